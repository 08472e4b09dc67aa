"""Token ids of whole texts, by the tokenizers library.

For a vocabulary that drops white space, a text's ids are those of its words, so each task encodes a word once, in
large batches, and joins the ids. ``direct_ids`` is the plain library call that the tests hold it against.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import gather_runs

END_ID = 1
#: Words that a task remembers; a bound on memory only.
REMEMBERED = 500_000
#: ASCII symbols that may end a word. After a letter the pre-tokenizer parts them from it anyway; an apostrophe may start
#: a contraction and "<" a special token, so they are not among them.
_TAIL = bytes(sorted(set(range(0x21, 0x7F)) - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'<")))
_LOWER = frozenset(b"abcdefghijklmnopqrstuvwxyz")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def direct_ids(tokenizer, text: str) -> list[int]:
    return tokenizer.encode(text, add_special_tokens=False).ids


#: Texts that a tokenizer must encode like its words one by one: white space, case, contractions, tails of symbols,
#: digits, other scripts, combining marks, special tokens.
PROBES = [
    "Ab, c'd\n e1 ***x", "THE Quick brown FOX's don't I'LL we've", "wow!!! end.) (a) a|b {x}; y:: z--- q_ r@ s/ t\\ u^ v~ w` 5% 6$", "1,234.5 007 3x x3 12abc34",
    "\u00c9t\u00c9 \u00df \u0130i \u4f60\u597d \u043c\u0438\u0440 e\u0301 na\u00efve \u00a0x\u2003y", "<|endoftext|> a<|endoftext|>B <b> <|x", "\t\r\n\x0b\x0c a  b   c",
]


class WordEncoder:
    """Texts to ids (little-endian unsigned 32-bit).

    Only for tokenizers whose normaliser lower-cases and turns white space into a space, and whose pre-tokenizer removes
    it; the constructor tries ``PROBES`` on the file at hand and refuses it if any id differs.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        mark = model.get("end_of_word_suffix")
        if not mark:
            raise ValueError(f"{path}: word ends are not marked")
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for w, i in model["vocab"].items() if w.endswith(mark)]] = True
        self.seen: dict[bytes, bytes] = {b"": b""}
        ids, counts = self.encode(pa.array(PROBES))
        for text, end, n in zip(PROBES, np.cumsum(counts).tolist(), counts.tolist(), strict=True):
            if ids[end - n : end].tolist() != direct_ids(self.tokenizer, text):
                raise ValueError(f"{path}: ids are not those of lower-cased words one by one, as in {text!r}")
        self.seen = {b"": b""}

    def _learn(self, fresh: list[bytes]) -> None:
        """Encode words that are new; of those that end in symbols, the two parts."""
        seen, parts, wanted = self.seen, [], set()
        for w in fresh:
            head = w.rstrip(_TAIL)
            if head and len(head) < len(w) and head[-1] in _LOWER and b"<|" not in w:
                tail = w[len(head) :]
                parts.append((w, head, tail))
                wanted.add(head)
                wanted.add(tail)
            else:
                wanted.add(w)
        self._encode_words([w for w in wanted if w not in seen])
        for w, head, tail in parts:
            seen[w] = seen[head] + seen[tail]

    def _encode_words(self, fresh: list[bytes]) -> None:
        """Words of letters only are one pre-token each, so they go in one text and are cut at the word ends."""
        plain, odd = [], []
        for w, s in zip(fresh, [w.decode() for w in fresh], strict=True):
            (plain if s.isalpha() and s.lower().isalpha() else odd).append((w, s))
        texts = [" ".join([s for _, s in plain[i : i + 100]]) for i in range(0, len(plain), 100)]
        if texts:
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(plain):
                data, at = ids.tobytes(), 0
                for (w, _), end in zip(plain, (4 * ends).tolist(), strict=True):
                    self.seen[w] = data[at:end]
                    at = end
            else:
                odd += plain
        for (w, _), e in zip(odd, self.tokenizer.encode_batch_fast([s for _, s in odd], add_special_tokens=False), strict=True):
            self.seen[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        # special tokens are matched before lower-casing, so texts that may hold one are not lower-cased here
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.seen.get, distinct))
        if None in found:
            if len(self.seen) > REMEMBERED:
                self.seen = {b"": b""}
            self._learn([w for w in distinct if w not in self.seen])
            found = list(map(self.seen.__getitem__, distinct))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(found), "<u4")
        at = words.indices.to_numpy()
        sizes = lengths[at]
        ids = flat[gather_runs(starts[at], sizes)]
        ends = np.r_[0, np.cumsum(sizes)][offsets - offsets[0]]
        return ids, np.diff(ends)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each file in a Python worker; what it remembers outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def document_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text followed by the end id, one after the other; and the bounds (one more than texts)."""
    ids, counts = encoder(path).encode(texts)
    bounds = np.r_[0, np.cumsum(counts + 1)]
    out = np.full(bounds[-1], END_ID, "<u4")
    out[gather_runs(bounds[:-1], counts)] = ids
    return out, bounds
