"""Sum-of-squares packing against trying every placement, and the packed documents against the library's ids."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import best_fit
from tidemark.llm.tokens import default_path, direct_ids, load


def by_trial(sizes: list[int], capacity: int) -> list[list[int]]:
    """Each piece where the sum of squared counts of open gaps is smallest, by computing that sum for every choice."""
    bins: list[list[int]] = []
    gap = lambda b: capacity - sum(sizes[i] for i in b)

    def cost(of):
        open_ = [g for g in map(gap, of) if g]
        return sum(open_.count(g) ** 2 for g in set(open_))

    for i, s in enumerate(sizes):
        choices = [(cost([*bins[:k], [*b, i], *bins[k + 1 :]]), gap(b), -k, k) for k, b in enumerate(bins) if gap(b) >= s]
        choices.append((cost([*bins, [i]]), capacity + 1, 0, None))
        k = min(choices)[3]
        if k is None:
            bins.append([i])
        else:
            bins.append([*bins.pop(k), i])  # the newest of its gap, as a stack has it
    return bins


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 12), max_size=40), st.integers(12, 20))
def test_every_placement_is_the_best(sizes, capacity):
    packer = best_fit.SumOfSquares(capacity)
    out = [done for i, s in enumerate(sizes) if (done := packer.place(i, s))]
    out += [pieces for _, pieces in packer.drain()]
    assert sorted(map(tuple, out)) == sorted(map(tuple, by_trial(sizes, capacity)))


def test_a_limit_on_open_sequences_drops_nothing():
    packer = best_fit.SumOfSquares(100, open_limit=5)
    sizes = [51 + i % 40 for i in range(300)]
    out = [done for i, s in enumerate(sizes) if (done := packer.place(i, s))]
    assert packer.n_open <= 5
    out += [pieces for _, pieces in packer.drain()]
    assert sorted(i for b in out for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= 100 for b in out)
    assert list(packer.drain()) == [] and packer.place("x", 100) == ["x"]


def check(rows, ids, capacity) -> int:
    """All contract conditions; returns the number of sequences."""
    whole: dict = {}
    for i, x in ids:
        whole.setdefault(i, []).append(x)
    want = sorted(
        (repr(i), k, a, min(capacity, len(x) - a), zlib.crc32(x[a : a + capacity])) for i, x in ids for k, a in enumerate(range(0, len(x), capacity))
    )
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for found in sequences.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == np.r_[0, np.cumsum([r.length for r in found])][:-1].tolist()
        assert sum(r.length for r in found) <= capacity
    return len(sequences)


@pytest.mark.parametrize("kind", ["odd", "real"])
def test_documents(spark, odd_dir, sf_dir, kind):
    folder = odd_dir if kind == "odd" else sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    t = load(default_path())
    ids = [(r.doc_id, np.array([*direct_ids(t, r.text or ""), 1], "<u4")) for r in docs.select("doc_id", "text").collect()]
    total = sum(len(x) for _, x in ids)
    found = check(best_fit.op12_best_fit(spark, folder).collect(), ids, 4096)
    assert found <= -(-total // 4096) + 2
    # many tasks, small sequences, chunks and pools: the second level gathers what the first left open
    some = docs.repartition(40)
    packed = best_fit.pack_documents(some, capacity=300, chunk=7, open_limit=6).collect()
    found = check(packed, ids, 300)
    assert any(r.sequence_id >= best_fit.SECOND for r in packed)
    assert found <= 1.1 * total / 300 + 2
