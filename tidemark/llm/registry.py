"""The contract queries of the numbered operators and the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, decontaminate, filter_audit, language_crf, packing, pii, pu_quality, quality_rules, secrets, simhash, token_store, url_filter, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_packing": packing.op2_packing,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_secrets": secrets.op4_secrets,
        "op5_pu_quality": pu_quality.op5_pu_quality,
        "op6_simhash": simhash.op6_simhash,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_language": language_crf.op9_language,
        "op10_token_store": token_store.op10_token_store,
        "op11_whitening": whitening.op11_whitening,
        "op12_best_fit": best_fit.op12_best_fit,
        "op13_filter_audit": filter_audit.op13_filter_audit,
        "packed_conversations": packing.packed_conversations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pii": pii.SQL,
        "op3_quality_rules": quality_rules.SQL,
        "op4_secrets": secrets.SQL,
        "op7_url_filter": url_filter.SQL,
        "op8_decontaminate": decontaminate.SQL,
        "op13_filter_audit": filter_audit.SQL,
    }
