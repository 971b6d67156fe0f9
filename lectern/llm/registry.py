"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontamination, licenses, line_dedup, ngram_join, packing, pii, quality, ranked_search, secrets, shards, shuffle, toxicity, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_training_order": shards.op7_training_order,
        "op8_pii": pii.op8_pii,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_hypergeometric_shuffle": shuffle.op11_hypergeometric_shuffle,
        "op12_best_position_search": ranked_search.op12_best_position_search,
        "op13_prefix_trie": trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    """The other operators learn, tokenise or estimate; they are tested against brute force and held-out rows."""
    return {"op2_secret_scan": secrets.oracle(), "op4_ngram_join": ngram_join.ORACLE, "op12_best_position_search": ranked_search.ORACLE, "op13_prefix_trie": trie.ORACLE}
