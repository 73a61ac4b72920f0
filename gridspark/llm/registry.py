"""The text operators' queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import decontaminate, exact_dedup, jaccard_join, language_id, licenses, line_dedup, merkle, packing, perspectives, runs, tiers, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_license_scan": licenses.query,
        "op3_language_id": language_id.query,
        "op4_line_dedup": line_dedup.query,
        "op5_benchmark_decontamination": decontaminate.query,
        "op6_warc_revisits": warc.query,
        "op7_best_fit_packing": packing.query,
        "op8_ngram_jaccard_join": jaccard_join.query,
        "op9_perspective_rotation": perspectives.query,
        "op10_toxicity_neighbours": toxicity.query,
        "op11_periodic_runs": runs.query,
        "op12_merkle_manifest": merkle.query,
        "op13_tiered_packing": tiers.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op4_line_dedup": line_dedup.ORACLE,
        "op6_warc_revisits": warc.ORACLE,
        "op9_perspective_rotation": perspectives.ORACLE,
        "op12_merkle_manifest": merkle.ORACLE,
    }
