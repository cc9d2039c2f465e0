"""Queries of this subpackage by name, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tieout.llm import decontaminate, divergence, hardnegatives, kneser_ney, linededup, mixing, neardup, pii, quality, sharding, tokenstore, toxicity, webp
from tieout.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def shipped(query: Query) -> Query:
    """``query`` after the workers have the package."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    "op1_kneser_ney": shipped(kneser_ney.op1_kneser_ney),
    "op2_quality": shipped(quality.op2_quality),
    "op3_personal_data": shipped(pii.op3_personal_data),
    "op4_mixing": mixing.op4_mixing,
    "op5_token_store": shipped(tokenstore.op5_token_store),
    "op6_decontamination": shipped(decontaminate.op6_decontamination),
    "op7_near_duplicates": shipped(neardup.op7_near_duplicates),
    "op8_sharding": sharding.op8_sharding,
    "op9_webp": shipped(webp.op9_webp),
    "op10_toxicity": shipped(toxicity.op10_toxicity),
    "op11_line_dedup": linededup.op11_line_dedup,
    "op12_hard_negatives": shipped(hardnegatives.op12_hard_negatives),
    "op13_divergence": shipped(divergence.op13_divergence),
}
ORACLE_SQL: dict[str, str] = {"op11_line_dedup": linededup.ORACLE_SQL, "op12_hard_negatives": hardnegatives.ORACLE_SQL, "op13_divergence": divergence.ORACLE_SQL}
