"""The training-data queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import chat, decontam, lm, mixing, quality, repeats, resample, sharding, simhash, tokencount, tokenids, vectorcode, warc


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    run.__name__ = query.__name__
    return run


QUERIES = {k: shipped(v) for k, v in {
    "op1_sharding": sharding.query,
    "op2_quality": quality.query,
    "op3_tokenids": tokenids.query,
    "op4_repeats": repeats.query,
    "op5_tokencount": tokencount.query,
    "op6_chat": chat.query,
    "op7_lm": lm.query,
    "op8_mixing": mixing.query,
    "op9_decontam": decontam.query,
    "op10_simhash": simhash.query,
    "op11_warc": warc.query,
    "op12_vectorcode": vectorcode.query,
    "op13_resample": resample.query,
}.items()}
ORACLES = {"op2_quality": quality.ORACLE, "op6_chat": chat.ORACLE, "op8_mixing": mixing.ORACLE, "op11_warc": warc.ORACLE, "op12_vectorcode": vectorcode.ORACLE}
