"""Queries of the operators in this sub-package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown, exact_dedup, mixing, mpegts, near_dedup, packing, sharding, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mpeg_ts": mpegts.query,
    "op2_systematic_mix": mixing.query,
    "op3_warc_chain": warc.query,
    "op4_monotone_packing": packing.query,
    "op5_kd_tree_shards": sharding.query,
    "op6_extendible_hash_dedup": exact_dedup.query,
    "op7_brown_classes": brown.query,
    "op8_subword_toxicity": toxicity.query,
    "op9_bayes_minhash_dedup": near_dedup.query,
    "op10_bloom_cascade": url_filter.query,
}

SQL: dict[str, str] = {
    "op3_warc_chain": warc.SQL,
    "op6_extendible_hash_dedup": exact_dedup.SQL,
    "op10_bloom_cascade": url_filter.SQL,
}
