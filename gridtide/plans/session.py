"""Session settings that suit this workload. The operators do not depend on any of them."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot keys: a partition far above the median is split and its partner repeated.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Compressed Parquet unpacks to several times its size, so a fact table of a few MB on disk is
    # no broadcast candidate. Dictionaries are far smaller.
    "spark.sql.autoBroadcastJoinThreshold": "1MB",
    # Where the measured build side of every partition is below this, AQE hashes instead of sorting
    # both sides; above it the sort-merge join, which can spill, stays.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Field names that differ only in case stay apart.
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles a method beyond 8,000 bytes. Long formulas fused into one method would be
    # interpreted; with this limit Spark runs such a stage operator by operator, in small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
