"""Session settings the engine was measured with."""

import re

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # bloom filters from the small side of a lookup reach the scan of the large one
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # a wide cleansing projection in one generated method is past what the JVM compiles;
    # Spark then splits it into several, which runs about twice as fast
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
BROADCAST_MEASURED = "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Files of more bytes are not broadcast by their size alone: pinned ids take a byte or two a row there, and sixty in the driver's memory.
BROADCAST_FILES = 512 << 10
UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}


def byte_count(text: str) -> int:
    """Bytes of a setting such as ``10485760b`` or ``10MB``."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", text.strip().lower()).groups()
    return int(number) << UNITS[unit]


def tune(spark: SparkSession) -> SparkSession:
    """The settings above that a running session still takes; all of them are per session.

    The session's own limit for broadcasts then holds for what a stage has written, whose size is known; what is planned from
    the size of compressed files has a lower one.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", SETTINGS["spark.sql.codegen.hugeMethodLimit"])
    limit = byte_count(spark.conf.get(BROADCAST))
    if limit > BROADCAST_FILES:
        if spark.conf.get(BROADCAST_MEASURED, None) is None:
            spark.conf.set(BROADCAST_MEASURED, str(limit))
        spark.conf.set(BROADCAST, str(BROADCAST_FILES))
    return spark


def local_session(name: str, cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """One JVM on this machine, for tests and the benchmark; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
