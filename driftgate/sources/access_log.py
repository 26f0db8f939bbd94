"""Access-log lines ``timestamp;clientID;objectID;size;method;status;type;server`` as event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftgate.functions.keys import pair_key, site_of

LINE_SCHEMA = (
    "timestamp BIGINT, clientID INT, objectID STRING, size STRING, method STRING, status STRING, type INT, server INT"
)
END_MARK = "EOF"


def to_events(fields: DataFrame, k: int) -> DataFrame:
    """``(site, ts_ms, a, b, x, val)``; log times are seconds."""
    return fields.select(
        site_of(F.col("server"), k).alias("site"),
        (F.col("timestamp") * 1000).alias("ts_ms"),
        F.col("clientID").cast("bigint").alias("a"),
        F.col("type").cast("bigint").alias("b"),
        pair_key(F.col("clientID"), F.col("type")).alias("x"),
        F.lit(1.0).alias("val"),
    )


def parse_lines(lines: DataFrame, k: int, mode: str = "FAILFAST") -> DataFrame:
    """Events from a ``value`` text column, batch or streaming. The end mark is skipped.

    A malformed line fails the job; with ``PERMISSIVE`` it is left out.
    """
    kept = lines.filter(F.col("value") != END_MARK)
    if mode == "FAILFAST":
        # a wrong field count must fail too, even in fields that are not kept
        complete = F.size(F.split("value", ";")) == 8
        checked = F.when(complete, F.col("value")).otherwise(
            F.raise_error(F.concat(F.lit("malformed log line: "), F.col("value")))
        )
        kept = kept.select(checked.alias("value"))
    parsed = kept.select(F.from_csv("value", LINE_SCHEMA, {"sep": ";", "mode": mode}).alias("f")).select("f.*")
    if mode != "FAILFAST":
        parsed = parsed.dropna(subset=["timestamp", "clientID", "type", "server"])
    return to_events(parsed, k)


def read_files(spark: SparkSession, path: str, k: int, mode: str = "FAILFAST") -> DataFrame:
    """Log files as one batch; splits of large files are read in parallel."""
    return parse_lines(spark.read.text(path), k, mode)


def stream_files(spark: SparkSession, path: str, k: int, files_per_trigger: int = 1) -> DataFrame:
    """Log files of a folder as a stream; with ``availableNow`` it ends at the last file."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return parse_lines(lines, k)


def stream_topic(spark: SparkSession, servers: str, topic: str, k: int, **options: str) -> DataFrame:
    """A text topic from its earliest offset. Needs the Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    for name, value in options.items():
        reader = reader.option(name, value)
    return parse_lines(reader.load().select(F.col("value").cast("string").alias("value")), k)


def to_lines(fields: DataFrame) -> DataFrame:
    """Rows with the eight log fields back to text lines."""
    names = [c.split()[0] for c in LINE_SCHEMA.split(", ")]
    return fields.select(F.concat_ws(";", *[F.col(n).cast("string") for n in names]).alias("value"))
