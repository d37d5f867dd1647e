"""JSONL session logs: file listing, lines with their place, and admission of each line."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.functions import variant as vx
from logloom.operators.carry import ledger, scan, total

#: Largest accepted line, its newline included (fixed value: 16 MiB).
MAX_LINE_BYTES = 16 * 1024 * 1024

_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:/+"

REJECTS = ("oversized_jsonl", "malformed_utf8", "malformed_jsonl", "non_object_jsonl")


def _roots(spark: SparkSession, active: str, archived: str | None) -> list[str]:
    """The roots that exist; a missing one simply holds no logs."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    roots = [r for r in (active, archived) if r and to_path(r).getFileSystem(conf).exists(to_path(r))]
    if not roots:
        raise ValueError("no session logs were found")
    return roots


def list_rollouts(spark: SparkSession, active: str, archived: str | None = None) -> DataFrame:
    """One row per log file: path, stem, file UUID, size, time, archived. Reads no content."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.jsonl").load(_roots(spark, active, archived))
    )
    path, modified = F.col("_metadata.file_path"), F.col("_metadata.file_modification_time")
    in_archive = F.lit(False)
    if archived:
        place = F.regexp_replace(tx.plain_path(path), _SCHEME, "/")
        in_archive = place.startswith(re.sub(_SCHEME, "/", archived).rstrip("/") + "/")
    return files.select(
        path.alias("file"),
        tx.file_stem(tx.plain_path(path)).alias("stem"),
        tx.rollout_id(tx.file_stem(tx.plain_path(path))).alias("rollout_id"),
        F.col("_metadata.file_size").alias("file_size"),
        F.unix_micros(modified).alias("modified_us"),
        F.unix_millis(modified).alias("modified_ms"),
        in_archive.alias("archived"),
    )


def read_lines(spark: SparkSession, active: str, archived: str | None = None) -> DataFrame:
    """Every line of every log with its file and its position inside the file."""
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
        .option("lineSep", "\n").text(_roots(spark, active, archived))
    )
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
        F.col("value").alias("raw"),
    )


def admit(lines: DataFrame) -> DataFrame:
    """Add ``entry`` (the parsed object) and ``reject`` (why a line is refused).

    A blank line has neither. Good lines go on whatever their neighbours are.
    """
    raw = F.col("raw")
    size = F.octet_length(raw) + 1
    blank = raw.rlike(r"^[ \t\x0b\f\r]*$")
    fits = (size <= MAX_LINE_BYTES) & F.is_valid_utf8(raw)
    # two steps, so that each line is parsed once
    parsed = lines.withColumns({
        "size": size.cast("long"), "__closed": F.when(fits, vx.closed(raw)),
    }).withColumn("__value", vx.opened(raw, F.col("__closed")))
    is_object = raw.rlike(r"^[ \t\r]*\{")
    reject = (
        F.when(size > MAX_LINE_BYTES, "oversized_jsonl")
        .when(blank, None)
        .when(~F.is_valid_utf8(raw), "malformed_utf8")
        .when(F.col("__value").isNull(), "malformed_jsonl")
        .when(~is_object, "non_object_jsonl")
    )
    return parsed.withColumn("reject", reject).withColumn(
        "entry", F.when(F.col("reject").isNull(), F.col("__value"))
    ).drop("__value", "__closed", "raw")


def frame(rows: DataFrame, max_rows: int, size: tuple[int, int]) -> DataFrame:
    """Line number, byte end and count of refused lines so far, per file.

    Call this on narrow rows: only they are shuffled. ``size`` is the number of lines of the
    largest file and of all (``measured`` on the raw lines); one task sorts at most ``max_rows`` of a file. An
    unfinished last line reaches past the file size and is left for the next read.
    """
    rows = ledger(rows.withColumn("session", F.col("file")), ["block", "position"], max_rows, size)
    rows = scan(
        rows, total("line_no", F.lit(1)), total("byte_end", F.col("size")),
        total("rejects", F.col("reject").isNotNull()),
    )
    finished = F.coalesce(F.col("byte_end") <= F.col("file_size"), F.lit(True))
    return rows.filter(finished).drop("session", "seq", "chunk", "block", "position", "file_size")


def quarantine(rows: DataFrame) -> DataFrame:
    """Refused lines of framed rows: file, line number, code, and the byte each begins at."""
    return rows.filter("reject is not null").select(
        "file", "line_no", F.col("reject").alias("code"), (F.col("byte_end") - F.col("size")).alias("begins"))
