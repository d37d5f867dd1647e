"""Live update: only sessions that got new lines are projected again.

Logs arrive as newline-cut chunk files ``<session>/<chunk>.jsonl`` (an append to
a file is invisible to a file stream). Each micro-batch keeps its lines as one
part of a line table and projects the changed sessions with the batch code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.functions import arguments
from logloom.operators import pages
from logloom.plans import build

class LiveUpdates:
    """Line table, update table and revision table under one folder.

    Every micro-batch writes its own part under its batch id, so a batch that is
    run again after a failure replaces its part. A table write is atomic only per
    part; a reader takes the newest part of each session.
    """

    def __init__(self, spark: SparkSession, landing: str, tables: str, buckets: int = 64):
        self.spark, self.landing, self.tables, self.buckets = spark, landing, tables, buckets

    def start(self, checkpoint: str, available_now: bool = False, files_per_trigger: int = 1000) -> StreamingQuery:
        """Start the update job; ``available_now`` works off what lies there and stops."""
        lines = (
            self.spark.readStream.schema("value string").format("text")
            .option("lineSep", "\n").option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_trigger)
            .load(self.landing)
            .select("value", F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_block_start").alias("start"))
        )
        writer = lines.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
            processingTime="1 second")
        return writer.start()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        parts = F.split("path", "/")
        session = F.element_at(parts, -2)
        chunk = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "")
        keyed = batch.select(
            session.alias("file"), chunk.alias("chunk"), F.col("start").alias("block"),
            F.monotonically_increasing_id().alias("position"),
            F.col("value").alias("raw"),
            F.pmod(F.xxhash64(session), F.lit(self.buckets)).cast("int").alias("bucket"),
        )
        keyed.write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.tables}/lines/batch={batch_id}")
        arrived = self.spark.read.parquet(f"{self.tables}/lines/batch={batch_id}")
        if not arrived.head(1):
            return
        changed = arrived.select("file", "bucket").distinct()
        # one file of the landing folder holds whole lines, so chunks in name order are the log
        history = (
            self.spark.read.option("basePath", f"{self.tables}/lines").parquet(f"{self.tables}/lines")
            .filter(F.col("batch") <= batch_id)
            .join(changed, ["bucket", "file"], "left_semi")
        )
        raw = history.select(
            "file", F.lit(None).cast("long").alias("file_size"),
            F.struct("chunk", "block").alias("block"), "position", "raw",
        )
        logs = build.from_lines(self._files(history), raw)
        # a session can have any number of chunks: its revision is a digest of plain aggregates
        revisions = history.groupBy(F.col("file").alias("session")).agg(F.sha2(F.concat_ws(
            "|", F.max("chunk"), F.count(F.lit(1)), F.sum(F.octet_length("raw") + 1),
            F.bit_xor(F.xxhash64("chunk", "block", "raw")),
        ), 256).alias("revision"))
        records = build.records(logs)
        self._put("records", records.join(revisions, "session"), batch_id)
        newest = pages.newest_page(records, arguments.LIVE_RECORDS)
        self._put("live_records", newest.join(revisions, "session"), batch_id)
        self._put("turns", build.turns(logs), batch_id)
        self._put("sessions", build.sessions(logs).withColumnRenamed("file", "session")
                  .join(revisions, "session"), batch_id)

    def _files(self, history: DataFrame) -> DataFrame:
        return history.groupBy("file").agg(F.max("batch").alias("b")).select(
            "file", F.col("file").alias("stem"), F.lit(None).cast("string").alias("rollout_id"),
            F.lit(None).cast("long").alias("file_size"), F.lit(None).cast("long").alias("modified_us"),
            F.col("b").cast("long").alias("modified_ms"), F.lit(False).alias("archived"),
        )

    def _put(self, name: str, table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.tables}/{name}/batch={batch_id}")

    def current(self, name: str) -> DataFrame:
        """The newest state of every session in one of the output tables."""
        table = self.spark.read.option("basePath", f"{self.tables}/{name}").parquet(f"{self.tables}/{name}")
        newest = table.groupBy("session").agg(F.max("batch").alias("batch"))
        return table.join(newest, ["session", "batch"], "left_semi").drop("batch")

    def update(self, session: str, revision: str | None) -> DataFrame:
        """The session's live records, none when the caller's revision is still the current one."""
        known = arguments.revision(revision)
        rows = self.current("live_records").filter(F.col("session") == session)
        return rows.filter(F.col("revision") != known) if known else rows
