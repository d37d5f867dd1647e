"""Log lines that Spark derives from the tabular inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.operators.carry import MAX_ROWS, ledger, scan, total
from logloom.session import written


def _line(kind: str, payload: Column) -> Column:
    return F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.lit(kind).alias("type"), payload.alias("payload"),
    ))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one log line; a user's events form one log file.

    The same reading of the events as in ``event_ledger``: signup starts or
    completes a turn, view is a message, click a call, error its output and
    purchase a token sample.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type", k.alias("k"),
        F.floor("value").cast("long").alias("amount"),
    )
    k, amount = F.col("k"), F.col("amount")
    turn, call = (k % 3).cast("string").alias("turn_id"), (k % 10).cast("string").alias("call_id")
    kind = lambda name: F.lit(name).alias("type")
    used = F.struct(
        amount.alias("input_tokens"), F.floor(amount / 3).cast("long").alias("cached_input_tokens"),
        k.alias("output_tokens"), F.floor(k / 4).cast("long").alias("reasoning_output_tokens"),
        (amount + k).alias("total_tokens"),
    )
    carried = F.when(k % 9 != 8, F.struct(
        F.when(k % 6 == 0, k).alias("output_tokens"), (F.col("event_id") + 1).alias("total_tokens")))
    window = F.struct((amount * 2).alias("used_percent"),
                      F.when(k % 7 == 0, 0).otherwise(300).alias("window_minutes"))
    raw = (
        F.when((F.col("event_type") == "signup") & (k % 2 == 1),
               _line("event_msg", F.struct(kind("task_started"), turn)))
        .when(F.col("event_type") == "signup",
              _line("event_msg", F.struct(kind("task_complete"), turn)))
        .when(F.col("event_type") == "view", _line("response_item", F.struct(
            kind("message"), F.lit("assistant").alias("role"),
            F.array(F.struct(F.lit("output_text").alias("type"),
                             F.concat(F.lit("said "), k.cast("string")).alias("text"))).alias("content"))))
        .when(F.col("event_type") == "click", _line("response_item", F.struct(
            kind("function_call"), call, F.lit("tool").alias("namespace"),
            (k % 10).cast("string").alias("name"))))
        .when(F.col("event_type") == "error", _line("response_item", F.struct(
            kind("function_call_output"), call,
            F.when(k % 4 == 0, '{"success": false}').otherwise("fine").alias("output"))))
        .otherwise(_line("event_msg", F.struct(
            kind("token_count"),
            F.struct(used.alias("last_token_usage"), carried.alias("total_token_usage")).alias("info"),
            F.struct(window.alias("primary")).alias("rate_limits"))))
    )
    return events.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("file"),
        F.lit(None).cast("long").alias("file_size"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', cast(ts AS TIMESTAMP_NTZ))")
        .alias("block"),
        F.col("event_id").alias("position"), raw.alias("raw"),
    )


def _events(spark: SparkSession, sf_dir: str, raw: Column) -> DataFrame:
    """The events as log lines, a user's events in one log; ``raw`` is the line over ts, event_type and k."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return events.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("file"), F.lit(None).cast("long").alias("file_size"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', cast(ts AS TIMESTAMP_NTZ))").alias("block"),
        F.col("event_id").alias("position"), raw.alias("raw"))


def compaction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages, completed turns, and compactions: a purchase is a checkpoint, a click the end of one."""
    kind = lambda name: F.lit(name).alias("type")
    said = F.array(F.struct(F.lit("output_text").alias("type"), F.lit("said").alias("text"))).alias("content")
    return _events(spark, sf_dir, (
        F.when(F.col("event_type") == "signup", _line("event_msg", F.struct(kind("task_complete"))))
        .when(F.col("event_type") == "purchase", _line("compacted", F.struct(F.lit("less").alias("message"))))
        .when(F.col("event_type") == "click", _line("event_msg", F.struct(kind("context_compacted"))))
        .otherwise(_line("response_item", F.struct(kind("message"), F.lit("assistant").alias("role"), said)))))


def renaming_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as calls of a generic or a specific name, errors as ends that name the tool or its server, or neither."""
    k = F.col("k")
    call, number = (k % 10).cast("string").alias("call_id"), (k % 2).cast("string")
    invocation = F.struct(F.when(k % 3 == 1, "s").alias("server"),
                          F.when(k % 3 != 0, F.concat(F.when(k % 3 == 1, "t").otherwise("u"), number)).alias("tool"))
    return _events(spark, sf_dir, (
        F.when(F.col("event_type") == "click", _line("response_item", F.struct(
            F.lit("function_call").alias("type"), call, F.when(k % 2 == 0, "tool").otherwise("find").alias("name"))))
        .when(F.col("event_type") == "error", _line("event_msg", F.struct(
            F.lit("mcp_tool_call_end").alias("type"), call, invocation.alias("invocation"))))
        .otherwise(_line("event_msg", F.struct(F.lit("thread_settings").alias("type"))))))


def files_of(raw: DataFrame) -> DataFrame:
    """File table of derived lines."""
    return raw.groupBy("file").agg(F.max("block").alias("modified_us")).select(
        "file", F.col("file").alias("stem"), tx.rollout_id(F.col("file")).alias("rollout_id"),
        F.lit(None).cast("long").alias("file_size"), "modified_us",
        F.floor(F.col("modified_us") / 1000).cast("long").alias("modified_ms"),
        F.lit(False).alias("archived"),
    )


def faulty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The props text of every event, damaged in a way its k decides; good where k%8=0, blank where k%8=5."""
    k = F.get_json_object("props", "$.k").cast("long")
    raw = (
        F.when(k % 8 == 0, F.col("props"))
        .when(k % 8 == 1, F.concat(F.col("props"), F.lit(" x")))
        .when(k % 8 == 2, F.concat(F.lit("["), "props", F.lit("]")))
        .when(k % 8 == 3, F.concat(F.lit('{"a": '), "props", F.lit(', "a": 2}')))
        .when(k % 8 == 4, F.concat(F.lit('{"p": '), "props", F.lit(', "a": NaN}')))
        .when(k % 8 == 5, F.lit("  "))
        .when(k % 8 == 6, F.concat(F.lit('{"p": '), "props", F.lit(', "a": 1e400}')))
        .otherwise(F.concat(F.lit('{"p": '), "props", F.lit(', "a": '), F.repeat(F.lit("7"), 257), F.lit("}")))
    )
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("file"),
        F.lit(None).cast("long").alias("file_size"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', cast(ts AS TIMESTAMP_NTZ))")
        .alias("block"),
        F.col("event_id").alias("position"), raw.alias("raw"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, as if the documents were log files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"),
        F.lit(None).cast("long").alias("file_size"), F.lit(0).cast("long").alias("block"),
        F.posexplode(F.split("text", "\n")).alias("position", "raw"),
    )


def desk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as logs with metadata, attachments, measured tool ends and a context window.

    User rows carry attachments, assistant rows a phase and a token sample behind them, and a
    system row is the end of a tool call that gave its duration, arguments and result.
    """
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    c, n, text = F.col("conv_id"), F.col("n"), F.col("text")
    talk = talk.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))
    word = lambda prefix, number: F.concat(F.lit(prefix), number.cast("string"))
    event = lambda *fields: F.to_json(F.struct(
        F.lit("event_msg").alias("type"), F.struct(*fields).alias("payload")))
    user = event(
        F.lit("user_message").alias("type"), text.alias("message"),
        F.array_repeat(F.lit("i"), (F.length("text") % 3).cast("int")).alias("images"),
        F.array_repeat(F.lit("a"), (n % 2).cast("int")).alias("audio"))
    said = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(
        F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.when(n % 2 == 0, "final").alias("phase"),
        F.array(F.struct(F.lit("output_text").alias("type"), text.alias("text"))).alias("content")).alias("payload")))
    result = F.struct(F.when(n % 4 != 0, F.struct(n.alias("v"))).alias("Ok"), F.when(n % 4 == 0, "bad").alias("Err"))
    ended = event(
        F.lit("mcp_tool_call_end").alias("type"), word("c", n).alias("call_id"),
        F.struct(n.alias("secs"), F.lit(250_000_000).alias("nanos")).alias("duration"),
        F.struct(F.lit("s").alias("server"), word("t", n % 3).alias("tool"), F.struct(n.alias("n")).alias("arguments"))
        .alias("invocation"), result.alias("result"))
    sample = event(F.lit("token_count").alias("type"), F.struct((n + 1000).alias("model_context_window")).alias("info"))
    rows = talk.select("conv_id", (n * 10).alias("position"), F.when(F.col("role") == "user", user).when(
        F.col("role") == "assistant", said).otherwise(ended).alias("raw"))
    samples = talk.where("role = 'assistant'").select("conv_id", (n * 10 + 1).alias("position"), sample.alias("raw"))
    source = F.when(c % 3 == 0, F.lit('"CLI"')).when(c % 3 == 1, F.lit('{"subagent": {"depth": 1}}')).otherwise(F.lit('"nowhere"'))
    heads = talk.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("position"), F.concat(
        F.lit('{"type": "session_meta", "payload": {"id": "desk-'), c.cast("string"), F.lit('", "originator": "desk", "cwd": "/root/p'),
        (c % 5).cast("string"), F.lit('", "instructions": "hidden", "source": '), source, F.lit(', "git": {"branch": "b'),
        (c % 4).cast("string"), F.lit('", "repository_url": "hidden", "commit_hash": "'), F.lpad(c.cast("string"), 10, "a"), F.lit('"}}}')).alias("raw"))
    return rows.unionByName(samples).unionByName(heads).select(
        word("desk-", c).alias("file"), F.lit(None).cast("long").alias("file_size"),
        F.lit(0).cast("long").alias("block"), "position", "raw")


def _uuid(conv: Column) -> Column:
    return F.concat(F.lpad(conv.cast("string"), 8, "0"), F.lit("-0000-4000-8000-000000000000"))


def inherited_lines(spark: SparkSession, sf_dir: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Conversations as paginated logs that inherit from each other in threes.

    Conversation 3n starts a history, 3n+1 goes on after the first half of 3n, and
    3n+2 after the first half of what 3n+1 added. A log states where its source is
    cut in entries and in bytes, so the three groups are built one after the other.
    """
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("place"), "role", "text")
    talk = scan(ledger(talk, ["place"], max_rows), total("n", F.lit(1)))
    halves = talk.groupBy("session").agg(F.floor(F.count(F.lit(1)) / 2).cast("long").alias("half"))
    talk = written(talk.select("session", "n", "role", "text").join(halves, "session"), "talk")
    halves = talk.filter("n = 1").select("session", "half")
    stated = None
    parts = []
    for step in range(3):
        group = F.pmod(F.col("session"), F.lit(3)) == step
        convs = halves.filter(group)
        empty = "base_id string, end_ordinal long, end_byte long"
        base = stated if stated is not None else spark.createDataFrame([], f"session long, {empty}")
        convs = convs.join(base, "session", "left").withColumn(
            "first", F.coalesce(F.col("end_ordinal"), F.lit(0).cast("long")))
        history = F.when(F.col("base_id").isNotNull(), F.struct(
            F.col("base_id").alias("thread_id"), F.col("end_ordinal").alias("end_ordinal_exclusive"),
            F.col("end_byte").alias("end_byte_offset")))
        heads = convs.select("session", "half", F.lit(0).cast("long").alias("n"), F.to_json(F.struct(
            F.lit("session_meta").alias("type"), F.col("first").alias("ordinal"),
            F.struct(_uuid(F.col("session")).alias("id"), F.lit("paginated").alias("history_mode"),
                     history.alias("history_base")).alias("payload"))).alias("raw"))
        item = F.struct(
            F.when(F.col("role") == "user", "UserMessage").otherwise("AgentMessage").alias("type"),
            F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"))
        ordinal = (F.col("first") + F.col("n")).alias("ordinal")
        line = F.when(F.col("role") == "system", F.to_json(F.struct(
            F.lit("turn_context").alias("type"), ordinal, F.struct(F.lit("m").alias("model")).alias("payload"),
        ))).otherwise(F.to_json(F.struct(
            F.lit("event_msg").alias("type"), ordinal,
            F.struct(F.lit("item_completed").alias("type"), F.lit("t").alias("turn_id"),
                     item.alias("item")).alias("payload"))))
        body = talk.filter(group).join(convs.select("session", "first"), "session").select(
            "session", "half", "n", line.alias("raw"))
        group_lines = written(heads.unionByName(body), f"group{step}")
        parts.append(group_lines)
        stated = group_lines.groupBy("session").agg(
            F.min(F.get_json_object("raw", "$.ordinal").cast("long")).alias("first"),
            F.first("half").alias("half"),
            F.sum(F.when(F.col("n") <= F.col("half"), F.octet_length("raw") + 1)).alias("end_byte"),
        ).select(
            (F.col("session") + 1).alias("session"), _uuid(F.col("session")).alias("base_id"),
            (F.col("first") + F.col("half") + 1).alias("end_ordinal"), "end_byte")
    return reduce(DataFrame.unionByName, parts).select(
        F.concat(F.lit("log-"), _uuid(F.col("session"))).alias("file"),
        F.lit(None).cast("long").alias("file_size"), F.lit(0).cast("long").alias("block"),
        F.col("n").alias("position"), "raw",
    )
