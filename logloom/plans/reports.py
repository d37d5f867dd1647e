"""Reports over the tabular inputs, each a function of (spark, sf_dir)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.operators import pages, quota, usage
from logloom.operators.carry import MAX_ROWS, measured, scan, total
from logloom.operators.defaults import COUNTERS
from logloom.operators.late import add_late_markers
from logloom.operators.sequence import add_index, add_owner, role_in, sequence
from logloom.operators.tools import fold_results, orphan_results, tool_latencies, tool_totals
from logloom.plans import build, contract, document, gold, overview, store
from logloom.session import checkpoint_dir, spread
from logloom.sources import derived, lines
from logloom.sources.tables import conversation_ledger, event_ledger, with_samples


def _rows(spark: SparkSession, sf_dir: str, max_rows: int = MAX_ROWS) -> DataFrame:
    return sequence(event_ledger(spark, sf_dir, max_rows))


def _sampled(spark: SparkSession, sf_dir: str, max_rows: int = MAX_ROWS) -> DataFrame:
    return usage.add_samples(sequence(with_samples(event_ledger(spark, sf_dir, max_rows))))


def _records(rows: DataFrame) -> DataFrame:
    """Record rows of the event ledger with the folded results of each call."""
    own, is_tool = F.col("own"), F.col("own.role") != "M"
    event = F.when(own["role"] == "M", "Assistant").when(
        own["role"] == "T", F.concat(F.lit("tool "), own["call"])
    ).otherwise("Tool result")
    status = F.when(is_tool, F.col("tool_status")).otherwise("complete")
    return gold.folded_records(rows, "event_id").select(
        "session", "own.index", "own.event_id", "own.turn", "own.step",
        F.when(is_tool, "tool").otherwise("assistant").alias("kind"), event.alias("event"), "own.call",
        F.when(is_tool, F.concat_ws(" · ", event, status)).otherwise(event).alias("summary"),
        status.alias("status"), F.col("own.start_ms").alias("started_ms"),
        F.when(is_tool, F.col("finished_ms")).otherwise(F.col("own.start_ms")).alias("completed_ms"),
        F.when(is_tool, F.col("took_ms")).alias("duration_ms"), "error",
    )


# --- ledger, turns, steps -------------------------------------------------------------------


def record_ledger(spark, sf_dir, max_rows=MAX_ROWS):
    return _records(_rows(spark, sf_dir, max_rows))


def turn_islands(spark, sf_dir, max_rows=MAX_ROWS):
    return _rows(spark, sf_dir, max_rows).select(
        "session", "event_id", "role", "turn", "opens", "split", "live"
    )


def model_steps(spark, sf_dir, max_rows=MAX_ROWS):
    return _rows(spark, sf_dir, max_rows).select("session", "event_id", "turn", "step", "index")


def turn_rollup(spark, sf_dir, max_rows=MAX_ROWS):
    return gold.turns(_sampled(spark, sf_dir, max_rows)).select(
        "session", "turn", "id", "started_ms", "completed_ms", "duration_ms", "status", "cut_by",
        "records", "steps", "model_calls", "used_total",
    )


def superseded_turns(spark, sf_dir, max_rows=MAX_ROWS):
    codes = F.when(F.col("cut_by") == "S", "overlapping_turn_start").when(
        F.col("cut_by") == "C", "mismatched_turn_completion"
    ).otherwise("mismatched_item_turn")
    return gold.turns(_rows(spark, sf_dir, max_rows)).filter("cut_by is not null").select(
        "session", "turn", "id", codes.alias("code"), "started_ms", "completed_ms", "duration_ms"
    )


def model_context(spark, sf_dir, max_rows=MAX_ROWS):
    """Model per turn: purchase rows with k%4=1 act as context rows, starts with k%3=0 name a model."""
    rows = event_ledger(spark, sf_dir, max_rows)
    context = role_in("K") & (F.col("k") % 4 == 1)
    name = F.concat(F.lit("m"), (F.col("k") % 5).cast("string"))
    rows = rows.withColumns({
        "in_context": context,
        "model": F.when(context & (F.col("k") % 8 == 1), name)
        .when(role_in("S") & (F.col("k") % 3 == 0), name),
    })
    return gold.turns(gold.add_model(sequence(rows))).select("session", "turn", "model")


# --- tools ----------------------------------------------------------------------------------


def tool_correlation(spark, sf_dir, max_rows=MAX_ROWS):
    """Every tool output with the record it belongs to."""
    rows = add_owner(event_ledger(spark, sf_dir, max_rows))
    owners = rows.filter(role_in("T", "R") & F.col("creates")).select(
        "session", F.col("seq").alias("owner"), F.col("event_id").alias("owner_event_id"),
        F.col("role").alias("owner_role"),
    )
    return rows.filter(role_in("R")).join(owners, ["session", "owner"]).select(
        "session", "event_id", "call", "owner_event_id", "owner_role"
    )


def tool_fold(spark, sf_dir, max_rows=MAX_ROWS):
    return _records_of_tools(_rows(spark, sf_dir, max_rows))


def _records_of_tools(rows: DataFrame) -> DataFrame:
    return gold.folded_records(rows, "event_id").filter("own.role <> 'M'").select(
        "session", "own.event_id", "own.call", "own.turn", "own.step", "own.index", "results",
        F.col("tool_status").alias("status"), F.col("own.start_ms").alias("started_ms"),
        F.col("finished_ms").alias("completed_ms"), F.col("took_ms").alias("duration_ms"), "error",
    )


def orphan_tool_results(spark, sf_dir, max_rows=MAX_ROWS):
    return orphan_results(add_owner(event_ledger(spark, sf_dir, max_rows))).select(
        "session", "event_id", "call", F.lit("unmatched_tool_result").alias("code")
    )


def tool_call_totals(spark, sf_dir, max_rows=MAX_ROWS):
    return tool_totals(event_ledger(spark, sf_dir, max_rows))


def tool_latency(spark, sf_dir, max_rows=MAX_ROWS):
    """Slowest tools first, by their median: finished calls per tool; unmeasured calls are left out."""
    done = fold_results(add_owner(event_ledger(spark, sf_dir, max_rows)))
    return tool_latencies(done).select(
        F.concat(F.lit("tool "), "call").alias("event"), "calls", "failed", "total_ms", "max_ms", "median_ms"
    ).orderBy(F.desc("median_ms"), F.desc("max_ms"), "event")


def turn_tool_time(spark, sf_dir, max_rows=MAX_ROWS):
    """Time in tools against the time of their turn."""
    rows = _rows(spark, sf_dir, max_rows)
    tools = gold.tool_records(rows).groupBy("session", "turn").agg(
        F.count(F.lit(1)).alias("tools"), F.sum("duration_ms").alias("tool_ms")
    )
    return gold.turns(rows).select("session", "turn", "duration_ms").join(
        tools, ["session", "turn"]
    ).select("session", "turn", "duration_ms", "tools", "tool_ms")


# --- usage and quota ------------------------------------------------------------------------


def usage_deltas(spark, sf_dir, max_rows=MAX_ROWS):
    return _sampled(spark, sf_dir, max_rows).filter(role_in("K")).select(
        "session", "event_id", "turn", "now_total", "now_output", "sampled", "accepted", "interval"
    )


def usage_attach(spark, sf_dir, max_rows=MAX_ROWS):
    rows = _sampled(spark, sf_dir, max_rows)
    places = rows.filter("creates").select(
        "session", F.col("seq").alias("owner"), "event_id", "index", "turn"
    )
    return usage.attach_samples(rows).join(places, ["session", "owner"]).select(
        "session", "event_id", "index", "turn", "used_input", "used_output", "used_total"
    )


def turn_usage(spark, sf_dir, max_rows=MAX_ROWS):
    turns = gold.turns(_sampled(spark, sf_dir, max_rows)).filter("model_calls > 0")
    return usage.breakdown(turns).select(
        "session", "turn", "model_calls", *[f"used_{c}" for c in COUNTERS],
        "uncached_input", "visible_output", "cache_hit_percent",
    )


def session_tokens(spark, sf_dir, max_rows=MAX_ROWS):
    """Last carried value per counter: an aggregate, no window needed."""
    rows = with_samples(event_ledger(spark, sf_dir, max_rows))
    return rows.filter(role_in("K")).groupBy("session").agg(*[
        F.max_by(f"cum_{c}", F.when(F.col(f"cum_{c}").isNotNull(), F.col("seq"))).alias(c)
        for c in ("output", "total")
    ])


def _quota_samples(rows: DataFrame) -> DataFrame:
    """Purchase rows as quota samples: odd k is the secondary window, k%7=0 has no valid length."""
    k = F.col("k")
    return rows.filter(role_in("K")).select(
        "session", "seq", *(["chunk"] if "chunk" in rows.columns else []), "event_id", "k",
        F.when(k % 2 == 0, "primary").otherwise("secondary").alias("window"),
        (F.col("amount") * 2).alias("used_percent"),
        F.when(k % 7 == 0, 0).when(k % 2 == 0, 300).otherwise(10080).cast("long")
        .alias("window_minutes"),
        (F.col("ts_ms") + 60_000 * (k % 3)).alias("resets_ms"),
    )


def quota_latest(spark, sf_dir, max_rows=MAX_ROWS):
    return quota.latest_quota(_quota_samples(event_ledger(spark, sf_dir, max_rows)))


def quota_alerts(spark, sf_dir, max_rows=MAX_ROWS):
    """Alert rows at 40 percent; the window identity is k%3, rows with k%4=0 run no turn."""
    valid = quota.valid_window(F.col("used_percent"), F.col("window_minutes"))
    samples = _quota_samples(event_ledger(spark, sf_dir, max_rows)).filter(valid).withColumns({
        "remaining": F.greatest(F.lit(0), 100 - F.col("used_percent")),
        "window_key": (F.col("k") % 3).cast("string"),
        "running": F.col("k") % 4 != 0,
    })
    return quota.quota_alerts(samples, 40).select("session", "event_id", "remaining", "window_key")


# --- sessions, pages ------------------------------------------------------------------------


def session_stats(spark, sf_dir, max_rows=MAX_ROWS):
    return gold.session_stats(_rows(spark, sf_dir, max_rows))


def _page_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("creates").select("session", "index", "event_id", "turn", "step")


def newest_page(spark, sf_dir, max_rows=MAX_ROWS):
    return pages.newest_page(_page_rows(_rows(spark, sf_dir, max_rows)), 50)


def page_before(spark, sf_dir, max_rows=MAX_ROWS):
    return pages.newest_page(_page_rows(_rows(spark, sf_dir, max_rows)), 50, before=40)


def page_header(spark, sf_dir, max_rows=MAX_ROWS):
    rows = _rows(spark, sf_dir, max_rows)
    return pages.page_headers(
        pages.newest_page(_page_rows(rows), 50, before=40), gold.session_stats(rows)
    )


def retained_turns(spark, sf_dir, max_rows=MAX_ROWS):
    """At most eight turns per session beside a page that ends at record 30."""
    rows = _rows(spark, sf_dir, max_rows)
    page = pages.newest_page(_page_rows(rows), 50, before=30)
    return pages.retained_turns(gold.turns(rows), page, 8).select(
        "session", "turn", "owns_page", "status"
    )


def page_turns(spark, sf_dir, max_rows=MAX_ROWS):
    rows = _rows(spark, sf_dir, max_rows)
    return pages.owning_turns(
        gold.turns(rows), pages.newest_page(_page_rows(rows), 50)
    ).select("session", "turn", "records", "steps")


def page_merge(spark, sf_dir, max_rows=MAX_ROWS):
    records = _page_rows(_rows(spark, sf_dir, max_rows))
    return pages.merge_pages(
        pages.newest_page(records, 50), pages.newest_page(records, 60, before=40)
    )


def warnings(spark, sf_dir, max_rows=MAX_ROWS):
    """First 20 warnings per session: unmatched outputs and turns cut short, in log order."""
    rows = _rows(spark, sf_dir, max_rows)
    code = F.when(role_in("R") & F.col("creates"), "unmatched_tool_result").when(
        F.col("split"), F.when(role_in("S"), "overlapping_turn_start")
        .otherwise("mismatched_turn_completion")
    )
    found = rows.withColumn("code", code).filter("code is not null")
    return pages.first_warnings(found, 20).select("session", "event_id", "code")


def unique_record_ids(spark, sf_dir, max_rows=MAX_ROWS):
    """Record ids made unique per session: repeats get a digest suffix."""
    rows = _rows(spark, sf_dir, max_rows).filter("creates")
    base = tx.identifier(F.concat_ws("-", F.when(role_in("M"), "assistant").otherwise("tool"), "call"))
    rows = scan(rows.withColumn("base", base), total("nth", F.lit(1)),
                by=("session", "base"), contiguous=False)
    return rows.select(
        "session", "event_id",
        F.when(F.col("nth") == 1, F.col("base")).otherwise(
            tx.salted_id(F.col("base"), F.col("index"))
        ).alias("record_id"),
    )


def revision(spark, sf_dir):
    """Digest per session over its (file, time, size) parts; a user-day stands for a file."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts")
    parts = events.groupBy(
        F.col("user_id").alias("session"), F.date_format("ts", "yyyy-MM-dd").alias("path")
    ).agg(F.max(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("modified"),
          F.count(F.lit(1)).alias("size"))
    return overview.revisions(parts)


def contract_report(spark, sf_dir, max_rows=MAX_ROWS):
    rows = _sampled(spark, sf_dir, max_rows)
    return contract.report(_records(rows), gold.turns(rows), gold.session_stats(rows))


# --- conversations --------------------------------------------------------------------------


def _overviews(spark, sf_dir, max_rows=MAX_ROWS):
    """Overview per conversation; conversations 10n and 10n+1 share a session id, the later wins."""
    rows = sequence(conversation_ledger(spark, sf_dir, max_rows))
    files = rows.groupBy("session").agg(F.count(F.lit(1)).alias("lines")).select(
        F.col("session").alias("file"),
        F.concat(F.lit("conv-"), (F.col("session") - F.when(F.col("session") % 10 == 1, 1).otherwise(0))
                 .cast("string")).alias("id"),
        F.concat(F.lit("log-"), F.lpad(F.col("session").cast("string"), 12, "0")).alias("stem"),
        F.lit(None).cast("string").alias("rollout_id"),
        (F.col("session") * 1000).alias("modified_ms"),
        (F.col("session") % 7 == 0).alias("archived"),
        F.concat(F.lit("/work/p"), (F.col("session") % 5).cast("string")).alias("cwd"),
        F.concat(F.lit("m"), (F.col("session") % 3).cast("string")).alias("model"),
    )
    body = rows.groupBy(F.col("session").alias("file")).agg(
        F.min_by("text", F.when(role_in("U") & (F.col("text") != ""), F.col("seq"))).alias("__first"),
        F.max("turn").alias("turns"),
        F.count_if("creates").alias("records"),
    )
    return files.join(body, "file").withColumn(
        "title", overview.title(F.col("__first"), 100)
    ).drop("__first")


def overview_list(spark, sf_dir, max_rows=MAX_ROWS):
    return overview.session_list(_overviews(spark, sf_dir, max_rows), limit=20).select(
        "id", "stem", "title", "turns", "records", "modified_ms", "archived"
    )


def session_search(spark, sf_dir, max_rows=MAX_ROWS):
    return overview.session_list(
        _overviews(spark, sf_dir, max_rows), limit=100, query="P3 M1", include_archived=True
    ).select("id", "stem", "title", "cwd", "model")


SELECTORS = ("latest", "conv-20", "conv-2", "log-000000000005", "log-00000000000", "none")


def selector_resolve(spark, sf_dir, max_rows=MAX_ROWS):
    return overview.resolve(_overviews(spark, sf_dir, max_rows), *SELECTORS)


def record_search(spark, sf_dir, max_rows=MAX_ROWS):
    rows = sequence(conversation_ledger(spark, sf_dir, max_rows)).filter("creates")
    records = rows.select(
        "session", "index", "turn", F.when(role_in("U"), "user").otherwise("assistant").alias("kind"),
        F.when(role_in("U"), "User").otherwise("Assistant").alias("event"),
        tx.shorten(F.col("text")).alias("summary"), F.lit(None).cast("string").alias("error"),
    )
    return pages.search_records(records, "The", "event", "summary", "error").drop("event", "error")


def kind_filter(spark, sf_dir, max_rows=MAX_ROWS):
    return pages.of_kind(_records(_rows(spark, sf_dir, max_rows)), "tool").select(
        "session", "index", "event", "status"
    )


def range_filter(spark, sf_dir, max_rows=MAX_ROWS):
    """Records that overlap 10 to 20 January 2024."""
    return pages.in_range(
        _records(_rows(spark, sf_dir, max_rows)), 1704844800000, 1705708800000
    ).select("session", "index", "started_ms", "completed_ms")


# --- text -----------------------------------------------------------------------------------


def summary_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", tx.shorten(F.col("text")).alias("summary"))


def bounded_detail(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", tx.bounded(F.col("text")).alias("detail"))


def bounded_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", tx.identifier(F.col("text"), F.lit("none")).alias("id"))


def path_redaction(spark, sf_dir):
    """Shown form of the url path of each page, with /wiki as the home folder."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    return rows.select("page_id", tx.shown_path(path, "/wiki").alias("path"))


# --- logs: the same events as JSON lines, through the whole log pipeline ---------------------


def _logs(spark, sf_dir, max_rows=MAX_ROWS) -> build.Logs:
    raw = derived.event_lines(spark, sf_dir)
    return build.from_lines(derived.files_of(raw), raw, max_rows=max_rows)


def log_records(spark, sf_dir, max_rows=MAX_ROWS):
    return build.records(_logs(spark, sf_dir, max_rows)).select(
        "session", "index", "turn", "step", "kind", "event", "summary", "status", "call",
        "started_ms", "completed_ms", "duration_ms", "error",
    )


def log_turns(spark, sf_dir, max_rows=MAX_ROWS):
    return build.turns(_logs(spark, sf_dir, max_rows)).select(
        "session", "turn", "id", "started_ms", "completed_ms", "duration_ms", "status", "error",
        "records", "steps",
    )


def log_compactions(spark, sf_dir):
    """Compactions, records and turns of logs with checkpoints, of which some are followed by their end."""
    raw = derived.compaction_lines(spark, sf_dir)
    return build.sessions(build.from_lines(derived.files_of(raw), raw)).select("id", "turns", "records", "compactions")


def log_tool_names(spark, sf_dir):
    """Tool records whose ends rename them, a generic name never over a specific one."""
    raw = derived.renaming_lines(spark, sf_dir)
    return build.records(build.from_lines(derived.files_of(raw), raw)).select("session", "index", "event", "call", "status")


def _late_logs(spark, sf_dir) -> build.Logs:
    raw = derived.event_lines(spark, sf_dir)
    return build.from_lines(derived.files_of(raw), raw, far=8)


def log_late_records(spark, sf_dir):
    """Records of the logs where a result eight records behind its call adds a marker."""
    return build.records(_late_logs(spark, sf_dir)).select(
        "session", "index", "turn", "step", "kind", "event", "call", "status", "started_ms", "completed_ms", "duration_ms", "error")


def log_late_turns(spark, sf_dir):
    """Turns of the same logs: markers are records of them and can open one."""
    return build.turns(_late_logs(spark, sf_dir)).select(
        "session", "turn", "started_ms", "completed_ms", "status", "records", "steps")


def log_sessions(spark, sf_dir, max_rows=MAX_ROWS):
    return build.sessions(_logs(spark, sf_dir, max_rows)).select(
        "id", "title", "turns", "records", "tool_calls", "failed_tools", "compactions",
        "started_ms", "updated_ms", "archived",
    )


def log_warnings(spark, sf_dir, max_rows=MAX_ROWS):
    return build.warnings(_logs(spark, sf_dir, max_rows)).select("session", "line", "code")


def log_quota(spark, sf_dir, max_rows=MAX_ROWS):
    return build.quotas(_logs(spark, sf_dir, max_rows)).select(
        "session", "window", "used_percent", "remaining_percent"
    )


def log_record_ids(spark, sf_dir, max_rows=MAX_ROWS):
    """Ids of the log's records: unique per session."""
    return build.records(_logs(spark, sf_dir, max_rows)).groupBy("session").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("id").alias("ids")
    )


def _desk(spark, sf_dir) -> build.Logs:
    raw = derived.desk_lines(spark, sf_dir)
    return build.from_lines(derived.files_of(raw), raw, "full")


def log_metadata(spark, sf_dir):
    """Allowed metadata, context window and model of every session."""
    return build.sessions(_desk(spark, sf_dir)).select(
        "id", "cwd", "originator", "source_kind", "git_branch", "git_commit", "context_window", "records", "tool_calls",
        "failed_tools",
    )


def log_tool_details(spark, sf_dir):
    """Tool records at full detail: measured time, input and output laid out as JSON, protocol."""
    return build.records(_desk(spark, sf_dir), "full").where("kind = 'tool'").select(
        "session", "index", "event", "status", "duration_ms", "input", "output", "metadata", "error",
    )


def log_attachments(spark, sf_dir):
    """Attachments that each user message brought."""
    count = lambda name: F.get_json_object("metadata", f"$.{name}").cast("long")
    return build.records(_desk(spark, sf_dir), "full").where("kind = 'user'").select(
        "session", "index", count("images").alias("images"), count("audio").alias("audio"),
    )


def log_phases(spark, sf_dir):
    """Label and phase of each model message."""
    return build.records(_desk(spark, sf_dir), "full").where("kind = 'assistant'").select(
        "session", "index", "event", F.get_json_object("metadata", "$.phase").alias("phase"), F.length("output").alias("chars"),
    )


def quarantine(spark, sf_dir, max_rows=MAX_ROWS):
    """Line number and code of every refused line."""
    raw = derived.faulty_lines(spark, sf_dir)
    admitted = lines.admit(spread(raw)).drop("entry")
    return lines.quarantine(lines.frame(admitted, max_rows, measured(raw, ["file"]))).select("file", "line_no", "code")


def document_admission(spark, sf_dir):
    """How many lines of each document are blank, good or refused."""
    admitted = lines.admit(spread(derived.document_lines(spark, sf_dir))).withColumn(
        "good", F.col("entry").isNotNull())
    return admitted.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("good").alias("good"),
        *[F.count_if(F.col("reject") == code).alias(code) for code in lines.REJECTS],
    )


def lineage_history(spark, sf_dir, max_rows=MAX_ROWS):
    """Logical history of every conversation, inherited entries first."""
    raw = derived.inherited_lines(spark, sf_dir, max_rows)
    logs = build.from_lines(derived.files_of(raw), raw, max_rows=max_rows)
    return logs.rows.select(
        F.substring("session", 5, 8).cast("long").alias("conv_id"), "event_number", "ordinal", "role",
        F.col("summary_text").alias("summary"),
    )


def log_documents(spark, sf_dir, max_rows=MAX_ROWS):
    """Counts read back from every session's JSON document with a page of 50 records."""
    return _counts_of(document.documents(_logs(spark, sf_dir, max_rows), 50))


def log_contract(spark, sf_dir):
    """Rules that rows of the gold tables and members of every document keep, with the rows that break them."""
    logs = _logs(spark, sf_dir)
    return contract.gold_report(
        records=build.records(logs), turns=build.turns(logs), sessions=build.sessions(logs), quotas=build.quotas(logs),
        warnings=build.warnings(logs), documents=document.documents(logs, 50))


def contract_breaches(spark, sf_dir):
    """Breaches that were planted in documents: which part of one is damaged hangs on its session's number."""
    docs = document.documents(_logs(spark, sf_dir), 50)
    kind = F.substring("session", 6, 20).cast("long") % 9
    damaged = F.col("document")
    for number, pattern, value in (
        (1, r'^\{', '{"extra":null,'), (2, r'"schemaVersion":1', '"schemaVersion":"1"'), (3, r',"nextBeforeRecord":[^}]*', ""),
        (4, r'"kind":"assistant"', '"kind":"guest"'), (5, r'"timeToFirstTokenMs":null', '"timeToFirstTokenMs":-1'),
        (6, r'"archived":false', '"archived":null'), (7, r"\}$", ""), (8, r'"event":"Assistant"', '"event":""'),
    ):
        damaged = F.when(kind == number, F.regexp_replace("document", pattern, value)).otherwise(damaged)
    return contract.document_report(docs.select(damaged.alias("document"))).where("broken > 0")


def trajectory_page(spark, sf_dir):
    """The newest session by the one-session call over saved tables."""
    folder = f"{checkpoint_dir(spark)}/gold-{uuid.uuid4().hex}"
    store.save(_logs(spark, sf_dir), folder, buckets=8)
    return _counts_of(store.trajectory(spark, folder, "latest", 50, buckets=8))


def _counts_of(docs):
    at = lambda path: F.get_json_object("document", path)
    return docs.select(
        "session", at("$.stats.records").cast("long").alias("records"),
        at("$.stats.visibleRecords").cast("long").alias("shown"),
        at("$.records[0].index").cast("long").alias("first_index"),
        at("$.pagination.nextBeforeRecord").cast("long").alias("next_before"),
        at("$.turns[0].index").cast("long").alias("first_turn"),
        at("$.session.startedAt").alias("started_at"),
    )


def live_cursor(spark, sf_dir, max_rows=MAX_ROWS):
    return document.live_cursor(_page_rows(_rows(spark, sf_dir, max_rows)))


def late_markers(spark, sf_dir, max_rows=MAX_ROWS):
    """Results at least eight records after their call, with the marker each one adds."""
    rows = add_index(add_owner(event_ledger(spark, sf_dir, max_rows)))
    return add_late_markers(rows, far=8).filter("late").select(
        "session", "event_id", "call", "marker_index"
    )
