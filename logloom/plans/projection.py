"""Log entries to typed ledger rows: one shape per entry, one CASE per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.functions import time as tm
from logloom.functions import variant as vx
from logloom.operators.defaults import COUNTERS

# Event kinds of the log format and the shape each one takes here.
EVENTS = {
    "task_started": "start", "turn_started": "start",
    "task_complete": "end", "turn_complete": "end", "turn_aborted": "abort",
    "user_message": "user", "token_count": "tokens", "thread_rolled_back": "rollback",
    "mcp_tool_call_end": "mcp_end", "patch_apply_end": "patch_end",
    "web_search_end": "search_end", "image_generation_end": "image_end",
    "sub_agent_activity": "subagent", "entered_review_mode": "review",
    "exited_review_mode": "review", "context_compacted": "compacted",
}
RESPONSES = {
    "reasoning": "reasoning", "message": "message", "function_call": "call",
    "custom_tool_call": "call", "local_shell_call": "shell", "tool_search_call": "finder",
    "tool_search_output": "finder_output", "web_search_call": "search",
    "image_generation_call": "image", "compaction": "compaction",
    "compaction_summary": "compaction", "context_compaction": "compaction",
    "function_call_output": "output", "custom_tool_call_output": "output",
    "agent_message": "agent_message",
}
ITEMS = (
    "user_message", "hook_prompt", "agent_message", "plan", "reasoning", "sub_agent_activity",
    "context_compaction", "entered_review_mode", "exited_review_mode", "command_execution",
    "dynamic_tool_call", "collab_agent_tool_call", "web_search", "image_view",
    "image_generation", "file_change", "mcp_tool_call", "extension",
)
TOOL_ITEMS = tuple("item:" + i for i in ITEMS[9:])
# Shapes that only logs of the older, unpaginated form use.
LEGACY_ONLY = (
    "user", "mcp_end", "patch_end", "search_end", "image_end", "subagent", "review", "compacted",
    "reasoning", "message", "call", "shell", "finder", "finder_output", "search", "image",
    "compaction", "output", "other_response",
)
# Status words.
OPEN_ENDED = ("completed", "incomplete", "failed")
SUCCEEDED = ("completed", "complete", "succeeded")
ITEM_FAILED = ("failed", "declined", "incomplete", "error")
OUTPUT_FAILED = ("failed", "incomplete", "error")
PATCH_FAILED = ("failed", "declined", "error")
GENERIC_TOOLS = ("tool", "mcp tool")

# Fixed value: shown for reasoning without a readable summary.
ENCRYPTED = "Encrypted reasoning (summary unavailable)"


def _quoted(names) -> str:
    return ", ".join(f"'{name}'" for name in names)


def _lookup(names: dict[str, str], key: str) -> Column:
    return F.expr(f"map({_quoted(x for pair in names.items() for x in pair)})[{key}]")


def _shaped(*shapes: str) -> Column:
    return F.expr(f"shape IN ({_quoted(shapes)})")


def _case(*branches: tuple[str | tuple[str, ...], Column], otherwise: Column | None = None) -> Column:
    """One value per shape."""
    chain = None
    for shapes, value in branches:
        names = (shapes,) if isinstance(shapes, str) else shapes
        chain = (F if chain is None else chain).when(_shaped(*names), value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def add_shape(entries: DataFrame) -> DataFrame:
    """Payload ``p``, its item, and the shape of every admitted entry."""
    p, head = F.col("p"), F.col("__head")
    rows = entries.withColumn(
        "__head", vx.parts_of(F.col("entry"), "", "type", "payload", "timestamp", "ordinal")
    ).withColumns({
        "kind_in": vx.as_text(head["type"]), "p": head["payload"],
        "__time_n": vx.as_number(head["timestamp"]), "__time_t": vx.as_text(head["timestamp"]),
        "ordinal": vx.as_whole(head["ordinal"]),
        "has_ordinal": F.coalesce(head["ordinal"].isNotNull(), F.lit(False)),
    }).drop("entry", "__head")
    rows = rows.withColumns({
        "ts_ms": _stamp("__time"), "type_in": vx.text(p, "type"),
    }).drop("__time_n", "__time_t")
    is_item = (F.col("kind_in") == "event_msg") & (F.col("type_in") == "item_completed")
    rows = rows.withColumns({
        "item": F.when(is_item, vx.field(p, "item")),
        "speaker": F.when(F.col("type_in") == "message", vx.text(p, "role")),
    })
    rows = rows.withColumns({
        "item_type": F.when(is_item, tx.snake_case(vx.text(F.col("item"), "type"))),
        "has_item": is_item & vx.is_object(F.col("item")),
    })
    item_shape = (
        F.when(~F.col("has_item"), "bad_item")
        .when(F.col("item_type").isin(*ITEMS), F.concat(F.lit("item:"), "item_type"))
        .otherwise("item:?")
    )
    other_speaker = (F.col("type_in") == "message") & ~F.col("speaker").eqNullSafe("assistant")
    response = F.when(other_speaker, None).when(
        F.col("type_in").isNotNull(),
        F.coalesce(_lookup(RESPONSES, "type_in"), F.lit("other_response")),
    )
    shape = (
        F.when(F.col("kind_in") == "session_meta", "meta")
        .when(F.col("kind_in") == "turn_context", "context")
        .when(is_item, item_shape)
        .when(F.col("kind_in") == "event_msg", _lookup(EVENTS, "type_in"))
        .when(F.col("kind_in") == "response_item", response)
        .when(F.col("kind_in") == "compacted", "checkpoint")
        .when(F.col("kind_in") == "inter_agent_communication", "agent_comm")
    )
    return rows.withColumn("shape", F.coalesce(shape, F.lit(""))).withColumn(
        "src", F.when(F.col("shape").startswith("item:"), F.col("item")).otherwise(p)
    ).drop("kind_in", "speaker", "has_item")


def _stamp(name: str) -> Column:
    """A time given as a Unix number (``name_n``) or as ISO text (``name_t``)."""
    return F.coalesce(tm.ms_of_number(F.col(name + "_n")), tm.ms_of_text(F.col(name + "_t")))


_ENDS = ("mcp_end", "patch_end", "search_end", "image_end")
_CALLS = ("call", "shell", "finder", "search", "image")
_ITEM_SHAPES = ("item:?", *["item:" + i for i in ITEMS])
_REVIEW_ITEMS = ("item:entered_review_mode", "item:exited_review_mode")
_COMPACTIONS = ("compaction", "checkpoint", "compacted", "item:context_compaction")
_BOUNDS = ("start", "end", "abort")
_AGENTS = ("subagent", "item:sub_agent_activity")
_SEARCHES = ("search", "search_end", "item:web_search", "item:extension")
_TALK = ("agent_message", "agent_comm")

# Scalar fields of an entry: path, longest shown text, and the shapes that use the field.
# These short texts have white space collapsed.
_SHORT = {
    "s_status": ("status", 80, ("shell", "finder", "finder_output", "search", "image", "patch_end",
                                "image_end", *TOOL_ITEMS)),
    "s_kind": ("kind", 100, (*_AGENTS, "item:extension")),
    "s_phase": ("phase", 80, ("message", "item:agent_message")),
    "s_agent_path": ("agent_path", 200, _AGENTS), "s_thread": ("agent_thread_id", 100, _AGENTS),
    "s_action": ("action.type", 80, _SEARCHES),
    "s_namespace": ("namespace", 100, ("call", "item:dynamic_tool_call")),
    "s_name": ("name", 160, ("call",)),
    "s_tool": ("tool", 160, ("item:dynamic_tool_call", "item:collab_agent_tool_call",
                             "item:mcp_tool_call")),
    "s_server": ("server", 100, ("item:mcp_tool_call",)),
    "s_execution": ("execution", 160, ("finder",)),
    "s_author": ("author", 200, _TALK), "s_recipient": ("recipient", 200, _TALK),
    "s_model": ("model", 200, ("context", "start")), "s_effort": ("effort", 80, ("context",)),
    "s_mode": ("collaboration_mode.mode", 80, ("context",)),
    "s_mode_kind": ("collaboration_mode_kind", 80, ("context", "start")),
    "s_call_server": ("invocation.server", 100, ("mcp_end",)),
    "s_call_tool": ("invocation.tool", 160, ("mcp_end",)),
}
# Texts taken as they are.
_TEXTS = {
    "t_call_id": ("call_id", (*_CALLS, "finder_output", "output", *_ENDS)),
    "t_id": ("id", (*_CALLS, "reasoning", "message", "compaction", *_TALK, *_ITEM_SHAPES)),
    "t_event_id": ("event_id", ("subagent",)), "t_item_id": ("item_id", ("review",)),
    "t_message": ("message", ("user", "checkpoint")), "t_text": ("text", ("item:plan",)),
    "t_content": ("content", ("agent_comm",)),
}
_PAYLOAD_TEXTS = {
    "t_turn": ("turn_id", (*_BOUNDS, *_ITEM_SHAPES)),
    "t_passed_turn": ("internal_chat_message_metadata_passthrough.turn_id", ("agent_message",)),
    "t_reason": ("reason", ("abort",)), "t_reason_message": ("reason.message", ("abort",)),
    "t_error": ("error", ("end",)), "t_error_message": ("error.message", ("end",)),
    "t_begun_t": ("started_at", _BOUNDS), "t_ended_t": ("completed_at", _BOUNDS),
}
_NUMBERS = {
    "t_begun_n": ("started_at", _BOUNDS), "t_ended_n": ("completed_at", _BOUNDS),
    "n_done": ("completed_at_ms", _ITEM_SHAPES), "n_begun": ("started_at_ms", _ITEM_SHAPES),
    "n_duration_ms": ("duration_ms", _BOUNDS), "n_ttft": ("time_to_first_token_ms", _BOUNDS),
    "n_occurred": ("occurred_at_ms", ("subagent",)),
}


def _read_scalars(rows: DataFrame) -> DataFrame:
    """Every scalar field as a column of its own, read once and only where a shape uses it."""
    p, src = F.col("p"), F.col("src")
    timed = (*_ENDS, *TOOL_ITEMS)
    judged = ("end", "mcp_end", "patch_end", "image_end", *TOOL_ITEMS)
    rows = rows.withColumns({
        **{name: _case((shapes, tx.collapse(vx.text(src, path))))
           for name, (path, _, shapes) in _SHORT.items()},
        **{name: _case((shapes, vx.text(src, path))) for name, (path, shapes) in _TEXTS.items()},
        **{name: _case((shapes, vx.text(p, path))) for name, (path, shapes) in _PAYLOAD_TEXTS.items()},
        **{name: _case((shapes, vx.number(p, path))) for name, (path, shapes) in _NUMBERS.items()},
        "n_seconds": _case((timed, vx.number(src, "duration"))),
        "n_sleep": _case(("item:extension", vx.number(src, "durationMs"))),
        "i_secs": _case((timed, vx.whole(src, "duration.secs"))),
        "i_nanos": _case((timed, vx.whole(src, "duration.nanos"))),
        "has_nanos": _case((timed, vx.field(src, "duration.nanos").isNotNull())),
        "b_success": _case((judged, vx.flag(src, "success"))),
        "has_error": _case((judged, vx.given(src, "error"))),
        "has_failure": _case((judged, vx.given(src, "failure"))),
        "i_rolled": _case(("rollback", vx.whole(p, "num_turns"))),
        "__probe": _case(("output", vx.field(p, "output")),
                         (("mcp_end", "item:mcp_tool_call"), vx.field(src, "result"))),
    })
    rows = rows.withColumns({
        **{name: F.when(F.col(name) != "", tx.clip(F.col(name), limit))
           for name, (_, limit, _s) in _SHORT.items()},
        "__probe_text": vx.as_text(F.col("__probe")),
        "t_begun": _stamp("t_begun"), "t_ended": _stamp("t_ended"),
    }).withColumn("__closed", vx.closed(F.col("__probe_text")))
    rows = rows.withColumn("__parsed", F.when(
        F.col("__probe_text").isNotNull(), vx.opened(F.col("__probe_text"), F.col("__closed"))
    ).otherwise(F.col("__probe")))
    return rows.withColumns({
        "status": F.lower("s_status"),
        "says_error": F.when(F.col("__parsed").isNotNull(), vx.reports_error(F.col("__parsed"))),
        "duration_read": F.coalesce(
            F.when(~F.col("has_nanos") | F.col("i_nanos").isNotNull(),
                   tm.ms_of_parts(F.col("i_secs"), F.col("i_nanos"))),
            tm.ms_of_seconds(F.col("n_seconds"))),
    }).drop("__probe", "__probe_text", "__closed", "__parsed")


def _search_label() -> Column:
    return F.concat_ws(" · ", F.lit("Web search"), "s_action")


def _assistant() -> Column:
    return F.concat_ws(" · ", F.lit("Assistant"), "s_phase")


def _named(group: str, name: str, default: str) -> Column:
    return F.concat_ws(".", F.col(group), F.coalesce(F.col(name), F.lit(default)))


def _subset(value: Column, *keys: str) -> Column:
    """JSON object of the given keys that are there and not null."""
    pairs = [F.struct(F.lit(k).alias("key"), vx.field(value, k).alias("value")) for k in keys]
    kept = F.filter(F.array(*pairs), lambda x: x["value"].isNotNull() & ~F.is_variant_null(x["value"]))
    return F.to_json(F.map_from_entries(kept))


def _filled(column: str) -> Column:
    return F.when(F.col(column) != "", F.col(column))


def _add_roles(rows: DataFrame) -> DataFrame:
    """Role, kind, label, call id and turn id."""
    finished = F.coalesce(F.col("status").isin(*OPEN_ENDED), F.lit(False))
    rows = rows.withColumn("role", _case(
        ("start", F.lit("S")), (("end", "abort"), F.lit("C")), ("tokens", F.lit("K")),
        (("user", "subagent", "review", "compaction", "agent_comm"), F.lit("U")),
        (("reasoning", "message"), F.lit("M")), ("call", F.lit("T")),
        (("shell", "finder"), F.when(finished, "TT").otherwise("T")),
        (("finder_output", "output"), F.lit("R")), (("search", "image", *_ENDS), F.lit("TT")),
        ("checkpoint", F.lit("P")), ("compacted", F.lit("CC")), ("agent_message", F.lit("A")),
        (("item:agent_message", "item:plan", "item:reasoning"), F.lit("IM")),
        ("item:context_compaction", F.lit("IC")), ("item:?", F.lit("IX")),
        (TOOL_ITEMS, F.lit("IT")), (_ITEM_SHAPES, F.lit("IU")),
        otherwise=F.lit("X"),
    ))
    extension = F.coalesce("s_kind", F.lit("extension"))
    subagent = F.concat(F.lit("Subagent · "), F.coalesce(F.substring("s_kind", 1, 80), F.lit("activity")))
    return rows.withColumns({
        "extension": F.when(F.col("shape") == "item:extension", extension),
        "legacy_only": _shaped(*LEGACY_ONLY),
        "kind": _case(
            (("user", "item:user_message", "item:hook_prompt"), F.lit("user")),
            (("reasoning", "item:reasoning"), F.lit("reasoning")),
            (("message", "review", "item:agent_message", "item:plan", *_REVIEW_ITEMS),
             F.lit("assistant")),
            (("subagent", "agent_message", "agent_comm", "item:sub_agent_activity"), F.lit("subagent")),
            (_COMPACTIONS, F.lit("compaction")),
            ((*_CALLS, "finder_output", "output", *_ENDS, *TOOL_ITEMS), F.lit("tool")),
        ),
        "call": tx.identifier(_case(
            (_CALLS, F.coalesce(_filled("t_call_id"), _filled("t_id"))),
            (("finder_output", "output", *_ENDS), F.col("t_call_id")), (TOOL_ITEMS, F.col("t_id")),
        )),
        "eid": tx.identifier(_case(
            (("start", "end", "abort", *_ITEM_SHAPES), F.col("t_turn")),
            ("agent_message", F.col("t_passed_turn")),
        )),
        "label": _case(
            (("user", "item:user_message"), F.lit("User")), ("item:hook_prompt", F.lit("Hook prompt")),
            (("reasoning", "item:reasoning"), F.lit("Reasoning")),
            (("message", "item:agent_message"), _assistant()), ("item:plan", F.lit("Plan")),
            ("call", _named("s_namespace", "s_name", "tool")),
            ("shell", F.lit("Local shell")),
            ("finder", F.coalesce("s_execution", F.lit("Tool search"))),
            ("finder_output", F.lit("Tool search result")), ("output", F.lit("Tool result")),
            (("search", "search_end", "item:web_search"), _search_label()),
            (("image", "image_end", "item:image_generation"), F.lit("Image generation")),
            (_COMPACTIONS, F.lit("Compaction")),
            ("mcp_end", _named("s_call_server", "s_call_tool", "MCP tool")),
            (("patch_end", "item:file_change"), F.lit("Apply patch")),
            (("subagent", "item:sub_agent_activity"), subagent),
            (("review", *_REVIEW_ITEMS), F.lit("Review mode")),
            ("agent_message", F.lit("Agent message")), ("agent_comm", F.lit("Agent communication")),
            ("item:command_execution", F.lit("Command")),
            ("item:dynamic_tool_call", _named("s_namespace", "s_tool", "dynamic tool")),
            ("item:collab_agent_tool_call", F.coalesce("s_tool", F.lit("Agent tool"))),
            ("item:image_view", F.lit("View image")),
            ("item:mcp_tool_call", _named("s_server", "s_tool", "MCP tool")),
            ("item:extension", F.when(extension == "clock.sleep", "Sleep")
             .when(extension == "web.search", _search_label())
             .when(extension == "image_gen.generation", "Image generation").otherwise("Extension")),
        ),
    })


def _add_texts(rows: DataFrame) -> DataFrame:
    """Body and summary text, record id parts, warnings."""
    src = F.col("src")
    body = _case(
        (("user", "checkpoint"), F.col("t_message")), ("item:plan", F.col("t_text")),
        (("message", "agent_message", "item:agent_message", "item:user_message"),
         vx.content_text(src, "content")),
        ("reasoning", vx.summary_parts(src, "summary")),
        ("item:reasoning", vx.summary_parts(src, "summary_text")),
        ("agent_comm", F.col("t_content")),
    )
    rows = rows.withColumn("body", body).withColumn("body", _filled("body"))
    agent = F.concat_ws(" · ", F.coalesce("s_agent_path", F.lit("subagent")),
                        F.coalesce(F.substring("s_kind", 1, 80), F.lit("activity")))
    entered = F.when(F.coalesce("item_type", "type_in").startswith("entered"), "Entered review mode")
    text = _case(
        (("user", "item:user_message"), F.coalesce("body", F.lit("User message"))),
        ("item:hook_prompt", F.lit("Internal hook prompt")),
        ("reasoning", F.coalesce("body", F.lit(ENCRYPTED))),
        (("message", "item:agent_message", "item:plan", "item:reasoning"), F.coalesce("body", "label")),
        (("subagent", "item:sub_agent_activity"), agent), (_COMPACTIONS, F.lit("Context compacted")),
        (("review", *_REVIEW_ITEMS), F.coalesce(entered, F.lit("Exited review mode"))),
        ("agent_message", F.coalesce("body", F.lit("Inter-agent message"))),
        ("agent_comm", F.coalesce("body", F.lit("Inter-agent communication"))),
    )
    rolled = F.when(F.col("i_rolled").between(0, tm.MAX_SAFE), F.col("i_rolled"))
    rows = rows.withColumns({
        "summary_text": tx.collapse(text),
        "user_text": F.when(F.col("shape").isin("user", "item:user_message"), F.col("body")),
        # record ids: a given id under its prefix, else a prefix with the entry number
        "given_id": _case(
            (("reasoning", "message", "compaction", "agent_message", "agent_comm", *_ITEM_SHAPES),
             _filled("t_id")),
            ((*_CALLS, "finder_output", "output", *_ENDS), F.col("call")),
            ("subagent", _filled("t_event_id")), ("review", _filled("t_item_id")),
        ),
        "id_prefix": _case(
            ((*_CALLS, *_ENDS), F.lit("tool-")), (("finder_output", "output"), F.lit("tool-result-")),
            ("subagent", F.lit("subagent-")), otherwise=F.lit(""),
        ),
        "number_prefix": _case(
            ("user", F.lit("user-")), ("reasoning", F.lit("reasoning-")),
            ("message", F.lit("assistant-")), ((*_CALLS, *_ENDS), F.lit("tool-")),
            (("finder_output", "output"), F.lit("tool-result-")),
            (("compaction", "checkpoint", "compacted"), F.lit("compaction-")),
            ("subagent", F.lit("subagent-")), ("review", F.lit("review-")),
            ("agent_message", F.lit("agent-message-")), ("agent_comm", F.lit("agent-communication-")),
            (_ITEM_SHAPES, F.lit("item-")),
        ),
        "warning": _case(
            ("bad_item", F.lit("malformed_item_completed")), ("item:?", F.lit("unsupported_turn_item")),
            ("other_response", F.lit("unsupported_response_item")),
            ("rollback", F.when(rolled.isNull(), "malformed_thread_rollback")
             .otherwise("thread_rolled_back")),
        ),
        "warning_detail": _case(
            ("item:?", F.coalesce(F.when(F.col("item_type") != "", F.col("item_type")),
                                  F.lit("<missing>"))),
            ("other_response", F.col("type_in")), ("rollback", rolled.cast("string")),
        ),
    })
    return rows.withColumns({
        "summary_text": tx.clip(F.col("summary_text"), tx.SUMMARY_LIMIT),
        "specific": ~F.lower("label").isin(*GENERIC_TOOLS),
    })


def _add_outcome(rows: DataFrame) -> DataFrame:
    """Times, durations, failure and turn fields."""
    ts, status, no = F.col("ts_ms"), F.col("status"), F.lit(False)
    untrue = F.coalesce(~F.col("b_success"), no)
    says = F.coalesce("says_error", no)
    done = F.coalesce(F.when(tm.ms_field(F.col("n_done")) > 0, tm.ms_field(F.col("n_done"))), ts)
    begun = F.when(tm.ms_field(F.col("n_begun")) > 0, tm.ms_field(F.col("n_begun")))
    ended = F.coalesce("t_ended", ts)
    took = F.col("duration_read")
    occurred = F.coalesce(tm.ms_field(F.col("n_occurred")), ts)
    bad_item = F.coalesce(status.isin(*ITEM_FAILED), no)
    unsuccessful = ~F.coalesce(status.isin(*SUCCEEDED), F.lit(True))
    empty_error = F.coalesce(F.to_json(vx.field(F.col("src"), "error")).isin(
        '""', "false", "0", "[]", "{}"), no)
    rows = rows.withColumns({
        "start_ms": _case(
            ("start", F.coalesce("t_begun", ts)), (("end", "abort"), F.coalesce("t_begun", ended)),
            (_ITEM_SHAPES, F.coalesce(begun, done)), ("subagent", occurred),
            (_ENDS, F.when(took.isNotNull() & ts.isNotNull(), F.greatest(ts - took, F.lit(0)))
             .otherwise(ts)),
            otherwise=ts,
        ),
        "end_ms": _case((("end", "abort"), ended), (_ITEM_SHAPES, done), ("subagent", occurred),
                        otherwise=ts),
        "persisted_start": _case(
            (("start", "end", "abort"), F.col("t_begun")), (_ITEM_SHAPES, begun),
            (("search", "image"), ts), (("shell", "finder"), F.when(F.col("role") == "TT", ts)),
        ),
        "duration_ms": _case(
            (("end", "abort"), tm.ms_field(F.col("n_duration_ms"))), (_ENDS, took),
            ("item:extension", F.when(F.col("extension") == "clock.sleep",
                                      tm.ms_field(F.col("n_sleep"))).otherwise(took)),
            (TOOL_ITEMS, took),
        ),
        "failed": F.coalesce(_case(
            (("shell", "finder"), (F.col("role") == "TT") & (status != "completed")),
            ("finder_output", status.isin(*OUTPUT_FAILED)), (("search", "image"), unsuccessful),
            ("output", says), ("mcp_end", untrue | says),
            ("patch_end", untrue | F.coalesce(status.isin(*PATCH_FAILED), no)),
            ("image_end", unsuccessful | F.col("has_failure")),
            ("item:dynamic_tool_call", bad_item | untrue | (F.col("has_error") & ~empty_error)),
            ("item:image_generation", bad_item | F.coalesce(status != "completed", no)),
            ("item:mcp_tool_call", bad_item | F.col("has_error") | says),
            ("item:extension", bad_item | F.coalesce(
                (F.col("extension") == "image_gen.generation") & F.col("has_failure"), no)),
            (TOOL_ITEMS, bad_item),
        ), no),
        "authoritative": F.col("role").isin("TT", "IT"),
        "ttft_ms": _case((("end", "abort"), tm.ms_field(F.col("n_ttft")))),
        "aborted": F.col("shape") == "abort",
        "errored": _case(("end", F.col("has_error"))),
        "error_text": _case(("abort", F.coalesce("t_reason", "t_reason_message")),
                            ("end", F.coalesce("t_error", "t_error_message"))),
        "model": _case((("context", "start"), F.col("s_model"))),
        "effort": _case(("context", F.col("s_effort"))),
        "collaboration": _case(("context", F.coalesce("s_mode", "s_mode_kind")),
                               ("start", F.col("s_mode_kind"))),
        "in_context": F.col("shape") == "context",
    })
    return rows


def _add_samples(rows: DataFrame) -> DataFrame:
    """Token counters, context window, quota windows and session metadata."""
    p = F.col("p")
    is_tokens = F.col("shape") == "tokens"
    names = [f"{c}_tokens" for c in COUNTERS]
    windows = ("primary", "secondary")
    rows = rows.withColumns({
        "__last": F.when(is_tokens, vx.parts_of(p, "info.last_token_usage", *names)),
        "__total": F.when(is_tokens, vx.parts_of(p, "info.total_token_usage", *names)),
        **{f"__{w}": F.when(is_tokens, vx.parts_of(
            p, f"rate_limits.{w}", "used_percent", "window_minutes", "resets_at")) for w in windows},
    })
    rows = rows.withColumns({
        **{f"last_{c}": vx.as_whole(F.col(f"__last.{c}_tokens")) for c in COUNTERS},
        **{f"cum_{c}": vx.as_whole(F.col(f"__total.{c}_tokens")) for c in COUNTERS},
        "has_total": F.when(is_tokens, vx.field(p, "info.total_token_usage").isNotNull()),
        "context_window": _case(("tokens", vx.whole(p, "info.model_context_window")),
                                ("start", vx.whole(p, "model_context_window"))),
        **{f"q_used_{w}": vx.as_number(F.col(f"__{w}.used_percent")) for w in windows},
        **{f"q_minutes_{w}": vx.as_whole(F.col(f"__{w}.window_minutes")) for w in windows},
        **{f"q_reset_{w}_n": vx.as_number(F.col(f"__{w}.resets_at")) for w in windows},
        **{f"q_reset_{w}_t": vx.as_text(F.col(f"__{w}.resets_at")) for w in windows},
        "meta": F.when(F.col("shape") == "meta", _metadata(p)),
    })
    counters = [f"{kind}_{c}" for kind in ("last", "cum") for c in COUNTERS]
    return rows.withColumns({
        **{c: F.when(F.col(c).between(0, tm.MAX_SAFE), F.col(c)) for c in counters},
        "context_window": F.when(F.col("context_window").between(1, tm.MAX_SAFE), F.col("context_window")),
        **{f"quota_{w}": _quota(w) for w in ("primary", "secondary")},
    })


def _quota(w: str) -> Column:
    used, minutes = F.col(f"q_used_{w}"), F.col(f"q_minutes_{w}")
    return F.when(used.between(0, 100) & minutes.between(1, tm.MAX_SAFE), F.struct(
        used.alias("used_percent"), minutes.alias("window_minutes"),
        _stamp(f"q_reset_{w}").alias("resets_ms"),
    ))


def _metadata(p: Column) -> Column:
    """Allowed session metadata only: no instructions, no remotes, no raw payload."""
    short = lambda path, n: tx.some_text(vx.text(p, path), n)
    commit = vx.text(p, "git.commit_hash")
    source_keys = F.map_keys(F.try_variant_get(p, "$.source", "map<string,variant>"))
    source = F.lower(F.coalesce(
        vx.text(p, "source"), F.when(F.size(source_keys) == 1, F.element_at(source_keys, 1))))
    return F.struct(
        tx.identifier(vx.text(p, "id")).alias("id"),
        tx.identifier(vx.text(p, "session_id")).alias("session_id"),
        vx.text(p, "id").alias("raw_id"),
        vx.text(p, "cwd").alias("cwd"), short("originator", 120).alias("originator"),
        F.when(source.isin(*tx.SOURCE_KINDS), source).alias("source_kind"),
        short("parent_thread_id", 100).alias("parent_thread_id"),
        short("agent_path", 200).alias("agent_path"), short("git.branch", 200).alias("git_branch"),
        F.when(commit.rlike("^[0-9a-fA-F]{4,64}$"), commit).alias("git_commit"),
        F.coalesce(tm.ms_of_number(vx.number(p, "timestamp")), tm.ms_of_text(vx.text(p, "timestamp")))
        .alias("timestamp_ms"),
        F.lower(vx.text(p, "history_mode")).alias("history_mode"),
        F.coalesce(vx.given(p, "history_base"), F.lit(False)).alias("has_base"),
        vx.text(p, "history_base.thread_id").alias("base_id"),
        vx.whole(p, "history_base.end_ordinal_exclusive").alias("base_end_ordinal"),
        vx.whole(p, "history_base.end_byte_offset").alias("base_end_byte"),
        F.coalesce(vx.given(p, "subagent_history_start_ordinal"), F.lit(False)).alias("has_subagent_start"),
        vx.whole(p, "subagent_history_start_ordinal").alias("subagent_start"),
    )


def _add_details(rows: DataFrame) -> DataFrame:
    """Input, output and metadata of a record, shown at full detail only."""
    src, p = F.col("src"), F.col("p")
    js = lambda path: vx.json_text(vx.field(src, path))
    extension = F.col("extension")
    given_input = F.when(vx.field(src, "arguments").isNotNull(), js("arguments")).otherwise(js("input"))
    agent = F.to_json(F.struct(
        F.coalesce("s_agent_path", F.lit("subagent")).alias("agentPath"),
        F.col("s_thread").alias("agentThreadId"),
        F.coalesce("s_kind", F.lit("activity")).alias("activity")))
    spoken = [F.col("s_author").alias("author"), F.col("s_recipient").alias("recipient")]
    recipients = F.filter(
        F.transform(vx.array(p, "other_recipients"), lambda r: tx.shorten(vx.as_text(r), 200)),
        lambda r: r.isNotNull())
    size = lambda path: F.coalesce(F.size(vx.array(src, path)), F.lit(0))
    parts = lambda kinds: vx.count_parts(src, "content", kinds)
    phase = F.to_json(F.struct(F.col("s_phase").alias("phase")))
    return rows.withColumns({
        "input": _case(
            (("user", "item:user_message"), F.col("body")), ("item:hook_prompt", js("fragments")),
            ("call", given_input), (("shell", "search"), js("action")), ("finder", js("arguments")),
            (("image", "image_end", "item:image_generation"), _subset(src, "revised_prompt")),
            ("mcp_end", js("invocation.arguments")), (("patch_end", "item:file_change"), js("changes")),
            (("search_end", "item:web_search"), _subset(src, "query", "action")),
            ("item:command_execution", _subset(src, "command", "cwd", "source")),
            (("item:dynamic_tool_call", "item:mcp_tool_call"), js("arguments")),
            ("item:collab_agent_tool_call",
             _subset(src, "prompt", "model", "reasoning_effort", "receiver_thread_ids")),
            ("item:image_view", _subset(src, "path")),
            ("item:extension", F.when(extension == "clock.sleep", _subset(src, "durationMs"))
             .when(extension == "web.search", _subset(src, "query", "action"))
             .when(extension == "image_gen.generation", _subset(src, "revisedPrompt"))
             .otherwise(_subset(src, "kind"))),
        ),
        "output": _case(
            (("reasoning", "message", "agent_message", "agent_comm", "checkpoint",
              "item:agent_message", "item:plan", "item:reasoning"), F.col("body")),
            ("finder_output", js("tools")), (("image", "mcp_end"), js("result")),
            ("output", js("output")), ("patch_end", _subset(src, "stdout", "stderr", "status")),
            (("search_end", "item:web_search"), js("results")),
            ("image_end", _subset(src, "result", "saved_path", "failure")),
            (("review", *_REVIEW_ITEMS), _subset(src, "target", "user_facing_hint", "review_output")),
            ("item:command_execution",
             _subset(src, "stdout", "stderr", "aggregated_output", "exit_code")),
            ("item:dynamic_tool_call", _subset(src, "content_items", "error")),
            ("item:collab_agent_tool_call", js("agents_states")),
            ("item:image_generation", _subset(src, "result", "saved_path")),
            ("item:file_change", _subset(src, "stdout", "stderr")),
            ("item:mcp_tool_call", F.coalesce(js("result"), js("error"))),
            ("item:extension", F.when(extension == "web.search", js("results"))
             .when(extension == "image_gen.generation", _subset(src, "result", "savedPath", "failure"))
             .when(extension != "clock.sleep", F.to_json(src))),
        ),
        "metadata": _case(
            ("user", F.to_json(F.struct(size("images").alias("images"), size("audio").alias("audio")))),
            ("item:user_message", F.to_json(F.struct(
                parts(vx.IMAGE_PARTS).alias("images"), parts(vx.AUDIO_PARTS).alias("audio")))),
            ("reasoning", F.to_json(F.struct(vx.given(src, "encrypted_content").alias("encrypted")))),
            (("message", "item:agent_message"), phase),
            (("subagent", "item:sub_agent_activity"), agent),
            ("agent_message", F.to_json(F.struct(*spoken))),
            ("agent_comm", F.to_json(F.struct(
                *spoken, F.slice(recipients, 1, 20).alias("otherRecipients"),
                F.coalesce(vx.flag(p, "trigger_turn"), F.lit(False)).alias("triggerTurn")))),
            ((*_CALLS, *_ENDS), F.to_json(F.struct(F.col("type_in").alias("protocolType")))),
            ("item:extension", F.to_json(F.struct(
                F.lit("extension").alias("protocolType"), extension.alias("extensionKind")))),
            (TOOL_ITEMS, F.to_json(F.struct(F.col("item_type").alias("protocolType")))),
            otherwise=F.lit("{}"),
        ),
    })


# Columns of a ledger row; what else was read from an entry stays behind.
LEDGER_COLUMNS = (
    "shape", "ordinal", "has_ordinal", "role", "legacy_only", "kind", "call", "eid", "ts_ms",
    "start_ms", "end_ms", "persisted_start", "duration_ms", "ttft_ms", "aborted", "errored",
    "error_text", "label", "specific", "summary_text", "failed", "authoritative", "given_id",
    "id_prefix", "number_prefix", "user_text", "warning", "warning_detail", "model", "effort",
    "collaboration", "in_context", "has_total", *[f"last_{c}" for c in COUNTERS],
    *[f"cum_{c}" for c in COUNTERS], "context_window", "quota_primary", "quota_secondary", "meta",
)
DETAIL_COLUMNS = ("input", "output", "metadata")


def project(entries: DataFrame, detail: bool = True) -> DataFrame:
    """Ledger rows of admitted entries (map only: nothing is shuffled).

    The steps build on each other, so every JSON path is read once per entry.
    """
    kept = [c for c in entries.columns if c != "entry"]
    rows = _read_scalars(add_shape(entries))
    rows = _add_samples(_add_outcome(_add_texts(_add_roles(rows))))
    if detail:
        rows = _add_details(rows)
    return rows.select(*kept, *LEDGER_COLUMNS, *(DETAIL_COLUMNS if detail else ()))
