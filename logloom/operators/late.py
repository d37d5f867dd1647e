"""Late markers: a result far from its call also gets a record of its own near the result.

``add_late_markers`` flags results of a plain ledger; ``with_markers`` inserts the records into the ledger of logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.carry import dealt, earliest, latest, scan, total
from logloom.operators.sequence import CALL_ROLES, RESULT_ROLES, add_owner, pair_compactions, role_in
from logloom.session import materialise, written

#: Distance in records at which call and result no longer share the smallest page (fixed value).
FAR = 50


def add_late_markers(rows: DataFrame, far: int = FAR) -> DataFrame:
    """``late`` marks results that add a marker; ``index`` and ``marker_index`` count markers too.

    A marker takes a record number, which moves later records, and becomes the
    record its call id points to. Each flag depends on earlier rows only, so
    starting without markers and repeating until no flag changes reaches the one
    answer: every round settles at least one more row of each session. A round is
    a set of scans over all sessions at once and is written down.
    """
    in_call = role_in(*CALL_ROLES) & F.col("call").isNotNull()
    rows = materialise(rows.withColumn("late", F.lit(False)))
    while True:
        # numbers before this row's own marker, which comes after the row's own record
        counted = scan(
            rows, total("__records", F.col("creates")), total("__late", F.col("late"), before=True),
        ).withColumn("__number", F.col("__records") + F.col("__late"))
        pointed = F.when(F.col("late"), F.col("__number") + 1).when(
            F.col("creates"), F.col("__number"))
        owned = scan(
            counted, latest("__to", F.when(in_call, pointed), before=True),
            by=("session", "call"), contiguous=False,
        )
        distance = F.col("__number") - F.col("__to")
        is_late = role_in(*RESULT_ROLES) & in_call & ~F.col("creates") & (distance >= far)
        flagged = materialise(owned.withColumn("__new", F.coalesce(is_late, F.lit(False))))
        settled = not flagged.filter("__new <> late").head(1)
        rows = flagged.withColumns({
            "late": F.col("__new"),
            "index": F.when(F.col("creates"), F.col("__number")),
            "marker_index": F.when(F.col("__new"), F.col("__number") + 1),
        }).drop("__records", "__late", "__number", "__to", "__new")
        if settled:
            return rows


#: Roles whose rows can add a record.
_RECORDS = ("M", "IM", "IU", "U", "A", "P", "CC", "IC", *CALL_ROLES)
_NARROW = ("session", "seq", "role", "call", "eid", "start_ms", "end_ms", "ts_ms")


def with_markers(rows: DataFrame, far: int = FAR) -> DataFrame:
    """``rows`` with a row of role L before each result whose call's record lies ``far`` records or more back.

    The row adds the marker's record, so that turns, indexes and owners come out of the same scans as
    for any other; from there on it is the record of its call id. It is a copy of the result: ``late_of`` is the
    seq of the record the result finishes as well, ``late_start`` that record's start and ``late_root`` the seq of the
    first record of the run of that call id. The columns are missing where there is no marker.

    Which results are far depends on earlier markers, on turns and on compaction pairs. That is settled on a narrow
    written table of the sessions that may have one: starting without markers and numbering anew until
    nothing changes reaches the one answer, as each flag depends on earlier rows only.
    """
    per_session = rows.filter(role_in(*_RECORDS)).groupBy("session").count().filter(F.col("count") > far)
    if not per_session.head(1):
        return rows
    narrow = rows.select(*_NARROW, *[c for c in ("chunk",) if c in rows.columns]).join(
        per_session.select("session"), "session", "left_semi")
    narrow = written(narrow.withColumn("seq", F.col("seq") * 2), "narrow")
    marks = _settled(narrow, far)
    if marks is None:
        return rows
    count = narrow.count() + marks.count()
    rows = rows.withColumn("seq", F.col("seq") * 2)
    results = rows.filter(role_in(*RESULT_ROLES) & F.col("call").isNotNull())
    places = marks.select("session", "seq", "late_of", "late_start", "late_root")
    copies = dealt(results, count, "session", "seq").join(
        dealt(places, count, "session", "seq"), ["session", "seq"]).withColumns({
        "seq": F.col("seq") - 1, "late_role": F.col("role"), "role": F.lit("L"), "kind": F.lit("tool"),
        "start_ms": F.col("end_ms"), "eid": F.lit(None).cast("string"), "warning": F.lit(None).cast("string"),
    })
    return _in_sessions(rows.unionByName(copies, allowMissingColumns=True), count)


def _in_sessions(rows: DataFrame, count: int) -> DataFrame:
    """Rows dealt by session for the scans to come; chunks stay where they are."""
    return rows if "chunk" in rows.columns else dealt(rows, count, "session")


def _settled(narrow: DataFrame, far: int) -> DataFrame | None:
    """The results that add a marker, as narrow rows with late_of, late_start and late_root; None if there is none."""
    marks, before = None, None
    count = narrow.count()
    compactions = bool(narrow.filter(role_in("P", "CC", "IC")).head(1))
    while True:
        rows = narrow if marks is None else narrow.unionByName(
            marks.drop("late_of", "late_start", "late_root").withColumns({
                "seq": F.col("seq") - 1, "role": F.lit("L"), "start_ms": F.col("end_ms"), "eid": F.lit(None).cast("string")}))
        rows = add_owner(_in_sessions(rows, count + (before[0] if before else 0)))
        if compactions:
            rows = pair_compactions(rows)
        rows = scan(rows, total("__number", F.col("creates")))
        carried = role_in(*CALL_ROLES, "L") & F.col("call").isNotNull()
        record = F.struct("seq", "start_ms", F.col("__number").alias("number"))
        rows = scan(
            rows, latest("__to", F.when(carried & role_in("T", "L"), record), before=True),
            latest("__called", F.when(carried & role_in("T"), F.col("seq")), before=True),
            earliest("__first", F.when(carried, record)), by=("session", "call"), contiguous=False)
        known = F.coalesce("__to", F.when(F.col("__first.seq") < F.col("seq"), F.col("__first")))
        # a result that has a marker already is judged by the marker, which knows the record before it
        judged = role_in("L") | (role_in(*RESULT_ROLES) & ~F.coalesce(
            (F.col("__to.seq") == F.col("seq") - 1) & (F.col("seq") % 2 == 0), F.lit(False)))
        distance = F.col("__number") - F.col("creates").cast("long") - known["number"]
        found = rows.filter(carried & judged & (role_in("L") | ~F.col("creates")) & (distance >= far)).select(
            F.when(role_in("L"), F.col("seq") + 1).otherwise(F.col("seq")).alias("seq"),
            *[c for c in narrow.columns if c != "seq"],
            known["seq"].alias("late_of"), known["start_ms"].alias("late_start"),
            F.coalesce("__called", "__first.seq").alias("late_root"))
        marks = written(found, "markers")
        now = marks.agg(F.count("*"), F.bit_xor(F.xxhash64("session", "seq", "late_of"))).first()
        if now == before or not now[0]:
            return marks if now[0] else None
        before = now
