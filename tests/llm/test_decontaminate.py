from __future__ import annotations

import hashlib
import random
import re

from logloom.llm import decontaminate
from tests.llm.texts import SCHEMA, documents, rows_of, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    out = []
    for doc in docs:
        text, hit, found = words(doc.text), set(), set()
        for item in items:
            have = words(item.text)
            size = min(13, len(have))
            for at in range(len(have) - size + 1 if have else 0):
                window = have[at:at + size]
                for start in range(len(text) - size + 1):
                    if text[start:start + size] == window:
                        hit |= set(range(start, start + size))
                        found.add("null" if item.item_id is None else str(item.item_id))
        names = ",".join(sorted(found))
        out.append((doc.doc_id, len(text), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(text)))
    return sorted(out, key=repr)


def tables(spark):
    docs = documents(spark)
    rng = random.Random(3)
    texts = [r.text for r in docs.where("length(text) > 200").limit(40).collect()]
    items = [(i, " ".join(rng.choice(texts).split()[5:5 + rng.randint(2, 40)]), "x") for i in range(25)]
    items += [(30, None, None), (31, "", "y"), (32, "One", "z"), (33, "tie, TIE tie!", "z"), (None, "x " * 20, "n"), items[0],
              (34, sentence(rng, 30), "never")]
    return docs, spark.createDataFrame(items, ITEMS)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_equal_to_brute_force(spark):
    docs, items = tables(spark)
    want = brute(docs.collect(), items.collect())
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    assert rows_of(decontaminate.contamination(docs, items).select(*COLUMNS)) == want


def test_items_in_several_blocks(spark):
    docs, items = tables(spark)
    got = decontaminate.contamination(docs, items, block_bytes=600).select(*COLUMNS)
    assert rows_of(got) == brute(docs.collect(), items.collect())


def test_clean_rows_keep_all_columns(spark):
    docs, items = tables(spark)
    docs = docs.withColumnRenamed("source", "n_hit")
    bad = {(r[0], r[1]) for r in brute(docs.collect(), items.collect()) if r[5]}  # id and length
    clean = sorted((tuple(r) for r in docs.collect() if (r.doc_id, len(words(r.text))) not in bad), key=repr)
    for size in (600, 1 << 20):
        kept = decontaminate.without_contaminated(docs, items, block_bytes=size)
        assert kept.schema == docs.schema
        assert rows_of(kept) == clean


def uncovered(text, items, most):
    """The text without its spans of more than ``most`` words, or without any span if a twentieth of its words is hit."""
    places, have, hit = [m.span() for m in WORD.finditer(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))], words(text), set()
    for item in items:
        size = min(13, len(words(item.text)))
        windows = {tuple(words(item.text)[i:i + size]) for i in range(len(words(item.text)) - size + 1)} if size else ()
        for start in range(len(have) - size + 1):
            if tuple(have[start:start + size]) in windows:
                hit |= set(range(start, start + size))
    gone, at = "", 0
    runs = [(i, next(j for j in range(i, len(have) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
    for a, b in runs:
        if b - a > most or 20 * len(hit) >= len(have):
            gone, at = gone + text[at:places[a][0]], places[b - 1][1]
    return gone + text[at:] if at else text


def test_spans_over_the_limits_are_cut(spark):
    docs, items = tables(spark)
    rng = random.Random(8)
    item = " ".join(f"q{rng.randrange(10**9)}" for _ in range(60))
    more = [(7000 + n, f"{sentence(rng, 600, 10**6)}. {' '.join(item.split()[:n])}, {sentence(rng, 600, 10**6)}!", "en", "s", 1) for n in (12, 13, 20, 21, 50)]
    docs = docs.unionByName(spark.createDataFrame(more, SCHEMA)).withColumnRenamed("lang", "hits")
    items = items.unionByName(spark.createDataFrame([(90, item, "q")], ITEMS))
    for most, size in ((20, 1 << 20), (20, 700), (0, 1 << 20), (10_000, 1 << 20)):
        cleaned = decontaminate.without_spans(docs, items, span_words=most, block_bytes=size)
        assert cleaned.schema == docs.schema
        rows = items.collect()
        want = sorted(((r.doc_id, uncovered(r.text, rows, most), *r[2:]) for r in docs.collect()), key=repr)
        assert rows_of(cleaned) == want
        changed = {a[0] for a, b in zip(want, rows_of(docs), strict=True) if a[1] != b[1]}
        assert {7000 + n in changed for n in (21, 50)} == {most < 10_000} and 7012 not in changed and (7020 in changed) == (most == 0)


def test_empty_tables(spark):
    docs, items = tables(spark)
    none = spark.createDataFrame([], SCHEMA)
    assert decontaminate.contamination(none, items).collect() == []
    clean = decontaminate.contamination(docs, spark.createDataFrame([], ITEMS))
    assert clean.where("contaminated or n_hit > 0 or n_items > 0").count() == 0


def test_cut():
    text = "a, b! c\nd"
    assert decontaminate.cut(text, [{"start": 1, "stop": 3}]) == "a, \nd"
