from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from logloom.llm import quality_rules
from tests.llm.texts import SCHEMA, documents, rows_of

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_statistics_equal_brute_force(spark):
    docs = documents(spark).withColumnRenamed("source", "words")
    got = quality_rules.statistics(docs).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for r in docs.collect():
        b = brute(r.text)
        want.append((r.doc_id, *b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
    assert rows_of(got) == sorted(want, key=repr)
    assert any(w[5] for w in want)


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 50), (5, 2000), (40, 9000), (0, 100_000), (900, 100_000), (7, 7)]
    df = spark.createDataFrame(cases, "k long, n long")
    for rate in (0.003, 0.2):
        got = {(r.k, r.n): r.p for r in df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), rate).alias("p")).collect()}
        for k, n in cases:
            terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)
                     for i in range(k + 1)]
            want = min(1.0, math.exp(max(terms)) * sum(math.exp(t - max(terms)) for t in terms))
            assert abs(got[k, n] - want) <= 1e-7 * want + 1e-300


def test_cutoffs_are_safe_and_strict(spark):
    rows = [(i, "en" if i % 2 else None, " ".join(["word"] + [f"w{i}x{j}" for j in range(40 + i % 100)]) + (" #" * (i % 3 == 0)))
            for i in range(6000)]
    rows += [(10_000 + i, "en", " ".join(f"### v{i}x{j}" for j in range(40))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 10_000), 0) for r in rows] + [(None, 1, 0), (3, 1, 0), (5, None, 0)], LABELS)
    stats = quality_rules.statistics(docs)
    chosen = {(r.stratum, r.rule): r for r in quality_rules.thresholds(stats, labels).collect()}
    assert {s for s, _ in chosen} == {"en", None}
    assert chosen["en", "symbol_share"].cutoff == 0.01 and chosen["en", "symbol_share"].rejected == 0
    good = {r[0] for r in rows if r[0] < 10_000}
    kept = {r.doc_id: r.kept for r in quality_rules.judged(docs, labels).collect()}
    assert sum(not kept[i] for i in good) <= 0.03 * len(good)
    assert not any(kept[r[0]] for r in rows if r[0] >= 10_000)


def test_few_labels_reject_nothing_more(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], LABELS)
    for given in (labels, spark.createDataFrame([], LABELS)):
        out = quality_rules.judged(docs, given)
        assert out.where("kept = base_failed").count() == 0 and out.count() == docs.count()
    assert quality_rules.judged(spark.createDataFrame([], SCHEMA), labels).collect() == []
