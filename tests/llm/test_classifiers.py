from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import quality_trees, toxicity
from tests.llm.texts import SCHEMA, documents, rows_of, sentence

LABELS = "doc_id long, quality int, toxic int"


def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def given(spark, rows=900):
    rng, texts, labels = random.Random(2), [], []
    for i in range(rows):
        good, toxic = i % 4 != 0, i % 7 == 0
        text = sentence(rng, rng.randint(30, 120), 3000)
        if not good:
            text = text.upper() + " !! ###" if i % 8 else (text + " | ") * 3
        if toxic:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["Vile,", "nasty", "SCUMMY.", "rotten"]))
            text = " ".join(words)
        texts.append((i, text, "en", "s", len(text)))
        if i % 3:
            labels.append((i, int(good), int(toxic)))
    odd = [(rows, None, None, None, None), (rows + 1, "", "en", "s", 0), (None, "nasty", None, None, None), texts[1], texts[1],
           (rows + 2, "nasty vile " * 20_000, "en", "s", 0)]
    labels += [(None, 1, 1), (2, None, None), (1, 0, 1)]
    return spark.createDataFrame(texts + odd, SCHEMA).repartition(3), spark.createDataFrame(labels, LABELS), {
        i: (i % 4 != 0, i % 7 == 0) for i in range(rows)}


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = given(spark)
    docs = docs.withColumnRenamed("lang", "score")
    out = quality_trees.scored(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert auc(np.array([r.score for r in held]), np.array([int(truth[r.doc_id][0]) for r in held])) > 0.97


def test_scores_ignore_labels_of_held_out_rows_and_other_columns(spark):
    docs, labels, _ = given(spark, 300)
    turned = labels.withColumns({
        "quality": F.when(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), 1 - F.col("quality")).otherwise(F.col("quality")),
        "toxic": F.when(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), 1 - F.col("toxic")).otherwise(F.col("toxic"))})
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    assert rows_of(quality_trees.scored(docs, labels)) == rows_of(quality_trees.scored(moved, turned))
    assert rows_of(toxicity.scored(docs, labels)) == rows_of(toxicity.scored(moved, turned))


def test_trees_fit_a_plain_rule():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(2000, 5))
    labels = ((rows[:, 1] > 0.3) ^ (rows[:, 3] > 0)).astype(float)
    model = quality_trees.fit(rows, labels)
    fresh = rng.normal(size=(1000, 5))
    want = (fresh[:, 1] > 0.3) ^ (fresh[:, 3] > 0)
    assert np.mean((model.score(fresh) > 0.5) == want) > 0.95

    def walk(row):
        margin = model.base
        for features, cuts, values in zip(model.features, model.cuts, model.values, strict=True):
            node = 0
            while 2 * node + 1 < len(features):
                node = 2 * node + 1 + int(row[features[node]] > cuts[node])
            margin += values[node]
        return 1 / (1 + np.exp(-margin))

    assert np.allclose(model.score(fresh[:50]), [walk(r) for r in fresh[:50]])


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = given(spark)
    docs = docs.withColumnRenamed("lang", "toxic")
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    real = np.array([int(truth[r.doc_id][1]) for r in held])
    assert auc(np.array([r.score for r in held]), real) > 0.97
    kept = toxicity.without_toxic(docs, labels)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r.predicted == 0 for r in rows)


def test_the_clean_risk_stays_non_negative():
    rng = random.Random(1)
    words = [f"w{i}".encode() for i in range(40)]
    positive = [set(rng.sample(words[:20], 6)) for _ in range(300)]
    clean = [set(rng.sample(words, 6)) for _ in range(700)]
    unlabelled = clean + [set(rng.sample(words[:20], 6)) for _ in range(300)]
    model = toxicity.fit(positive, unlabelled, 0.3)
    assert sum(model.score(" ".join(w.decode() for w in t)) > 0.5 for t in positive) > 200
    assert sum(model.score(" ".join(w.decode() for w in t)) < 0.5 for t in clean) > 500


def test_the_slope_is_that_of_the_risk():
    """Against differences of the risk, added up row by row."""
    rng = random.Random(6)

    def risk(margins, n_pos, prior):
        toxic = sum(math.log(1 + math.exp(-m)) for m in margins[:n_pos]) / n_pos
        clean = (sum(math.log(1 + math.exp(m)) for m in margins[n_pos:]) / (len(margins) - n_pos)
                 - prior * sum(math.log(1 + math.exp(m)) for m in margins[:n_pos]) / n_pos)
        return (prior * toxic + clean, clean) if clean >= 0 else (-clean, clean)  # below 0 the clean part is led back up

    signs = set()
    for _ in range(60):
        n_pos, prior = rng.randint(1, 4), rng.choice([0.1, 0.5, 0.9])
        margins = [rng.gauss(1, 2) for _ in range(n_pos)] + [rng.gauss(rng.choice([-3, 1]), 1) for _ in range(rng.randint(1, 5))]
        slope = toxicity.risk_slope(np.array(margins), n_pos, prior)
        signs.add(risk(margins, n_pos, prior)[1] >= 0)
        for at in range(len(margins)):
            moved = [[m + (i == at) * d for i, m in enumerate(margins)] for d in (1e-5, -1e-5)]
            up, down = (risk(m, n_pos, prior)[0] for m in moved)
            assert abs((up - down) / 2e-5 - slope[at]) < 1e-5
    assert signs == {True, False}


def test_toxicity_equals_a_fit_on_plain_sets(spark):
    docs, labels, truth = given(spark)
    texts = {}
    for r in docs.collect():
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            texts.setdefault(r.doc_id, set()).add(r.text)
    assert all(len(t) == 1 for t in texts.values())
    known = {}
    for r in labels.collect():
        if r.doc_id in texts and r.toxic is not None:
            known[r.doc_id] = max(r.toxic, known.get(r.doc_id, 0))
    every = labels.where("doc_id is not null and toxic is not null and not (crc32(cast(doc_id as string)) % 3 = 1)")
    share = np.mean([r.t for r in every.groupBy("doc_id").agg(F.max("toxic").alias("t")).collect()])
    words = {i: toxicity.normal(next(iter(t))) for i, t in texts.items()}
    model = toxicity.fit([words[i] for i in sorted(words) if known.get(i) == 1], [words[i] for i in sorted(words)], share)
    rows = toxicity.scored(docs, labels).collect()
    by_text = {(r.doc_id, r.text) for r in docs.collect()}
    want = {(i, round(model.score(t), 6)) for i, t in by_text}
    assert {(r.doc_id, round(r.score, 6)) for r in rows} == want


@pytest.mark.parametrize("known", [1.0, 0.3, 0.05])
def test_scores_follow_the_prior_whatever_share_is_confirmed(known):
    rng = random.Random(2)
    words = [f"w{i}".encode() for i in range(60)]
    bad, good = ([set(rng.sample(words[a:b], 6)) for _ in range(n)] for a, b, n in ((0, 30, 400), (20, 60, 1600)))
    confirmed = rng.sample(bad, int(known * len(bad)))
    model = toxicity.fit(confirmed, bad + good, 0.2, steps=200)
    scores = [model.score(" ".join(w.decode() for w in t)) for t in bad + good]
    assert 0.1 < np.mean([s > 0.5 for s in scores]) < 0.3
    assert auc(np.array(scores), np.array([1] * 400 + [0] * 1600)) > 0.9


def test_trees_equal_a_slow_fit():
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(160, 3)).round(1)
    labels = ((rows[:, 0] > 0.2) ^ (rng.random(160) < 0.1)).astype(float)
    trees, levels, bins, rate, least, penalty = 4, 2, 8, 0.3, 5.0, 1.0
    model = quality_trees.fit(rows, labels, trees, levels, rate, bins, least, penalty)
    cuts = [sorted(set(np.quantile(rows[:, f], [k / bins for k in range(1, bins)]))) for f in range(3)]
    margin = [math.log(labels.mean() / (1 - labels.mean()))] * 160
    for _ in range(trees):
        chance = [1 / (1 + math.exp(-m)) for m in margin]
        leaves = [list(range(160))]
        for _ in range(levels):
            after = []
            for leaf in leaves:
                best = (1e-6, None)
                for f, c in ((f, c) for f in range(3) for c in cuts[f]):
                    parts = [[i for i in leaf if (rows[i, f] > c) == side] for side in (False, True)]
                    g, h = zip(*[(sum(chance[i] - labels[i] for i in p), sum(chance[i] * (1 - chance[i]) for i in p)) for p in parts], strict=True)
                    if min(h) < least / 4:
                        continue
                    gain = sum(x * x / (y + penalty) for x, y in zip(g, h, strict=True)) - sum(g) ** 2 / (sum(h) + penalty)
                    if gain > best[0] + 1e-9:
                        best = (gain, parts)
                after += best[1] or [leaf, []]
            leaves = after
        for leaf in leaves:
            g, h = sum(chance[i] - labels[i] for i in leaf), sum(chance[i] * (1 - chance[i]) for i in leaf)
            for i in leaf:
                margin[i] -= rate * g / (h + penalty)
    assert np.allclose(model.score(rows), 1 / (1 + np.exp(-np.array(margin))))


def test_quality_does_not_hang_on_the_order_of_rows(spark):
    docs, labels, _ = given(spark)
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" And more of it, in other words."))))
    found = [rows_of(quality_trees.scored(twice.repartition(n), labels)) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2]
    found = [rows_of(toxicity.scored(twice.repartition(n), labels)) for n in (1, 7)]
    assert found[0] == found[1]


def test_without_labels(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality_trees.scored(docs, none).collect()} == {0.5}
    assert {round(r.score, 9) for r in toxicity.scored(docs, none).collect()} == {0.1}
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_trees.scored(empty, none).collect() == [] == toxicity.scored(empty, none).collect()
