from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from logloom.llm import bytebpe, jaccard, toxicity
from logloom.llm.queries import RANK_FILE
from tests.llm import test_decontaminate, test_jaccard, test_substring
from tests.llm.test_classifiers import LABELS
from tests.llm.texts import SCHEMA, documents, rows_of, sentence


def corpus(spark, folder):
    """Texts with toxic words, near copies, shared passages and benchmark items, with labels."""
    rng, rows = random.Random(12), [tuple(r) for r in documents(spark, rows=90).collect()]
    item = sentence(random.Random(77), 30, 10**6)
    labels = []
    for i in range(1000, 1400):
        text = sentence(rng, rng.randint(25, 80), 3000)
        if i % 5 == 0:
            text += " vile scummy nasty Rotten vile"
            text = " ".join(rng.sample(text.split(), len(text.split())))
        rows.append((i, text, "en", None, len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(2000, sentence(rng, 20, 10**6) + " " + item, "en", "s", 1), (2001, sentence(rng, 2000, 10**6) + " " + item, "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_equal_brute_force(spark, tmp_path):
    folder = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, out = docs.collect(), stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/stage{number}")
        after = spark.read.parquet(f"{folder}/stage{number}")
        got = sorted((tuple(r) for r in after.collect()), key=repr)
        if number == 0:
            bad = {r.doc_id for r in toxicity.scored(docs, labels).where("predicted = 1").collect()}
            want = [tuple(r) for r in before if r.doc_id not in bad]
            assert sum(i in bad for i in range(1000, 1400, 5)) > 70 and not any(i in bad for i in range(1000, 1400) if i % 5)
        elif number == 1:
            lost = {w[0] for w in test_jaccard.brute(before, corpus_pipeline.NEAR_COPY)[0] if w[0] is not None and w[2] != w[0]}
            want = [tuple(r) for r in before if r.doc_id not in lost]
            assert lost
        elif number == 2:
            words = sorted(((i, len(t.encode().split()) if t else 0) for i, t, *_ in got), key=repr)
            assert words == sorted(((w[0], w[1] - w[2]) for w in test_substring.brute(before)), key=repr)
            assert sorted(hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for _, t, *_ in got) == \
                sorted(w[3] for w in test_substring.brute(before))
            want = None
        else:
            bad = {(w[0], w[1]) for w in test_decontaminate.brute(before, items.collect()) if w[5]}
            want = [tuple(r) for r in before if (r.doc_id, len(test_decontaminate.words(r.text))) not in bad]
            assert {i for i, _ in bad} >= {2000} and 2001 in {w[0] for w in want}
        assert want is None or got == sorted(want, key=repr)
        docs = after
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANK_FILE), special_tokens={})
    want = sorted(((r.doc_id, len(library.encode_ordinary(r.text or ""))) for r in docs.collect()), key=repr)
    assert rows_of(corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens")) == want


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", LABELS), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_copies_share_four_fifths_of_their_runs_of_five_words(spark, tmp_path):
    rng = random.Random(4)
    hundred, fifty = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(50)]
    rows = [(1, " ".join(hundred)), (2, " ".join(["x" if i in (30, 60) else w for i, w in enumerate(hundred)])),
            (3, " ".join(fifty)), (4, " ".join(["x" if i == 25 else w for i, w in enumerate(fifty)]))]
    for first, words in ((100, 12), (200, 30), (300, 60), (400, 140), (500, 400)):
        rows += [(first + i, t) for i, t in test_jaccard.near(0, words // 15 + 1, 40, words)]
    rows += [(900 + i, sentence(rng, rng.randint(1, 12), 3)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).unionByName(
        documents(spark, seed=5).withColumn("doc_id", F.col("doc_id") + 2000)).repartition(3)
    before = docs.collect()
    label = {w[0]: w[2] for w in test_jaccard.brute(before, jaccard.Likeness(5, 4, 5))[0]}
    assert label[2] == 1 and label[4] == 3
    want = sorted((tuple(r) for r in before if r.doc_id is None or label[r.doc_id] == r.doc_id), key=repr)
    assert rows_of(corpus_pipeline.without_near_copies(spark, docs, str(tmp_path))) == want
