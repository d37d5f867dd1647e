"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives. The unlabelled texts are a sample of all texts, whatever is known
of them, so that the class prior, the share of toxic rows among the labelled ones, holds for it. The classifiers minimise the class-prior-corrected risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

so that toxic texts among the unlabelled do not count as clean ones, and the clean part of
the risk cannot become negative: where it does, the step goes the other way. The risk is
estimated on the whole sample at every step, as small batches make its clean part negative by
chance. Each classifier is linear over the words of a text (present or not); the score is the
mean chance of several classifiers, each fitted to another part of the unlabelled texts.

The fit runs on the driver from a bounded sample: at most ``POSITIVES`` toxic and ``UNLABELLED`` texts of different
ids, chosen by a hash of the id, as numbers of at most ``VOCABULARY`` words, those whose shares among
the two samples differ by most standard errors, counted by an aggregate. Which texts are sampled is decided on ids
alone; only that bounded list of ids is broadcast. Every text is scored whole.

Defined results: null is the empty text and gets a score too; of several texts of a sampled id the one whose words have
the largest hash is learned from; labels of a document that
disagree count as toxic; null ids and labels are not learned from; without positives or
without unlabelled texts every score is the prior; repeated rows get equal scores; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.decontaminate import words_of
from logloom.llm.texts import map_batches
from logloom.session import written

#: Bounds of the sample, and the cutoff of a prediction.
POSITIVES, UNLABELLED, VOCABULARY, CUTOFF = 4_000, 12_000, 4_096, 0.7
#: Words of a sampled text that are kept: those a vocabulary can hold come from this many texts at least.
LEAST_TEXTS = 5
#: Standard errors by which a word's share among positives differs at least from that among the others.
DIFFERENCE = 5.0
#: Classifiers, steps and their size, share of the unlabelled texts each sees, and the prior where none can be counted.
CLASSIFIERS, STEPS, STEP, SHARE, PRIOR = 3, 400, 0.1, 0.7, 0.1
SEED = 23


def normal(text: str | None) -> set[bytes]:
    return set(words_of(text.lower() if text else None))


class Classifier:
    """A linear model over the presence of words."""

    def __init__(self, words: list[bytes], weights: np.ndarray, bias: np.ndarray):
        self.known, self.weights, self.bias = {w: i for i, w in enumerate(words)}, weights, bias

    def score(self, text: str | None) -> float:
        found = [self.known[w] for w in self.known.keys() & normal(text)]
        margins = self.weights[:, sorted(found)].sum(1) + self.bias
        return float(np.mean(1 / (1 + np.exp(-margins))))


class Texts:
    """Texts as ragged rows of word numbers."""

    def __init__(self, rows: list[np.ndarray]):
        self.flat = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32)
        self.sizes = np.array([len(r) for r in rows], np.int64)

    def of(self) -> np.ndarray:
        """The text that each number stands in."""
        return np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)


def fit(positive: list[set[bytes]], unlabelled: list[set[bytes]], prior: float, **settings) -> Classifier:
    """Fit the classifiers to the non-negative risk of texts given as sets of words."""
    words = sorted(set().union(*positive, *unlabelled))
    known = {w: i for i, w in enumerate(words)}
    rows = [Texts([np.array(sorted(known[w] for w in t), np.int32) for t in texts]) for texts in (positive, unlabelled)]
    return fit_rows(words, *rows, prior, **settings)


def risk_slope(margin: np.ndarray, n_pos: int, prior: float) -> np.ndarray:
    """By how much the risk grows with each margin, positives first; away from the clean part where that is negative."""
    n_rest = len(margin) - n_pos
    chance = 1 / (1 + np.exp(-margin))
    clean = np.logaddexp(0, margin)  # the loss of the answer "clean"
    slope = np.concatenate([-prior * chance[:n_pos] / n_pos, chance[n_pos:] / n_rest])
    if clean[n_pos:].mean() - prior * clean[:n_pos].mean() < 0:
        return -slope
    slope[:n_pos] += prior * (chance[:n_pos] - 1) / n_pos
    return slope


def fit_rows(words: list[bytes], positive: Texts, unlabelled: Texts, prior: float, vocabulary: int = VOCABULARY,
             least_texts: int = LEAST_TEXTS, classifiers: int = CLASSIFIERS, steps: int = STEPS) -> Classifier:
    """Fit the classifiers; the numbers of the texts are places in ``words``."""
    prior = float(np.clip(prior, 1e-3, 0.9))
    rest = np.full(classifiers, np.log(prior / (1 - prior)))
    n_pos, n_all = len(positive.sizes), len(positive.sizes) + len(unlabelled.sizes)
    if not n_pos or n_pos == n_all:
        return Classifier([], np.zeros((classifiers, 0)), rest)
    # Words are ranked by how far their share among positives is from that among the others.
    counts = [np.bincount(t.flat, minlength=len(words)) for t in (positive, unlabelled)]
    p, u = counts[0] / n_pos, counts[1] / (n_all - n_pos)
    far = np.abs(p - u) / np.sqrt(p * (1 - p) / n_pos + u * (1 - u) / (n_all - n_pos) + 1e-9)
    far[counts[0] + counts[1] < least_texts] = 0
    chosen = np.argsort(-far, kind="stable")[:vocabulary]
    chosen = chosen[far[chosen] >= DIFFERENCE]
    place = np.full(len(words), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    words, width = [words[i] for i in chosen.tolist()], len(chosen)
    sides = []
    for texts, offset in ((positive, 0), (unlabelled, n_pos)):
        numbers = place[texts.flat]
        sides.append((numbers[numbers >= 0], texts.of()[numbers >= 0] + offset))
    every_col, every_of = (np.concatenate(x) for x in zip(*sides, strict=True))

    all_weights, all_bias = np.zeros((classifiers, width)), rest.copy()
    for number in range(classifiers):
        rng = np.random.default_rng([SEED, number])
        seen = rng.random(n_all) < SHARE
        seen[:n_pos] = True
        if seen.sum() == n_pos:
            seen[:] = True
        inside = seen[every_of]
        cols, of, rows = every_col[inside], (np.cumsum(seen) - 1)[every_of[inside]], int(seen.sum())
        weights, bias = rng.normal(0, 0.01, width), rest[number]
        first, second = np.zeros(width + 1), np.zeros(width + 1)
        for step in range(1, steps + 1):
            slope = risk_slope(np.bincount(of, weights[cols], rows) + bias, n_pos, prior)
            gradient = np.append(np.bincount(cols, slope[of], width), slope.sum())
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            change = STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            weights, bias = weights - change[:-1], bias - change[-1]
        all_weights[number], all_bias[number] = weights, bias
    return Classifier(words, all_weights, all_bias)


def _sample(docs: DataFrame, labels: DataFrame, held_out: str, id_col: str, text_col: str, label_col: str,
            positives: int, unlabelled: int) -> tuple[list[bytes], Texts, Texts, float]:
    """Words, sampled texts as their numbers, and the share of toxic rows among the labelled ones."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).where(f"not ({held_out})")
    share = known.agg(F.avg("label")).first()[0]
    toxic, order = known.where("label = 1").select("id"), F.xxhash64("id", F.lit(SEED))
    some = toxic.orderBy(order, "id").limit(positives).withColumn("toxic", F.lit(True))
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").where(f"not ({held_out})").distinct()
    others = ids.orderBy(order, "id").limit(unlabelled)
    chosen = some.unionByName(others.withColumn("toxic", F.lit(False)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches):
        for batch in batches:
            found = [sorted(normal(text.as_py())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.binary()))],
                                             names=["id", "toxic", "words"])

    kind = rows.schema["id"].dataType.simpleString()
    sample = map_batches(rows.select("id", "text", "toxic"), run, f"id {kind}, toxic boolean, words array<binary>")
    sample = written(sample.groupBy("id", "toxic").agg(F.max_by("words", F.xxhash64("words")).alias("words")), "toxicity")
    many = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    p, u = (F.count_if(F.col("toxic") == side) / F.lit(many.get(side, 1)) for side in (True, False))
    counts = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(p.alias("p"), u.alias("u"), F.count("*").alias("texts"))
    spread = sum(F.col(c) * (1 - F.col(c)) / many.get(side, 1) for c, side in (("p", True), ("u", False)))
    far = (F.abs(F.col("p") - F.col("u")) / F.sqrt(spread + 1e-9)).alias("far")
    words = counts.where(F.col("texts") >= LEAST_TEXTS).select("word", far).where(F.col("far") >= DIFFERENCE)
    words = sorted(bytes(r.word) for r in words.orderBy(F.desc("far"), "word").limit(VOCABULARY).collect())
    given = docs.sparkSession.sparkContext.broadcast(words)

    def number(batches):
        known = {w: i for i, w in enumerate(given.value)}
        for batch in batches:
            rows = [np.array([known[w] for w in text if w in known], "<i4").tobytes() for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())],
                                             names=["id", "toxic", "numbers"])

    found = sorted(map_batches(sample, number, f"id {kind}, toxic boolean, numbers binary").collect(), key=lambda r: r.id)
    texts = [Texts([np.frombuffer(r.numbers, "<i4") for r in found if r.toxic is side]) for side in (True, False)]
    return words, texts[0], texts[1], PRIOR if share is None else share


def train(docs: DataFrame, labels: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    return fit_rows(*_sample(docs, labels, held_out, id_col, text_col, label_col, positives, unlabelled))


#: Rows that labels are not learned from: one third, by a checksum of the id.
HELD_OUT = "crc32(cast(id as string)) % 3 = 1"


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
           held_out: str = HELD_OUT, cutoff: float = CUTOFF) -> DataFrame:
    """Per row of ``docs``: id, held_out, score and predicted. ``held_out`` is SQL over the column ``id``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, held_out, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "text")

    def run(batches):
        for batch in batches:
            scores = np.array([model.value.score(text.as_py()) for text in batch.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= cutoff).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic", held_out: str = HELD_OUT, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs``, all columns kept, that are not predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, held_out, id_col, text_col, label_col))
    place = docs.columns.index(text_col)

    def clean(batches):
        for batch in batches:
            keep = [model.value.score(text.as_py()) < cutoff for text in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, clean, docs.schema)
