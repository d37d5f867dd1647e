"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass over the texts gives each document a narrow row of statistics, written as a table.
The trees are fitted on the driver from a bounded sample of labelled rows (``SAMPLE_ROWS``,
chosen by a hash of the id); all other work covers all rows. Fitted trees are flattened to
arrays (feature, threshold, child, value), and a batch of documents walks down a tree with
one gather per level.

Only the text decides a score. Defined results: null is the empty text and gets a score too;
labels of a document that disagree count as their least; null ids and null labels are not
learned from; without labels of both kinds every score is the share of label 1 (0.5 if there
are no labels); repeated rows get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.texts import map_batches
from logloom.session import written

#: Most labelled rows the trees are fitted on, and the cutoff of a prediction.
SAMPLE_ROWS, CUTOFF = 20_000, 0.3
#: Trees, levels of a tree, learning rate, bins of a statistic, least rows' weight in a leaf, penalty.
TREES, LEVELS, RATE, BINS, LEAST, PENALTY = 60, 4, 0.15, 64, 2.0, 1.0
SEED = 11

_SETS = {
    "symbols": b"#*$%&|<>", "exclamations": b"!?", "stops": b".,;:", "digits": b"0123456789",
    "capitals": bytes(range(65, 91)), "letters": bytes(range(97, 123)), "brackets": b"()[]{}", "slashes": b"/\\@_=",
    "spaces": b" \t", "lines": b"\n", "wide": bytes(range(128, 256)), "controls": bytes([*range(9), 11, 12, *range(14, 32), 127]),
}
STATISTICS = [*(f"{name}_share" for name in _SETS), "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word",
              "log_lines", "distinct_lines", "words_per_line", "capital_words", "stop_ends", "byte_entropy", "long_words"]
_BYTES_OF = np.zeros((256, len(_SETS)), np.float64)
for _at, _members in enumerate(_SETS.values()):
    _BYTES_OF[list(_members), _at] = 1


def describe(text: str | None) -> np.ndarray:
    """The statistics of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total, words, lines = max(len(raw), 1), raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    kinds: dict[bytes, int] = {}
    for word in words:
        kinds[word] = kinds.get(word, 0) + 1
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    shares = counts[counts > 0] / total
    return np.concatenate([counts @ _BYTES_OF / total, [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n_words, len(kinds) / n_words,
        max(kinds.values(), default=0) / n_words, np.log1p(len(lines)), len(set(lines)) / n_lines, n_words / n_lines,
        sum(map(bytes.isupper, words)) / n_words, sum(w.endswith((b".", b",")) for w in words) / n_words,
        -float(np.sum(shares * np.log(shares))), sum(len(w) > 20 for w in words) / n_words]])


class Trees:
    """Boosted trees as flat arrays; node n of a tree has the children 2n + 1 and 2n + 2."""

    def __init__(self, base: float, features: np.ndarray, cuts: np.ndarray, values: np.ndarray):
        self.base, self.features, self.cuts, self.values = base, features, cuts, values

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of statistics."""
        margin, at = np.full(len(rows), self.base), np.arange(len(rows))
        for features, cuts, values in zip(self.features, self.cuts, self.values, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(len(features).bit_length() - 1):  # all leaves are on the last level
                node = 2 * node + 1 + (rows[at, features[node]] > cuts[node])
            margin += values[node]
        return 1 / (1 + np.exp(-margin))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, levels: int = LEVELS, rate: float = RATE,
        bins: int = BINS, least: float = LEAST, penalty: float = PENALTY) -> Trees:
    """Fit trees to the logistic loss, level by level, from histograms of gradients."""
    count, width = rows.shape
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if count else 0.5
    nodes, inner = 2 ** (levels + 1) - 1, 2**levels - 1
    base = float(np.log(share / (1 - share)))
    if not count or labels.min() == labels.max():
        return Trees(base, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes)))
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], 1)
    offsets, margin = np.arange(width) * bins, np.full(count, base)
    all_features, all_cuts, all_values = [], [], []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        gradient, weight = chance - labels, np.maximum(chance * (1 - chance), 1e-9)
        features, cuts = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        node = np.zeros(count, np.int64)
        for level in range(levels):
            first, many = 2**level - 1, 2**level
            cells = ((node - first)[:, None] * (width * bins) + offsets + binned).ravel()
            g = np.bincount(cells, np.repeat(gradient, width), many * width * bins).reshape(many, width, bins).cumsum(2)
            h = np.bincount(cells, np.repeat(weight, width), many * width * bins).reshape(many, width, bins).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g**2 / (all_h + penalty)
            gain[(h < least * 0.25) | (all_h - h < least * 0.25)] = -np.inf
            best = gain.reshape(many, -1).argmax(1)
            for n in range(many):
                feature, cut = divmod(int(best[n]), bins)
                if gain[n, feature, cut] > 1e-6 and cut < len(edges[feature]):
                    features[first + n], cuts[first + n] = feature, edges[feature][cut]
            node = 2 * node + 1 + (rows[np.arange(count), features[node]] > cuts[node])
        g, h = np.bincount(node, gradient, nodes), np.bincount(node, weight, nodes)
        values = np.where(np.arange(nodes) >= inner, -rate * g / (h + penalty), 0.0)
        margin += values[node]
        all_features.append(features)
        all_cuts.append(cuts)
        all_values.append(values)
    return Trees(base, np.array(all_features), np.array(all_cuts), np.array(all_values))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) per row of ``docs``, in one pass over the texts."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            rows = [describe(text.as_py()).astype(np.float32) for text in batch.column(1)]
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.float32), pa.float32())
            stats = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=["id", "stats"])

    return map_batches(narrow, run, f"id {narrow.schema['id'].dataType.simpleString()}, stats array<float>")


def training_sample(rows: DataFrame, labels: DataFrame, held_out: str, id_col: str = "doc_id", label_col: str = "quality",
                    sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, label, stats) of at most ``sample_rows`` labelled ids outside the held-out part, chosen by a hash of the id.

    Of several rows of an id the one whose statistics have the largest hash is taken.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    known = known.where(f"not ({held_out})")
    chosen = known.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample_rows)
    return rows.join(chosen, "id").groupBy("id", "label").agg(F.max_by("stats", F.xxhash64("stats")).alias("stats"))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
           held_out: str = "crc32(cast(id as string)) % 5 = 0", sample_rows: int = SAMPLE_ROWS,
           cutoff: float = CUTOFF) -> DataFrame:
    """Per row of ``docs``: id, held_out, score and predicted. ``held_out`` is SQL over the column ``id``."""
    stats = written(described(docs, id_col, text_col), "quality")
    sample = training_sample(stats, labels, held_out, label_col=label_col, sample_rows=sample_rows).orderBy("id")
    sample = sample.select("stats", "label").toPandas()
    rows = np.array(sample["stats"].tolist(), np.float64).reshape(len(sample), len(STATISTICS))
    trees = fit(rows, sample["label"].to_numpy(np.float64))
    out = stats.select("id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "stats")

    def run(batches):
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scores = trees.score(flat.reshape(batch.num_rows, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= cutoff).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"])

    kind = stats.schema["id"].dataType.simpleString()
    return map_batches(out, run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
