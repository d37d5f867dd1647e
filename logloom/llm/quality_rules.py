"""Quality rules whose cutoffs are chosen under a limit on false rejections.

The statistics of a text are DataFrame expressions. For each rule a fixed list of cutoffs is
tried on a labelled holdout, apart for each stratum: a cutoff is safe when the number of good
documents it rejects is so low that a rate above the limit would show it, or less, with a
probability of at most ``DELTA`` divided by the number of strata and rules (exact binomial tail,
Bonferroni). The cutoffs of one rule are nested, so they are tested in a fixed sequence from
the loosest on, each at that same level, until one fails: a stricter cutoff rejects all that a
looser one does. The strictest safe cutoff is taken; where none is safe the rule stays unused.
The limit of a stratum is shared among the rules, so with confidence 1 - DELTA no stratum
rejects more than ``LIMIT`` of its good documents by these rules.

Everything runs as DataFrame operations. The statistics are written once, as a narrow table;
labels meet them by document id; what is broadcast, if Spark so decides, is one row per
stratum. Holdout counts are sums over all labelled rows; nothing is sampled.

Defined results: a null or wordless text has no words and fails the base rule; labels of a
document that disagree count as their least quality; documents without a label, with a null
id or in a stratum without labels are judged too, the latter by the base rule only; a null
stratum is a stratum of its own; repeated rows are judged alike. Windows of a text are compared
by 64-bit hashes. Arrays of a text's words are held in memory, one text at a time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import written

#: Good documents that the rules of a stratum may reject, and the chance that they reject more.
LIMIT, DELTA = 0.03, 0.05
#: Fixed base rule: least words, most repeated words in a hundred, words of a window.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
#: Cutoffs tried for each rule, strictest first; a statistic above the cutoff rejects.
CUTOFFS = {
    "symbol_share": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "capital_share": [0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "exclamation_share": [0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3],
    "line_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5],
    "repeat_share": [0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25],
    "word_length": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
    "few_words": [-100.0, -80.0, -60.0, -50.0, -40.0, -35.0, -30.0, -25.0],
}

_SPACE = "[\\x20\\x09-\\x0d]+"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, counts and shares) per row of ``docs``.

    Arrays that a later step reads element by element are columns of an earlier step and
    are used there more than once, so that they are computed once per text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"))
    rows = rows.withColumns({
        "words": F.filter(F.split("text", _SPACE), lambda w: w != ""),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0d]")),
    })
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.expr(r"regexp_count(text, '[#*$%&|<>]')").cast("long"),
        "n_capitals": F.expr(r"regexp_count(text, '\\p{Lu}')").cast("long"),
        "n_exclamations": (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("!"), F.lit("")))).cast("long"),
        "windows": F.when(F.size("words") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))),
    }).drop("text", "words", "lines")
    # Most texts repeat nothing; only the others are sorted.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(repeats, F.sort_array(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = F.zip_with(F.slice("sorted", 1, F.size("sorted") - 1), F.slice("sorted", 2, F.size("sorted") - 1),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("places", F.sort_array(F.array_distinct(F.flatten(F.array_compact(near)))))
    gaps = F.zip_with(F.slice("places", 1, F.size("places") - 1), F.slice("places", 2, F.size("places") - 1),
                      lambda a, b: F.least(b - a, F.lit(WINDOW)))
    rows = rows.withColumn("n_repeat_words", F.when(
        F.size("places") > 0, F.lit(WINDOW) + F.aggregate(gaps, F.lit(0), lambda n, x: n + x)).otherwise(0).cast("long"))

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return rows.select(
        "id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_exclamations", "word_chars").alias("exclamation_share"),
        share("n_dup_lines", "n_lines").alias("line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("word_length"),
        (-F.col("n_words")).cast("double").alias("few_words"),
    )


def binomial_tail(rejected: Column, good: Column, rate: float) -> Column:
    """P(X <= rejected) for X binomial with ``good`` trials of ``rate``, summed in logarithms."""
    step = math.log(rate) - math.log1p(-rate)
    start = F.struct((good * math.log1p(-rate)).alias("term"), F.lit(0.0).alias("top"), F.lit(0.0).alias("sum"))
    begin = F.struct(start["term"].alias("term"), start["term"].alias("top"), F.lit(1.0).alias("sum"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((good - i + 1) / i) + step
        top = F.greatest(term, state["top"])
        return F.struct(term.alias("term"), top.alias("top"),
                        (state["sum"] * F.exp(state["top"] - top) + F.exp(term - top)).alias("sum"))

    steps = F.when(rejected > 0, F.sequence(F.lit(1), rejected.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.least(F.aggregate(steps, begin, add, lambda s: F.exp(s["top"] + F.log(s["sum"]))), F.lit(1.0))


def thresholds(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
               limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, good, rejected): the strictest safe cutoff of each rule."""
    good = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg(F.min(label_col).alias("quality")).where("quality = 1").select("id")
    held = stats.where("not base_failed").join(good, "id").select("stratum", *CUTOFFS)
    # How many cutoffs each statistic exceeds; one row per document and rule, counted map-side.
    passed = [F.struct(F.lit(rule).alias("rule"), sum(
        (F.when(F.col(rule) > c, 1).otherwise(0) for c in cutoffs), F.lit(0)).alias("passed")) for rule, cutoffs in CUTOFFS.items()]
    counts = held.select("stratum", F.explode(F.array(*passed)).alias("p")).groupBy("stratum", "p.rule", "p.passed").agg(
        F.count("*").alias("n"))
    tried = held.sparkSession.createDataFrame(
        [(rule, at, float(cutoff)) for rule, cutoffs in CUTOFFS.items() for at, cutoff in enumerate(cutoffs)],
        "tried_rule string, place int, cutoff double")
    tests = counts.join(tried, F.col("rule") == F.col("tried_rule")).groupBy("stratum", "rule", "place", "cutoff").agg(
        F.sum("n").alias("good"), F.sum(F.when(F.col("passed") > F.col("place"), F.col("n")).otherwise(0)).alias("rejected"))
    made = max(1, counts.select("stratum").distinct().count()) * len(CUTOFFS)
    tail = binomial_tail(F.col("rejected"), F.col("good"), limit / len(CUTOFFS))
    safe = tests.where((F.col("rejected") <= F.col("good") * (limit / len(CUTOFFS))) & (tail <= delta / made))
    # rejections only grow with strictness, so every cutoff looser than a safe one is safe as well
    best = F.min_by(F.struct("cutoff", "good", "rejected"), "place")
    return safe.groupBy("stratum", "rule").agg(best.alias("b")).select("stratum", "rule", "b.*")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
           label_col: str = "quality", limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """Per row of ``docs``: id, the base statistics, base_failed and kept."""
    stats = written(statistics(docs, id_col, text_col, stratum_col), "statistics")
    chosen = thresholds(stats, labels, "doc_id", label_col, limit, delta)
    limits = chosen.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"most_{rule}") for rule in CUTOFFS])
    limits = limits.withColumnRenamed("stratum", "of")
    joined = stats.join(limits, F.col("stratum").eqNullSafe(F.col("of")), "left")
    rejected = F.lit(False)
    for rule in CUTOFFS:
        rejected = rejected | F.coalesce(F.col(rule) > F.col(f"most_{rule}"), F.lit(False))
    return joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
