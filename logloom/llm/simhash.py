"""SimHash fingerprints of whole texts, and all fingerprints within a Hamming radius of each other.

Terms. The words of a text are the runs of characters other than ASCII white space, in lower case. A
term is a word with the word that follows it (the last word of a text is one by itself), its weight is
the number of its occurrences. The 64-bit hash of a term votes with its weight on each bit, for it where
the hash has the bit and against it where not; a bit of the fingerprint is set if more than half of the
votes are for it. Votes are counted in lanes of packed numbers: runs of 127 terms in eight numbers of
eight 8-bit lanes, their sums in 32 numbers of two 32-bit lanes, all inside the row, without a shuffle.

Permuted block tables. Two fingerprints that differ in at most ``radius`` bits agree in ``blocks - radius``
of ``blocks`` blocks, whichever bits differ. There is a table for each choice of that many blocks, in
which the chosen blocks are the key; fingerprints that meet in a table are compared in all bits. A pair
belongs to the first table in which it meets, so that it comes out once. Equal fingerprints are one
row of the tables. Six blocks and radius 3 are 20 tables with keys of 31 to 34 bits.

Everything is DataFrame functions. Texts cross the network once for the rows, and the heads that the row before needs, at
most a third of it, once more. Defined results: a null text is empty; a text without
words has the fingerprint 0; equal texts have equal fingerprints; each row is fingerprinted, repeated rows
and rows of null id included; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import written

#: Words are separated by these characters.
SPACE = r"[\x20\x09-\x0D]+"
BITS = 64
#: Fingerprints that differ in at most so many bits are near; blocks of the tables that find them.
RADIUS, BLOCKS = 3, 6
#: Terms whose votes fit an 8-bit lane, the uppermost, which has the sign, included.
_RUN = 127
_BYTES, _HALVES, _LOW = 0x0101010101010101, 0x000000FF000000FF, 0xFFFFFFFF


def _struct(values: list[Column]) -> Column:
    return F.struct(*[v.cast("long").alias(f"v{i}") for i, v in enumerate(values)])


def _votes(run: Column) -> Column:
    """Eight numbers of eight lanes: lane k of number j counts the hashes of ``run`` that have bit 8k + j."""
    return F.aggregate(run, _struct([F.lit(0)] * 8), lambda seen, term: _struct(
        [seen[f"v{j}"] + F.shiftrightunsigned(term, j).bitwiseAND(F.lit(_BYTES)) for j in range(8)]))


def _summed(runs: Column) -> Column:
    """32 numbers of two lanes: number 4j + k counts bit 8k + j, and bit 8k + j + 32 in its upper half."""
    return F.aggregate(runs, _struct([F.lit(0)] * 32), lambda seen, votes: _struct(
        [seen[f"v{4 * j + k}"] + F.shiftrightunsigned(votes[f"v{j}"], 8 * k).bitwiseAND(F.lit(_HALVES))
         for j in range(8) for k in range(4)]))


def _signed(bit: int) -> int:
    """The long that has this bit alone."""
    return (1 << bit) - (1 << BITS if bit == BITS - 1 else 0)


def fingerprinted(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of its column ``text`` as a long column ``name``."""
    words, terms, votes = (f"__{name}_{x}" for x in ("words", "terms", "votes"))
    df = df.withColumn(words, F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), ""))
    df = df.withColumn(terms, F.zip_with(words, F.slice(words, 2, F.size(words)), lambda one, two: F.xxhash64(one, two)))
    runs = F.sequence(F.lit(0), F.expr(f"greatest(size(`{terms}`) - 1, 0) div {_RUN}").cast("int"))
    df = df.withColumn(votes, _summed(F.transform(runs, lambda at: _votes(F.slice(terms, at * _RUN + 1, F.lit(_RUN))))))
    bits = []
    for j, k, half in itertools.product(range(8), range(4), range(2)):
        lane = F.shiftrightunsigned(F.col(f"{votes}.v{4 * j + k}"), 32 * half).bitwiseAND(F.lit(_LOW))
        bits.append(F.when(lane * 2 > F.size(terms), F.lit(_signed(8 * k + j + 32 * half))).otherwise(F.lit(0).cast("long")))
    return df.withColumn(name, functools.reduce(Column.bitwiseOR, bits)).drop(words, terms, votes)


def hexed(fingerprint: str) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")


def likeness(one: str, two: str) -> Column:
    """The share of bits in which two fingerprints agree."""
    return F.lit(1.0) - F.bit_count(F.col(one).bitwiseXOR(F.col(two))) / F.lit(float(BITS))


def tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The mask of each table: the bits of the blocks that are its key, as a long."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError(f"no block tables for radius {radius} and {blocks} blocks")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [(1 << high) - (1 << low) for low, high in itertools.pairwise(cuts)]
    keys = [functools.reduce(operator.or_, some) for some in itertools.combinations(masks, blocks - radius)]
    return [key - (1 << BITS) if key >> BITS - 1 else key for key in keys]


def near(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints of the column ``fingerprint`` within the radius, each once.

    Fingerprints within radius 3 of one are at most 43,744, whatever the corpus; in a table a
    fingerprint is compared with those of its key. Both sides of the join are dealt out
    by table and key, so that adaptive execution can split a frequent key.
    """
    masks = tables(radius, blocks)
    value = F.col("fingerprint")
    rows = F.array(*[F.struct(F.lit(t).alias("t"), value.bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    rows = fingerprints.select("fingerprint").distinct().select(F.col("fingerprint").alias("a"), F.inline(rows))
    other = rows.select("t", "key", F.col("a").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)])
    return rows.join(other, ["t", "key"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & (first == F.col("t"))).select("a", "b")


def _givers(rows: DataFrame) -> DataFrame:
    """(id, tie, to, chars): the id in whose row the text of ``id`` goes on, and the characters that may take.

    ``rows`` has id, tie and chars. In descending order of id (null last) each id goes to the one before it,
    the first to the last. Of several texts of an id the one with the largest tie gives. Ids are
    dealt out by range; only one row a range meets the neighbouring ranges.
    """
    spark = rows.sparkSession
    per_id = rows.groupBy("id").agg(F.max("tie").alias("tie"), F.max("chars").alias("chars"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(per_id.repartitionByRange(ranges, "id").withColumn("part", F.spark_partition_id()), "ranges")
    at = F.struct("id", "chars")
    heads = placed.groupBy("part").agg(F.min(at).alias("head"))
    order = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = placed.withColumn("next", F.lead(at).over(Window.partitionBy("part").orderBy("id")))
    found = inside.join(heads, "part").withColumn("to", F.coalesce("next", "after"))
    return found.select("id", "tie", F.col("to.id").alias("to"), F.col("to.chars").alias("chars"))


def edited(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row of ``docs``: id, n_chars, edited_sha256 and the fingerprints own, changed and after.

    ``changed`` is that of the edited text: the last third of the characters (rounded down) replaced by
    the first as many, or all, of the next document in descending order of id. ``after`` is that of the next
    document. Rows of one id all have the same next document; it is the text of largest hash if its id has several.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie, chars = F.xxhash64("text"), F.char_length("text")
    givers = _givers(rows.select("id", tie.alias("tie"), chars.alias("chars")))
    own = fingerprinted(rows, "text", "own")
    gives = own.join(givers.toDF("giver", "tie", "to", "chars"), own["id"].eqNullSafe(F.col("giver")))
    # not a key of the join: texts are dealt out by id alone, for this join and the next
    gives = gives.where(tie.bitwiseXOR(F.col("tie")) == 0)
    # the text that goes on is cut to the third of the longest row of the id it goes to
    head = F.substring("text", F.lit(1), F.expr("chars div 3").cast("int"))
    gives = gives.select("to", F.struct(head.alias("head"), F.col("own").alias("after")).alias("gift"))
    gives = gives.groupBy("to").agg(F.max("gift").alias("gift")).select("to", "gift.head", "gift.after")
    taken = own.join(gives, own["id"].eqNullSafe(F.col("to")), "left")
    taken = taken.withColumn("n", F.char_length("text")).withColumn("cut", F.expr("cast(n div 3 as int)"))
    text = F.concat(F.substring("text", F.lit(1), (F.col("n") - F.col("cut")).cast("int")),
                    F.substring("head", F.lit(1), F.col("cut")))
    taken = fingerprinted(taken.withColumn("edit", text), "edit", "changed")
    return taken.select("id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
                        "own", "changed", "after")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Per row of ``docs``: fingerprints of its text and of its edited text, their likeness, and what is near.

    ``class_id`` is the smallest id with the same fingerprint (null if there is none that is not null),
    ``n_near`` the number of other rows whose fingerprint is within the radius. Both
    come from pairs of different fingerprints; rows that share one are never paired.
    """
    rows = written(edited(docs, id_col, text_col), "fingerprints")
    classes = written(rows.groupBy(F.col("own").alias("fingerprint")).agg(
        F.min("id").alias("class_id"), F.count("*").alias("n")), "classes")
    pairs = near(classes, radius, blocks)
    both = pairs.union(pairs.select("b", "a")).toDF("a", "b")
    others = both.join(classes.select(F.col("fingerprint").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    classes = written(classes.join(others, F.col("fingerprint") == F.col("a"), "left").select(
        F.col("fingerprint").alias("own"), "class_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near")), "near")
    return rows.join(classes, "own").select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", hexed("own").alias("fingerprint"),
        hexed("changed").alias("edited_fingerprint"), likeness("own", "changed").alias("near_edited"),
        likeness("own", "after").alias("near_next"), "class_id", "n_near")
