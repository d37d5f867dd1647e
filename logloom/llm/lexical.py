"""Ranked lexical search: the highest-scoring documents of every query, by Block-Max MaxScore.

Terms are the runs of ASCII letters, digits and characters beyond ASCII in the whole text, A-Z in lower case. N counts the
documents with a term, L all their terms, n those of one document, df the documents that hold a term, tf its
occurrences in one. A term weighs floor(1000 ln((2N+2) / (2df+1))), a document's length counts as
m = 75 + (25 n N) div L, and the score of a document is the sum of weight * ((10^9 tf) div (1000 tf + 12 m)) over the
terms of the query, repeats included. Equal scores are ordered by id.

Index. The documents a task reads become shards of a bounded number of terms, one row each: term hashes
(64 bits) in ascending order, and for each term its documents with their tf in blocks of 128, the distances and
counts of a block in as many bytes as its largest needs. Of each block the last document and the
largest value of (10^9 tf) div (1000 tf + 12 m) are held outside of it.

Search. A task goes through its shards with one heap per query. The lists of a query's terms have an
upper bound each, their weight times their largest block maximum; the lists of smallest bounds that together stay
below the last score of the full heap are not essential. Documents of essential lists are
candidates; in the other lists, from the largest bound down, a candidate is given up as soon as its score, the maximum of the
one block that may hold it and the bounds of the lists left stay below that score, and only then are blocks decoded. The
heaps of all tasks meet in a ranking per query that each task has cut to its best rows.

Queries are dealt into blocks of about ``QUERY_BYTES`` of text; each is a file in the shared folder that
tasks load, so that neither the driver nor a task holds all queries. The index is written once and
read once for each block of queries.

Defined results: null and empty texts have no term, neither count nor are found; a query without terms has no
row; each row of the documents is one, also where ids repeat; ids are integers, null ids come last among equals;
equal rows of the queries are one query, different texts of one query id are ranked apart; other
columns are ignored; empty tables give an empty table. Building the index and the weights runs jobs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import store
from logloom.llm.texts import hash_words, kept, map_batches
from logloom.session import written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text that are not part of a term become spaces, A-Z become a-z.
_TABLE = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else 32 if b < 128 else b for b in range(256))
#: Documents of one query's result.
TOP = 20
#: Terms of a shard, beyond its last document, and documents of a block.
SHARD, BLOCK = 1 << 21, 128
#: Bytes of query texts in one block of queries.
QUERY_BYTES = 1 << 20

_INDEX = "ids binary, known binary, scale binary, terms binary, counts binary, last binary, most binary, widths binary, blocks binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """N and L of all documents."""
    n = docs.select(F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(TERM)).cast("long").alias("n"))
    row = n.agg(F.count_if(F.col("n") > 0).alias("N"), F.sum("n").alias("L")).first()
    return row.N, row.L or 0


def scales(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents with so many terms."""
    if int(lengths.max(initial=0)) * 25 * documents < 1 << 63:
        return 75 + 25 * lengths * documents // max(terms, 1)
    return np.array([75 + 25 * n * documents // terms for n in lengths.tolist()], np.int64)


def _value(tf: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * scale)


def _widths(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many bytes the numbers of each block need: none where all are 0, else 1, 2 or 4."""
    most = np.maximum.reduceat(values, starts)
    return np.where(most > 0xFFFF, 4, np.where(most > 0xFF, 2, (most > 0).astype(np.int64)))


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, widths: np.ndarray) -> None:
    for byte in range(4):
        some = widths > byte
        out[at[some] + byte] = values[some] >> 8 * byte & 0xFF


def shard(ids: list[int | None], hashes: list[np.ndarray], documents: int, terms: int) -> pa.RecordBatch:
    """The index row of some documents, from the term hashes of each."""
    lengths = np.array([len(h) for h in hashes], np.int64)
    scale = scales(lengths, documents, terms)
    every, owner = np.concatenate(hashes), np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    term = np.concatenate(([True], every[1:] != every[:-1]))
    posting = np.flatnonzero(term | np.concatenate(([True], owner[1:] != owner[:-1])))
    tf = np.diff(posting, append=len(every))
    docs = owner[posting].astype(np.int64)
    first = np.flatnonzero(term[posting])
    counts = np.diff(first, append=len(posting))
    place = np.arange(len(posting)) - np.repeat(first, counts)
    starts = np.flatnonzero(place % BLOCK == 0)
    sizes = np.diff(starts, append=len(posting))
    block = np.repeat(np.arange(len(starts)), sizes)
    gaps = np.diff(docs, prepend=0)
    gaps[starts] = docs[starts]
    wide, deep = np.maximum(_widths(gaps, starts), 1), _widths(tf - 1, starts)
    offset = np.concatenate(([0], np.cumsum(sizes * (wide + deep))))
    out = np.zeros(offset[-1], np.uint8)
    inside = np.arange(len(posting)) - starts[block]
    _put(out, offset[block] + inside * wide[block], gaps, wide[block])
    _put(out, (offset[:-1] + sizes * wide)[block] + inside * deep[block], tf - 1, deep[block])
    columns = [np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], "u1"), scale.astype("<i8"),
               every[posting[first]].astype("<u8"), counts.astype("<i4"), docs[starts + sizes - 1].astype("<i4"),
               np.maximum.reduceat(_value(tf, scale[docs]), starts).astype("<i4"), (wide << 4 | deep).astype("u1"), out]
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns],
                                      names=[c.split()[0] for c in _INDEX.split(", ")])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The index of all documents as a written table, and the number N it was made with."""
    documents, terms = statistics(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words_of(text.as_py())
                if found:
                    ids.append(i)
                    hashes.append(hash_words(found))
                    size += len(found)
                if size >= SHARD:
                    yield shard(ids, hashes, documents, terms)
                    ids, hashes, size = [], [], 0
        if ids:
            yield shard(ids, hashes, documents, terms)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(map_batches(rows, run, _INDEX), "index"), documents


class Shard:
    """An index row: lists of blocks that are decoded when they are needed, once."""

    def __init__(self, ids, known, scale, terms, counts, last, most, widths, blocks):
        self.ids, self.known, self.scale = np.frombuffer(ids, "<i8"), np.frombuffer(known, "u1"), np.frombuffer(scale, "<i8")
        self.terms, self.last, self.most = np.frombuffer(terms, "<u8"), np.frombuffer(last, "<i4"), np.frombuffer(most, "<i4")
        counts, widths = np.frombuffer(counts, "<i4").astype(np.int64), np.frombuffer(widths, "u1").astype(np.int64)
        number = -(-counts // BLOCK)
        self.start = np.concatenate(([0], np.cumsum(number)))  # first block of each term
        self.size = np.full(len(widths), BLOCK)
        self.size[self.start[1:] - 1] = counts - BLOCK * (number - 1)
        self.wide, self.deep = widths >> 4, widths & 15
        self.offset = np.concatenate(([0], np.cumsum(self.size * (self.wide + self.deep))))
        self.blocks, self.decoded = blocks, {}
        self.top = np.maximum.reduceat(self.most, self.start[:-1])

    def open(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their values."""
        if block not in self.decoded:
            size, wide, deep, at = (int(x[block]) for x in (self.size, self.wide, self.deep, self.offset))
            docs = np.cumsum(np.frombuffer(self.blocks, f"<u{wide}", size, at), dtype=np.int64)
            tf = np.ones(size, np.int64)
            if deep:
                tf += np.frombuffer(self.blocks, f"<u{deep}", size, at + size * wide)
            self.decoded[block] = docs, _value(tf, self.scale[docs])
        return self.decoded[block]

    def search(self, lists: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score over the lists reaches ``least`` (at least 1), with their scores."""
        bounds = weights * self.top[lists]
        order = np.argsort(bounds, kind="stable")
        lists, weights, below = lists[order], weights[order], np.cumsum(bounds[order])
        essential = int(np.searchsorted(below, least))
        scores = np.zeros(len(self.ids), np.int64)
        for term, weight in zip(lists[essential:].tolist(), weights[essential:].tolist(), strict=True):
            for block in range(self.start[term], self.start[term + 1]):
                docs, values = self.open(block)
                scores[docs] += weight * values
        found = np.flatnonzero(scores)
        for at in range(essential - 1, -1, -1):
            found = found[scores[found] + below[at] >= least]
            if not len(found):
                break
            term, weight, left = lists[at], weights[at], int(below[at - 1]) if at else 0
            first, after = self.start[term], self.start[term + 1]
            block = first + np.searchsorted(self.last[first:after], found)
            inside = block < after
            may = np.where(inside, self.most[np.minimum(block, after - 1)], 0)
            passed = scores[found] + weight * may + left >= least
            found, block, inside = found[passed], block[passed], inside[passed]
            for number in np.unique(block[inside]).tolist():
                docs, values = self.open(number)
                some = found[block == number]
                place = np.searchsorted(docs, some)  # its last document is not before any of them
                hit = docs[place] == some
                scores[some[hit]] += weight * values[place[hit]]
        found = found[scores[found] >= least]
        return found, scores[found]


_QUERY = np.dtype([("key", "<i8"), ("term", "<u8"), ("weight", "<i8")])


def _load(address: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a file of query terms, ordered by query, the distinct terms and for each row the place of its term in these."""

    def make():
        rows = np.frombuffer(store.read_file(address), _QUERY)
        return rows, *np.unique(rows["term"], return_inverse=True)

    return kept(("queries", address), make)


def _write(terms: DataFrame, name: str) -> list[str]:
    """Write the rows (block, key, term, weight) as one file per block; returns the addresses."""
    folder = store.new_folder(terms.sparkSession, name)

    def write(table: pa.Table) -> pa.Table:
        rows = np.empty(table.num_rows, _QUERY)
        for column in ("key", "weight"):
            rows[column] = table.column(column).to_numpy()
        rows["term"] = table.column("term").to_numpy().view(np.uint64)
        address = store.write_file(folder, "queries", np.sort(rows, order=["key", "term"]).tobytes())
        return pa.table({"block": table.column("block")[:1], "address": pa.array([address])})

    found = terms.select("block", "key", "term", "weight").groupBy("block").applyInArrow(write, "block long, address string")
    return [r.address for r in found.orderBy("block").collect()]


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(key, id) of the different queries, and (block, key, term, times) of their terms, written."""
    rows = queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "queries")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / QUERY_BYTES))

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                term, times = np.unique(hash_words(words_of(text)), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(term), key), pa.int64()), pa.array(term.view(np.int64)), pa.array(times.astype(np.int64))],
                    names=["key", "term", "times"])

    terms = map_batches(rows.select("key", "text"), run, "key long, term long, times long")
    return rows.select("key", "id"), written(terms.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))), "terms")


def _frequencies(index: DataFrame, addresses: list[str]) -> DataFrame:
    """(term, df) of the terms in the files, in which each is once."""

    def run(batches):
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms, counts = np.frombuffer(terms, "<u8"), np.frombuffer(counts, "<i4")
                for address in addresses:
                    wanted = _load(address)[1]
                    place = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                    hit = terms[place] == wanted
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(wanted[hit].view(np.int64)), pa.array(counts[place[hit]].astype(np.int64))], names=["term", "df"])

    found = map_batches(index.select("terms", "counts"), run, "term long, df long")
    return found.groupBy("term").agg(F.sum("df").alias("df"))


def search(index: DataFrame, documents: int, queries: DataFrame, id_col: str = "item_id", text_col: str = "text",
           top: int = TOP) -> DataFrame:
    """(id, key, rank, doc_id, score): the ``top`` highest-scoring documents of every query, scores above 0 only."""
    keys, terms = query_terms(queries, id_col, text_col)
    blocks = terms.agg(F.max("block")).first()[0] or 0
    wanted = terms.select("term").distinct().select(F.pmod(F.xxhash64("term"), F.lit(blocks + 1)).alias("block"), F.lit(0).alias("key"), "term", F.lit(0).alias("weight"))
    df = _frequencies(index, _write(wanted, "wanted"))
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1)))
    weighted = terms.join(df, "term").withColumn("weight", (weight * F.col("times")).cast("long")).where("weight > 0")
    found = None
    for address in _write(weighted, "weights"):
        part = _searched(index, address, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.sparkSession.createDataFrame([], _HEAP)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(keys, "key").select("id", "key", "rank", "doc_id", "score")


_HEAP = "key long, doc_id long, score long"


def _searched(index: DataFrame, address: str, top: int) -> DataFrame:
    """The best documents of each query of a block in each task's part of the index."""

    def run(batches):
        rows, wanted, place = _load(address)
        cuts = np.flatnonzero(np.diff(rows["key"], prepend=-1)).tolist() + [len(rows)]
        heaps: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                part = Shard(*(c[row].as_buffer() for c in batch.columns))
                at = np.minimum(np.searchsorted(part.terms, wanted), len(part.terms) - 1)
                at = np.where(part.terms[at] == wanted, at, -1)[place]
                for query, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    here = at[a:b] >= 0
                    if not here.any():
                        continue
                    heap = heaps.get(query)
                    least = int(heap[0][-1]) if heap and len(heap[0]) == top else 1
                    docs, scores = part.search(at[a:b][here], rows["weight"][a:b][here], least)
                    if len(docs):
                        fresh = scores, part.known[docs], part.ids[docs]
                        scores, known, ids = map(np.concatenate, zip(heap, fresh, strict=True)) if heap else fresh
                        best = np.lexsort((ids, known == 0, -scores))[:top]
                        heaps[query] = scores[best], known[best], ids[best]
        for query, (scores, known, ids) in heaps.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), rows["key"][cuts[query]]), pa.int64()),
                 pa.array(ids, pa.int64(), mask=known == 0), pa.array(scores, pa.int64())], names=["key", "doc_id", "score"])

    return map_batches(index, run, _HEAP)


def ranked(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) over ``documents`` (doc_id, text) and items (item_id, text)."""
    index, documents = build(docs)
    found = search(index, documents, queries, top=top)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select(F.col("id").alias("item_id"), F.col("rank").cast("int"), F.col("doc_id").cast(kind), "score")
