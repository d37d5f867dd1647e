"""Substring deduplication with a count-min sketch before exact grouping.

1. Every task sketches the windows of its texts: each window of 13 words is hashed to one cell
   in each of ``DEPTH`` rows of counters. A task sends its cells sorted, by slices of the
   sketch; the slices of all tasks are merged by streaming, one slice in memory at a time. A
   window's estimate, the least of its counters, is never below the documents it occurs in.
2. A second pass takes only windows estimated to occur twice or more. A task settles at once
   what it sees itself: of the documents in one of its stretches that share a window all but the
   smallest are hit, so a passage that very many documents share costs each stretch one row, not
   one for each document. The smallest one's windows are sent, with a 96-bit hash, to buckets
   whose number follows the counted windows, and are grouped exactly there.
3. The hits of a document go back to its text and the words they cover are removed.

The sketch is what is broadcast. Its size is fixed by ``LOG2_WIDTH`` and ``DEPTH`` (64 MB for the
defaults) whatever the input; on inputs far above its cells more windows pass it and are
grouped exactly, nothing is lost. Raise LOG2_WIDTH with the corpus.

Defined results: null is a text without words; texts of fewer than 13 words lose none; rows
with null ids neither lose words nor make others lose them; of rows with equal id none is
smaller than the other; an empty table gives an empty table; texts of any length are whole.
Ids are integers.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.texts import U64, distinct, hash_words, kept, map_batches, mixed, pack, place_names, unpack, window_hashes

WINDOW = 13
#: Counters of one row of the sketch (as a power of two), rows, and counters of one slice.
LOG2_WIDTH, DEPTH, LOG2_SLICE = 28, 2, 22
#: Windows a task gathers before it sends them on.
GATHER = 1 << 22
#: Windows that meet in one bucket of the exact grouping.
BUCKET = 1 << 21


def _windows(text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    words = hash_words(text.encode("utf-8", "surrogatepass").split())
    return words, window_hashes(words, width, 1)


def _cells(windows: np.ndarray, row: int, log2_width: int) -> np.ndarray:
    return (windows >> U64(row * (64 - log2_width) if row else 0)) & U64((1 << log2_width) - 1)


def _sketches(docs: DataFrame, width: int, log2_width: int) -> DataFrame:
    """(slice, cells) from every task: the sorted cells of its windows, as packed differences."""
    log2_slice = min(LOG2_SLICE, log2_width)
    per_row = 1 << (log2_width - log2_slice)

    def send(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        windows = np.concatenate(gathered)
        for row in range(DEPTH):
            cells = np.sort(_cells(windows, row, log2_width).astype(np.uint32))
            numbers, blobs = [], []
            edges = np.searchsorted(cells, np.arange(per_row + 1, dtype=np.uint64) << U64(log2_slice))
            for number in np.flatnonzero(np.diff(edges)).tolist():
                part = cells[edges[number]:edges[number + 1]] - np.uint32(number << log2_slice)
                numbers.append(row * per_row + number)
                blobs.append(pack(np.diff(part, prepend=np.uint32(0)), "<u4"))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())],
                                             names=["slice", "cells"])

    def run(batches):
        gathered, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                windows = distinct(_windows(text.as_py(), width)[1])
                if len(windows):
                    gathered.append(windows)
                    size += len(windows)
                if size >= GATHER:
                    yield from send(gathered)
                    gathered, size = [], 0
        if size:
            yield from send(gathered)

    return map_batches(docs.select("text"), run, "slice int, cells binary")


def _merged(sketches: DataFrame, log2_width: int) -> DataFrame:
    """Per slice: a bitmap of the counters of two or more, and what these sum to."""
    size = 1 << min(LOG2_SLICE, log2_width)

    def settle(number: int, counts: np.ndarray) -> pa.RecordBatch:
        bits = np.packbits(counts >= 2, bitorder="little")
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([pack(bits, "u1")], pa.binary()),
             pa.array([int(counts[counts >= 2].sum(dtype=np.int64))], pa.int64())], names=["slice", "bits", "total"])

    def run(batches):
        number, counts = None, None
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != number:
                    if number is not None:
                        yield settle(number, counts)
                    number, counts = at, np.zeros(size, np.uint32)
                cells = np.cumsum(unpack(blob.as_py(), "<u4"), dtype=np.uint32)
                firsts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
                counts[cells[firsts]] += np.diff(firsts, append=len(cells)).astype(np.uint32)
        if number is not None:
            yield settle(number, counts)

    slices = DEPTH << (log2_width - min(LOG2_SLICE, log2_width))
    dealt = sketches.repartition(min(slices, int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))),
                                 "slice").sortWithinPartitions("slice")
    return map_batches(dealt, run, "slice int, bits binary, total long")


class Estimate:
    """Which windows are estimated to occur in two documents or more."""

    def __init__(self, rows: list[tuple], log2_width: int):
        self.log2_width = log2_width
        log2_slice = min(LOG2_SLICE, log2_width)
        per_row, size = 1 << (log2_width - log2_slice), 1 << log2_slice
        self.bits = np.zeros((DEPTH, (1 << log2_width) // 8), np.uint8)
        for number, bits in rows:
            row, at = divmod(number, per_row)
            self.bits[row, at * size // 8:(at + 1) * size // 8] = unpack(bits, "u1")

    def repeated(self, windows: np.ndarray) -> np.ndarray:
        found = np.ones(len(windows), bool)
        for row in range(DEPTH):
            cells = _cells(windows, row, self.log2_width)
            found &= (self.bits[row, cells >> U64(3)] >> (cells & U64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def _estimate(shared) -> Estimate:
    name, rows, log2_width = shared.value
    return kept(("sketch", name), lambda: Estimate(rows, log2_width))


_KINDS = ("<u8", "<u4", "<i8", "<i4", "<i4")
_NAMES = ("w", "v", "id", "key", "place")
_CANDIDATES = "bucket int, open boolean, " + ", ".join(f"{name} binary" for name in _NAMES)


def _settled(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The given columns, sorted in place by window and document, and which rows a smaller document precedes."""
    order = np.lexsort((columns[2], columns[1], columns[0]))
    for at in range(len(columns)):
        columns[at] = columns[at][order]  # one by one, so that few are held twice
    w, v, ids = columns[:3]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])))
    return columns, ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]


def _candidates(docs: DataFrame, shared, width: int, buckets: int) -> DataFrame:
    """Windows estimated to be repeated, packed by bucket: open ones, and hits already known."""

    def send(gathered: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns, known = _settled([np.concatenate(c) for c in zip(*gathered, strict=True)])
        # Open windows meet by window; known hits are dealt by document, so that no bucket gathers one passage's.
        deal = np.where(known, mixed(columns[2].view(np.uint64)), columns[0])
        group = ((deal >> U64(20)) % U64(buckets)).astype(np.int64) * 2 + ~known
        order = np.argsort(group, kind="stable")
        group, columns = group[order], [c[order] for c in columns]
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        blobs = [pa.array([pack(c[a:b], kind) if name not in "wv" or group[a] % 2 else None for a, b in spans], pa.binary())
                 for c, kind, name in zip(columns, _KINDS, _NAMES, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(group[a]) // 2 for a, _ in spans], pa.int32()),
             pa.array([bool(group[a] % 2) for a, _ in spans], pa.bool_()), *blobs], names=["bucket", "open", *_NAMES])

    def run(batches):
        estimate, gathered, size = _estimate(shared), [], 0
        for batch in batches:
            for i, key, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                words, windows = _windows(text, width)
                places = np.flatnonzero(estimate.repeated(windows))
                if not len(places):
                    continue
                second = window_hashes(words, width, 2)[places].astype(np.uint32)
                gathered.append((windows[places], second, np.full(len(places), i, np.int64),
                                 np.full(len(places), key, np.int32), places.astype(np.int32)))
                size += len(places)
                if size >= GATHER // 4:
                    yield from send(gathered)
                    gathered, size = [], 0
        if size:
            yield from send(gathered)

    return map_batches(docs.select("id", "key", "text"), run, _CANDIDATES)


def _blobs(columns: list[np.ndarray], group: np.ndarray, first: str) -> pa.Table:
    """The columns (id, key, place) packed by ``group``."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else [0]
    spans = list(zip(cuts, cuts[1:], strict=False))
    blobs = {first: pa.array(group[cuts[:-1]], pa.int32())}
    for at, (name, kind) in enumerate(zip(_NAMES[2:], _KINDS[2:], strict=True)):
        columns[at] = columns[at][order]
        blobs[name] = pa.array([pack(columns[at][a:b], kind) for a, b in spans], pa.binary())
    return pa.table(blobs)


def _columns(table: pa.Table, first: int, rows: np.ndarray | None = None) -> list[np.ndarray]:
    """The columns from ``first`` on, unpacked; of those rows only where they are given."""
    rows = range(table.num_rows) if rows is None else rows.tolist()

    def column(name: str, kind: str) -> np.ndarray:
        blobs = table.column(name)
        return np.concatenate([np.empty(0, kind), *(unpack(blobs[at].as_py(), kind) for at in rows)])

    return [column(name, kind) for name, kind in zip(_NAMES[first:], _KINDS[first:], strict=True)]


def _by_document(table: pa.Table) -> pa.Table:
    """The hits of a group of documents, one row for each document."""
    ids, keys, places = _columns(table, 2)
    order = np.lexsort((places, keys, ids))
    ids, keys, places = ids[order], keys[order], places[order].astype("<i4")
    new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))))
    cuts = [*new.tolist(), len(ids)]
    return pa.table({"id": pa.array(ids[new], pa.int64()), "key": pa.array(keys[new], pa.int32()),
                     "places": pa.array([places[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})


def hits(docs: DataFrame, window: int = WINDOW, log2_width: int = LOG2_WIDTH, bucket: int = BUCKET) -> DataFrame:
    """(id, key, places): starts of windows that also start in a document of smaller id.

    ``docs`` has id, key and text; the key tells apart texts that share an id. A document
    with hits has one row.
    """
    texts = docs.where("text is not null and id is not null")
    rows = _merged(_sketches(texts, window, log2_width), log2_width).collect()
    per_row = 1 << (log2_width - min(LOG2_SLICE, log2_width))
    totals = [sum(r.total for r in rows if r.slice // per_row == row) for row in range(DEPTH)]
    shared = docs.sparkSession.sparkContext.broadcast(
        (uuid.uuid4().hex, [(r.slice, r.bits) for r in rows], log2_width))
    groups = max(1, -(-min(totals) // bucket))

    def late(table: pa.Table) -> pa.Table:
        """The hits of one bucket, packed by groups of documents."""
        kept(("grouping",), lambda: None)  # the sketch has no reader any more, so its memory goes
        waits = table.column("open").to_numpy()
        columns = _columns(table, 2, np.flatnonzero(~waits))
        if waits.any():
            sent, hit = _settled(_columns(table, 0, np.flatnonzero(waits)))
            del sent[:2]
            columns = [np.concatenate([a, sent.pop(0)[hit]]) for a in columns]
        return _blobs(columns, (mixed(columns[0].view(np.uint64)) % U64(groups)).astype(np.int32), "part")

    found = _candidates(texts, shared, window, groups).groupBy("bucket").applyInArrow(
        late, "part int, id binary, key binary, place binary")
    return found.groupBy("part").applyInArrow(_by_document, "id long, key int, places binary")


def _with_places(docs: DataFrame, id_col: str, text_col: str, **sizes) -> tuple[DataFrame, int, int]:
    """The rows of ``docs`` by place names, each with ``places``: the packed starts of its hits."""
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    rows = place_names(docs).withColumns({
        "id": F.col(f"c{at_id}").cast("long"), "key": F.hash(f"c{at_text}")})
    found = hits(rows.select("id", "key", F.col(f"c{at_text}").alias("text")), **sizes)
    return rows.join(found, ["id", "key"], "left"), at_id, at_text


def _removed(places: bytes | None, n_words: int, width: int) -> np.ndarray:
    gone = np.zeros(n_words, bool)
    if places:
        edges = np.zeros(n_words + 1, np.int32)
        starts = distinct(np.frombuffer(places, "<i4"))
        edges[starts] += 1
        np.subtract.at(edges, starts + width, 1)
        gone = np.cumsum(edges[:-1]) > 0
    return gone


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
            **sizes) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_removed and kept_sha256 of the kept words joined by spaces."""
    joined, at_id, at_text = _with_places(docs, id_col, text_col, window=window, **sizes)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes, removed, sums = [], [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                gone = _removed(places, len(words), window)
                sizes.append(len(words))
                removed.append(int(gone.sum()))
                sums.append(hashlib.sha256(b" ".join(compress(words, (~gone).tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())],
                names=[id_col, "n_words", "n_removed", "kept_sha256"])

    return map_batches(joined.select(f"c{at_id}", f"c{at_text}", "places"), run,
                       f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")


_WORD = re.compile(rb"[^\x20\x09-\x0d]+[\x20\x09-\x0d]*")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 **sizes) -> DataFrame:
    """All rows and columns of ``docs``; the words removed are cut out of the text with the space after them."""
    joined, _, at_text = _with_places(docs, id_col, text_col, window=window, **sizes)
    out_names = docs.columns
    names = [f"c{i}" for i in range(len(out_names))]

    def run(batches):
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            for at, places in enumerate(batch.column(len(names)).to_pylist()):
                if places:
                    raw = texts[at].encode("utf-8", "surrogatepass")
                    lead = len(raw) - len(raw.lstrip())
                    parts = _WORD.findall(raw)
                    gone = _removed(places, len(parts), window)
                    texts[at] = (raw[:lead] + b"".join(compress(parts, (~gone).tolist()))).decode("utf-8", "surrogatepass")
            columns = [batch.column(i) for i in range(len(names))]
            columns[at_text] = pa.array(texts, columns[at_text].type)
            yield pa.RecordBatch.from_arrays(columns, names=out_names)

    return map_batches(joined.select(*names, "places"), run, docs.schema)
