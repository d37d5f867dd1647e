"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits. The low chunks of all ids stand in level 0; a bitmap
says which ids go on, and their next chunks stand in level 1 in the same order, and so on. The
place of a chunk in the next level is the number of set bits before it, which a rank directory
(set bits before every block of 512) and the bits of one block give. So any id, or any run of
ids, is read without decoding what stands before it.

Documents are dealt out by ranges of their id, so that files in the order of their range and
number hold all documents in ascending order. A file holds a bounded number of ids; the
place of its first id among all ids is a running sum over the table of files.

Words are encoded once per worker by the tokenizers library and remembered, in bounded
number: the tokenizer drops white space and never looks across it, so the ids of a text are
those of its words. Of a word of letters with ASCII punctuation behind it, which is most words,
letters and punctuation are encoded apart, as the tokenizer's own split has them; the letters in
lower case go to its merges directly, since its other steps leave such letters as they are.

Defined results: null and the empty text have the end id only; null ids come first; equal ids
stand side by side, ordered by their text; strings of special tokens in a text are ordinary
text; an empty table gives no files; texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import store
from logloom.llm.bytebpe import ragged, slices
from logloom.llm.texts import kept, map_batches
from logloom.session import written

#: Ids of one file; a document longer than that has a file of its own.
FILE_IDS = 4 << 20
#: Words whose ids a worker remembers.
KNOWN_WORDS = 1_000_000
#: Fixed values of the file format.
MAGIC, BLOCK = b"DACIDS01", 512


#: Letters that every step but lower case leaves as they are, and ASCII punctuation that is no apostrophe.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch


class Numbers(dict):
    """Numbers of words in the order they come; ``new`` has those whose ids are not learned yet."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Words:
    """Ids of white-space separated words by a tokenizer that drops white space."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        self.whole.encode_special_tokens = True
        steps = json.loads(definition) | {"normalizer": None, "added_tokens": []}
        steps["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.letters = Tokenizer.from_str(json.dumps(steps))
        self.forget()

    def forget(self) -> None:
        self.index = Numbers()
        self.flat, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)
        # parts of words: number 0 is the empty part
        self.parts: dict[str, int] = {"": 0}
        self.part_flat, self.part_starts = np.empty(0, np.uint32), np.zeros(2, np.int64)

    def _learn_parts(self, tokenizer, parts: list[str]) -> None:
        ids, sizes = [], np.zeros(len(parts), np.int64)
        for at in range(0, len(parts), 20_000):
            some = parts[at:at + 20_000]
            found = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            sizes[at:at + len(some)] = np.bincount(np.array(found.word_ids, np.int64), minlength=len(some))
        self.parts.update(zip(parts, range(len(self.parts), len(self.parts) + len(parts)), strict=True))
        self.part_starts = np.concatenate([self.part_starts, self.part_starts[-1] + np.cumsum(sizes)])
        self.part_flat = np.concatenate([self.part_flat, *ids])

    def learn(self) -> None:
        """Add the ids of the new words."""
        words, self.index.new = self.index.new, []
        if not words:
            return
        split, letters, others = [], set(), set()
        for word in words:
            text = word.decode("utf-8", "surrogatepass")
            found = _PLAIN(text)
            if found:
                base, tail = found[1].lower(), found[2]
                letters.add(base)
            else:
                base, tail = text, ""
                others.add(base)
            others.add(tail)
            split += (base, tail)
        self._learn_parts(self.letters, [x for x in letters if x not in self.parts])
        self._learn_parts(self.whole, [x for x in others if x not in self.parts])
        numbers = np.fromiter(map(self.parts.__getitem__, split), np.int64, len(split))
        tokens, sizes = ragged(self.part_flat, self.part_starts, numbers)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes.reshape(-1, 2).sum(1))])
        self.flat = np.concatenate([self.flat, tokens])

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """The ids of each text, with ``end`` after them."""
        if len(self.index) > KNOWN_WORDS:
            self.forget()
        number, numbers = self.index.__getitem__, []
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").split()
            numbers.append(np.fromiter(map(number, words), np.int64, len(words)))
        self.learn()
        return [np.append(ragged(self.flat, self.starts, some)[0], np.uint32(end)) for some in numbers]


class Level:
    """One level of chunks with its bitmap and rank directory."""

    def __init__(self, chunks: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bits, self.ranks = chunks, bits, ranks

    def rank(self, at: int) -> int:
        """Set bits before ``at``."""
        block = at // BLOCK
        first = block * BLOCK
        inside = np.unpackbits(self.bits[first // 8:-(-at // 8)], bitorder="little")[:at - first]
        return int(self.ranks[block]) + int(inside.sum())

    def flags(self, start: int, stop: int) -> np.ndarray:
        first = start // 8 * 8
        return np.unpackbits(self.bits[start // 8:-(-stop // 8)], bitorder="little")[start - first:stop - first].astype(bool)


def encode_ids(ids: np.ndarray) -> list[Level]:
    levels, rest = [], ids.astype(np.uint64)
    while True:
        more = rest > 255
        ranks = np.concatenate(([0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64)))) \
            if len(more) else np.zeros(1, np.int64)
        levels.append(Level((rest & np.uint64(255)).astype(np.uint8), np.packbits(more, bitorder="little"), ranks.astype("<u8")))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint64(8)


def read_ids(levels: list[Level], start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` to ``stop``; only their own chunks are touched."""
    out, where = np.zeros(stop - start, np.uint32), np.arange(stop - start)
    for number, level in enumerate(levels):
        out[where] |= level.chunks[start:stop].astype(np.uint32) << np.uint32(8 * number)
        more = level.flags(start, stop)
        where = where[more]
        if not len(where):
            break
        start = level.rank(start)
        stop = start + len(where)
    return out


def to_bytes(doc_ids: list, sizes: list[int], ids: np.ndarray) -> bytes:
    """A file: header, documents (null marks, ids, where each begins) and the levels."""
    levels = encode_ids(ids)
    parts = [MAGIC, struct.pack("<QQQ", len(sizes), len(ids), len(levels)),
             np.array([i is None for i in doc_ids], np.uint8).tobytes(),
             np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
             np.concatenate(([0], np.cumsum(sizes))).astype("<u8").tobytes()]
    for level in levels:
        parts += [struct.pack("<Q", len(level.chunks)), level.chunks.tobytes(), level.bits.tobytes(), level.ranks.tobytes()]
    return b"".join(parts)


class Codes:
    """A file of codes, opened: documents by number, ids by place."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        docs, self.n_ids, n_levels = struct.unpack_from("<QQQ", data, 8)
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        nulls = take("u1", docs)
        self.doc_ids = [None if n else i for n, i in zip(nulls.tolist(), take("<i8", docs).tolist(), strict=True)]
        self.begins = take("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            count = int(take("<u8", 1)[0])
            self.levels.append(Level(take("u1", count), take("u1", -(-count // 8)), take("<u8", -(-count // BLOCK) + 1)))

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.begins[number]), int(self.begins[number + 1]))

    def runs(self, ids: int = 1 << 16) -> Iterator[tuple[int, int]]:
        """Documents [first, stop) in runs of about that many ids."""
        first = 0
        while first < len(self.doc_ids):
            stop = max(first + 1, int(np.searchsorted(self.begins, self.begins[first] + ids, side="right")) - 1)
            yield first, stop
            first = stop

    def ids(self, start: int, stop: int) -> np.ndarray:
        return read_ids(self.levels, start, stop)


def _words(shared) -> Words:
    return kept(("words", zlib.crc32(shared.value.encode())), lambda: Words(shared.value))


def write_files(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                file_ids: int = FILE_IDS) -> DataFrame:
    """Write all documents to files; returns their table (part, number, path, docs, ids, start)."""
    spark, folder = docs.sparkSession, store.new_folder(docs.sparkSession, "codes")
    with open(tokenizer_file, encoding="utf-8") as source:
        shared = spark.sparkContext.broadcast(source.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, ids, size = [], [], 0

        def close() -> pa.RecordBatch:
            data = to_bytes(doc_ids, [len(x) for x in ids], np.concatenate(ids))
            path = store.write_file(folder, f"{part:06d}-{number:05d}.dac", data)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "path": [path],
                 "docs": [len(ids)], "ids": [size]})

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in slices(texts):
                for doc_id, found in zip(names[some], _words(shared).encode(texts[some], end_id), strict=True):
                    if size and size + len(found) > file_ids:
                        yield close()
                        doc_ids, ids, size, number = [], [], 0, number + 1
                    doc_ids.append(doc_id)
                    ids.append(found)
                    size += len(found)
        if ids:
            yield close()

    files = written(map_batches(ranges, run, "part int, number int, path string, docs long, ids long"), "codes")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, start (ids before it), n_tokens and ids_crc32."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, sums = Codes(store.read_file(path)), []
                for first, stop in codes.runs():
                    begins = codes.begins[first:stop + 1] - codes.begins[first]
                    ids = codes.ids(int(codes.begins[first]), int(codes.begins[stop])).astype("<u4")
                    sums += [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes.doc_ids, pa.int64()), pa.array(codes.begins[:-1] + start, pa.int64()),
                     pa.array(np.diff(codes.begins), pa.int64()), pa.array(sums, pa.int64())],
                    names=[id_col, "start", "n_tokens", "ids_crc32"])

    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(files.select("path", "start").repartition(spread, "path"), run,
                       f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
