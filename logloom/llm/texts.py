"""Shared helpers: batches, word hashes and sums over whole texts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from logloom.llm import store
from logloom.session import checkpoint_dir

#: Bytes of texts that one Arrow batch holds, beyond its first row.
BATCH_BYTES = "8m"
#: Entries a word memo holds before it starts anew; speed only, never results.
MEMO_ENTRIES = 1 << 17

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark application, wherever the driver imported it from."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if not root.is_dir() or hasattr(context, "_logloom_shipped"):
        return
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context._logloom_shipped = store.write_file(store.new_folder(spark, "code"), f"{root.name}.zip", archive.getvalue())
    context.addPyFile(context._logloom_shipped)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes as well as in rows."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()  # workers wait for their next task with it

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hash of each word seen, computed once per distinct word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a worker needs for all its tasks of one operator, made once; another operator's goes."""
    if key not in _KEPT:
        _KEPT.clear()
        _HASHES.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> U64(30))) * _MIX1
        values = (values ^ (values >> U64(27))) * _MIX2
        return values ^ (values >> U64(31))


def window_hashes(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash for each run of ``width`` words, from the hashes of its words."""
    count = len(words) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    factor = U64(seed * 2 + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
    with np.errstate(over="ignore"):
        value = np.zeros(count, np.uint64)
        for i in range(width):
            value = value * factor + words[i:i + count]
        return mixed(value ^ U64(seed))


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted values, each once."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def place_names(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ... so that no name can clash with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pack(array: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.astype(kind).tobytes())


def unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)
