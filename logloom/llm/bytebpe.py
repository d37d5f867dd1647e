"""Byte-level BPE by merge replay over the distinct words of a stretch of the corpus.

The pieces that the split pattern finds in a batch of texts are collected as distinct
words. An inverted index leads from the rank of a token pair to the places where the pair
stands in any word. Merges are applied in rank order, each to all its places at once, and
only the two neighbours of a place touched get new index entries. A text is then the
concatenation of its words' tokens. Each task replays the words of its own batches and
keeps what it knows for the next, so no vocabulary of the whole corpus is built, joined
or broadcast: the result of a word depends on the ranks alone.

Only the rank file is shared (its size does not depend on the data; ``MAX_RANKS`` bounds it).

Defined results: null is the empty text; the empty text has no tokens; special tokens are
ordinary text; a text or a word of any length is encoded whole; repeated rows give repeated
rows; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.texts import MEMO_ENTRIES, distinct, kept, map_batches

#: Characters of a text that are split into words at a time.
STRETCH = 1 << 20
#: Tokens of a rank file that may be broadcast.
MAX_RANKS = 1_000_000

NONE = np.iinfo(np.int64).max


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: base64 text and rank on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{len(ranks)} tokens; at most {MAX_RANKS} may be broadcast")
    return ranks


def pieces(pattern: regex.Pattern, text: str) -> Iterator[list[str]]:
    """The matches in ``text``, by stretches; no match is cut at the end of a stretch."""
    at, size = 0, STRETCH
    while at < len(text):
        stop = min(len(text), at + size)
        found = pattern.findall(text, at, stop)
        if stop < len(text):
            # What the last matches are may depend on the text beyond the stretch.
            kept = sum(map(len, found[:-2]))
            if not kept:
                size *= 2
                continue
            found, at, size = found[:-2], at + kept, STRETCH
        else:
            at = stop
        yield found


class Replay:
    """Words and their tokens under one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        # Every cut of a token in two tokens is a pair that merges to it.
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.results = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.used = np.empty(0, np.int64), np.zeros(1, np.int64), 0

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        if not len(self.keys):
            return np.full(len(keys), NONE)
        places = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[places] == keys, self.results[places], NONE)

    def learn(self, words: list[str]) -> None:
        """Add words that are not known yet, each once."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = np.array([self.ranks.get(w, -1) for w in raw], np.int64)
        flat, sizes = self.replay([w for w, rank in zip(raw, whole.tolist(), strict=True) if rank < 0])
        lengths = np.ones(len(raw), np.int64)
        lengths[whole < 0] = sizes
        tokens = np.empty(int(lengths.sum()), np.int64)
        alone = np.repeat(whole >= 0, lengths)
        tokens[alone], tokens[~alone] = whole[whole >= 0], flat
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, tokens])

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words and how many each has, by applying the merges in rank order."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sizes = np.array([len(w) for w in words])
        stops = np.cumsum(sizes)
        symbols = self.single[np.frombuffer(b"".join(words), np.uint8)]
        if (symbols < 0).any():
            raise ValueError("the rank file lacks a byte that occurs in the text")
        count = len(symbols)
        after = np.arange(1, count + 1)
        after[stops - 1] = count
        before = np.arange(-1, count - 1)
        before[stops - sizes] = -1
        symbols = np.append(symbols, -1)  # what stands after a word's end
        places: dict[int, list[np.ndarray]] = {}
        due: list[int] = []
        odd: set[int] = set()

        def note(at: np.ndarray) -> np.ndarray:
            """Index pairs that start at ``at``; returns their ranks."""
            ranks = self._rank_of(symbols[at], symbols[after[at]])
            known = ranks < NONE
            at, found = at[known], ranks[known]
            if not len(at):
                return ranks
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist(), len(at)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                rank = int(found[begin])
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(due, rank)
                places[rank].append(at[begin:end])
            return ranks

        first = np.flatnonzero(after[:count] < count)
        note(first)
        while due:
            rank = heapq.heappop(due)
            at = distinct(np.concatenate(places.pop(rank)))
            # Places whose tokens were merged with others since are no longer this pair.
            live = (symbols[at] >= 0) & (after[at] < count)
            at = at[live]
            at = at[self._rank_of(symbols[at], symbols[after[at]]) == rank]
            if not len(at):
                continue
            if len(at) > 1:
                # Of pairs that overlap, the first, third ... of a run are merged.
                joined = np.concatenate(([False], after[at[:-1]] == at[1:]))
                run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            right = after[at]
            symbols[at] = rank
            symbols[right] = -2
            far = after[right]
            after[at] = far
            inside = far < count
            before[far[inside]] = at[inside]
            left = before[at]
            touched = distinct(np.concatenate([left[left >= 0], at[inside]]))
            lower = touched[note(touched) < rank]
            if len(lower):  # a lower rank that a merge brought about: settle these words alone
                odd.update(np.searchsorted(stops, lower, side="right").tolist())
        alive = symbols[:count] >= 0
        kept = symbols[:count][alive]
        lengths = np.add.reduceat(alive, stops - sizes, dtype=np.int64)
        if odd:
            parts = np.split(kept, np.cumsum(lengths)[:-1])
            for word in odd:
                parts[word] = np.array(self._alone(words[word]), np.int64)
            kept, lengths = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return kept, lengths

    def _alone(self, word: bytes) -> list[int]:
        """One word by itself: merge the leftmost pair of lowest rank until none is left."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == NONE:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, pattern: regex.Pattern, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.index) > MEMO_ENTRIES:
            self.forget()
        found = [list(chain.from_iterable(pieces(pattern, text))) for text in texts]
        fresh = set().union(*found)
        self.learn([w for w in fresh if w not in self.index])
        numbers = np.fromiter(map(self.index.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
        tokens, sizes = ragged(self.flat, self.starts, numbers)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(np.array([len(part) for part in found], np.int64))]
        return np.split(tokens, ends[:-1]) if texts else []

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def ragged(flat: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``numbers`` of a ragged array, one after the other, and their lengths."""
    begin = starts[numbers]
    sizes = starts[numbers + 1] - begin
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(begin - (ends - sizes), sizes)], sizes


def _replay(shared) -> Replay:
    name, ranks = shared.value
    return kept(("ranks", name), lambda: Replay(ranks))


def slices(texts: list[str], limit: int = 4 << 20) -> Iterator[slice]:
    """Stretches of rows of about ``limit`` characters, one row at least."""
    start = size = 0
    for at, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield slice(start, at)
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def encoded(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id and ``ids``, the tokens as little-endian unsigned 32-bit numbers."""
    shared, name = _shared(docs, rank_file)
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        replay, words = _replay(shared), regex.compile(pattern)
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for part in slices(texts):
                out += [ids.astype("<u4").tobytes() for ids in replay.encode(words, texts[part])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "ids"])

    return map_batches(narrow, run, f"`{id_col}` {narrow.schema['id'].dataType.simpleString()}, ids binary")


def decoded(tokens: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``bytes``, what the tokens stand for."""
    shared, _ = _shared(tokens, rank_file)
    narrow = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        replay = _replay(shared)
        for batch in batches:
            out = [replay.decode(np.frombuffer(ids or b"", "<u4")) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    return map_batches(narrow, run, f"`{id_col}` {narrow.schema['id'].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_tokens, ids_sha256 and decoded_sha256, in one pass."""
    shared, _ = _shared(docs, rank_file)
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        replay, words = _replay(shared), regex.compile(pattern)
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), []
            for part in slices(texts):
                for ids in replay.encode(words, texts[part]):
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                                 hashlib.sha256(replay.decode(ids)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(columns[0]), pa.int64()), pa.array(list(columns[1]), pa.string()),
                 pa.array(list(columns[2]), pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = narrow.schema["id"].dataType.simpleString()
    return map_batches(narrow, run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _shared(df: DataFrame, rank_file: str) -> tuple:
    ranks = read_ranks(rank_file)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((name, ranks)), name
