"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

The normalised words of a block of items go into one automaton. The words of a training
text are streamed through it and the longest match ending at each word is tracked, so
any occurrence of an item window is seen wherever it starts. A text is contaminated
when the words inside such occurrences reach the coverage limit. ``without_contaminated`` leaves such texts out,
``without_spans`` cuts the spans inside occurrences out of texts, where a span is too long or the text is contaminated.

The items may be a table of any size: they are dealt into blocks of about ``block_bytes`` of text, tasks
build an automaton of each and write it to the shared folder, and the one pass over the texts matches
each batch of texts with one automaton after the other. Only their addresses reach the driver. Building them runs a job.

Defined results: a null or wordless text has no words and is never contaminated; null items
and items without words match nothing; an item id of null has
the id text "null"; items of equal id count as one; repeated rows are judged each for itself; an empty item table
leaves every text clean; a text of any length is read whole.
"""

from __future__ import annotations

import hashlib
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import store
from logloom.llm.texts import kept, map_batches

#: Words of a window, and hit words in a hundred words that make a text contaminated.
WINDOW = 13
COVERAGE_PERCENT = 5
#: A span of more words than this is cut out of any text.
SPAN_WORDS = 20
#: Bytes of item texts in one automaton.
BLOCK_BYTES = 1 << 20

# A-Z become a-z; every other ASCII byte that is no letter or digit separates words.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the items behind each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []  # state, words read, item
        self.ids = [item for item, _ in items]
        self.shortest = min([window, *(len(words) for _, words in items if words)])
        for number, (_, words) in enumerate(items):
            state = 0
            for at, word in enumerate(words, 1):
                state = self._extend(state, self.vocabulary.setdefault(word, len(self.vocabulary)))
                if at >= window or at == len(words):
                    ends.append((state, min(at, window), number))
        # A window belongs to the state of its own length on the chain of suffix links.
        windows: dict[int, dict[int, set[int]]] = {}
        for state, words, number in ends:
            while self.length[self.link[state]] >= words:
                state = self.link[state]
            windows.setdefault(state, {}).setdefault(words, set()).add(number)
        self.windows = {s: sorted(found.items()) for s, found in windows.items()}
        # The nearest state with windows at or above each state, so that chains are short.
        self.above = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            self.above[state] = state if state in self.windows else self.above[up]

    def _extend(self, last: int, word: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        if word in nexts[last]:
            known = nexts[last][word]
            return known if length[known] == length[last] + 1 else self._split(last, word, known)
        state = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        while last >= 0 and word not in nexts[last]:
            nexts[last][word] = state
            last = link[last]
        if last >= 0:
            known = nexts[last][word]
            link[state] = known if length[known] == length[last] + 1 else self._split(last, word, known)
        return state

    def _split(self, last: int, word: int, known: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[known]))
        length.append(length[last] + 1)
        link.append(link[known])
        link[known] = copy
        while last >= 0 and nexts[last].get(word) == known:
            nexts[last][word] = copy
            last = link[last]
        return copy

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[int], int]:
        """Which words are hit, the items found and the longest match."""
        hit = np.zeros(len(words), bool)
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        # Only runs of known words that are long enough for the shortest window are streamed.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, stops = edges[::2], edges[1::2]
        wide = stops - starts >= self.shortest
        found, spans, longest = set(), [], 0
        nexts, link, length, above, windows = self.next, self.link, self.length, self.above, self.windows
        for start, stop in zip(starts[wide].tolist(), stops[wide].tolist(), strict=True):
            state = matched = 0
            for at, word in enumerate(ids[start:stop].tolist(), start + 1):
                while word not in nexts[state] and state:
                    state = link[state]
                    matched = length[state]
                state = nexts[state].get(word, -1)
                if state < 0:
                    state = matched = 0
                    continue
                matched += 1
                if matched > longest:
                    longest = matched
                up = above[state]
                while up > 0:
                    for size, items in windows[up]:
                        if size <= matched:
                            found |= items
                            spans.append((at - size, at))
                    up = above[link[up]]
        for start, stop in spans:
            hit[start:stop] = True
        return hit, found, longest


def _automata(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list[str]:
    """The addresses of the automata of all blocks of items, which tasks build and write."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t"))
    rows = rows.where("t is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks, folder = max(1, -(-size // block_bytes)), store.new_folder(items.sparkSession, "items")

    def build(table: pa.Table) -> pa.Table:
        pairs = zip(table.column("i").to_pylist(), table.column("t").to_pylist(), strict=True)
        automaton = Automaton([(i, words_of(t)) for i, t in pairs], window)
        return pa.table({"address": [store.write_file(folder, "automaton", pickle.dumps(automaton))]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))).groupBy("block")
    return sorted(r.address for r in dealt.applyInArrow(build, "address string").collect())


def _matched(texts: pa.Array, addresses: list[str]) -> list[tuple[np.ndarray, set[str], int]]:
    """For each text which words are hit, the ids of the items found and the longest match, over all automata."""
    found = [(np.zeros(0, bool), set(), 0)] * len(texts)
    for address in addresses:
        automaton = kept(("items", address), lambda at=address: pickle.loads(store.read_file(at)))
        for number, text in enumerate(texts):
            hit, items, longest = automaton.match(words_of(text.as_py()))
            before = found[number]
            found[number] = (hit | before[0] if len(before[0]) else hit, before[1] | {automaton.ids[i] for i in items},
                             max(longest, before[2]))
    if not addresses:
        found = [(np.zeros(len(words_of(t.as_py())), bool), set(), 0) for t in texts]
    return found


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  coverage_percent: int = COVERAGE_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, longest, hits.

    ``hits`` lists the word spans [start, end) inside occurrences of item windows, ``items``
    the item ids found, sorted as text.
    """
    addresses = _automata(items, item_id, item_text, window, block_bytes)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def judge(batches):
        for batch in batches:
            rows = [_row(*found, coverage_percent) for found in _matched(batch.column(1), addresses)]
            yield _batch(batch.column(0), rows, id_col)

    kind = narrow.schema["id"].dataType.simpleString()
    return map_batches(narrow, judge, f"`{id_col}` {kind}, {_SCHEMA}")


_SCHEMA = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
           "longest long, hits array<struct<start:int,stop:int>>, items array<string>")
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _spans(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
    return [{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _row(hit: np.ndarray, items: set[str], longest: int, percent: int) -> tuple:
    names, n_hit = sorted(items), int(hit.sum())
    digest = hashlib.sha256(",".join(names).encode("utf-8", "surrogatepass")).hexdigest()
    return (len(hit), n_hit, len(names), digest, _contaminated(hit, percent), longest,
            _spans(hit), names)


def _batch(ids: pa.Array, rows: list[tuple], id_col: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), _SPANS, pa.list_(pa.string())]
    names = [part.split()[0] for part in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, *names])


def _contaminated(hit: np.ndarray, percent: int) -> bool:
    n_hit = int(hit.sum())
    return n_hit > 0 and 100 * n_hit >= percent * len(hit)


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                         item_text: str = "text", window: int = WINDOW,
                         coverage_percent: int = COVERAGE_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text is not contaminated."""
    addresses, place = _automata(items, item_id, item_text, window, block_bytes), docs.columns.index(text_col)

    def clean(batches):
        for batch in batches:
            keep = [not _contaminated(hit, coverage_percent) for hit, _, _ in _matched(batch.column(place), addresses)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, clean, docs.schema)


def without_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, span_words: int = SPAN_WORDS,
                  coverage_percent: int = COVERAGE_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns kept, their texts without spans that exceed a limit.

    A span is a longest run of words inside occurrences of item windows. One of more than ``span_words`` words
    is cut out of any text, and all spans are cut out of a contaminated text, with what stands between their
    words. Texts without such spans, nulls included, stay as they are.
    """
    addresses, place = _automata(items, item_id, item_text, window, block_bytes), docs.columns.index(text_col)

    def clean(batches):
        for batch in batches:
            column, texts = batch.column(place), batch.column(place).to_pylist()
            for number, (hit, _, _) in enumerate(_matched(column, addresses)):
                every = _contaminated(hit, coverage_percent)
                spans = [s for s in _spans(hit) if every or s["stop"] - s["start"] > span_words]
                if spans:
                    texts[number] = cut(texts[number], spans)
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, column.type))

    return map_batches(docs, clean, docs.schema)


def cut(text: str, spans: list[dict]) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for span in spans:
        out.append(text[at:places[span["start"]][0]])
        at = places[span["stop"] - 1][1]
    return "".join([*out, text[at:]])
