"""N-gram Jaccard self-join with a token-group matrix.

The set of a document holds its distinct runs of ``words`` words (a shorter text is one run). Two
documents are linked when their sets' Jaccard similarity reaches ``over / under``; the result is the
smallest id each document is linked with, directly or over others. Three words and 9/10 are the defaults.

Blocks. With the similarity p/q, sets of sizes a <= b can be linked only if b <= a * q/p, and then differ
in at most a * (q-p)/p tokens. Sizes are cut into classes so that linked sets lie in one class or in
neighbours. For each class a set is cut by token hash into d + 2 parts, d being the most tokens that may
differ, and some more where d + 2 parts would often be empty: two linked sets agree in two parts at
least. The hash of a part that is not empty is a signature. A set with so many empty parts that
it may agree with a linked one in these only has each pair of them as a signature as well. So every
linked pair shares a signature, whatever tokens are frequent, and a shared passage alone rarely makes one.
Smaller sets of a class, which differ in fewer tokens, agree in more parts: a set that must share n signatures
of a class drops the n - 1 most frequent of them, the same order for all. The rarest one that a linked pair
shares stays in both, and a set with fewer than n signatures that others have drops out.

Groups. Documents that share signatures are put into groups around the smallest document they share
one with; a group holds a bounded number of members and tokens. The token-group matrix has a row for
each group: its members and the union of their tokens. Groups are first opened against
themselves and their leader, which links most near copies. Documents are then grouped anew by
what they are connected with, and what is left are pairs of groups that share a signature and
are not connected as a whole: for each query of the smaller group the overlap with the other
group's union bounds the overlap with any member, and only groups that some query's bound
reaches are opened, for those queries. Of a signature, groups whose members are all connected already are not compared.

Hot groups. Equal sets are one class with one representative. A task sends a signature once for
each stretch of texts, with one set; where it saw several, all of them go out as well. Minimum and maximum per signature are partial aggregates. Full groups of one connected
component are never compared, so a very large cluster of linked copies costs rows in
proportion to its members; a large cluster that is alike but not linked is compared group by
group, and neither its pairs of documents nor their links are written out. No candidate is dropped.

Sets meet by 64-bit token hashes and 128-bit set digests. Defined results: null and wordless texts
have the empty set and are linked with nothing, themselves excepted; rows of null id count their
shingles, take no part in links and have a null component; where rows of one id have different
sets the largest stands for the id (of equal sizes that of the largest digest), and all these rows
have its component; an empty table gives an empty table; texts are whole. Ids are integers.
"""

from __future__ import annotations

import functools
import math
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.graph import components
from logloom.llm.texts import U64, distinct, hash_words, map_batches, mixed, pack, unpack, window_hashes
from logloom.session import forget, written


class Likeness(NamedTuple):
    """Words of a token, and the similarity as a fraction."""

    words: int = 3
    over: int = 9
    under: int = 10


LIKENESS = Likeness()
#: Signatures a task gathers before it sends them, in pieces, and that meet in one bucket.
GATHER, PIECES, BUCKET = 1 << 20, 16, 1 << 19
#: Members and tokens of one group.
MEMBERS, TOKENS = 32, 1 << 16
#: Bits of the filter by which the second pass over the texts leaves out documents without candidates.
FILTER_BITS = 1 << 25


def tokens_of(text: str | None, width: int = LIKENESS.words) -> np.ndarray:
    """The sorted distinct token hashes of a text."""
    words = hash_words((text or "").encode("utf-8", "surrogatepass").lower().split())
    return distinct(window_hashes(words, min(width, len(words)) or width, len(words) if len(words) < width else 0))


@functools.cache
def _classes(over: int, under: int, limit: int = 1 << 40) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Smallest sizes of the classes, and per class its largest size, the most tokens in which a set of it
    differs from a larger one, and the number of parts."""
    lows, out, low = [], [], 1
    spare = 1.5 * math.exp(-over / (under - over))  # more parts than are expected empty
    while low <= limit:
        high = low * under // over
        most = high * (under - over) // over
        lows.append(low)
        out.append((high, most, most + 2 + int(spare * most)))
        low = high + 1
    return np.array(lows), out


def signatures(tokens: np.ndarray, like: Likeness = LIKENESS) -> np.ndarray:
    """The signatures of a set: those of its own size class, and of the class below it."""
    return _signatures(tokens, like)[0]


def _signatures(tokens: np.ndarray, like: Likeness) -> tuple[np.ndarray, int]:
    """The signatures of a set, and how many of them it shares at least with any set it is linked with.

    Bit 16 of a signature is that of its class being odd. The number for the odd class is 32 bits above that for the even one.
    """
    over, under, size = like.over, like.under, len(tokens)
    needs = [1, 1]
    if size * (under - over) < over:
        return np.empty(0, np.uint64), needs[0] | needs[1] << 32  # linked only with equal sets
    lows, classes = _classes(over, under)
    own = int(np.searchsorted(lows, size, side="right")) - 1
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(tokens + U64(0x632BE59BD9B4E019)))))
    found = []
    for number in range(max(own - 1, 0), own + 1):
        high, most, parts = classes[number]
        if not most:
            continue
        cuts = (np.arange(1, parts, dtype=np.uint64) << U64(32)) // U64(parts) << U64(32)
        edges = np.concatenate(([0], np.searchsorted(tokens, cuts), [size]))
        with np.errstate(over="ignore"):
            names = mixed(np.arange(parts, dtype=np.uint64) + U64(number << 32))
            value = mixed(np.diff(sums[edges])) + names
        empty = np.diff(edges) == 0
        parity, found_here = number & 1, [mixed(value[~empty])]
        # the most tokens in which this set differs from one it meets in this class
        differ = size * (under - over) // over if number == own else (size + high) * (under - over) // (over + under)
        needs[parity] = max(1, parts - min(most, differ) - int(empty.sum()))
        if empty.sum() >= parts - min(most, differ):
            names = names[empty]
            one, two = np.triu_indices(len(names), 1)
            with np.errstate(over="ignore"):
                found_here.append(mixed(mixed(names[one] + U64(1)) + names[two]))
        found.append(np.concatenate(found_here) & ~_ODD | _ODD * U64(parity))
    return np.concatenate(found) if found else np.empty(0, np.uint64), needs[0] | needs[1] << 32


#: The bit of a signature that tells its class from the neighbours'; the lowest of those that are kept.
_ODD = U64(1 << 16)

_PASS = "kind int, bucket int, first long, a binary, b binary, c binary, d binary, e binary"


_HEAD = struct.Struct("<BBQ")


def _coded(signs: np.ndarray, owners: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Ascending signs as distances, set numbers as distances from the least, each in as few bytes as fit, and a head."""
    first, least = int(owners.min()), signs[0]
    steps, places = np.diff(signs, prepend=least), (owners - first).astype(np.uint64)
    wide, deep = 8 if steps.max() >> U64(32) else 4, 2 if places.max() < 1 << 16 else 8
    return first, steps.astype(f"<u{wide}").tobytes(), places.astype(f"<u{deep}").tobytes(), _HEAD.pack(wide, deep, int(least))


def _decoded(first: int, steps: bytes, places: bytes, head: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide, deep, least = _HEAD.unpack(head)
    signs = np.cumsum(np.frombuffer(steps, f"<u{wide}"), dtype=np.uint64) + U64(least)
    return signs, first + np.frombuffer(places, f"<u{deep}").astype(np.int64)


def _passed(docs: DataFrame, buckets: int, like: Likeness) -> DataFrame:
    """One pass over the texts: sets (id, size, digest, needs) as kind 0, open signatures as 1, further members as 2.

    Sets are numbered; signatures go with the number of one of the documents that have the set, and
    stand for any that has. A signature is cut to its upper 48 bits, sorted and dealt by ranges.
    """
    names = [c.split()[0] for c in _PASS.split(", ")]

    def rows(kind: int, entries: list[tuple]) -> pa.RecordBatch:
        """Rows of (bucket, first, a, b, c, d, e)."""
        numbers, firsts, *columns = zip(*entries, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(entries), pa.int32()), pa.array(numbers, pa.int32()), pa.array(firsts, pa.int64()),
             *(pa.array(c, pa.binary()) for c in columns)], names=names)

    def send(found: list[np.ndarray], numbers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every, of = np.concatenate(found) >> U64(16), np.concatenate(numbers)
        found.clear()
        numbers.clear()
        bucket = (every >> U64(16)) * U64(buckets) >> U64(32)
        piece = bucket % U64(PIECES)
        for number in range(PIECES):  # what is sorted and copied is a piece at a time
            some = piece == U64(number)
            if not some.any():
                continue
            signs, owners, where = every[some], of[some], bucket[some]
            order = np.lexsort((owners, signs))
            signs, owners, where = signs[order], owners[order], where[order]
            new = np.concatenate(([True], signs[1:] != signs[:-1]))
            again = ~new | np.concatenate((~new[1:], [False]))  # signatures that several sets here share
            if again.any():
                yield rows(2, [(0, *_coded(signs[again], owners[again]), None, None)])
            signs, owners, where = signs[new], owners[new], where[new].astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
            yield rows(1, [(int(where[x]), *_coded(signs[x:y], owners[x:y]), None, None) for x, y in zip(cuts, cuts[1:], strict=False)])

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        found, numbers, size = [], [], 0
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            sets = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = tokens_of(text.as_py(), like.words)
                digest = _digest(tokens)
                signs = tokens[:0]
                if digest not in seen:
                    signs, seen[digest] = _signatures(tokens, like)
                sets.append((i, len(tokens), *digest, seen[digest]))
                if len(signs):
                    found.append(signs)
                    numbers.append(np.full(len(signs), number + len(sets) - 1))
                    size += len(signs)
                if size >= GATHER:
                    yield from send(found, numbers)
                    size = 0
                    seen.clear()
            if sets:
                yield rows(0, [(0, number, *(np.array(c, "<i8").tobytes() for c in zip(*sets, strict=True)))])
                number += len(sets)
        if size:
            yield from send(found, numbers)

    return map_batches(docs.where("id is not null").select("id", "text"), run, _PASS)


def _sets(passed: DataFrame) -> DataFrame:
    """(number, id, size, high, low, needs) of every document."""

    def run(batches):
        for batch in batches:
            for first, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns = [np.frombuffer(x, "<i8") for x in row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (np.arange(first, first + len(columns[0])), *columns)],
                    names=["number", "id", "size", "high", "low", "needs"])

    return map_batches(passed.where("kind = 0").select("first", "a", "b", "c", "d", "e"), run,
                       "number long, id long, size long, high long, low long, needs long")


def _shared(passed: DataFrame) -> DataFrame:
    """(sign, number): the sets of signatures that occur more than once."""

    def pairs(signs: np.ndarray, numbers: np.ndarray) -> list[pa.Array]:
        return [pa.array(signs.view(np.int64), pa.int64()), pa.array(numbers, pa.int64())]

    def meet(table: pa.Table) -> pa.Table:
        found = [_decoded(*x) for x in zip(*(table.column(c).to_pylist() for c in ("first", "a", "b", "c")), strict=True)]
        signs, numbers = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(signs, kind="stable")
        signs, numbers = signs[order], numbers[order]
        same = signs[1:] == signs[:-1]
        again = np.concatenate((same, [False])) | np.concatenate(([False], same))
        return pa.table(pairs(signs[again], numbers[again]), names=["sign", "number"])

    schema = "sign long, number long"
    met = passed.where("kind = 1").select("bucket", "first", "a", "b", "c").groupBy("bucket").applyInArrow(meet, schema)

    def run(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays(pairs(*_decoded(*row)), names=["sign", "number"])

    return met.unionByName(map_batches(passed.where("kind = 2").select("first", "a", "b", "c"), run, schema))


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set, as two signed numbers."""
    digest = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which the hashed place of every id is set."""
    size = FILTER_BITS // 8

    def run(batches):
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            place = mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) % U64(FILTER_BITS)
            np.bitwise_or.at(bits, (place >> U64(3)).astype(np.int64), (1 << (place & U64(7)).astype(np.uint8)).astype(np.uint8))
        step = size // 64
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(64), pa.int32()), pa.array([pack(bits[i * step:(i + 1) * step], "u1") for i in range(64)], pa.binary())],
            names=["slice", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([unpack(x, "u1") for x in table.column("bits").to_pylist()])
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([pack(bits, "u1")], pa.binary())})

    schema = "slice int, bits binary"
    rows = map_batches(ids, run, schema).groupBy("slice").applyInArrow(merge, schema).collect()
    out = np.zeros(size, np.uint8)
    for row in rows:
        out[row.slice * (size // 64):(row.slice + 1) * (size // 64)] = unpack(row.bits, "u1")
    return out


def _tokens(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, tokens) of the documents ``ids`` (id, high): a second pass over the texts, which the filter shortens."""
    shared = docs.sparkSession.sparkContext.broadcast(pack(_filter(ids.select("id")), "u1"))

    def run(batches):
        bits = unpack(shared.value, "u1")
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            place = mixed(names.view(np.uint64)) % U64(FILTER_BITS)
            may = bits[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8) & 1
            some = np.flatnonzero(may)
            found = [tokens_of(batch.column(1)[i].as_py(), width) for i in some.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[some], pa.int64()), pa.array([_digest(t)[0] for t in found], pa.int64()),
                 pa.array([t.tobytes() for t in found], pa.binary())], names=["id", "high", "tokens"])

    rows = map_batches(docs.where("id is not null").select("id", "text"), run, "id long, high long, tokens binary")
    # equal rows of one id have equal sets: one of them is enough; grouped by the keys of the join, without another shuffle
    return rows.join(ids, ["id", "high"]).groupBy("id", "high").agg(F.first("tokens").alias("tokens")).drop("high")


class Row:
    """A row of the token-group matrix: members, their tokens and the union of these."""

    def __init__(self, ids: list[int], tokens: list[np.ndarray]):
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids = np.array([ids[i] for i in order], np.int64)
        parts = [tokens[i] for i in order]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.tokens = np.concatenate([*parts, np.empty(0, np.uint64)])
        self.union = distinct(self.tokens)

    def bound(self, queries: Row) -> np.ndarray:
        """For each member of ``queries``, the most tokens it can share with any member here."""
        places = np.minimum(np.searchsorted(self.union, queries.tokens), max(len(self.union) - 1, 0))
        inside = (self.union[places] == queries.tokens) if len(self.union) else np.zeros(len(queries.tokens), bool)
        return np.diff(np.concatenate(([0], np.cumsum(inside)))[queries.starts])

    def some(self, wanted: np.ndarray) -> Row:
        kept = np.flatnonzero(wanted).tolist()
        return Row(self.ids[kept].tolist(), [self.tokens[self.starts[i]:self.starts[i + 1]] for i in kept])


def overlaps(left: Row, right: Row, width: int = 1 << 14) -> np.ndarray:
    """How many tokens each member of ``left`` shares with each of ``right``."""
    both = np.intersect1d(left.tokens, right.tokens)
    out = np.zeros((len(left.ids), len(right.ids)), np.float64)
    for at in range(0, len(both), width):
        columns = both[at:at + width]
        sides = []
        for row in (left, right):
            matrix = np.zeros((len(row.ids), len(columns)), np.float32)
            places = np.minimum(np.searchsorted(columns, row.tokens), len(columns) - 1)
            inside = columns[places] == row.tokens
            matrix[np.repeat(np.arange(len(row.ids)), row.sizes)[inside], places[inside]] = 1
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    return np.rint(out).astype(np.int64)


def linked(left: Row, right: Row, like: Likeness = LIKENESS) -> np.ndarray:
    """Which members of ``left`` and ``right`` are linked."""
    shared = overlaps(left, right)
    return like.under * shared >= like.over * (left.sizes[:, None] + right.sizes[None, :] - shared)


def opened(left: Row, right: Row, like: Likeness = LIKENESS) -> list[tuple[int, int]]:
    """Links between two groups: only queries whose bound allows one are compared with the members."""
    wanted = right.bound(left) * like.under >= like.over * left.sizes
    if not wanted.any():
        return []
    left = left.some(wanted)
    return [(int(left.ids[a]), int(right.ids[b])) for a, b in _forest(linked(left, right, like))]


def _forest(links: np.ndarray, same: bool = False) -> list[tuple[int, int]]:
    """Links enough to connect what ``links`` connects."""
    rows, columns = links.shape
    parent = list(range(rows + (0 if same else columns)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in np.argwhere(links).tolist():
        x, y = root(a), root(b + (0 if same else rows))
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


_EDGES = "a long, b long"


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def within(row: Row, like: Likeness) -> list[tuple[int, int]]:
    """Links inside one group."""
    return [(int(row.ids[a]), int(row.ids[b])) for a, b in _forest(linked(row, row, like), same=True)]


def _tokens_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(t, "<u8") for t in column.to_pylist()]


def _matrix_row(table: pa.Table) -> pa.Table:
    """One group as a row: ids, the union of their tokens, and the members' tokens as bits over the union.

    Members are mostly near copies, so that a row takes little more than the tokens of one of them.
    """
    coded = _coded_row(Row(table.column("id").to_pylist(), _tokens_of(table.column("tokens"))))
    kept = [c for c in table.column_names if c not in ("id", "tokens")]
    return pa.table([*(table.column(c)[:1] for c in kept), *(pa.array([c], pa.binary()) for c in coded)],
                    names=[*kept, "ids", "tokens", "bits"])


def _coded_row(row: Row) -> tuple[bytes, bytes, bytes]:
    """A row as ids, union and bits, members in order of id."""
    bits = np.zeros((len(row.ids), len(row.union)), bool)
    bits[np.repeat(np.arange(len(row.ids)), row.sizes), np.searchsorted(row.union, row.tokens)] = True
    return row.ids.astype("<i8").tobytes(), row.union.astype("<u8").tobytes(), pack(np.packbits(bits, 1), "u1")


def _row(ids: bytes, tokens: bytes, bits: bytes) -> Row:
    ids, union = np.frombuffer(ids, "<i8").tolist(), np.frombuffer(tokens, "<u8")
    members = np.unpackbits(unpack(bits, "u1").reshape(len(ids), -1), 1, len(union)).view(bool)
    return Row(ids, [union[row] for row in members])


def _grouped(members: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """``members`` with a column ``part`` that cuts what shares ``by`` into groups of bounded size.

    The totals are a written table, so that the join on ``by`` deals both sides out and a key of very many rows is split.
    """
    totals = members.join(sizes, "id").groupBy(*by).agg(F.count("*").alias("n"), F.sum("size").alias("t"))
    parts = F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("t") / TOKENS))
    return members.join(written(totals.select(*by, parts.alias("parts")), "totals"), by).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))


def _rarest(members: DataFrame, needs: DataFrame) -> DataFrame:
    """``members`` (sign, id) without the most frequent signatures, those one less than the set shares with any it is linked with.

    ``needs`` has id and needs. Signatures of one set only are not shared and go first.
    """
    counted = members.groupBy("sign").agg(F.count("*").alias("n")).where("n > 1")
    odd = F.col("sign").bitwiseAND(F.lit(1))
    rows = members.join(counted, "sign").join(needs, "id").select(
        "sign", "id", "n", odd.alias("odd"),
        F.when(odd == 1, F.shiftright("needs", 32)).otherwise(F.col("needs").bitwiseAND(F.lit((1 << 32) - 1))).alias("need"))
    by = Window.partitionBy("id", "odd").orderBy(F.desc("n"), F.desc("sign"))
    return rows.withColumn("at", F.row_number().over(by)).where("at >= need").select("sign", "id")


def _together(met: DataFrame) -> DataFrame:
    """Signatures around one document taken as one (sign -1) where this makes fewer pairs of groups.

    Groups that share many of them then meet once; what is compared holds all that shares one of the signatures.
    """
    apart = met.groupBy("around", "sign").agg(F.count("*").alias("g")).groupBy("around").agg(F.sum(F.col("g") * F.col("g")).alias("apart"))
    groups = met.select("around", "name").distinct().groupBy("around").agg(F.count("*").alias("g"))
    fewer = apart.join(groups, "around").where("g * g < apart").select("around", F.lit(-1).cast("long").alias("as"))
    rows = met.join(fewer, "around", "left").withColumn("sign", F.coalesce("as", "sign"))
    return rows.groupBy("around", "sign", "label", "name").agg(
        F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"), F.min("low").alias("low"), F.max("high").alias("high")
    ).withColumn("n", F.size("ids").cast("long"))


def links(docs: DataFrame, like: Likeness = LIKENESS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, size) of every row, (id, rep) of every id and the links (a, b) that connect what is connected.

    ``docs`` has id (long) and text. The representative of a document is the smallest id with
    an equal set; links are between representatives.
    """
    if not (like.words > 0 and 0 < like.over < like.under):
        raise ValueError(f"no width and similarity between 0 and 1: {like}")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size * (like.under - like.over) / (2 * like.under) / BUCKET))
    passed = written(_passed(docs, buckets, like), "signatures")
    sets = written(_sets(passed), "sets")
    one = sets.groupBy("id").agg(F.max(F.struct("size", "high", "low", "needs")).alias("s")).select("id", "s.*")
    owners = written(one.groupBy("high", "low").agg(F.min("id").alias("rep")), "owners")  # the join can be split
    one = one.join(owners, ["high", "low"])
    named = sets.select("number", "high", "low").join(owners, ["high", "low"]).select("number", F.col("rep").alias("id"))
    one = written(one.select("id", "size", "high", "needs", F.when(F.col("size") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep")), "sets")
    # Members of shared signatures, as representatives; signatures of one set only are no blocks.
    # A set that stands for no id has no representative.
    members = written(_shared(passed).join(named, "number").select("sign", "id").distinct(), "members")
    forget(passed)
    every, members = members, written(_rarest(members, one.where("id = rep").select("id", "needs")), "members")
    forget(every)
    spans = members.groupBy("sign").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last")
    blocks = written(members.join(spans.select("sign", "leader"), "sign"), "blocks")
    sizes = one.where("id = rep").select("id", "size", "high")
    around = blocks.groupBy("id").agg(F.min("leader").alias("leader"))
    tokens = written(_tokens(docs, sizes.join(around, "id", "left_semi").select("id", "high"), like.words), "tokens")
    sizes = sizes.select("id", "size")
    forget()

    # Each group against itself and its leader.
    homes = written(_grouped(around, sizes, ["leader"]).select("id", "leader", "part"), "groups")
    inside = homes.unionByName(homes.select(F.col("leader").alias("id"), "leader", "part").distinct()).distinct()

    def own_links(table: pa.Table) -> pa.Table:
        return _edges(within(Row(table.column("id").to_pylist(), _tokens_of(table.column("tokens"))), like))

    own = inside.join(tokens, "id").groupBy("leader", "part").applyInArrow(own_links, _EDGES)
    own = written(own, "links")
    forget()

    # Groups that share a signature and are not connected yet. A label that fills a group by itself
    # has groups of its own, which need not be compared with each other; what is left of a
    # leader's documents shares groups, which are compared with themselves as well.
    labels = components(own)
    labelled = homes.select("id", "leader").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))  # the component so far
    labelled = written(labelled, "labelled")
    alike = written(labelled.groupBy("leader", "label").agg(F.count("*").alias("alike")), "alike")
    labelled = labelled.join(alike, ["leader", "label"]).select(
        "id", "leader", F.col("label").alias("linked"), F.when(F.col("alike") >= MEMBERS, F.col("label")).alias("label"))
    named = _grouped(labelled.withColumn("kind", F.coalesce(F.col("label").cast("string"), F.lit("rest"))), sizes, ["leader", "kind"])
    named = written(named.select("id", "label", "linked", F.concat_ws("/", "leader", "kind", "part").alias("name")), "named")
    met = blocks.select("sign", F.col("leader").alias("around"), "id").join(named, "id").groupBy("sign", "around", "label", "name").agg(
        F.count("*").alias("n"), F.collect_list("id").alias("ids"),  # of a group, which is bounded
        F.min("linked").alias("low"), F.max("linked").alias("high"))
    met = written(met, "met")
    forget(blocks, members)
    # what shares a signature and is all connected needs no comparison
    open_ = met.groupBy("sign").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("sign")
    met = met.join(open_, "sign", "left_semi")
    itself = met.where("label is null and low < high").select("name", F.lit(True).alias("itself"), F.lit(False).alias("paired"))
    met = written(_together(met), "met")
    # Of one signature, all groups but those of its most frequent label are compared with all others.
    key = ["around", "sign"]
    most = met.where("label is not null").groupBy(*key, "label").agg(F.sum("n").alias("n")).groupBy(*key).agg(
        F.max_by("label", F.struct("n", "label")).alias("main"))
    every = met.join(most, key, "left").select(
        *key, "label", "name", "ids", "low", "high", F.coalesce(F.col("label") == F.col("main"), F.lit(False)).alias("main"))
    rest = every.where("not main").drop("main")
    pairs = rest.toDF(*key, "l1", "one", "ids1", "low1", "high1").join(
        every.toDF(*key, "l2", "two", "ids2", "low2", "high2", "main"), key).where(
        "(main or one < two) and (l1 is null or l2 is null or l1 <> l2) and least(low1, low2) < greatest(high1, high2)")
    # of two groups only the members that share a signature with the other one can be linked across
    turn = F.col("one") > F.col("two")
    sides = [F.struct(F.col(g).alias("name"), F.col(i).alias("ids")) for g, i in (("one", "ids1"), ("two", "ids2"))]
    pairs = pairs.select(F.when(turn, sides[1]).otherwise(sides[0]).alias("a"), F.when(turn, sides[0]).otherwise(sides[1]).alias("b"))
    pairs = pairs.groupBy(F.col("a.name").alias("one"), F.col("b.name").alias("two")).agg(
        *[F.array_distinct(F.flatten(F.collect_set(x))).alias(n) for x, n in (("a.ids", "ids1"), ("b.ids", "ids2"))])
    pairs = written(pairs, "pairs")
    # groups that are compared with themselves need no join, and of two groups the one with fewer tokens goes to the other
    used = pairs.select(F.col("one").alias("name")).union(pairs.select("two")).select(
        "name", F.lit(False).alias("itself"), F.lit(True).alias("paired")).union(itself)
    used = used.groupBy("name").agg(F.max("itself").alias("itself"), F.max("paired").alias("paired"))
    matrix = named.select("id", "name").join(used, "name").join(tokens, "id").groupBy("name", "itself", "paired").applyInArrow(
        _matrix_row, "name string, itself boolean, paired boolean, ids binary, tokens binary, bits binary")
    matrix = written(matrix, "matrix")
    forget(tokens)

    def alone(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _edges(within(_row(*row), like)).to_batches()

    def cut(batches):
        for batch in batches:
            rows = []
            for wanted, *row in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                part = _row(*row)
                rows.append(_coded_row(part.some(np.isin(part.ids, wanted))))
            columns = [pa.array(c, pa.binary()) for c in zip(*rows, strict=True)] or [pa.array([], pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["two", "ids2", "ids", "tokens", "bits"])

    def compare(batches):
        for batch in batches:
            for wanted, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, right = _row(*row[:3]), _row(*row[3:])
                right = right.some(np.isin(right.ids, wanted))
                if len(left.ids) > len(right.ids):
                    left, right = right, left
                yield from _edges(opened(left, right, like)).to_batches()

    inner = map_batches(matrix.where("itself").select("ids", "tokens", "bits"), alone, _EDGES)
    matrix = matrix.where("paired")
    size = matrix.select("name", F.length("tokens").alias("size"))
    pairs = pairs.join(size.toDF("one", "size1"), "one").join(size.toDF("two", "size2"), "two")
    first = F.col("size1") <= F.col("size2")
    one_of = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    pairs = pairs.select(one_of("one", "two").alias("one"), one_of("two", "one").alias("two"),
                         one_of("ids1", "ids2").alias("ids1"), one_of("ids2", "ids1").alias("ids2"))
    coded = matrix.select("name", "ids", "tokens", "bits")
    half = pairs.join(coded.withColumnRenamed("name", "one"), "one").select("two", "ids2", "ids1", "ids", "tokens", "bits")
    half = map_batches(half, cut, "two string, ids2 array<long>, ids binary, tokens binary, bits binary")
    both = half.join(coded.toDF("two", "ids_two", "tokens_two", "bits_two"), "two").drop("two")
    across = map_batches(both, compare, _EDGES)
    return sets.select("id", "size"), one.select("id", "rep"), own.unionByName(inner).unionByName(across)


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = LIKENESS) -> DataFrame:
    """Per row of ``docs``: id, n_shingles and component_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets, one, found = links(rows, like)
    labels = components(found).withColumnRenamed("id", "rep")
    per_id = one.join(labels, "rep", "left").select("id", F.coalesce("label", "rep").alias("component_id"))
    kind = docs.schema[id_col].dataType.simpleString()
    known = sets.join(per_id, "id")

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens_of(t.as_py(), like.words)) for t in batch.column(0)], pa.int64())], names=["size"])

    nameless = map_batches(rows.where("id is null").select("text"), count, "size long").select(
        F.lit(None).cast("long").alias("id"), "size", F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(nameless).select(
        F.col("id").cast(kind).alias(id_col), F.col("size").alias("n_shingles"), F.col("component_id").cast(kind))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = LIKENESS) -> DataFrame:
    """The rows of ``docs``, all columns kept, but one document of each component: the one of smallest id.

    Rows of null id and of empty sets are all kept.
    """
    found = joined(docs, id_col, text_col, like)
    lost = found.where(F.col(id_col).isNotNull() & (F.col("component_id") < F.col(id_col))).select(
        F.col(id_col).alias("__lost")).distinct()
    return docs.join(lost, F.col(id_col) == F.col("__lost"), "left_anti")
