from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import graph, jaccard
from tests.llm.texts import SCHEMA, documents, rows_of, sentence


def shingles(text, width=3):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows, like=jaccard.LIKENESS):
    sets = [(r.doc_id, shingles(r.text, like.words)) for r in rows]
    best = {}
    for i, s in sets:
        if i is not None and (i not in best or len(s) > len(best[i])):
            best[i] = s
    label = {i: i for i in best}
    ids = sorted(best)
    changed = True
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
             if best[a] and like.under * len(best[a] & best[b]) >= like.over * len(best[a] | best[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return sorted(((i, len(s), label.get(i)) for i, s in sets), key=repr), len(pairs)


@settings(max_examples=200, deadline=None)
@given(st.integers(9, 3000), st.integers(0, 10**6))
def test_linked_sets_share_a_signature(size, seed):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**64, size, np.uint64, endpoint=False))
    differ = int(rng.integers(0, len(base) // 9 + 1))
    gone = int(rng.integers(0, differ + 1))
    other = np.unique(np.concatenate([rng.permutation(base)[gone:], rng.integers(0, 2**64, differ - gone, np.uint64)]))
    shared = len(np.intersect1d(base, other))
    if 10 * shared >= 9 * (len(base) + len(other) - shared) and len(base) != shared:
        assert set(jaccard.signatures(base).tolist()) & set(jaccard.signatures(other).tolist())


@settings(max_examples=400, deadline=None)
@given(st.integers(4, 3000), st.integers(0, 10**6), st.sampled_from([(4, 5), (9, 10), (3, 5), (1, 2), (9, 13)]))
def test_linked_sets_share_a_signature_at_any_similarity(size, seed, fraction):
    over, under = fraction
    like, rng = jaccard.Likeness(5, over, under), np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**64, size, np.uint64, endpoint=False))
    differ = int(len(base) * (under - over) // over * rng.choice([1, 1, rng.random()]))
    gone = int(differ * rng.choice([0, 0.5, 1, rng.random()]))
    other = np.unique(np.concatenate([rng.permutation(base)[gone:], rng.integers(0, 2**64, differ - gone, np.uint64)]))
    shared = len(np.intersect1d(base, other))
    if under * shared >= over * (len(base) + len(other) - shared) and not len(base) == len(other) == shared:
        assert set(jaccard.signatures(base, like).tolist()) & set(jaccard.signatures(other, like).tolist())


def test_sets_without_common_tokens_share_no_signature():
    rng, seen = np.random.default_rng(5), set()
    for size in [*range(40, 60), *range(1000, 1300, 10), 20_000, 24_990, 25_000]:
        signs = set(jaccard.signatures(np.unique(rng.integers(0, 2**64, size, np.uint64)), jaccard.Likeness(5, 4, 5)).tolist())
        assert not signs & seen
        seen |= signs


def near(first, changes, rows=90, words=120):
    """One cluster of texts with a few words changed each, with similarities around the limit."""
    rng = random.Random(first)
    base = sentence(rng, words, 10**6).split()
    out = []
    for i in range(rows):
        text = list(base)
        for _ in range(rng.randint(0, changes)):
            text[rng.randrange(len(text))] = f"z{rng.randrange(10**6)}"
        out.append((first + i, " ".join(text)))
    return out


def chain(first):
    """Each text differs from the one before by three words only, the last from the first by far more."""
    words, out = sentence(random.Random(first), 200, 10**6).split(), []
    for i in range(12):
        words[i * 12:i * 12 + 3] = [f"c{i}a", f"c{i}b", f"c{i}c"]
        out.append((first - i, " ".join(words)))
    return out


def everything(spark):
    rng = random.Random(9)
    a, b = sentence(rng, 40, 10**6), sentence(rng, 60, 10**6)
    rows = near(1000, 2) + near(2000, 4) + near(3000, 8) + chain(4100)
    rows += [(5001, a), (5002, b), (5002, a), (5003, b), (5003, b), (5004, a)]  # different texts of one id
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    return documents(spark, rows=200).unionByName(more).repartition(4).withColumnRenamed("source", "component_id")


def test_equal_to_brute_force(spark, monkeypatch):
    docs = everything(spark)
    want, pairs = brute(docs.collect())
    labels = {w[0]: w[2] for w in want}
    assert pairs > 2000 and {labels[4100 - i] for i in range(12)} == {4089}
    assert 3 < len({labels[i] for i in range(2000, 2090)}) < 90
    assert rows_of(jaccard.joined(docs)) == want
    # stretches, buckets and groups of a few rows
    for name, size in (("GATHER", 300), ("BUCKET", 200), ("MEMBERS", 4)):
        monkeypatch.setattr(jaccard, name, size)
    assert rows_of(jaccard.joined(docs)) == want


def test_sets_of_repeated_ids_stand_for_other_ids(spark):
    rng = random.Random(31)
    small, large = sentence(rng, 100, 10**6), sentence(rng, 150, 10**6)
    close = " ".join(["x", *small.split()[1:]])
    rows = [(10, small), (10, large), (20, small), (30, close), (40, large + " y")]  # in one stretch, in this order
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).coalesce(1)
    want, _ = brute(docs.collect())
    assert {(w[0], w[2]) for w in want} == {(10, 10), (20, 20), (30, 20), (40, 10)}
    assert rows_of(jaccard.joined(docs)) == want


def test_bounds_open_only_groups_that_can_hold_a_link():
    rng = np.random.default_rng(1)
    draw = lambda n: np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False))
    base = draw(100)
    rows = [jaccard.Row(list(range(k, k + 3)), [np.union1d(base[i:90 + i], draw(extra)) for i in range(3)])
            for k, extra in ((0, 1), (10, 1), (20, 80))]
    for left in rows:
        for right in rows:
            links = jaccard.linked(left, right)
            shared = [[len(np.intersect1d(left.tokens[left.starts[a]:left.starts[a + 1]], right.tokens[right.starts[b]:right.starts[b + 1]]))
                       for b in range(3)] for a in range(3)]
            assert jaccard.overlaps(left, right, width=7).tolist() == shared
            assert (right.bound(left)[:, None] >= shared).all()
            assert bool(links.any()) == bool(jaccard.opened(left, right))
    assert not jaccard.opened(rows[2], rows[0])


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)]
    edges += [(500, i) for i in range(600, 700)] + [(7, 7)]
    parent = {n: n for e in edges if e[0] != e[1] for n in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark, seed=2)
    want = {(w[0], w[1]) for w in brute(docs.collect())[0] if w[0] is None or w[2] == w[0]}
    kept = jaccard.one_of_each(docs.withColumnRenamed("lang", "rep"))
    assert kept.columns == ["doc_id", "text", "rep", "source", "n_chars"]
    assert {(r.doc_id, len(shingles(r.text))) for r in kept.collect()} == want


def test_empty_table(spark):
    assert jaccard.joined(spark.createDataFrame([], SCHEMA)).collect() == []


def test_matrix_rows_and_signatures_come_back_from_their_codes():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**64, 900, np.uint64)
    sets = [np.unique(rng.choice(base, size)) for size in (1, 7, 300, 800)] + [np.unique(rng.integers(0, 2**64, 50, np.uint64))]
    coded = jaccard._matrix_row(pa.table({"name": ["g"] * 5, "itself": [False] * 5, "id": [9, 3, 7, 1, 5], "tokens": [s.tobytes() for s in sets]}))
    row = jaccard._row(*(coded.column(c)[0].as_py() for c in ("ids", "tokens", "bits")))
    want = jaccard.Row([9, 3, 7, 1, 5], sets)
    assert all((getattr(row, f) == getattr(want, f)).all() for f in ("ids", "sizes", "starts", "tokens", "union"))
    for high, spread, count in ((1 << 48, 70_000, 3000), (1 << 20, 5, 40), (1 << 48, 1, 1)):
        signs = np.sort(rng.integers(0, high, count).astype(np.uint64))
        numbers = (7 << 33) + rng.integers(0, spread, count)
        first, *rest = jaccard._coded(signs, numbers)
        back = jaccard._decoded(first, *rest)
        assert (back[0] == signs).all() and (back[1] == numbers).all()


def test_rarest_signatures_that_a_linked_pair_must_share_are_enough():
    like, rng = jaccard.Likeness(5, 4, 5), np.random.default_rng(3)
    for size in (40, 300, 331, 2000):
        base = np.unique(rng.integers(0, 2**64, size, np.uint64))
        for gone in range(0, len(base) // 5 + 1, max(1, size // 40)):
            sets = base, base[gone:]
            (one, need), (two, other) = (jaccard._signatures(x, like) for x in sets)
            shared = set(one.tolist()) & set(two.tolist())
            count = [sum(x >> 16 & 1 == odd for x in shared) for odd in (0, 1)]
            few = [max(n >> 32 * odd & 0xffffffff for n in (need, other)) for odd in (0, 1)]
            assert not gone or any(c >= f for c, f in zip(count, few, strict=True))  # in the class where they meet


def test_the_most_frequent_signatures_are_dropped(spark):
    members = spark.createDataFrame([(2, i) for i in (1, 2, 3, 4)] + [(4, 1), (4, 2), (6, 1), (6, 2), (3, 1), (3, 4), (5, 1)], "sign long, id long")
    needs = spark.createDataFrame([(1, 3 | 1 << 32), (2, 2 | 1 << 32), (3, 2 | 1 << 32), (4, 1 | 2 << 32)], "id long, needs long")
    got = {tuple(r) for r in jaccard._rarest(members, needs).collect()}
    assert got == {(4, 1), (3, 1), (6, 2), (4, 2), (2, 4)}


def test_groups_that_share_many_signatures_meet_once(spark):
    met = [(s, 1, None, n, [10 * k], k, k) for s in range(40) for k, n in enumerate("abcde")]  # five groups share forty signatures
    met += [(100 + s, 2, None, f"{s}{n}", [s], s, s) for s in range(30) for n in "xy"]  # many groups, each sharing one
    rows = spark.createDataFrame(met, "sign long, around long, label long, name string, ids array<long>, low long, high long")
    got = jaccard._together(rows).collect()
    assert sorted((r.sign, r.name, r.ids) for r in got if r.around == 1) == [(-1, n, [10 * k]) for k, n in enumerate("abcde")]
    assert sorted((r.sign, r.name) for r in got if r.around == 2) == sorted((m[0], m[3]) for m in met if m[1] == 2)
