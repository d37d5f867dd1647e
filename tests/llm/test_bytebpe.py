from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import bytebpe
from logloom.llm.queries import RANK_FILE
from tests.llm.texts import SCHEMA, documents, rows_of

RANKS = bytebpe.read_ranks(RANK_FILE)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PATTERN = regex.compile(public_tokenizers.PATTERN)
REPLAY = bytebpe.Replay(RANKS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aabet 'sédntiong\n\t漢1!ſ̈  <|>"), max_size=80), max_size=4))
def test_equal_to_library(texts):
    got = REPLAY.encode(PATTERN, texts)
    assert [g.tolist() for g in got] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [REPLAY.decode(g).decode() for g in got] == texts


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert REPLAY.encode(PATTERN, [text])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_stretches_cut_no_match(monkeypatch):
    text = "the  quick   fox\n\n jumps " * 40 + " " * 90 + "a" * 70 + "!?" * 50
    monkeypatch.setattr(bytebpe, "STRETCH", 7)
    assert [w for part in bytebpe.pieces(PATTERN, text) for w in part] == PATTERN.findall(text)


def test_lower_rank_after_a_merge_is_settled_alone():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"aab": 258, b"ab": 300}
    own = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    replay, pattern = bytebpe.Replay(ranks), regex.compile(r"\S+|\s+")
    for text in ("abc", "aabc", "aabcabc bcbc aab", "ababab"):
        assert replay.encode(pattern, [text])[0].tolist() == own.encode_ordinary(text)


def test_digests_and_round_trip(spark):
    docs = documents(spark).withColumnRenamed("lang", "n_tokens")
    want = sorted(((r.doc_id, len(ids := LIBRARY.encode_ordinary(r.text or "")),
                    hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()), key=repr)
    assert rows_of(bytebpe.digests(docs, RANK_FILE, public_tokenizers.PATTERN)) == want
    tokens = bytebpe.encoded(docs, RANK_FILE, public_tokenizers.PATTERN)
    back = bytebpe.decoded(tokens, RANK_FILE)
    assert rows_of(back.selectExpr("doc_id", "cast(bytes as string)")) == rows_of(docs.selectExpr("doc_id", "coalesce(text, '')"))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bytebpe.digests(none, RANK_FILE, public_tokenizers.PATTERN).collect() == []
