from __future__ import annotations

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm import codes
from logloom.llm.queries import WORD_BPE
from tests.llm.texts import SCHEMA, documents, rows_of

LIBRARY = Tokenizer.from_file(WORD_BPE)
LIBRARY.encode_special_tokens = True
WORDS = codes.Words(open(WORD_BPE, encoding="utf-8").read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbÉß×,.Σς't  \t\n ́ \x1c\x85éİ漢12!?<|endoftx>"), max_size=40), max_size=3))
def test_equal_to_library(texts):
    want = [LIBRARY.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [x.tolist() for x in WORDS.encode(texts, 2)] == want


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=50))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert WORDS.encode([text], 2)[0].tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 255, 256, 257, 65_535, 65_536, 49_407, 2**32 - 1]), max_size=3000), st.data())
def test_any_id_is_read_directly(ids, data):
    opened = codes.Codes(codes.to_bytes([7], [len(ids)], np.array(ids, np.uint32)))
    assert opened.document(0).tolist() == ids
    if ids:
        start = data.draw(st.integers(0, len(ids) - 1))
        stop = data.draw(st.integers(start + 1, len(ids)))
        assert opened.ids(start, stop).tolist() == ids[start:stop]


def brute(docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*LIBRARY.encode(text, add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_files_hold_all_documents_in_order(spark):
    docs = documents(spark).withColumnRenamed("source", "start")
    for size in (500, codes.FILE_IDS):
        files = codes.write_files(docs, WORD_BPE, 2, file_ids=size)
        assert rows_of(codes.read_files(files)) == brute(docs)
    assert codes.write_files(docs, WORD_BPE, 2, file_ids=500).count() > 10


def test_empty_table(spark):
    files = codes.write_files(spark.createDataFrame([], SCHEMA), WORD_BPE, 2)
    assert codes.read_files(files).collect() == []


def test_words_are_numbered_in_one_pass_and_learned_once():
    words = codes.Words(open(WORD_BPE, encoding="utf-8").read())
    texts = ["new words, new words", "words again", ""]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in words.encode(texts, 2)] == want
        assert len(words.index) == len(words.starts) - 1 == 4 and words.index.new == []
