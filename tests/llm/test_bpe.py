"""Byte-level BPE against the library of the rank file's format, and exact round trips."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import bpe, tables, words
from tessella.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def settings_of_text(spark):
    tables.prepared(spark)


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    import tiktoken

    ranks = bpe.vocabulary(bpe.default_vocabulary()).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts, size=words.CHUNK):
    out, v = [], bpe.vocabulary(bpe.default_vocabulary())
    for chunk in words.chunks(pa.array(texts, pa.string()), size):
        ids, place, per_doc = v.encode(chunk)
        ends = np.cumsum(per_doc)
        out += [ids[a:b].tolist() for a, b in zip(ends - per_doc, ends)]
        assert v.decode(ids.astype(np.int64), place, per_doc) == [chunk.data[a:b].tobytes() for a, b in zip(chunk.starts, chunk.stops)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAsdmtrevl''  \n\t1²é漢,.🙂  ")), max_size=8), st.integers(1, 40))
def test_ids_are_those_of_the_library(plain, texts, size):
    assert ids_of(texts, size) == [plain.encode_ordinary(t) for t in texts]


def test_any_text(plain):
    r = random.Random(5)
    texts = [chr(c) for c in range(0, 0x110000, 61) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1 {c}" for c in texts] + ["it's we'll they've I'd you're 's 'll ''s x'ss 'l 'r e's\n's  's"] + ["".join(map(chr, r.choices(range(1, 0x3000), k=50))) for _ in range(300)]
    assert ids_of(texts) == plain.encode_ordinary_batch(texts)


def test_long_pieces(plain):
    r = random.Random(1)
    texts = [" " * 5000, "ab" * 3000, "".join(r.choices("abcde", k=20_000)), "=" * 777, "\n" * 100 + "x"]
    assert ids_of(texts) == [plain.encode_ordinary(t) for t in texts]
    v = bpe.vocabulary(bpe.default_vocabulary())
    for t in ("".join(r.choices("etaoin ", k=60)) for _ in range(200)):
        assert v._joined(t.encode()) == v._joined_by_heap(t.encode())


def test_blocks_compose_to_a_plain_walk():
    r = np.random.default_rng(0)
    for n in (1, 2, 17, 1000, 5000):
        kind = r.integers(0, 16, n)
        kind[0] = bpe.FIRST
        state, want = bpe.FRESH, []
        for k in kind:
            want.append(state)
            state = bpe.THEN[k, state]
        assert bpe.scan(kind).tolist() == want


def test_awkward_rows_and_columns(spark, plain):
    texts = [None, "", " ", "twice", "twice", "no id", "w1 " * 50_000, "ß   é x", "é"]
    ids = [0, 1, 2, 3, 3, None, 5, 6, 7]
    rows = [(i, t, [1], b"x", "m", 3) for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded binary, `meta.url` string, n_tokens int")
    found = bpe.encode_documents(docs)
    assert sorted((str(r.doc_id), r.ids) for r in found.collect()) == sorted((str(i), plain.encode_ordinary(t or "")) for i, t in zip(ids, texts))
    for r in found.collect():
        sizes = [len(plain.decode_single_token_bytes(i)) for i in r.ids]
        assert r.offsets == [sum(sizes[:k]) for k in range(len(sizes))] or len(sizes) > 1000
    back = bpe.decode_documents(found.selectExpr("*", "1 AS decoded", "2 AS `meta.url`")).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode(), r.n_tokens) for r in back) == sorted((str(i), t or "", len(plain.encode_ordinary(t or ""))) for i, t in zip(ids, texts))
    assert bpe.encode_documents(docs.limit(0)).count() == 0 and bpe.decode_documents(found.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None)], "doc_id long, ids array<int>, offsets array<int>")
    assert [tuple(r) for r in bpe.decode_documents(empty).collect()] == [(1, 0, b"", b"")]


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT 2L, 'fine'")
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode_documents(bpe.encode_documents(docs)).collect()}
    assert back == {1: "a�b", 2: "fine"}


def test_query(spark, plain):
    got = {r.doc_id: r for r in QUERIES["op13_bpe"](spark, SF).collect()}
    docs = tables.table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = plain.encode_ordinary(d.text or ""), got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
