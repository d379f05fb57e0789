import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.awkward import ROWS, docs
from weftlink.llm import registry
from weftlink.llm.bpe import BpeParams, Encoder, _fold_long, decode_column, encode, fold_words, load_ranks, slices

P = BpeParams(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, table_size=300, cache=50)


@pytest.fixture(scope="module")
def enc():
    return Encoder(P)


@pytest.fixture(scope="module")
def lib(enc):
    return tiktoken.Encoding("own", pat_str=P.pattern, mergeable_ranks=enc.ranks, special_tokens={})


def ids(raw):
    return [int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("abst E'é\n\t  .,1　́中\x00\x1c\x85▁\U0001f600"), max_size=40))
def test_ids_equal_the_librarys(enc, lib, text):
    assert ids(enc.ids(text)) == lib.encode_ordinary(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abst E'é\n\t  .,1　́中\x00\x1c\x85▁\U0001f600"), max_size=20), max_size=5))
def test_ids_of_many_texts_equal_the_librarys(enc, lib, texts):
    counts, found = enc.many(pa.array(["", *texts, ""]).slice(1, len(texts)) if texts else pa.array([], pa.string()))
    assert [len(lib.encode_ordinary(t)) for t in texts] == counts.tolist()
    assert [i for t in texts for i in lib.encode_ordinary(t)] == found.tolist()


def test_slices():
    assert list(slices(pa.array(["ab", "", "cdefg", "h", "i", ""]), 2)) == [(0, 2), (2, 3), (3, 6)]
    assert list(slices(pa.array([], pa.string()), 2)) == []


def test_every_code_point(enc, lib):
    every = [f"a{chr(c)}b {chr(c)}1{chr(c)}  {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for texts in ([t for t in every if t[1].isspace()], [t for t in every if not t[1].isspace()]):
        counts, found = enc.many(pa.array(texts))
        want = [lib.encode_ordinary(t) for t in texts]
        assert counts.tolist() == [len(x) for x in want] and found.tolist() == [i for x in want for i in x]


def test_folds_agree_with_the_library(spark, enc, lib):
    words = ["a", " the", "zukeitpf", " étrech", "中文字", "\U0001f600", "x" * 300, "aaaaaaab", " 12345", "...!!", "\n\n", "abcdefgh" * 7]
    want = {w: lib._core_bpe.encode_single_piece(w.encode()) for w in words}
    assert {w: ids(x) for w, x in zip(words, enc.fold(words))} == want
    assert {w: _fold_long(w.encode(), enc.ranks) for w in words} == want
    got = fold_words(spark.createDataFrame([(w,) for w in [*words, ""]], "word string"), enc.ranks).collect()
    assert {r.word: r.ids for r in got} == want | {"": []}


def test_awkward_documents_round_trip(spark, enc, lib):
    out = encode(docs(spark), P).withColumn("back", decode_column(F.col("ids"), enc.ranks)).collect()
    assert sorted((str(r.doc_id), r.ids, bytes(r.back)) for r in out) == sorted((str(i), lib.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in ROWS)
    assert encode(docs(spark, []), P).collect() == []
    assert spark.range(1).select(decode_column(F.array(F.lit(60_000)), enc.ranks)).head()[0] is None


def test_query(spark, sf_dir, lib):
    got = {r.doc_id: r for r in registry.op3_byte_level_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        own = lib.encode_ordinary(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
