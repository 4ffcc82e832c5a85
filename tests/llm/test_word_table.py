"""Encoding and decoding by word tables against the tokenizers library."""

import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from tessera.llm import common, queries, word_table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = [
    None,
    "",
    " ",
    "  a  b ",
    "Tab\there\r\nline\n\nend\x0b\x0c\x1c\x85 x y z",
    "don't WE'LL it's 'til ''s",
    "<|endoftext|> in<|startoftext|>side <|endoftext |> <|EndOfText|>",
    "é ́ ÀÉÎ ß ΣΑΣ İstanbul ﬁ ½ １２３ 日本語 🙂👩‍👩‍👧 ​",
    "no spaces" + "x" * 5000,
    "word " * 30_000,
    "12,345.67e-8 a_b-c/d @ # $$$",
    "\x00 nul",
]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def rows(spark):
    texts = [*enumerate(TRICKY), (3, TRICKY[3]), (None, "no id"), (None, "no id")]
    return spark.createDataFrame([(*r, "x", [1]) for r in texts], "doc_id long, text string, WORDS string, ids array<int>"), texts


def test_encode_and_decode_equal_the_library(spark, library):
    df, texts = rows(spark)
    want = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t in texts]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    coded = common.cut(word_table.encode(df, PATH))
    assert sorted(((r.doc_id, r.ids) for r in coded.collect()), key=key) == sorted(want, key=key)
    got = sorted(((r.doc_id, r.text) for r in word_table.decode(coded, PATH).collect()), key=key)
    assert got == sorted(((d, library.decode(i, skip_special_tokens=False)) for d, i in want), key=key)


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    """All parts of all blocks through one mapper: what the library is given are the distinct words."""
    df, texts = rows(spark)
    monkeypatch.setattr(word_table, "BLOCK_WORDS", 20)
    size = spark.conf.get(common.BATCH_ROWS)
    spark.conf.set(common.BATCH_ROWS, "2")
    try:
        made = word_table.blocks(df.repartition(2))
        parts = made.selectExpr("block", "posexplode(parts) AS (part, words)").where("words IS NOT NULL").toArrow().combine_chunks()
    finally:
        spark.conf.set(common.BATCH_ROWS, size)
    assert made.count() >= 4
    given = []

    class Library:
        def encode_batch(self, words, add_special_tokens):
            given.extend(words)
            return [type("Coded", (), {"ids": [len(w)]}) for w in words]

    monkeypatch.setattr(word_table, "library", lambda path: Library())
    run = word_table._coded(PATH, common.arrow_schema(spark, word_table.CODED))
    n = sum(len(word_table.unpacked_numbers(b.column(2)[0].as_py())) for b in run(iter(parts.to_batches())))
    words = {w for _, t in texts for w in (t or "").translate({9: 32, 10: 32, 13: 32}).split(" ")}
    assert sorted(given) == sorted(words) and n > len(words)


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_bpe_word_table(spark, SF).collect()}
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == want


def test_small_batches_make_blocks_of_their_own(spark, library):
    size = spark.conf.get(common.BATCH_ROWS)
    spark.conf.set(common.BATCH_ROWS, "2")
    try:
        df, texts = rows(spark)
        got = word_table.digests(df.repartition(3), PATH).collect()
    finally:
        spark.conf.set(common.BATCH_ROWS, size)
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in texts)
    assert sorted(r.n_tokens for r in got) == want


def test_odd_ids_and_empty_tables(spark, library):
    df = spark.createDataFrame([(1, None), (2, []), (3, [320, None, 9_000_000, -5, 49407]), (3, [320])], "doc_id long, ids array<int>")
    got = sorted((r.doc_id, r.text) for r in word_table.decode(df, PATH).collect())
    assert got == sorted([(1, ""), (2, ""), (3, library.decode([320, 9_000_000, 49407], skip_special_tokens=False)), (3, library.decode([320], skip_special_tokens=False))])
    docs, _ = rows(spark)
    assert word_table.decode(df.limit(0), PATH).count() == 0 and word_table.digests(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        word_table.decode(df, public_tokenizers.path("byte_bpe_50k.json"))


def test_decoding_holds_the_characters_of_some_documents_at_a_time():
    pieces = word_table.Pieces(PATH)
    ids = np.tile(np.arange(1000, 6000, dtype=np.uint32), 200)
    edges = np.arange(0, len(ids) + 1, 500)
    tracemalloc.start()
    n = sum(len(x) + 1 for x in pieces.texts(ids, edges))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == pieces.size[ids].sum()
    assert most < 30e6
    uneven = np.array([0, 0, 120_000, 120_000, 120_001, 400_000, 400_000])
    assert [len(x) for x in pieces.texts(ids, uneven)] == [max(0, int(pieces.size[ids[a:b]].sum()) - 1) for a, b in zip(uneven, uneven[1:])]
