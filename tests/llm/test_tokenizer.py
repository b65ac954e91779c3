"""Encoding against the library the vocabulary was made for, and exact round trips."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from volspark.llm import tokenizer

NASTY = [
    "",
    None,
    " ",
    "\n\n  \t\n",
    "it's we'll I'D  two  spaces nbsp",
    "<|endoftext|> is text",
    "naïve café Ünïcode ÿ",
    "🔥😍👍" * 700,
    "a" * 3000,
    "a" * 100_001,
    "".join(random.Random(3).choices("acgt", k=30_000)),
    "".join(random.Random(4).choices("ab", k=2000)),
    "また買いたいと思います。" * 40,
    "é ​﻿­ zero width",
    "123456789 ١٢٣ ½ ²",
    "\x00\x01\x85  ",
    "=====----=====",
    "x" + " " * 500 + "y",
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    random.seed(5)
    signs = "abcdeEÉñß中の🔥⭐ .,!?'\n\t0123"
    return NASTY + ["".join(random.choices(signs, k=random.randrange(1, 80))) for _ in range(150)]


def test_ids_equal_the_librarys_and_decode_gives_the_text_back(spark, library):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k1 string, ids int")
    out = tokenizer.encode(df).withColumn("back", tokenizer.decode(F.col("ids"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == library.encode_ordinary(r.text or ""), repr(r.text)[:80]
        assert r.back == (r.text or "")
        assert r.k1 == "clash"


def test_repeated_rows_and_empty_tables(spark, library):
    df = spark.createDataFrame([(1, "zyxwvut qqq"), (1, "zyxwvut qqq"), (None, "zyxwvut"), (1, "other zyxwvut")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.text, tuple(r.ids)) for r in tokenizer.encode(df).collect())
    assert got == sorted((str(a), b, tuple(library.encode_ordinary(b))) for a, b in [(1, "zyxwvut qqq"), (1, "zyxwvut qqq"), (None, "zyxwvut"), (1, "other zyxwvut")])
    assert tokenizer.encode(df.limit(0)).count() == 0


def test_decoding_unknown_ids_gives_null(spark):
    df = spark.createDataFrame([([15496, 995],), ([50256],), ([-1],), ([],), (None,)], "ids array<int>")
    assert [r[0] for r in df.select(tokenizer.decode(F.col("ids"))).collect()] == ["Hello world", None, None, "", None]


def test_a_hot_word_is_spread(spark, library):
    df = spark.createDataFrame([(i, "qqzzxx " * 5 + f"wvut{i}") for i in range(60)], "doc_id bigint, text string")
    places = spark.createDataFrame([(i, i, 0, "hot" if i % 3 else f"w{i}") for i in range(90)], "k1 bigint, k2 bigint, pos int, b string")
    ids = places.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("ids", F.array(F.lit(1)))
    spread, copies = tokenizer._salted(places, ids, 10)
    assert spread.where("b = 'hot'").select("salt").distinct().count() == copies.where("b = 'hot'").count() == 6 and copies.where("b <> 'hot'").count() == 30
    assert spread.join(copies, ["b", "salt"]).count() == 90
    before, tokenizer.WORD_ROWS = tokenizer.WORD_ROWS, 7
    try:
        assert all(r.ids == library.encode_ordinary(r.text) for r in tokenizer.encode(df).collect())
    finally:
        tokenizer.WORD_ROWS = before
