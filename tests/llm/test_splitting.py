"""Pieces against their definition and against a sequential walk."""

import base64

import public_tokenizers as P
import pytest
import tiktoken

from volspark.llm import splitting


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cases():
    prose = "".join(f"This is sentence {i}, which says little. " + ("\n\nNew paragraph here! " if i % 17 == 0 else "") for i in range(900))
    return [
        (1, prose),
        (2, "short"),
        (3, None),
        (4, ""),
        (5, "🔥😍👍⭐" * 900),
        (6, "また買いたいと思います。静かで気に入っています。" * 200),
        (7, "word " * 1199),
        (8, "word " * 1300),
        (9, "q" * 3000 + " end of it. " + "z9" * 2000),
        (10, prose[:9000]),
        (10, prose[:9000]),
        (None, prose[:7000]),
    ]


def test_pieces(spark, library):
    df = spark.createDataFrame([(a, b, "x") for a, b in cases()], "doc_id bigint, text string, at string")
    rows = splitting.split(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    texts = dict(cases())
    long = {a for a, b in cases() if b and len(library.encode_ordinary(b)) > splitting.LIMIT}
    assert set(by) == long and 2 not in long and None in long
    for doc, pieces in by.items():
        pieces.sort(key=lambda r: r.piece_no)
        ids = library.encode_ordinary(texts[doc])
        assert [r.piece_no for r in pieces] == list(range(1, len(pieces) + 1))
        assert "".join(r.fresh for r in pieces) == texts[doc]
        assert pieces[0].first_token == 0 and pieces[-1].end_token == len(ids)
        for a, b in zip(pieces, pieces[1:]):
            assert b.first_token == a.end_token - splitting.OVERLAP and a.ids[-splitting.OVERLAP :] == b.ids[: splitting.OVERLAP]
        for r in pieces:
            assert r.ids == ids[r.first_token : r.end_token] and len(r.ids) <= splitting.LIMIT
            assert r.piece.endswith(r.fresh)
    assert all(r.fresh.rstrip().endswith((".", "!")) for r in by[1][:-1])
    assert all(r.fresh.endswith("。") for r in by[6])
    assert len(by[8]) == 2 and by[8][0].fresh.endswith("word")


def test_greedy_cuts_equal_a_walk(spark):
    steps = {0: 5, 5: 9, 7: 9, 9: 14, 14: 20, 3: 4}
    table = spark.createDataFrame([("a", *x) for x in steps.items()] + [("b", 0, 3)], "_key string, at bigint, next bigint")
    assert {tuple(r) for r in splitting.reached(table, 6).collect()} == {("a", x) for x in (0, 5, 9, 14, 20)} | {("b", 0), ("b", 3)}


def test_empty_table(spark):
    assert splitting.split(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_text_of_many_blocks(spark):
    """More tokens than a block of positions holds, with and without natural boundaries."""
    words = "word " * 70_000
    rows = splitting.split(spark.createDataFrame([(1, words), (2, "🔥" * 30_000)], "doc_id bigint, text string")).select("doc_id", "piece_no", "first_token", "end_token", "fresh").collect()
    by = {k: sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece_no) for k in (1, 2)}
    for k, text in ((1, words), (2, "🔥" * 30_000)):
        assert "".join(r.fresh for r in by[k]) == text
        assert all(b.first_token == a.end_token - splitting.OVERLAP for a, b in zip(by[k], by[k][1:]))
        assert all(splitting.LIMIT - 4 <= r.end_token - r.first_token <= splitting.LIMIT for r in by[k][:-1])


def test_no_text_is_copied_for_its_pieces(spark):
    """What the last join moves grows with the texts: it holds each text once, with its cuts."""
    df = spark.createDataFrame([(1, "word and more. " * 3000)], "doc_id bigint, text string")
    plan = splitting.split(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner")  # the pieces are cut above the join
