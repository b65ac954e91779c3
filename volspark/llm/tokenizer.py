"""Encoding and decoding by a public byte-level BPE vocabulary, in Spark's own expressions.

Texts are split into words by the vocabulary's pattern. A word that is one token is looked up where it stands; the distinct others are
encoded once each, by folding the merge of lowest rank over the array of their bytes, and joined back. The ranks are a literal: an
array of small maps, in which a piece's hash gives its place, so that a look-up takes the same time whatever the size of the vocabulary.

Bytes are carried as strings of the code points 0 to 255 (ISO 8859-1), for which Spark has more functions than for binary.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Java's \s covers all white space of Unicode only under this flag.
PATTERN = "(?U)" + public_tokenizers.PATTERN
LATIN = "ISO-8859-1"
BUCKETS = 1 << 15
#: Spark's xxhash64 starts from this seed.
SEED = 42


@lru_cache(maxsize=4)
def ranks(path: str = VOCABULARY) -> dict[str, int]:
    """Piece (as ISO 8859-1 string) to rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a).decode(LATIN): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _rank_json(path: str) -> str:
    table: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks(path).items():
        table[xxhash.xxh64_intdigest(piece.encode(), SEED) % BUCKETS][piece] = rank
    return json.dumps(table, separators=(",", ":"))


@lru_cache(maxsize=4)
def _piece_json(path: str) -> str:
    by_id = sorted(ranks(path), key=ranks(path).__getitem__)
    return json.dumps(by_id)


def rank_literal(path: str = VOCABULARY) -> Column:
    """Folded into one literal when the query is optimized."""
    return F.from_json(F.lit(_rank_json(path)), "array<map<string,int>>")


def piece_literal(path: str = VOCABULARY) -> Column:
    return F.from_json(F.lit(_piece_json(path)), "array<string>")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def looker(table: Column) -> Callable[[Column], Column]:
    """The look-up of a piece's rank in the table that a lambda variable stands for."""
    # the hash is taken as unsigned: its low bits are those of the signed number
    return lambda piece: F.try_element_at(F.get(table, F.xxhash64(piece).bitwiseAND(BUCKETS - 1).cast("int")), piece)


def with_ranks(then: Callable[[Callable[[Column], Column]], Column], path: str = VOCABULARY) -> Column:
    """An expression that looks up ranks; the literal stands in the plan once, however often it is used."""
    return _let(rank_literal(path), lambda table: then(looker(table)))


def latin(text: Column) -> Column:
    """A text's UTF-8 bytes, one code point each."""
    return F.decode(F.encode(text, "UTF-8"), LATIN)


#: Signs beyond the code points of bytes: one on each side of every piece, one between two pieces of a pair.
_EDGE, _PAIR = "\u0100", "\u0101"


def merged(word: Column, look: Callable[[Column], Column]) -> Column:
    """The pieces of a word after all merges: array<string>.

    A step of the fold merges all places of the pair of lowest rank by one replacement, so it takes as many steps as kinds of merges, each in time by the length.

    That is the same as merging them one by one from the left if no other pair has that rank, and none of a lower rank arises: neither in the result nor while the
    next place still stands unmerged (the pair's text and its first piece once more). Where it isn't, the step merges the leftmost place alone.
    """
    none = F.lit(None).cast("struct<rank:int,x:string,y:string,several:boolean>")

    def best(state: Column) -> Column:
        pieces = F.split(F.substring(state, F.lit(2), F.length(state) - 2), _EDGE + _EDGE)

        def of(p: Column) -> Column:
            kinds = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.concat(F.get(p, i - 1), F.lit(_PAIR), F.get(p, i))))
            ranked = lambda ks: F.transform(ks, lambda k: look(F.replace(k, F.lit(_PAIR), F.lit(""))))

            def lowest(ks: Column, rs: Column) -> Column:
                low = F.array_min(rs)
                kind = F.get(ks, F.array_position(rs, low).cast("int") - 1)
                found = F.struct(low.alias("rank"), F.substring_index(kind, _PAIR, 1).alias("x"), F.substring_index(kind, _PAIR, -1).alias("y"), (F.size(F.filter(rs, lambda r: r == low)) > 1).alias("several"))
                return F.when(low.isNotNull(), found)

            return F.when(F.size(p) > 1, _let(kinds, lambda ks: _let(ranked(ks), lambda rs: lowest(ks, rs)))).otherwise(none)

        return _let(pieces, of)

    with_best = lambda text: _let(text, lambda t: F.struct(t.alias("t"), best(t).alias("b")))
    edged = lambda *xs: F.concat(*[y for x in xs for y in (F.lit(_EDGE), x, F.lit(_EDGE))])

    def step(state: Column, _: Column) -> Column:
        t, b = state["t"], state["b"]
        pair, whole = edged(b["x"], b["y"]), edged(F.concat(b["x"], b["y"]))
        place = F.call_function("locate", pair, t)
        first = F.concat(F.substring(t, F.lit(1), place - 1), whole, F.substring(t, place + F.length(pair), F.length(t)))
        lone = ~b["several"] & (F.coalesce(look(F.concat(b["x"], b["y"], b["x"])), b["rank"]) >= b["rank"])
        all_ = F.when(lone, with_best(F.replace(t, pair, whole)))
        return F.when(b.isNull(), state).otherwise(_let(all_, lambda q: F.when(q.isNotNull() & (F.coalesce(q["b"]["rank"], b["rank"]) >= b["rank"]), q).otherwise(with_best(first))))

    letters = F.array_join(F.transform(F.split(word, ""), lambda c: edged(c)), "")
    steps = F.when(F.length(word) > 1, F.sequence(F.lit(2), F.length(word))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, with_best(letters), step, lambda s: F.split(F.substring(s["t"], F.lit(2), F.length(s["t"]) - 2), _EDGE + _EDGE))


def word_ids(word: Column, path: str = VOCABULARY) -> Column:
    """The ids of a word."""
    return with_ranks(lambda look: _let(merged(word, look), lambda pieces: F.transform(pieces, lambda p: look(p))), path)


#: A word that stands in more rows than this and than a HOT_SHARE-th of all is met in several tasks; so there are at most HOT_SHARE of them.
WORD_ROWS, HOT_SHARE = 100_000, 1000


def _salted(places: DataFrame, ids: DataFrame, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with `salt`, by which the places of a hot word are spread and its ids repeated."""
    total = ids.agg(F.sum("n")).first()[0] or 0
    size = max(rows or WORD_ROWS, total // HOT_SHARE + 1)
    pieces = F.ceil(F.col("n") / size).cast("int")
    hot = places.sparkSession.createDataFrame(ids.where(F.col("n") > size).select("b", pieces.alias("pieces")).collect(), "b string, pieces int")
    spread = places.join(F.broadcast(hot), "b", "left").withColumn("salt", F.pmod(F.xxhash64("k1", "pos"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
    return spread, ids.withColumn("salt", F.explode(F.sequence(F.lit(0), pieces - 1)))


def _encoded(df: DataFrame, text: str, path: str) -> DataFrame:
    """(r, w): each row as a struct and its words as array<struct<pos int, ids array<int>>>; so no name of a column can clash.

    Rows are told apart by two hashes of all their columns, so equal rows are legal and come out as often as they came in.
    """
    keys = [f"`{c}`" for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    flags = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]
    split = F.coalesce(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))
    slots = with_ranks(lambda look: F.transform(split, lambda w, i: _let(latin(w), lambda b: F.struct(i.alias("pos"), look(b).alias("id"), b.alias("b")))), path)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"), F.xxhash64(F.lit(1), *flags).alias("k1"), F.xxhash64(F.lit(2), *flags).alias("k2"), slots.alias("slots"))
    one = F.transform(F.filter("slots", lambda s: s["id"].isNotNull()), lambda s: F.struct(s["pos"].alias("pos"), F.array(s["id"]).alias("ids")))
    many = F.transform(F.filter("slots", lambda s: s["id"].isNull()), lambda s: F.struct(s["pos"].alias("pos"), s["b"].alias("b")))
    rows = written(rows.select("r", "k1", "k2", one.alias("one"), many.alias("many")), "words")
    places = rows.select("k1", "k2", F.explode("many").alias("m")).select("k1", "k2", "m.pos", "m.b")
    # a number of partitions that is stated isn't reduced by size: the words are few bytes but much work
    distinct = places.groupBy("b").agg(F.count(F.lit(1)).alias("n")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("b"))
    ids = written(distinct.select("b", "n", word_ids(F.col("b"), path).alias("ids")), "ids")
    spread, copies = _salted(places, ids)
    found = spread.join(copies, ["b", "salt"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "ids")).alias("found"))
    whole = rows.where(F.size("many") == 0).select("r", F.col("one").alias("w"))
    parts = rows.where(F.size("many") > 0).join(found, ["k1", "k2"]).select("r", F.array_sort(F.concat("one", "found")).alias("w"))
    return whole.unionByName(parts)


def _others(df: DataFrame, new: str) -> list[Column]:
    return [F.col(f"r.`{c}`") for c in df.columns if c.lower() != new.lower()]


def encode_words(df: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """All columns and `_words`: array<struct<pos int, ids array<int>>>, the words of the text in order; empty for an empty or null text.

    A column that is called `_words` is replaced.
    """
    return _encoded(df, text, path).select(*_others(df, "_words"), F.col("w").alias("_words"))


def encode(df: DataFrame, text: str = "text", into: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """All columns and the ids of the text, without special tokens, whose strings are ordinary text; empty for an empty or null text.

    A column that is called as `into` is replaced; repeated rows stay as many as they are; an empty table gives an empty table.
    """
    return _encoded(df, text, path).select(*_others(df, into), F.flatten(F.transform("w", lambda w: w["ids"])).alias(into))


def joined_pieces(ids: Column, path: str = VOCABULARY) -> Column:
    """The bytes of ids one after another, as code points 0 to 255."""
    return _let(piece_literal(path), lambda pieces: F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of ids: their pieces' bytes one after another, read as UTF-8; null for null or for an unknown id."""
    known = F.forall(ids, lambda i: (i >= 0) & (i < F.lit(len(ranks(path)))))
    return F.when(known, F.encode(joined_pieces(ids, path), LATIN).cast("string"))


def piece_bytes(path: str = VOCABULARY) -> Column:
    """Literal array: the number of bytes of each id, below 0 if the first of them continues a character."""
    by_id = sorted(ranks(path), key=ranks(path).__getitem__)
    return F.split(F.lit(",".join(str(-len(p) if 0x80 <= ord(p[0]) < 0xC0 else len(p)) for p in by_id)), ",").cast("array<int>")
