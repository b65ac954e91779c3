"""Cutting texts that are too long for a limit in tokens into overlapping pieces, at natural boundaries, by pointer doubling.

Every legal cut of a text is joined to its successor: the farthest end a piece can have that starts `overlap` tokens before the
cut, at a paragraph, else a sentence, else a word, else a character. Squaring that table again and again doubles the reach of its steps, so all
cuts of all texts are found in a number of rounds that is the logarithm of the most pieces a text has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.ordering import running_total
from ..session import written
from .tokenizer import PATTERN, VOCABULARY, _let, encode_words, joined_pieces, piece_bytes

LIMIT, OVERLAP = 1200, 64
#: A word of more tokens than this may be cut inside, where characters end.
LONG_WORD = 64
#: Kinds of cuts.
INSIDE, CHARACTER, WORD, SENTENCE, PARAGRAPH, END = -1, 0, 1, 2, 3, 4
_ENDERS = r"[.!?…。！？｡]['\"»”’)\]」』）]*$"
_WIDE_ENDERS = r"[。！？｡][」』）”’]*$"


def _kind(words: Column, i: Column) -> Column:
    """The kind of cut behind word i."""
    w, after, before = F.get(words, i), F.get(words, i + 1), F.get(words, i - 1)
    blank = lambda c: F.coalesce(c.rlike(r"^(?U)\s+$"), F.lit(False))
    lines = lambda c: F.coalesce(F.length(F.regexp_replace(c, r"[^\n]", "")), F.lit(0))
    starts = after.rlike(r"^(?U)\s")
    paragraph = blank(w) & (lines(w) > 0) & (lines(w) + F.when(blank(before), lines(before)).otherwise(0) > 1) & ~(blank(after) & (lines(after) > 0))
    sentence = (w.rlike(_ENDERS) & starts) | w.rlike(_WIDE_ENDERS)
    return F.when(after.isNull(), END).when(paragraph, PARAGRAPH).when(sentence, SENTENCE).when(starts | blank(w), WORD).otherwise(CHARACTER)


def _units(words: Column, ids: Column, sizes: Column) -> Column:
    """(n, bytes, kind) of each word, or of each token of a long word; sizes: `piece_bytes`."""

    def of(x: Column, i: Column) -> Column:
        kind, w = _kind(words, i), F.get(words, i)
        inner = F.transform(
            x["ids"],
            lambda t, j: F.struct(
                F.lit(1).alias("n"),
                F.abs(F.get(sizes, t)).alias("bytes"),
                F.when(j == F.size(x["ids"]) - 1, kind)
                .when(F.get(sizes, F.get(x["ids"], j + 1)) < 0, INSIDE)
                .otherwise(CHARACTER)
                .alias("kind"),
            ),
        )
        one = F.array(F.struct(F.size(x["ids"]).alias("n"), F.octet_length(w).alias("bytes"), kind.alias("kind")))
        return F.when(F.size(x["ids"]) > LONG_WORD, inner).otherwise(one)

    return F.flatten(F.transform(ids, of))


def _successors(nodes: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(_key, at, next): for each legal cut the next one, found by running maxima over blocks of positions that overlap by a piece."""
    block, fresh = 1 << 16, limit - overlap
    cuts = nodes.where(F.col("kind") >= CHARACTER)
    there = F.explode(F.array_distinct(F.array(F.floor(F.col("at") / block), F.floor((F.col("at") + limit) / block))))
    points = cuts.where("at > 0").select("_key", there.alias("_block"), F.col("at").alias("p"), F.lit(0).alias("ask"), "kind", F.lit(None).cast("bigint").alias("at"))
    reach = F.when(F.col("at") == 0, F.lit(limit)).otherwise(F.lit(fresh)) + F.col("at")
    asks = cuts.where(F.col("kind") < END).select("_key", F.floor(reach / block).alias("_block"), reach.alias("p"), F.lit(1).alias("ask"), F.lit(None).cast("int").alias("kind"), F.col("at").cast("bigint").alias("at"))
    order = W.partitionBy("_key", "_block").orderBy("p", "ask").rowsBetween(W.unboundedPreceding, 0)
    far = {f"f{k}": F.max(F.when(F.col("kind") >= k, F.col("p"))).over(order) for k in (CHARACTER, WORD, SENTENCE, PARAGRAPH, END)}
    rows = points.unionByName(asks).withColumns(far).where("ask = 1")
    half = F.col("at") + fresh // 2
    ahead = lambda k, least: F.when(F.col(f"f{k}") > least, F.col(f"f{k}"))
    following = F.coalesce(ahead(END, F.col("at")), ahead(PARAGRAPH, half), ahead(SENTENCE, half), ahead(WORD, F.col("at")), ahead(CHARACTER, F.col("at")))
    return rows.select("_key", "at", following.alias("next"))


def reached(successors: DataFrame, most: int) -> DataFrame:
    """(_key, at): the cuts that the start at 0 leads to, in log2(most) rounds of squaring.

    Only the start and cuts that are some cut's successor can be on the way; the others leave the table first.
    """
    possible = successors.select("_key", F.col("next").alias("at")).unionByName(successors.where("at = 0").select("_key", "at")).distinct()
    jumps = written(successors.join(possible, ["_key", "at"], "left_semi"), "jumps")
    cuts = jumps.where("at = 0").select("_key", "at")
    for k in range(math.ceil(math.log2(max(2, most + 1)))):
        onward = cuts.join(jumps, ["_key", "at"]).select("_key", F.col("next").alias("at"))
        cuts = written(cuts.unionByName(onward).distinct(), f"cuts{k}")
        second = jumps.select("_key", F.col("at").alias("next"), F.col("next").alias("_then"))
        jumps = written(jumps.join(second, ["_key", "next"]).select("_key", "at", F.col("_then").alias("next")), f"jumps{k}")
    return cuts


def split(documents: DataFrame, doc: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, path: str = VOCABULARY) -> DataFrame:
    """(doc, piece_no, first_token, end_token, ids, fresh, piece): the pieces of every text of more than `limit` tokens.

    Piece n > 1 starts `overlap` tokens before the end of piece n - 1; `fresh` is its text beyond those, so that the fresh texts of a document
    give its text; `piece` is fresh with the shared text before it, from the first whole character on. Texts within the limit, empty and null ones give
    no rows; equal rows count once; a null id is kept; other columns are left out.
    """
    texts = documents.select(doc, text).where(F.octet_length(text) > limit)  # a token has at least one byte
    texts = texts.withColumn("_key", F.sha2(F.concat_ws("\x00", F.lit("k"), F.col(doc).cast("string"), F.col(doc).isNull().cast("string"), text), 256)).dropDuplicates(["_key"])
    encoded = encode_words(texts, text, path).where(F.aggregate("_words", F.lit(0), lambda n, w: n + F.size(w["ids"])) > limit)
    encoded = written(encoded, "long")
    words = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    cut = encoded.select("_key", "_words", words.alias("_w"), piece_bytes(path).alias("_sizes"))
    units = cut.select("_key", F.posexplode(_units(F.col("_w"), F.col("_words"), F.col("_sizes"))).alias("u", "x")).select("_key", "u", "x.*")
    units = written(units, "units")
    placed = running_total(units, ["_key"], "u", F.floor(F.col("u") / 4096), {"t": F.col("n"), "b": F.col("bytes")})
    start = encoded.select("_key", F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("byte"), F.lit(CHARACTER).alias("kind"))
    nodes = placed.select("_key", (F.col("t") + F.col("n")).alias("at"), (F.col("b") + F.col("bytes")).alias("byte"), "kind").unionByName(start)
    nodes = written(nodes, "nodes")
    successors = written(_successors(nodes, limit, overlap), "successors")
    # two pieces in a row bring nearly limit - overlap tokens at least
    longest = nodes.agg(F.max("at")).first()[0] or 0
    cuts = reached(successors, 2 * longest // max(1, limit - overlap - 8) + 2)
    steps = cuts.join(successors, ["_key", "at"])
    byte = nodes.select("_key", "at", "byte")
    steps = steps.join(byte, ["_key", "at"]).join(byte.select("_key", F.col("at").alias("next"), F.col("byte").alias("_to")), ["_key", "next"])
    # the cuts come to the text, not the text to each cut: what is moved grows as the texts
    cuts = F.array_sort(F.collect_list(F.struct("at", "next", "byte", F.col("_to").alias("to"))))
    texts = encoded.join(steps.groupBy("_key").agg(cuts.alias("_cuts")), "_key").select(doc, F.encode(F.col(text), "UTF-8").alias("_raw"), "_words", "_cuts")

    def piece(ids: Column, c: Column, i: Column) -> Column:
        first = F.when(c["at"] == 0, F.lit(0)).otherwise(F.greatest(c["at"] - overlap, F.lit(0)))
        part = lambda a, b: F.slice(ids, (a + 1).cast("int"), (b - a).cast("int"))
        fresh = F.substring(F.col("_raw"), (c["byte"] + 1).cast("int"), (c["to"] - c["byte"]).cast("int")).cast("string")
        return F.struct((i + 1).alias("piece_no"), first.alias("first_token"), c["next"].alias("end_token"), part(first, c["next"]).alias("ids"), fresh.alias("fresh"), part(first, c["at"]).alias("shared"))

    flat = F.flatten(F.transform("_words", lambda w: w["ids"]))
    pieces = _let(flat, lambda ids: F.transform("_cuts", lambda c, i: piece(ids, c, i)))
    rows = texts.select(doc, F.explode(pieces).alias("p")).select(doc, "p.*")
    shared = F.encode(F.regexp_replace(joined_pieces(F.col("shared"), path), "^[\u0080-¿]+", ""), "ISO-8859-1").cast("string")
    return rows.select(doc, "piece_no", "first_token", "end_token", "ids", "fresh", F.concat(shared, "fresh").alias("piece"))
