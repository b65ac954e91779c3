"""Evaluation texts in training text, by winnowing.

Of every window of WINDOW word k-grams the one of least hash is kept, of documents and items alike, so that any span of SPAN
shared words shares a kept gram. Grams that meet are extended over the words on either side; a hit needs SPAN words.
Items of fewer words are kept whole and looked for in every place.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

SPAN, GRAM = 12, 8
WINDOW = SPAN - GRAM + 1
SIDE = SPAN - GRAM
#: Up to so many item grams are sent to the tasks, which then give only grams that some item has; beyond, all grams are joined.
FILTER_LIMIT = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _ignored() -> dict[int, None]:
    """Combining marks and invisible format characters."""
    return {c: None for c in range(0x80, 0x110000) if (k := unicodedata.category(chr(c)))[0] == "M" or k == "Cf"}


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, without case, accents and format characters."""
    if not text:
        return []
    if text.isascii():
        return _WORD.findall(text.lower())
    plain = unicodedata.normalize("NFD", text).translate(_ignored()).casefold()
    return _WORD.findall(unicodedata.normalize("NFD", plain).translate(_ignored()))


class _Hashes(dict):
    """Hash of each word; forgotten when there are many."""

    def of(self, ws: list[str]) -> list[int]:
        if len(self) > 500_000:
            self.clear()
        return [self[w] if w in self else self.setdefault(w, xxhash.xxh64_intdigest(w, 7)) for w in ws]


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on, whether they lie in one text or not."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.full(n, np.uint64(k))
    for j in range(k):
        g = g * _BASE + h[j : j + n]
        g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(32))


def _kept(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the winnowed grams; ends: of each word's text."""
    g = _grams(h, GRAM)
    n = len(g) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), g[:0]
    windows = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    starts = np.arange(n)
    inside = starts + SPAN <= ends[:n]
    last = WINDOW - 1 - np.argmin(windows[inside][:, ::-1], axis=1)
    places = np.unique(starts[inside] + last)
    return places, g[places]


def fingerprints(df: DataFrame, key: str, text: str, pad: int, short: list[int] | None, only: object = None) -> DataFrame:
    """(key, words, gram, around): kept grams with the words around them.

    `words` is 0 for a winnowed gram and the number of words of a short text's gram. With `short` None the texts are items: a text of fewer than
    SPAN words gives one gram of all its words; else grams of each of these numbers of words are given in every place.
    `only`: a broadcast sorted array of grams outside which none is given. `pad` stands for words beyond a text's ends.
    """
    kind = df.schema[key].dataType
    out = T.StructType().add(key, kind).add("words", T.IntegerType()).add("gram", T.LongType()).add("around", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        wanted = only.value if only is not None else None
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                b = whole.slice(first, 500)
                lists = [cache.of(words(t)) for t in b.column(text).to_pylist()]
                sizes = np.array([len(x) for x in lists], np.int64)
                h = np.fromiter((x for ws in lists for x in ws), np.uint64, int(sizes.sum()))
                ends, row = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(lists)), sizes)
                found: list[tuple[int, np.ndarray, np.ndarray]] = [(0, *_kept(h, ends))]
                if short is None:
                    for i in np.flatnonzero((sizes > 0) & (sizes < SPAN)):
                        begin, n = int(sizes[:i].sum()), int(sizes[i])
                        found.append((n, np.array([begin]), _grams(h[begin : begin + n], n)))
                else:
                    for n in short:
                        g = _grams(h, n)
                        places = np.flatnonzero(np.arange(len(g)) + n <= ends[: len(g)])
                        found.append((n, places, g[places]))
                for n, places, g in found:
                    if wanted is not None and len(g):
                        at = np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)
                        ok = wanted[at] == g if len(wanted) else np.zeros(len(g), bool)
                        places, g = places[ok], g[ok]
                    if not len(g):
                        continue
                    lo, width = (-SIDE, GRAM + 2 * SIDE) if n == 0 else (0, n)
                    index = places[:, None] + np.arange(lo, lo + width)
                    safe = np.clip(index, 0, len(h) - 1)
                    around = np.where((index >= 0) & (index < len(h)) & (row[safe] == row[places][:, None]), h[safe], np.uint64(pad)).view(np.int64)
                    lists_ = pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1) * width, pa.int32()), pa.array(around.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(key).take(pa.array(row[places])), pa.array(np.full(len(places), n, np.int32)), pa.array(g.view(np.int64)), lists_], names=[key, "words", "gram", "around"]
                    )

    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, out)


def _extended() -> Column:
    """Whether the gram's words agree and the run of equal words around it reaches SPAN."""
    eq = lambda i: F.get("around", F.lit(i)) == F.get("_around", F.lit(i))
    left, right = F.lit(SIDE), F.lit(SIDE)
    for k in range(SIDE - 1, -1, -1):
        left, right = F.when(~eq(SIDE - 1 - k), k).otherwise(left), F.when(~eq(SIDE + GRAM + k), k).otherwise(right)
    same = F.slice("around", SIDE + 1, GRAM) == F.slice("_around", SIDE + 1, GRAM)
    return same & (left + right + GRAM >= SPAN)


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (doc, item): documents that hold SPAN consecutive words of an item or, of a shorter item, all its words in sequence.

    Texts that are null or without words hold nothing and are held nowhere; repeated rows count once; other columns are left out.
    """
    tests = written(fingerprints(items, item, text, 1, None).withColumnsRenamed({item: "_item", "around": "_around"}), "items")
    short = sorted(r[0] for r in tests.where("words > 0").select("words").distinct().collect())
    only = None
    n = tests.count()
    if n <= FILTER_LIMIT:
        grams = np.array([r[0] for r in tests.select("gram").distinct().collect()], np.int64).view(np.uint64)
        only = documents.sparkSession.sparkContext.broadcast(np.sort(grams))
    given = fingerprints(documents, doc, text, 0, short, only)
    met = given.join(F.broadcast(tests) if n <= FILTER_LIMIT // 10 else tests, ["words", "gram"])
    hits = met.where(F.when(F.col("words") == 0, _extended()).otherwise(F.col("around") == F.col("_around")))
    return hits.select(doc, F.col("_item").alias(item)).distinct()
