"""Winnowing against a brute force over all spans."""

import random

from volspark.llm import leakage


def brute(docs, items):
    found = set()
    for d, text in docs:
        w = leakage.words(text)
        spans = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in range(1, 13)}
        for i, t in items:
            v = leakage.words(t)
            if not v:
                continue
            n = min(len(v), 12)
            if any(tuple(v[k : k + n]) in spans[n] for k in range(len(v) - n + 1)):
                found.add((d, i))
    return found


def case():
    random.seed(11)
    vocabulary = ["alpha", "béta", "Gam­ma", "42", "ΔΕΛΤΑ", "in", "the", "of", "house", "mouse", "ein", "Haus"]
    line = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(i, line(random.choice([1, 2, 5, 8, 9, 11, 12, 13, 20, 40]))) for i in range(40)] + [(100, None), (101, ""), (102, " -- "), (103, "the")]
    docs = [(i, line(random.randrange(0, 90))) for i in range(60)]
    for i in range(60, 140):
        words = random.choice(items[:40])[1].split()
        a = random.randrange(len(words))
        part = words[a : a + random.choice([3, 11, 12, 13, 30])]
        docs.append((i, f"{line(random.randrange(30))}, {'; '.join(part).upper()} . {line(random.randrange(30))}"))
    return docs + [(900, None), (901, ""), (902, docs[70][1]), (902, docs[70][1]), (903, "x " * 5000 + docs[75][1])], items


def test_every_shared_span_is_found(spark, monkeypatch):
    docs, items = case()
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id bigint, text string, gram int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute(docs, items)
    rows = leakage.leaks(d, i).collect()
    assert {tuple(r) for r in rows} == expected and len(rows) == len(expected) > 50
    monkeypatch.setattr(leakage, "FILTER_LIMIT", 0)  # all grams are joined
    assert {tuple(r) for r in leakage.leaks(d, i).collect()} == expected
    assert leakage.leaks(d.limit(0), i).count() == 0
    assert leakage.leaks(d, i.limit(0)).count() == 0


def test_words():
    assert leakage.words("Café CAFÉ ca­fe​, x_y 3½") == ["cafe", "cafe", "cafe", "x", "y", "3½"]
    assert leakage.words("Straße STRASSE") == ["strasse", "strasse"]
