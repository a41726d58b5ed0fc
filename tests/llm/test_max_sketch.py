import math
import re
from collections import Counter

import numpy as np
import pytest

from edgelytics.llm import max_sketch as ms
from tests.llm.helpers import TEXTS, documents, invented

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow_scores(docs, items):
    """The score of each document for each item, restated from the contract."""
    held = [TERM.findall(lower(t)) for _, t in docs]
    n_docs, length = sum(bool(t) for t in held), sum(map(len, held))
    df = Counter(term for t in held for term in set(t))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    found = np.zeros((len(items), len(docs)), np.int64)
    for d, t in enumerate(held):
        if not t:
            continue
        m = 75 + (25 * len(t) * n_docs) // length
        tf = Counter(t)
        for q, (_, text) in enumerate(items):
            found[q, d] = sum(weight[w] * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in TERM.findall(lower(text)) if tf[w])
    return found


def brute(docs, items, top=20):
    rows = []
    for (item, _), scores in zip(items, slow_scores(docs, items), strict=True):
        order = sorted(range(len(docs)), key=lambda d: (-scores[d], docs[d][0] is None, docs[d][0] or 0))
        rows += [(item, rank, docs[d][0], int(scores[d])) for rank, d in enumerate(order[:top], start=1) if scores[d] > 0]
    return sorted(rows, key=repr)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(5),
        spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int"),
    )


def found(spark, docs, items, **more):
    got = ms.search(*tables(spark, docs, items), **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(8)
    texts = [*TEXTS.values(), "x " * 20_000, "Q" * 50_000]
    texts += [invented(rng, int(rng.integers(1, 300)), 900) for _ in range(150)]
    texts += [texts[20]] * 30 + [texts[21] + " w1"] * 3
    docs = [(i if i % 17 else None, t) for i, t in enumerate(texts)]
    docs += [(20, texts[20])] * 3 + [(25, "another text w7 w8")]
    items = [(k, " ".join(texts[30 + k].split()[:40])) for k in range(12)]
    items += [(12, texts[20]), (13, None), (14, "!?"), (15, "never seen words"), (3, items[3][1]), (None, "W1 w1 w2"), (16, "x")]
    return docs, items


def test_as_brute_force(spark, corpus):
    docs, items = corpus
    assert found(spark, docs, items) == brute(docs, items)


def test_first_and_blocks_change_nothing(spark, corpus, monkeypatch):
    docs, items = corpus
    want = brute(docs, items[:9], 5)
    monkeypatch.setattr(ms, "BLOCK_ITEMS", 4)
    assert found(spark, docs, items[:9], top=5, first=1) == want


def test_few_coordinates_and_no_known_weight_change_nothing(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(ms, "FREQUENT_TERMS", 0)
    assert found(spark, docs, items[:6], top=3, first=2) == brute(docs, items[:6], 3)


def test_bounds_hold(spark, corpus):
    docs, items = corpus
    table, _ = tables(spark, docs, items)
    index = ms.build_index(table)
    block = ms._block([Counter(ms.terms((t or "").encode())) for _, t in items], index)
    rows = index.sketches.collect()
    bounds = ms._bounds([r["sketch"] for r in rows], block)
    slow = slow_scores(docs, items)
    by_key = {}
    for d, (key, text) in enumerate(docs):
        by_key.setdefault(key, []).append((text, d))
    checked = 0
    for r, bound in zip(rows, bounds, strict=True):
        if len({t for t, _ in by_key[r["doc_id"]]}) == 1:
            scores = slow[:, by_key[r["doc_id"]][0][1]]
            assert (bound >= scores).all()
            checked += 1
    assert checked > 100


def test_ties_go_by_doc_id_whatever_the_number_of_copies(spark):
    docs = [(i, "same words here") for i in range(400, 0, -1)] + [(1000 + i, f"other{i} text") for i in range(50)]
    items = [(1, "same other3"), (2, "text")]
    got = found(spark, docs, items, first=3)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "word")]) == []
    assert found(spark, [(1, "word"), (2, None)], []) == []
    assert found(spark, [(1, None), (2, " ")], [(1, "word")]) == []


def test_clashing_columns(spark):
    docs = documents(spark, ["one two", "two three"], clash="h1")
    items = spark.createDataFrame([(5, "two", "x")], "item_id long, text string, query string")
    assert {r["doc_id"] for r in ms.search(docs, items).collect()} == {0, 1}
