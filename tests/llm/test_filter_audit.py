from itertools import permutations
from math import factorial

import numpy as np
import pytest

from edgelytics.llm import filter_audit as fa
from tests.llm.helpers import TEXTS, documents, invented, words

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(rows):
    """The failed filters of each (doc_id, text), restated from the contract."""
    out = []
    for key, text in rows:
        text, w = text or "", words(text)
        failed = {"A"} if len(w) < 50 else set()
        failed |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        failed |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
        failed |= {"D"} if any(c in "#$%&*|" for c in text) else set()
        smaller = [k for k, t in rows if k is not None and (t or "") == text and key is not None and k < key]
        out.append(failed | ({"E"} if smaller else set()))
    return out


def brute(rows, labels):
    """rows: (doc_id, text, source); every order applied document by document."""
    failed = failures([r[:2] for r in rows])
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, start=1):
                gone = [k for k, bad in left if f in bad]
                left = [(k, bad) for k, bad in left if f not in bad]
                redundant = sum(f in bad for _, bad in mine) - len(gone)
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), redundant, sum(bad == {f} for _, bad in mine),
                    sum(k in good for k in gone), sum(k in toxic for k in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    assert df.columns == COLUMNS
    got = {tuple(r[:3]): tuple(r[3:]) for r in df.collect()}
    assert len(got) == df.count()
    return got


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_as_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = list(TEXTS.values()) + [
        invented(rng, 60, 5000), invented(rng, 60, 20), invented(rng, 60, 5000).upper(), invented(rng, 70, 5000) + " $",
        "SHOUT " * 80, "", "x " * 30_000, "a" * 200_000,
    ]
    texts = texts * 3
    rows = [(i if i % 11 else None, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(7, texts[7], "s1")] * 2 + [(7, "another text of row 7", "")]  # repeated rows, and a repeated key
    labels = [(i, i % 3 % 2, i % 2) for i in range(0, len(texts), 2)] + [(4, 1, None), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, part string")
    got = found(fa.audit(docs, labelled(spark, labels)))
    assert got == brute(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_hot_group_of_copies_and_clashing_columns(spark):
    docs = documents(spark, ["the same text"] * 300 + [None] * 30, clash="failed")
    got = found(fa.audit(docs, labelled(spark, [])))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert got == brute(rows, [])


@pytest.mark.parametrize("texts", [[], [None]])
def test_empty_tables(spark, texts):
    got = found(fa.audit(documents(spark, texts), labelled(spark, [])))
    assert len(got) == 600 * len(texts)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_paths(n):
    forward, backward = fa.path_counts(n)
    for state in range(1 << n):
        size = state.bit_count()
        assert (forward[state], backward[state]) == (factorial(size), factorial(n - size))
    edges = fa.edges_table(n)
    assert len(edges) == n * 2 ** (n - 1)
    # as many orders use an edge as list it among their steps
    steps = fa.steps_table("ABCDE"[:n])
    for state, added, orders in edges:
        assert orders == sum((s, a) == (state, added) for _, _, s, a in steps)
