import hashlib
from collections import Counter

import numpy as np
import pytest

from edgelytics.llm import substring
from tests.llm.helpers import TEXTS, documents, invented, words


def brute(texts, window):
    counts = Counter(tuple(w[s : s + window]) for w in map(words, texts) for s in range(len(w) - window + 1))
    out = []
    for w in map(words, texts):
        gone = set()
        for s in range(len(w) - window + 1):
            if counts[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def corpus(rng):
    passage = [invented(rng, n, 9000).split() for n in (12, 35, 36, 34, 60, 90)]
    texts = [*TEXTS.values()]
    for _ in range(120):
        own = invented(rng, int(rng.integers(0, 120)), 9000).split()
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(len(own) + 1))
            own[at:at] = passage[int(rng.integers(len(passage)))]
        texts.append("\n".join([" ".join(own[:20]), "\t".join(own[20:])]))
    texts += ["again " * 80, "a b " * 50, texts[10], texts[10], texts[11] + " more", *[" ".join(passage[4])] * 9]
    return texts


@pytest.mark.parametrize(("window", "first"), [(35, 18), (35, 5), (35, 35), (7, 2), (1, 1)])
def test_as_brute_force(spark, window, first):
    texts = corpus(np.random.default_rng(window + first))
    docs = documents(spark, texts, clash="spans").repartition(6)
    rows = substring.drop_repeated_passages(docs, window=window, first=first).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in rows] == brute(texts, window)
    for r, text in zip(rows, texts, strict=True):
        assert sum(s["words"] for s in r["spans"]) == r["n_removed"]
        gone = {i for s in r["spans"] for i in range(s["first"], s["first"] + s["words"])}
        assert " ".join(w for i, w in enumerate(words(text)) if i not in gone) == r["kept_text"]


def test_levels():
    assert substring.level_lengths(35, 18) == [18, 35]
    assert substring.level_lengths(35, 5) == [5, 10, 20, 35]
    assert substring.level_lengths(4, 9) == [4]


def test_equal_windows_pick_equal_places():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 2**64, 35, dtype=np.uint64)
    for _ in range(20):
        left, right = (rng.integers(0, 2**64, int(rng.integers(0, 50)), dtype=np.uint64) for _ in range(2))
        text = np.concatenate([left, passage, right])
        places, hashes = substring.chosen(text, 9, 35)
        alone, own = substring.chosen(passage, 9, 35)
        assert places[len(left)] - len(left) == alone[0] and hashes[places[len(left)]] == own[alone[0]]


def test_runs():
    places = np.array([0, 1, 2, 7, 9, 10])
    assert substring.to_runs(places).tolist() == [[0, 3], [7, 1], [9, 2]]
    assert substring.from_runs(substring.to_runs(places)).tolist() == places.tolist()


def test_rows_of_every_kind(spark):
    long = " ".join(f"u{k}" for k in range(200_000))
    docs = spark.createDataFrame([(None, "p " * 3), (1, "p p"), (1, "p p"), (2, None), (3, long)], "doc_id long, text string")
    rows = substring.drop_repeated_passages(docs, window=2, first=1, keep=["doc_id"], with_text=False).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in rows) == [(0, 0), (2, 2), (2, 2), (3, 3), (200_000, 0)]
    assert all(r["kept_text"] is None for r in rows)
    assert substring.drop_repeated_passages(docs.limit(0)).count() == 0
    assert substring.drop_repeated_passages(docs.filter("doc_id = 3")).first()["n_removed"] == 0
