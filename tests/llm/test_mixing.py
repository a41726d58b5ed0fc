from collections import Counter

import numpy as np
import pytest

from edgelytics.llm import mixing
from tests.llm.helpers import TEXTS, documents, invented, words


def by_rounds(sizes, most=3):
    """Targets by resharing what is above its stop until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_sources, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_sources) for s in open_sources}
        above = [s for s in open_sources if share[s] > most * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_sources.discard(s)
        if not open_sources:
            return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {s: int(rng.integers(0, 10 ** rng.integers(1, 6))) for s in ["b", "a", "Z", "é", "", "10", "9", "\U00010000", "￿", None]}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    want = by_rounds(sizes)
    assert got == {s: pytest.approx(t) for s, t in want.items()}
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations(size):
    one, two = (mixing.permuted(np.arange(size), size, seed) for seed in (1, 2))
    assert sorted(one.tolist()) == sorted(two.tolist()) == list(range(size))
    assert size < 64 or (one != two).mean() > 0.9


def test_draws_add_up():
    owed = np.array([0, 5, 1000, 37, 200_000])
    counts = mixing.draw_counts(owed, 13, 1)
    assert (counts.sum(0) == owed).all() and np.ptp(counts.sum(1)) <= 1 and (counts >= 0).all()
    assert np.ptp(counts[:, 2]) > 0  # drawn, not dealt
    assert (mixing.draw_counts(owed, 13, 1) == counts).all()


def corpus():
    rng = np.random.default_rng(9)
    texts = [invented(rng, int(rng.integers(0, 300))) for _ in range(250)] + list(TEXTS.values())
    return [t.replace(" w1 ", "\n\n") if t else t for t in texts]


def test_mix_of_documents(spark):
    texts = corpus()
    docs = documents(spark, texts, clash="size").repartition(3)
    options = {"block_words": 8, "shards": 5, "bucket_rows": 20}
    rows = [r.asDict() for r in mixing.mix_sizes(docs, **options).collect()]
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size = Counter()
    for r in rows:
        assert r["size"] == len(words(texts[r["doc_id"]])) and 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
    for s in size:
        own = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in own} == {size[s]} and len({r["target"] for r in own}) == 1
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 8 + 0.02 * own[0]["target"]
    again = mixing.mix_sizes(docs.repartition(7), **options).collect()
    assert sorted(map(tuple, again), key=repr) == sorted((tuple(r.values()) for r in rows), key=repr)

    mixed = mixing.mix_documents(docs, **options)
    assert mixed.columns == docs.columns
    taken = Counter()
    for r in mixed.collect():
        whole, part = words(texts[r["doc_id"]]), words(r["text"])
        taken[r["doc_id"]] += len(part)
        at = iter(whole)
        assert part and all(w in at for w in part)  # in their order
        if len(part) == len(whole):
            assert r["text"].strip() == texts[r["doc_id"]].strip(" \t\n\x0b\x0c\r")
    assert dict(taken) == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}


def test_slots_take_each_block_evenly(spark):
    sources = spark.createDataFrame([("a", 0, 100, 250.0), ("b", 1, 40, 10.0)], "source string, source_no int, source_size long, target double")
    slots = mixing.draw_slots(sources, 4, 3, 1).collect()
    assert len({(r["shard"], r["place"]) for r in slots}) == len(slots) == 62 + 2
    times = Counter((r["source_no"], r["block"]) for r in slots)
    first = [times[(0, b)] for b in range(25)]
    assert set(first) <= {2, 3} and max(times[(1, b)] for b in range(10)) == 1


def test_null_and_repeated_rows(spark):
    rows = [(None, "a b c", None)] * 3 + [(1, None, "s"), (1, "", "s"), (2, "x y " * 50_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sizes(docs)
    assert got.count() == 6 and got.filter("taken > 3 * size").count() == 0
    assert {r["size"] for r in got.collect()} == {3, 0, 100_000}
    mixed = mixing.mix_documents(docs).collect()
    assert sum(len(r["text"].split()) for r in mixed) == got.groupBy().sum("taken").first()[0]
    empty = docs.limit(0)
    assert mixing.mix_sizes(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    blank = docs.filter("text is null")
    assert [(r["target"], r["taken"]) for r in mixing.mix_sizes(blank).collect()] == [(0.0, 0)]


def test_rows_alike_in_key_and_text_keep_their_source_and_columns(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text, s, None if s == "a" else "x", f"{s}{k}") for s in ("a", "b", "c") for k in range(4)]
    rows += [(None, text, None, "a", "n"), (None, text, "a", None, "a0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, url string")
    options = {"block_words": 8, "shards": 4, "bucket_rows": 3}
    sizes = mixing.mix_sizes(docs, **options).toPandas().fillna({"source": "none"}).groupby("source").taken.sum()
    got, told = Counter(), set()
    for r in mixing.mix_documents(docs, **options).collect():
        got[r["source"] or "none"] += len(r["text"].split())
        told.add((r["source"], r["lang"], r["url"]))
    assert dict(got) == {s: n for s, n in sizes.to_dict().items() if n}
    assert told <= {(s, lang, url) for _, _, s, lang, url in rows}
    assert len({url for s, _, url in told if s == "a"}) == 4
