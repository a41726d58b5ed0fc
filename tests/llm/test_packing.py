import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from edgelytics.llm import packing
from edgelytics.llm.queries import vocabulary_path
from tests.llm.helpers import TEXTS, documents, invented

PATH = vocabulary_path()
WHOLE = Tokenizer.from_file(PATH)
TOKENS = packing.WordTokens(PATH)


def whole_ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def check_ids(texts, tokens=TOKENS):
    got = [np.frombuffer(b, "<u4").tolist() for b in tokens.ids(texts)]
    assert got == [whole_ids(t) for t in texts]


ODD = ["It's they'll 'S don’t 'twas'", "ÀÉÎ é é ǅ ŉ", "x1y22 ½ ² 三 ٣", "<|startoftext|>a b<|endoftext|><|x|>", "a​b ﻿c \xadd", "\x1cq\x1d \x85  r　s", "ﬁ Ω K", "İI ıi ẞß ΑΣ ΑΣ.", "!!!??? ... -- #$%&*", "퟿ \U0001f600 \U0010ffff"]


def test_ids_of_odd_texts():
    check_ids([t or "" for t in TEXTS.values()] + ODD + [" ".join(ODD)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_ids_of_any_texts(texts):
    check_ids(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aA1 .,'|<>é\tßs", max_size=40), max_size=5))
def test_ids_of_plain_texts(texts):
    check_ids(texts)


def test_a_small_store_starts_anew():
    rng = np.random.default_rng(0)
    tokens = packing.WordTokens(PATH, most=50)
    for _ in range(5):
        check_ids([invented(rng, 100, 300) for _ in range(4)], tokens)


def sums(bins, lengths):
    return [sum(lengths[i] for i in b) for b in bins]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_packing_keeps_items_and_never_needs_more_bins(lengths):
    bins = packing.best_fit(lengths, 30)
    better = packing.improve([list(b) for b in bins], lengths, 30)
    for found in (bins, better):
        assert sorted(i for b in found for i in b) == list(range(len(lengths)))
        assert all(0 < s <= 30 for s in sums(found, lengths))
    assert len(better) <= len(bins)
    assert sum(s * s for s in sums(better, lengths)) >= sum(s * s for s in sums(bins, lengths))


@pytest.mark.parametrize(
    ("bins", "lengths"),
    [
        ([[0], [1, 2]], [3, 3, 4]),  # a move
        ([[0, 1], [2, 3], [4]], [6, 3, 5, 4, 2]),  # exchanges
        ([[0, 1], [2, 3]], [2, 2, 3, 3]),  # two for one
    ],
)
def test_moves_and_exchanges_empty_bins(bins, lengths):
    better = packing.improve([list(b) for b in bins], lengths, 10)
    assert len(better) == -(-sum(lengths) // 10)


def test_exchanges_beat_a_poor_start():
    rng = np.random.default_rng(2)
    lengths = rng.integers(100, 900, 400).tolist()
    poor = [[i, i + 1] for i in range(0, 400, 2)]
    assert len(packing.improve(poor, lengths, 2048)) <= 1.1 * -(-sum(lengths) // 2048)


def gains(bins, lengths, capacity):
    """Every move and exchange of one or two items for a smaller one that raises the sum of squared fills."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    for s, source in enumerate(bins):
        given = [(i,) for i in source] + [(i, j) for n, i in enumerate(source) for j in source[n + 1 :]]
        for items in given:
            total = sum(lengths[i] for i in items)
            for t, target in enumerate(bins):
                back = [lengths[j] for j in target] + ([0] if len(items) == 1 else [])
                for length in back if t != s and capacity not in (fill[s], fill[t]) else ():
                    if 0 < total - length <= capacity - fill[t] and fill[t] + total - length > fill[s]:
                        yield items, s, t, length


def test_search_ends_only_where_no_step_is_left():
    rng = np.random.default_rng(6)
    for lo, hi in ((20, 45), (5, 60)):
        lengths = rng.integers(lo, hi, 60).tolist()
        bins = packing.best_fit(lengths, 100)
        better = packing.improve([list(b) for b in bins], lengths, 100)
        least = -(-sum(lengths) // 100)
        assert len(better) == least or not list(gains(better, lengths, 100))
        assert sorted(map(len, packing.improve([list(b) for b in better], lengths, 100))) == sorted(map(len, better))


def test_search_on_pieces_that_fit_badly():
    lengths = np.random.default_rng(0).integers(500, 901, 4000).tolist()
    bins = packing.best_fit(lengths, 2048)
    better = packing.improve([list(b) for b in bins], lengths, 2048)
    assert len(bins) > 1520 and len(better) <= 1459
    assert sorted(i for b in better for i in b) == list(range(4000))
    assert max(sum(lengths[i] for i in b) for b in better) <= 2048


@pytest.mark.parametrize("group_rows", [40, 20_000])
def test_documents(spark, group_rows):
    rng = np.random.default_rng(6)
    texts = [*TEXTS.values(), *(invented(rng, int(rng.integers(1, 90))) for _ in range(300)), invented(rng, 1000), *["copy"] * 40]
    docs = documents(spark, texts, clash="offset").repartition(4)
    packed = packing.pack_documents(docs, PATH, 128, with_ids=True, group_rows=group_rows)
    rows = packed.collect()
    want = {}
    for i, text in enumerate(texts):
        ids = [*whole_ids(text), 0]
        for piece, start in enumerate(range(0, len(ids), 128)):
            want[(i, piece)] = (start, np.array(ids[start : start + 128], "<u4").tobytes())
    assert {(r["doc_id"], r["piece"]): (r["start"], bytes(r["ids"])) for r in rows} == want and len(rows) == len(want)
    by_sequence = {}
    for r in rows:
        assert (r["length"], r["ids_crc32"]) == (len(r["ids"]) // 4, zlib.crc32(r["ids"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))]
        assert sum(n for _, n, _ in own) <= 128
    least = -(-sum(r["length"] for r in rows) // 128)
    assert len(by_sequence) <= 1.02 * least + 1
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    assert sorted(joined.values()) == sorted(b"".join(x for _, _, x in own) for own in by_sequence.values())


def test_null_keys_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c"), (2, None), (3, "w" * 200_000)], "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH, 64).collect()
    assert sum(r["length"] for r in rows) == sum(len(whole_ids(t)) + 1 for t in ("a", "b c", "b c", "", "w" * 200_000))
    assert packing.pack_documents(docs.limit(0), PATH, 64).count() == 0


def test_pieces_that_fill_no_bin_never_meet_in_one_group(spark, monkeypatch):
    sizes = []

    def spied(pieces, *args):
        sizes.extend(r["count"] for r in pieces.groupBy("group").count().collect())
        return own(pieces, *args)

    own = packing._round
    monkeypatch.setattr(packing, "_round", spied)
    lengths = [1100] * 1200 + [2048] * 100 + [948] * 20
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "piece long, length long").repartition(4)
    rows = packing.pack(pieces, 2048, group_rows=100).collect()
    assert max(sizes) <= 200
    assert sorted(r["piece"] for r in rows) == list(range(len(lengths)))
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert len(fill) == 1300  # the 948s go with an 1100 each


def test_bins_of_a_group_have_numbers(spark):
    with pytest.raises(ValueError, match="group_rows"):
        packing.pack(spark.createDataFrame([(1, 1)], "piece long, length long"), 2048, group_rows=1 << 23)
