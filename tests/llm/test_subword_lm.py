import math
import zlib
from collections import Counter

import numpy as np
import pytest

from edgelytics.llm import subword_lm as lm
from edgelytics.llm.queries import PIECES, QUERIES, vocabulary_path
from tests.llm.helpers import TEXTS, documents, invented, words

PATH = vocabulary_path(PIECES)


@pytest.fixture(scope="module")
def vocabulary():
    return lm.load_vocabulary(PATH)


def ways(word, numbers):
    """Every way to cut a word into pieces, as lists of piece numbers."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        for number in numbers.get(word[:n], ()):
            for rest in ways(word[n:], numbers):
                yield [number, *rest]


def by_piece(vocabulary):
    numbers = {}
    for number, piece in enumerate(vocabulary.pieces):
        numbers.setdefault(piece, []).append(number)
    return numbers


WORDS = [b"a", b"the", b"thing", "né".encode(), "Ω梦".encode(), b"\x00q", b"-----", b"zqx9"]


def test_forward_sums_all_ways(vocabulary):
    numbers, weights = by_piece(vocabulary), np.log(vocabulary.prior)
    want = [math.log(sum(math.exp(sum(weights[i] for i in way)) for way in ways(b" " + w, numbers))) for w in WORDS]
    assert np.allclose(lm.word_scores(WORDS, vocabulary, weights), want, rtol=1e-12)
    # alone or among others, a word's score is the same to the last bit
    more = WORDS + [b"x" * n for n in (1, 7, 8, 9, 16, 17, 3000)]
    together = lm.word_scores(more, vocabulary, weights)
    assert [lm.word_scores([w], vocabulary, weights)[0] for w in more] == together.tolist()


def test_expected_counts_are_posterior_sums(vocabulary):
    numbers, weights = by_piece(vocabulary), np.log(vocabulary.prior)
    times = np.arange(1, len(WORDS) + 1)
    want = np.zeros(len(vocabulary.pieces))
    for word, n in zip(WORDS, times, strict=True):
        found = [(way, math.exp(sum(weights[i] for i in way))) for way in ways(b" " + word, numbers)]
        total = sum(p for _, p in found)
        for way, p in found:
            for i in way:
                want[i] += n * p / total
    lattice = lm.Lattice(vocabulary)
    lattice.lay_out(WORDS)
    got = lattice.expected(weights, times) / lm.UNITS
    assert np.allclose(got, want, atol=1e-5)


def test_long_pieces_are_found(vocabulary):
    numbers = by_piece(vocabulary)
    long = sorted((p for p in vocabulary.pieces if p[:1] == b" "), key=len)[-30:]
    weights = np.full(len(vocabulary.pieces) + 1, -1000.0)
    for piece in long:
        only = weights.copy()
        only[numbers[piece]] = -1.0
        assert lm.word_scores([piece[1:]], vocabulary, only)[0] > -2


def test_probabilities_sum_to_one_at_most(vocabulary):
    assert math.isclose(vocabulary.prior.sum(), 1)
    assert len(vocabulary.prior) == len(vocabulary.pieces) + 1


def is_held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    """(held_out, n_tokens, n_known, train_tokens, base_score) of each (doc_id, text)."""
    tokens = [[*words(lower(t)), None] for _, t in rows]
    counts = Counter(w for (k, _), ts in zip(rows, tokens, strict=True) if not is_held_out(k) for w in ts)
    total, distinct = sum(counts.values()), len(counts)
    return [
        (is_held_out(k), len(ts), sum(counts[w] > 0 for w in ts), total,
         sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ts))
        for (k, _), ts in zip(rows, tokens, strict=True)
    ]


@pytest.mark.parametrize("frequent", [0, 5, 100_000])
def test_base_as_brute_force(spark, frequent):
    rng = np.random.default_rng(2)
    texts = [*TEXTS.values(), *[invented(rng, 40, 60) for _ in range(40)], "THE the The", "word " * 3000, "y" * 20_000, "y" * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 2 + [(None, "alone")] * 2
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, n long, score double")
    found = lm.score_texts(docs, PATH, rounds=1, frequent_words=frequent).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:4])
    want = sorted(((k, *b) for (k, _), b in zip(rows, brute(rows), strict=True)), key=key)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)


def test_scores_are_the_same_however_rows_are_dealt(spark):
    rng = np.random.default_rng(3)
    docs = documents(spark, [invented(rng, 30, 200) for _ in range(60)])
    one = {r["doc_id"]: r["score"] for r in lm.score_texts(docs.coalesce(1), PATH).collect()}
    two = {r["doc_id"]: r["score"] for r in lm.score_texts(docs.repartition(7), PATH, frequent_words=3).collect()}
    assert one == two and len(one) == 60


def test_learning_raises_the_likelihood_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = []
    for rounds in (0, 1, 3):
        rows = lm.score_texts(docs, PATH, rounds=rounds).filter("held_out").collect()
        held.append(sum(r["score"] for r in rows))
    assert held[0] < held[1] < held[2] and len(rows) > 10


def test_no_training_rows(spark):
    assert lm.score_texts(documents(spark, []), PATH).count() == 0
    keys = [k for k in range(60) if is_held_out(k)]
    docs = spark.createDataFrame([(k, "some words") for k in keys], "doc_id long, text string")
    for r in lm.score_texts(docs, PATH).collect():
        assert (r["held_out"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 0, 0, 0.0)
        assert math.isfinite(r["score"])


def test_query(spark):
    got = QUERIES["op13_lattice_lm"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {k: b for (k, _), b in zip(docs, brute([tuple(r) for r in docs]), strict=True)}
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert tuple(r)[1:5] == want[r["doc_id"]][:4] and math.isclose(r["base_score"], want[r["doc_id"]][4], rel_tol=1e-11)
