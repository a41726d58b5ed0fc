import os

import numpy as np
import pytest

from edgelytics.llm import toxicity
from edgelytics.llm.toxicity import Lexicon, fold
from tests.llm.helpers import TEXTS, documents

SF = "/root/testdata/sf0.01"
LEXICON = Lexicon({"idiot": 5.0, "stup": 4.0, "stupid": 4.5, "trash": 3.0}, curve=(-4.0, 1.0, 1.0))


@pytest.mark.parametrize(
    "text",
    ["an IDIOT here", "1d10t", "idіоt", "ｉｄｉｏｔ", "id​iot", "!idiot!", "idiot$$$", "i­diot", "𝐢𝐝𝐢𝐨𝐭"],
)
def test_disguises_are_hits(text):
    assert LEXICON.score(text)[1] == 1 and LEXICON.score(text)[0] >= 0.5


@pytest.mark.parametrize("text", ["", None or "", "videotape", "put it in the trash can.", "TRASH  bin", "costs $5 or 10%", "🙂 ½ ß"])
def test_clean_texts_are_not(text):
    assert LEXICON.score(text)[1] == 0 and LEXICON.score(text)[0] < 0.5


def test_folding_and_longest_entry():
    assert fold("A-b3\n") == " a be "
    assert fold("x@y.z $h@m3").split() == ["xay", "z", "shame"]
    assert LEXICON.hits(fold("stupidity, stupor; trash can trash")) == [4.5, 4.0, 3.0]


def test_length_lowers_the_score():
    short, long = LEXICON.score("idiot " + "word " * 5)[0], LEXICON.score("idiot " + "word " * 5000)[0]
    assert short > long


def test_weights_as_log_odds():
    rows = [("ab", 10, 0), ("abc", 10, 0), ("abcd", 9, 0), ("x", 10, 10), ("xy", 10, 0)]
    kept = toxicity.choose_stems(rows, 10, 100)
    assert set(kept) == {"ab", "x", "xy"}
    assert kept["ab"] == pytest.approx(np.log(10.5 / 11) - np.log(0.5 / 101))


def test_rows_of_every_kind(spark):
    docs = documents(spark, [*TEXTS.values(), "you idiot", "you idiot", "w " * 300_000 + "idiot"], clash="score")
    found = toxicity.score_texts(docs, LEXICON, keep=docs.columns)
    assert found.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted", "hits"]
    assert [r["predicted"] for r in found.orderBy("doc_id").collect()] == [0] * len(TEXTS) + [1, 1, 0]
    assert toxicity.score_texts(docs.limit(0), LEXICON).count() == 0


def test_without_labels_every_text_scores_low(spark):
    docs = documents(spark, ["a b", "c"])
    none = spark.createDataFrame([(0, 1), (1, None), (None, 0)], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(docs, none)
    assert lexicon.weights == {}
    assert [r["predicted"] for r in toxicity.score_texts(docs, lexicon).collect()] == [0, 0]


def test_stem_counts_by_hand(spark):
    rows = spark.createDataFrame([(0, 1, "abcd abce"), (1, 0, "ABcx"), (1, 1, None)], "half int, toxic int, _text string")
    got = {r["stem"]: (r["toxic0"], r["clean0"], r["toxic1"], r["clean1"]) for r in toxicity.stem_counts(rows, 3, 4).collect()}
    assert got == {"abc": (1, 0, 0, 1), "abcd": (1, 0, 0, 0), "abce": (1, 0, 0, 0), "abcx": (0, 0, 0, 1)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_held_out_rows_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn_lexicon(docs, labels.filter(~toxicity.held_out()))
    seen = toxicity.score_texts(docs, lexicon).join(labels.filter(toxicity.held_out()), "doc_id").toPandas()
    toxic, clean = seen[seen.toxic == 1].score.to_numpy(), seen[seen.toxic == 0].score.to_numpy()
    above = (toxic[:, None] > clean).mean() + 0.5 * (toxic[:, None] == clean).mean()
    assert above >= 0.8
    assert (clean < 0.5).mean() >= 0.97


def test_a_repeated_key_is_one_row_of_the_sample(spark, monkeypatch):
    fitted = []
    own = toxicity.fit_curve
    monkeypatch.setattr(toxicity, "fit_curve", lambda features, labels: fitted.append(len(features)) or own(features, labels))
    texts = ["you idiot fool" if i % 2 else "a calm word" for i in range(60)]
    docs = documents(spark, texts).select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    copies = spark.createDataFrame([(1, "you idiot fool")] * 150 + [(1, "another text")] * 150, "doc_id long, text string")
    lexicon = toxicity.learn_lexicon(docs.filter("doc_id != 1").union(copies), labels)
    assert fitted == [60] and lexicon.weights
    again = toxicity.learn_lexicon(docs.filter("doc_id != 1").union(copies.distinct()), labels)
    assert fitted == [60, 60] and again.weights == lexicon.weights
