from collections import Counter

import numpy as np
import pytest

from edgelytics.llm import quality
from tests.llm.helpers import TEXTS, documents, invented, words

CLEAN = "The river ran past the old mill, and nobody had seen it so high before. " * 1


def brute(text):
    w = words(text)
    grams = Counter(tuple(w[s : s + 3]) for s in range(len(w) - 2))
    covered = {i for s in range(len(w) - 2) if grams[tuple(w[s : s + 3])] > 1 for i in range(s, s + 3)}
    lines, seen = [x for x in (text or "").split("\n") if words(x)], set()
    again = 0
    for line in lines:
        again += line in seen
        seen.add(line)
    joined = "".join(w)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), len(joined), sum(c in "#*$%&|<>" for c in joined), again, len(covered), failed


def test_counts_as_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [*TEXTS.values(), "a b c a b c", "x " * 200, "same line\n" * 60, "Ä# é|<> %%\n\n  \n Ä# é|<> %%"]
    texts += [invented(rng, int(rng.integers(1, 300)), int(rng.integers(2, 400))).replace(" w1 ", "\n") for _ in range(80)]
    rows = quality.clean_lines(documents(spark, texts, clash="kept")).orderBy("doc_id").collect()
    got = [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows]
    assert got == [brute(t) for t in texts]
    assert not any(r["kept"] and r["base_failed"] for r in rows)


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        ("Licensed under the Apache License, Version 2.0.", True),
        ("HOME", True),
        ("Home is where we started from and the end is near.", False),
        ("a | b | c | d", True),
        ("this%%% that### these***", True),
        ("go go go go go go go go", True),
        ("go go go go go go go", False),
        ("Copyright 2019 Somebody Inc", True),
        ("The copyright of 2019 is theirs.", False),
        ("Er sagte: 5 > 3, ja.", False),
        (CLEAN, False),
        ("   \t ", False),
    ],
)
def test_line_rules(line, fails):
    rules = quality.LineRules()
    verdict = bool(line.split()) and quality.line_fails(line.encode(), line.encode().split(), rules, quality._compiled(rules))
    assert verdict is fails


def test_documents_that_lose_too_much_go(spark):
    rng = np.random.default_rng(2)
    good = [invented(rng, 60, 9000) for _ in range(3)]
    menu = " | ".join(f"m{k}" for k in range(70))
    texts = [good[0], good[0] + "\nHome\nLogin", good[1] + "\n" + menu, menu + "\n" + menu.replace("m", "n") + "\n" + good[2], "short"]
    rows = quality.clean_lines(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True, True, False, False, False]
    assert rows[1]["clean_text"] == good[0] and rows[1]["n_failed_words"] == 2


def test_rows_of_every_kind(spark):
    docs = spark.createDataFrame([(None, None), (1, "a"), (1, "a"), (2, invented(np.random.default_rng(0), 300_000, 10**6))], "doc_id long, text string")
    rows = quality.clean_lines(docs).collect()
    assert sorted((r["n_words"], r["kept"]) for r in rows) == [(0, False), (1, False), (1, False), (300_000, True)]
    assert quality.clean_lines(docs.limit(0)).count() == 0


def test_triples_of_very_many_words():
    words_ = [b"%d" % k for k in range(1 << 21)] + [b"0", b"1", b"2"]
    assert quality._repeated(words_) == 6


@pytest.mark.parametrize(
    "line",
    ["Read more" + " " * 500, "\t" * 450 + "Read more", "All rights reserved " + "\U0001f600" * 110],
)
def test_boilerplate_however_long_in_bytes(line):
    rules = quality.LineRules()
    assert quality.line_fails(line.encode(), line.encode().split(), rules, quality._compiled(rules))
