"""Toxicity by a weighted lexicon of word beginnings.

Texts are folded first: lower case, look-alike letters of other scripts and wide forms to
plain ones, digits and signs that stand for letters inside a word to those letters,
everything else to blanks. One Aho-Corasick automaton finds all lexicon entries and all
exception phrases in a single pass; a hit inside an exception phrase does not count.
Weights are summed and set against the text's length; a logistic curve gives the score.

The lexicon and the curve are learned from labelled rows, a bounded sample of them. The
curve is fitted to each half of the sample as a lexicon of the other half sees it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelytics.llm.common import as_bytes, slices, text_column

# Letters that look alike, and digits and signs used for letters.
_LOOKALIKES = dict(
    zip(
        "абвгеёзикмнорстухѕіјԁһԛԝѵӏαβεικνορτυχωγ",
        "abbreezukmhopctyxsijdhqwvlabeikvoptuxwy",
        strict=True,
    )
)
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_SIGNS = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])|(?<![^\W_])[@$](?=[^\W_])")
_SIGN = {"@": "a", "$": "s", "!": "i", "|": "l"}
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_UNUSUAL = re.compile("[̀-ͯ℀-⅏＀-￯\U0001d400-\U0001d7ff]")


class _Folding(dict):
    """A table for str.translate that fills itself: letters stay, the rest becomes a blank."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        value = _DIGITS.get(char) or _LOOKALIKES.get(char) or (char if char.isalpha() or unicodedata.combining(char) else " ")
        self[code] = value
        return value


_FOLDING = _Folding()


def fold(text: str) -> str:
    """The folded text: words of letters, with one blank between and around them."""
    if not text.isascii():
        if _UNUSUAL.search(text):
            text = unicodedata.normalize("NFKC", text)
        text = _HIDDEN.sub("", text)
    text = text.lower()
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGNS.sub(lambda m: _SIGN[m[0]], text)
    return f" {' '.join(text.translate(_FOLDING).split())} "


# Phrases in which a word of the lexicon is meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "circus clown", "clown fish", "idiot proof")


@dataclass
class Lexicon:
    """Word beginnings with weights, exception phrases, and the curve of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-5.0, 1.0, 1.0)

    def __getstate__(self) -> dict:
        """Without the automaton, which each task builds for itself."""
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for stem, weight in self.weights.items():
            if stem:
                found.add_word(f" {stem}", (len(stem) + 1, weight))
        for phrase in self.exceptions:
            if folded := " ".join(fold(phrase).split()):
                found.add_word(f" {folded} ", (len(folded) + 2, None))
        found.make_automaton()
        return found

    def hits(self, folded: str) -> list[float]:
        """Weights of the hits; of entries that begin at the same word, the longest counts."""
        if not len(self.automaton):
            return []
        at: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(folded):
            if weight is None:
                excused.append((end - length + 1, end))
            else:
                at[end - length + 1] = weight
        return [w for start, w in at.items() if not any(a <= start < b for a, b in excused)]

    def features(self, text: str) -> tuple[float, float, int]:
        folded = fold(text)
        weights = self.hits(folded)
        total = max(0.0, sum(weights))
        words = folded.count(" ") - 1 if weights else 1
        return math.log1p(total), math.log1p(100 * total / max(1, words)), len(weights)

    def score(self, text: str) -> tuple[float, int]:
        total, density, hits = self.features(text)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * total + c * density)))), hits


# Learning


def _beginnings(text: str, shortest: int, longest: int) -> set[str]:
    found = set()
    for word in set(fold(text).split()):
        for length in range(shortest, min(longest, len(word)) + 1):
            found.add(word[:length])
    return found


def _texts(batch: pa.RecordBatch, at: int) -> list[str]:
    return [(t or b"").decode() for t in as_bytes(batch.column(at))]


_COUNTS = ("clean0", "toxic0", "clean1", "toxic1")  # documents by label, in either half


def stem_counts(labelled: DataFrame, shortest: int, longest: int) -> DataFrame:
    """(stem, clean0, toxic0, clean1, toxic1): documents of either half and label with a
    word that begins so, added up per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in _COUNTS]

        def rows() -> pa.RecordBatch:
            stems = list(set().union(*seen))
            counts = [pa.array([own[s] for s in stems], pa.int64()) for own in seen]
            for own in seen:
                own.clear()
            return pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *counts], ["stem", *_COUNTS])

        for batch in slices(batches, "_text"):
            for half, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, 2), strict=True):
                seen[2 * half + label].update(_beginnings(text, shortest, longest))
            if sum(map(len, seen)) > 150_000:
                yield rows()
        yield rows()

    mapped = labelled.select("half", "toxic", "_text").mapInArrow(run, "stem string, " + ", ".join(f"{c} long" for c in _COUNTS))
    return mapped.groupBy("stem").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    return F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))


def choose_stems(rows: list[tuple[str, int, int]], toxic: int, clean: int, margin: float = 0.7) -> dict[str, float]:
    """Weights by log odds; a longer beginning is kept only if it says clearly more."""
    weight = {s: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for s, t, c in rows}
    kept: dict[str, float] = {}
    for stem in sorted(weight, key=lambda s: (len(s), s)):
        shorter = [kept[stem[:k]] for k in range(1, len(stem)) if stem[:k] in kept]
        if not shorter or weight[stem] > max(shorter) + margin:
            kept[stem] = weight[stem]
    return kept


def fit_curve(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; few columns and a bounded number of rows."""
    x = np.column_stack([np.ones(len(features)), features])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (labels - p) - penalty @ beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = 20_000,
    shortest: int = 3,
    longest: int = 10,
    least_documents: int = 5,
    least_odds: float = 2.0,
    most_stems: int = 5_000,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """A lexicon from at most `sample_rows` labelled rows, those first in the order of a hash
    of their key. Labels that are null and rows without a text are not used; of several
    labels for a key the greater holds, of several texts the one of the least hash. Without labelled rows of both kinds the lexicon
    is empty and every text scores low alike.

    The driver gets at most `most_stems` stems, the heaviest, and three numbers per row of
    the sample.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    mix = F.xxhash64(F.lit("sample"), F.col("_key"))
    half = F.pmod(F.xxhash64(F.col("_key")), F.lit(2)).cast("int")
    sample = known.orderBy(mix, "_key").limit(sample_rows).withColumn("half", half)
    read = docs.select(F.col(key).alias("_key"), text_column(text).alias("_text")).filter("_text is not null")
    named = read.join(F.broadcast(sample), "_key")  # at most sample_rows rows of numbers
    # a key is one row, however often it occurs: copies go before the shuffle
    single = named.groupBy("_key", "half", "toxic").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    rows = single.select("half", "toxic", "_text")
    totals = Counter({(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()})
    # rows that choose the stems: either half, or both
    parts = [((0,), totals[0, 1], totals[0, 0]), ((1,), totals[1, 1], totals[1, 0])]
    parts.append(((0, 1), totals[0, 1] + totals[1, 1], totals[0, 0] + totals[1, 0]))
    if not parts[2][1] or not parts[2][2]:
        return Lexicon({}, exceptions)
    stems = stem_counts(rows, shortest, longest)
    odds, fits = [], []
    for halves, toxic, clean in parts:
        seen = [sum((F.col(f"{kind}{h}") for h in halves), F.lit(0)) for kind in ("toxic", "clean")]
        odds.append(_odds(*seen, toxic, clean))
        fits.append((seen[0] >= least_documents) & (odds[-1] >= least_odds))
    heavy = stems.filter(fits[0] | fits[1] | fits[2]).orderBy(F.greatest(*odds).desc(), "stem").limit(most_stems)
    found = heavy.select("stem", *_COUNTS, F.array(*fits).alias("fits")).collect()

    def lexicon(part: int) -> Lexicon:
        halves, toxic, clean = parts[part]
        own = [(r["stem"], sum(r[f"toxic{h}"] for h in halves), sum(r[f"clean{h}"] for h in halves)) for r in found if r["fits"][part]]
        return Lexicon(choose_stems(own, toxic, clean), exceptions)

    # the curve is fitted to rows that had no part in the stems they are seen through
    others = [lexicon(1), lexicon(0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            values = [others[half].features(t)[:2] for half, t in zip(batch.column(0).to_pylist(), _texts(batch, 2), strict=True)]
            columns = list(zip(*values, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array(c, pa.float64()) for c in columns)], ["toxic", "total", "density"]
            )

    seen = rows.mapInArrow(run, "toxic int, total double, density double").toPandas()
    whole = lexicon(2)
    whole.curve = fit_curve(seen[["total", "density"]].to_numpy(), seen["toxic"].to_numpy())
    return whole


# Scoring


def score_texts(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (the key) with score, predicted and hits, row by row.

    Only the text enters the score. A null or empty text has no hits and scores what any
    clean text scores. Columns named like an added one are replaced.
    """
    columns = [c for c in ([key] if keep is None else keep) if c not in ("score", "predicted", "hits")]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            values = [lexicon.score(t) for t in _texts(batch, len(columns))]
            scores = np.array([v[0] for v in values], np.float64)
            arrays = batch.columns[: len(columns)]
            arrays += [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array([v[1] for v in values], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "score", "predicted", "hits"])

    read = docs.select(*[F.col(f"`{c}`") for c in columns], text_column(text).alias("_text"))
    return read.mapInArrow(run, ", ".join([*kinds, "score double, predicted int, hits long"]))


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
