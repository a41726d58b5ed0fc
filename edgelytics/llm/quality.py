"""Line-first cleaning: rules per line, then a verdict on what is left of the document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelytics.llm.common import as_bytes, slices, text_column

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(c for c in range(256) if c not in _SYMBOLS)
_BLANK_BYTES = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class LineRules:
    """What makes a line fail, and how much of a document may fail.

    A line without a word is kept and counts for nothing. Shares are of the document's
    words, so many short bad lines weigh no more than they hold.
    """

    symbol_share: float = 0.10  # characters of #*$%&|<> among the line's word characters
    separators: int = 3  # words that are nothing but | > » · in a navigation line
    separator_share: float = 0.2
    run: int = 8  # one word this many times in a row
    boilerplate: tuple[str, ...] = (
        r"^(licensed|released) under the .{0,80}\blicen[cs]e\b.{0,40}$",
        r"^(all rights reserved|copyright (\(c\)|©|[0-9]{4})).{0,120}$",
        r"^(home|menu|login|log in|sign in|sign up|share|tweet|print|next|previous|back|top|search|subscribe)$",
        r"^(click here|read more|cookie policy|privacy policy|terms of (use|service)|accept (all )?cookies).{0,40}$",
    )
    most_lost: float = 0.5  # reject a document that loses over this share of its words
    least_words: int = 50  # base rules
    most_repeated: int = 50  # per cent


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_failed_lines long, n_failed_words long, clean_text string"
)


def _symbols(data: bytes) -> int:
    return len(data.translate(None, _NOT_SYMBOLS))


def _repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(words)
    if n < 3:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    wide = len(seen)
    if wide < 1 << 21:
        grams = (ids[:-2] * wide + ids[1:-1]) * wide + ids[2:]
    else:  # numbers of pairs, so that the triple fits into 64 bits
        pairs = np.unique(ids[:-1] * wide + ids[1:], return_inverse=True)[1]
        grams = pairs[:-1] * wide + ids[2:]
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= hit
    return int(covered.sum())


def _compiled(rules: LineRules) -> re.Pattern[str]:
    return re.compile("|".join(f"(?:{p})" for p in rules.boilerplate), re.IGNORECASE | re.ASCII)


def line_fails(line: bytes, words: list[bytes], rules: LineRules, boilerplate: re.Pattern[str]) -> bool:
    """Whether a line with words is punctuation noise, navigation, boilerplate or a run of one word."""
    chars = sum(map(len, words))
    if _symbols(line) > rules.symbol_share * chars:
        return True
    marks = sum(w in (b"|", b">", b"\xc2\xbb", b"\xc2\xb7") for w in words)
    if marks >= rules.separators and marks >= rules.separator_share * len(words):
        return True
    if boilerplate.match(line.strip(_BLANK_BYTES).decode()):
        return True
    if len(words) >= rules.run and len(set(words)) < len(words):
        run = 1
        for left, right in zip(words, words[1:], strict=False):
            run = run + 1 if left == right else 1
            if run >= rules.run:
                return True
    return False


def judge(text: bytes | None, rules: LineRules, boilerplate: re.Pattern[str]) -> tuple:
    """The values of SCHEMA for one text."""
    text = text or b""
    words = text.split()
    n_words = len(words)
    repeated = _repeated(words)
    seen: set[bytes] = set()
    kept_lines: list[bytes] = []
    duplicates = failed = failed_words = 0
    lines = text.split(b"\n")
    for line in lines:
        own = line.split()
        if own:
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
            if line_fails(line, own, rules, boilerplate):
                failed += 1
                failed_words += len(own)
                continue
        kept_lines.append(line)
    base_failed = n_words < rules.least_words or 100 * repeated > rules.most_repeated * n_words
    kept = not base_failed and failed_words <= rules.most_lost * n_words
    joined = b"".join(words)
    return (
        n_words, len(joined.translate(None, _CONTINUATION)), _symbols(joined), duplicates, repeated,
        base_failed, kept, len(lines), failed, failed_words, b"\n".join(kept_lines).decode(),
    )


def clean_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: LineRules | None = None) -> DataFrame:
    """One row per document: the key, its counts, the verdict and the text without failed lines.

    No shuffle and no state beyond one document. A null text counts as empty: no words,
    one line, base rules failed, clean text empty. Repeated rows are judged one by one;
    other columns of the input are not looked at, so their names cannot clash.
    """
    rules = rules or LineRules()
    kind = docs.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boilerplate = _compiled(rules)
        for batch in slices(batches, "_text"):
            rows = [judge(t, rules, boilerplate) for t in as_bytes(batch.column(1))]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.string()]
            arrays = [batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["_key", *names])

    found = docs.select(F.col(key).alias("_key"), text_column(text).alias("_text")).mapInArrow(run, f"_key {kind}, {SCHEMA}")
    return found.withColumnRenamed("_key", key)
