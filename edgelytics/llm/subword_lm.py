"""Language-model scores from a lattice of subword pieces.

A word, a blank before it, is cut into pieces of an existing vocabulary in every possible
way; a way's probability is the product of its pieces' weights, and a text's probability
is the sum over all ways, with one closing symbol. No piece reaches over a blank, so the
forward recursion runs word by word, in log space, and word probabilities multiply.

The vocabulary's scores give the first weights. The corpus then weighs the same pieces
anew: each round distributes every training word over its lattice by forward and backward
recursion and adds up the expected counts of the pieces (expectation maximisation). The
pieces themselves never change. Single bytes are pieces too, so every text has a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelytics.llm.common import as_bytes, frequency_floor, slices, stored, text_column

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCKS = 6  # pieces have up to 48 bytes, compared eight at a time
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_FILTER_BITS = 20

#: Words whose counts travel to all tasks: the most frequent ones, of bounded length.
FREQUENT_WORDS = 100_000
FREQUENT_BYTES = 256
#: Bytes of text that a worker holds cut into words at a time.
_SLICE = 2 << 20
#: Expected counts are added up in these parts of one, as whole numbers, in any order.
UNITS = 1 << 20


def held_out(key: str = "doc_id") -> Column:
    """Rows that nothing is learned from; a null key is not among them."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 7 == 2, F.lit(False))


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes, a blank standing for the start of a word, and the weight each has
    by the vocabulary's own score. The last two weights' places are not pieces of a word:
    the 256 single bytes come first, and the closing symbol is the last."""

    pieces: list[bytes]
    prior: np.ndarray

    @property
    def end(self) -> int:
        return len(self.pieces)


def load_vocabulary(path: str) -> Vocabulary:
    """The usable pieces of a sentencepiece model.

    A merge vocabulary scores its pieces by rank (minus the rank, in fact), so Zipf's law
    makes a weight of it: 1 / (1 + rank). Single bytes have the rank after the last. Pieces
    that no lower-cased word can hold are left out.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ranks = [bytes([b]) for b in range(256)], [0.0] * 256
    for number in range(model.vocab_size()):
        if model.is_byte(number) or model.is_control(number) or model.is_unknown(number) or model.is_unused(number):
            continue
        piece, score = model.id_to_piece(number).replace("▁", " ").encode(), model.get_score(number)
        body = piece[1:] if piece[:1] == b" " else piece
        if score < -1e8 or body.split() != ([body] if body else []) or body.translate(_LOWER) != body or len(piece) > 8 * _BLOCKS:
            continue
        pieces.append(piece)
        ranks.append(-score)
    ranks[:256] = [max(ranks) + 1] * 256
    weights = 1.0 / (1.0 + np.array([*ranks, 0.0]))
    return Vocabulary(pieces, weights / weights.sum())


def _blocks(data: bytes) -> np.ndarray:
    """The eight bytes from each position on as a number; `data` has eight spare bytes at its end."""
    flat = np.frombuffer(data, np.uint8).astype(np.uint64)
    found = np.zeros(len(flat) - 8, np.uint64)
    for k in range(8):
        found |= flat[k : k + len(found)] << np.uint64(8 * k)
    return found


class Lattice:
    """All segmentations of words, and recursions over them.

    Words are laid out by position: the nodes before their first byte, then those after
    it, and so on, longest word first, so the words that reach a position are a prefix.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.size = len(vocabulary.pieces)
        order = np.zeros((self.size, _BLOCKS), np.uint64)
        lengths = np.array([len(p) for p in vocabulary.pieces])
        for number, piece in enumerate(vocabulary.pieces):
            padded = piece.ljust(8 * _BLOCKS, b"\0")
            order[number] = np.frombuffer(padded, "<u8")
        keys = self._key([order[:, k] for k in range(_BLOCKS)], lengths.astype(np.uint64))
        listed = np.argsort(keys[256:], kind="stable") + 256  # bytes need no search
        self.keys, self.numbers, self.blocks, self.lengths = keys[listed], listed, order, lengths
        self.used = sorted(set(lengths[256:].tolist()))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    @staticmethod
    def _key(blocks: list[np.ndarray], length) -> np.ndarray:  # noqa: ANN001
        key = np.uint64(length) * _MIX[0] if np.isscalar(length) else length * _MIX[0]
        for block, mix in zip(blocks, _MIX, strict=False):
            key = (key ^ block) * mix
            key = key ^ (key >> np.uint64(29))
        # the top bits choose the filter's place
        return key * _MIX[1]

    def lay_out(self, words: list[bytes]) -> None:
        """Find every piece in the words, each with its blank in front."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        longest = int(sizes[0]) if len(sizes) else 0
        # reach[p]: how many words have a node at position p; base[p]: the number of the first
        self.reach = np.searchsorted(-sizes, -np.arange(longest + 1), side="right")
        self.base = np.r_[0, np.cumsum(self.reach)]
        data = b"".join([b" " + words[k] for k in self.order.tolist()]) + b"\0" * (8 * _BLOCKS + 8)
        starts = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        at = np.arange(total)
        word = np.repeat(np.arange(len(sizes)), sizes)
        position = at - starts[word]
        left = sizes[word] - position
        window = _blocks(data)
        self.sizes = sizes
        flat = np.frombuffer(data, np.uint8, total)
        node = self.base[position] + word
        self.bytes = np.zeros(int(self.base[-1]), np.int64)
        self.bytes[node] = flat
        self.found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        alive = at
        for length in self.used:
            alive = alive[left[alive] >= length]
            if not len(alive):
                break
            full, rest = divmod(length, 8)
            blocks = [window[alive + 8 * k] for k in range(full)]
            if rest:
                blocks.append(window[alive + 8 * full] & _MASKS[rest])
            zero = np.zeros(1, np.uint64)
            key = self._key(blocks + [zero] * (_BLOCKS - len(blocks)), np.full(1, length, np.uint64))
            maybe = np.flatnonzero(self.filter[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
            number = self.numbers[place]
            same = (self.keys[place] == key[maybe]) & (self.lengths[number] == length)
            for k, block in enumerate(blocks):
                same &= self.blocks[number, k] == block[maybe]
            hit = alive[maybe[same]]
            if len(hit):
                nodes = node[hit]
                sort = np.argsort(nodes)
                nodes = nodes[sort]
                # where each position's hits begin
                self.found[length] = nodes, number[same][sort], np.searchsorted(nodes, self.base)

    def _edges(self, position: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, pieces) of the pieces of this length that start at this position."""
        nodes, numbers, first = self.found[length]
        part = slice(first[position], first[position + 1])
        return nodes[part] - self.base[position], numbers[part]

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all ways to each node."""
        total = np.zeros(int(self.base[-1]))
        for p in range(1, len(self.reach)):
            n, here, before = int(self.reach[p]), self.base[p], self.base[p - 1]
            reached = total[before : before + n] + weights[self.bytes[before : before + n]]
            for length in self.found:
                if length <= p:
                    words, pieces = self._edges(p - length, length)
                    if len(words):
                        way = total[self.base[p - length] + words] + weights[pieces]
                        reached[words] = np.logaddexp(reached[words], way)
            total[here : here + n] = reached
        return total

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The natural log of each word's probability."""
        found = np.zeros(len(self.sizes))
        found[self.order] = self.forward(weights)[self.base[self.sizes] + np.arange(len(self.sizes))]
        return found

    def expected(self, weights: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected, in UNITS, when word k occurs times[k] times."""
        before = self.forward(weights)
        after = np.full(len(before), -np.inf)
        ends = self.base[self.sizes] + np.arange(len(self.sizes))
        after[ends] = 0.0
        logs, times = before[ends], times[self.order] * float(UNITS)
        counts = np.zeros(self.size)
        for p in range(len(self.reach) - 1, 0, -1):
            n, here, start = int(self.reach[p]), self.base[p], self.base[p - 1]
            reached = after[here : here + n]
            self._share(counts, weights, self.bytes[start : start + n], before[start : start + n], reached, logs[:n], times[:n])
            after[start : start + n] = np.logaddexp(after[start : start + n], reached + weights[self.bytes[start : start + n]])
            for length in self.found:
                if length <= p:
                    words, pieces = self._edges(p - length, length)
                    if len(words):
                        source = self.base[p - length] + words
                        self._share(counts, weights, pieces, before[source], reached[words], logs[words], times[words])
                        after[source] = np.logaddexp(after[source], reached[words] + weights[pieces])
        return counts.astype(np.int64)

    @staticmethod
    def _share(counts, weights, pieces, before, after, logs, times) -> None:  # noqa: ANN001
        # whole numbers: sums do not depend on the order of words, tasks or batches
        share = np.rint(np.exp(before + weights[pieces] + after - logs) * times)
        counts += np.bincount(pieces, share, len(counts))


_LATTICES: dict[int, Lattice] = {}  # one per Python worker


def _lattice(vocabulary: Vocabulary) -> Lattice:
    key = hash((len(vocabulary.pieces), tuple(vocabulary.pieces[::97])))
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(vocabulary)
    return _LATTICES[key]


def _chunks(words: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Stretches of words of about `most` bytes, a word at least."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start = 0
    while start < len(words):
        limit = (ends[start - 1] if start else 0) + most
        end = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
        yield start, end
        start = end


def word_scores(words: list[bytes], vocabulary: Vocabulary, weights: np.ndarray) -> np.ndarray:
    """The natural log of the probability of each word."""
    lattice = _lattice(vocabulary)
    scores = np.zeros(len(words))
    # words of like length together: a long one costs as many steps as it has bytes
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    listed = [words[k] for k in order]
    for start, end in _chunks(listed):
        lattice.lay_out(listed[start:end])
        scores[order[start:end]] = lattice.scores(weights)
    return scores


# The corpus: word counts, and the pieces' weights


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) over the training rows; the null word is the end, once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = as_bytes(batch.column(0))
            counts = Counter(chain.from_iterable((t or b"").translate(_LOWER).split() for t in texts))
            words: list[bytes | None] = [*counts, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([*counts.values(), len(texts)], pa.int64())], ["word", "n"]
            )

    read = docs.filter(~held_out(key)).select(text_column(f"`{text}`").alias("_text"))
    return read.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn_weights(counts: DataFrame, vocabulary: Vocabulary, rounds: int = 3, prior: float = 1000.0) -> np.ndarray:
    """Natural logs of the weights of all pieces and, last, of the end.

    Each round is one pass over the distinct words. What comes back to the driver is a
    number per piece. The vocabulary's own weights count as `prior` occurrences.
    """
    ends = counts.filter("word is null").agg(F.sum("n")).first()[0] or 0
    words = counts.filter("word is not null")
    weights = np.log(vocabulary.prior)
    for _ in range(rounds):
        now = weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, found = _lattice(vocabulary), np.zeros(len(vocabulary.pieces), np.int64)
            for batch in batches:
                rows = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=lambda r: -len(r[0]))
                listed, times = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
                for start, end in _chunks(listed):
                    lattice.lay_out(listed[start:end])
                    found += lattice.expected(now, times[start:end])
            seen = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(found[seen], pa.int64())], ["piece", "n"])

        summed = words.mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"))
        expected = vocabulary.prior * prior
        for piece, n in summed.collect():  # one row per piece
            expected[piece] += float(n) / UNITS
        expected[vocabulary.end] += ends
        weights = np.log(expected / expected.sum())
    return weights


_RARE = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32())])


def _word_hash(word: Column) -> list[Column]:
    return [F.xxhash64(word).alias("h1"), F.xxhash64(F.concat(word, F.lit(b"\x01"))).alias("h2")]


def _signed(number: int) -> int:
    return number - (number >> 63 << 64)


@dataclass(frozen=True)
class Frequent:
    """The most frequent words by number, their counts and the logs of their probabilities."""

    number: dict[bytes, int]
    counts: np.ndarray
    logs: np.ndarray


def scored_words(counts: DataFrame, least: int, vocabulary: Vocabulary, weights: np.ndarray) -> Frequent:
    """The words of (word, n) with at least `least` occurrences, each scored once, by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = word_scores(batch.column(0).to_pylist(), vocabulary, weights)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], ["word", "n", "log"])

    scored = counts.filter(F.col("n") >= least).select("word", "n").mapInArrow(run, "word binary, n long, log double")
    listed = scored.collect()  # as many as the floor allows
    number = {bytes(r["word"]): k for k, r in enumerate(listed)}
    return Frequent(number, np.array([r["n"] for r in listed], np.int64), np.array([r["log"] for r in listed], np.float64))


def _score_rows(docs: DataFrame, vocabulary: Vocabulary, weights: np.ndarray, frequent: Frequent, ends: int, key: str, text: str) -> DataFrame:
    """One row per document: sums over its frequent words, its score, and its other words."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", _SLICE):
            tokens = [(t or b"").translate(_LOWER).split() for t in as_bytes(batch.column(2))]
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            flat = list(chain.from_iterable(tokens))
            number = {w: k for k, w in enumerate(dict.fromkeys(flat))}
            at = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
            row = np.repeat(np.arange(len(tokens)), sizes)
            words = list(number)
            found = np.fromiter((frequent.number.get(w, -1) for w in words), np.int64, len(words))
            listed, new = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
            logs, known = np.zeros(len(words)), np.full(len(words), -1, np.int64)
            logs[listed], known[listed] = frequent.logs[found[listed]], frequent.counts[found[listed]]
            logs[new] = word_scores([words[k] for k in new.tolist()], vocabulary, weights)
            base = np.log10(np.maximum(known, 0) + 1.0)
            n = len(tokens)
            rare = np.flatnonzero(known[at] < 0)
            # what a document has several times is one entry
            pair, times = np.unique(row[rare] * max(1, len(words)) + at[rare], return_counts=True)
            which = pair % max(1, len(words))
            distinct = np.unique(which)
            hashes = np.zeros((2, max(1, len(words))), np.int64)
            for k in distinct.tolist():
                hashes[0, k] = _signed(xxhash.xxh64_intdigest(words[k], 42))
                hashes[1, k] = _signed(xxhash.xxh64_intdigest(words[k] + b"\x01", 42))
            offsets = np.searchsorted(pair // max(1, len(words)), np.arange(n + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays(
                [pa.array(hashes[0, which]), pa.array(hashes[1, which]), pa.array(times.astype(np.int32))], fields=list(_RARE)
            )
            columns = {
                "_key": batch.column(0),
                "held_out": batch.column(1),
                "n_tokens": pa.array(sizes + 1),
                "_known": pa.array(np.bincount(row, known[at] >= 0, n).astype(np.int64) + (ends > 0)),
                "_base": pa.array(np.bincount(row, base[at], n) + math.log10(ends + 1)),
                "score": pa.array((np.bincount(row, logs[at], n) + weights[vocabulary.end]) / math.log(10)),
                "_rare": pa.ListArray.from_arrays(pa.array(offsets), values),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    read = docs.select(F.col(f"`{key}`").alias("_key"), held_out(key).alias("held_out"), text_column(f"`{text}`").alias("_text"))
    schema = (
        f"_key {kind}, held_out boolean, n_tokens long, _known long, _base double, score double, "
        "_rare array<struct<h1: long, h2: long, n: int>>"
    )
    return read.mapInArrow(run, schema)


def score_texts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", rounds: int = 3, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document.

    `score` is the log10 of the text's probability: lower-cased words (A-Z only) and one
    end. `base_score` weighs whole words with one added to each count. Both learn from rows
    that are not held out; with `rounds` 0 `score` uses the vocabulary's weights alone. A
    null or empty text has only its end. Repeated rows count and are scored as often as
    they occur; a null key is a training row. Without any training row counts are zero.
    Other columns are not read; an empty table gives no rows.

    Counts and scores of up to `frequent_words` most frequent words, none of over FREQUENT_BYTES
    bytes, go to every task; all other words of a document are joined with their counts, so
    results do not depend on that number.
    """
    spark = docs.sparkSession
    vocabulary = load_vocabulary(model_path)
    counts = stored(word_counts(docs, key, text), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.filter("word is null").agg(F.sum("n")).first()[0] or 0
    weights = learn_weights(counts, vocabulary, rounds)
    short = counts.filter(F.col("word").isNotNull() & (F.length("word") <= FREQUENT_BYTES))
    least = frequency_floor(short, "n", frequent_words)
    frequent = scored_words(short, least, vocabulary, weights)
    rows = _score_rows(docs, vocabulary, weights, frequent, ends, key, text)
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "scored")
    met = (F.length("word") > FREQUENT_BYTES) | (F.col("n") < least)
    others = counts.filter(F.col("word").isNotNull() & met).select(*_word_hash(F.col("word")), F.col("n").alias("_count"))
    pairs = rows.select("_row", F.inline("_rare"))
    more = pairs.join(others, ["h1", "h2"]).groupBy("_row").agg(
        F.sum("n").alias("_more_known"), F.sum(F.col("n") * F.log10(F.col("_count") + 1.0)).alias("_more_base")
    )
    whole = rows.drop("_rare").join(more, "_row", "left")
    some = F.lit(math.log10(total + distinct + 1))
    return whole.select(
        F.col("_key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("_known") + F.coalesce("_more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_more_base", F.lit(0.0)) - F.col("n_tokens") * some).alias("base_score"),
        "score",
    )
