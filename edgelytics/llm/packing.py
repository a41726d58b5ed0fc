"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised once and cut into pieces of at most a sequence's length. Pieces
are dealt at random into groups of bounded size. A group is packed best-fit, longest
first; then a local search works on the bins that are not full: documents move, or are
exchanged one for one or two for one, so that the sum of squared fills grows, which
drains the emptiest bins until they are gone. Bins that stay open go on to a next round
with fewer groups of the same size, until one group is left or a round closes little:
then all bins of its groups are final. So no task sees more than a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edgelytics.llm.common import slices, stored, text_column

#: Words and pieces that a worker keeps the ids of, twice over while it takes some from the store before.
STORE_WORDS = 450_000
END = b"\0\0\0\0"  # id 0 ends each document

# Tokens

# What the vocabulary's own splitting does inside a word, for words of plain Latin letters.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Byte-level vocabularies write bytes that print as themselves, the others from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SIGNS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_LATIN = regex.compile(r"[!-~¡-ɏ]+")
_ODD_BLANKS = "\x1c\x1d\x1e\x1f\x85"  # str.split() cuts here, the tokenizer may not


class WordTokens:
    """Ids of texts by a vocabulary that lower-cases, drops white space and never joins two words.

    Words repeat, so each is encoded once and kept, as are the pieces that the vocabulary's
    pattern cuts words into: a piece on its own has the ids it has inside a word. A store of
    over `most` of them becomes the old one, which words in use are taken over from, and a
    new one begins. New pieces go to the vocabulary's model alone, without its splitting.
    """

    def __init__(self, path: str, most: int = STORE_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        #: the four bytes of each id
        self.named = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.most = most
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def _encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, "<u4").tobytes()

    def _learn_pieces(self, new: list[str]) -> None:
        words, named, join = self.words, self.named, b"".join
        merged = self.tokenizer.model.tokenize
        for piece in new:
            # the model sees a sign for each byte
            signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SIGNS)
            words[piece] = join([named[t.id] for t in merged(signs)])

    def _learn(self, new: list[str]) -> None:
        # a word of small Latin letters is a piece as it stands
        letters = [w for w in new if w.isascii() and w.isalpha() and w.islower()]
        self._learn_pieces(letters)
        if len(letters) == len(new):
            return
        words = self.words
        new = [w for w in new if w not in words]
        # the vocabulary's own normalising; blanks stay between the words
        simple = [w for w in new if w.isascii() and w.isprintable() and "<|" not in w]
        normal = " ".join(simple).lower().split(" ") if simple else []
        latin = [w for w in new if not w.isascii() and _LATIN.fullmatch(w) and "<|" not in w]
        if latin:
            folded = self.tokenizer.normalizer.normalize_str(" ".join(latin)).split(" ")
            if len(folded) == len(latin):
                simple += latin
                normal += folded
        # a word of letters, or one with a sign behind it, needs no pattern
        cut = [
            [n] if n.isalpha() else [n[:-1], n[-1]] if n[-1] in ".,!?;:" and n[:-1].isalpha() else _PIECES.findall(n)
            for n in normal
        ]
        self._learn_pieces([p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in words])
        for word, own in zip(simple, cut, strict=True):
            words[word] = words[own[0]] if len(own) == 1 else b"".join([words[p] for p in own])
        if len(simple) < len(new):
            for word in new:
                if word not in words:
                    words[word] = self._encoded(word)

    def _cut(self, text: str) -> list[str] | None:
        """The words, A-Z lower-cased as the vocabulary does; None if only the tokenizer can tell.

        A text with a sign of special tokens keeps its capitals, which those tell apart."""
        if any(c in text for c in _ODD_BLANKS):
            return None
        if "<|" in text:
            return text.split()
        return (text.lower() if text.isascii() else text.encode().lower().decode()).split()

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, 32 bits each, little-endian."""
        cut = [self._cut(t) for t in texts]
        at = 0
        while at < len(cut):  # a block of texts at a time, so that the store can start anew between
            if len(self.words) > self.most:
                self.old_words, self.words = self.words, {}
            block, size = at, 0
            seen: set[str] = set()
            while at < len(cut) and size < 200_000:
                seen.update(cut[at] or ())
                size += len(cut[at] or ())
                at += 1
            fresh = seen - self.words.keys()
            kept = fresh & self.old_words.keys()
            self.words.update((w, self.old_words[w]) for w in kept)
            self._learn(list(fresh - kept))
            for row in range(block, at):
                if cut[row] is None:
                    yield self._encoded(texts[row])
                else:
                    yield b"".join(map(self.words.__getitem__, cut[row]))


_LOADED: dict[tuple[str, int], WordTokens] = {}  # one store per Python worker, kept between tasks


def _tokens(path: str, most: int = STORE_WORDS) -> WordTokens:
    if (path, most) not in _LOADED:
        _LOADED[path, most] = WordTokens(path, most)
    return _LOADED[path, most]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, key: str = "doc_id", text: str = "text", with_ids: bool = False, store_words: int = STORE_WORDS) -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids): each document's ids and the closing id
    0, cut every `capacity` ids. A null text is an empty one, which still has its id 0.
    Without `with_ids` ids is null."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(vocabulary, store_words)
        for batch in slices(batches, "_text", 4 << 20):
            rows: list[tuple[int, int, int, int, int, bytes | None]] = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for row, ids in enumerate(tokens.ids(texts)):
                ids += END
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    rows.append((row, piece, start // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [batch.column(0).take(pa.array(columns[0], pa.int64()))]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays += [pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["_key", "piece", "start", "length", "ids_crc32", "ids"])

    read = docs.select(F.col(key).alias("_key"), text_column(text).alias("_text"))
    schema = f"_key {kind}, piece int, start long, length long, ids_crc32 long, ids binary"
    return read.mapInArrow(run, schema).withColumnRenamed("_key", key)


# Packing


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[own].append(item)
        else:
            own, room = len(bins), capacity
            bins.append([item])
        left = room - size
        by_room[left].append(own)
        rooms |= 1 << left
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over the bins that are not full.

    A step moves an item, exchanges one item for a smaller one, or two items for a smaller
    one, so that the sum of squared fills grows, which drains the emptiest bins until they
    are gone. All items and all pairs of a bin are tried against all other open bins, the
    emptiest bin first, each time with the step that raises the sum most. Ends when the
    bins are as few as the total allows, or when no step is left: the sum is bounded and
    grows by a whole number with each.
    """
    fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    least = -(-int(fill.sum()) // capacity)
    open_bins = np.flatnonzero(fill < capacity)
    count = len(bins)
    if count <= least or len(open_bins) < 2:
        return bins
    held = {int(b): list(bins[b]) for b in open_bins}
    item = np.array([i for b in open_bins for i in bins[b]], np.int64)
    size = np.array([lengths[i] for i in item], np.int64)
    place = {int(i): k for k, i in enumerate(item)}
    where = np.array([b for b in open_bins for _ in bins[b]], np.int64)

    def shift(one: int, target: int) -> None:
        k = place[one]
        source, length = int(where[k]), int(size[k])
        fill[source] -= length
        fill[target] += length
        where[k] = target
        held[source].remove(one)
        held[target].append(one)

    def step(given: list[int], source: int) -> bool:
        """Give these items for nothing or for a smaller item, whichever raises the sum most."""
        total, low = sum(lengths[i] for i in given), int(fill[source])
        best, chosen = 0, None
        if len(given) == 1:
            after = fill[open_bins] + total
            gain = np.where((after <= capacity) & (open_bins != source) & (fill[open_bins] > 0), after - low, 0)
            at = int(gain.argmax())
            if gain[at] > 0:
                best, chosen = total * int(gain[at]), (int(open_bins[at]), None)
        moved = total - size
        after = fill[where] + moved
        gain = np.where((moved > 0) & (after <= capacity) & (where != source), moved * (after - low), 0)
        at = int(gain.argmax())
        if gain[at] > best:
            chosen = int(where[at]), int(item[at])
        if chosen is None:
            return False
        target, back = chosen
        for one in given:
            shift(one, target)
        if back is not None:
            shift(back, source)
        return True

    changed = True
    while changed and count > least:
        changed = False
        for source in sorted(held, key=lambda b: int(fill[b])):
            going = bool(held[source])
            while going and held[source] and count > least:
                own = sorted(held[source], key=lambda i: -lengths[i])
                tries = {lengths[i]: [i] for i in own}
                going = any(step(given, source) for given in tries.values())
                if not going:
                    pairs = {lengths[i] + lengths[j]: [i, j] for k, i in enumerate(own) for j in own[k + 1 :]}
                    going = any(step(given, source) for given in pairs.values())
                changed |= going
                count -= not held[source]
    return [b for n, b in enumerate(bins) if n not in held] + [b for b in held.values() if b]


_PACKED = "group long, item long, length long, bin long, offset long, closed boolean"


def _round(pieces: DataFrame, capacity: int, full: int) -> DataFrame:
    """Each group of (group, item, length) packed; a bin is closed from `full` tokens on."""

    def run(group: pa.Table) -> pa.Table:
        lengths = group["length"].to_pylist()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        order = np.array([i for b in bins for i in b], np.int64)
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        sizes = np.array(lengths, np.int64)[order]
        before = np.cumsum(sizes) - sizes
        first = np.r_[True, number[1:] != number[:-1]]
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        closed = np.bincount(number, sizes)[number] >= full
        return pa.table(
            {
                "group": group["group"].take(pa.array(order)),
                "item": group["item"].take(pa.array(order)),
                "length": pa.array(sizes),
                "bin": pa.array(number),
                "offset": pa.array(offset),
                "closed": pa.array(closed),
            }
        )

    return pieces.groupBy("group").applyInArrow(run, _PACKED)


def pack(pieces: DataFrame, capacity: int, group_rows: int = 20_000, slack: int = 4) -> DataFrame:
    """`pieces` (with `length` at most `capacity`) with sequence_id and offset.

    Pieces are numbered and dealt to groups of about `group_rows`. Bins with no more than
    `slack` free places are final; the rest go to a next round. The last round is that of
    one group, or one that closes less than a fifth of its pieces: groups are dealt at
    random and have the same mix, so larger ones would hardly close more.
    """
    if group_rows > 1 << 22:
        raise ValueError("group_rows is at most 2^22, so that a group's bins can be numbered")
    numbered = stored(
        pieces.withColumn("item", F.monotonically_increasing_id()).withColumn("_deal", F.rand(20)), "pieces"
    )
    left = numbered.select("item", "length", "_deal")
    count = numbered.count()
    done, level = None, 0
    while count:
        groups = max(1, round(count / group_rows))
        dealt = left.select("item", "length", F.floor(F.col("_deal") * groups).cast("long").alias("group"))
        packed = stored(_round(dealt, capacity, capacity - slack), f"packed-{level}")
        rest = packed.filter("not closed")
        after = rest.count()
        last = groups == 1 or after > 0.8 * count
        # the number: 7 bits of the level (each leaves four fifths at most), 32 of the group, 24 of the bin
        name = F.lit(level << 56) + F.shiftleft("group", 24) + F.col("bin")
        final = (packed if last else packed.filter("closed")).select("item", name.alias("sequence_id"), "offset")
        done = final if done is None else done.union(final)
        if last:
            break
        left = rest.select("item", "length", F.rand(21 + level).alias("_deal"))
        count, level = after, level + 1
    if done is None:
        done = numbered.select("item", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return numbered.drop("_deal").join(done, "item").drop("item")


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    group_rows: int = 20_000,
    store_words: int = STORE_WORDS,
) -> DataFrame:
    """key, piece, start, length, ids_crc32, ids, sequence_id, offset: one row per piece.

    Only documents of over `capacity` ids are cut. A null or empty text is one id. Repeated
    rows are packed as often as they occur; a null key stays null; other columns are not
    read. An empty table gives no rows. Sequence numbers are unique, not dense. Fewer
    `store_words` take less memory of a worker and more time; ids are the same.
    """
    return pack(token_pieces(docs, vocabulary, capacity, key, text, with_ids, store_words), capacity, group_rows)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed ids of each sequence, 32 bits each; needs `with_ids`."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"))
