import numpy as np
import pytest
import xxhash

from edgelytics.llm import simhash
from tests.llm.helpers import TEXTS, documents, invented, words


def slow_fingerprint(text, width):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    grams = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if grams else 0


def groups(marks, bits):
    """Least index reachable, by comparing all."""
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(marks):
        for j in range(i):
            if (a ^ marks[j]).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(marks))]


@pytest.mark.parametrize("width", [1, 3, 5])
def test_fingerprints_bit_by_bit(width):
    rng = np.random.default_rng(width)
    for text in [*TEXTS.values(), "A b C d", *(invented(rng, n, 50) for n in (2, 3, 4, 200, 3000))]:
        assert simhash.fingerprint(None if text is None else text.encode(), width) == slow_fingerprint(text, width)


def clustered(rng, n):
    """64-bit values in clusters of few differing bits, chains included."""
    out = []
    while len(out) < n:
        value = int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(1, 12))):
            out.append(value)
            for b in rng.integers(0, 64, int(rng.integers(0, 5))):
                value ^= 1 << int(b)
    return out[:n]


@pytest.mark.parametrize("seed", range(3))
def test_links_of_many_small_groups(spark, seed):
    rng = np.random.default_rng(seed)
    marks = [0, 2**64 - 1, 1, *clustered(rng, 300)]
    signed = [m - (m >> 63 << 64) for m in marks]
    fps = spark.createDataFrame([(s,) for s in signed] + [(None,)], "fp long")
    links = simhash.fingerprint_links(fps, 3, group_rows=16).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in links)
    distinct = sorted(set(marks))
    where = {m: i for i, m in enumerate(distinct)}
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(where[a & (2**64 - 1)]), find(where[b & (2**64 - 1)])))
        root[y] = x
    assert [find(i) for i in range(len(distinct))] == groups(distinct, 3)


def test_a_dense_group_gives_a_forest():
    rng = np.random.default_rng(1)
    # all within three bits of zero, so nearly all pairs link
    marks = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (3, 500), dtype=np.uint64), axis=0))
    marks = marks[np.argsort([simhash_rank(int(m)) for m in marks])]
    found = len(set(groups(marks.tolist(), 3)))
    a, b = simhash.forest([marks, marks], None, 3)
    assert len(a) == len(marks) - found and (np.bitwise_count(a ^ b) <= 3).all()
    one, two = marks[::2], marks[1::2]
    links = sum(len(simhash.forest(x, y, 3)[0]) for x, y in (([one, one], None), ([two, two], None), ([one, one], [two, two])))
    assert len(marks) - found <= links < 2 * len(marks)


def simhash_rank(value):
    for shift in (1, 2, 4, 8, 16, 32):
        value ^= value >> shift
    return value


def test_gray_order_of_neighbours(spark):
    values = [0, 1, 3, 2, 6, 7, 5, 4, 12]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "fp long, i int")
    assert [r["i"] for r in df.orderBy(simhash.gray_rank(df.fp)).collect()] == list(range(len(values)))


def test_documents_as_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [*TEXTS.values()]
    for _ in range(40):
        base = invented(rng, int(rng.integers(1, 400))).split()
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 4))):
            base[int(rng.integers(len(base)))] = "Changed"
            texts.append(" ".join(base))
    texts += ["same text again"] * 30
    got = simhash.near_duplicates(documents(spark, texts, clash="component").repartition(4), group_rows=8).collect()
    want = groups([slow_fingerprint(t, 3) for t in texts], 3)
    assert {r["doc_id"]: r["component"] for r in got} == dict(enumerate(want))
    hexed = simhash.near_duplicates(documents(spark, texts[:6])).select(simhash.hexadecimal(simhash.F.col("fp")).alias("h"), "doc_id")
    assert {r["doc_id"]: r["h"] for r in hexed.collect()} == {i: f"{slow_fingerprint(t, 3):016x}" for i, t in enumerate(texts[:6])}


def test_null_keys_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, None), (6, ""), (None, "zz")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component"]) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (7, 6), (6, 6), (None, None)], key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_copies_with_changed_words(spark):
    rng = np.random.default_rng(8)
    texts, family = [], []
    for f in range(60):
        base = invented(rng, 300, 5000).split()
        for copy in range(3):
            own = list(base)
            for k in range(copy * 2):  # no, two or four of 300 words changed
                own[int(rng.integers(300))] = f"new{f}{k}"
            texts.append(" ".join(own))
            family.append(3 * f)
    got = {r["doc_id"]: r["component"] for r in simhash.near_copies(documents(spark, texts)).collect()}
    assert got == dict(enumerate(family))


def test_views_never_meet(spark):
    sig = spark.createDataFrame([([3, -5, 7, 1, 2, -9, 4, 6],)], "sig array<long>")
    values = sig.select(*[simhash.view_of(k, 40) for k in range(12)]).first()
    whole = sum((v & (2**64 - 1)) << 64 * i for i, v in enumerate([3, -5, 7, 1, 2, -9, 4, 6]))
    assert [v & (2**40 - 1) for v in values] == [whole >> 40 * k & (2**40 - 1) for k in range(12)]
    codes = [(v & (2**64 - 1)) >> 40 for v in values]
    assert min((a ^ b).bit_count() for a in codes for b in codes if a != b) >= 4 and len(set(codes)) == 12


def test_links_that_fail_do_not_stand_in_for_one_that_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    free = np.r_[80:240, 320:480]  # whole views, so that the two alike meet only in views where all do
    marks = []
    for _ in range(6):
        base = rng.integers(0, 2, 512)
        for member in range(12):  # the first two are 75 bits apart, all others some 130 and more
            own = base.copy()
            if member:
                own[rng.choice(free, 75 if member == 1 else 140, replace=False)] ^= 1
            marks.append(np.packbits(own.astype(np.uint8), bitorder="little").view("<i8"))
    unsigned = [m.view(np.uint64) for m in marks]
    near = [(i, j) for i in range(72) for j in range(i) if np.bitwise_count(unsigned[i] ^ unsigned[j]).sum() <= 78]
    assert near == [(12 * f + 1, 12 * f) for f in range(6)]
    given = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(marks)], "doc_id long, sig array<long>")
    monkeypatch.setattr(simhash, "signatures", lambda *_: given)
    got = {r["doc_id"]: r["component"] for r in simhash.near_copies(given).collect()}
    assert got == {i: i - (i % 12 == 1) for i in range(72)}
