import hashlib
from collections import Counter

import numpy as np
import pytest

from edgelytics.llm import line_dedup
from edgelytics.llm.line_dedup import PerfectHash
from tests.llm.helpers import TEXTS, documents


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def brute(texts, least, length=1):
    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < length or counts[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def run(docs, **options):
    found = line_dedup.drop_shared_lines(docs, **options)
    return [(r["n_lines"], r["n_dropped"], r["kept_sha256"], r["kept_text"]) for r in found.orderBy("doc_id").collect()]


@pytest.mark.parametrize("options", [{}, {"shard_keys": 7, "copies": 3}, {"least_length": 4}])
def test_as_brute_force(spark, options):
    rng = np.random.default_rng(4)
    lines = [f"Line {k} {'x' * (k % 5)}" for k in range(40)] + ["", " ", "é", "\tA b\r", "a B", "abc"]
    texts = ["\n".join(lines[k] for k in rng.integers(0, len(lines), rng.integers(1, 9))) for _ in range(150)]
    texts += [*TEXTS.values(), "hot\n" * 5, *["hot\nown %d" % k for k in range(60)], *["copy\nof\nthis"] * 12]
    got = run(documents(spark, texts).repartition(5), least_documents=10, **options)
    assert got == brute(texts, 10, options.get("least_length", 1))


def test_rows_of_every_kind(spark):
    docs = spark.createDataFrame(
        [(1, "a\nb", 5), (1, "a\nc", 6), (None, "a", 7), (None, None, 8), (2, "d" * 2_000_000 + "\na", 9)],
        "doc_id long, text string, n_lines long",
    )
    found = line_dedup.drop_shared_lines(docs, least_documents=3)
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept_sha256", "kept_text"]
    got = sorted((r["text"] or "", r["n_lines"], r["n_dropped"], len(r["kept_text"])) for r in found.collect())
    assert got == [("", 1, 0, 0), ("a", 1, 1, 0), ("a\nb", 2, 1, 1), ("a\nc", 2, 1, 1), ("d" * 2_000_000 + "\na", 2, 1, 2_000_000)]
    assert line_dedup.drop_shared_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    low, high = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
    low[: n // 2] = 5  # told apart by the other word alone
    own = PerfectHash.unpack(PerfectHash.of(low, high).pack())
    assert own.size == n
    assert sorted(own.slots(low, high).tolist()) == list(range(n))
    assert sum(map(len, own.levels)) <= max(64, n)  # under 8 bits a key


def test_rows_of_one_key_get_the_lines_of_their_own_text(spark, monkeypatch):
    given = {}
    own = line_dedup._without
    monkeypatch.setattr(line_dedup, "_without", lambda joined, *args: given.setdefault("joined", joined) and own(joined, *args))
    texts = [f"shared {k}\nonly {k} {i}" for k in range(8) for i in range(10)] + ["shared 1\nshared 2"] * 3
    docs = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = line_dedup.drop_shared_lines(docs).collect()
    assert sorted(r["kept_text"] for r in rows) == sorted([f"only {k} {i}" for k in range(8) for i in range(10)] + [""] * 3)
    found = [(r["_text"], len(r["_drop"])) for r in given["joined"].select("_text", "_drop").collect()]
    assert all(n == sum(x.startswith("shared") for x in t.split("\n")) for t, n in found)
