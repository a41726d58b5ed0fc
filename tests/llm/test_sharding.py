import zlib

import numpy as np
import pytest

from edgelytics.llm import sharding
from edgelytics.session import scratch_path
from tests.llm.helpers import TEXTS, documents, invented


@pytest.mark.parametrize("seed", range(4))
def test_rebalancing_evens_out_and_growing_only_gives(seed):
    rng = np.random.default_rng(seed)
    weight = {s: int(rng.pareto(1.2) * 1000) for s in range(512) if rng.random() < 0.9}
    first = sharding.even_map(7, 512)
    edited = sharding.rebalanced(first, weight, 7)
    assert [s for s, _ in edited] == list(range(512))

    def totals(owner, n):
        out = [0] * n
        for slot, shard in owner:
            out[shard] += weight.get(slot, 0)
        return out

    even, best = totals(edited, 7), sum(weight.values()) / 7
    assert max(even) <= max(max(weight.values()), best * 1.01)
    assert sharding.rebalanced(edited, weight, 7) == edited or max(totals(sharding.rebalanced(edited, weight, 7), 7)) <= max(even)
    more = sharding.grown(edited, weight, 7)
    assert all(new in (old, 7) for (_, old), (_, new) in zip(edited, more, strict=True))
    share = sum(weight.values()) / 8
    assert totals(more, 8)[7] <= max(share, max(weight.values()))


def test_rows(spark):
    rng = np.random.default_rng(1)
    texts = [*TEXTS.values(), *(invented(rng, int(rng.integers(1, 200))) for _ in range(600)), *["same"] * 50]
    path = scratch_path(spark, "map")
    docs = documents(spark, texts, clash="shard").repartition(3)
    rows = sharding.shard_documents(docs, 16, path).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    held, places = [0] * 16, {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        held[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert max(held) - min(held) <= 0.02 * max(held)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    maps = [{r["vslot"]: r["shard"] for r in sharding.read_map(spark, path, v).collect()} for v in (0, 1)]
    assert maps[0] == dict(sharding.even_map(16)) and maps[0] != maps[1]
    assert all(maps[1][r["vslot"]] == r["shard"] for r in rows)


def test_null_ids_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(None, f"t{k}") for k in range(50)] + [(1, "x")] * 5 + [(None, None)] * 2, "doc_id long, text string")
    rows = sharding.shard_documents(docs, 4, scratch_path(spark, "map")).collect()
    assert len(rows) == 57 and len({(r["shard"], r["slot"]) for r in rows}) == 57
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 4
    assert sharding.shard_documents(docs.limit(0), 4, scratch_path(spark, "map")).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    sharding.shard_documents(documents(spark, ["a"]), 2, scratch_path(spark, "map")).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("parts", [sharding.COPY_PARTS, 20])
def test_a_third_of_all_rows_alike(spark, monkeypatch, parts):
    """Shards are as even as without, places gapless, and no slot holds what the row holds."""
    monkeypatch.setattr(sharding, "equal_records", lambda docs, slots, own=sharding.equal_records: own(docs, slots, parts))
    rng = np.random.default_rng(3)
    other = [(k, invented(rng, int(rng.integers(1, 30)))) for k in range(2000)]
    docs = spark.createDataFrame([(None, "the same text " * 3)] * 1000 + other, "doc_id long, text string")
    rows = sharding.shard_documents(docs, 16, scratch_path(spark, "map")).collect()
    held, places, alike = [0] * 16, {}, {}
    for r in rows:
        held[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
        if r["doc_id"] is None:
            assert r["size"] == 43
            alike[r["vslot"]] = alike.get(r["vslot"], 0) + 1
    assert len(rows) == 3000 and sum(alike.values()) == 1000
    assert max(held) - min(held) <= (0.005 if parts > 20 else 0.02) * max(held)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(alike.values()) <= (10 if parts > 20 else 150)
