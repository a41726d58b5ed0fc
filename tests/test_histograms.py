"""Histograms, quantiles, tails and the summary document."""

import json
import random
from functools import reduce

import pytest
from conftest import NONE6, rows
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelytics.functions.transmitters import with_dominant
from edgelytics.operators import histogram as hg
from edgelytics.operators import sketches as sk
from edgelytics.operators import tails
from edgelytics.operators.reports import first_n_rows
from edgelytics.plans.summary import summarize, summarize_gold, summary_document
from edgelytics.schema import CONNECTIONS, SUMMARY_RECORD
from edgelytics.session import scratch_path
from edgelytics.sources import summaries


@pytest.fixture(scope="module")
def cube(tiny):
    cached = hg.connection_cube(with_dominant(tiny)).cache()
    yield cached
    cached.unpersist()


def test_hand_counts(cube, tiny):
    assert hg.row_count(cube).first()[0] == 9
    assert tuple(hg.unique_counts(tiny).first()) == (5, 5, 5, 3)
    assert tuple(hg.unique_counts(tiny, cube).first()) == (5, 5, 5, 3)
    assert rows(hg.hist_global(cube)) == [(v, 1) for v in (1, 2, 3, 4, 5, 6, 7, 9)]
    assert rows(hg.hist_by_neuropil(cube)) == [
        *[("AL_L", v, 1) for v in (2, 5, 7, 9)],
        ("AL_R", 3, 1),
        *[("FB", v, 1) for v in (4, 6)],
    ]
    by_nt = [("Acetylcholine", 3, 1), ("Acetylcholine", 7, 1), ("Dopamine", 4, 1)]
    by_nt += [("GABA", 5, 1), ("GABA", 7, 1), ("GABA", 9, 1), ("Glutamate", 2, 1)]
    assert rows(hg.hist_by_nt(cube)) == by_nt
    assert rows(hg.hist_by_nt(cube, include_unassigned=True)) == [("", 6, 1), *by_nt]
    assert tuple(hg.syn_stats(cube).first()) == (1, 9)
    totals = hg.with_total_pairs(hg.hist_by_neuropil(cube), "neuropil")
    assert dict(rows(totals, "neuropil", "total_pairs")) == {"AL_L": 4, "AL_R": 1, "FB": 2}


def test_slices_and_tails(cube):
    histograms = hg.all_histograms(cube)
    assert rows(hg.hist_slice(histograms, "AL_L", "GABA")) == [(5, 1), (7, 1), (9, 1)]
    assert rows(hg.hist_slice(histograms, "AL_R")) == [(3, 1)]
    assert rows(hg.hist_slice(histograms, nt="Dopamine")) == [(4, 1)]
    assert hg.hist_slice(histograms, "", "").count() == 8
    one = hg.hist_slice(histograms, "AL_R")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in one
    assert hg.tail_total(hg.hist_global(cube), 6).first()[0] == 3
    assert hg.tail_total(hg.hist_global(cube), 100).first()[0] == 0
    table = tails.tail_counts(hg.hist_by_neuropil(cube), "neuropil")
    assert dict(rows(tails.pairs_at_or_above(table, 5, "neuropil"))) == {"AL_L": 3, "AL_R": 0, "FB": 1}
    assert dict(rows(tails.pairs_at_or_above(table, 7, "neuropil")))["FB"] == 0
    assert rows(table.where("neuropil = 'AL_L'"), "syn_count", "at_or_above") == [
        (2, 4), (5, 3), (7, 2), (9, 1),
    ]


def test_region_dominant(cube):
    found = {r.neuropil: (r.nt, r.pairs) for r in tails.region_dominant_nt(hg.hist_by_neuropil_nt(cube), 5).collect()}
    assert found == {"AL_L": ("GABA", 3), "AL_R": ("Acetylcholine", 0), "FB": ("Dopamine", 0)}


def test_equal_tails_follow_the_vocabulary(spark):
    df = spark.createDataFrame(
        [("A", "Dopamine", 5, 2), ("A", "Serotonin", 5, 2), ("A", "Octopamine", 9, 1), ("A", "other", 9, 7)],
        "neuropil string, nt string, syn_count int, count bigint",
    )
    assert tails.region_dominant_nt(df, 1).first().nt == "Serotonin"
    assert tails.region_dominant_nt(df, 99).first().nt == "Octopamine"


def test_bubbles(cube):
    hists = hg.hist_by_neuropil(cube), hg.hist_by_neuropil_nt(cube)
    found = {r.neuropil: r for r in tails.region_bubbles(*hists, 5).collect()}
    assert found["AL_L"].marker_size == 72 and found["AL_R"].marker_size == 14
    assert found["FB"].label == "FB<br>pairs ≥ 5: 1<br>dominant: Dopamine"
    assert [found[r].grid_x for r in ("AL_L", "AL_R", "FB")] == [0, 1, 2]
    assert found["AL_R"].opacity == 0.2 and found["FB"].opacity == 0.95
    of_label = {r.neuropil: r for r in tails.region_bubbles(*hists, 5, "GABA").collect()}
    assert of_label["FB"].pairs == 0 and of_label["AL_L"].pairs == 3
    assert of_label["FB"].label == "FB<br>dominant: GABA<br>pairs ≥ 5: 0"
    assert {r.marker_size for r in tails.region_bubbles(*hists, 1000).collect()} == {14.0}


def test_quantiles_by_hand(cube):
    asked = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = dict(rows(hg.syn_quantiles(cube, asked)))
    assert found == {0.0: 1, 0.25: 3, 0.5: 5, 0.75: 7, 0.9: 9, 1.0: 9}
    assert rows(hg.syn_cdf(cube), "syn_count", "running")[-1] == (9, 8)


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_against_a_sorted_list(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([None, *range(1, 12)]) for _ in range(rng.randint(1, 60))] + [3]
    data = [(i, 1, 2, "FB", v, *NONE6) for i, v in enumerate(values)]
    df = hg.connection_cube(with_dominant(spark.createDataFrame(data, CONNECTIONS)))
    asked = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    ordered = sorted(v for v in values if v is not None)
    expected = {q: ordered[min(round(q * (len(values) - 1)), len(ordered) - 1)] for q in asked}
    assert dict(rows(hg.syn_quantiles(df, asked))) == expected


def test_no_synapse_counts(spark):
    data = [(1, 1, 2, "FB", None, *NONE6)]
    cube = hg.connection_cube(with_dominant(spark.createDataFrame(data, CONNECTIONS)))
    assert hg.syn_quantiles(cube, [0.5]).collect() == []
    ids = hg.unique_counts(spark.createDataFrame(data, CONNECTIONS))
    text = summary_document(cube, ids, "empty").first()[0]
    doc = json.loads(text)
    assert doc["total_rows"] == 1
    assert doc["syn_count"] == {"min": None, "max": None, "median": None, "quantiles": {}, "histogram": []}
    assert doc["by_neuropil"] == {}


def test_cubes_add_up(tiny):
    gold = with_dominant(tiny)
    early, late = gold.where("ord <= 4"), gold.where("ord > 4")
    merged = hg.merge_cubes(hg.connection_cube(early), hg.connection_cube(late))
    assert rows(merged.select("neuropil", "dominant_nt", "syn_count", "count")) == rows(
        hg.connection_cube(gold)
    )


def test_summary_document(cube, tiny):
    doc = json.loads(summary_document(cube, hg.unique_counts(tiny), "tiny", max_rows=9).first()[0])
    assert list(doc) == [
        "input", "max_rows", "total_rows", "neurotransmitters", "unique", "syn_count",
        "by_neuropil", "by_neurotransmitter",
    ]
    assert (doc["input"], doc["max_rows"], doc["total_rows"]) == ("tiny", 9, 9)
    assert doc["syn_count"]["median"] == 5 and doc["syn_count"]["quantiles"]["0.9"] == 9
    assert doc["syn_count"]["histogram"][0] == {"syn_count": 1, "count": 1}
    region = doc["by_neuropil"]["AL_L"]
    assert region["total_pairs"] == 4
    assert region["by_neurotransmitter"]["Acetylcholine"] == {
        "total_pairs": 1,
        "histogram": [{"syn_count": 7, "count": 1}],
    }
    assert list(doc["by_neurotransmitter"]) == ["Acetylcholine", "Dopamine", "GABA", "Glutamate"]
    few = summary_document(cube, hg.unique_counts(tiny), "tiny", quantiles=[1.0, 1e-05, 1.0])
    syn = json.loads(few.first()[0])["syn_count"]
    assert syn["median"] == 5 and syn["quantiles"] == {"1.0": 9, "1e-05": 1}
    stored = json.loads(
        summary_document(
            cube, hg.unique_counts(tiny), "tiny", quantiles=None, include_unassigned=True
        ).first()[0]
    )
    assert stored["syn_count"]["median"] is None and stored["syn_count"]["quantiles"] == {}
    assert stored["by_neurotransmitter"][""]["total_pairs"] == 1


def test_summaries_of_raw_rows_and_dataset(tiny):
    raw = json.loads(summarize(first_n_rows(tiny, 4), "raw", max_rows=4).first()[0])
    assert (raw["total_rows"], raw["max_rows"], raw["unique"]["neuropil"]) == (4, 4, 2)
    gold = json.loads(summarize_gold(with_dominant(tiny), "gold").first()[0])
    assert gold["syn_count"]["quantiles"] == {} and "" in gold["by_neurotransmitter"]
    whole = json.loads(summarize(tiny, "gold").first()[0])
    assert gold["unique"] == whole["unique"]
    assert gold["by_neuropil"]["AL_L"] == whole["by_neuropil"]["AL_L"]


def test_summary_histograms(cube, tiny):
    document = summary_document(cube, hg.unique_counts(tiny), "tiny")
    found = summaries.summary_histograms(document)
    assert rows(found) == rows(hg.all_histograms(cube))


def test_summary_records(spark, tmp_path):
    minimal = {"input": "pytest", "max_rows": 1, "total_rows": 1, "unique": {}, "syn_count": {}}
    source = tmp_path / "summary.json"
    source.write_text(json.dumps(minimal) + "\n")
    table = scratch_path(spark, "records")
    document = summaries.read_summary_json(spark, str(source))
    summaries.push_summary(document, table, "a")
    summaries.push_summary(document, table, "b")
    changed = spark.createDataFrame(
        [('{"input": "new", "total_rows": 7, "max_rows": true, "unique": {"neuropil": "3.7"}, "syn_count": {"min": 2.0, "max": "5", "median": 3.7}}',)],
        "summary_json string",
    )
    summaries.push_summary(changed, table, "a")
    record = summaries.fetch_summary(spark, table, "b").first()
    assert json.loads(record.summary_json) == minimal
    assert (record.total_rows, record.max_rows, record.syn_min) == (1, 1, None)
    again = summaries.fetch_summary(spark, table, "a").collect()
    assert [(r.input, r.total_rows, r.syn_min, r.syn_median) for r in again] == [("new", 7, 2, 3)]
    assert [(r.max_rows, r.neuropil, r.syn_max) for r in again] == [(None, None, None)]  # not numbers
    assert again[0].updated_at is not None
    assert summaries.fetch_summary(spark, table, "none").collect() == []
    assert summaries.fetch_summary(spark, table, "a").schema.names == SUMMARY_RECORD.names
    broken = spark.createDataFrame([("not json",)], "summary_json string")
    with pytest.raises(Exception, match="not valid JSON"):
        summaries.summary_record(broken, "x").collect()


def test_tail_lookup_matches_direct_count(cube, tiny):
    table = tails.tail_counts(hg.hist_by_neuropil_nt(cube), "neuropil", "nt")
    for threshold in range(0, 11):
        looked_up = tails.pairs_at_or_above(table, threshold, "neuropil", "nt").where("pairs > 0")
        direct = (
            hg.hist_by_neuropil_nt(cube)
            .where(F.col("syn_count") >= threshold)
            .groupBy("neuropil", "nt")
            .agg(F.sum("count").alias("pairs"))
        )
        assert rows(looked_up) == rows(direct)


def test_approximate_counts_merge_and_keep_their_error(spark, tiny):
    ids = spark.range(200_000)
    split = [ids.where(F.col("id") % 3 == n) for n in range(3)]
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in CONNECTIONS.fields[3:]]
    parts = [
        part.select(F.col("id").alias("ord"), (F.col("id") % 50_000).alias("pre_pt_root_id"), (F.col("id") + 20_000).alias("post_pt_root_id"), *rest)
        for part in split
    ]
    sketches = reduce(DataFrame.union, [sk.id_sketches(p) for p in parts])
    cube = hg.connection_cube(with_dominant(parts[0]))
    got = sk.approx_unique_counts(sketches, cube).first()
    want = (50_000, 200_000, 220_000, 0)
    assert list(got.asDict()) == hg.unique_counts(tiny).columns
    assert all(abs(g - w) <= 0.024 * w for g, w in zip(got, want, strict=True))  # three standard errors
    # merged at once, in steps, or made in one go: the same registers
    whole = sk.id_sketches(reduce(DataFrame.union, parts))
    steps = sk.merge_sketches(sk.merge_sketches(sketches.limit(2)).union(sk.id_sketches(parts[2])))
    assert got == sk.approx_unique_counts(whole, cube).first() == sk.approx_unique_counts(steps.union(whole), cube).first()
    none = tiny.where("false")
    assert tuple(sk.approx_unique_counts(sk.id_sketches(none), hg.connection_cube(with_dominant(none))).first()) == (0, 0, 0, 0)
