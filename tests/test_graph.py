"""Edges, partners, what-if, multi-hop queries; brute force on random graphs."""

import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from edgelytics.functions.filters import EdgeFilter
from edgelytics.operators import edges as eg
from edgelytics.operators import hops, hub_join, partners, whatif
from edgelytics.plans.neuron_report import SECTIONS, neuron_report, neuron_report_counts
from edgelytics.schema import CONNECTIONS, EDGES


def test_edges(tiny, tiny_edges):
    assert tiny_edges.schema.names == EDGES.names
    assert rows(tiny_edges, "src", "dst", "neuropil", "syn_count", "ord") == [
        (1, 2, "AL_L", 9, 8),
        (1, 2, "AL_R", 3, 2),
        (2, 3, "AL_L", 7, 3),
        (2, 4, "FB", None, 6),
        (3, 1, "AL_L", 2, 4),
        (3, 3, "FB", 4, 5),
        (4, 5, "FB", 6, 7),
    ]
    assert rows(eg.rejected_connections(tiny), "ord") == [(9,)]
    assert [r[0] for r in rows(eg.neurons(tiny_edges))] == [1, 2, 3, 4, 5]
    assert tuple(eg.graph_counts(tiny_edges).first()) == (7, 5)
    assert tuple(eg.top_out_degree(tiny_edges).first()) == (1, 2)
    assert dict(rows(eg.out_degree(tiny_edges))) == {1: 2, 2: 2, 3: 2, 4: 1}


def test_latest_row_wins_even_with_nulls(spark):
    data = [
        (1, 1, 2, "FB", 5, 0.5, None, None, None, None, None),
        (2, 1, 2, "FB", None, None, None, None, None, None, 0.25),
    ]
    found = eg.latest_edges(spark.createDataFrame(data, CONNECTIONS)).first()
    assert (found.syn_count, found.gaba_avg, found.da_avg, found.dominant_nt, found.ord) == (
        None, None, 0.25, "Dopamine", 2,
    )


def test_upsert(spark, tiny, tiny_edges):
    later = [
        (1, 1, 2, "AL_L", 40, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0),
        (2, 7, 8, "EB", 1, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0),
        (3, 7, None, "EB", 1, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0),
    ]
    merged = eg.upsert_edges(tiny_edges, spark.createDataFrame(later, CONNECTIONS))
    found = {(r.src, r.dst, r.neuropil): (r.syn_count, r.dominant_nt) for r in merged.collect()}
    assert len(found) == merged.count() == 8
    # An incoming row replaces an existing edge although its position is lower.
    assert found[1, 2, "AL_L"] == (40, "Glutamate") and found[7, 8, "EB"] == (1, "GABA")
    assert found[2, 3, "AL_L"] == (7, "GABA,Acetylcholine")


def roots_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "root_id bigint")


def test_partners(spark, tiny_edges):
    listed = partners.strongest_first(partners.postsynaptic(tiny_edges, [1]))
    assert [tuple(r)[1:5] for r in listed.collect()] == [
        (2, 9, "AL_L", "GABA"),
        (2, 3, "AL_R", "Acetylcholine"),
    ]
    gaba = partners.postsynaptic(tiny_edges, [2], EdgeFilter(0, "gaba"))
    assert rows(gaba, "partner_id", "syn_count", "neuropil") == [(3, 7, "AL_L")]
    assert rows(partners.presynaptic(tiny_edges, [3]), "partner_id", "syn_count") == [(2, 7), (3, 4)]
    assert partners.postsynaptic(tiny_edges, [99]).collect() == []
    assert partners.preview(partners.postsynaptic(tiny_edges), 3).count() == 3


@pytest.mark.parametrize("operator", [partners.postsynaptic, partners.presynaptic])
def test_roots_as_ids_table_or_all(spark, tiny_edges, operator, monkeypatch):
    ids = [1, 2, 3, 4, 5]
    everyone = rows(operator(tiny_edges))
    assert rows(operator(tiny_edges, ids)) == everyone
    assert rows(operator(tiny_edges, roots_of(spark, *ids, *ids))) == everyone
    monkeypatch.setattr(partners, "LITERAL_IDS", 2)
    assert rows(operator(tiny_edges, ids)) == everyone


def test_pairs(tiny_edges):
    found = [tuple(r) for r in partners.dataset_pairs(tiny_edges, limit=3).collect()]
    assert found == [
        (1, 2, 9, "GABA", "AL_L"),
        (2, 3, 7, "GABA,Acetylcholine", "AL_L"),
        (4, 5, 6, "", "FB"),
    ]
    assert partners.dataset_pairs(tiny_edges, limit=5000).count() == 6
    with pytest.raises(ValueError):
        partners.dataset_pairs(tiny_edges, limit=0)


def test_what_if(spark, tiny_edges):
    assert rows(whatif.boost(tiny_edges, [1])) == [
        (1, 2, 3, 6.0, "AL_R"),
        (1, 2, 9, 18.0, "AL_L"),
    ]
    assert rows(whatif.boost(tiny_edges, [2])) == [
        (2, 3, 7, 14.0, "AL_L"),
        (2, 4, None, 0.0, "FB"),
    ]
    assert {r[0] for r in rows(whatif.silence(tiny_edges), "effective_syn_count")} == {0.0}
    assert whatif.silence(tiny_edges).count() == 7
    scenarios = spark.createDataFrame([(1, 0.0), (3, 0.5)], "root_id bigint, factor double")
    found = rows(whatif.reweight(tiny_edges, scenarios), "source_id", "effective_syn_count")
    assert found == [(1, 0.0), (1, 0.0), (3, 1.0), (3, 2.0)]
    assert rows(partners.outgoing_edges(tiny_edges, [2])) == [(2, 3, 7, "AL_L"), (2, 4, None, "FB")]
    for unclear in ([(1, 2.0), (1, 3.0)], [(None, 1.0)]):
        with pytest.raises(ValueError, match="root_id"):
            whatif.reweight(tiny_edges, spark.createDataFrame(unclear, "root_id bigint, factor double"))


def test_two_hop(tiny_edges):
    down = hops.two_hop_downstream(tiny_edges, [1])
    assert down.columns == [
        "root_id", "post1_id", "post2_id", "syn_count_1", "syn_count_2", "neuropil_1", "neuropil_2",
    ]
    assert rows(down) == [
        (1, 2, 3, 3, 7, "AL_R", "AL_L"),
        (1, 2, 3, 9, 7, "AL_L", "AL_L"),
    ]
    up = hops.two_hop_upstream(tiny_edges, [3])
    columns = ["pre2_id", "pre1_id", "syn_count_1", "syn_count_2", "neuropil_1", "neuropil_2"]
    assert rows(up, *columns) == [
        (1, 2, 7, 3, "AL_L", "AL_R"),
        (1, 2, 7, 9, "AL_L", "AL_L"),
        (2, 3, 4, 7, "FB", "AL_L"),
    ]
    assert rows(hops.two_hop_downstream(tiny_edges, [99])) == []


def test_trail_lengths(tiny_edges):
    paths = hops.k_hop_downstream(tiny_edges, [1], k=5)
    assert dict(rows(paths.groupBy("hops").count())) == {1: 2, 2: 2, 3: 4, 4: 4, 5: 2}
    preview = hops.path_preview(paths)
    assert all(r.nodes == r.hops + 1 and r.edges == r.hops for r in preview.collect())
    assert {r.start for r in preview.collect()} == {1}


def test_path_structure(tiny_edges):
    longest = hops.k_hop_upstream(tiny_edges, [3], k=2).where("hops = 2 and nodes[0] = 2").first()
    assert longest.nodes == [2, 3, 3]
    assert [tuple(e) for e in longest.edges] == [
        (2, 3, 7, "AL_L", "GABA,Acetylcholine", 0.5),
        (3, 3, 4, "FB", "Dopamine", 0.7),
    ]


def test_hop_bounds(tiny_edges):
    for k in (0, 6):
        for operator in (hops.k_hop_downstream, hops.k_hop_upstream, hops.k_hop_nodes, hops.circuit):
            with pytest.raises(ValueError):
                operator(tiny_edges, [1], k)
    assert hops.k_hop_downstream(tiny_edges, [1], 7, max_hops=None).count() == 14


def test_circuits(tiny_edges):
    for k in (1, 2):
        found = hops.circuit(tiny_edges, [1], k)
        nodes = {r[0] for r in rows(hops.k_hop_nodes(tiny_edges, [1], k), "node_id")}
        assert nodes == {1, 2, 3} and found.count() == 5
    assert rows(hops.circuit(tiny_edges, [4], 1), "source_root_id", "target_root_id") == [(4, 5)]
    assert hops.circuit(tiny_edges, [4], 3, EdgeFilter(10)).collect() == []
    assert rows(hops.k_hop_nodes(tiny_edges, [3], 1, EdgeFilter(neuropil="fb"))) == [(3, 3)]


def test_circuit_documents(spark, tiny_edges):
    found = hops.circuit(tiny_edges, k=2)
    whole = hops.circuit_documents(found, pieces=1).collect()
    assert {r.piece for r in whole} == {0}
    by_root = {r.root_id: r.circuits[0].connections for r in whole}
    assert [tuple(c) for c in by_root[4]] == [(4, 5, "FB", 6, "")]
    pieces = hops.circuit_documents(found, pieces=3).collect()
    assert {r.piece for r in pieces} == {0, 1, 2}
    spread = [(r.root_id, *c) for r in pieces for c in r.circuits[0].connections]
    assert len(pieces) > len(whole) and sorted(spread) == rows(found)


# Brute force on random multigraphs with self-loops, parallel edges and a hub.


def random_edges(seed, neurons=9, count=26):
    rng = random.Random(seed)
    regions = ["A", "B", "C"]
    hub = [(0, n) for n in range(neurons)] + [(n, 0) for n in range(1, neurons)]
    ends = [(rng.randrange(neurons), rng.randrange(neurons)) for _ in range(count)]
    keys = {(a, b, rng.choice(regions)) for a, b in ends + hub}
    return sorted((a, b, r, rng.randint(1, 9)) for a, b, r in keys)


def edge_table(spark, edges):
    df = spark.createDataFrame(edges, "src bigint, dst bigint, neuropil string, syn_count int")
    for field in EDGES.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.select(EDGES.names)


def brute_trails(edges, k):
    found, level = [], [[e] for e in edges]
    while level and len(level[0]) <= k:
        found += level
        level = [t + [e] for t in level for e in edges if e[0] == t[-1][1] and e not in t]
    return found


def brute_nodes(edges, root, k):
    near = {n: set() for e in edges for n in e[:2]}
    for a, b, *_ in edges:
        near[a].add(b)
        near[b].add(a)
    if root not in near:
        return set()
    reached = {root}
    for _ in range(k):
        reached |= {b for a in reached for b in near[a]}
    return reached


@pytest.mark.parametrize(("seed", "cell_rows"), [(1, 1_000_000), (2, 20)])
def test_against_brute_force(spark, monkeypatch, seed, cell_rows):
    # small cells: nearly every neuron is cut as a hub would be
    monkeypatch.setattr(hub_join, "CELL_ROWS", cell_rows)
    if cell_rows == 20:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        everything = random_edges(seed)
        df = edge_table(spark, everything).cache()
        flt = EdgeFilter(threshold=4)
        edges = [e for e in everything if e[3] >= 4]
        trails = brute_trails(edges, 3)
        down = {(t[0][0], tuple(n[1] for n in t), tuple(n[2] for n in t)) for t in trails}
        paths = hops.k_hop_downstream(df, k=3, flt=flt).collect()
        assert len(paths) == len(trails)
        assert {
            (p.root_id, tuple(p.nodes[1:]), tuple(e.neuropil for e in p.edges)) for p in paths
        } == down
        up = hops.k_hop_upstream(df, roots_of(spark, 0, 3), k=3, flt=flt).collect()
        ending = [t for t in trails if t[-1][1] in (0, 3)]
        assert sorted((p.root_id, tuple(p.nodes)) for p in up) == sorted(
            (t[-1][1], (t[0][0], *[e[1] for e in t])) for t in ending
        )
        for k in (1, 2, 3):
            nodes = rows(hops.k_hop_nodes(df, k=k, flt=flt))
            expected = {r: brute_nodes(edges, r, k) for r in range(9)}
            assert nodes == sorted(((r, n) for r in expected for n in expected[r]), key=repr)
            inside = rows(
                hops.circuit(df, roots_of(spark, *range(12)), k, flt),
                "root_id", "source_root_id", "target_root_id", "neuropil", "syn_count",
            )
            assert inside == sorted(
                (
                    (r, *e)
                    for r, e in itertools.product(expected, edges)
                    if e[0] in expected[r] and e[1] in expected[r]
                ),
                key=repr,
            )
        two = rows(hops.two_hop_downstream(df, flt=flt), "root_id", "post1_id", "post2_id")
        assert two == sorted(
            ((t[0][0], t[0][1], t[1][1]) for t in trails if len(t) == 2), key=repr
        )
        listed = neuron_report(df, roots_of(spark, 0), k=3, flt=flt)
        assert rows(listed["two_hop_downstream"]) == rows(hops.two_hop_downstream(df, [0], flt))
        assert rows(listed["k_hop_upstream"]) == rows(hops.k_hop_upstream(df, [0], 3, flt))
        assert rows(listed["circuit"]) == rows(hops.circuit(df, [0], 3, flt))
        partner = ["root_id", "partner_id", *hops.PATH_ATTRIBUTES]
        assert rows(listed["presynaptic"]) == rows(partners.presynaptic(df, [0], flt), *partner)
        report = neuron_report_counts(df, roots_of(spark, 0, 77), k=3, flt=flt)
        counts = {(r.root_id, r.section): r.rows for r in report.collect()}
        assert len(counts) == 2 * len(SECTIONS) and counts[77, "circuit"] == 0
        assert counts[0, "k_hop_downstream"] == sum(t[0][0] == 0 for t in trails)
        assert counts[0, "two_hop_upstream"] == sum(t[-1][1] == 0 and len(t) == 2 for t in trails)
        assert counts[0, "presynaptic"] == sum(e[1] == 0 for e in edges)
        df.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_upstream_is_downstream_of_the_reversed_graph(spark):
    edges = random_edges(5)
    forward = edge_table(spark, edges)
    backward = edge_table(spark, [(b, a, r, s) for a, b, r, s in edges])
    up = hops.k_hop_upstream(forward, [0], k=2).select("root_id", F.reverse("nodes"))
    assert rows(up) == rows(hops.k_hop_downstream(backward, [0], k=2), "root_id", "nodes")


def test_recursive_sql_lists_the_same_trails(spark):
    edge_table(spark, random_edges(7)).createOrReplaceTempView("e")
    listed = spark.sql("""
        with recursive t (root, tip, hops, used) as (
          select src, dst, 1, array(concat_ws(':', src, dst, neuropil)) from e
          union all
          select t.root, e.dst, t.hops + 1, array_append(t.used, concat_ws(':', e.src, e.dst, e.neuropil))
          from t join e on e.src = t.tip
          where t.hops < 3 and not array_contains(t.used, concat_ws(':', e.src, e.dst, e.neuropil)))
        select root, hops, tip from t""")
    paths = hops.path_preview(hops.k_hop_downstream(spark.table("e"), k=3))
    assert rows(paths, "root_id", "hops", "end") == rows(listed)


@pytest.mark.parametrize(("cell_rows", "pack_roots"), [(1_000_000, 4096), (1_000_000, 2), (20, 3), (1_000, 4096)])
def test_circuits_of_every_neuron_against_brute_force(spark, monkeypatch, cell_rows, pack_roots):
    """Lists of roots in one or many parts, with a hub cut or not, repeated rows and null ids."""
    monkeypatch.setattr(hub_join, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(hops, "PACK_ROOTS", pack_roots)
    edges = random_edges(5)
    edges += edges[::7]
    odd = [(None, 1, "A", 9), (2, None, "A", 9), (None, None, "B", 9), (900, 900, "A", 9), (901, 902, "A", 1)]
    df = edge_table(spark, edges + odd).cache()
    usable = [e for e in [*edges, odd[3]] if e[3] >= 4]
    known = eg.degrees(df.where("src is not null and dst is not null"))
    columns = ["root_id", "source_root_id", "target_root_id", "neuropil", "syn_count"]
    for k, degrees in ((1, known), (2, None), (3, known)):
        near = {r: brute_nodes(usable, r, k) for r in {n for e in usable for n in e[:2]}}
        inside = rows(hops.circuit(df, None, k, EdgeFilter(threshold=4), degrees=degrees), *columns)
        expected = [(r, *e) for r in near for e in usable if e[0] in near[r] and e[1] in near[r]]
        assert inside == sorted(expected, key=repr)
    df.unpersist()


def test_paths_as_text(spark):
    """The texts are those of the listed nodes and edges, nulls included."""
    edges = random_edges(3)
    df = edge_table(spark, [*edges, (None, 1, "A", 9), (2, None, "A", 9), (0, 1, None, None)])
    df = df.withColumn("dominant_nt", F.when(F.col("syn_count") > 5, "GABA,Dopamine")).withColumn(
        "dominant_score", F.when(F.col("syn_count") > 3, F.col("syn_count") / 8)
    )
    nodes = F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes")
    steps = F.array_join(F.col("edges").cast("array<string>"), ";").alias("edges")
    for operator in (hops.k_hop_downstream, hops.k_hop_upstream):
        for roots, k in ((None, 2), ([0, 3], 3), ([77], 2)):
            listed = operator(df, roots, k).select("root_id", "hops", nodes, steps)
            assert rows(operator(df, roots, k, text=True)) == rows(listed)
