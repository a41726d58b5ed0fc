"""Relations between operators that must hold on any data."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from edgelytics.functions.filters import EdgeFilter
from edgelytics.functions.transmitters import with_dominant
from edgelytics.operators import edges as eg
from edgelytics.operators import histogram as hg
from edgelytics.operators import hops, partners, tails
from edgelytics.session import materialize
from edgelytics.workload.tables import connections

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def raw(spark):
    return materialize(connections(spark, SF), "raw").df


@pytest.fixture(scope="module")
def edges(raw):
    return materialize(eg.latest_edges(raw), "edges").df


def test_histograms_account_for_every_row(raw):
    cube = materialize(hg.connection_cube(with_dominant(raw)), "cube").df
    assert hg.row_count(cube).first()[0] == raw.count()
    counted = hg.hist_global(cube).agg(F.sum("count")).first()[0]
    assert counted == raw.where("syn_count is not null").count()
    by_region = hg.with_total_pairs(hg.hist_by_neuropil(cube), "neuropil")
    tail = tails.tail_counts(by_region, "neuropil")
    smallest = tail.groupBy("neuropil").agg(F.max("at_or_above").alias("n"), F.max("total_pairs").alias("t"))
    assert smallest.where("n <> t").count() == 0
    ties = hg.hist_by_nt(cube).agg(F.sum("count")).first()[0]
    assert ties >= hg.hist_by_neuropil(cube).agg(F.sum("count")).first()[0] * 0.9


def test_upsert_of_everything_changes_nothing(raw, edges):
    assert rows(eg.upsert_edges(edges, raw)) == rows(edges)
    assert eg.out_degree(edges).agg(F.sum("out_deg")).first()[0] == edges.count()


def test_hops_agree_with_each_other(edges):
    flt = EdgeFilter(threshold=20)
    paths = materialize(hops.k_hop_downstream(edges, k=2, flt=flt), "paths").df
    one = paths.where("hops = 1").selectExpr("root_id", "nodes[1] as partner_id", "edges[0].neuropil as neuropil")
    assert rows(one) == rows(partners.postsynaptic(edges, flt=flt), "root_id", "partner_id", "neuropil")
    two = paths.where("hops = 2").selectExpr("root_id", "nodes[1] as post1_id", "nodes[2] as post2_id")
    assert rows(two) == rows(hops.two_hop_downstream(edges, flt=flt), "root_id", "post1_id", "post2_id")


def test_circuits_hold_their_roots(edges):
    flt = EdgeFilter(threshold=45)
    nodes = materialize(hops.k_hop_nodes(edges, k=2, flt=flt), "nodes").df
    touched = eg.neurons(edges.where(flt.condition))
    assert rows(nodes.where("root_id = node_id"), "root_id") == rows(touched)
    # Reachability without direction is symmetric.
    assert rows(nodes) == rows(nodes.selectExpr("node_id", "root_id"))
    inside = hops.circuit(edges, k=2, flt=flt)
    ends = inside.selectExpr("root_id", "source_root_id as node_id").union(
        inside.selectExpr("root_id", "target_root_id as node_id")
    )
    assert rows(ends.distinct()) == rows(nodes)
