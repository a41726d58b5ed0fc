"""The registered queries on the smallest test tables: beside their SQL, or held to their contract."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as spark_entry
import corpus_pipeline
from edgelytics.llm import line_dedup, mixing, packing, toxicity
from edgelytics.llm.oracle import ORACLE
from edgelytics.llm.queries import QUERIES
from tools.check import normalised

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels", "benchmark")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(spark_entry.queries())
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_as_sql(spark, duck, name):
    got = normalised(QUERIES[name](spark, SF).toPandas())
    want = normalised(duck.execute(ORACLE[name]).fetch_df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_op1_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, vectors = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), np.float64)
    got = QUERIES["op1_robust_graph"](spark, SF).toPandas().groupby("query_id").vec_id.apply(set)
    hits = 0
    for query, found in got.items():
        order = [j for j in np.lexsort((ids, -(vectors @ vectors[ids == query][0]))) if ids[j] != query][:20]
        hits += len(found & set(ids[order]))
    assert list(got.index) == [i for i in ids if i % 20 == 0] and hits >= 0.95 * 20 * len(got)


@pytest.mark.parametrize("name", ["op2_url_filter", "op3_toxicity", "op5_mixing", "op6_simhash", "op7_sharding", "op8_packing"])
def test_one_row_each(spark, docs, name):
    rows = QUERIES[name](spark, SF).toPandas()
    key, given = ("page_id", spark.read.parquet(f"{SF}/pages.parquet")) if name.startswith("op2") else ("doc_id", docs)
    if name.startswith("op8"):
        rows = rows[rows.piece == 0]
    assert sorted(rows[key]) == sorted(r[0] for r in given.select(key).collect())


def test_op6_as_brute_force(spark, docs):
    from tests.llm.test_simhash import groups, slow_fingerprint

    texts = docs.orderBy("doc_id").collect()
    marks = [slow_fingerprint(r["text"], 3) for r in texts]
    want = {r["doc_id"]: (f"{m:016x}", texts[g]["doc_id"]) for r, m, g in zip(texts, marks, groups(marks, 3), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op6_simhash"](spark, SF).collect()} == want


def test_pipeline_stage_by_stage(spark, docs):
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas() if name == "packing" else stage(spark, docs, SF).collect(), None if name == "packing" else docs.schema)
        out[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns and (out[name].n_chars == out[name].text.str.len()).all()
    given = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.held_out())
    lexicon = toxicity.learn_lexicon(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    clean = {i for i, r in given.items() if lexicon.score(r["text"] or "")[0] < 0.5}
    assert set(out["toxicity"].doc_id) == clean and len(clean) > 0.7 * len(given)

    from tests.llm.test_line_dedup import brute

    ordered = sorted(clean)
    want = {i: row[3] for i, row in zip(ordered, brute([given[i]["text"] for i in ordered], 10), strict=True)}
    assert dict(zip(out["line_dedup"].doc_id, out["line_dedup"].text, strict=True)) == want

    from tests.llm.test_simhash import groups, slow_fingerprint

    order = sorted(want)
    group = groups([slow_fingerprint(want[i], 3) for i in order], 3)
    assert set(out["simhash_dedup"].doc_id) == {order[g] for g in group}

    taken = out["mixing"].assign(n=out["mixing"].text.map(lambda t: len(t.split()))).groupby("doc_id").n.sum()
    sizes = mixing.mix_sizes(spark.createDataFrame(out["simhash_dedup"])).toPandas()
    assert taken.to_dict() == sizes[sizes.taken > 0].set_index("doc_id").taken.to_dict()

    packed = out["packing"]
    tokens = packing.WordTokens(corpus_pipeline.vocabulary_path())
    assert packed.length.sum() == sum(len(b) // 4 + 1 for b in tokens.ids(out["mixing"].text.tolist()))
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.sequence_id.nunique() <= 1.01 * -(-packed.length.sum() // 2048) + 1


def test_line_hash_of_both_sides_agree():
    hi, lo = line_dedup._hash(b"x")
    assert line_dedup._signed_hash(b"x") == (hi - (hi >> 63 << 64), lo - (lo >> 63 << 64))


STAGES = dict(corpus_pipeline.STAGES)


def odd_documents(spark, rows):
    """Documents with columns named like what operators add or use inside."""
    names = ["score", "predicted", "hits", "n_lines", "kept_text", "row", "_row", "_text", "_rest", "times", "fp", "component", "a.b", "key"]
    kinds = ", ".join(f"`{n}` string" for n in names)
    data = [(k, t, "en", s, len(t or ""), *[f"{n}{i}" for n in names]) for i, (k, t, s) in enumerate(rows)]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {kinds}")


def test_stages_keep_clashing_columns_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    from tests.llm.helpers import TEXTS, invented

    rows = [(i, t, "s") for i, t in enumerate(TEXTS.values())]
    rows += [(10 + i, invented(rng, 80, 3000), f"s{i % 2}") for i in range(20)]
    rows += [(None, invented(rng, 40, 3000), None), (None, None, None), (40, "long " * 60_000, "s"), (12, rows[8][1], "s0"), (12, rows[8][1], "s0")]
    docs = odd_documents(spark, rows)
    extra = docs.columns[5:]
    given = {tuple(r[c] for c in extra): r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows = out.collect()
        for r in rows:  # each row still has its own columns, id and source
            own = given[tuple(r[c] for c in extra)]
            assert (r["doc_id"], r["lang"], r["source"], r["n_chars"]) == (own["doc_id"], own["lang"], own["source"], len(r["text"] or ""))
        if name == "toxicity":
            assert len(rows) == len(given)
        if name == "line_dedup":
            assert {r["text"] for r in rows} == {r["text"] or "" for r in given.values()}
        if name == "simhash_dedup":  # null ids stay; of the texts without words one
            kept = [r["doc_id"] for r in rows]
            assert kept.count(None) == 2 and kept.count(12) == 3 and len({0, 1, 2} & set(kept)) == 1
        docs = spark.createDataFrame(rows, out.schema)
    packed = STAGES["packing"](spark, docs, SF).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("texts", [[], [None, None, ""]])
def test_stages_over_empty_tables(spark, texts):
    docs = odd_documents(spark, [(i, t, None) for i, t in enumerate(texts)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert name == "packing" or out.columns == docs.columns
        assert not rows if not texts else name in ("mixing", "packing") or rows
        docs = spark.createDataFrame(rows, out.schema) if name != "packing" else out
