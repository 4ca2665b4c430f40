"""Queries on points so dense that the smallest tables say nothing about them, against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cladeframe.plans import catalog
from tests.oracle import assert_same


def points(folder, extra, base=120, copied="TRUE"):
    """A folder with embeddings alone: the smallest table's first rows and near copies of some of them, in the same frames."""
    con = duckdb.connect()
    path = f"{folder}/embeddings.parquet"
    con.execute(f"""COPY (SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE vec_id < {base}
      UNION ALL BY NAME SELECT * REPLACE (vec_id + k * 1000 AS vec_id, list_transform(embedding, lambda v, i: CAST(v + 0.0003 * ((vec_id * 7 + k * 3 + i) % 5) AS FLOAT)) AS embedding)
      FROM '/root/testdata/sf0.001/embeddings.parquet', range(1, {extra + 1}) r(k) WHERE vec_id < {base} AND {copied}) TO '{path}'""")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    return con


MATCHED = ["as1_match_nodes", "ag7_edge_outcomes", "ag7_edge_confusion", "ag8_adjusted_jaccard", "ag10_micro_average", "ag12_diagnostics", "ag13_score", "ag23_oracle_edges", "ag27_division_audit"]


@pytest.mark.parametrize("name", MATCHED)
def test_scores_with_several_partners_equal_sql(spark, tmp_path, name):
    con = points(tmp_path, 1, copied="vec_id % 40 = 3" if name in ("ag10_micro_average", "ag13_score") else "TRUE")  # their SQL refuses contested divisions
    assert_same(catalog.queries()[name](spark, str(tmp_path)), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["jn3_nearest_three", "jn3_nearest_any", "ag26_local_spacing", "as11_division_proposals"])
def test_searches_from_a_small_gate_equal_sql(spark, tmp_path, monkeypatch, name):
    from cladeframe.operators import spatial

    monkeypatch.setattr(spatial, "FEW_PAIRS", 0)  # as if the frames were dense
    con = points(tmp_path, 3)
    assert_same(catalog.queries()[name](spark, str(tmp_path)), con, catalog.oracle_sql()[name])


AT = ("'d' dataset", "id node_id", "int(id % 2) t", "rand(1) * 100 z", "rand(2) * 100 y", "rand(3) * 100 x")


def test_copies_for_neighbour_cells_are_not_broadcast(spark, tmp_path):
    from cladeframe.operators import spatial

    spark.range(40000).selectExpr(*AT).write.parquet(f"{tmp_path}/points")
    at = spark.read.parquet(f"{tmp_path}/points")
    plan = spatial.radius_join(at, at, 8.0, 1)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_dense_frames_start_small(spark):
    from cladeframe.operators import spatial

    at = spark.range(40000).selectExpr(*AT)
    assert spatial._first_gate(at, at, 1, 64.0, 1, spatial.UNIT) <= 8.0
    same = at.withColumns({a: F.lit(1.0) for a in "zyx"})
    assert spatial.nearest(same, same, 2, 4.0, 1).groupBy().agg({"right_id": "max"}).first()[0] == 3  # of copies the smallest ids


def edges_of(spark):
    """Edges with many equal probabilities and distances, as a table and as pairs made anew."""
    from cladeframe.operators.pairs import Pairs

    rows = [("d", s, 100 + t, float((s * 7 + t * 3) % 4) / 4, float((s + t) % 3)) for s in range(12) for t in range(9) if (s * t) % 5]
    df = spark.createDataFrame(rows, "dataset string, source long, target long, probability double, distance double")

    def make(source, target):
        out = df
        for figures, end in ((source, "source"), (target, "target")):
            out = out if figures is None else out.join(figures, ["dataset", end], "left")
        return out

    return df, Pairs(make)


@pytest.mark.parametrize("end", ["source", "target"])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_best_of_pairs_equal_best_of_a_table(spark, end, k):
    from cladeframe.operators import graph as G

    df, pairs = edges_of(spark)
    assert sorted(G.best_by(pairs, end, k=k).collect()) == sorted(G.best_by(df, end, k=k).select(*df.columns).collect())


def test_figures_do_not_shuffle_the_pairs(spark):
    """No window over all pairs, and no exchange after the join that makes them."""
    from cladeframe.operators import track as K
    from cladeframe.sources import adapters as A

    n = A.nodes(spark, "/root/testdata/sf0.001")
    out = K.mutual_bonus(A.scored_pairs(n), "probability").select("source", "target", "bonus_logit")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.index("ShuffledHashJoin") < plan.index("Exchange")
    df, pairs = edges_of(spark)
    for f in (lambda e: K.mutual_bonus(e, "probability").select("source", "target", "bonus_logit"), lambda e: K.candidates(e, 0.8, 0.2, 3, 1.5)):
        assert sorted(f(pairs).collect()) == sorted(f(df).collect())


def test_components_and_clusters_send_nothing_through_the_driver(spark, tmp_path):
    from cladeframe.operators import ensemble, graph

    spark.range(3000).selectExpr(*AT[:2], "0 t", *AT[3:], "int(id % 3) graph").write.parquet(f"{tmp_path}/points")
    spark.range(2999).selectExpr("'d' dataset", "id source", "id + 1 + id % 7 target").write.parquet(f"{tmp_path}/edges")
    at, edges = spark.read.parquet(f"{tmp_path}/points"), spark.read.parquet(f"{tmp_path}/edges")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    graph.components(at, edges).write.mode("overwrite").format("noop").save()
    ensemble.cluster(at).write.mode("overwrite").format("noop").save()
    runs = store.executionsList()
    ids = [runs.apply(i).executionId() for i in range(before, runs.size())]
    names = [nodes.apply(i).name() for nodes in (store.planGraph(i).allNodes() for i in ids) for i in range(nodes.size())]
    assert "ShuffledHashJoin" in " ".join(names) and "BroadcastExchange" not in names
