"""Rounds of figures by end over candidate pairs, and where a join puts an end's pairs."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cladeframe.functions import scalar as X
from cladeframe.operators import pairs as P
from cladeframe.plans import catalog
from cladeframe.sources import adapters as A

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, rounds", [("prj17_blend_adaptive", 2), ("prj17_blend_consensus", 2), ("prj16_bidirectional_logits", 4)])
def test_pairs_are_made_once_for_figures_that_can_go_together(spark, monkeypatch, name, rounds):
    made = []
    monkeypatch.setattr(P, "stored", lambda df, n: made.append(n) or df)
    catalog.queries()[name](spark, SMALL)
    assert made.count("figures") == rounds


def test_a_source_with_figures_meets_its_targets_in_one_task(spark):
    n = A.nodes(spark, SMALL)
    figures = n.select("dataset", F.col("node_id").alias("source"), (F.col("node_id") * 3).alias("f"))
    plain, known = A.scored_edges(n), A.scored_edges(n, source=figures)
    assert sorted(known.drop("f").collect()) == sorted(plain.collect()) and known.filter("f <> source * 3 OR f IS NULL").isEmpty()
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = known.select("source", F.spark_partition_id().alias("task")).distinct().toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert tasks["task"].nunique() > 1 and tasks["source"].is_unique


def test_the_largest_moved_value_is_known_without_the_rows(spark):
    """Groups of one row, of equal values, with nulls, and with values that are not finite."""
    inf, nan = float("inf"), float("nan")
    groups = [[1.0, 2.0, 4.5], [3.0], [2.0, 2.0], [None, 1.0, 0.1], [None], [inf, 1.0], [-inf, 1.0], [-inf, inf, 0.0], [nan, 1.0], [-inf], [1e200, -1e200, 3.0], [0.1, 0.2, 0.3, 0.1 + 0.2]]
    df = spark.createDataFrame([(g, i, v, float(i % 2)) for g, vs in enumerate(groups) for i, v in enumerate(vs)], "g int, i int, v double, l double")
    out = X.align(df, "v", "l", ["g"], "out", tops=("top_l", "top_out"))
    w = Window.partitionBy("g")
    wrong = out.withColumns({"a": F.max("out").over(w), "b": F.max("l").over(w)}).filter("NOT (top_out <=> a AND top_l <=> b)")
    assert wrong.collect() == []


@pytest.mark.parametrize("end, k", [("target", 1), ("source", 2)])
def test_only_pairs_that_can_be_best_are_ranked(spark, end, k):
    """Of the pairs of an end no more than the k best and their equals reach the window that ranks them."""
    pairs = A.scored_pairs(A.nodes(spark, SMALL))
    left = P.contenders(pairs, end, [-F.col("probability"), F.col("distance")], k)
    ends = A.scored_edges(A.nodes(spark, SMALL)).groupBy(end).agg(F.count(F.lit(1)).alias("n"))
    most, made = ends.agg(F.sum(F.least("n", F.lit(k))), F.sum("n")).first()
    assert left.count() == most and made > 10 * most


def test_division_geometry_ranks_only_pairs_that_can_be_best(spark, monkeypatch):
    from cladeframe.operators import graph as G

    asked = []
    plain = G.contenders
    monkeypatch.setattr(G, "contenders", lambda pairs, end, values, k: asked.append((type(pairs), end, k)) or plain(pairs, end, values, k))
    catalog.queries()["rk7_division_geometry"](spark, SMALL)
    assert asked == [(P.Pairs, "source", 2)]


def test_hard_negatives_rank_a_short_list(spark):
    """The rows of a window over all pairs; few of the pairs are ranked, and none is shuffled to be told from the true ones."""
    from cladeframe.operators import track as K

    n = A.nodes(spark, SMALL)
    true = A.chain_edges(n)
    columns = ["dataset", "source", "target", "rank"]
    got, want = (K.hard_negatives(e, true, 20.0).select(*columns) for e in (A.scored_pairs(n), A.scored_edges(n)))
    assert sorted(got.collect()) == sorted(want.collect())
    plan = catalog.queries()["rk2_hard_negatives"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "_target_up_to_1" in plan


@pytest.mark.parametrize("end", ["source", "target"])
@pytest.mark.parametrize("k", [1, 3])
def test_short_list_has_the_first_of_every_end(spark, end, k):
    from tests.test_dense import edges_of

    df, pairs = edges_of(spark)
    w = Window.partitionBy(end).orderBy(F.desc("probability"), "distance", "source", "target")
    first = lambda e: sorted(map(tuple, e.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("source", "target", "r").collect()))
    assert first(P.shortlist(pairs, end, [-F.col("probability"), F.col("distance")], k)) == first(df)
