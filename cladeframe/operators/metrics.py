"""Scores of a predicted graph against a sparse true one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.scalar import adjusted, jaccard



def match_by_radius(pred: DataFrame, true: DataFrame, gate: float) -> DataFrame:
    """dataset, pred_id, gt_id: all pairs within the gate; a one-to-one choice among them is ``assign.match_nodes``."""
    from cladeframe.operators.spatial import radius_join

    return radius_join(pred, true, gate).select("dataset", F.col("left_id").alias("pred_id"), F.col("right_id").alias("gt_id"))


def matched_edges(edges: DataFrame, match: DataFrame) -> DataFrame:
    """Predicted edges with the true ids of their ends (null where unmatched)."""
    s = match.select("dataset", F.col("pred_id").alias("source"), F.col("gt_id").alias("gs"))
    t = match.select("dataset", F.col("pred_id").alias("target"), F.col("gt_id").alias("gt"))
    return edges.select("dataset", "source", "target").join(s, ["dataset", "source"], "left").join(t, ["dataset", "target"], "left")


def edge_outcomes(edges: DataFrame, truth: DataFrame, match: DataFrame) -> DataFrame:
    """dataset, source, target, outcome: tp, fp or ignored.

    A wrong edge counts as fp when its target's true node has any parent or its
    source's true node any child.
    """
    known = truth.select("dataset", F.col("source").alias("gs"), F.col("target").alias("gt"), F.lit(True).alias("_hit")).distinct()
    has_in = truth.select("dataset", F.col("target").alias("gt"), F.lit(True).alias("_in")).distinct()
    has_out = truth.select("dataset", F.col("source").alias("gs"), F.lit(True).alias("_out")).distinct()
    df = matched_edges(edges, match).join(known, ["dataset", "gs", "gt"], "left").join(has_in, ["dataset", "gt"], "left").join(has_out, ["dataset", "gs"], "left")
    kind = F.when(F.col("_hit"), "tp").when(F.col("_in") | F.col("_out"), "fp").otherwise("ignored")
    return df.select("dataset", "source", "target", "gs", "gt", kind.alias("outcome"))


def edge_confusion(edges: DataFrame, truth: DataFrame, match: DataFrame) -> DataFrame:
    """dataset, edge_tp, edge_fp, edge_fn."""
    out = edge_outcomes(edges, truth, match)
    found = out.filter("outcome = 'tp'").groupBy("dataset").agg(F.countDistinct("gs", "gt").alias("_found"))
    counts = out.groupBy("dataset").agg(
        F.sum((F.col("outcome") == "tp").cast("bigint")).alias("edge_tp"), F.sum((F.col("outcome") == "fp").cast("bigint")).alias("edge_fp")
    )
    total = truth.groupBy("dataset").agg(F.countDistinct("source", "target").alias("_all"))
    zero = F.lit(0).cast("bigint")
    return total.join(counts, "dataset", "full").join(found, "dataset", "left").select(
        "dataset", F.coalesce("edge_tp", zero).alias("edge_tp"), F.coalesce("edge_fp", zero).alias("edge_fp"),
        (F.coalesce("_all", zero) - F.coalesce("_found", zero)).alias("edge_fn"),
    )


def division_confusion(nodes: DataFrame, edges: DataFrame, true_nodes: DataFrame, truth: DataFrame, match: DataFrame) -> DataFrame:
    """dataset, division_tp, division_fp, division_fn in the local window around every true division.

    A branch of a predicted fork shows the component of its matched child, or
    of its matched grandchildren if these agree.  A fork recovers a division
    when it is near (at the parent, the parent's predecessors, or one step
    after) and its branches can be matched to all daughters.  Divisions and
    forks are then matched with the largest number of pairs.
    """
    from cladeframe.operators.assign import matching_size, pair_up
    from cladeframe.operators.graph import components, forks

    comp = components(true_nodes, truth).select("dataset", F.col("node_id").alias("gt_id"), "component")
    known = match.join(comp, ["dataset", "gt_id"])
    fork = forks(edges).select("dataset", F.col("node_id").alias("fork"))
    parents = edges.groupBy("dataset", "target").agg(F.count(F.lit(1)).alias("_p"))
    branch = fork.join(edges.withColumnRenamed("source", "fork"), ["dataset", "fork"]).select("dataset", "fork", F.col("target").alias("branch"))
    branch = branch.join(parents.select("dataset", F.col("target").alias("branch"), F.col("_p")), ["dataset", "branch"])
    direct = known.select("dataset", F.col("pred_id").alias("branch"), F.col("gt_id").alias("d_id"), F.col("component").alias("d_comp"))
    grand = edges.select("dataset", F.col("source").alias("branch"), F.col("target").alias("pred_id")).join(known, ["dataset", "pred_id"]).join(
        parents.select("dataset", F.col("target").alias("pred_id"), F.col("_p").alias("_gp")), ["dataset", "pred_id"]
    )
    grand = grand.groupBy("dataset", "branch").agg(
        F.countDistinct("component").alias("_k"), F.min(F.struct("gt_id", "component", "_gp")).alias("g")
    ).filter("_k = 1").select("dataset", "branch", F.col("g.gt_id").alias("g_id"), F.col("g.component").alias("g_comp"), F.col("g._gp").alias("_gp"))
    evidence = branch.join(direct, ["dataset", "branch"], "left").join(grand, ["dataset", "branch"], "left").select(
        "dataset", "fork", "branch", F.coalesce("d_id", "g_id").alias("shown"), F.coalesce("d_comp", "g_comp").alias("component"),
        ((F.col("_p") > 1) | (F.col("d_id").isNull() & F.coalesce(F.col("_gp") > 1, F.lit(False)))).alias("merged"),
    )
    divisions = forks(truth).select("dataset", F.col("node_id").alias("division"))
    anchors = divisions.select("dataset", "division", F.col("division").alias("gt_id")).unionByName(
        divisions.join(truth.select("dataset", F.col("target").alias("division"), F.col("source").alias("gt_id")), ["dataset", "division"])
    ).join(match, ["dataset", "gt_id"]).select("dataset", "division", F.col("pred_id").alias("fork"))
    after = anchors.withColumnRenamed("fork", "source").join(edges.select("dataset", "source", "target"), ["dataset", "source"]).select("dataset", "division", F.col("target").alias("fork"))
    near = anchors.unionByName(after).distinct().join(fork, ["dataset", "fork"], "left_semi")
    daughters = divisions.join(truth.withColumnRenamed("source", "division"), ["dataset", "division"]).select("dataset", "division", F.col("target").alias("daughter"))
    windows = daughters.select("dataset", "division", "daughter", F.col("daughter").alias("shown")).unionByName(
        daughters.join(truth.select("dataset", F.col("source").alias("daughter"), F.col("target").alias("shown")), ["dataset", "daughter"]).select("dataset", "division", "daughter", "shown")
    ).distinct()
    home = comp.select("dataset", F.col("gt_id").alias("division"), F.col("component").alias("home"))
    fits = (
        near.join(evidence.filter("NOT merged"), ["dataset", "fork"]).join(windows, ["dataset", "division", "shown"]).join(home, ["dataset", "division"])
        .filter("component = home").select("dataset", "division", "fork", "daughter", "branch")
    )
    sizes = fits.groupBy("dataset", "division", "fork").applyInPandas(matching_size("daughter", "branch", ["dataset", "division", "fork"]), "dataset string, division bigint, fork bigint, size bigint")
    wanted = daughters.groupBy("dataset", "division").agg(F.count(F.lit(1)).alias("n"))
    valid = sizes.join(wanted, ["dataset", "division"]).filter("size = n AND n >= 2").select("dataset", "division", "fork")
    paired = pair_up(valid, "division", "fork")
    child = truth.select("dataset", F.col("source").alias("gt_id")).distinct()
    on_track = match.join(child, ["dataset", "gt_id"], "left_semi").select("dataset", F.col("pred_id").alias("fork"))
    mixed = evidence.groupBy("dataset", "fork").agg(F.countDistinct("component").alias("k"), F.max("merged").alias("m")).filter("k > 1 OR m").select("dataset", "fork")
    wrong = fork.join(paired.select("dataset", "fork"), ["dataset", "fork"], "left_anti").join(
        on_track.unionByName(valid.select("dataset", "fork")).unionByName(mixed).distinct(), ["dataset", "fork"], "left_semi"
    )
    all_sets = nodes.select("dataset").union(true_nodes.select("dataset")).distinct()
    n = lambda df, name: df.groupBy("dataset").agg(F.count(F.lit(1)).alias(name))
    zero = F.lit(0).cast("bigint")
    return (
        all_sets.join(n(paired, "tp"), "dataset", "left").join(n(wrong, "fp"), "dataset", "left").join(n(divisions, "n"), "dataset", "left")
        .select("dataset", F.coalesce("tp", zero).alias("division_tp"), F.coalesce("fp", zero).alias("division_fp"), (F.coalesce("n", zero) - F.coalesce("tp", zero)).alias("division_fn"))
    )


def with_scores(rows: DataFrame, weight: float = 0.1, alpha: float = 0.1, empty: float = 1.0) -> DataFrame:
    """Adds edge_jaccard, adjusted_edge_jaccard, division_jaccard, score to counts by dataset."""
    df = rows.withColumn("edge_jaccard", jaccard(F.col("edge_tp"), F.col("edge_fp"), F.col("edge_fn"), empty))
    df = df.withColumn("adjusted_edge_jaccard", adjusted(F.col("edge_jaccard"), F.col("n_pred"), F.col("n_true"), alpha))
    df = df.withColumn("division_jaccard", jaccard(F.col("division_tp"), F.col("division_fp"), F.col("division_fn"), empty))
    return df.withColumn("score", F.col("adjusted_edge_jaccard") + weight * F.col("division_jaccard"))


def aggregate(rows: DataFrame, weight: float = 0.1) -> DataFrame:
    """One row: adjusted Jaccard weighted by edges, division Jaccard of the summed counts, score."""
    w = F.col("edge_tp") + F.col("edge_fp") + F.col("edge_fn")
    df = rows.agg(
        F.count(F.lit(1)).alias("n_datasets"), F.sum(F.col("adjusted_edge_jaccard") * w).alias("_s"), F.sum(w).alias("_w"),
        *(F.sum(f"division_{x}").alias(f"division_{x}") for x in ("tp", "fp", "fn")),
    )
    edge = F.when(F.col("_w") == 0, 1.0).otherwise(F.col("_s") / F.col("_w"))
    div = jaccard(F.col("division_tp"), F.col("division_fp"), F.col("division_fn"))
    return df.select("n_datasets", edge.alias("adjusted_edge_jaccard"), div.alias("division_jaccard"), (edge + weight * div).alias("score"))


def diagnostics(pred: DataFrame, edges: DataFrame, true: DataFrame, truth: DataFrame, match: DataFrame) -> DataFrame:
    """Missed and spurious nodes; true edges recovered, fragmented or lost to detection; wrong associations; by dataset."""
    key = "dataset"
    hit = match.select(key, F.col("gt_id"), "pred_id")
    ends = truth.join(hit.select(key, F.col("gt_id").alias("source"), F.col("pred_id").alias("ps")), [key, "source"], "left").join(
        hit.select(key, F.col("gt_id").alias("target"), F.col("pred_id").alias("pt")), [key, "target"], "left"
    )
    have = edges.select(key, F.col("source").alias("ps"), F.col("target").alias("pt"), F.lit(True).alias("_e")).distinct()
    ends = ends.join(have, [key, "ps", "pt"], "left")
    both = F.col("ps").isNotNull() & F.col("pt").isNotNull()
    c = lambda cond, name: F.sum(F.coalesce(cond, F.lit(False)).cast("bigint")).alias(name)
    edge_rows = ends.groupBy(key).agg(
        c(F.col("_e"), "edges_recovered"), c(both & F.col("_e").isNull(), "edges_fragmented"), c(~both, "edges_lost_to_detection")
    )
    wrong = edge_outcomes(edges, truth, match).groupBy(key).agg(c(F.col("outcome") == "fp", "wrong_association_edges"))
    n_true = true.groupBy(key).agg(F.count(F.lit(1)).alias("_nt"))
    n_pred = pred.groupBy(key).agg(F.count(F.lit(1)).alias("_np"))
    n_hit = match.groupBy(key).agg(F.countDistinct("gt_id").alias("_h"))
    zero = F.lit(0).cast("bigint")
    h, nt = F.coalesce("_h", zero), F.coalesce("_nt", zero)
    return n_true.join(n_pred, key, "full").join(n_hit, key, "left").join(edge_rows, key, "left").join(wrong, key, "left").select(
        key, (nt - h).alias("missed_nodes"), (F.coalesce("_np", zero) - h).alias("spurious_nodes"),
        F.when(nt == 0, 1.0).otherwise(h / nt).alias("node_recall"),
        *(F.coalesce(x, zero).alias(x) for x in ("edges_recovered", "edges_fragmented", "edges_lost_to_detection", "wrong_association_edges")),
    )


def oracle_edges(truth: DataFrame, match: DataFrame) -> DataFrame:
    """Links that perfect association of the matched nodes would give."""
    s = match.select("dataset", F.col("gt_id").alias("source"), F.col("pred_id").alias("ps"))
    t = match.select("dataset", F.col("gt_id").alias("target"), F.col("pred_id").alias("pt"))
    return truth.join(s, ["dataset", "source"]).join(t, ["dataset", "target"]).select("dataset", F.col("ps").alias("source"), F.col("pt").alias("target")).distinct()


def division_audit(edges: DataFrame, truth: DataFrame, match: DataFrame) -> DataFrame:
    """Every true division: reproduced_ok, recoverable, missing_second_daughter or parent_unmatched."""
    div = truth.groupBy("dataset", "source").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("dataset", F.col("source").alias("division"), "n")
    parent = match.select("dataset", F.col("gt_id").alias("division"), F.col("pred_id").alias("parent"))
    child = truth.select("dataset", F.col("source").alias("division"), F.col("target").alias("gt_id")).join(match, ["dataset", "gt_id"]).select("dataset", "division", F.col("pred_id").alias("child"))
    pairs = div.join(parent, ["dataset", "division"], "left").join(child, ["dataset", "division"], "left").join(
        edges.select("dataset", F.col("source").alias("parent"), F.col("target").alias("child"), F.lit(1).alias("_e")).distinct(), ["dataset", "parent", "child"], "left"
    )
    g = pairs.groupBy("dataset", "division").agg(F.max("parent").alias("parent"), F.count("child").alias("children"), F.sum(F.coalesce("_e", F.lit(0))).alias("linked"))
    status = F.when(F.col("parent").isNull(), "parent_unmatched").when(F.col("children") < 2, "missing_second_daughter").when(F.col("linked") >= 2, "reproduced_ok").otherwise("recoverable")
    return g.select("dataset", "division", status.alias("status"))
