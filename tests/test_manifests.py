"""Manifests as tables, digests of files and folders, sweeps and temperatures in few aggregations."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from cladeframe.operators import evaluation as E
from cladeframe.sources import manifests as X
from cladeframe.sources import submission as U

RUNS = "candidate string, config_path string, split_path string, fold string, seed long, max_hours double, commit string, created_at string"


def test_manifest_rows_and_their_changes(spark):
    digests = spark.createDataFrame([("c.yaml", "aa"), ("s.csv", "bb"), ("t.csv", "cc")], "path string, sha256 string")
    good = [("r1", "c.yaml", "s.csv", "A", 0, 9.0, "x", "2026-01-01T00:00:00+00:00"), ("r2", "c.yaml", "t.csv", "B", 3, 1.5, "x", "")]
    known = X.manifests(spark.createDataFrame(good, RUNS), digests)
    rows = {r.candidate: r for r in known.collect()}
    assert (rows["r1"].config_sha256, rows["r2"].split_sha256, rows["r1"].created_at) == ("aa", "cc", "2026-01-01T00:00:00+00:00") and rows["r2"].created_at.endswith("+00:00")
    assert X.manifest_changes(known, digests).count() == 0
    later = spark.createDataFrame([("c.yaml", "zz"), ("s.csv", "bb")], "path string, sha256 string")
    assert {tuple(r) for r in X.manifest_changes(known, later).collect()} == {("r1", "config hash"), ("r2", "config hash"), ("r2", "split missing")}
    for change, rule in (({0: "a/b"}, "candidate"), ({0: ".."}, "candidate"), ({4: -1}, "seed"), ({5: 0.0}, "max_hours"), ({7: "now"}, "created_at"), ({1: "no"}, "config_path"), ({2: "no"}, "split_path")):
        with pytest.raises(ValueError, match=rule):
            X.manifests(spark.createDataFrame([tuple(change.get(i, v) for i, v in enumerate(good[0]))], RUNS), digests)


def test_digest_of_a_file_and_faults(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(U, "PIECE", 7)
    (tmp_path / "one").write_bytes(b"0123456789" * 5)
    assert U.directory_digest(spark, f"file://{tmp_path}/one") == hashlib.sha256(b"0123456789" * 5).hexdigest()
    (tmp_path / "d").mkdir()
    with pytest.raises(ValueError):
        U.directory_digest(spark, str(tmp_path / "d"))
    (tmp_path / "d" / "b").write_bytes(b"")
    (tmp_path / "d" / "link").symlink_to(tmp_path / "one")
    with pytest.raises(ValueError, match="link"):
        U.directory_digest(spark, str(tmp_path / "d"))
    with pytest.raises(FileNotFoundError):
        U.directory_digest(spark, str(tmp_path / "none"))


def test_temperature_is_the_least_of_a_fine_grid(spark):
    rows = [(0.05 + 0.09 * (i % 10), int((i * 37 % 100) / 100 < 0.3 + 0.04 * (i % 10))) for i in range(500)]
    found = E.fit_temperature(spark.createDataFrame(rows, "p double, y int"), "p", "y")

    def loss(log_t):
        q = [1 / (1 + math.exp(-math.log(p / (1 - p)) / math.exp(log_t))) for p, _ in rows]
        return -sum(math.log(a) if y else math.log(1 - a) for a, (_, y) in zip(q, rows))

    best = min((k / 1000 for k in range(-1500, 1501)), key=loss)
    assert abs(math.log(found) - best) < 1.1e-3
    with pytest.raises(ValueError):
        E.fit_temperature(spark.createDataFrame([], "p double, y int"), "p", "y")


def test_sweep_takes_the_default_within_the_margin(spark):
    pick = lambda *rows: E.sweep_best(spark.createDataFrame(rows, "setting string, score double"), F.min("setting")).collect()
    assert pick(("a", 0.5), ("b", 0.5003)) == [("a",)] and pick(("a", 0.5), ("c", 0.6), ("b", 0.6)) == [("b",)]
