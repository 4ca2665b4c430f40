"""The jobs: registered queries against SQL, growing input, reruns, failures and odd rows."""

import datetime
import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import registered, reply_trees, track_ledger
from tests.oracle import assert_same, connect, rows

SF = "/root/testdata/sf0.001"
ROOT = __file__.rsplit("/tests/", 1)[0]


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_job_equals_sql(spark, name):
    before = dict(spark.conf.getAll) if hasattr(spark.conf, "getAll") else None
    assert_same(registered.queries()[name](spark, SF), connect(SF), registered.oracle_sql()[name])
    after = dict(spark.conf.getAll) if hasattr(spark.conf, "getAll") else None
    assert before is None or {k: v for k, v in after.items() if k != "cladeframe.scratch.dir"} == {k: v for k, v in before.items() if k != "cladeframe.scratch.dir"}


def graph_sql(path):
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    return con


def split_events(spark, tmp_path, parts):
    """Copies of the events in files that arrive one after another, in no order of time."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    odd = spark.createDataFrame([(9_000_001, None, 3, "view", 1.0, None), (9_000_002, datetime.datetime(2024, 1, 3), None, "view", 1.0, None), (9_000_003, datetime.datetime(2024, 1, 4), 77, "view", None, None)], track_ledger.EVENTS)
    whole = events.select(*odd.columns).unionByName(odd)
    for k in range(parts):
        whole.filter(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == k).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    return [next((tmp_path / f"part{k}").glob("*.parquet")) for k in range(parts)]


def test_ledger_takes_only_what_is_new(spark, tmp_path):
    files = split_events(spark, tmp_path, 3)
    spool, out = tmp_path / "spool", str(tmp_path / "out")
    spool.mkdir()
    run = lambda: track_ledger.update(spark, str(spool), out, str(tmp_path / "checkpoint"), track_ledger.DEFAULTS)
    total = 0
    for k, f in enumerate(files):
        (spool / f"{k}.parquet").write_bytes(f.read_bytes())
        counts = run()
        assert counts["batches"] == 1 and counts["events"] > 0
        total += counts["events"]
        assert_same(track_ledger.result(spark, out), graph_sql(spool), registered.JOB1)
    assert total == connect(SF).execute("SELECT count(*) FROM events").fetchall()[0][0] + 1  # two odd rows have no frame
    before = rows(track_ledger.result(spark, out).toPandas())
    assert run() == {"batches": 0, "events": 0, "frames": 0}
    assert rows(track_ledger.result(spark, out).toPandas()) == before


def test_ledger_touches_only_the_frames_of_new_events(spark, tmp_path):
    at = lambda day, user, value: (user, datetime.datetime(2024, 1, 1 + day, 12), user, "view", value, None)
    spool, out = str(tmp_path / "spool"), str(tmp_path / "out")
    run = lambda: track_ledger.update(spark, spool, out, str(tmp_path / "checkpoint"), track_ledger.DEFAULTS)
    spark.createDataFrame([at(d, u, 10.0 * u) for d in range(6) for u in range(4)], track_ledger.EVENTS).coalesce(1).write.parquet(spool)
    assert run() == {"batches": 1, "events": 24, "frames": 6}
    links = lambda: {(r.source_id, r.target_id) for r in track_ledger.result(spark, out).filter("row_type = 'edge' AND t IN (2, 3)").collect()}
    assert len(links()) == 8
    old = {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "graph").rglob("*.parquet")}
    # large values take every user of day 3 out of the gate: its links on both sides go, the partitions stay
    spark.createDataFrame([at(3, u, 1e6) for u in range(4)], track_ledger.EVENTS).coalesce(1).write.mode("append").parquet(spool)
    assert run() == {"batches": 1, "events": 4, "frames": 2} and links() == set()
    kept = {f for f in (tmp_path / "out" / "graph").rglob("*.parquet") if f in old}
    assert {f.parent.name for f in kept} == {"t=0", "t=1", "t=4", "t=5"} and all(f.stat().st_mtime_ns == old[f] for f in kept)
    assert {(r.t, r.n_nodes, r.n_links) for r in track_ledger.result(spark, out).filter("row_type = 'frame'").collect()} == {(0, 4, 4), (1, 4, 4), (2, 4, 0), (3, 4, 0), (4, 4, 4), (5, 4, 0)}


def test_ledger_survives_a_batch_that_fails_half_way(spark, tmp_path, monkeypatch):
    files = split_events(spark, tmp_path, 2)
    spool, out = tmp_path / "spool", str(tmp_path / "out")
    spool.mkdir()
    run = lambda: track_ledger.update(spark, str(spool), out, str(tmp_path / "checkpoint"), track_ledger.DEFAULTS)
    (spool / "0.parquet").write_bytes(files[0].read_bytes())
    run()
    (spool / "1.parquet").write_bytes(files[1].read_bytes())

    def fail(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):
        m.setattr(track_ledger, "frames", fail)  # after the partial sums are written
        run()
    run()
    assert_same(track_ledger.result(spark, out), graph_sql(spool), registered.JOB1)


def test_small_batches_give_the_same_ledger(spark, tmp_path):
    split_events(spark, tmp_path, 4)
    spool = str(tmp_path / "part*")
    out = str(tmp_path / "out")
    counts = track_ledger.update(spark, spool, out, str(tmp_path / "checkpoint"), track_ledger.DEFAULTS | {"files_per_batch": 1})
    assert counts["batches"] == 4
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/part*/*.parquet'")
    assert_same(track_ledger.result(spark, out), con, registered.JOB1)


def test_reply_trees_of_odd_turns(spark, tmp_path):
    said = [
        (1, 0, "user", "the red house by the river"), (1, 1, "assistant", "the red house"), (1, 2, "user", "a red house by the river"), (1, 3, "user", "by the river"),
        (1, 3, "user", "by the river"), (1, 4, None, None), (1, 5, "user", ""), (2, 0, "user", "nothing alike"), (2, 1, "user", "other words"),
        (None, 1, "user", "x"), (3, None, "user", "x"), (3, -1, "user", "x"), (4, 7, "user", "alone"), (-3, 2, "user", "alone"),
    ]
    path = str(tmp_path / "conversations")
    spark.createDataFrame([(*r, "extra") for r in said], "conv_id long, turn long, role string, text string, dataset string").write.parquet(path)
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    for _ in range(2):
        counts = reply_trees.build(spark, path, str(tmp_path / "out"), reply_trees.DEFAULTS)
        assert counts == {"turns": 10, "links": 2, "trees": 8, "no_key": 2, "turn_out_of_range": 1, "repeated_turn": 1}
        assert_same(reply_trees.result(spark, str(tmp_path / "out")), con, registered.JOB2)
    sent = spark.read.option("header", True).csv(str(tmp_path / "out" / "submission"))
    assert sent.groupBy("row_type").count().orderBy("row_type").collect() == [("edge", 2), ("node", 10)]
    # of three replies to one turn two stay
    at = reply_trees.DEFAULTS | {"window": 3, "max_replies": 1}
    assert reply_trees.build(spark, path, str(tmp_path / "one"), at)["links"] == 1
    empty = str(tmp_path / "empty")
    spark.read.parquet(path).limit(0).write.parquet(empty)
    assert reply_trees.build(spark, empty, str(tmp_path / "none"), reply_trees.DEFAULTS) == {"turns": 0, "links": 0, "trees": 0}
    assert reply_trees.result(spark, str(tmp_path / "none")).count() == 0


def test_settings_come_from_the_config_file(spark, tmp_path):
    for job in (track_ledger, reply_trees):
        assert job.settings_of(spark, f"{ROOT}/jobs/{job.__name__.rpartition('.')[2]}.json") == job.DEFAULTS == job.settings_of(spark, None)
    (tmp_path / "bad.json").write_text(json.dumps({"gates": 1}))
    with pytest.raises(ValueError, match="gates"):
        track_ledger.settings_of(spark, str(tmp_path / "bad.json"))


def test_command_line(tmp_path):
    said = subprocess.run(
        [sys.executable, "-m", "jobs.reply_trees", "--config", "jobs/reply_trees.json", "--conversations", f"{SF}/conversations.parquet", "--out", str(tmp_path / "out")],
        cwd=ROOT, capture_output=True, text=True, timeout=300, check=True,
    )
    assert "wrote" in said.stderr and (tmp_path / "out" / "threads").is_dir()
