"""Linking points as frames arrive.

An extension for Structured Streaming: points come with an event time and a
frame number; a frame is linked to the one before it once both are complete,
that is when the watermark has passed them.  State by dataset: the points of
the last open frames only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cladeframe.operators.track import _near, link_pairs

OUTPUT = "dataset string, source bigint, target bigint, distance double, kind string"
STATE = "t array<int>, node_id array<bigint>, z array<double>, y array<double>, x array<double>"


def link_frames(rows: list[tuple], gate: float, division_radius: float, max_daughters: int, until: int) -> tuple[list[tuple], list[tuple]]:
    """(links between complete neighbouring frames, rows still needed) of rows (t, node_id, z, y, x)."""
    frames: dict[int, list] = {}
    for r in sorted(set(rows)):
        frames.setdefault(r[0], []).append(r)
    out = []
    for t in sorted(frames):
        if t + 1 in frames and t + 1 < until:
            a, b = frames[t], frames[t + 1]
            p, q = np.array([r[2:] for r in a]), np.array([r[2:] for r in b])
            near = [(a[i][1], b[j][1], d) for i, j, d in _near(p, q, max(gate, division_radius))]
            out += link_pairs(near, gate, division_radius, max_daughters, None)
    return out, [r for t, rs in frames.items() if t >= until - 1 for r in rs]


def link_stream(points: DataFrame, time: str = "ts", delay: str = "10 seconds", gate: float = 15.0, division_radius: float = 20.0, max_daughters: int = 2) -> DataFrame:
    """Links of a stream of (dataset, node_id, t, z, y, x, time).

    A frame counts as complete when a later frame has arrived in an earlier
    batch or the dataset's state times out behind the watermark.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = list(zip(*state.get)) if state.exists else []
        rows = [(int(t), int(i), float(z), float(y), float(x)) for t, i, z, y, x in rows]
        for pdf in batches:
            rows += [(int(t), int(i), float(z), float(y), float(x)) for t, i, z, y, x in zip(pdf.t, pdf.node_id, pdf.z, pdf.y, pdf.x)]
        if state.hasTimedOut:
            until = max((r[0] for r in rows), default=0) + 1
        else:
            until = max((r[0] for r in rows), default=0)
        links, kept = link_frames(rows, gate, division_radius, max_daughters, until)
        if state.hasTimedOut:
            state.remove()
        else:
            state.update(tuple(list(c) for c in zip(*kept)) if kept else ([], [], [], [], []))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 1_000_000)
        if links:
            yield pd.DataFrame([(key[0], *x) for x in links], columns=["dataset", "source", "target", "distance", "kind"])

    marked = points.withWatermark(time, delay)
    return marked.groupBy("dataset").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def frame_counts(points: DataFrame, time: str = "ts", delay: str = "10 seconds", window: str = "1 minute") -> DataFrame:
    """Points by dataset and window of event time, late ones dropped behind the watermark."""
    return points.withWatermark(time, delay).groupBy("dataset", F.window(time, window)).agg(F.count(F.lit(1)).alias("n")).select("dataset", "window.start", "window.end", "n")
