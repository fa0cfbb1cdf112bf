"""The tracker as a stream (SS1 to SS4, SS7): state per source, the same kernel as the batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.config import Tracking
from quillon.operators.tracking import OUTPUT, Tracker, as_frame, history_rows, run_frames


def tracked_stream(stream: DataFrame, fps: float = 10.0, source: str = "source_id", c: Tracking = Tracking(), idle: int | None = None) -> DataFrame:
    """As `tracked`, for a stream of detections; rows of kind `track` are the histories so far, the latest hold.

    A micro-batch holds whole frames. Frames at or before the last one seen are not
    tracked: they come out as rows of kind `late`, and the state stays. With
    ``idle`` (milliseconds) a source that has been silent for so long is forgotten.
    """
    kind = stream.schema[source].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker = Tracker.load(state.get[0]) if state.exists else Tracker(fps, c)
        pdf = pd.concat(list(batches), ignore_index=True)
        old = pdf["frame_index"] <= tracker.frame
        rows = [{"kind": "late", "frame_index": int(f), "det_index": int(d)} for f, d in zip(pdf["frame_index"][old], pdf["det_index"][old])]
        rows += run_frames(tracker, pdf[~old]) + history_rows(tracker)
        state.update((tracker.save(),))
        if idle:
            state.setTimeoutDuration(idle)
        yield as_frame(rows, {source: key[0]})

    slim = stream.select(source, "frame_index", "det_index", "class_id", "conf", "x1", "y1", "x2", "y2")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return slim.groupBy(source).applyInPandasWithState(run, f"{source} {kind}, {OUTPUT}", "tracker binary", "append", timeout)
