"""Vehicle tracks through frames (SS1 to SS4, JN10, JN18, JN19, MA10, WI6 to WI8, AG17, AG20, SU8).

A source's frames are sequential by nature; sources spread over the cluster. The
same kernel serves batches (`tracked`) and streams (`quillon.streaming.tracks`),
where its state is what `Tracker.save` gives.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import Tracking
from quillon.operators.assign import in_order, match

#: Standard deviations as shares of the box's height, for place and velocity; those of the aspect are fixed.
PLACE, SPEED = 1 / 20, 1 / 160
MOTION = np.eye(8) + np.eye(8, k=4)


def _diagonal(place: float, aspect: float, speed: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Standard deviations of a box's measures, and of their speeds: what grows with the height, and what does not."""
    grows, fixed = [place, place, 0, place], [0, 0, aspect, 0]
    if speed is not None:
        grows, fixed = grows + [speed, speed, 0, speed], fixed + [0, 0, 1e-5, 0]
    return np.array(grows), np.array(fixed)


BORN, MOVED, SEEN = _diagonal(2 * PLACE, 1e-2, 10 * SPEED), _diagonal(PLACE, 1e-2, SPEED), _diagonal(PLACE, 1e-1)


def _noise(height: np.ndarray, deviations: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Diagonal covariances, one a row of ``height``."""
    grows, fixed = deviations
    out = np.zeros((len(height), len(grows), len(grows)))
    at = np.arange(len(grows))
    out[:, at, at] = (np.maximum(1.0, height)[:, None] * grows + fixed) ** 2
    return out


def measured(boxes: np.ndarray) -> np.ndarray:
    """Centre, aspect and height of boxes."""
    size = boxes[:, 2:] - boxes[:, :2]
    if (size <= 0).any():
        raise ValueError("a vehicle's box must have positive area")
    return np.column_stack([(boxes[:, :2] + boxes[:, 2:]) / 2, size[:, 0] / size[:, 1], size[:, 1]])


def boxes_of(mean: np.ndarray) -> np.ndarray:
    half = np.maximum(1.0, np.column_stack([mean[:, 2] * mean[:, 3], mean[:, 3]])) / 2
    return np.hstack([mean[:, :2] - half, mean[:, :2] + half])


def born(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.hstack([z, np.zeros_like(z)]), _noise(z[:, 3], BORN)


def predicted(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mean @ MOTION.T, MOTION @ cov @ MOTION.T + _noise(mean[:, 3], MOVED)


def corrected(mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    innovation = cov[:, :4, :4] + _noise(mean[:, 3], SEEN)
    gain = np.linalg.solve(innovation, cov[:, :4, :]).transpose(0, 2, 1)
    new = cov - gain @ cov[:, :4, :]
    return mean + np.einsum("nij,nj->ni", gain, z - mean[:, :4]), (new + new.transpose(0, 2, 1)) / 2


def iou_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    cut = np.maximum(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0)
    both = cut[..., 0] * cut[..., 1]
    area = [np.prod(np.maximum(x[:, 2:] - x[:, :2], 0), axis=1) for x in (a, b)]
    union = area[0][:, None] + area[1][None] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


class Tracker:
    """Tracks of one source."""

    def __init__(self, fps: float, c: Tracking = Tracking()):
        self.c, self.patience = c, c.lost_frames(fps)
        self.ids = np.zeros(0, int)
        self.mean, self.cov, self.box = np.zeros((0, 8)), np.zeros((0, 8, 8)), np.zeros((0, 4))
        self.cls, self.hits, self.first, self.seen = (np.zeros(0, int) for _ in range(4))
        self.lost = np.zeros(0, bool)
        self.next_id, self.frame = 1, -1
        self.streaks: dict[tuple[int, int], int] = {}
        self.history: dict[int, dict] = {}

    def save(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @classmethod
    def load(cls, state: bytes) -> Tracker:
        out = cls.__new__(cls)
        out.__dict__.update(pickle.loads(state))
        return out

    def costs(self, tracks: np.ndarray, box: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """JN10: overlap and nearness of predicted and seen boxes; pairs that are neither are out."""
        guess = boxes_of(self.mean[tracks])
        overlap = iou_table(guess, box)
        middle = lambda x: (x[:, :2] + x[:, 2:]) / 2
        far = np.linalg.norm(middle(guess)[:, None] - middle(box)[None], axis=2) / np.maximum(1.0, np.linalg.norm(guess[:, 2:] - guess[:, :2], axis=1))[:, None]
        cost = 1 - (0.8 * overlap + 0.2 * np.maximum(0.0, 1 - far)) + self.c.class_penalty * (self.cls[tracks][:, None] != kind[None])
        return np.where((overlap < self.c.min_iou) & (far > self.c.max_centre_distance), np.inf, cost)

    def _keep(self, keep: np.ndarray) -> None:
        for name in ("ids", "mean", "cov", "box", "cls", "hits", "first", "seen", "lost"):
            setattr(self, name, getattr(self, name)[keep])

    def step(self, frame: int, box: np.ndarray, conf: np.ndarray, kind: np.ndarray) -> tuple[list[tuple], list[tuple]]:
        """Visible detections (index, track, age, hits, reidentified), by index, and events (track, event, counted)."""
        if frame <= self.frame:
            raise ValueError("frames must come in rising order")
        self.frame = frame
        c, events, at = self.c, [], {}
        still = self.mean.copy()
        still[self.lost, 7] = 0
        if len(still):
            self.mean, self.cov = predicted(still, self.cov)
        high = np.flatnonzero(conf >= c.high)
        low = np.flatnonzero((conf >= c.low) & (conf < c.high))
        left, free = np.arange(len(self.ids)), np.ones(len(self.ids), bool)
        back: set[int] = set()
        for band, limit in ((high, c.first_limit), (low, c.second_limit)):
            found = match(self.costs(left, box[band], kind[band]), limit) if len(left) and len(band) else []
            if found:
                t, d = left[[r for r, _ in found]], band[[k for _, k in found]]
                self.mean[t], self.cov[t] = corrected(self.mean[t], self.cov[t], measured(box[d].astype(float)))
                for i, j in zip(t.tolist(), d.tolist()):
                    if self.lost[i]:
                        back.add(j)
                        events.append((int(self.ids[i]), "reactivated"))
                    at[j] = int(self.ids[i])
                    if limit == c.second_limit and band is low:
                        events.append((int(self.ids[i]), "second_stage"))
                self.box[t], self.cls[t], self.lost[t], self.seen[t] = box[d], kind[d], False, frame
                self.hits[t] += 1
                free[t] = False
                left = np.flatnonzero(free)
        for i in left.tolist():
            if not self.lost[i]:
                self.lost[i] = True
                events.append((int(self.ids[i]), "lost"))
        gone = left[frame - self.seen[left] > self.patience]
        for i in gone.tolist():
            self._remove(i, "timeout", "removed", events)
        if len(gone):
            self._keep(np.delete(np.arange(len(self.ids)), gone))
        for j in high.tolist():  # JN18: in order, since each new track hides later ones
            if j in at or conf[j] < c.new:
                continue
            taken = box[list(at)].astype(float).reshape(-1, 4)
            if len(taken) and iou_table(box[j : j + 1].astype(float), taken).max() >= c.suppress_iou:
                events.append((None, "suppressed"))
                continue
            self._create(frame, box[j], int(kind[j]), events)
            at[j] = int(self.ids[-1])
        if len(at) > 1:
            for t in self._duplicates(at, events):
                at = {j: k for j, k in at.items() if k != t}
        else:
            self.streaks = {}
        place = {int(t): i for i, t in enumerate(self.ids)}
        for i, t in enumerate(self.ids.tolist()):
            self.history[t] |= {"last_frame": int(self.seen[i]), "hits": int(self.hits[i])}
        out = []
        for j in sorted(at):
            i = place[at[j]]
            out.append((j, at[j], int(frame - self.first[i] + 1), int(self.hits[i]), j in back))
        return out, events

    def _create(self, frame: int, box: np.ndarray, kind: int, events: list) -> None:
        mean, cov = born(measured(box[None].astype(float)))
        new = {"ids": [self.next_id], "mean": mean, "cov": cov, "box": box[None], "cls": [kind], "hits": [1], "first": [frame], "seen": [frame], "lost": [False]}
        for name, value in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), np.asarray(value, getattr(self, name).dtype)]))
        self.history[self.next_id] = {"first_frame": frame, "last_frame": frame, "hits": 1, "removal_reason": None}
        events.append((self.next_id, "created"))
        self.next_id += 1

    def _remove(self, i: int, reason: str, event: str, events: list) -> None:
        t = int(self.ids[i])
        self.history[t] |= {"removal_reason": reason, "last_frame": int(self.seen[i]), "hits": int(self.hits[i])}
        events.append((t, event))

    def _duplicates(self, at: dict[int, int], events: list) -> list[int]:
        """JN19, SS3: of tracks that coincide for long enough, the one with fewer hits goes (the younger of equals). A removed track is compared no more."""
        seen = np.flatnonzero(np.isin(self.ids, list(at.values())))
        table = iou_table(self.box[seen], self.box[seen])
        now, dead = {}, []
        for a in range(len(seen)):
            for b in range(a + 1, len(seen)):
                pair = int(self.ids[seen[a]]), int(self.ids[seen[b]])
                if pair[0] in dead or pair[1] in dead or table[a, b] < self.c.duplicate_iou:
                    continue
                now[pair] = self.streaks.get(pair, 0) + 1
                if now[pair] >= self.c.duplicate_frames:
                    i = min(seen[a], seen[b], key=lambda k: (self.hits[k], -self.ids[k]))
                    self._remove(int(i), "duplicate", "removed_duplicate", events)
                    dead.append(int(self.ids[i]))
        self.streaks = now
        if dead:
            self._keep(~np.isin(self.ids, dead))
        return dead


OUTPUT = "kind string, frame_index int, det_index int, track_id int, event string, age_frames int, hits int, missed_frames int, reidentified boolean, first_frame int, last_frame int, removal_reason string, status string"


def run_frames(tracker: Tracker, pdf: pd.DataFrame) -> list[dict]:
    """Rows of all frames of a source that ``pdf`` has; frames without detections in between are empty ones."""
    rows = []
    if not len(pdf):
        return rows
    frames, index = pdf["frame_index"].to_numpy(int), pdf["det_index"].to_numpy()
    order = np.lexsort((index, frames))
    frames, index = frames[order], index[order]
    box = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)[order]
    conf, kind = pdf["conf"].to_numpy(float)[order], pdf["class_id"].to_numpy(int)[order]
    first = tracker.frame + 1 if tracker.frame >= 0 else int(frames[0])
    cuts = np.searchsorted(frames, np.arange(first, int(frames[-1]) + 2)).tolist()
    for frame, a, b in zip(range(first, int(frames[-1]) + 1), cuts, cuts[1:]):
        visible, events = tracker.step(frame, box[a:b], conf[a:b], kind[a:b])
        for j, t, age, hits, back in visible:
            rows.append({"kind": "observation", "frame_index": frame, "det_index": int(index[a + j]), "track_id": t, "age_frames": age, "hits": hits, "missed_frames": 0, "reidentified": back, "status": "active"})
        rows += [{"kind": "event", "frame_index": frame, "track_id": t, "event": e} for t, e in events]
    return rows


def history_rows(tracker: Tracker) -> list[dict]:
    lost = dict(zip(tracker.ids.tolist(), tracker.lost.tolist()))
    status = lambda t: "removed" if t not in lost else "lost" if lost[t] else "active"
    return [{"kind": "track", "track_id": t, "status": status(t), **h} for t, h in sorted(tracker.history.items())]


@dataclass
class _Source:
    """A source's tracker, as `in_order` runs it."""

    tracker: Tracker

    def frames(self, pdf: pd.DataFrame) -> list[dict]:
        return run_frames(self.tracker, pdf)

    def end(self) -> list[dict]:
        return history_rows(self.tracker)


def as_frame(rows: list[dict], extra: dict) -> pd.DataFrame:
    names = [p.split()[0] for p in OUTPUT.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    for p in OUTPUT.split(", "):
        name, kind = p.split()
        if kind == "int":
            out[name] = out[name].astype("Int32")
        elif kind == "boolean":
            out[name] = out[name].astype("boolean")
        else:
            out[name] = out[name].astype(object).where(out[name].notna(), None)
    for i, (k, v) in enumerate(extra.items()):
        out.insert(i, k, v)
    return out


def tracked(df: DataFrame, fps: float = 10.0, source: str = "source_id", c: Tracking = Tracking()) -> DataFrame:
    """SS1 to SS4: rows of kind `observation` (a detection's track), `event` and `track` (its history) for each source.

    Rows have frame_index, det_index, class_id, conf and x1..y2. Frames without
    rows between a source's first and last count as frames without detections.
    """
    kind = df.schema[source].dataType.simpleString()
    slim = df.select(source, "frame_index", "det_index", "class_id", "conf", "x1", "y1", "x2", "y2")
    return in_order(slim, source, "frame_index", "det_index", lambda: _Source(Tracker(fps, c)), f"{source} {kind}, {OUTPUT}")


def observations(rows: DataFrame, source: str = "source_id") -> DataFrame:
    return rows.filter("kind = 'observation'").select(source, "frame_index", "det_index", "track_id", "age_frames", "hits", "reidentified")


def histories(rows: DataFrame, source: str = "source_id") -> DataFrame:
    """SS2, SU8: per track its frames, hits, status and why it was removed."""
    return rows.filter("kind = 'track'").select(source, "track_id", "first_frame", "last_frame", "hits", "status", "removal_reason")


def surviving(tracks: DataFrame) -> DataFrame:
    """FI13: without duplicates; tracks that timed out stay."""
    return tracks.filter(~F.col("removal_reason").eqNullSafe("duplicate"))


def counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AG20: events counted by name."""
    n = lambda e: F.count_if(F.col("event").isin(*e))
    return rows.filter("kind = 'event'").groupBy(*keys).agg(
        n(["created"]).alias("tracks_created"),
        n(["reactivated"]).alias("tracks_reactivated"),
        n(["lost"]).alias("tracks_lost"),
        n(["removed", "removed_duplicate"]).alias("tracks_removed"),
        n(["second_stage"]).alias("second_stage_matches"),
        n(["removed_duplicate"]).alias("duplicate_tracks_removed"),
        n(["suppressed"]).alias("duplicate_detections_suppressed"),
    )


def class_vote(df: DataFrame, keys: list[str], name: str = "class_name") -> DataFrame:
    """AG17: the most frequent class, of equals the first by name, and all counts sorted by name."""
    per = df.groupBy(*keys, name).agg(F.count("*").alias("n"))
    counts = F.array_sort(F.collect_list(F.struct(F.col(name).alias("class"), F.col("n").alias("n"))))
    return per.groupBy(*keys).agg(F.min_by(name, F.struct(-F.col("n"), F.col(name))).alias(name), F.map_from_entries(counts).alias("class_counts"))


def seen_spans(df: DataFrame, keys: list[str]) -> DataFrame:
    """WI7: first and last frame, hits, age."""
    return df.groupBy(*keys).agg(F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count("*").alias("hits"), (F.max("frame_index") - F.min("frame_index") + 1).alias("age_frames"))


def missed(df: DataFrame, keys: list[str]) -> DataFrame:
    """WI8: frames since the row before, less one."""
    w = Window.partitionBy(*keys).orderBy("frame_index")
    return df.withColumn("missed_frames", F.col("frame_index") - F.lag("frame_index").over(w) - 1)


def streaks(df: DataFrame, keys: list[str]) -> DataFrame:
    """WI6: how many frames in a row, up to this one, each key has been seen."""
    w = Window.partitionBy(*keys).orderBy("frame_index")
    island = df.withColumn("_island", F.col("frame_index") - F.row_number().over(w))
    return island.withColumn("streak", F.row_number().over(Window.partitionBy(*keys, "_island").orderBy("frame_index"))).drop("_island")
