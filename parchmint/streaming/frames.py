"""Frames of scanning sessions: as a stateful stream and, with the same result, over stored frames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parchmint.streaming.automata import Session, Settings, step

FRAME = "session string, t_ms double, quad array<double>, score double, partial boolean, blurry boolean, too_dark boolean, enabled boolean"
DECISION = "session string, t_ms double, quad array<double>, confidence double, stable boolean, stable_for_ms double, motion double, partial boolean, status string, progress double, fire boolean"
_OUT = ["session", "t_ms", "quad", "confidence", "stable", "stable_for_ms", "motion", "partial", "status", "progress", "fire"]
_IN = ["t_ms", "quad", "score", "partial", "blurry", "too_dark", "enabled"]


def _frames(pdf: pd.DataFrame) -> Iterator[dict]:
    for r in pdf[_IN].itertuples(index=False):
        yield dict(zip(_IN, r))


class Capture(StatefulProcessor):
    """State of one session: the two machines' memory as JSON (Infinity included), sorted input per batch."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "json string")

    def handleInputRows(self, key, rows, timerValues):
        s = Session.load(json.loads(self.memory.get()[0])) if self.memory.exists() else Session()
        frames = pd.concat(list(rows)).sort_values("t_ms", kind="stable")
        out = [{"session": key[0], "t_ms": f["t_ms"]} | step(s, self.settings, f) for f in _frames(frames)]
        self.memory.update((json.dumps(s.dump()),))
        yield pd.DataFrame(out, columns=_OUT)

    def close(self) -> None:
        pass


def capture_stream(frames: DataFrame, settings: Settings) -> DataFrame:
    """Decisions of a stream of frames, session by session. Needs the RocksDB state store; frames of a batch are put in order."""
    return frames.groupBy("session").transformWithStateInPandas(statefulProcessor=Capture(settings), outputStructType=DECISION, outputMode="Update", timeMode="None")


def capture_batch(frames: DataFrame, settings: Settings) -> DataFrame:
    """The same over stored frames. Sessions are sorted inside partitions and folded row by row, so none is gathered in memory."""

    def run(batches):
        key, s = None, Session()
        for pdf in batches:
            out = []
            for name, f in zip(pdf["session"], _frames(pdf)):
                if name != key:
                    key, s = name, Session()
                out.append({"session": name, "t_ms": f["t_ms"]} | step(s, settings, f))
            yield pd.DataFrame(out, columns=_OUT)

    return frames.where(F.col("session").isNotNull()).repartition("session").sortWithinPartitions("session", "t_ms").mapInPandas(run, DECISION)


def look_back(events: DataFrame, key: str, at_ms: str, value: str, window_ms: int = 500) -> DataFrame:
    """Number, least and greatest value of each row's last ``window_ms`` (itself included): a sliding window of event time."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(at_ms).rangeBetween(-window_ms, 0)
    return events.select("*", F.count("*").over(w).alias("n_window"), F.min(value).over(w).alias("low"), F.max(value).over(w).alias("high"))
