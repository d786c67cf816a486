"""Scene chunks of videos whose frames arrive as a stream.

A keyed state holds the last frame of each video and where its open chunk began.
A chunk is given out when the cut after it comes, or with the last frame of its
video; so that a stream gives the chunks of ``scene_chunks`` however it is split
into batches, also after a restart.

Rows are frames (video_id, si, a, d, color, last): hashes of the whole frame, its
color grid or null, and whether it is the last of its video.  Within a batch they
may come in any order; a frame that comes after a later one was taken is given
out as late and otherwise left out.  A video has color motion until a frame
without a full grid comes; a table looks at all frames first.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.frames import CUT_AHASH, CUT_DHASH, CUT_MOTION

OUT = "video_id string, chunk_id long, start long, end long, frames long, late boolean"


def _far(one: list[int] | None, two: list[int] | None, least: float) -> bool:
    """Whether two hashes of the same length agree in less than ``least`` %."""
    if one is None or two is None or len(one) != len(two) or not len(one):
        return False
    differ = sum((int(x) ^ int(y)).bit_count() for x, y in zip(one, two, strict=True))
    return (1 - differ / (32 * len(one))) * 100 < least


class Scenes(StatefulProcessor):
    """Cuts and chunks of one video after the other frame."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("scene", "value binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else None
        out = []
        frames = pd.concat(list(rows)).sort_values("si", kind="stable")  # of one video and batch
        for si, a, d, color, last in frames[["si", "a", "d", "color", "last"]].itertuples(index=False):
            si, color = int(si), None if color is None or len(color) != 48 else np.asarray(color, float)
            if at is not None and si <= at["si"]:
                out.append((key[0], None, si, si, 1, True))
                continue
            a, d = (None if x is None else [int(w) for w in x] for x in (a, d))
            if at is None:
                at = {"chunk": 0, "start": si, "frames": 0, "moves": color is not None}
            else:
                at["moves"] &= color is not None
                jump = at["moves"] and float(np.sqrt(((color - at["color"]) ** 2).sum())) > CUT_MOTION
                if jump or _far(at["a"], a, CUT_AHASH) or _far(at["d"], d, CUT_DHASH):
                    out.append((key[0], at["chunk"], at["start"], at["si"], at["frames"], False))
                    at |= {"chunk": at["chunk"] + 1, "start": si, "frames": 0}
            at |= {"si": si, "a": a, "d": d, "color": color, "frames": at["frames"] + 1}
            if last:
                out.append((key[0], at["chunk"], at["start"], si, at["frames"], False))
                at |= {"chunk": at["chunk"] + 1, "start": si + 1, "frames": 0}
        if at is not None:
            self.state.update((pickle.dumps(at),))
        yield pd.DataFrame(out, columns=["video_id", "chunk_id", "start", "end", "frames", "late"]).astype({"chunk_id": "Int64"})

    def close(self) -> None:
        pass


def chunk_stream(frames: DataFrame) -> DataFrame:
    """(video_id, chunk_id, start, end, frames, late) of a stream of frames."""
    # The process that starts a stream's state does not see files that were sent
    # to executors: the processor travels with its code.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    slim = frames.selectExpr("CAST(video_id AS STRING) AS video_id", "CAST(si AS BIGINT) AS si", "a", "d", "color", "coalesce(last, false) AS last")
    return slim.groupBy("video_id").transformWithStateInPandas(Scenes(), OUT, "Append", "None")
