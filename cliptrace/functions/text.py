"""Scalar rules over scores, times and model answers."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Confidence from which a verdict of "same" is accepted.
ACCEPT_CONFIDENCE = 80.0
#: Longest piece of a segment that is sent for verification, in seconds.
LONGEST_CUT, SHORTEST_CUT = 60.0, 0.04
# Waits before tries after failures of infrastructure, in ms.
BACKOFF_MS = [2000, 8000, 30000]


def match_likelihood(same: Column, confidence: Column) -> Column:
    """Confidence that two clips match, whichever way the verdict went."""
    return F.when(same, confidence).otherwise(100 - confidence)


def fallback_score(likelihood: Column, verdict: Column, confidence: Column) -> Column:
    """The stored likelihood, else one from verdict and confidence; null for a
    candidate that has no verdict."""
    return F.coalesce(likelihood, F.when(verdict == "accepted", confidence).when(verdict.isNotNull(), 100 - confidence))


def sample_fps(seconds: Column) -> Column:
    """Frames a second at which a clip of this length is sampled."""
    return F.when(seconds < 0.5, 7).when(seconds <= 2, 3).otherwise(1)


def retry_params(attempt: Column) -> dict[str, Column]:
    """Wider search limits for the r-th retry."""
    return {
        "min_similarity": F.greatest(F.lit(20), 40 - 5 * attempt),
        "min_frames": F.greatest(F.lit(2), F.when(attempt > 0, 2).otherwise(3)),
        "frame_drift": F.least(F.lit(24), 8 + 4 * attempt),
        "pad_seconds": F.least(F.lit(6.0), F.lit(1.5) + F.lit(0.75) * attempt),
    }


def cut_window(start: Column, end: Column) -> tuple[Column, Column]:
    """Start and duration of the piece that is cut out: the middle minute of
    what is longer."""
    first = F.greatest(start, F.lit(0.0))
    long = F.greatest(end - first, F.lit(SHORTEST_CUT))
    return F.when(long > LONGEST_CUT, first + (long - LONGEST_CUT) / 2).otherwise(first), F.least(long, F.lit(LONGEST_CUT))


def backoff_ms(attempt: Column) -> Column:
    """Wait before the r-th try, from 0."""
    return F.element_at(F.array(*map(F.lit, BACKOFF_MS)), F.least(attempt, F.lit(len(BACKOFF_MS) - 1)).cast("int") + 1)


def is_daily_limit(message: Column) -> Column:
    """Whether a "too many requests" answer means the day's quota."""
    return F.coalesce(message.rlike(r"(?i)perday|per day|daily"), F.lit(False))


def clock(seconds: Column) -> Column:
    """mm:ss.ff, cut off, not rounded."""
    hundredths = F.floor((seconds - F.floor(seconds)) * 100).cast("int")
    whole = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d.%02d", F.floor(whole / 60).cast("int"), whole % 60, hundredths)


def confidence_tier(confidence: Column) -> Column:
    """Badge of a confidence."""
    return F.when(confidence >= 80, "high").when(confidence >= 60, "medium").otherwise("low")


VERDICT = T.StructType([
    T.StructField("same", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("evidence", T.ArrayType(T.StringType())),
])


def _objects(text: str) -> Iterator[str]:
    """Balanced top-level {...} pieces, with braces in strings left alone."""
    depth, start, quoted, skip = 0, 0, False, False
    for i, ch in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip = ch == "\\"
            quoted = ch != '"'
        elif ch == '"' and depth:
            quoted = True
        elif ch == "{":
            if not depth:
                start = i
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if not depth:
                yield text[start : i + 1]


def _verdict(text: str | None) -> tuple[bool | None, float | None, list[str] | None]:
    best = (None, None, None)
    for piece in _objects((text or "").replace("```json", "").replace("```", "")):
        try:
            x = json.loads(piece)
        except ValueError:
            continue
        number = x.get("confidence")
        if isinstance(x.get("same"), bool) and isinstance(number, int | float) and not isinstance(number, bool) and math.isfinite(number):
            said = x.get("evidence")
            lines = [e.strip() for e in said if isinstance(e, str) and e.strip()][:8] if isinstance(said, list) else []
            best = (x["same"], min(100.0, max(0.0, float(number))), lines)
    return best


@F.pandas_udf(VERDICT)
def parse_verdict(answer: pd.Series) -> pd.DataFrame:
    """The last object of an answer with a boolean ``same`` and a numeric
    ``confidence``, clamped to 0..100, with up to 8 lines of evidence; nulls
    where there is none."""
    return pd.DataFrame([_verdict(a) for a in answer], columns=["same", "confidence", "evidence"])
