"""Resampling by a polyphase windowed sinc, over spans of samples that exchange their borders.

An output frame j lies at j * rate / wanted input frames.  It is the sum of the input frames nearer than ``reach`` to it, weighted by
cutoff * sinc(cutoff * u) * (1 + cos(pi * u / reach)) / 2 for a distance u, with cutoff = min(1, wanted / rate) and reach =
TAPS / cutoff; the weights of an output frame are divided by the sum they have over all places, inside the source or
not, so a constant stays what it is away from the ends.  Before and behind a source there is silence.  Sums are
rounded to the nearest integer, halves to even, and clipped to 16 bits.

The filter has no delay in time: output frame j is input time j * rate / wanted.  Seen as a stream, it comes out once ``delay``
further input frames are there; the frames that the end of the source alone brings out have ``flush`` set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Zero crossings of the sinc on each side.
TAPS = 16
#: Input frames of a span, of which a task holds one with its borders at a time.
SPAN = 16_384
OUT = "source_id string, frame bigint, channel int, value int, flush boolean"


def reach(rate: int, wanted: int) -> float:
    return TAPS * max(1.0, rate / wanted)


def delay(rate: int, wanted: int) -> int:
    """Input frames beyond its own time that an output frame needs at most."""
    return math.ceil(reach(rate, wanted))


def weights(rate: int, wanted: int) -> np.ndarray:
    """(phases, taps): phase p is that of output frames whose time is p / phases beyond an input frame; taps from -delay to delay."""
    g = math.gcd(rate, wanted)
    phases, far, cutoff = wanted // g, delay(rate, wanted), min(1.0, wanted / rate)
    u = np.arange(phases)[:, None] / phases - np.arange(-far, far + 1)[None, :]
    h = np.where(np.abs(u) < reach(rate, wanted), cutoff * np.sinc(cutoff * u) * (1 + np.cos(np.pi * u / reach(rate, wanted))) / 2, 0.0)
    return h / h.sum(axis=1, keepdims=True)


def resampled(samples: DataFrame, rate: int, wanted: int, span: int = SPAN) -> DataFrame:
    """OUT: (source_id, frame, channel, value) at another rate; frames of a source count from 0 without a gap.

    Spans are arrays of at most ``span`` values.  Each sends its first and last ``delay`` values to its neighbours, all that
    meet in one more exchange are the three parts of a span; the filter runs over a span at a time.
    """
    far = delay(rate, wanted)
    if span < far:
        raise ValueError(f"a span must have {far} frames at least")
    h, g = weights(rate, wanted), math.gcd(rate, wanted)
    up, down = wanted // g, rate // g  # output frame j is at j * down / up
    at = F.call_function("div", F.col("frame"), F.lit(span))
    grouped = samples.groupBy("source_id", "channel", at.alias("span")).agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("rows"))
    spans = grouped.select("source_id", "channel", "span", F.col("rows.value").alias("values"))
    whole, head, tail = F.lit(1), F.slice("values", F.lit(1), F.lit(far)), F.slice("values", F.greatest(F.size("values") - far + 1, F.lit(1)), F.lit(far))
    part = lambda to, kind, v: F.struct(to.alias("to"), kind.alias("kind"), v.alias("values"))
    sent = F.array(part(F.col("span"), whole, F.col("values")), part(F.col("span") - 1, F.lit(2), head), part(F.col("span") + 1, F.lit(0), tail))
    parts = spans.select("source_id", "channel", F.inline(sent))
    met = parts.groupBy("source_id", "channel", "to").agg(*(F.max(F.when(F.col("kind") == k, F.col("values"))).alias(n) for k, n in ((0, "before"), (1, "own"), (2, "after"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, channel, k, before, own, after in zip(*(b.column(c).to_pylist() for c in ("source_id", "channel", "to", "before", "own", "after")), strict=True):
                n, low = len(own), k * span
                x = np.concatenate([np.zeros(far - len(before or [])), before or [], own, after or [], np.zeros(far - len(after or []))])
                # output frames whose time lies in the span's frames, each the responsibility of the frame before it
                j = np.arange(-(-low * up // down), -(-(low + n) * up // down))
                first, phase = j * down // up, j * down % up
                windows = np.lib.stride_tricks.sliding_window_view(x, 2 * far + 1)[first - low]
                value = np.clip(np.rint((windows * h[phase]).sum(axis=1)), -32768, 32767).astype(np.int32)
                flush = np.zeros(len(j), bool) if after and len(after) >= far else first + far >= low + n + len(after or [])
                many = pa.array(np.zeros(len(j), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([source], pa.string()).take(many), pa.array(j), pa.array(np.full(len(j), channel, np.int32)), pa.array(value), pa.array(flush)], names=["source_id", "frame", "channel", "value", "flush"]
                )

    return met.where("own is not null").mapInArrow(run, OUT)
