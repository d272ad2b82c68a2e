"""Seeking: where to start decoding for a time asked for, from an index of packets by time.

The index of a track is a tree of buckets.  A bucket of level 0 spans 2 ** STEP ticks and lists the times in it, a bucket
of a further level lists the buckets below it that are not empty, with the last packet of each; so a list has at most
2 ** STEP entries whatever the data, however long the track and however wide its gaps.  A request meets one
bucket a level by equality: in its own bucket the last time at or before it counts, further up the last
bucket before its own, and the nearest of what is found is the answer.  Requests are never compared with all
packets of a track, and a track of any size is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import status as S

STEP = 10
#: Levels until one bucket has all of a signed 64-bit time.
LEVELS = 6


def _up(c: Column, level: int) -> Column:
    """The number of a bucket of a level (level -1: the time itself); there is one bucket of the last level."""
    return F.lit(0).cast("bigint") if level == LEVELS - 1 else F.call_function("shiftright", c, F.lit(STEP * (level + 1))) if level >= 0 else c


def time_index(packets: DataFrame, track: list[str], time: str, carried: list[str]) -> DataFrame:
    """(track columns, level, bucket, entries: array of (at, last: struct of time and ``carried``)).

    Of packets of the same time the last by ``carried`` counts; packets without a time are left out.  Each level is a partial aggregate of the one below.
    """
    last = F.struct(F.col(time).cast("bigint").alias("time"), *(F.col(c) for c in carried))
    now = packets.where(F.col(time).isNotNull()).select(*track, F.col(time).cast("bigint").alias("at"), last.alias("last")).groupBy(*track, "at").agg(F.max("last").alias("last"))
    out = None
    for level in range(LEVELS):
        if level:
            now = now.groupBy(*track, _up(F.col("last.time"), level - 1).alias("at")).agg(F.max("last").alias("last"))
        rows = now.groupBy(*track, _up(F.col("last.time"), level).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("at", "last"))).alias("entries"))
        rows = rows.select(*track, F.lit(level).alias("level"), "bucket", "entries")
        out = rows if out is None else out.unionByName(rows)
    return out


def look_back(requests: DataFrame, index: DataFrame, track: list[str], time: str, key: list[str], name: str) -> DataFrame:
    """``key`` and ``name``: the last indexed packet of the request's track at or before ``time``; no row where there is none."""
    at = F.col(time).cast("bigint")
    # in the request's own bucket of level 0 its time counts, further up only what lies before the bucket below
    asked = F.array(*(F.struct(F.lit(k).alias("level"), _up(at, k).alias("bucket"), (_up(at, k - 1) - int(k > 0)).alias("_until")) for k in range(LEVELS)))
    each = requests.where(at.isNotNull()).select(*dict.fromkeys([*key, *track]), F.inline(asked))
    met = each.join(index, [*track, "level", "bucket"])
    before = met.withColumn("_before", F.filter("entries", lambda e: e["at"] <= F.col("_until"))).where(F.size("_before") > 0)
    return before.select(*key, F.element_at("_before", -1)["last"].alias(name)).groupBy(*key).agg(F.max(name).alias(name))


def ticks_at(position_ms: Column, scale: Column) -> Column:
    """A position in ticks, to the nearest one (halves up); null if it is negative or beyond 64 bits."""
    whole = position_ms.cast("decimal(20,0)") * scale.cast("decimal(12,0)") + F.lit(500).cast("decimal(4,0)")
    return F.when((position_ms >= 0) & (scale > 0), F.floor(whole / F.lit(1000).cast("decimal(4,0)")).try_cast("bigint"))


def seek(requests: DataFrame, packets: DataFrame, position_ms: str, scale: str, key: list[str], track: list[str], time: str, ordinal: str, is_key: Column, carried: list[str] | None = None) -> DataFrame:
    """``requests`` (distinct by ``key``) with where decoding starts and what to throw away until the position.

    seek_status: OK, INVALID (a position that is null, negative or too large), UNSUPPORTED (no key packet at or before it; nothing
    is guessed).  start: the last key packet at or before the position (its time, ordinal and the ``carried`` columns).
    discard_packets: whole packets between it and the one that holds the position; discard_ticks: ticks from its start to the
    position.  ``ordinal`` counts the packets of a track.
    """
    own = requests.withColumn("ticks", ticks_at(F.col(position_ms), F.col(scale)))
    starts = look_back(own, time_index(packets.where(is_key), track, time, [ordinal, *(carried or [])]), track, "ticks", key, "start")
    ends = look_back(own, time_index(packets, track, time, [ordinal]), track, "ticks", key, "_end")
    found = own.join(starts, key, "left").join(ends, key, "left")
    status = F.when(F.col("ticks").isNull(), S.INVALID).when(F.col("start").isNull(), S.UNSUPPORTED).otherwise(S.OK)
    return found.withColumns({
        "seek_status": status,
        "discard_packets": (F.col(f"_end.{ordinal}") - F.col(f"start.{ordinal}")).cast("bigint"),
        "discard_ticks": F.col("ticks") - F.col("start.time"),
    }).drop("_end")
