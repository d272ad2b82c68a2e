"""Relational steps of media processing, as DataFrame operations.

A source (a media file, a playback session) may hold a large share of all rows.  Running sums,
ranks and looks at the row before go through ``running``, and as-of lookups through ``asof``,
which split a large source into pieces of its order, so no task holds it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalars import U32
from ..status import AUDIO
from .validity import command_ok, number_ok

#: Chunk numbers handled by one task of ``asof``.
ASOF_SPAN = 4096
#: Sources of more rows, and of more than one in PIECES of all, are cut into PIECES pieces of their order; the others are a task's work whole.
LARGE, PIECES = 1_000_000, 1024


def exclusive_sum(value: Column, by: list[str], order: list[str]) -> Column:
    """Running sum of what comes before: the timestamp of a packet from the durations before it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def large_sources(rows: DataFrame, source: str, least: int = LARGE) -> Column | None:
    """Whether a row is of a source that has more than ``least`` rows and more than a part in PIECES of all; None if no source has.

    By the second condition fewer than PIECES sources are large, however many rows there are.
    """
    total = rows.count()
    if total <= least:
        return None
    counts = rows.groupBy(source).agg(F.count("*").alias("_n")).where(F.col("_n") > max(least, total // PIECES))
    names = [r[0] for r in counts.select(source).collect()]
    known = F.coalesce(F.col(source).isin([n for n in names if n is not None]), F.lit(False))
    return (known | F.col(source).isNull() if None in names else known) if names else None


def in_pieces(rows: DataFrame, large: Column, order: str, pieces: int = PIECES) -> DataFrame:
    """``rows`` with ``_piece``, 0 for sources that are not large and else growing with ``order``.

    The pieces are cut at quantiles of the large sources' orders, nulls first as in a window's
    order; equal values share a piece, and an order that is not numeric is one piece.
    """
    from pyspark.ml.feature import Bucketizer

    if not isinstance(rows.schema[order].dataType, NumericType):
        return rows.withColumn("_piece", F.lit(0))
    value = F.col(order).cast("double")
    shares = [k / pieces for k in range(1, pieces)]
    found = rows.where(large & ~F.isnan(value)).agg(F.percentile_approx(value, shares, 10 * pieces)).first()[0] if shares else None
    infinite = float("inf")
    splits = [-infinite, *(sorted(set(found or []) - {-infinite, infinite}) or [0.0]), infinite]
    placed = Bucketizer(splits=splits, inputCol="_order", outputCol="_piece", handleInvalid="keep").transform(rows.withColumn("_order", value))
    return placed.withColumn("_piece", F.when(large & F.col("_order").isNotNull(), F.col("_piece").cast("int") + 1).otherwise(0)).drop("_order")


def running(
    rows: DataFrame, source: str, order: list[str], sums: dict[str, Column], before: dict[str, Column] | None = None, least: int = LARGE, pieces: int = PIECES,
    latest: dict[str, Column] | None = None, earlier: dict[str, Column] | None = None, large: Column | str | None = "count",
) -> DataFrame:
    """``rows`` with, by name, sums over all earlier rows of the source (0 at its start) and values of the row before.

    ``latest`` and ``earlier`` are running maxima, with the row itself and without it; nulls do not count.  With the order in front, a
    maximum of structs is the last value that is not null.

    Each piece of a large source gets one more row ahead of its own, which holds the sums and maxima of the
    earlier pieces and the values of their last row; so a window over the piece alone is enough,
    without a join.

    Which sources are large is counted, a job over ``rows`` when the plan is made; ``large`` spares it: a condition
    that holds for their rows, or None if there are none (for rows that are dear to make, and for streams).
    """
    before, latest, earlier = before or {}, latest or {}, earlier or {}
    values = {f"_{name}": value for name, value in (sums | before | latest | earlier).items()}
    valued = rows.withColumns(values)

    def looked(by: list[str], along: list[str], carry: bool = False) -> dict[str, Column]:
        w = Window.partitionBy(*by).orderBy(*along)
        own, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        found = {k: exclusive_sum(F.col(f"_{k}"), by, along) for k in sums} | {k: F.lag(f"_{k}").over(w) for k in before}
        return found | {k: F.max(f"_{k}").over(past if carry else own) for k in latest} | {k: F.max(f"_{k}").over(past) for k in earlier}

    if isinstance(large, str):
        large = large_sources(rows, source, least)
    if large is None:
        return valued.withColumns(looked([source], order)).drop(*values)
    cut = in_pieces(valued, large, order[0], pieces).withColumn("_mark", F.lit(1))
    totals = cut.where(large).groupBy(source, "_piece").agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in sums), *(F.max_by(f"_{k}", F.struct(*order)).alias(f"_{k}") for k in before), *(F.max(f"_{k}").alias(f"_{k}") for k in latest | earlier))
    carried = totals.select(source, "_piece", F.lit(0).alias("_mark"), *(c.alias(f"_{k}") for k, c in looked([source], ["_piece"], True).items()))
    both = cut.unionByName(carried, allowMissingColumns=True)
    return both.withColumns(looked([source, "_piece"], ["_mark", *order])).where("_mark = 1").drop("_piece", "_mark", *values)


def timestamps(packets: DataFrame, source: str, order: str, duration: str) -> DataFrame:
    return running(packets, source, [order], {"timestamp_ticks": F.col(duration)})


def sort_packets(packets: DataFrame, source: str, offset: str, emit_seq: str) -> DataFrame:
    """Stable order by offset: ``emit_seq`` breaks ties as the indexer emitted them."""
    return running(packets, source, [offset, emit_seq], {"seq": F.lit(1)})


def reject_orphans(packets: DataFrame, tracks: DataFrame, source: str, track: str) -> DataFrame:
    """One row a source: status 0 and its packets, or -2 and none if a packet names no track."""
    known = tracks.select(source, track).distinct().withColumn("_known", F.lit(1))
    counts = packets.groupBy(source, track).agg(F.count("*").alias("_n"))
    joined = counts.join(known, [source, track], "left")
    totals = joined.groupBy(source).agg(F.sum("_n").alias("_n"), F.sum(F.when(F.col("_known").isNull(), F.col("_n")).otherwise(0)).alias("_orphans"))
    return totals.select(source, F.when(F.col("_orphans") > 0, -2).otherwise(0).alias("status"), F.when(F.col("_orphans") > 0, 0).otherwise(F.col("_n")).cast("bigint").alias("n_packets"))


def asof(chunks: DataFrame, entries: DataFrame, source: str, chunk: str, first: str, value: str) -> DataFrame:
    """Each chunk with the value of the last entry whose first chunk is not after it, or null.

    Both sides are cut into spans of chunk numbers, so a large source is not one task: within a
    span the last entry comes from a window, before it from the last entries of earlier spans
    (one row a source and span that has entries).
    """
    span = lambda c: F.floor(F.col(c) / ASOF_SPAN)
    last = entries.groupBy(source, span(first).alias("_span")).agg(F.max_by(F.struct(F.col(value).alias("v")), first).alias("_last"))
    spans = chunks.select(source, span(chunk).alias("_span")).distinct()
    w = Window.partitionBy(source).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.join(last, [source, "_span"], "full").withColumn("_carry", F.last("_last", ignorenulls=True).over(w)).select(source, "_span", "_carry")
    cols = chunks.columns
    marked = chunks.withColumns({"_span": span(chunk), "_at": F.col(chunk).cast("bigint"), "_kind": F.lit(1), "_entry": F.lit(None).cast(last.schema["_last"].dataType)})
    points = entries.select(source, span(first).alias("_span"), F.col(first).cast("bigint").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(value).alias("v")).alias("_entry"))
    both = marked.unionByName(points, allowMissingColumns=True)
    inside = Window.partitionBy(source, "_span").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_in", F.last("_entry", ignorenulls=True).over(inside)).where("_kind = 1")
    return seen.join(carried, [source, "_span"], "left").select(*cols, F.coalesce("_in", "_carry")["v"].alias(value))


def expand_runs(runs: DataFrame, source: str, order: str, run: str, value: str) -> DataFrame:
    """(source, ordinal, value): each run-length entry as that many rows, numbered through the source."""
    started = running(runs, source, [order], {"_start": F.col(run).cast("bigint")}).where(F.col(run) > 0)
    return started.select(source, F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col(run) - 1)).alias("ordinal"), value)


def nth_row(rows: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """The n-th row (from 0) of each source."""
    return running(rows, source, [order], {"_n": F.lit(1)}).where(F.col("_n") == n).drop("_n")


def chunk_at(chunks: DataFrame, source: str, order: list[str], samples: str, target: int) -> DataFrame:
    """The chunk of each source that holds sample ``target``, with the offset into it and what remains."""
    low = running(chunks, source, order, {"_low": F.col(samples).cast("bigint")})
    inside = low.where((F.col("_low") <= target) & (F.lit(target) - F.col("_low") < F.col(samples)))
    return inside.withColumn("offset_samples", (F.lit(target) - F.col("_low")).cast("bigint")).withColumn("available", (F.col(samples) - F.col("offset_samples")).cast("bigint")).drop("_low")


def contiguity(packets: DataFrame, source: str, order: str, offset: str, size: str, timestamp: str, duration: str) -> DataFrame:
    """One row a source: packets that overlap the one before, and that break the running timestamp."""
    seen = running(packets, source, [order], {"_due": F.col(duration)}, {"_end": F.col(offset) + F.col(size)})
    marked = seen.withColumns({"_overlap": (F.col(offset) < F.col("_end")).cast("int"), "_gap": (F.col(timestamp) != F.col("_due")).cast("int")})
    sums = marked.groupBy(source).agg(F.coalesce(F.sum("_overlap"), F.lit(0)).alias("overlaps"), F.coalesce(F.sum("_gap"), F.lit(0)).alias("gaps"))
    return sums.withColumn("status", F.when((F.col("overlaps") > 0) | (F.col("gaps") > 0), -3).otherwise(0))


def duration_check(packets: DataFrame, source: str, duration: str, declared: DataFrame, total: str) -> DataFrame:
    """Sum of durations of each source, saturated to 32 bits, against the declared one (0: undeclared)."""
    sums = packets.groupBy(source).agg(F.least(F.sum(F.col(duration).cast("bigint")), F.lit(U32)).alias("duration_ticks"))
    joined = sums.join(declared.select(source, total), source)
    return joined.withColumn("matches", (F.col(total) == 0) | (F.col(total) == F.col("duration_ticks")))


def last_granule(pages: DataFrame, source: str, seq: str, granule: str, none: int = -1) -> DataFrame:
    """The granule of the last page that has one."""
    return pages.where(F.col(granule) != none).groupBy(source).agg(F.max_by(granule, seq).alias("granule"))


def latest(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """The row of the highest revision of each key; a partial aggregate, so a hot key costs one row a partition."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), revision).alias("_row")).select("_row.*")


def publisher_states(events: DataFrame, publisher: str, order: str) -> DataFrame:
    """``accepted`` and ``session_id`` (0: none is open) after each event of a session's publisher.

    Events are of a kind publish, update, poll or close, with info_ok, reply_session, reply_revision, command and
    command_revision.  A publish replaces what was open, also if it is refused; a refused update changes nothing; a
    bad command ends the session.  Only those events that open or end a session matter to later ones, so the state
    is the last of these.  ``order`` is unique within a publisher.
    """
    kind = F.col("kind")
    opened = F.col("info_ok") & number_ok(F.col("reply_session")) & number_ok(F.col("reply_revision"))
    good = command_ok(F.col("command"), F.col("command_revision"))
    left = F.when(kind == "publish", F.when(opened, F.col("reply_session")).otherwise(0)).when((kind == "close") | ((kind == "poll") & ~good), 0)
    moved = left.cast("decimal(20,0)")
    last = F.when(moved.isNotNull(), F.struct(F.col(order).alias("at"), moved.alias("session")))
    seen = running(events, publisher, [order], {}, latest={"_now": last}, earlier={"_past": last})
    seen = seen.withColumns({"_before": F.coalesce("_past.session", F.lit(0)), "session_id": F.coalesce("_now.session", F.lit(0))})
    there = F.col("_before") != 0
    ok = F.when(kind == "publish", opened).when(kind == "update", there & F.col("info_ok")).when(kind == "poll", there & good).otherwise(kind == "close")
    return seen.withColumn("accepted", ok).drop("_now", "_past", "_before")


def duplicate_tracks(tracks: DataFrame, source: str, track: str) -> DataFrame:
    """Sources that use a track id twice."""
    return tracks.groupBy(source, track).count().where("count > 1").select(source).distinct()


def best_track(tracks: DataFrame, source: str, track: str, is_default: str) -> DataFrame:
    """The first track of each source, those marked as default before the others."""
    key = F.struct((~F.col(is_default)).cast("int"), F.col(track))
    return tracks.groupBy(source).agg(F.min_by(F.struct(*tracks.columns), key).alias("_row")).select("_row.*")


def best_audio(tracks: DataFrame, source: str, track: str, kind: str, is_default: str) -> DataFrame:
    """``best_track`` among those of kind AUDIO; a source without one has no row."""
    return best_track(tracks.where(F.col(kind) == AUDIO), source, track, is_default)


def clock_positions(events: DataFrame, player: str, order: str, elapsed: str, fps: Column, frames: Column) -> DataFrame:
    """Time after each update of a clock that saturates at 32 bits and does not loop, and its target frame."""
    step = F.coalesce(F.col(elapsed).cast("bigint"), F.lit(0))
    timed = running(events, player, [order], {"time_ms": step}).withColumn("time_ms", F.least(F.col("time_ms") + step, F.lit(U32)))
    raw = F.floor(F.col("time_ms").cast("double") * fps / 1000.0)
    return timed.withColumn("target_frame", F.when((frames > 0) & (fps > 0), F.least(raw, frames - 1)).otherwise(0).cast("bigint"))
