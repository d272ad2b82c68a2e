"""Playback machines as scans: states from running sums and maxima, so that a session of any size is the work of many tasks.

What these machines remember is little: the last event of some kind, or the highest generation since the last event that
cleared all.  Each is a maximum of structs that begin with the place of the event, or of the segment it lies in.  Maxima and
sums are associative, so ``timeline.running`` computes them piece by piece and carries one row from piece to piece.

The results are those of the machines in ``machines``, whose callbacks all succeed here; ``replay`` and the
stream processors run owners whose callbacks fail, and players, whose clock wraps around by what was there before.

Events need an order that is unique within their key.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import policy
from .machines import POLICY
from .policy import ALL_FLAGS, FOREGROUND, PAUSED, PLAYING, R_INVALID
from .timeline import running


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def lifecycle(events: DataFrame, key: str, seq: str, session: str = "session", **options: Any) -> DataFrame:
    """key, seq and the results of ``machines.Lifecycle``.

    A bind that is valid or a clear begins a segment, whatever came before; the session it leaves is fixed for the
    segment, so which of its other events are accepted is known from it alone, and the last accepted ones are the state.
    """
    e = events.select(*dict.fromkeys([key, seq, session, "kind", *POLICY]))
    kind, place = F.col("kind"), F.col(seq).alias("at")
    binds = _sure((kind == "bind") & (F.col(session) != 0) & (F.col("generation") != 0) & F.col("flags").between(0, ALL_FLAGS))
    begins = binds | (kind == "clear")
    bound = F.struct(place, binds.alias("bound"), *(F.col(c).alias(c) for c in ("generation", "background", "output", "flags")))
    one = running(e, key, [seq], {}, latest={"_base": F.when(begins, bound)}, **options)
    has = _sure(F.col("_base.bound"))
    mine = _sure(has & ~begins & (F.col("generation") == F.col("_base.generation")))
    surfaces = _sure((kind == "surface") & mine & ((F.col("state") == FOREGROUND) | (F.col("_base.background") != 0)))
    plays = _sure((kind == "playback") & mine)
    two = running(
        one.withColumns({"_ok": begins | surfaces | plays}), key, [seq], {},
        latest={"_surface": F.when(surfaces, F.struct(place, F.col("state").alias("state"))), "_play": F.when(plays, F.struct(place, (F.col("playback") == PLAYING).alias("on"), F.col("output").alias("output")))}, **options,
    )
    since = lambda c: _sure(F.col(f"{c}.at") > F.col("_base.at"))
    state = F.when(since("_surface"), F.col("_surface.state")).otherwise(FOREGROUND)
    playing = F.when(_sure(since("_play") & F.col("_play.on")), PLAYING).otherwise(PAUSED)
    output = F.when(since("_play"), F.col("_play.output")).otherwise(F.col("_base.output"))
    decided = policy.decision(state, playing, F.col("_base.background"), output, F.col("_base.flags"), F.col("_base.generation"))
    shown = {k: F.when(has, c).otherwise(R_INVALID if k == "reason" else 0).cast("int") for k, c in decided.items()}
    return two.select(key, seq, F.col("_ok").cast("int").alias("accepted"), has.cast("int").alias("bound"), *(c.alias(k) for k, c in shown.items()))


def owner(events: DataFrame, key: str, seq: str, lock: bool, session: str = "session", **options: Any) -> DataFrame:
    """key, seq and the results of ``machines.Owner``.

    What is held changes hands within runs of admitted requests of one session: a denial ends a run, and so does another session, which
    takes over at once.  Within a run the highest generation holds, of equal ones the last.
    """
    names = dict.fromkeys([key, seq, *POLICY, session, "command"])
    inputs = [F.col(c) for c in POLICY]
    wanted = policy.lock_build(*inputs, F.col(session), F.col("command")) if lock else policy.power_build(*inputs, F.col(session))
    e = events.select(*names).withColumn("_wanted", wanted)
    one = running(e, key, [seq], {}, before={"_was": F.struct("_wanted", F.col(session).alias("session"))}, **options)
    goes_on = _sure((F.col("_wanted") == 1) & (F.col("_was._wanted") == 1) & (F.col("_was.session") == F.col(session)))
    two = running(one.withColumn("_new", (~goes_on).cast("bigint")), key, [seq], {"_runs": F.col("_new")}, **options)
    held = F.struct(
        (F.col("_runs") + F.col("_new")).alias("run"), F.when(F.col("_wanted") == 1, F.col("generation").cast("bigint")).alias("generation"), F.col(seq).alias("at"),
        F.col(session).cast("bigint").alias("session"), (F.col("command") if lock else F.lit(0)).cast("int").alias("command"),
    )
    three = running(two, key, [seq], {}, latest={"_now": held}, earlier={"_past": held}, **options)
    stale = _sure((F.col("_past.run") == F.col("_runs") + F.col("_new")) & (F.col("generation") < F.col("_past.generation")))
    active = F.col("_now.generation").isNotNull()
    result = F.when(F.col("_wanted") <= 0, F.col("_wanted")).when(stale, -1).otherwise(1).cast("int")
    shown = {"active_session": "session", "active_generation": "generation", "active_command": "command"}
    return three.select(key, seq, result.alias("result"), active.cast("int").alias("active"), F.lit(0).alias("pending"), *(F.when(active, F.col(f"_now.{c}")).otherwise(0).alias(k) for k, c in shown.items()))


def clock(events: DataFrame, key: str, seq: str, **options: Any) -> DataFrame:
    """key, seq and the results of ``machines.Clock``: the last position, the last rate in bounds, the last pause or resume."""
    kind, value, place = F.col("kind"), F.col("value").cast("bigint"), F.col(seq).alias("at")
    rated = _sure((kind == "rate") & value.between(1, 4000))
    stops = kind.isin("pause", "resume")
    last = {
        "_position": F.when(kind == "position", F.struct(place, value.alias("v"))),
        "_rate": F.when(rated, F.struct(place, value.alias("v"))),
        "_paused": F.when(stops, F.struct(place, (kind == "pause").cast("int").alias("v"))),
    }
    found = running(events, key, [seq], {}, latest=last, **options)
    ok = _sure((kind == "position") | rated | stops)
    return found.select(
        key, seq, ok.cast("int").alias("accepted"), F.coalesce("_position.v", F.lit(0)).alias("position_ns"), F.coalesce("_rate.v", F.lit(1000)).cast("int").alias("rate_permille"), F.coalesce("_paused.v", F.lit(1)).alias("paused")
    )
