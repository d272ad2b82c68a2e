"""Playback admission: one conditional expression per output column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States, commands and the flags that offer them, reasons.
FOREGROUND, BACKGROUND, LOCKED = 1, 2, 3
PAUSED, PLAYING = 1, 2
PLAY_PAUSE, NEXT, PREVIOUS, STOP = 1, 2, 3, 4
FLAGS = {PLAY_PAUSE: 1, NEXT: 2, PREVIOUS: 4, STOP: 8}
ALL_FLAGS = 15
R_OK, R_INVALID, R_PAUSED, R_BACKGROUND, R_OUTPUT = 0, 1, 2, 3, 4


def reason(state: Column, playback: Column, background: Column, output: Column, flags: Column, generation: Column) -> Column:
    """Why playback is denied, the first that holds: malformed, paused, no output, background not allowed; 0: admitted."""
    valid = state.isin(FOREGROUND, BACKGROUND, LOCKED) & playback.isin(PAUSED, PLAYING) & background.isin(0, 1) & output.isin(0, 1) & flags.between(0, ALL_FLAGS) & (generation != 0)
    return (
        F.when(~F.coalesce(valid, F.lit(False)), R_INVALID)
        .when(playback == PAUSED, R_PAUSED)
        .when(output == 0, R_OUTPUT)
        .when((state != FOREGROUND) & (background == 0), R_BACKGROUND)
        .otherwise(R_OK)
    )


def decision(state: Column, playback: Column, background: Column, output: Column, flags: Column, generation: Column) -> dict[str, Column]:
    why = reason(state, playback, background, output, flags, generation)
    allowed = why == R_OK
    return {
        "allow_playback": allowed.cast("int"),
        "show_lock_controls": (allowed & (state == LOCKED) & (flags != 0)).cast("int"),
        "request_power_inhibit": allowed.cast("int"),
        "reason": why,
    }


def command_flag(command: Column) -> Column:
    """The flag that offers a command; 0 for others."""
    out = F.lit(0)
    for c, f in FLAGS.items():
        out = F.when(command == c, f).otherwise(out)
    return out


def lock_build(state: Column, playback: Column, background: Column, output: Column, flags: Column, generation: Column, session: Column, command: Column) -> Column:
    """1 admitted, 0 denied, -1 malformed."""
    flag = command_flag(command)
    got = decision(state, playback, background, output, flags, generation)
    return F.when((session == 0) | (flag == 0) | (got["reason"] == R_INVALID), -1).when((got["show_lock_controls"] == 0) | (flags.bitwiseAND(flag) == 0), 0).otherwise(1)


def power_build(state: Column, playback: Column, background: Column, output: Column, flags: Column, generation: Column, session: Column) -> Column:
    got = decision(state, playback, background, output, flags, generation)
    return F.when((session == 0) | (got["reason"] == R_INVALID), -1).otherwise(got["request_power_inhibit"])
