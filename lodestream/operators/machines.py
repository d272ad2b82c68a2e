"""Playback state machines in plain Python; Spark code replays events through them.

Each machine keeps the state of one key as a dict of plain values, takes one event (a dict) at a
time and returns the result columns of that event.
"""

from __future__ import annotations

from collections.abc import Callable

from .policy import ALL_FLAGS, BACKGROUND, FLAGS, FOREGROUND, LOCKED, PAUSED, PLAYING, R_BACKGROUND, R_INVALID, R_OK, R_OUTPUT, R_PAUSED

U32 = 4_294_967_295


def decide(state: int, playback: int, background: int, output: int, flags: int, generation: int) -> tuple[int, int, int, int]:
    """(allow, show lock controls, inhibit power, reason)."""
    if state not in (FOREGROUND, BACKGROUND, LOCKED) or playback not in (PAUSED, PLAYING) or background not in (0, 1) or output not in (0, 1) or not 0 <= flags <= ALL_FLAGS or not generation:
        return 0, 0, 0, R_INVALID
    if playback == PAUSED:
        return 0, 0, 0, R_PAUSED
    if not output:
        return 0, 0, 0, R_OUTPUT
    if state != FOREGROUND and not background:
        return 0, 0, 0, R_BACKGROUND
    return 1, int(state == LOCKED and flags != 0), 1, R_OK


POLICY = ("state", "playback", "background", "output", "flags", "generation")


class Lifecycle:
    """Events bind, clear, surface and playback of one session, checked against the bound generation."""

    RESULT = "accepted int, bound int, allow_playback int, show_lock_controls int, request_power_inhibit int, reason int"
    START = {"bound": 0, "generation": 0, "background": 0, "output": 0, "flags": 0, "state": FOREGROUND, "playing": 0}

    def step(self, s: dict, e: dict) -> tuple:
        kind, ok = e["kind"], False
        if kind == "bind":
            ok = bool(e["session"]) and bool(e["generation"]) and 0 <= e["flags"] <= ALL_FLAGS
            if ok:
                s.update(self.START, bound=1, generation=e["generation"], background=e["background"], output=e["output"], flags=e["flags"])
        elif kind == "clear":
            ok = True
            s.update(self.START)
        elif s["bound"] and e["generation"] == s["generation"]:
            if kind == "surface":
                ok = e["state"] == FOREGROUND or bool(s["background"])
                if ok:
                    s["state"] = e["state"]
            elif kind == "playback":
                ok = True
                s.update(playing=int(e["playback"] == PLAYING), output=e["output"])
        if not s["bound"]:
            return int(ok), 0, 0, 0, 0, R_INVALID
        got = decide(s["state"], PLAYING if s["playing"] else PAUSED, s["background"], s["output"], s["flags"], s["generation"])
        return int(ok), 1, *got


class Owner:
    """Keeps what is shown or held in step with the policy's requests.

    ``act`` and ``undo`` are the owner's callbacks; they return False on failure.  A failed undo
    stays pending and is tried again before anything new is done; a failed act is undone.
    """

    RESULT = "result int, active int, pending int, active_session bigint, active_generation bigint, active_command int"
    START = {"active": 0, "pending": 0, "session": 0, "generation": 0, "command": 0}

    def __init__(self, lock: bool, act: Callable[[dict], bool] = lambda e: True, undo: Callable[[dict], bool] = lambda e: True):
        self.lock, self.act, self.undo = lock, act, undo

    def build(self, e: dict) -> int:
        _, show, inhibit, why = decide(*(e[k] for k in POLICY))
        flag = FLAGS.get(e["command"], 0)
        if not e["session"] or why == R_INVALID or (self.lock and not flag):
            return -1
        return int(show and e["flags"] & flag != 0) if self.lock else inhibit

    def clear(self, s: dict, e: dict) -> bool:
        if not s["active"] and not s["pending"]:
            return True
        if not self.undo(e):
            s["pending"] = 1
            return False
        s.update(self.START)
        return True

    def sync(self, s: dict, e: dict) -> int:
        wanted = self.build(e)
        if wanted <= 0:  # a stale denial clears as well
            cleared = self.clear(s, e)
            return wanted if cleared else -1
        if s["pending"] and not self.clear(s, e):
            return -1
        command = e["command"] if self.lock else 0
        if s["active"]:
            same = s["session"] == e["session"]
            if same and e["generation"] < s["generation"]:
                return -1
            if same and s["generation"] == e["generation"]:
                if s["command"] == command:
                    return 1
            elif not self.clear(s, e):
                return -1
        s.update(active=1, pending=0, session=e["session"], generation=e["generation"], command=command)
        if not self.act(e):
            self.clear(s, e)
            return -1
        return 1

    def step(self, s: dict, e: dict) -> tuple:
        result = self.sync(s, e)
        return result, s["active"], s["pending"], s["session"], s["generation"], s["command"]


class Player:
    """A playback clock over frames; an overshoot with looping restarts at frame 0 exactly."""

    RESULT = "time_ms bigint, target_frame bigint, frames_due bigint, playing int"
    START = {"time_ms": 0, "frame": 0, "playing": 0, "loop": 0}

    def __init__(self, fps: float, frames: int):
        self.fps, self.frames = fps, frames

    def step(self, s: dict, e: dict) -> tuple:
        kind, target, due = e["kind"], s["frame"], 0
        if kind in ("play", "pause"):
            s["playing"] = int(kind == "play")
        elif kind == "stop":
            s.update(playing=0, frame=0, time_ms=0)
            target = 0
        elif kind == "loop":
            s["loop"] = int(bool(e["value"]))
        elif kind == "seek":
            s["frame"] = max(0, min(int(e["value"]), self.frames - 1))
            s["time_ms"] = min(U32, int(s["frame"] * 1000.0 / self.fps)) if self.fps > 0 else 0
            target = s["frame"]
        elif kind == "update" and s["playing"] and self.frames and self.fps > 0:
            s["time_ms"] = min(U32, s["time_ms"] + int(e["value"]))
            target = min(self.frames, int(s["time_ms"] * self.fps / 1000.0))
            if target >= self.frames:
                if s["loop"]:
                    target %= self.frames
                    s["time_ms"] = min(U32, int(target * 1000.0 / self.fps))
                else:
                    target = self.frames - 1
            due = max(0, min(target - s["frame"], 2**31 - 1))
        return s["time_ms"], target, due, s["playing"]


class Clock:
    """A position set by its owner, with a rate of 1 to 4000 per mille and a pause flag."""

    RESULT = "accepted int, position_ns bigint, rate_permille int, paused int"
    START = {"position": 0, "rate": 1000, "paused": 1}

    def step(self, s: dict, e: dict) -> tuple:
        kind, ok = e["kind"], True
        if kind == "position":
            s["position"] = e["value"]
        elif kind == "rate":
            ok = 1 <= e["value"] <= 4000
            if ok:
                s["rate"] = e["value"]
        elif kind in ("pause", "resume"):
            s["paused"] = int(kind == "pause")
        else:
            ok = False
        return int(ok), s["position"], s["rate"], s["paused"]
