"""Schemas of the media relations; nothing is inferred."""

VERSION = 1

TRACK = "track_id bigint, kind int, codec_id bigint, time_scale bigint, duration_ticks decimal(20,0), codec_name string"
PACKET = "seq int, byte_offset bigint, byte_size bigint, track_id bigint, timestamp_ticks decimal(20,0), duration_ticks bigint, flags int"


def _struct(fields: str) -> str:
    """The fields as an array of structs."""
    parts = fields.replace("(20,0)", "(20;0)").split(", ")
    return ("array<struct<" + ", ".join(p.replace(" ", ": ", 1) for p in parts) + ">>").replace("(20;0)", "(20,0)")


INSPECTED = f"status int, container_id int, tracks {_struct(TRACK)}"
INDEXED = f"{INSPECTED}, packets {_struct(PACKET)}"

TRACKS = f"source_id string, container_id int, {TRACK}"
PACKETS = f"source_id string, {PACKET}"
SAMPLES = "source_id string, frame bigint, channel int, value int"
FRAMES = "source_id string, frame_index bigint, timestamp_ns decimal(20,0), width int, height int, pixels binary"
STATUS = "source_id string, stage string, code int"
DECISION = "allow_playback int, show_lock_controls int, request_power_inhibit int, reason int"
