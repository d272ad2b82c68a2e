"""Whether rows of the media relations are well formed, as predicates over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import text_admitted
from .policy import ALL_FLAGS, FLAGS, PAUSED, PLAYING

MAX_PACKET_BYTES, MAX_CHANNELS, MAX_RATE = 16 * 1024 * 1024, 32, 384_000
TEXT_BYTES, METADATA_BYTES = 128, 4096
#: Codes of uncompressed and of JPEG video, and what they are called.
MJPEG, RAW, UNKNOWN = "mjpeg", "raw", "unknown"
VIDEO_CODES = {"MJPG": MJPEG, "mjpg": MJPEG, "JPEG": MJPEG, "DIB ": RAW, "\0\0\0\0": RAW}
#: No revision: the largest unsigned 64-bit number.
NO_REVISION = 2**64 - 1
#: Fixed value: flags of a snapshot, allowed in the background (1) and with an output there (2).
INFO_FLAGS = 3


def track_ok(track: Column, kind: Column, codec: Column, scale: Column) -> Column:
    return (track != 0) & (kind != 0) & (codec != 0) & (scale != 0)


def packet_ok(size: Column, track: Column, pts: Column, dts: Column) -> Column:
    return size.between(1, MAX_PACKET_BYTES) & (track != 0) & (pts >= 0) & (dts >= 0)


def audio_frame_ok(samples: Column, channels: Column, rate: Column, timestamp_ms: Column) -> Column:
    return (samples > 0) & channels.between(1, MAX_CHANNELS) & (rate != 0) & (timestamp_ms >= 0)


def video_frame_ok(width: Column, height: Column, stride: Column, timestamp_ms: Column) -> Column:
    return (width > 0) & (height > 0) & (stride.cast("bigint") >= width.cast("bigint") * 4) & (timestamp_ms >= 0)


def pcm_config_ok(version: Column, rate: Column, channels: Column, sample_format: Column, reserved: Column, formats: int = 6) -> Column:
    return (version == 1) & rate.between(1, MAX_RATE) & channels.between(1, MAX_CHANNELS) & sample_format.between(1, formats) & (reserved == 0)


def session_info_ok(playback: Column, flags: Column, position_ms: Column, duration_ms: Column, revision: Column, title: Column, artist: Column, album: Column, published: bool, info_flags: Column | int = 0) -> Column:
    """A session snapshot; a publisher's has no revision yet, a published one has.

    Revisions are unsigned (bigint or decimal(20,0)); ``info_flags`` must be among INFO_FLAGS.
    """
    number = revision.cast("decimal(20,0)")
    unknown = (F.lit(info_flags) if isinstance(info_flags, int) else info_flags).cast("bigint").bitwiseAND(F.lit(~INFO_FLAGS).cast("bigint"))
    texts = text_admitted(title, TEXT_BYTES) & text_admitted(artist, TEXT_BYTES) & text_admitted(album, TEXT_BYTES)
    times = (position_ms >= 0) & (duration_ms >= 0) & ((duration_ms == 0) | (position_ms <= duration_ms))
    return playback.isin(PAUSED, PLAYING) & flags.between(1, ALL_FLAGS) & times & (number != 0 if published else number == 0) & (number != F.lit(str(NO_REVISION)).cast("decimal(20,0)")) & (unknown == 0) & texts


def lock_request_ok(session: Column, generation: Column, command: Column) -> Column:
    return (session != 0) & (generation != 0) & command.isin(*FLAGS)


def power_request_ok(session: Column, generation: Column, inhibit: Column) -> Column:
    return (session != 0) & (generation != 0) & (inhibit == 1)


def number_ok(number: Column) -> Column:
    """A session id or a revision that is given: unsigned 64 bits, neither 0 nor the largest."""
    return number.cast("decimal(20,0)").between(F.lit("1").cast("decimal(20,0)"), F.lit(str(NO_REVISION - 1)).cast("decimal(20,0)"))


def command_ok(command: Column, revision: Column, reserved: Column | int = 0) -> Column:
    """A command of a controller, as it is dispatched to a session or polled by its publisher."""
    return command.isin(*FLAGS) & number_ok(revision) & ((F.lit(reserved) if isinstance(reserved, int) else reserved) == 0)


def request_range_ok(address: Column, size: Column, most: int) -> Column:
    """A span of an unsigned 64-bit address space: not empty, not too long, and not beyond the end."""
    a, n = address.cast("decimal(20,0)"), size.cast("decimal(20,0)")
    return (a > 0) & (n > 0) & (n <= most) & (a + n <= F.lit(str(2**64 - 1)).cast("decimal(21,0)"))


def reply_ok(reply: Column, magic: Column | int, version: Column | int, operation: Column, request: Column, session: Column) -> Column:
    """Whether a reply's header (magic, version, operation, reserved, request_id, session_id) echoes its request's."""
    return (reply["magic"] == magic) & (reply["version"] == version) & (reply["operation"] == operation) & (reply["reserved"] == 0) & (reply["request_id"] == request) & (reply["session_id"] == session)


def video_codec(code: Column) -> Column:
    """What a four-character code of AVI video is decoded as."""
    out = F.lit(UNKNOWN)
    for c, name in VIDEO_CODES.items():
        out = F.when(code == c, name).otherwise(out)
    return out


def metadata(in_format: Column, in_stream: Column) -> Column:
    """The file's value, else the stream's; empty and overlong values count as absent."""
    usable = lambda c: F.when((F.length(c) > 0) & (F.octet_length(c) <= METADATA_BYTES), c)
    return F.coalesce(usable(in_format), usable(in_stream), F.lit(""))


def first_success(native_status: Column, native: Column, fallback_status: Column, fallback: Column) -> Column:
    """The native result, or the fallback's where the native one failed; null if both did."""
    return F.when(native_status == 0, native).when(fallback_status == 0, fallback)
