"""Scalar functions on bytes, times, text and geometry, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4_294_967_295
MAX_SIDE, MAX_PIXELS, MAX_FRAME_BYTES = 4096, 16_777_216, 64 * 1024 * 1024


def read_be(data: Column, at: int | Column, n: int) -> Column:
    """Unsigned big-endian integer of n <= 7 bytes (exact in a bigint), from byte ``at`` (0-based)."""
    return F.conv(F.hex(F.substring(data, at + 1, n)), 16, 10).cast("bigint")


def read_le(data: Column, at: int, n: int) -> Column:
    """Unsigned little-endian integer of n <= 7 bytes."""
    return F.conv(F.concat(*(F.hex(F.substring(data, at + k, 1)) for k in range(n, 0, -1))), 16, 10).cast("bigint")


def signed(x: Column, bits: int) -> Column:
    return F.when(x >= 1 << (bits - 1), x - (1 << bits)).otherwise(x)


def fourcc(code: Column) -> Column:
    """Big-endian value of a four-character code."""
    return read_be(F.encode(code, "utf-8"), 0, 4)


def stream_index(chunk: Column) -> Column:
    """Two leading digits of a chunk id, else -1."""
    return F.when(chunk.rlike("^[0-9]{2}"), F.substring(chunk, 1, 2).cast("int")).otherwise(-1)


def is_video_chunk(chunk: Column) -> Column:
    return chunk.rlike("^..d[cb]$")


def is_audio_chunk(chunk: Column) -> Column:
    return chunk.rlike("^..wb$")


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, of the UTF-8 bytes; 0 becomes 1."""
    digits = F.hex(F.encode(text, "utf-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda p: F.conv(F.substring(digits, p, F.lit(2)), 16, 10).cast("bigint")
    h = F.aggregate(places, F.lit(2166136261).cast("bigint"), lambda h, p: (h.bitwiseXOR(byte(p)) * 16777619).bitwiseAND(U32))
    return F.when(h == 0, F.lit(1).cast("bigint")).otherwise(h)


def text_admitted(text: Column, limit: int = 128) -> Column:
    """Valid UTF-8 without C0 controls or DEL, shorter than ``limit`` bytes."""
    return F.coalesce(F.is_valid_utf8(text) & ~text.rlike("[\\x00-\\x1f\\x7f]") & (F.octet_length(text) < limit), F.lit(False))


def frame_time_ms(frame: Column, fps: Column) -> Column:
    """Start of a frame in whole milliseconds, saturating at 32 bits; 0 for a rate that is not positive."""
    value = frame.cast("double") * 1000.0 / fps
    return F.when(fps > 0, F.least(F.lit(float(U32)), F.floor(value).cast("double"))).otherwise(0.0).cast("bigint")


def frame_for_time(ms: Column, fps: Column) -> Column:
    value = ms.cast("double") * fps / 1000.0
    return F.when(fps > 0, F.least(F.lit(float(U32)), F.floor(value).cast("double"))).otherwise(0.0).cast("bigint")


def sample_for_time(ms: Column, rate: Column) -> Column:
    return F.least(F.lit(U32), F.call_function("div", ms.cast("bigint") * rate.cast("bigint"), F.lit(1000)))


def duration_ms(samples: Column, rate: Column) -> Column:
    return F.when(rate > 0, F.least(F.lit(U32), F.call_function("div", samples.cast("bigint") * 1000, rate.cast("bigint")))).otherwise(0).cast("bigint")


def frame_timestamp_ns(index: Column, scale: Column, rate: Column) -> Column:
    """index * scale / rate seconds in whole nanoseconds, without overflow."""
    wide = index.cast("decimal(20,0)") * scale.cast("decimal(10,0)")
    whole = F.floor(wide / rate.cast("decimal(10,0)"))
    rest = wide - whole * rate.cast("decimal(10,0)")
    return (whole.cast("decimal(20,0)") * F.lit(1_000_000_000) + F.floor(rest.cast("decimal(20,0)") * F.lit(1_000_000_000) / rate.cast("decimal(10,0)"))).cast("decimal(38,0)")


def rescaled_ns(ticks: Column, num: Column, den: Column) -> Column:
    """Ticks of num/den seconds in nanoseconds, rounded half away from zero."""
    return F.round(ticks.cast("decimal(20,0)") * num.cast("decimal(9,0)") * F.lit(1_000_000_000) / den.cast("decimal(9,0)"), 0).cast("decimal(38,0)")


def seek_sample(ms: Column, rate: Column, total: Column, block: int = 1) -> Column:
    """Sample to seek to: clamped to the end, floored to a block."""
    at = F.least(total.cast("bigint"), sample_for_time(ms, rate))
    return at - at % block


def frame_geometry_ok(width: Column, height: Column) -> Column:
    return width.between(1, MAX_SIDE) & height.between(1, MAX_SIDE) & (width.cast("bigint") * height <= MAX_PIXELS) & (width.cast("bigint") * height * 4 <= MAX_FRAME_BYTES)


def rational_ok(num: Column, den: Column) -> Column:
    return (num > 0) & (den > 0) & (num.cast("bigint") <= den.cast("bigint") * 1000)


def audio_format_ok(rate: Column, channels: Column) -> Column:
    return rate.between(1, 384_000) & channels.between(1, 32)


def rgb565_to_argb(pixel: Column) -> Column:
    """Opaque ARGB of a 565 pixel; the channels are shifted up, low bits stay zero."""
    p = pixel.cast("bigint")
    r = F.shiftright(p, 11).bitwiseAND(31) * 8
    g = F.shiftright(p, 5).bitwiseAND(63) * 4
    b = p.bitwiseAND(31) * 8
    return F.lit(0xFF000000).cast("bigint") + r * 65536 + g * 256 + b


def opus_frame_ticks(toc: Column) -> Column:
    """Ticks at 48 kHz of one frame, by the packet's first byte."""
    config = F.shiftright(toc.cast("int"), 3)
    step = config.bitwiseAND(3)
    power = lambda base: F.call_function("shiftleft", F.lit(base), step)
    return F.when(config < 12, F.element_at(F.array(*map(F.lit, (480, 960, 1920, 2880))), step + 1)).when(config < 16, F.when(config.bitwiseAND(1) == 0, 480).otherwise(960)).otherwise(power(120))
