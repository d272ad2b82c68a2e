"""WAV files as relations by column expressions alone: chunks, the format, one track, packets of sample frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import status as S
from ..functions.scalars import read_le
from .boxtree import SPANS, _held, _long, kind_at, let, name_at
from .riff import _GUID_TAIL, ALAW, EXTENSIBLE, FLOAT, IMA, MULAW, PCM, TAG_NAMES, U32

#: Depths that each format may have.
DEPTHS = {PCM: (8, 16, 24, 32), FLOAT: (32,), ALAW: (8,), MULAW: (8,)}


def chunks(data: Column, at: Column, end: Column, wanted: tuple[str, ...]) -> Column:
    """(at, ok, found): a walk over chunks whose bodies are padded to even sizes, as ``boxtree.siblings`` over boxes."""
    kind = f"struct<at: bigint, ok: boolean, found: {SPANS}>"
    wide = F.sequence(F.lit(1), F.greatest(F.ceil(F.sqrt((end - at) / 8.0)).cast("int") + 1, F.lit(1)))
    begin = F.struct(_long(at).alias("at"), F.lit(True).alias("ok"), F.array().cast(SPANS).alias("found")).cast(kind)
    more = lambda s: s["ok"] & (s["at"] + 8 <= end)

    def step(s: Column) -> Column:
        low = s["at"].cast("int")
        span = F.struct(name_at(data, low).alias("kind"), (s["at"] + 8).alias("at"), (s["at"] + 8 + read_le(data, low + 4, 4)).alias("end"))
        return let(span, lambda b: taken_in(s, b))

    def taken_in(s: Column, b: Column) -> Column:
        good = F.coalesce(b["end"] <= end, F.lit(False))
        found = F.when(good & b["kind"].isin(*wanted), F.array_append(s["found"], b)).otherwise(s["found"])
        return F.struct(F.when(good, b["end"] + (b["end"] - b["at"]) % 2).otherwise(s["at"]).alias("at"), good.alias("ok"), found.alias("found"))

    taken = lambda s, inner: F.when(more(s), inner(s)).otherwise(s)
    one = lambda s: F.aggregate(wide, s, lambda t, _: taken(t, step))
    return F.aggregate(wide, begin, lambda t, _: taken(t, one))


def inspected(sources: DataFrame, max_bytes: int = S.MAX_SOURCE_BYTES) -> DataFrame:
    """source_id, status, container_id, and of files that are right tag, channels, rate, align, bits, start, size, block_samples and n_samples; one row a source."""
    data, c = F.col("content"), F.col
    n = F.octet_length("content").cast("bigint")
    fits = F.coalesce((n > 0) & (n <= max_bytes), F.lit(False))
    own = sources.select(c("source_id").cast("string").alias("source_id"), F.when(fits, data).alias("content"), fits.alias("fits"))
    own = own.withColumn("end", 8 + read_le(data, 4, 4))
    named = (kind_at(data, F.lit(0)) == "RIFF") & (kind_at(data, F.lit(8)) == "WAVE") & (F.octet_length("content") >= 12) & (c("end") <= F.octet_length("content"))
    own = own.withColumn("is_wav", F.coalesce(named, F.lit(False)))
    own = own.withColumn("walk", F.when(c("is_wav") & (c("end") >= 12), chunks(data, _long(12), c("end"), ("fmt ", "data"))))
    one = lambda k: F.filter("walk.found", lambda b: b["kind"] == k)
    whole = F.coalesce(c("walk.ok") & (F.size(one("fmt ")) == 1) & (F.size(one("data")) == 1), F.lit(False))
    own = own.select("source_id", "content", "fits", "is_wav", whole.alias("whole"), F.get(one("fmt "), F.lit(0)).alias("f"), F.get(one("data"), F.lit(0)).alias("d"))
    room = c("f.end") - c("f.at")
    body = F.when(c("whole"), F.substring(data, (c("f.at") + 1).cast("int"), room.cast("int")))
    own = own.select("source_id", "fits", "is_wav", "whole", body.alias("fmt"), c("d.at").alias("start"), (c("d.end") - c("d.at")).alias("size"))
    field = lambda at, n: read_le(c("fmt"), at, n)
    extended = (F.octet_length("fmt") >= 40) & (field(18, 2) <= field(14, 2)) & (F.substring("fmt", 27, 14) == F.lit(_GUID_TAIL))
    tag = F.when(field(0, 2) == EXTENSIBLE, F.when(extended, field(24, 2))).otherwise(field(0, 2))
    own = own.select("*", tag.alias("tag"), field(2, 2).alias("channels"), field(4, 4).alias("rate"), field(12, 2).alias("align"), field(14, 2).alias("bits"))
    head = 4 * c("channels")
    ima = (c("tag") == IMA) & (c("bits") == 4) & (c("align") > head) & ((c("align") - head) % head == 0)
    plain = F.lit(False)
    for t, depths in DEPTHS.items():
        plain |= (c("tag") == t) & c("bits").isin(*depths) & (c("align") * 8 == c("channels") * c("bits"))
    sound = (F.octet_length("fmt") >= 16) & c("channels").between(1, 2) & (c("rate") > 0) & (c("align") > 0) & (ima | plain)
    block = F.when(c("tag") == IMA, F.call_function("div", (c("align") - head) * 2, c("channels")) + 1).otherwise(1).cast("bigint")
    right = F.coalesce(c("whole") & sound & (c("size") > 0) & (c("size") % F.when(c("align") > 0, c("align")) == 0), F.lit(False))
    status = F.when(~c("fits"), S.INVALID).when(right, S.OK).otherwise(S.UNSUPPORTED)
    own = own.select("*", _held(status).alias("status"), F.when(c("is_wav"), S.WAV).otherwise(0).alias("container_id"), block.alias("block_samples"))
    total = F.least(F.call_function("div", c("size"), F.when(c("status") == S.OK, c("align"))) * c("block_samples"), F.lit(U32))
    return own.select("source_id", "status", "container_id", "tag", "channels", "rate", "align", "bits", "start", "size", "block_samples", total.alias("n_samples"))


def tracks(found: DataFrame) -> DataFrame:
    name = F.coalesce(*(F.when(F.col("tag") == t, n) for t, n in TAG_NAMES.items()))
    return found.where(F.col("status") == S.OK).select(
        "source_id", "container_id", F.lit(1).cast("bigint").alias("track_id"), F.lit(S.AUDIO).alias("kind"), F.col("tag").alias("codec_id"), F.col("rate").alias("time_scale"), F.col("n_samples").cast("decimal(20,0)").alias("duration_ticks"), name.alias("codec_name")
    )


def _count(frames_per_packet: int) -> Column:
    return F.call_function("div", F.col("size") + F.col("align") * frames_per_packet - 1, F.when(F.col("align") > 0, F.col("align")) * frames_per_packet)


def packets(found: DataFrame, frames_per_packet: int = 1, limits: S.Limits = S.LIMITS) -> DataFrame:
    """PACKETS: a block each, or so many together."""
    step = F.col("align") * frames_per_packet
    n = F.when((F.col("status") == S.OK) & (_count(frames_per_packet) <= limits.packets), _count(frames_per_packet))
    rows = found.select("*", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1))).alias("seq"))
    at = F.col("seq") * step
    size = F.least(step, F.col("size") - at)
    return rows.select(
        "source_id", F.col("seq").cast("int").alias("seq"), (F.col("start") + at).alias("byte_offset"), size.alias("byte_size"), F.lit(1).cast("bigint").alias("track_id"), (F.col("seq") * frames_per_packet * F.col("block_samples")).cast("decimal(20,0)").alias("timestamp_ticks"),
        (F.call_function("div", size, F.col("align")) * F.col("block_samples")).alias("duration_ticks"), F.lit(S.KEYFRAME).alias("flags"),
    )


def statuses(found: DataFrame, frames_per_packet: int = 1, limits: S.Limits = S.LIMITS) -> DataFrame:
    """(source_id, stage, code, n_packets) of the index."""
    n = F.when(F.col("status") == S.OK, _count(frames_per_packet))
    code = F.when((F.col("status") == S.OK) & (n > limits.packets), S.UNSUPPORTED).otherwise(F.col("status"))
    return found.select("source_id", F.lit("index").alias("stage"), code.alias("code"), F.when(code == S.OK, n).otherwise(0).alias("n_packets"))
