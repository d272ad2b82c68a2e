"""AVI files as relations by column expressions alone: lists and chunks, streams, index rows, packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import status as S
from ..functions.scalars import read_be, read_le, signed
from .boxtree import _held, _long, kind_at
from .riff import AVI_TAG_NAMES, OTHER_NAME
from .wavtree import chunks

KINDS = {"vids": S.VIDEO, "auds": S.AUDIO, "txts": S.SUBTITLE}
#: Index rows of what is no packet are left out.
PACKETS = "^..(dc|db|wb)$"


def inspected(sources: DataFrame, max_bytes: int = S.MAX_SOURCE_BYTES, limits: S.Limits = S.LIMITS) -> DataFrame:
    """source_id, status, container_id, tracks (array) and rows: the index as an array of (name, key, size, place), place null where no chunk lies as the index says."""
    data, c = F.col("content"), F.col
    n = F.octet_length("content").cast("bigint")
    fits = F.coalesce((n > 0) & (n <= max_bytes), F.lit(False))
    own = sources.select(c("source_id").cast("string").alias("source_id"), F.when(fits, data).alias("content"), fits.alias("fits"))
    own = own.withColumn("end", 8 + read_le(data, 4, 4))
    named = (kind_at(data, F.lit(0)) == "RIFF") & (kind_at(data, F.lit(8)) == "AVI ") & (F.octet_length("content") >= 12) & (c("end") <= F.octet_length("content"))
    own = own.withColumn("is_avi", F.coalesce(named, F.lit(False)))
    own = own.withColumn("walk", F.when(c("is_avi") & (c("end") >= 12), chunks(data, _long(12), c("end"), ("LIST", "idx1"))))
    form = lambda b: F.when(b["kind"] == "LIST", F.when(b["end"] - b["at"] >= 4, kind_at(data, b["at"].cast("int")))).otherwise(b["kind"])
    own = own.withColumn("top", F.transform("walk.found", lambda b: F.struct(form(b).alias("key"), b["at"].alias("at"), b["end"].alias("end"))))
    of = lambda k: F.filter("top", lambda b: b["key"] == k)
    own = own.select("source_id", "content", "fits", "is_avi", (c("walk.ok") & F.forall(F.array(*map(F.lit, ("hdrl", "movi", "idx1"))), lambda k: F.size(F.filter("top", lambda b: b["key"] == k)) <= 1)).alias("ok"), *(F.get(of(k), F.lit(0)).alias(k) for k in ("hdrl", "movi", "idx1")))
    own = own.withColumn("head", F.when(c("ok") & c("hdrl").isNotNull() & c("movi").isNotNull(), chunks(data, c("hdrl.at") + 4, c("hdrl.end"), ("avih", "LIST"))))
    header = F.forall("head.found", lambda b: (b["kind"] != "avih") | (b["end"] - b["at"] >= 56))
    lists = F.filter("head.found", lambda b: (b["kind"] == "LIST") & (kind_at(data, b["at"].cast("int")) == "strl"))
    own = own.withColumns({"ok": F.coalesce(c("ok") & c("head.ok") & header & F.size(lists).between(1, limits.tracks), F.lit(False)), "lists": lists})
    own = own.withColumn("parts", F.when(c("ok"), F.transform("lists", lambda b: chunks(data, b["at"] + 4, b["end"], ("strh", "strf")))))

    def stream(p: Column) -> Column:
        found = p["found"]
        first = F.get(found, F.lit(0))
        at = first["at"].cast("int")
        kind = F.coalesce(*(F.when(kind_at(data, at) == k, F.lit(v)) for k, v in KINDS.items()), F.lit(S.UNKNOWN_TRACK))
        formats = F.filter(found, lambda b: b["kind"] == "strf")
        last = F.try_element_at(formats, F.lit(-1))
        at_last = last["at"].cast("int")
        room = lambda b: b["end"] - b["at"]
        sized = lambda b: (room(b) >= 40) & (signed(read_le(data, b["at"].cast("int") + 4, 4), 32) > 0) & (read_le(data, b["at"].cast("int") + 8, 4) != 0)
        video, audio = kind == S.VIDEO, kind == S.AUDIO
        good = p["ok"] & (first["kind"] == "strh") & (room(first) >= 48) & (F.size(F.filter(found, lambda b: b["kind"] == "strh")) == 1) & F.when(video, F.forall(formats, sized)).when(audio, F.forall(formats, lambda b: room(b) >= 16)).otherwise(True)
        tag = read_le(data, at_last, 2)
        code = F.when(video, read_be(data, at_last + 16, 4)).when(audio, tag)
        name = F.when(video, kind_at(data, at_last + 16)).otherwise(F.coalesce(*(F.when(tag == t, n) for t, n in AVI_TAG_NAMES.items()), F.lit(OTHER_NAME)))
        scale, length = read_le(data, at + 20, 4), read_le(data, at + 32, 4)
        usable = good & (video | audio) & (code > 0) & (scale > 0) & (audio | name.rlike("^[ -~]*$"))
        return F.struct(F.coalesce(usable, F.lit(False)).alias("usable"), kind.alias("kind"), code.alias("codec_id"), scale.alias("time_scale"), (length.cast("decimal(20,0)") * scale.cast("decimal(10,0)")).cast("decimal(20,0)").alias("duration_ticks"), name.alias("codec_name"))

    own = own.withColumn("streams", F.transform("parts", stream))
    entries = F.coalesce(c("idx1.end") - c("idx1.at"), F.lit(0))
    right = F.coalesce(c("ok") & F.forall("streams", lambda s: s["usable"]) & (entries % 16 == 0), F.lit(False))
    own = own.withColumns({"right": right, "entries": F.call_function("div", entries, F.lit(16))})

    def row(k: Column) -> Column:
        at = (c("idx1.at") + k * 16).cast("int")
        name, size, offset = kind_at(data, at), read_le(data, at + 12, 4), read_le(data, at + 8, 4)
        lies = lambda p: (p >= c("movi.at")) & (p + 8 + size <= c("movi.end")) & (kind_at(data, p.cast("int")) == name) & (read_le(data, p.cast("int") + 4, 4) == size)
        near = c("movi.at") + offset
        place = F.when(lies(near), near + 8).when(lies(offset), offset + 8)
        return F.struct(name.alias("name"), (read_le(data, at + 4, 4).bitwiseAND(0x10) != 0).alias("key"), size.alias("size"), place.alias("place"))

    rows = F.when(c("entries") > 0, F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), c("entries") - 1), row), lambda r: r["name"].rlike(PACKETS)))
    status = F.when(~c("fits"), S.INVALID).when(c("right"), S.OK).otherwise(S.UNSUPPORTED)
    tracks_ = F.transform("streams", lambda s, k: F.struct((k + 1).cast("bigint").alias("track_id"), s["kind"].alias("kind"), s["codec_id"].alias("codec_id"), s["time_scale"].alias("time_scale"), s["duration_ticks"].alias("duration_ticks"), s["codec_name"].alias("codec_name")))
    return own.select("source_id", _held(status).alias("status"), F.when(c("is_avi"), S.AVI).otherwise(0).alias("container_id"), _held(F.when(c("right"), tracks_)).alias("tracks"), _held(F.when(c("right"), rows)).alias("rows"))


def tracks(found: DataFrame) -> DataFrame:
    return found.where(F.col("status") == S.OK).select("source_id", "container_id", F.inline("tracks"))


def packets(found: DataFrame, limits: S.Limits = S.LIMITS) -> DataFrame:
    """PACKETS of the sources whose index holds; a stream's time advances by its scale a chunk."""
    c = F.col
    rows = found.where((c("status") == S.OK) & (F.size("rows") <= limits.packets)).select("source_id", "tracks", F.posexplode("rows").alias("n", "r"))
    numbered = F.when(c("r.name").rlike("^[0-9]{2}"), F.substring("r.name", 1, 2).cast("int"))
    audio = F.substring("r.name", 3, 2) == "wb"
    track = F.get("tracks", numbered)
    flat = rows.select("source_id", "n", track["track_id"].alias("track_id"), track["time_scale"].alias("scale"), (track["kind"] == F.when(audio, S.AUDIO).otherwise(S.VIDEO)).alias("same"), c("r.size").alias("size"), c("r.place").alias("place"), F.when(c("r.key") & ~audio, S.KEYFRAME).otherwise(0).alias("flags"))
    good = F.coalesce(c("same") & (c("size") > 0) & c("place").isNotNull(), F.lit(False))
    source = Window.partitionBy("source_id")
    before = F.row_number().over(Window.partitionBy("source_id", "track_id").orderBy("n")) - 1
    whole = flat.withColumns({"good": F.min(good.cast("int")).over(source), "ticks": (before * c("scale")).cast("decimal(20,0)")}).where("good = 1")
    seq = F.row_number().over(source.orderBy("place", "n")) - 1
    return whole.select("source_id", seq.alias("seq"), c("place").alias("byte_offset"), c("size").alias("byte_size"), "track_id", c("ticks").alias("timestamp_ticks"), c("scale").alias("duration_ticks"), "flags")
