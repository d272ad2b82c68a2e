"""MP4 files as relations by column expressions alone: the box tree, its tables, tracks and packets.

The headers of siblings are walked by a fold over the bytes of their span, and each level of the tree, eight at
most, is one column made from the containers of the level above; so a file is parsed within its own row,
where its bytes are, and only spans and the small sample tables leave it.  Tables become arrays of
fixed-width slices, runs are expanded by array functions, and one ``posexplode`` makes the samples; running
timestamps and offsets are windows over the samples of one file, which its size bounds.

A file that breaks a rule or a limit has no rows but its status.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import status as S
from ..functions.scalars import read_be, signed

DEPTH = 8
CONTAINERS = ("moov", "trak", "mdia", "minf", "stbl", "edts", "dinf", "udta")
#: Boxes that a track has once at most.
ONCE = ("tkhd", "mdhd", "hdlr", "stsd", "stts", "ctts", "stsc", "stsz", "stco", "co64", "stss")
NEEDED = ("tkhd", "mdhd", "hdlr", "stsd")
ROLES = {"soun": S.AUDIO, "vide": S.VIDEO, "subt": S.SUBTITLE, "text": S.SUBTITLE, "clcp": S.SUBTITLE}
#: Entries of a track's sample-to-chunk table at most.
GROUPS = 64
SPANS = "array<struct<kind: string, at: bigint, end: bigint>>"
BIG = 1 << 62


def _long(value: int | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("bigint")


def _held(c: Column) -> Column:
    """The column itself, which the optimizer leaves where it is: it would copy a long expression into each filter above it."""
    return F.when(F.spark_partition_id() >= 0, c)


def read_u64(data: Column, at: Column) -> Column:
    """Unsigned big-endian integer of eight bytes; values from 2**56 on, which no file has as a size, become 2**62."""
    return F.when(read_be(data, at, 1) > 0, _long(BIG)).otherwise(read_be(data, at + 1, 7))


def kind_at(data: Column, at: Column) -> Column:
    """The four characters of a box type, one a byte."""
    return F.decode(F.substring(data, at + 1, 4), "ISO-8859-1")


def name_at(data: Column, at: Column) -> Column:
    """The four bytes of a type as they are, to be compared with known ones only: cheaper than ``kind_at``."""
    return F.substring(data, at + 1, 4).cast("string")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is named: a lambda's variable."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def siblings(data: Column, at: Column, end: Column, wanted: tuple[str, ...]) -> Column:
    """(at, ok, found): where the walk over sibling boxes ended, whether all was well, and the bodies of the wanted types.

    A fold cannot stop early, so two nested ones of the square root of the greatest possible number of boxes take a
    step only while there is one to take.
    """
    kind = f"struct<at: bigint, ok: boolean, found: {SPANS}>"
    wide = F.sequence(F.lit(1), F.greatest(F.ceil(F.sqrt((end - at) / 8.0)).cast("int") + 1, F.lit(1)))
    begin = F.struct(_long(at).alias("at"), F.lit(True).alias("ok"), F.array().cast(SPANS).alias("found")).cast(kind)
    more = lambda s: s["ok"] & (s["at"] < end)

    def step(s: Column) -> Column:
        low = s["at"].cast("int")
        return let(F.struct(read_be(data, low, 4).alias("size32"), name_at(data, low + 4).alias("kind")), lambda h: sized(s, h))

    def sized(s: Column, h: Column) -> Column:
        big = h["size32"] == 1
        size, head = F.when(big, read_u64(data, s["at"].cast("int") + 8)).otherwise(h["size32"]), F.when(big, 16).otherwise(8)
        return let(F.struct(h["kind"].alias("kind"), (s["at"] + head).alias("at"), (s["at"] + size).alias("end")), lambda b: taken_in(s, b))

    def taken_in(s: Column, b: Column) -> Column:
        good = F.coalesce((b["at"] <= end) & (b["end"] >= b["at"]) & (b["end"] <= end), F.lit(False))
        found = F.when(good & b["kind"].isin(*wanted), F.array_append(s["found"], b)).otherwise(s["found"])
        return F.struct(F.when(good, b["end"]).otherwise(s["at"]).alias("at"), good.alias("ok"), found.alias("found"))

    taken = lambda s, inner: F.when(more(s), inner(s)).otherwise(s)
    one = lambda s: F.aggregate(wide, s, lambda t, _: taken(t, step))
    return F.aggregate(wide, begin, lambda t, _: taken(t, one))


TREE = "array<struct<track: int, kind: string, at: bigint, end: bigint>>"


def inspected(sources: DataFrame, max_bytes: int = S.MAX_SOURCE_BYTES, limits: S.Limits = S.LIMITS) -> DataFrame:
    """source_id, status, container_id, n_bytes and tracks: an array of the track columns and the bodies of its sample tables; one row a source."""
    data, size = F.col("content"), F.octet_length("content").cast("bigint")
    fits = F.coalesce((size > 0) & (size <= max_bytes), F.lit(False))
    own = sources.select(F.col("source_id").cast("string").alias("source_id"), F.when(fits, data).alias("content"), fits.alias("fits"))
    own = own.withColumn("n_bytes", F.coalesce(F.octet_length("content").cast("bigint"), F.lit(0)))
    own = own.withColumn("top", F.when(F.col("fits"), siblings(data, _long(0), F.col("n_bytes"), ("ftyp", "moov"))))
    one = lambda name: F.filter("top.found", lambda b: b["kind"] == name)
    # the type comes first: its body begins behind its own header, at the very start of the file
    whole = F.col("top.ok") & (F.size(one("ftyp")) == 1) & (F.size(one("moov")) == 1) & (kind_at(data, F.lit(4)) == "ftyp")
    own = own.withColumns({"is_mp4": F.coalesce(F.size(one("ftyp")) > 0, F.lit(False)), "moov": F.when(whole, F.get(one("moov"), F.lit(0)))})
    own = own.withColumn("inner", F.when(F.col("moov").isNotNull(), siblings(data, F.col("moov.at"), F.col("moov.end"), ("trak",))))
    roots = F.transform("inner.found", lambda b, i: F.struct(i.alias("track"), b["kind"].alias("kind"), b["at"].alias("at"), b["end"].alias("end")))
    fine = F.coalesce(F.col("inner.ok") & F.size("inner.found").between(1, limits.tracks), F.lit(False))
    own = own.withColumns({"level": F.when(fine, roots).otherwise(F.array()).cast(TREE), "leaves": F.array().cast(TREE), "ok": fine}).drop("top", "moov", "inner")
    for _ in range(DEPTH + 1):
        below = F.transform("level", lambda c: F.struct(c["track"].alias("track"), siblings(data, c["at"], c["end"], (*CONTAINERS, *ONCE)).alias("in")))
        flat = lambda kinds: F.flatten(F.transform("below", lambda c: F.transform(F.filter(c["in"]["found"], lambda b: b["kind"].isin(*kinds)), lambda b: F.struct(c["track"].alias("track"), b["kind"].alias("kind"), b["at"].alias("at"), b["end"].alias("end"))))).cast(TREE)
        own = own.select("source_id", "content", "fits", "n_bytes", "is_mp4", "ok", "leaves", below.alias("below"))
        own = own.select("source_id", "content", "fits", "n_bytes", "is_mp4", (F.col("ok") & F.forall("below", lambda c: c["in"]["ok"])).alias("ok"), flat(CONTAINERS).alias("level"), F.concat("leaves", flat(ONCE)).alias("leaves"))
    own = own.withColumn("ok", F.col("ok") & (F.size("level") == 0))  # deeper than allowed
    named = F.transform("leaves", lambda b: F.struct(b["track"].alias("track"), b["kind"].alias("kind")))
    own = own.withColumn("ok", F.col("ok") & (F.size(F.array_distinct(named)) == F.size("leaves")))
    n_tracks = F.coalesce(F.array_max(F.transform("leaves", lambda b: b["track"])) + 1, F.lit(0))
    mine = lambda t: F.map_from_entries(F.transform(F.filter("leaves", lambda b: b["track"] == t), lambda b: F.struct(b["kind"], F.struct(b["at"].alias("at"), b["end"].alias("end")))))
    maps = F.when(F.col("ok") & (n_tracks > 0), F.transform(F.sequence(F.lit(0), n_tracks - 1), mine))
    own = own.withColumns({"maps": maps, "n_tracks": n_tracks}).drop("level", "leaves")

    def track(m: Column) -> Column:
        at = lambda k: m[k]["at"].cast("int")
        n = lambda k: (m[k]["end"] - m[k]["at"]).cast("int")
        head = F.when(read_be(data, at("tkhd"), 1) > 0, 20).otherwise(12)
        wide = read_be(data, at("mdhd"), 1) > 0
        code = F.substring(data, at("stsd") + 13, 4)
        top = read_be(data, at("mdhd") + 24, 1)
        # a duration may have all 64 bits
        duration = F.when(wide, top.cast("decimal(20,0)") * F.lit(1 << 56).cast("decimal(20,0)") + read_be(data, at("mdhd") + 25, 7)).otherwise(read_be(data, at("mdhd") + 16, 4)).cast("decimal(20,0)")
        handler = kind_at(data, at("hdlr") + 8)
        role = F.coalesce(*(F.when(handler == k, F.lit(v)) for k, v in ROLES.items()), F.lit(S.UNKNOWN_TRACK))
        inside = F.lit(True)
        for k, need in (("tkhd", head + 4), ("mdhd", F.when(wide, 32).otherwise(20)), ("hdlr", F.lit(12))):
            inside &= m[k]["at"] + need <= F.col("n_bytes")
        fields = {
            "track_id": read_be(data, at("tkhd") + head, 4), "kind": role, "codec_id": read_be(code, F.lit(0), 4), "time_scale": read_be(data, F.when(wide, at("mdhd") + 20).otherwise(at("mdhd") + 12), 4),
            "duration_ticks": duration, "codec_name": F.decode(code, "ISO-8859-1"), "entries": read_be(data, at("stsd") + 4, 4), "room": n("stsd"), "inside": inside & F.array_contains(F.map_keys(m), "stsd"),
        }
        tables = {k: F.when(m[k].isNotNull(), F.substring(data, at(k) + 1, n(k))) for k in ("stts", "ctts", "stsc", "stsz", "stco", "co64", "stss")}
        return F.struct(*(c.alias(k) for k, c in (fields | tables).items()))

    complete = F.forall("maps", lambda m: F.forall(F.array(*map(F.lit, NEEDED)), lambda k: F.array_contains(F.map_keys(m), k)))
    own = own.withColumn("tracks", F.when(F.coalesce(complete, F.lit(False)) & (F.size("maps") == F.col("n_tracks")), F.transform("maps", track)))
    valid = F.forall("tracks", lambda t: F.coalesce(t["inside"] & (t["entries"] == 1) & (t["room"] >= 16) & ~F.contains(t["codec_name"], F.lit("\0")) & (t["track_id"] > 0) & (t["time_scale"] > 0), F.lit(False)))
    ids = F.transform("tracks", lambda t: t["track_id"])
    own = own.withColumn("ok", F.coalesce(F.col("ok") & valid & (F.size(F.array_distinct(ids)) == F.size("tracks")), F.lit(False)))
    status = F.when(~F.col("fits"), S.INVALID).when(F.col("ok"), S.OK).otherwise(S.UNSUPPORTED)
    container = F.when(F.col("is_mp4"), S.MP4).otherwise(0)
    return own.select("source_id", _held(status).alias("status"), container.alias("container_id"), "n_bytes", _held(F.when(F.col("ok"), F.col("tracks"))).alias("tracks"))


def tracks(found: DataFrame) -> DataFrame:
    """TRACKS of the inspected sources."""
    rows = found.where(F.col("status") == S.OK).select("source_id", "container_id", F.inline("tracks"))
    return rows.select("source_id", "container_id", "track_id", "kind", "codec_id", "time_scale", "duration_ticks", "codec_name")


def _entries(table: Column, width: int, skip: int = 8) -> Column:
    """The number of entries of a table whose count stands before ``skip``; null if they do not fit."""
    n = read_be(table, F.lit(skip - 4), 4)
    return F.when(F.octet_length(table) >= skip, F.when(n * width + skip <= F.octet_length(table), n))


def _column(table: Column, n: Column, width: int, at: int, skip: int = 8, size: int = 4) -> Column:
    """One field of each entry."""
    read = (lambda p: read_u64(table, p)) if size == 8 else (lambda p: read_be(table, p, 4))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: read(k * width + skip + at)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)


def _repeated(counts: Column, values: Column, most: int) -> Column:
    """Run-length entries as an array; null if there are more values than ``most``."""
    each = F.zip_with(counts, values, lambda n, v: F.array_repeat(v, n.cast("int")))
    return F.when(_total(counts) <= most, F.flatten(each))


def samples(found: DataFrame, limits: S.Limits = S.LIMITS) -> DataFrame:
    """(source_id, n_bytes, order, track_id, k, size, delta, shift, key, chunk, chunk_offset) of all tracks, or one row with k null for a track whose tables do not agree."""
    t = found.where(F.col("status") == S.OK).select("source_id", "n_bytes", F.posexplode("tracks").alias("order", "t")).select("source_id", "n_bytes", "order", "t.*")
    most = limits.packets
    c = F.col
    t = t.withColumns({
        "n": F.when(F.octet_length("stsz") >= 12, read_be(c("stsz"), F.lit(8), 4)), "fixed": read_be(c("stsz"), F.lit(4), 4),
        "n_stts": _entries(c("stts"), 8), "n_ctts": _entries(c("ctts"), 8), "n_stsc": _entries(c("stsc"), 12), "n_stss": _entries(c("stss"), 4),
        "n_chunks": F.coalesce(_entries(c("stco"), 4), _entries(c("co64"), 8)),
    })
    present = c("n_stts").isNotNull() & c("n_stsc").between(1, GROUPS) & c("n_chunks").isNotNull() & (c("stco").isNull() | c("co64").isNull()) & (c("ctts").isNull() | c("n_ctts").isNotNull()) & (c("stss").isNull() | c("n_stss").isNotNull())
    fits = (c("n") <= most) & ((c("fixed") > 0) | (c("n") * 4 + 12 <= F.octet_length("stsz")))
    t = t.withColumn("fine", F.coalesce(present & fits, F.lit(False)))
    shift = F.transform(_column(c("ctts"), c("n_ctts"), 8, 4), lambda v: F.when(read_be(c("ctts"), F.lit(0), 1) > 0, signed(v, 32)).otherwise(v))
    t = t.withColumns({
        "sizes": F.when(c("fixed") > 0, F.array_repeat(c("fixed"), c("n").cast("int"))).otherwise(_column(c("stsz"), c("n"), 4, 0, 12)),
        "deltas": _repeated(_column(c("stts"), c("n_stts"), 8, 0), _column(c("stts"), c("n_stts"), 8, 4), most),
        "shifts": F.when(c("ctts").isNull(), F.array_repeat(F.lit(0).cast("bigint"), c("n").cast("int"))).otherwise(_repeated(_column(c("ctts"), c("n_ctts"), 8, 0), shift, most)),
        "first": _column(c("stsc"), c("n_stsc"), 12, 0), "each": _column(c("stsc"), c("n_stsc"), 12, 4), "described": _column(c("stsc"), c("n_stsc"), 12, 8),
        "offsets": F.when(c("stco").isNotNull(), _column(c("stco"), c("n_chunks"), 4, 0)).otherwise(_column(c("co64"), c("n_chunks"), 8, 0, 8, 8)),
        "marked": F.array_sort(F.array_distinct(F.filter(_column(c("stss"), c("n_stss"), 4, 0), lambda k: k.between(1, c("n"))))),
    })
    ends = F.concat(F.slice("first", F.lit(2), F.greatest(F.size("first") - 1, F.lit(0))), F.array(c("n_chunks") + 1))
    held = F.zip_with("first", ends, lambda a, b: F.greatest(F.least(b, c("n_chunks") + 1) - a, F.lit(0)))
    ascending = F.forall(F.zip_with("first", F.concat(F.array(F.lit(0).cast("bigint")), F.slice("first", F.lit(1), F.greatest(F.size("first") - 1, F.lit(0)))), lambda a, b: a > b), lambda x: x)
    grouped = (F.get("first", F.lit(0)) == 1) & ascending & F.forall("each", lambda x: x > 0) & F.forall("described", lambda x: x == 1)
    t = t.withColumn("fine", F.coalesce(c("fine") & grouped & (F.size("deltas") == c("n")) & (F.size("shifts") == c("n")), F.lit(False)))
    # samples of a chunk are at most ``most``; their sum is compared before anything is repeated
    many = F.aggregate(F.zip_with(held, "each", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, v: a + v)
    t = t.withColumn("fine", c("fine") & (many == c("n")))
    per_chunk = F.when(c("fine"), F.flatten(F.zip_with(held, "each", lambda a, b: F.array_repeat(b, a.cast("int")))))
    t = t.withColumn("per_chunk", per_chunk)
    places = F.flatten(F.transform("per_chunk", lambda m, i: F.array_repeat(F.struct(i.alias("chunk"), F.get("offsets", i).alias("chunk_offset")), m.cast("int"))))
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice("marked", F.lit(1), F.greatest(F.size("marked") - 1, F.lit(0))))
    runs = F.zip_with("marked", before, lambda a, b: F.when(a.isNotNull(), F.concat(F.array_repeat(F.lit(0), (a - b - 1).cast("int")), F.array(F.lit(S.KEYFRAME)))).otherwise(F.array().cast("array<int>")))
    keys = F.when(c("stss").isNull(), F.array_repeat(F.lit(S.KEYFRAME), c("n").cast("int"))).otherwise(F.slice(F.concat(F.flatten(runs), F.array_repeat(F.lit(0), c("n").cast("int"))), F.lit(1), F.greatest(c("n").cast("int"), F.lit(0))))
    t = t.withColumns({"places": F.when(c("fine"), places), "keys": F.when(c("fine"), keys)})
    rows = F.arrays_zip(*(F.col(k) for k in ("sizes", "deltas", "shifts", "keys", "places")))
    none = F.array(F.lit(None).cast("struct<sizes: bigint, deltas: bigint, shifts: bigint, keys: int, places: struct<chunk: int, chunk_offset: bigint>>"))
    t = t.select("source_id", "n_bytes", "order", "track_id", _held(F.when(c("fine"), rows).otherwise(none)).alias("all"))
    t = t.select("source_id", "n_bytes", "order", "track_id", F.posexplode("all").alias("k", "s"))
    return t.select("source_id", "n_bytes", "order", "track_id", F.when(c("s.sizes").isNotNull(), c("k")).alias("k"), c("s.sizes").alias("size"), c("s.deltas").alias("delta"), c("s.shifts").alias("shift"), c("s.keys").alias("flags"), c("s.places.chunk").alias("chunk"), c("s.places.chunk_offset").alias("chunk_offset"))


def packets(found: DataFrame, limits: S.Limits = S.LIMITS) -> DataFrame:
    """PACKETS of the inspected sources whose tables hold; all of a source's or none."""
    rows = samples(found, limits)
    track = Window.partitionBy("source_id", "order")
    along = track.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("source_id", "order", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({
        "timestamp_ticks": (F.coalesce(F.sum("delta").over(along), F.lit(0)) + F.col("shift")).cast("decimal(20,0)"),
        "byte_offset": F.col("chunk_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)),
    })
    good = F.coalesce((F.col("delta") > 0) & (F.col("size") > 0) & (F.col("byte_offset") + F.col("size") <= F.col("n_bytes")) & (F.col("timestamp_ticks") >= 0), F.lit(False))
    source = Window.partitionBy("source_id")
    whole = placed.withColumns({"_good": F.min(good.cast("int")).over(source), "_n": F.count("*").over(source)}).where((F.col("_good") == 1) & (F.col("_n") <= limits.packets))
    seq = F.row_number().over(source.orderBy("byte_offset", "order", "k")) - 1
    return whole.select("source_id", seq.alias("seq"), "byte_offset", F.col("size").alias("byte_size"), "track_id", "timestamp_ticks", F.col("delta").alias("duration_ticks"), "flags")


def statuses(found: DataFrame, rows: DataFrame) -> DataFrame:
    """STATUS of the index: of ``packets(found)``, one row a source."""
    held = rows.select("source_id").distinct().withColumn("_held", F.lit(True))
    code = F.when(F.col("status") != S.OK, F.col("status")).when(F.col("_held"), S.OK).otherwise(S.UNSUPPORTED)
    return found.select("source_id", "status").join(held, "source_id", "left").select("source_id", F.lit("index").alias("stage"), code.alias("code"))


# --- writing, for files made from tables ---


def be(value: Column, n: int = 4) -> Column:
    """A number as big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * n, "0"))


def box(kind: str, body: Column) -> Column:
    """A box around a body, which should be a column of its own: it is named twice."""
    return F.concat(be(F.octet_length(body) + 8), F.lit(kind.encode()), body)


def rows_of(values: Column, *fields) -> Column:  # noqa: ANN002
    """A table behind its version: the number of entries, and for each value the fields that functions make of it and its index."""
    entry = lambda v, i: F.concat(*(F.lpad(F.hex(f(v, i).cast("bigint")), 8, "0") for f in fields))
    return F.concat(F.lit(bytes(4)), be(F.size(values)), F.unhex(F.array_join(F.transform(values, entry), "")))


def mp4_files(rows: DataFrame, source: str, sizes: str, deltas: str, per_chunk: int, key_every: int, codec: str = "mp4a", handler: str = "soun", scale: int = 1000) -> DataFrame:
    """(source_id, content): a file a row with one track of zero bytes, whose samples have the ``sizes`` and ``deltas`` of two arrays,
    lie in chunks of ``per_chunk``, and are keys ``key_every`` so many."""
    one = lambda v, i: F.lit(1)
    z, n = F.col("z"), F.size("z")
    own = rows.select(F.col(source).cast("string").alias("source_id"), F.col(sizes).cast("array<bigint>").alias("z"), F.col(deltas).cast("array<bigint>").alias("d"))
    offset = lambda v, i: F.lit(28) + _total(F.slice(z, F.lit(1), v * per_chunk))
    whole, rest = F.floor(n / per_chunk), n % per_chunk
    groups = F.concat(F.when(whole > 0, F.array(F.array(F.lit(1).cast("bigint"), F.lit(per_chunk).cast("bigint")))).otherwise(F.array()), F.when(rest > 0, F.array(F.array(whole + 1, rest.cast("bigint")))).otherwise(F.array()))
    own = own.withColumns({
        "stsd": F.concat(F.lit(bytes(4)), be(F.lit(1)), box(codec, F.lit(bytes(28)))),
        "stts": rows_of(F.col("d"), one, lambda v, i: v),
        "stsc": rows_of(groups, lambda v, i: v[0], lambda v, i: v[1], one),
        "stsz": F.concat(F.lit(bytes(4)), rows_of(z, lambda v, i: v)),
        "stco": rows_of(F.sequence(F.lit(0), F.ceil(n / per_chunk).cast("int") - 1), offset),
        "stss": rows_of(F.filter(F.sequence(F.lit(1), n), lambda k: (k - 1) % key_every == 0), lambda v, i: v),
        "mdhd": F.concat(F.lit(bytes(12)), be(F.lit(scale)), be(_total(F.col("d"))), F.lit(bytes(4))),
        "hdlr": F.concat(F.lit(bytes(8)), F.lit(handler.encode()), F.lit(bytes(13))),
        "tkhd": F.concat(F.lit(bytes(12)), be(F.lit(1)), F.lit(bytes(68))),
        "mdat": F.unhex(F.repeat(F.lit("00"), _total(z).cast("int"))),
    })
    # a level at a time, so that each body is a column
    for outer, inner in (("stbl", ("stsd", "stts", "stsc", "stsz", "stco", "stss")), ("minf", ("stbl",)), ("mdia", ("mdhd", "hdlr", "minf")), ("trak", ("tkhd", "mdia")), ("moov", ("trak",))):
        own = own.withColumn(outer, F.concat(*(box(k, F.col(k)) for k in inner)))
    head = F.lit(b"\0\0\0\x14ftypisom\0\0\0\0isom")
    return own.select("source_id", F.concat(head, box("mdat", F.col("mdat")), box("moov", F.col("moov"))).alias("content"))
