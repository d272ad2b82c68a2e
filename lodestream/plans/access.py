"""Queries of access to files: reads by position, selection of tracks at the source, seeking, long streams, checksums; and of conversion.

Files are made from the driver's tables, written to the shared folder by the library's own sink, and removed when the
query's rows are in a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import status as S
from ..functions import checksums, samples, scalars
from ..operators import frames, resample, seeking, timeline
from ..sources import datasource, longstreams, positional, store
from ..streaming import pump
from .queries import MAKERS, blobs, longs, query, table

#: Documents a file of q53, bytes of a packet, and where packets that no file has begin.
DOCS_A_FILE, HEAD = 64, 200


def written(spark: SparkSession, sources: DataFrame, label: str) -> str:
    """The folder into which (source_id, content) went as files named by source_id."""
    folder = store.shared_folder(spark, label)
    datasource.register(spark)
    sources.write.format("media_files").option("path", folder).mode("append").save()
    return folder


@query(f"""
WITH d AS (SELECT doc_id, doc_id // {DOCS_A_FILE} AS f, upper(hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (SELECT doc_id, f, h, CAST(coalesce(sum(length(h) // 2) OVER (PARTITION BY f ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS low, length(h) // 2 AS n FROM d)
SELECT f AS file, doc_id AS seq, low AS byte_offset, CAST(CASE WHEN n = 0 THEN -1 ELSE 0 END AS BIGINT) AS packet_status, CASE WHEN n > 0 THEN md5(substr(h, 1, 2 * least(n, {HEAD}))) END AS payload_md5 FROM p
UNION ALL SELECT f, CAST(-1 AS BIGINT), CAST(sum(n) AS BIGINT) - 1, CAST(-5 AS BIGINT), NULL FROM p GROUP BY f
UNION ALL SELECT f, CAST(-2 AS BIGINT), CAST(sum(n) AS BIGINT), CAST(-4 AS BIGINT), NULL FROM p GROUP BY f""")
def q53_positional_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bytes of each document, read by position from files of 64 documents each; and packets beyond the end of a file and of files that are not there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.call_function("div", F.col("doc_id"), F.lit(DOCS_A_FILE)).alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    name = F.format_string("file-%012d.bin", "file")
    files = docs.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("all"))
    folder = written(spark, files.select(name.alias("source_id"), F.encode(F.array_join(F.col("all.text"), ""), "utf-8").alias("content")), "q53")
    size = F.octet_length("text").cast("bigint")
    placed = timeline.running(docs, "file", ["doc_id"], {"byte_offset": size}).select("file", F.col("doc_id").alias("seq"), "byte_offset", F.least(size, F.lit(HEAD)).alias("byte_size"))
    ends = docs.groupBy("file").agg(F.sum(size).alias("end"))
    odd = ends.select("file", F.inline(F.array(F.struct(F.lit(-1).cast("bigint").alias("seq"), (F.col("end") - 1).alias("byte_offset"), F.lit(2).cast("bigint").alias("byte_size")), F.struct(F.lit(-2).cast("bigint").alias("seq"), F.col("end").alias("byte_offset"), F.lit(1).cast("bigint").alias("byte_size")))))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", "file-([0-9]+)[.]bin$", 1).cast("bigint").alias("file"), "path")
    packets = placed.unionByName(odd).join(listed, "file").withColumn("source_id", F.when(F.col("seq") == -2, F.concat("path", F.lit(".none"))).otherwise(F.col("path")))
    got = positional.read_packets(packets.drop("path"))
    kept = longs(got.select("file", "seq", "byte_offset", "packet_status", F.md5(F.hex("payload").cast("binary")).alias("payload_md5")), "packet_status").checkpoint()
    store.remove(folder)
    return kept


@query(f"""
WITH l AS (SELECT l_partkey // 8 AS f, CAST(trunc(l_quantity) AS BIGINT) AS q, l_orderkey, l_linenumber, row_number() OVER w AS r FROM lineitem WINDOW w AS (PARTITION BY l_partkey // 8 ORDER BY l_orderkey, l_linenumber, trunc(l_quantity))),
n AS (SELECT f, r - 1 AS seq, q, CAST(coalesce(sum(q) OVER (PARTITION BY f ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM l WHERE f % 3 = 0)
SELECT f AS file, CAST(seq AS BIGINT) AS seq, q AS byte_size, before AS timestamp_ticks, CAST(1836069985 AS BIGINT) AS codec_id FROM n WHERE before >= 500""")
def q55_track_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of MP4, WebM and AVI files of eight parts each, the packets of audio tracks from tick 500 on, chosen in the reader."""
    line = F.struct("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.call_function("div", F.col("l_partkey"), F.lit(8)).alias("f")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    sized = grouped.select(F.format_string("%012d.bin", "f").alias("name"), (F.col("f") % 3).alias("kind"), F.col("lines.q").alias("sizes"))
    sources = None
    for k, kind in enumerate(("mp4", "webm", "avi")):
        made = blobs(sized.where(F.col("kind") == k), MAKERS[kind], "name")
        sources = made if sources is None else sources.unionByName(made)
    folder = written(spark, sources, "q55")
    found = spark.read.format("media").option("relation", "track_packets").option("maxPackets", 1_000_000).load(folder).where((F.col("kind") == S.AUDIO) & (F.col("timestamp_ticks") >= 500))
    file = F.regexp_extract("source_id", "([0-9]+)[.]bin$", 1).cast("bigint")
    kept = longs(found.select(file.alias("file"), "seq", "byte_size", "timestamp_ticks", "codec_id"), "seq", "timestamp_ticks").checkpoint()
    store.remove(folder)
    return kept


@query("""
WITH l AS (SELECT l_suppkey AS s, l_linenumber % 2 AS t, (l_orderkey * 10 + l_linenumber) * 100 + CAST(trunc(l_quantity) AS BIGINT) AS pos, CAST(trunc(l_quantity) AS BIGINT) AS q FROM lineitem),
p AS (SELECT s, t, q, row_number() OVER (PARTITION BY s, t ORDER BY pos) - 1 AS n, CAST(coalesce(sum(q) OVER (PARTITION BY s, t ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ts FROM l),
k AS (SELECT s, t, ts, max(n) AS n FROM p WHERE q % 16 = 1 GROUP BY s, t, ts), m AS (SELECT s, t, ts, max(n) AS n FROM p GROUP BY s, t, ts),
r AS (SELECT o_orderkey, o_custkey % 100 + 1 AS s, o_orderkey % 2 AS t, (CAST(trunc(o_totalprice) AS BIGINT) * 90 + 500) // 1000 AS ticks FROM orders)
SELECT r.o_orderkey, r.s AS source, r.t AS track, r.ticks, CAST(CASE WHEN k.ts IS NULL THEN -2 ELSE 0 END AS BIGINT) AS seek_status, CAST(coalesce(k.n, -1) AS BIGINT) AS start_packet, coalesce(k.ts, -1) AS start_ticks, CAST(coalesce(m.n - k.n, -1) AS BIGINT) AS discard_packets, coalesce(r.ticks - k.ts, -1) AS discard_ticks
FROM r ASOF LEFT JOIN k ON r.s = k.s AND r.t = k.t AND r.ticks >= k.ts ASOF LEFT JOIN m ON r.s = m.s AND r.t = m.t AND r.ticks >= m.ts""")
def q54_backward_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position asked for by each order, in a supplier's two tracks of lines: the key packet to start from, and what to throw away."""
    line = table(spark, sf_dir, "lineitem")
    own = line.select(F.col("l_suppkey").alias("source"), (F.col("l_linenumber") % 2).cast("bigint").alias("track"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("bigint")).alias("pos"), F.col("l_quantity").cast("bigint").alias("q"))
    packets = timeline.running(own.withColumn("of", F.col("source") * 2 + F.col("track")), "of", ["pos"], {"ts": F.col("q"), "n": F.lit(1).cast("bigint")})
    o = table(spark, sf_dir, "orders")
    asked = o.select("o_orderkey", (F.col("o_custkey") % 100 + 1).alias("source"), (F.col("o_orderkey") % 2).cast("bigint").alias("track"), F.col("o_totalprice").cast("bigint").alias("ms"), F.lit(90).alias("scale"))
    got = seeking.seek(asked, packets, "ms", "scale", ["o_orderkey"], ["source", "track"], "ts", "n", F.col("q") % 16 == 1)
    shown = {"start_packet": F.col("start.n"), "start_ticks": F.col("start.time"), "discard_packets": F.col("discard_packets"), "discard_ticks": F.col("discard_ticks")}
    return longs(got.select("o_orderkey", "source", "track", "ticks", "seek_status", *(F.coalesce(c, F.lit(-1)).alias(k) for k, c in shown.items())), "seek_status", "source")


#: Bytes of text in a frame of q56.
FRAME = 1000


def adts_frame(payload: str) -> str:
    """SQL of one frame (AAC LC, 44,100 Hz, two channels) around a binary expression, as hex digits: a header of 56 bits and the payload."""
    size = f"(octet_length({payload}) + 7)"
    return f"concat('FFF1', lpad(hex(({322 << 30}L | shiftleft(CAST({size} AS BIGINT), 13) | {0x7FF << 2}L)), 10, '0'), hex({payload}))"


@query(f"""
WITH d AS (SELECT doc_id, doc_id // {DOCS_A_FILE} AS f, strlen(coalesce(text, '')) AS n FROM documents),
k AS (SELECT f, doc_id, k, least({FRAME}, n - {FRAME} * k) + 7 AS size FROM d, unnest(range((n + {FRAME - 1}) // {FRAME})) AS u(k))
SELECT f AS file, row_number() OVER w - 1 AS seq, CAST(coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset, size AS byte_size, (row_number() OVER w - 1) * 1024 AS timestamp_ticks
FROM k WINDOW w AS (PARTITION BY f ORDER BY doc_id, k)""")
def q56_long_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as AAC frames, 64 documents a stream: frames found by many tasks, each from its own piece of a file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.call_function("div", F.col("doc_id"), F.lit(DOCS_A_FILE)).alias("file"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("body"))
    cut = F.expr(f"transform(sequence(0, greatest(div(octet_length(body) - 1, {FRAME}), 0)), k -> substring(body, CAST(k * {FRAME} + 1 AS INT), {FRAME}))")
    framed = docs.select("file", "doc_id", F.when(F.octet_length("body") > 0, cut).otherwise(F.array()).alias("parts"))
    made = framed.select("file", "doc_id", F.expr(f"array_join(transform(parts, p -> {adts_frame('p')}), '')").alias("hex"))
    files = made.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("doc_id", "hex"))).alias("all"))
    folder = written(spark, files.select(F.format_string("file-%012d.aac", "file").alias("source_id"), F.unhex(F.array_join(F.col("all.hex"), "")).alias("content")), "q56")
    found, _ = longstreams.adts_index(spark, folder, piece=1 << 16)
    file = F.regexp_extract("source_id", "file-([0-9]+)[.]aac$", 1).cast("bigint")
    kept = found.select(file.alias("file"), "seq", "byte_offset", "byte_size", "timestamp_ticks").checkpoint()
    store.remove(folder)
    return kept


#: Pages of q57's spans.
PAGES_A_SPAN = 50


def _crc_sql(kind: checksums.Kind) -> str:
    register = [f"{int(x)}::BIGINT" for x in checksums._table(kind)]
    return f"list_reduce(list_prepend(0::BIGINT, bytes), lambda c, b: xor([{', '.join(register)}][(xor(c >> {kind.bits - 8}, b) & 255) + 1], (c << 8) & {kind.mask}))"


@query(f"""
WITH s AS (SELECT page_id // {PAGES_A_SPAN} AS span, string_agg(url, '' ORDER BY page_id, url) AS t FROM pages WHERE url IS NOT NULL GROUP BY 1),
b AS (SELECT span, [strpos('123456789ABCDEF', substr(hex(encode(t)), 2 * k + 1, 1))::BIGINT * 16 + strpos('123456789ABCDEF', substr(hex(encode(t)), 2 * k + 2, 1)) FOR k IN range(strlen(t))] AS bytes FROM s)
SELECT span, len(bytes)::BIGINT AS n_bytes, {_crc_sql(checksums.OGG)} AS crc32, {_crc_sql(checksums.FLAC16)} AS crc16 FROM b""")
def q57_span_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of the addresses of fifty pages each, one after the other, from shares computed address by address."""
    p = table(spark, sf_dir, "pages").where("url is not null").select(F.call_function("div", F.col("page_id"), F.lit(PAGES_A_SPAN)).alias("span"), "page_id", F.encode("url", "utf-8").alias("body"))
    placed = timeline.running(p, "span", ["page_id", "body"], {"at": F.octet_length("body").cast("bigint")}).select("span", "at", "body")
    one, two = (checksums.checksums(placed, k, ["span"], "at", "body").withColumnRenamed("crc", n) for k, n in ((checksums.OGG, "crc32"), (checksums.FLAC16, "crc16")))
    return one.join(two.drop("n_bytes"), "span")


#: Bytes of a frame of q58.
PUMPED = 256


@query(f"""
WITH d AS (SELECT coalesce(lang, '-') AS source_id, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT source_id, hex(encode(string_agg(t, '' ORDER BY doc_id))) AS h FROM d GROUP BY source_id),
f AS (SELECT source_id, unnest(range((length(h) // 2 + {PUMPED - 1}) // {PUMPED})) AS k, h FROM s)
SELECT source_id, k AS frame_index, CAST(least({PUMPED}, length(h) // 2 - {PUMPED} * k) AS BIGINT) AS n_samples, md5(substr(h, {2 * PUMPED} * k + 1, {2 * PUMPED})) AS samples_md5, CAST(0 AS BIGINT) AS last FROM f
UNION ALL SELECT source_id, (length(h) // 2 + {PUMPED - 1}) // {PUMPED}, CAST(0 AS BIGINT), '', CAST(1 AS BIGINT) FROM s""")
def q58_pump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as packets of a language's stream, to frames of 256 bytes and a row that says a stream is drained."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("-")).alias("source_id"), "doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("samples"))
    large = timeline.large_sources(docs.select("source_id"), "source_id", pump.ROWS)
    packets = timeline.running(docs, "source_id", ["doc_id"], {"seq": F.lit(1).cast("bigint")}, large=large)
    got = pump.pumped(packets, PUMPED, 1, large=large)
    digest = F.when(F.col("samples").isNull(), "").otherwise(F.md5(F.hex("samples").cast("binary")))
    return longs(got.select("source_id", "frame_index", "n_samples", digest.alias("samples_md5"), "last"), "n_samples", "last")


@query("""
WITH w AS (SELECT CAST(vec_id AS VARCHAR) AS source_id, pos - 1 AS frame, trunc(greatest(least(x, 1::FLOAT), -1::FLOAT) * 32767::FLOAT)::DOUBLE AS value
FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings)),
n AS (SELECT source_id, max(frame) + 1 AS n FROM w GROUP BY source_id), o AS (SELECT source_id, n, unnest(range((n * 11025 + 7999) // 8000)) AS j FROM n),
p AS (SELECT source_id, n, j, j * 8000 // 11025 + unnest(range(-16, 17)) AS k FROM o),
h AS (SELECT *, j * 8000 / 11025.0::DOUBLE - k AS u FROM p),
g AS (SELECT source_id, j, k, CASE WHEN abs(u) >= 16 THEN 0 WHEN u = 0 THEN 1 ELSE sin(pi() * u) / (pi() * u) * (1 + cos(pi() * u / 16)) / 2 END AS weight FROM h)
SELECT g.source_id, j AS frame, CAST(round(greatest(-32768, least(32767, sum(weight * coalesce(value, 0)) / sum(weight)))) AS BIGINT) AS value FROM g LEFT JOIN w ON g.source_id = w.source_id AND g.k = w.frame GROUP BY g.source_id, j""")
def q59_resample_sinc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as samples of 8,000 Hz, brought to 11,025 Hz by the windowed sinc."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("source_id"), F.posexplode("embedding").alias("pos", "x"))
    own = e.select("source_id", F.col("pos").cast("bigint").alias("frame"), F.lit(0).alias("channel"), samples.f32(F.col("x")).cast("int").alias("value"))
    return longs(resample.resampled(own, 8000, 11_025).select("source_id", "frame", "value"), "value")


@query("""
WITH f AS (SELECT vec_id, [CAST(floor(abs(x) * 1000) AS BIGINT) % 256 FOR x IN embedding] AS v FROM embeddings),
p AS (SELECT vec_id, k, v[k + 1] - 16 AS c, v[(k // 8 // 2) * 4 + (k % 8) // 2 + 1] - 128 AS d, v[(k // 8 // 2) * 4 + (k % 8) // 2 + 17] - 128 AS e FROM f, unnest(range(64)) AS u(k))
SELECT vec_id, k AS pixel, greatest(0, least(255, (298 * c + 516 * d + 128) >> 8)) AS b, greatest(0, least(255, (298 * c - 100 * d - 208 * e + 128) >> 8)) AS g, greatest(0, least(255, (298 * c + 409 * e + 128) >> 8)) AS r FROM p""")
def q60_planar_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as planar frames of eight by eight pixels, converted in four tiles each."""
    hexed = lambda a: F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    v = F.transform("embedding", lambda x: F.floor(F.abs(x) * F.lit(1000.0).cast("float")).cast("bigint") % 256)
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    made = e.select(F.col("vec_id").cast("string").alias("source_id"), F.lit(0).alias("frame_index"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.concat(hexed(F.col("v")), hexed(F.slice("v", 1, 32)))).alias("pixels"))
    got = frames.assembled(frames.tiles(made, form="i420", tile=4)).select(F.col("source_id").cast("bigint").alias("vec_id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.substring("pixels", k * 4 + 1, F.lit(4)))).alias("pixel", "p"))
    return longs(got.select("vec_id", "pixel", *(scalars.read_be(F.col("p"), k, 1).alias(n) for k, n in enumerate("bgr"))), "pixel")
