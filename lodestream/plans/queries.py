"""Queries over the driver's tables, one an operator; ``ORACLES`` holds their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, samples, scalars
from ..operators import machines, policy, replay, scans, timeline, validity
from ..sources import avitree, boxtree, elements, encode, flacframes, framed, longstreams, media, streams, wavtree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# --- sample conversion -----------------------------------------------------------------------


@query("""
SELECT vec_id, CAST(pos - 1 AS BIGINT) AS pos, CAST(trunc(greatest(least(x, 1::FLOAT), -1::FLOAT) * 32767::FLOAT) AS BIGINT) AS value
FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings)""")
def q01_pcm_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return longs(e.select("vec_id", "pos", samples.f32(F.col("x")).alias("value")), "pos", "value")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, (CAST(trunc(l_quantity) AS BIGINT) - 128) * 256 AS u8, CAST(trunc(l_quantity) AS BIGINT) * 256 AS s8 FROM lineitem")
def q02_pcm_8bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return longs(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), samples.u8(q).alias("u8"), samples.s8(q).alias("s8")), "line", "u8", "s8")


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(floor(x / 256.0) AS BIGINT) AS s24, CAST(floor(x * 256 / 65536.0) AS BIGINT) AS s32
FROM (SELECT *, CAST(trunc(l_extendedprice) AS BIGINT) - 50000 AS x FROM lineitem)""")
def q04_pcm_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through packed bytes: the value as three and as four little-endian bytes, read back and narrowed."""
    x = F.col("l_extendedprice").cast("bigint") - 50000
    packed = lambda v, n: F.unhex(F.lpad(F.hex(v.bitwiseAND((1 << 8 * n) - 1)), 2 * n, "0"))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), packed(x, 3).alias("b3"), packed(x * 256, 4).alias("b4"))
    s24 = scalars.signed(scalars.read_be(F.col("b3"), 0, 3), 24)
    s32 = scalars.signed(scalars.read_be(F.col("b4"), 0, 4), 32)
    return longs(df.select("l_orderkey", "line", samples.s24(s24).alias("s24"), samples.s32(s32).alias("s32")), "line", "s24", "s32")


@query("""
WITH c AS (SELECT event_id, event_id % 256 AS code, xor(event_id % 256, 85) AS a, 255 - event_id % 256 AS u FROM events),
p AS (SELECT event_id, code, a, u, ((a >> 4) & 7) AS ae, ((a & 15) << 4) AS al, ((u >> 4) & 7) AS ue, (((u & 15) << 3) + 132) AS ul FROM c),
s AS (SELECT event_id, code, a, u, CASE WHEN ae = 0 THEN al + 8 ELSE (al + 264) << (ae - 1) END AS am, (ul << ue) - 132 AS um FROM p)
SELECT event_id, CAST(code AS BIGINT) AS code, CAST(CASE WHEN a >= 128 THEN am ELSE -am END AS BIGINT) AS alaw, CAST(CASE WHEN a >= 128 THEN -am ELSE am END AS BIGINT) AS alaw_compat,
CAST(CASE WHEN u >= 128 THEN -um ELSE um END AS BIGINT) AS ulaw FROM s""")
def q06_g711(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code an event, by its number."""
    c = F.col("code")
    codes = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 256).alias("code"))
    return longs(codes.select("event_id", "code", samples.alaw(c).alias("alaw"), samples.alaw(c, True).alias("alaw_compat"), samples.ulaw(c).alias("ulaw")), "code", "alaw", "alaw_compat", "ulaw")


#: A state is packed in one number: the sum of the samples above 23 bits, the value above 7, the step.
_IMA_SIZE = f"{list(codecs._STEPS)}[(a & 127) + 1]"
_IMA_CHANGE = f"(({_IMA_SIZE} >> 3) + (c >> 2 & 1) * {_IMA_SIZE} + (c >> 1 & 1) * ({_IMA_SIZE} >> 1) + (c & 1) * ({_IMA_SIZE} >> 2))"
_IMA_VALUE = f"greatest(-32768, least(32767, ((a >> 7) & 65535) - 32768 + (1 - (c >> 3) * 2) * {_IMA_CHANGE}))"
_IMA_STEP = "greatest(0, least(88, (a & 127) + CASE WHEN (c & 7) < 4 THEN -1 ELSE ((c & 7) - 3) * 2 END))"


@query(f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, r, rpad(h, CAST((length(h) + 7) // 8 * 8 AS INT), '0') AS h FROM t),
b AS (SELECT r, substr(h, 2040 * k + 1, 2040) AS h FROM (SELECT r, h, unnest(range((length(h) + 2039) // 2040)) AS k FROM p)),
n AS (SELECT r, length(h) + 1 AS n, list_prepend({(1 << 61) + (32768 << 7) + 16}::BIGINT, list_transform(range(length(h)), lambda i: strpos('123456789ABCDEF', substr(h, i + 2 - i % 2 * 2, 1))::BIGINT)) AS codes FROM b),
s AS (SELECT r, sum(n) AS n_samples, sum((list_reduce(codes, lambda a, c: ((a >> 23) + {_IMA_VALUE}) * 8388608 + ({_IMA_VALUE} + 32768) * 128 + {_IMA_STEP}) >> 23) - {1 << 38}) AS total FROM n GROUP BY r)
SELECT doc_id, CAST(coalesce(n_samples, 0) AS BIGINT) AS n_samples, CAST(coalesce(total, 0) AS BIGINT) AS total FROM p LEFT JOIN s USING (r)""")
def q07_ima_adpcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 1,024 bytes built from the whole texts, decoded many at a time; sums a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, totals = [0] * b.num_rows, [0] * b.num_rows
            rows: list[int] = []
            blocks: list[bytes] = []

            def flush() -> None:
                for k, s in zip(rows, codecs.ima_blocks(blocks, 1), strict=True):
                    counts[k] += len(s)
                    totals[k] += int(s.sum(dtype="int64"))
                rows.clear()
                blocks.clear()

            for k, t in enumerate(b.column("text").to_pylist()):
                body = (t or "").encode()
                body += b"\0" * (-len(body) % 4)
                for at in range(0, len(body), 1020):
                    rows.append(k)
                    blocks.append(b"\0\0\x10\0" + body[at : at + 1020])
                    if len(blocks) == 4096:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(totals, pa.int64())], names=["doc_id", "n_samples", "total"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_samples bigint, total bigint")


# --- relational steps ------------------------------------------------------------------------


@query("""
SELECT event_id, user_id, CAST(trunc(value) AS BIGINT) AS duration_ticks,
CAST(coalesce(sum(CAST(trunc(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS timestamp_ticks FROM events""")
def q08_packet_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").cast("bigint").alias("duration_ticks"))
    return longs(timeline.timestamps(e, "user_id", "event_id", "duration_ticks"), "timestamp_ticks")


@query("""
SELECT o_custkey, o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) % 1000 AS byte_offset,
row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(trunc(o_totalprice) AS BIGINT) % 1000, o_orderkey) - 1 AS seq FROM orders""")
def q09_packet_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice").cast("bigint") % 1000).alias("byte_offset"))
    return longs(timeline.sort_packets(o, "o_custkey", "byte_offset", "o_orderkey"), "seq")


@query("""
SELECT l_orderkey AS source_id, CAST(CASE WHEN max(l_linenumber) > 5 OR bool_or(o_orderkey IS NULL) THEN -2 ELSE 0 END AS BIGINT) AS status,
CAST(CASE WHEN max(l_linenumber) > 5 OR bool_or(o_orderkey IS NULL) THEN 0 ELSE count(*) END AS BIGINT) AS n_packets
FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders) ON o_orderkey = l_orderkey GROUP BY l_orderkey""")
def q10_track_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("track_id"))
    packets = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("track_id"))
    return longs(timeline.reject_orphans(packets, tracks, "source_id", "track_id"), "status", "n_packets")


@query("""
WITH e AS (SELECT p_partkey % 4 AS src, p_partkey AS first_chunk, CAST(p_size AS BIGINT) AS spc FROM part),
c AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, (l_partkey + l_linenumber) % 4 AS src, l_partkey AS chunk FROM lineitem)
SELECT l_orderkey, line, c.src, chunk, spc FROM c ASOF LEFT JOIN e ON c.src = e.src AND c.chunk >= e.first_chunk""")
def q11_chunk_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "part").select((F.col("p_partkey") % 4).alias("src"), F.col("p_partkey").alias("first_chunk"), F.col("p_size").cast("bigint").alias("spc"))
    chunks = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), ((F.col("l_partkey") + F.col("l_linenumber")) % 4).alias("src"), F.col("l_partkey").alias("chunk"))
    return timeline.asof(chunks, entries, "src", "chunk", "first_chunk", "spc")


@query("""
WITH r AS (SELECT p_brand, p_partkey, CAST(p_size AS BIGINT) AS run, coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM part)
SELECT p_brand, CAST(start + i AS BIGINT) AS ordinal, p_partkey AS value FROM (SELECT *, unnest(range(run)) AS i FROM r)""")
def q12_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", F.col("p_partkey").alias("value"))
    return longs(timeline.expand_runs(p, "p_brand", "p_partkey", "p_size", "value"), "ordinal")


@query("SELECT user_id, event_id, value FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 3")
def q13_nth_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", "event_id", "value")
    return timeline.nth_row(clicks, "user_id", "event_id", 2)


@query("""
WITH c AS (SELECT l_suppkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(trunc(l_quantity) AS BIGINT) AS n,
coalesce(sum(CAST(trunc(l_quantity) AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, trunc(l_quantity) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM lineitem)
SELECT l_suppkey, l_orderkey, line, n, CAST(500 - low AS BIGINT) AS offset_samples, CAST(n - (500 - low) AS BIGINT) AS available FROM c WHERE low <= 500 AND 500 < low + n""")
def q14_time_to_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_quantity").cast("bigint").alias("n"))
    return timeline.chunk_at(c, "l_suppkey", ["l_orderkey", "line", "n"], "n", 500)


@query("""
WITH p AS (SELECT user_id, event_id, event_id * 10 AS off, 5 + CAST(trunc(value) AS BIGINT) % 5 * 40 AS size, CAST(trunc(value) AS BIGINT) % 3 AS dur FROM events),
w AS (SELECT user_id, off < lag(off + size) OVER (PARTITION BY user_id ORDER BY event_id) AS o,
      event_id % 7 <> coalesce(sum(dur) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM p)
SELECT user_id, CAST(count(*) FILTER (o) AS BIGINT) AS overlaps, CAST(count(*) FILTER (g) AS BIGINT) AS gaps,
CAST(CASE WHEN count(*) FILTER (o) > 0 OR count(*) FILTER (g) > 0 THEN -3 ELSE 0 END AS BIGINT) AS status FROM w GROUP BY user_id""")
def q15_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value").cast("bigint")
    p = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 10).alias("off"), (5 + v % 5 * 40).alias("size"), (F.col("event_id") % 7).alias("ts_"), (v % 3).alias("dur"))
    return longs(timeline.contiguity(p, "user_id", "event_id", "off", "size", "ts_", "dur"), "overlaps", "gaps", "status")


@query("""
WITH s AS (SELECT l_orderkey, least(sum(CAST(trunc(l_quantity) AS BIGINT) * 60000000), 4294967295) AS duration_ticks FROM lineitem GROUP BY l_orderkey),
d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 4294967295 END AS declared FROM orders)
SELECT l_orderkey, CAST(duration_ticks AS BIGINT) AS duration_ticks, CAST(declared AS BIGINT) AS declared, declared = 0 OR declared = duration_ticks AS matches FROM s JOIN d ON o_orderkey = l_orderkey""")
def q16_duration_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity").cast("bigint") * 60_000_000).alias("dur"))
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(scalars.U32).cast("bigint").alias("declared"))
    return timeline.duration_check(p, "l_orderkey", "dur", d, "declared")


# --- scalars ---------------------------------------------------------------------------------


@query("""
SELECT event_id, CAST(CASE WHEN value > 0 THEN least(4294967295.0::DOUBLE, floor(event_id::DOUBLE * 1000.0::DOUBLE / value)) ELSE 0 END AS BIGINT) AS time_ms,
CAST(CASE WHEN value > 0 THEN least(4294967295.0::DOUBLE, floor((event_id * 97)::DOUBLE * value / 1000.0::DOUBLE)) ELSE 0 END AS BIGINT) AS frame,
least(4294967295, event_id * 44100 // 1000) AS sample, least(4294967295, event_id * 1000 // 44100) AS wav_ms FROM events""")
def q17_time_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    rate = F.lit(44100).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", scalars.frame_time_ms(e, v).alias("time_ms"), scalars.frame_for_time(e * 97, v).alias("frame"), scalars.sample_for_time(e, rate).alias("sample"), scalars.duration_ms(e, rate).alias("wav_ms"))


@query("""
SELECT p_partkey, CAST(CASE WHEN h = 0 THEN 1 ELSE h END AS BIGINT) AS hash FROM (
SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(t) + 1), lambda i: ord(substr(t, i, 1))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS h
FROM (SELECT p_partkey, p_type || ' ' || p_brand AS t FROM part))""")
def q18_fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.fnv1a(F.concat_ws(" ", "p_type", "p_brand")).alias("hash"))


@query("""
SELECT 'd' AS kind, doc_id AS id, CAST(0 AS BIGINT) AS turn, NOT regexp_matches(text, '[\\x00-\\x1f\\x7f]') AND strlen(text) < 128 AS admitted FROM documents
UNION ALL SELECT 'c', conv_id, turn, NOT regexp_matches(text, '[\\x00-\\x1f\\x7f]') AND strlen(text) < 128 FROM conversations""")
def q19_text_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = scalars.text_admitted(F.col("text")).alias("admitted")
    d = table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), ok)
    return d.unionAll(table(spark, sf_dir, "conversations").select(F.lit("c").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("bigint"), ok))


def _inputs() -> dict[str, Column]:
    """Policy inputs from an event's number, every valid value and one invalid of each field among them."""
    e = F.col("event_id")
    part = lambda d, m: (F.floor(e / d) % m).cast("int")
    return {"state": part(1, 4), "playback": part(4, 3), "background": part(12, 2), "output": part(5, 2), "flags": part(7, 17), "generation": part(1, 11), "session": part(1, 13), "command": part(3, 6)}


_INPUT_SQL = """i AS (SELECT event_id, event_id % 4 AS state, event_id // 4 % 3 AS playback, event_id // 12 % 2 AS background, event_id // 5 % 2 AS output,
event_id // 7 % 17 AS flags, event_id % 11 AS generation, event_id % 13 AS session, event_id // 3 % 6 AS command FROM events),
r AS (SELECT *, CASE WHEN state NOT IN (1, 2, 3) OR playback NOT IN (1, 2) OR flags > 15 OR generation = 0 THEN 1 WHEN playback = 1 THEN 2 WHEN output = 0 THEN 4
WHEN state <> 1 AND background = 0 THEN 3 ELSE 0 END AS reason FROM i)"""


@query(f"""WITH {_INPUT_SQL}
SELECT event_id, CAST(reason = 0 AS BIGINT) AS allow_playback, CAST(reason = 0 AND state = 3 AND flags <> 0 AS BIGINT) AS show_lock_controls, CAST(reason = 0 AS BIGINT) AS request_power_inhibit,
CAST(reason AS BIGINT) AS reason FROM r""")
def q20_policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _inputs()
    got = policy.decision(*(i[k] for k in machines.POLICY))
    return longs(table(spark, sf_dir, "events").select("event_id", *(c.alias(k) for k, c in got.items())), *got)


@query(f"""WITH {_INPUT_SQL}, f AS (SELECT *, CASE command WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 8 ELSE 0 END AS flag FROM r)
SELECT event_id, CAST(CASE WHEN session = 0 OR flag = 0 OR reason = 1 THEN -1 WHEN reason = 0 AND state = 3 AND flags & flag <> 0 THEN 1 ELSE 0 END AS BIGINT) AS lock_result,
CAST(CASE WHEN session = 0 OR reason = 1 THEN -1 WHEN reason = 0 THEN 1 ELSE 0 END AS BIGINT) AS power_result FROM f""")
def q20_request_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _inputs()
    common = [i[k] for k in (*machines.POLICY, "session")]
    return longs(table(spark, sf_dir, "events").select("event_id", policy.lock_build(*common, i["command"]).alias("lock_result"), policy.power_build(*common).alias("power_result")), "lock_result", "power_result")


def playback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events from the events table: the kind by its type, the generation from its props."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "signup", "bind").when(F.col("event_type") == "error", "clear").when(F.col("event_type") == "view", "surface").otherwise("playback")
    n = F.col("event_id")
    return e.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.coalesce(k, F.lit(0)) % 3 + 1).alias("generation"), (1 + n % 3).cast("int").alias("state"), (1 + n % 2).cast("int").alias("playback"),
        (F.floor(n / 2) % 4 != 0).cast("int").alias("background"), (F.floor(n / 3) % 5 != 0).cast("int").alias("output"), (F.floor(n / 5) % 16).cast("int").alias("flags"), (1 + F.floor(n / 7) % 4).cast("int").alias("command"),
    )


#: The same events in SQL, numbered within their session.
_PLAYBACK_SQL = """e AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'signup' THEN 'bind' WHEN 'error' THEN 'clear' WHEN 'view' THEN 'surface' ELSE 'playback' END AS kind,
coalesce(CAST(nullif(regexp_extract(props, '"k": *(-?[0-9]+)', 1), '') AS BIGINT), 0) % 3 + 1 AS generation, 1 + event_id % 3 AS state, 1 + event_id % 2 AS playback, event_id // 2 % 4 <> 0 AS background,
event_id // 3 % 5 <> 0 AS output, event_id // 5 % 16 AS flags, 1 + event_id // 7 % 4 AS command, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"""


@query(f"""
WITH RECURSIVE {_PLAYBACK_SQL},
r AS (SELECT DISTINCT session, 0::BIGINT AS rn, 0::BIGINT AS seq, FALSE AS ok, FALSE AS bound, 0::BIGINT AS gen, FALSE AS bg, FALSE AS sound, 0::BIGINT AS fl, 1::BIGINT AS surface, FALSE AS plays FROM e
UNION ALL SELECT session, rn, seq, ok, CASE WHEN kind = 'clear' THEN FALSE ELSE bound OR (kind = 'bind' AND ok) END, CASE WHEN kind = 'clear' THEN 0 WHEN kind = 'bind' AND ok THEN generation ELSE gen END,
CASE WHEN kind = 'clear' THEN FALSE WHEN kind = 'bind' AND ok THEN background ELSE bg END, CASE WHEN kind = 'clear' THEN FALSE WHEN kind IN ('bind', 'playback') AND ok THEN output ELSE sound END,
CASE WHEN kind = 'clear' THEN 0 WHEN kind = 'bind' AND ok THEN flags ELSE fl END, CASE WHEN kind = 'clear' OR (kind = 'bind' AND ok) THEN 1 WHEN kind = 'surface' AND ok THEN state ELSE surface END,
CASE WHEN kind = 'clear' OR (kind = 'bind' AND ok) THEN FALSE WHEN kind = 'playback' AND ok THEN playback = 2 ELSE plays END
FROM (SELECT e.*, bound, gen, bg, sound, fl, surface, plays, CASE kind WHEN 'bind' THEN e.session <> 0 WHEN 'clear' THEN TRUE WHEN 'surface' THEN bound AND generation = gen AND (state = 1 OR bg) ELSE bound AND generation = gen END AS ok
FROM r JOIN e ON e.session = r.session AND e.rn = r.rn + 1)),
w AS (SELECT *, CASE WHEN NOT bound THEN 1 WHEN NOT plays THEN 2 WHEN NOT sound THEN 4 WHEN surface <> 1 AND NOT bg THEN 3 ELSE 0 END AS why FROM r WHERE rn > 0)
SELECT session, seq, CAST(ok AS BIGINT) AS accepted, CAST(bound AS BIGINT) AS bound, CAST(why = 0 AS BIGINT) AS allow_playback, CAST(why = 0 AND surface = 3 AND fl <> 0 AS BIGINT) AS show_lock_controls,
CAST(why = 0 AS BIGINT) AS request_power_inhibit, CAST(why AS BIGINT) AS reason FROM w""")
def q21_lifecycle_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(scans.lifecycle(playback_events(spark, sf_dir), "session", "seq"), "accepted", "bound", "allow_playback", "show_lock_controls", "request_power_inhibit", "reason")


def _owner_sql(wanted: str, command: str) -> str:
    """An owner without failures: a denial clears, an older generation is refused, all else is taken over."""
    return f"""
WITH RECURSIVE {_PLAYBACK_SQL}, b AS (SELECT *, CASE WHEN session = 0 THEN -1 WHEN playback = 2 AND output AND (state = 1 OR background) AND {wanted} THEN 1 ELSE 0 END AS wanted FROM e),
r AS (SELECT DISTINCT session, 0::BIGINT AS rn, 0::BIGINT AS seq, 0 AS result, FALSE AS active, 0::BIGINT AS gen, 0::BIGINT AS held FROM e
UNION ALL SELECT b.session, b.rn, b.seq, CASE WHEN wanted = 1 AND active AND generation < gen THEN -1 ELSE wanted END, wanted = 1,
CASE WHEN wanted < 1 THEN 0 WHEN active THEN greatest(gen, generation) ELSE generation END, CASE WHEN wanted < 1 THEN 0 WHEN active AND generation < gen THEN held ELSE {command} END
FROM r JOIN b ON b.session = r.session AND b.rn = r.rn + 1)
SELECT session, seq, CAST(result AS BIGINT) AS result, CAST(active AS BIGINT) AS active, CAST(0 AS BIGINT) AS pending, CASE WHEN active THEN session ELSE 0 END AS active_session, gen AS active_generation, held AS active_command FROM r WHERE rn > 0"""


@query(_owner_sql("state = 3 AND (flags >> CAST(command - 1 AS INT)) & 1 = 1", "command"))
def q22_lock_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(scans.owner(playback_events(spark, sf_dir), "session", "seq", True), "result", "active", "pending", "active_command")


@query(_owner_sql("TRUE", "0"))
def q23_power_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(scans.owner(playback_events(spark, sf_dir), "session", "seq", False), "result", "active", "pending", "active_command")


@query("""
WITH n AS (SELECT DISTINCT event_type AS name FROM events UNION SELECT unnest(['wav', 'opus', 'vorbis', 'm4a', 'WAV']))
SELECT name, CAST(coalesce(codec_id, -1) AS BIGINT) AS codec_id FROM n LEFT JOIN (VALUES (1, 'wav'), (2, 'mp3'), (3, 'flac'), (4, 'ogg'), (5, 'opus'), (6, 'aac'), (7, 'm4a')) v(codec_id, name) USING (name)""")
def q24_capability_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(x,) for x in ("wav", "opus", "vorbis", "m4a", "WAV")], "name string")
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct().unionAll(extra).distinct()
    return longs(media.find_capability(names, spark), "codec_id")


def blobs(rows: DataFrame, make: Callable[[list[int]], bytes], key: str) -> DataFrame:
    """(source_id, content): a file from each row's array ``sizes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([make(s) for s in b.column(1).to_pylist()], pa.binary())], names=["source_id", "content"])

    return rows.select(F.col(key).cast("string").alias("source_id"), "sizes").mapInArrow(run, "source_id string, content binary")


def order_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, sizes): the quantities of each order's lines, in line order."""
    line = F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return grouped.select("o", F.col("lines.q").alias("sizes"))


def _wav_f32(values: list[float]) -> bytes:
    import struct

    return encode.wav(struct.pack(f"<{len(values)}f", *values), 3, 1, 8000, 32)


def wav_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs(table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "sizes"), _wav_f32, "vec_id")


@lru_cache(maxsize=4096)
def _bytes(n: int) -> bytes:
    return bytes((7 * n + 3 * k) % 251 for k in range(n))


@lru_cache(maxsize=4096)
def _second(k: int, n: int) -> tuple[int, list[bytes]]:
    """A cluster of one block."""
    return 1000 * k, [encode.element(0xA3, encode.block(_bytes(n), 5))]


MAKERS: dict[str, Callable[[list[int]], bytes]] = {
    "wav": lambda s: encode.wav(b"".join(_bytes(2 * n) for n in s)),
    "avi": lambda s: encode.avi([(b"00dc", _bytes(n)) for n in s]),
    "flac": lambda s: encode.flac([[n] for n in s], block=2),
    "adts": lambda s: encode.adts([_bytes(n) for n in s]),
    "opus": lambda s: encode.ogg_opus([b"\x08" + _bytes(n) for n in s]),
    "vorbis": lambda s: encode.ogg_vorbis([(b"\0" + _bytes(n), sum(s[: k + 1])) for k, n in enumerate(s)]),
    "mp4": lambda s: encode.mp4([_bytes(n) for n in s], s, keys=list(range(1, len(s) + 1, 2)), per_chunk=2),
    "webm": lambda s: encode.mkv([_second(k, n) for k, n in enumerate(s)]),
    "laced": lambda s: encode.mkv([(7, [encode.element(0xA3, encode.block(encode.xiph_lace([_bytes(n) for n in s]), 0, 0x82))])], "matroska"),
}


def container_sources(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return blobs(order_sizes(spark, sf_dir), MAKERS[kind], "o")


@query("""
SELECT 'html' AS kind, CAST(0 AS BIGINT) AS container_id, count(*) AS n FROM pages HAVING count(*) > 0
UNION ALL SELECT kind, CAST(c AS BIGINT), (SELECT count(DISTINCT l_orderkey) FROM lineitem)
FROM (VALUES ('adts', 8), ('avi', 4), ('flac', 6), ('laced', 3), ('mp4', 1), ('opus', 7), ('vorbis', 7), ('wav', 5), ('webm', 2)) v(kind, c)""")
def q25_container_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each kind for every order, all kinds in one pass over its lines, and the pages, which are no media."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("sizes").to_pylist()
            for kind in sorted(MAKERS):
                yield pa.RecordBatch.from_arrays([b.column("o").cast(pa.string()), pa.array(map(MAKERS[kind], sizes), pa.binary()), pa.array([kind], pa.string()).take(pa.array([0] * len(sizes)))], names=["source_id", "content", "kind"])

    made = order_sizes(spark, sf_dir).mapInArrow(make, "source_id string, content binary, kind string")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_id"), F.encode("html", "utf-8").alias("content"), F.lit("html").alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array([media.probe(d or b"") for d in b.column("content").to_pylist()], pa.int64())], names=["kind", "container_id"])

    found = made.unionByName(pages).select("kind", "content").mapInArrow(run, "kind string, container_id bigint")
    return found.groupBy("kind", "container_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, pixel, CAST(4278190080 + (pixel >> 11 & 31) * 8 * 65536 + (pixel >> 5 & 63) * 4 * 256 + (pixel & 31) * 8 AS BIGINT) AS argb FROM (SELECT event_id, event_id * 31 % 65536 AS pixel FROM events)")
def q26_raw_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel of 16 bits an event, by its number."""
    pixels = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 31 % 65536).alias("pixel"))
    return pixels.select("event_id", "pixel", scalars.rgb565_to_argb(F.col("pixel")).alias("argb"))


@query("""
SELECT o_orderkey, least(o_custkey * 10, least(4294967295, CAST(trunc(o_totalprice) AS BIGINT) * 8000 // 1000)) AS sample,
least(o_custkey * 10, least(4294967295, CAST(trunc(o_totalprice) AS BIGINT) * 8000 // 1000)) // 505 * 505 AS block_sample FROM orders""")
def q27_seek_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms, rate, total = F.col("o_totalprice").cast("bigint"), F.lit(8000), F.col("o_custkey") * 10
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.seek_sample(ms, rate, total).alias("sample"), scalars.seek_sample(ms, rate, total, 505).alias("block_sample"))


@query("""
WITH t AS (SELECT user_id, event_id, least(sum(CAST(trunc(value) AS BIGINT) * 100000) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4294967295) AS time_ms FROM events)
SELECT user_id, event_id, CAST(time_ms AS BIGINT) AS time_ms, CAST(least(floor(time_ms::DOUBLE * 25.0::DOUBLE / 1000.0::DOUBLE), 999999) AS BIGINT) AS target_frame FROM t""")
def q28_clock_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value").cast("bigint") * 100_000).alias("elapsed"))
    got = timeline.clock_positions(e, "user_id", "event_id", "elapsed", F.lit(25.0), F.lit(1_000_000).cast("bigint"))
    return longs(got.drop("elapsed"), "time_ms")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'play' WHEN 'error' THEN 'stop' WHEN 'purchase' THEN 'loop' ELSE 'update' END AS kind,
CASE event_type WHEN 'purchase' THEN event_id % 2 ELSE CAST(trunc(value) AS BIGINT) END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS event_id, 0::BIGINT AS ms, 0::BIGINT AS target, FALSE AS plays, FALSE AS loops FROM e
UNION ALL SELECT user_id, rn, event_id, CASE WHEN kind = 'stop' OR (runs AND raw >= 5 AND loops) THEN 0 WHEN runs THEN later ELSE ms END, CASE WHEN NOT runs OR (raw >= 5 AND loops) THEN 0 ELSE least(raw, 4) END,
CASE kind WHEN 'play' THEN TRUE WHEN 'stop' THEN FALSE ELSE plays END, CASE WHEN kind = 'loop' THEN v <> 0 ELSE loops END
FROM (SELECT *, kind = 'update' AND plays AS runs, CAST(floor(later::DOUBLE * 25.0::DOUBLE / 1000.0::DOUBLE) AS BIGINT) AS raw
FROM (SELECT e.*, ms, plays, loops, least(4294967295, ms + v) AS later FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)))
SELECT user_id, event_id, ms AS time_ms, target AS target_frame, target AS frames_due, CAST(plays AS BIGINT) AS playing FROM r WHERE rn > 0""")
def q28_player_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A looping player a user: clicks play, errors stop, purchases switch looping, the rest let time pass."""
    t = F.col("event_type")
    kind = F.when(t == "click", "play").when(t == "error", "stop").when(t == "purchase", "loop").otherwise("update")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"), F.when(t == "purchase", F.col("event_id") % 2).otherwise(F.col("value").cast("bigint")).alias("value"))
    return longs(replay.replay(e, machines.Player(25.0, 5), "user_id", ["event_id"]), "playing")


# --- whole paths from bytes ------------------------------------------------------------------


@query("""
SELECT CAST(vec_id AS VARCHAR) AS source_id, CAST(count(*) AS BIGINT) AS n, CAST(min(v) AS BIGINT) AS low, CAST(max(v) AS BIGINT) AS high, CAST(sum(v) AS BIGINT) AS total FROM (
SELECT vec_id, trunc(greatest(least(x, 1::FLOAT), -1::FLOAT) * 32767::FLOAT) AS v FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)) GROUP BY vec_id""")
def q29_wav_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as float WAV files: probe, inspect, decode, aggregate."""
    s = codecs.samples(wav_sources(spark, sf_dir))
    return longs(s.groupBy("source_id").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total")), "low", "high")


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS source_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, trunc(l_quantity)) - 1 AS frame, CAST(trunc(l_quantity) AS BIGINT) AS value FROM lineitem""")
def q30_flac_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames found, checked and decoded as rows."""
    frames = flacframes.checked(flacframes.walked(container_sources(spark, sf_dir, "flac")))
    return longs(flacframes.samples(frames).select("source_id", "frame", "value"), "value")


_LINES = """l AS (SELECT CAST(l_orderkey AS VARCHAR) AS source_id, row_number() OVER w - 1 AS seq, CAST(trunc(l_quantity) AS BIGINT) AS q,
CAST(coalesce(sum(CAST(trunc(l_quantity) AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, trunc(l_quantity) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, trunc(l_quantity)))"""
_INDEX_SQL = {
    "avi": ("q", "seq", "1", "1"),
    "adts": ("q + 7", "seq * 1024", "1024", "1"),
    "opus": ("q + 1", "seq * 960", "960", "1"),
    "vorbis": ("q + 1", "before", "q", "1"),
    "mp4": ("q", "before", "q", "(seq + 1) % 2"),
    "webm": ("q", "seq * 1000 + 5", "0", "1"),
    "laced": ("q", "7", "0", "1"),
}


def mp4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file an order, made without Python: a sample a line, of its quantity in bytes and in ticks, every second one a key."""
    return boxtree.mp4_files(order_sizes(spark, sf_dir), "o", "sizes", "sizes", 2, 2)


#: Lines whose packets one task's windows hold.
LINES_A_TASK = 100_000


def dealt(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files by source, in partitions as many as the lines need; those of small tables as the session deals them."""
    n = table(spark, sf_dir, "lineitem").count() // LINES_A_TASK
    return rows.repartition(n, "source_id") if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows


def _index_query(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if kind == "mp4":
            rows = boxtree.packets(boxtree.inspected(mp4_sources(spark, sf_dir)))
        elif kind == "avi":
            rows = avitree.packets(avitree.inspected(container_sources(spark, sf_dir, kind)))
        elif kind == "adts":
            rows = framed.packets(framed.adts(dealt(framed.walked(container_sources(spark, sf_dir, kind), longstreams.ADTS), spark, sf_dir)))
        elif kind in ("opus", "vorbis"):
            rows = framed.packets(framed.ogg(dealt(framed.walked(container_sources(spark, sf_dir, kind), framed.OGG), spark, sf_dir)))
        else:
            found = elements.walked(container_sources(spark, sf_dir, kind))
            rows = elements.packets(found, elements.inspected(found))
        return longs(rows.select("source_id", "seq", "byte_size", "timestamp_ticks", "duration_ticks", "flags"), "seq", "timestamp_ticks", "flags")

    run.__name__ = f"q31_{kind}_index"
    return run


for _kind, (_size, _time, _dur, _flags) in _INDEX_SQL.items():
    query(f"""WITH {_LINES} SELECT source_id, CAST(seq AS BIGINT) AS seq, CAST({_size} AS BIGINT) AS byte_size, CAST({_time} AS BIGINT) AS timestamp_ticks, CAST({_dur} AS BIGINT) AS duration_ticks,
CAST({_flags} AS BIGINT) AS flags FROM l""")(_index_query(_kind))


@query(f"""WITH {_LINES} SELECT source_id, CAST(seq AS BIGINT) AS seq, CAST(2 AS BIGINT) AS byte_size, CAST(seq AS BIGINT) AS timestamp_ticks
FROM (SELECT source_id, n, sum(q) AS total FROM l GROUP BY source_id, n) CROSS JOIN LATERAL (SELECT unnest(range(CAST(total AS BIGINT))) AS seq) WHERE total <= 256""")
def q31_wav_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCM: one packet a sample frame; sources of more than 256 are rejected whole."""
    rows = wavtree.packets(wavtree.inspected(container_sources(spark, sf_dir, "wav")))
    return longs(rows.select("source_id", "seq", "byte_size", "timestamp_ticks"), "seq", "timestamp_ticks")


@query(f"""WITH {_LINES} SELECT source_id, CAST(seq AS BIGINT) AS seq, least(n - seq * 2, 2) AS duration_ticks, seq * 2 AS timestamp_ticks
FROM (SELECT DISTINCT source_id, n, seq // 2 AS seq FROM l)""")
def q31_flac_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flacframes.packets(flacframes.checked(flacframes.walked(container_sources(spark, sf_dir, "flac"))))
    return longs(rows.select("source_id", "seq", "duration_ticks", "timestamp_ticks"), "seq", "timestamp_ticks")


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS source_id, CAST(1 AS BIGINT) AS container_id, CAST(1 AS BIGINT) AS track_id, CAST(1 AS BIGINT) AS kind, CAST(1836069985 AS BIGINT) AS codec_id, CAST(1000 AS BIGINT) AS time_scale,
CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS duration_ticks, 'mp4a' AS codec_name FROM lineitem GROUP BY l_orderkey""")
def q32_track_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(boxtree.tracks(boxtree.inspected(mp4_sources(spark, sf_dir))), "container_id", "kind", "duration_ticks")


@query(f"""WITH {_LINES} SELECT source_id, CAST(seq AS BIGINT) AS seq, q AS n_bytes, CAST(CASE WHEN q > 0 THEN 7 * q % 251 END AS BIGINT) AS first_byte FROM l""")
def q33_packet_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.indexed_payloads(container_sources(spark, sf_dir, "avi")).where("status = 0")
    return longs(got.select("source_id", "seq", F.octet_length("payload").alias("n_bytes"), scalars.read_be(F.col("payload"), 0, 1).alias("first_byte")), "seq", "n_bytes")


@query("""
SELECT o_orderkey, CAST(CAST(o_custkey AS HUGEINT) * (1 + o_orderkey % 1001) * 1000000000 // (o_orderkey % 60 + 1) AS BIGINT) AS frame_ns,
o_custkey % 5000 BETWEEN 1 AND 4096 AND o_orderkey % 5000 BETWEEN 1 AND 4096 AND (o_custkey % 5000) * (o_orderkey % 5000) <= 16777216 AS geometry_ok,
CAST(CASE WHEN o_custkey % 256 >> 3 < 12 THEN [480, 960, 1920, 2880][(o_custkey % 256 >> 3) % 4 + 1] WHEN o_custkey % 256 >> 3 < 16 THEN [480, 960][(o_custkey % 256 >> 3) % 2 + 1]
ELSE [120, 240, 480, 960][(o_custkey % 256 >> 3) % 4 + 1] END AS BIGINT) AS opus_ticks FROM orders""")
def q34_time_and_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    ns = scalars.frame_timestamp_ns(c, 1 + o % 1001, o % 60 + 1)
    return longs(table(spark, sf_dir, "orders").select("o_orderkey", ns.alias("frame_ns"), scalars.frame_geometry_ok(c % 5000, o % 5000).alias("geometry_ok"), scalars.opus_frame_ticks(c % 256).alias("opus_ticks")), "frame_ns", "opus_ticks")


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN c SIMILAR TO '[0-9][0-9].*' THEN CAST(substr(c, 1, 2) AS BIGINT) ELSE -1 END AS stream, c SIMILAR TO '..d[cb]' AS is_video, c SIMILAR TO '..wb' AS is_audio FROM (
SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN 'JU' ELSE lpad(CAST(l_linenumber AS VARCHAR), 2, '0') END || CASE l_partkey % 4 WHEN 0 THEN 'dc' WHEN 1 THEN 'db' WHEN 2 THEN 'wb' ELSE 'tx' END AS c FROM lineitem)""")
def q35_chunk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey") % 4
    head = F.when(F.col("l_orderkey") % 7 == 0, "JU").otherwise(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    c = F.concat(head, F.when(p == 0, "dc").when(p == 1, "db").when(p == 2, "wb").otherwise("tx"))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), c.alias("c"))
    x = F.col("c")
    return longs(df.select("l_orderkey", "line", scalars.stream_index(x).alias("stream"), scalars.is_video_chunk(x).alias("is_video"), scalars.is_audio_chunk(x).alias("is_audio")), "line", "stream")


@query("""
WITH t AS (SELECT o_custkey AS source, o_orderkey AS track, o_orderpriority = '1-URGENT' AS is_default FROM orders)
SELECT source, arg_min(track, (NOT is_default)::INT * 1000000000000 + track) AS track, arg_min(is_default, (NOT is_default)::INT * 1000000000000 + track) AS is_default FROM t GROUP BY source""")
def q36_best_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("track"), (F.col("o_orderpriority") == "1-URGENT").alias("is_default"))
    return timeline.best_track(t, "source", "track", "is_default")


@query("""
SELECT user_id, arg_max(CAST(trunc(value) AS BIGINT), event_id) AS granule FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def q37_last_granule(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", -1).otherwise(F.col("value").cast("bigint")).alias("granule"))
    return timeline.last_granule(pages, "user_id", "event_id", "granule")


@query("SELECT DISTINCT l_orderkey AS source FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1")
def q38_duplicate_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.duplicate_tracks(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "source"), "source", "l_suppkey")


@query(f"""
WITH v AS (SELECT p_partkey, p_partkey * 2654435761 % 65536 AS v FROM part), f AS (SELECT *, v >> 11 AS kind, (v >> 7) & 15 AS rate, (v >> 3) & 15 AS channels FROM v),
g AS (SELECT *, kind NOT IN (0, 5, 29, 31) AND rate < {len(streams.AAC_RATES)} AND channels <= 7 AND NOT (kind IN (1, 2, 3, 4, 6, 7, 17, 19, 20, 21, 22, 23) AND (v & 2) = 2) AS ok FROM f)
SELECT p_partkey, CAST(CASE WHEN ok THEN 0 ELSE -3 END AS BIGINT) AS status, CAST(CASE WHEN ok THEN kind ELSE 0 END AS BIGINT) AS object_type,
CAST(CASE WHEN ok THEN {list(streams.AAC_RATES)}[rate + 1] ELSE 0 END AS BIGINT) AS rate, CAST(CASE WHEN ok THEN channels ELSE 0 END AS BIGINT) AS channels FROM g""")
def q39_aac_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-byte configurations made from part keys: object type, rate index and channels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for k in b.column("p_partkey").to_pylist():
                try:
                    c = streams.aac_config((k * 2654435761 % 65536).to_bytes(2, "big"))
                    got.append((0, c.object_type, c.rate, c.channels))
                except media.Bad:
                    got.append((-3, 0, 0, 0))
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), *(pa.array([g[c] for g in got], pa.int64()) for c in range(4))], names=["p_partkey", "status", "object_type", "rate", "channels"])

    return table(spark, sf_dir, "part").select("p_partkey").mapInArrow(run, "p_partkey bigint, status bigint, object_type bigint, rate bigint, channels bigint")


@query("""
SELECT conv_id, max(turn) AS revision, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id""")
def q40_latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest snapshot of each session by its revision."""
    c = table(spark, sf_dir, "conversations")
    return timeline.latest(c.select("conv_id", F.col("turn").alias("revision"), "role"), "conv_id", "revision")


@query("""
WITH e AS (SELECT *, event_id % 9 AS a, event_id % 7 AS b, event_id % 5 AS c, event_id % 3 AS d, CAST(trunc(value) AS BIGINT) AS v FROM events)
SELECT event_id, a <> 0 AND b <> 0 AND c <> 0 AND d <> 0 AS track_ok, v * 100000 BETWEEN 1 AND 16777216 AND a <> 0 AND v - 2 >= 0 AND b - 1 >= 0 AS packet_ok,
v > 0 AND a * 5 BETWEEN 1 AND 32 AND b <> 0 AND c - 1 >= 0 AS audio_ok, a > 0 AND b > 0 AND v >= a * 4 AND d - 1 >= 0 AS video_ok,
d = 1 AND v * 2000 BETWEEN 1 AND 384000 AND a * 5 BETWEEN 1 AND 32 AND b BETWEEN 1 AND 6 AND c = 0 AS pcm_ok, a <> 0 AND b <> 0 AND c BETWEEN 1 AND 4 AS lock_ok, a <> 0 AND b <> 0 AND d = 1 AS power_ok FROM e""")
def q41_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, v = F.col("event_id"), F.col("value").cast("bigint")
    a, b, c, d = (n % m for m in (9, 7, 5, 3))
    return table(spark, sf_dir, "events").select(
        "event_id", validity.track_ok(a, b, c, d).alias("track_ok"), validity.packet_ok(v * 100_000, a, v - 2, b - 1).alias("packet_ok"), validity.audio_frame_ok(v, a * 5, b, c - 1).alias("audio_ok"),
        validity.video_frame_ok(a, b, v, d - 1).alias("video_ok"), validity.pcm_config_ok(d, v * 2000, a * 5, b, c).alias("pcm_ok"), validity.lock_request_ok(a, b, c).alias("lock_ok"),
        validity.power_request_ok(a, b, d).alias("power_ok"),
    )


@query("""
WITH s AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, conv_id % 3 AS playback, conv_id % 17 AS flags, turn * 100 AS position, conv_id % 4 * 150 AS duration, turn % 2 AS revision, role, text FROM conversations),
t AS (SELECT *, playback IN (1, 2) AND flags BETWEEN 1 AND 15 AND (duration = 0 OR position <= duration) AND NOT regexp_matches(text, '[\\x00-\\x1f\\x7f]') AND strlen(text) < 128 AS ok FROM s)
SELECT conv_id, turn, ok AND revision = 0 AS publisher_ok, ok AND revision <> 0 AS published_ok FROM t""")
def q42_session_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    args = (c % 3, c % 17, t * 100, c % 4 * 150, t % 2, F.col("text"), F.col("role"), F.lit(""))
    return longs(table(spark, sf_dir, "conversations").select("conv_id", "turn", validity.session_info_ok(*args, published=False).alias("publisher_ok"), validity.session_info_ok(*args, published=True).alias("published_ok")), "turn")


@query("""
WITH p AS (SELECT page_id, ['MJPG', 'jpeg', 'DIB ', 'RAW ', 'H264', 'mjpg', 'JPEG', repeat(chr(0), 4)][CAST(page_id % 8 AS INT) + 1] AS code, CASE WHEN page_id % 2 = 0 THEN '' ELSE url END AS a, CASE WHEN page_id % 3 = 0 THEN '' ELSE html END AS b FROM pages)
SELECT page_id, hex(encode(code)) AS code, CASE WHEN code IN ('MJPG', 'mjpg', 'JPEG') THEN 'mjpeg' WHEN code IN ('DIB ', repeat(chr(0), 4)) THEN 'raw' ELSE 'unknown' END AS codec,
CASE WHEN length(a) > 0 AND strlen(a) <= 4096 THEN a WHEN length(b) > 0 AND strlen(b) <= 4096 THEN b ELSE '' END AS title FROM p""")
def q43_codec_and_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    code = F.element_at(F.array(*map(F.lit, ("MJPG", "jpeg", "DIB ", "RAW ", "H264", "mjpg", "JPEG", "\0\0\0\0"))), (n % 8 + 1).cast("int"))
    df = table(spark, sf_dir, "pages").select("page_id", code.alias("code"), F.when(n % 2 == 0, "").otherwise(F.col("url")).alias("a"), F.when(n % 3 == 0, "").otherwise(F.col("html")).alias("b"))
    return df.select("page_id", F.hex(F.encode("code", "utf-8")).alias("code"), validity.video_codec(F.col("code")).alias("codec"), validity.metadata(F.col("a"), F.col("b")).alias("title"))


@query("""
WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) AS source_id, l_orderkey % 3 AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT source_id, 'index' AS stage, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN -2 ELSE -1 END AS BIGINT) AS code, CASE WHEN k = 0 THEN n ELSE 0 END AS n_packets FROM s""")
def q44_failure_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three sources, one is whole, one has its last frame cut, one is empty: all rows or none."""
    o = F.col("source_id").cast("bigint") % 3
    made = container_sources(spark, sf_dir, "adts")
    cut = F.when(o == 0, F.col("content")).when(o == 1, F.substring("content", F.lit(1), F.octet_length("content") - 1)).otherwise(F.lit(bytearray()))
    found = framed.adts(framed.walked(made.withColumn("content", cut), longstreams.ADTS))
    return longs(framed.statuses(found), "code", "n_packets")


# --- requests, limits and formats --------------------------------------------------------------

_WAV_SAMPLES = """w AS (SELECT CAST(vec_id AS VARCHAR) AS source_id, pos - 1 AS frame, CAST(trunc(greatest(least(x, 1::FLOAT), -1::FLOAT) * 32767::FLOAT) AS BIGINT) AS value
FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings))"""


@query(f"""
WITH {_WAV_SAMPLES}, r AS (SELECT CAST(event_id AS BIGINT) AS request, CAST(user_id AS VARCHAR) AS source_id, event_id % 70 AS position, event_id % 9 AS max_frames FROM events)
SELECT request, source_id, CAST(frame AS BIGINT) AS frame, value FROM w JOIN r USING (source_id) WHERE frame >= position AND frame < position + max_frames""")
def q45_bounded_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read request an event, each of a few frames at a position, some of them beyond the end."""
    n = F.col("event_id")
    asked = table(spark, sf_dir, "events").select(n.cast("bigint").alias("request"), F.col("user_id").cast("string").alias("source_id"), (n % 70).alias("position"), (n % 9).alias("max_frames"))
    got = codecs.bounded_read(codecs.samples(wav_sources(spark, sf_dir)), asked)
    return longs(got.select("request", "source_id", "frame", "value"), "frame", "value")


@query("""
WITH s AS (SELECT l_orderkey, sum(2 * CAST(trunc(l_quantity) AS BIGINT)) AS body FROM lineitem GROUP BY 1)
SELECT CAST(l_orderkey AS VARCHAR) AS source_id, 'index' AS stage, CAST(CASE WHEN 44 + body > 400 THEN -1 ELSE 0 END AS BIGINT) AS code, CAST(CASE WHEN 44 + body > 400 THEN 0 ELSE (body // 2 + 15) // 16 END AS BIGINT) AS n_packets FROM s""")
def q46_oversize_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAV sources under a limit of 400 bytes, 16 sample frames a packet: one status row a source, always."""
    return longs(wavtree.statuses(wavtree.inspected(container_sources(spark, sf_dir, "wav"), 400), 16), "code", "n_packets")


@query(f"""
WITH {_WAV_SAMPLES} SELECT source_id, CAST(0 AS BIGINT) AS status, CAST(frame // 8 AS BIGINT) AS packet, CAST(frame AS BIGINT) AS frame, value FROM w""")
def q47_packet_table_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as float WAV files, decoded by a table of packets of eight sample frames."""
    got = media.samples_by_packets(wav_sources(spark, sf_dir), frames_per_packet=8)
    return longs(got.select("source_id", "status", "packet", "frame", "value"), "status", "value")


@query("""
WITH e AS (SELECT user_id, event_id, CAST(trunc(value) AS BIGINT) * 60 AS v, CASE event_type WHEN 'click' THEN 'position' WHEN 'error' THEN 'rate' WHEN 'purchase' THEN 'pause' ELSE 'resume' END AS kind FROM events)
SELECT user_id, event_id, CAST(CASE WHEN kind <> 'rate' OR v BETWEEN 1 AND 4000 THEN 1 ELSE 0 END AS BIGINT) AS accepted,
coalesce(last_value(CASE WHEN kind = 'position' THEN v END IGNORE NULLS) OVER w, 0) AS position_ns, coalesce(last_value(CASE WHEN kind = 'rate' AND v BETWEEN 1 AND 4000 THEN v END IGNORE NULLS) OVER w, 1000) AS rate_permille,
CAST(coalesce(last_value(CASE kind WHEN 'pause' THEN 1 WHEN 'resume' THEN 0 END IGNORE NULLS) OVER w, 1) AS BIGINT) AS paused
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def q48_playback_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clock a user: clicks set its position, errors its rate (some out of bounds), purchases pause it, the rest resume it."""
    t = F.col("event_type")
    kind = F.when(t == "click", "position").when(t == "error", "rate").when(t == "purchase", "pause").otherwise("resume")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"), (F.col("value").cast("bigint") * 60).alias("value"))
    got = scans.clock(e, "user_id", "event_id")
    return longs(got, "accepted", "rate_permille", "paused").select("user_id", "event_id", "accepted", "position_ns", "rate_permille", "paused")


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k, CAST((2 * CAST(c AS HUGEINT) * (k % 1000 + 1) * 1000000000 + (k % 60 + 1)) // (2 * (k % 60 + 1)) AS BIGINT) AS ns, c % 1200 > 0 AND k % 7 > 0 AND c % 1200 <= k % 7 * 1000 AS rational_ok,
k * 97 % 500000 BETWEEN 1 AND 384000 AND c % 40 BETWEEN 1 AND 32 AS format_ok, CASE WHEN k % 3 = 0 THEN k WHEN c % 2 = 0 THEN c ELSE -1 END AS opened,
c % 500 > 0 AND k % 9 > 0 AND k % 9 <= 6 AS range_ok, k % 5 <> 1 AND k % 2 = 0 AS reply_ok FROM o""")
def q49_times_formats_and_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rescaled times, admitted rationals and output formats, native decoding with a fallback, request ranges and reply headers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    reply = F.struct(F.lit(7).alias("magic"), F.lit(1).alias("version"), (k % 5).alias("operation"), (k % 2).alias("reserved"), k.alias("request_id"), c.alias("session_id"))
    expected = F.when(k % 5 == 1, 9).otherwise(k % 5)
    return longs(
        table(spark, sf_dir, "orders").select(
            k.alias("k"), scalars.rescaled_ns(c, k % 1000 + 1, k % 60 + 1).alias("ns"), scalars.rational_ok(c % 1200, k % 7).alias("rational_ok"), scalars.audio_format_ok(k * 97 % 500_000, c % 40).alias("format_ok"),
            F.coalesce(validity.first_success(k % 3, k, c % 2, c), F.lit(-1)).alias("opened"), validity.request_range_ok(c % 500, k % 9, 6).alias("range_ok"), validity.reply_ok(reply, 7, 1, expected, k, c).alias("reply_ok"),
        ),
        "ns", "opened",
    )


@query("""
WITH s AS (SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS frame, CAST(trunc(value) AS BIGINT) - 40 AS value FROM events)
SELECT source_id, frame, CAST(c AS BIGINT) AS channel, CASE c % 2 WHEN 0 THEN value ELSE value * 2 END AS value FROM s, (VALUES (0), (1), (2)) v(c)
UNION ALL SELECT source_id, frame, CAST(-1 AS BIGINT), CAST(trunc(value * 3 / 2.0) AS BIGINT) FROM s""")
def q50_remix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels to three, and (shown as channel -1) to one."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("frame"), (F.col("value").cast("bigint") - 40).alias("v"))
    two = e.select("source_id", "frame", F.posexplode(F.array("v", F.col("v") * 2)).alias("channel", "value"))
    return longs(codecs.remixed(two, 3).unionByName(codecs.remixed(two, 1).withColumn("channel", F.lit(-1))), "channel", "value")


@query("""
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'publish' WHEN 'error' THEN 'close' WHEN 'purchase' THEN 'poll' ELSE 'update' END AS kind,
event_id % 4 <> 0 AS info, event_id % 5 AS sid, event_id % 7 AS rev, event_id % 6 BETWEEN 1 AND 4 AND event_id % 3 <> 0 AS good FROM events),
m AS (SELECT *, CASE WHEN kind = 'publish' THEN CASE WHEN info AND rev > 0 THEN sid ELSE 0 END WHEN kind = 'close' OR (kind = 'poll' AND NOT good) THEN 0 END AS leaves FROM e),
s AS (SELECT *, coalesce(last_value(leaves IGNORE NULLS) OVER w, 0) AS now, coalesce(last_value(leaves IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, kind, CAST(CASE kind WHEN 'publish' THEN now > 0 WHEN 'update' THEN before > 0 AND info WHEN 'poll' THEN before > 0 AND good ELSE TRUE END AS BIGINT) AS accepted,
CAST(now AS BIGINT) AS session_id, CAST(sid > 0 AND good AS BIGINT) AS dispatched FROM s""")
def q51_session_publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A publisher a user: signups publish, errors close, purchases poll for a command, the rest update; and whether a controller's command could be dispatched."""
    t, n = F.col("event_type"), F.col("event_id")
    kind = F.when(t == "signup", "publish").when(t == "error", "close").when(t == "purchase", "poll").otherwise("update")
    fields = {"info_ok": n % 4 != 0, "reply_session": n % 5, "reply_revision": n % 7, "command": n % 6, "command_revision": n % 3}
    got = timeline.publisher_states(table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"), *(c.alias(k) for k, c in fields.items())), "user_id", "event_id")
    sent = validity.number_ok(F.col("reply_session")) & validity.command_ok(F.col("command"), F.col("command_revision"))
    return longs(got.select("user_id", "event_id", "kind", "accepted", "session_id", sent.alias("dispatched")), "accepted", "session_id", "dispatched")


@query(f"""
WITH {_WAV_SAMPLES}, n AS (SELECT source_id, count(*) AS n FROM w GROUP BY source_id), o AS (SELECT source_id, n, unnest(range((n * 11025 + 7999) // 8000)) AS j FROM n),
p AS (SELECT source_id, j, j * 8000 // 11025 AS k, j * 8000 % 11025 AS rest, least(j * 8000 // 11025 + 1, n - 1) AS k2 FROM o)
SELECT p.source_id, CAST(j AS BIGINT) AS frame, a.value + CAST(trunc((b.value - a.value) * rest / 11025.0::DOUBLE) AS BIGINT) AS value
FROM p JOIN w a ON a.source_id = p.source_id AND a.frame = k JOIN w b ON b.source_id = p.source_id AND b.frame = k2""")
def q52_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as WAV files of 8,000 Hz, decoded and brought to 11,025 Hz."""
    return longs(codecs.resampled(codecs.samples(wav_sources(spark, sf_dir)), 8000, 11_025).select("source_id", "frame", "value"), "frame", "value")


from . import access  # noqa: E402, F401 - registers further queries
