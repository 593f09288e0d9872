"""Adapter views: the engine's inputs, derived by Spark from the given tables, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86400000 + F.hour(ts) * 3600000 + F.minute(ts) * 60000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, ordinal (arrival), received_ms, data_type, nested, sample."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("session"), (F.row_number().over(order) - 1).cast("long").alias("ordinal"), epoch_ms(F.col("ts")).alias("received_ms"), F.col("event_type").alias("data_type"), F.col("props").alias("nested"), F.col("value").alias("sample"))


PACKETS_SQL = """packets AS (
  SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ordinal,
         epoch_us(ts) // 1000 AS received_ms, event_type AS data_type, props AS nested, value AS sample FROM events)"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, ordinal, payload (64 integers of 24 bits and more, by exact scaling of the vector)."""
    v = table(spark, sf_dir, "embeddings")
    order = Window.partitionBy("label").orderBy("vec_id")
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * 4194304).cast("long"))
    return v.select(F.col("label").cast("long").alias("session"), (F.row_number().over(order) - 1).cast("long").alias("ordinal"), ints.alias("payload"))


PAYLOADS_SQL = """payloads AS (
  SELECT CAST(label AS BIGINT) AS session, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS ordinal,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4194304) AS BIGINT)) AS payload FROM embeddings),
words AS (
  SELECT session, ordinal, unnest(range(len(payload))) AS pos, unnest(payload) AS v FROM payloads)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload words, one row each: session, ordinal, pos, v."""
    return payloads(spark, sf_dir).select("session", "ordinal", F.posexplode("payload").alias("pos", "v"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells of three columns (session_id, props_json, note), some of them empty or broken."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    props = F.when(k % 11 == 0, None).when(k % 11 == 1, "").when(k % 11 == 2, "[]").when(k % 11 == 3, "{bad").when(k % 11 == 4, " NaN ").when(k % 11 == 5, "{}").when(k % 11 == 6, "[1, 2]").otherwise(F.col("props"))
    return e.select("event_id", F.stack(F.lit(3), F.lit("session_id"), F.col("user_id").cast("string"), F.lit("props_json"), props, F.lit("note"), F.when(k % 5 == 0, " ").otherwise(F.col("event_type"))).alias("column", "cell"))


CELLS_SQL = """cells AS (
  SELECT event_id, 'session_id' AS "column", CAST(user_id AS VARCHAR) AS cell FROM events
  UNION ALL SELECT event_id, 'note', CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type END FROM events
  UNION ALL SELECT event_id, 'props_json', CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '[]' WHEN 3 THEN '{bad'
    WHEN 4 THEN ' NaN ' WHEN 5 THEN '{}' WHEN 6 THEN '[1, 2]' ELSE props END FROM events)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table of text, one row an event: upload counts, a duration, and two JSON columns, some of them broken."""
    k = F.col("event_id")
    text = lambda c: c.cast("string")
    ppg = F.concat(F.lit('{"time_ms":[0,'), text(k % 10 * 1000), F.lit('],"ppg":[1,2,'), text(k % 3), F.lit('],"meta":'), F.col("props"), F.lit("}"))
    motion = F.when(k % 3 == 0, F.concat(F.lit('{"heart_rate":{"bpm":['), text(k % 90), F.lit('.5]},"12.5":null,"failed":'), text(k % 4), F.lit("}"))).when(k % 3 == 1, "").otherwise('[{"acc":[]},{"acc":[true]}]')
    return table(spark, sf_dir, "events").select(
        k.alias("session"), text(k % 13).alias("chunks_sent"), F.when(k % 6 == 0, "").otherwise("9").alias("chunks_total"),
        F.when(k % 5 == 0, "yes").when(k % 5 == 1, "2").otherwise("0").alias("upload_pending"), F.when(k % 4 > 0, text(k % 10)).alias("duration_s"),
        F.when(k % 7 == 0, "").when(k % 7 == 1, "{bad").when(k % 7 == 2, "[]").otherwise(ppg).alias("ppg_json"), motion.alias("motion_json"))


SESSIONS_SQL = """sessions AS (
  SELECT event_id AS session, CAST(event_id % 13 AS VARCHAR) AS chunks_sent, CASE WHEN event_id % 6 = 0 THEN '' ELSE '9' END AS chunks_total,
    CASE event_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '2' ELSE '0' END AS upload_pending, CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 10 AS VARCHAR) END AS duration_s,
    CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '{bad' WHEN 2 THEN '[]' ELSE '{"time_ms":[0,' || (event_id % 10 * 1000) || '],"ppg":[1,2,' || (event_id % 3) || '],"meta":' || props || '}' END AS ppg_json,
    CASE event_id % 3 WHEN 0 THEN '{"heart_rate":{"bpm":[' || (event_id % 90) || '.5]},"12.5":null,"failed":' || (event_id % 4) || '}' WHEN 1 THEN '' ELSE '[{"acc":[]},{"acc":[true]}]' END AS motion_json FROM events),
json_cells AS (SELECT session, 'ppg_json' AS col, ppg_json AS cell FROM sessions UNION ALL SELECT session, 'motion_json', motion_json FROM sessions),
nodes AS (SELECT c.session, c.col, t.type AS t, regexp_replace(regexp_replace(regexp_replace(t.fullkey, '\\[\\d+\\]', '[]', 'g'), '^\\$\\.?', ''), '"?12\\.5"?', '<dynamic_key>') AS path,
    CASE WHEN t.type = 'ARRAY' THEN json_array_length(t.value) END AS len,
    CASE WHEN t.type = 'ARRAY' THEN CASE WHEN regexp_matches(CAST(t.value AS VARCHAR), '[{]') THEN 0 ELSE json_array_length(t.value) END END AS samples
  FROM (SELECT * FROM json_cells WHERE json_valid(cell) AND cell <> '[]') c, json_tree(c.cell) t)"""


def timed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payloads() with received_ms: a second a packet, a little off, and five seconds more after every 200 vectors."""
    v = table(spark, sf_dir, "embeddings")
    order = Window.partitionBy("label").orderBy("vec_id")
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * 4194304).cast("long"))
    rows = v.select(F.col("label").cast("long").alias("session"), (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "vec_id", ints.alias("payload"))
    return rows.select("session", "ordinal", (F.col("ordinal") * 1000 + F.col("vec_id") % 7 * 10 + F.floor(F.col("vec_id") / 200) * 5000).alias("received_ms"), "payload")


TIMED_SQL = """timed AS (
  SELECT session, ordinal, ordinal * 1000 + vec_id % 7 * 10 + vec_id // 200 * 5000 AS received_ms, payload FROM (
    SELECT CAST(label AS BIGINT) AS session, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS ordinal, vec_id,
           list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4194304) AS BIGINT)) AS payload FROM embeddings))"""


def packet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session table with one cell of packets (of six words) an event: the first packet is sound or short, the second one is
    broken in one of ten ways; some cells are empty, malformed, or hold no array."""
    e = F.col("event_id")
    text = lambda c: c.cast("string")
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    words = part("[", text(e), ",2,3,4,5,6]")
    end, kind, time = '"dataEnd":1', '"dataType":"119"', part('"receivedAtMs":', text(e * 10000 + (e % 3 - 1) * 1000))
    dic = lambda ppg: part('"dicData":{"PPG":', ppg, ',"Time":1}')
    packet = lambda *xs: part("{", *[y for x in xs for y in (x, ",")][:-1], "}")
    first = packet(end, kind, dic(F.when(e % 7 == 0, part("[", text(e), ",2,3,4,5]")).otherwise(words)), part('"receivedAtMs":', text(e * 10000)))
    second = [
        packet(kind, dic(words), time), packet(end, kind, dic(words), time, '"more":1'), packet(end, kind, dic(words), '"receivedAtMs":"abc"'), packet(end, kind, '"dicData":null', time),
        packet(end, kind, part('"dicData":{"PPG":', words, "}"), time), packet(end, kind, '"dicData":{"Time":1}', time), packet(end, kind, dic('"[1,2"'), time), packet(end, kind, dic('"5"'), time),
        packet(end, kind, dic("[1.5,2]"), time), packet(end, '"dataType":"7"', dic(words), time), F.lit("42"),
    ]
    broken = second[0]
    for i, p in enumerate(second[1:], 1):
        broken = F.when(e % 11 == i, p).otherwise(broken)
    k = e % 17
    cell = F.when(k == 0, None).when(k == 1, "").when(k == 2, "NaN").when(k == 3, "{bad").when(k == 4, '{"a":1}').when(k == 5, "[]").otherwise(part("[", first, ",", broken, "]"))
    return table(spark, sf_dir, "events").select(e.alias("session_ordinal"), cell.alias("raw_packets_json"))


PACKET_CELLS_SQL = """c AS (SELECT event_id AS e, event_id % 17 AS k, event_id % 11 AS b, event_id % 3 AS r FROM events),
items AS (
  SELECT 'code' AS kind, CASE WHEN k < 3 THEN 'cell_empty' ELSE 'cell_malformed' END AS name FROM c WHERE k < 5
  UNION ALL SELECT unnest(['schema', 'data_type', 'payload_length']), unnest([CASE WHEN e % 7 = 0 THEN 'anomaly' ELSE 'ok' END, '119', CASE WHEN e % 7 = 0 THEN '5' ELSE '6' END]) FROM c WHERE k > 5
  UNION ALL SELECT 'code', 'payload_length_mismatch' FROM c WHERE k > 5 AND e % 7 = 0
  UNION ALL SELECT unnest(['schema', 'data_type', 'payload_length']), unnest(['anomaly', CASE b WHEN 9 THEN '7' WHEN 10 THEN '<missing>' ELSE '119' END, CASE WHEN b IN (3, 5, 6, 7, 8, 10) THEN '<missing>' ELSE '6' END]) FROM c WHERE k > 5
  UNION ALL SELECT 'code', unnest(CASE b WHEN 0 THEN ['missing_top_keys'] WHEN 1 THEN ['extra_top_keys'] WHEN 2 THEN ['received_at_invalid'] WHEN 3 THEN ['dicdata_missing'] WHEN 4 THEN ['dicdata_missing_keys']
    WHEN 5 THEN ['dicdata_missing_keys', 'ppg_missing'] WHEN 6 THEN ['ppg_json_malformed'] WHEN 7 THEN ['ppg_not_array'] WHEN 8 THEN ['ppg_non_integer'] WHEN 9 THEN ['datatype_unexpected'] ELSE ['packet_not_object', 'datatype_unexpected'] END) FROM c WHERE k > 5
  UNION ALL SELECT 'nested', CASE b WHEN 5 THEN 'ppg_missing' WHEN 6 THEN 'ppg_json_malformed' WHEN 7 THEN 'ppg_not_array' ELSE 'ppg_non_integer' END FROM c WHERE k > 5 AND b BETWEEN 5 AND 8
  UNION ALL SELECT 'code', CASE r WHEN 0 THEN 'timestamp_regression' ELSE 'timestamp_duplicate' END FROM c WHERE k > 5 AND b NOT IN (2, 10) AND r < 2),
counts AS (SELECT kind, name, count(*) AS n FROM items GROUP BY 1, 2)"""


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of channel pairs, one row an event: session, layout, hypothesis, correlations, lag, coherence, frequencies."""
    e = F.col("event_id")
    a, b = F.when(e % 8 > 0, 1 + e % 5 * 0.1), 1 + e * 3 % 5 * 0.1
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).alias("session"), F.when(e % 2 == 0, "INTERLEAVED_PACKET_LOCAL").otherwise("BLOCKED_PACKET_LOCAL").alias("layout"), F.when(e % 3 == 0, "H_3x22:default").otherwise("H_2x33:default").alias("hypothesis"),
        ((e * 37 % 201 - 100) / 100.0).alias("zero_lag"), ((e * 53 + F.col("user_id") * 7) % 60 / 100.0).alias("max_xcorr"), (e * 7 % 41 - 20).alias("best_lag"), F.when(e % 9 > 0, e * 29 % 37 / 100.0).alias("coherence"), a.alias("dom_a"), b.alias("dom_b"),
        F.when((e + F.col("user_id")) % 6 == 0, F.array(F.lit("too_short"))).when(e % 5 == 0, F.array(F.lit("zero_variance"), F.lit("inverted_channels"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    rel = F.abs(F.col("dom_a") - F.col("dom_b")) / ((F.col("dom_a") + F.col("dom_b")) / 2)
    return rows.withColumn("rel_diff", rel).withColumn("agree", F.coalesce(rel <= 0.25 + 1e-9, F.lit(False)))


PAIR_ROWS_SQL = """pair_rows AS (SELECT *, coalesce(rel_diff <= 0.25::DOUBLE + 1e-9::DOUBLE, false) AS agree FROM (SELECT *, abs(dom_a - dom_b) / ((dom_a + dom_b) / 2) AS rel_diff FROM (
  SELECT user_id % 40 AS session, CASE WHEN event_id % 2 = 0 THEN 'INTERLEAVED_PACKET_LOCAL' ELSE 'BLOCKED_PACKET_LOCAL' END AS layout, CASE WHEN event_id % 3 = 0 THEN 'H_3x22:default' ELSE 'H_2x33:default' END AS hypothesis,
    (event_id * 37 % 201 - 100) / 100.0::DOUBLE AS zero_lag, (event_id * 53 + user_id * 7) % 60 / 100.0::DOUBLE AS max_xcorr, event_id * 7 % 41 - 20 AS best_lag, CASE WHEN event_id % 9 > 0 THEN event_id * 29 % 37 / 100.0::DOUBLE END AS coherence,
    CASE WHEN event_id % 8 > 0 THEN 1 + event_id % 5 * 0.1::DOUBLE END AS dom_a, 1 + event_id * 3 % 5 * 0.1::DOUBLE AS dom_b,
    CASE WHEN (event_id + user_id) % 6 = 0 THEN ['too_short'] WHEN event_id % 5 = 0 THEN ['zero_variance', 'inverted_channels'] ELSE [] END AS reasons FROM events)))"""
