"""Packets inside JSON cells: extraction, validation of their shape, payload parsing. Whole cells, JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.functions.ordering import previous
from tracegrain.functions.store import stored

from .cells import is_json, is_nullish

# fixed values: the keys of a packet and of its nested data
TOP = ["dataEnd", "dataType", "dicData", "receivedAtMs"]
NESTED = ["PPG", "Time"]
INTEGER = "^-?[0-9]+(\\.0+)?$"


EXPECTED_TYPE = "119"


def cell_states(sessions: DataFrame, cell: str = "raw_packets_json", key: str = "session_ordinal") -> DataFrame:
    """``key``, the cell and its ``state``: empty, malformed (another value than an array too) or packets."""
    is_array = F.regexp_like(cell, F.lit("^[ \\t\\r\\n]*\\[")) & is_json(F.trim(cell))
    state = F.when(is_nullish(F.col(cell)), "empty").when(is_array, "packets").otherwise("malformed")
    return sessions.select(key, F.col(cell).alias("cell"), state.alias("state"))


def packet_rows(sessions: DataFrame, cell: str = "raw_packets_json", key: str = "session_ordinal") -> DataFrame:
    """One row a packet (``key``, packet_ordinal, packet as JSON text); cells that hold no array give none."""
    return _packets(cell_states(sessions, cell, key), key)


def _packets(states: DataFrame, key: str) -> DataFrame:
    items = F.from_json(F.when(F.col("state") == "packets", F.trim("cell")), "array<string>")
    return states.select(key, F.posexplode(items).alias("packet_ordinal", "packet"))


def _with_payload(rows: DataFrame, raw: str) -> DataFrame:
    """``rows`` with _values and _code of the payload text ``raw``, which is an array, or text that holds one. Each step is a
    projection of its own, so that no text is parsed twice."""
    text = F.when(F.startswith(F.trim(raw), F.lit("[")), F.col(raw))
    items = rows.withColumn("_items", F.from_json(text, "array<string>"))
    whole = items.withColumn("_whole", F.forall("_items", lambda x: x.isNotNull() & F.regexp_like(x, F.lit(INTEGER))))
    ints = whole.withColumn("_values", F.when(F.col("_whole"), F.transform("_items", lambda x: F.regexp_replace(x, "\\.0+$", "").try_cast("long"))))
    broken = F.when(F.try_parse_json(raw).isNull(), "ppg_json_malformed").when(F.col("_items").isNull(), "ppg_not_array").otherwise("ppg_non_integer")
    code = F.when(F.col(raw).isNull(), "ppg_missing").when(F.col("_whole") & F.try_parse_json(raw).isNotNull(), None).otherwise(broken)
    return ints.withColumn("_code", code).withColumn("_values", F.when(F.col("_code").isNull(), F.col("_values"))).drop("_items", "_whole")


def validated(packets: DataFrame) -> DataFrame:
    """``packets`` with data_type, received_at_ms, nested_time, payload, schema_ok and the codes of what is wrong."""
    j = F.col("packet")
    is_object = lambda c: F.when(F.startswith(F.trim(c), F.lit("{")), F.col(c))
    top = F.array(*[F.lit(k) for k in TOP])
    found = packets.select("*", F.json_object_keys(is_object("packet")).alias("_k"), F.json_tuple(j, "dataType", "receivedAtMs", "dicData").alias("_type", "_r", "_d"))
    row = _with_payload(found.select("*", F.json_object_keys(is_object("_d")).alias("_dk"), F.get_json_object(j, "$.dicData.PPG").alias("_ppg")), "_ppg")
    missing, extra = F.size(F.array_except(top, "_k")) > 0, F.size(F.array_except("_k", top)) > 0
    ms = F.when(F.regexp_like("_r", F.lit("^-?[0-9]+(\\.0+)?$")), F.regexp_replace("_r", "\\.0+$", "").try_cast("long"))
    bad = [
        (F.col("_k").isNull(), "packet_not_object"), (missing, "missing_top_keys"), (extra, "extra_top_keys"), (F.col("_r").isNotNull() & ms.isNull(), "received_at_invalid"),
        (F.col("_k").isNotNull() & F.col("_dk").isNull(), "dicdata_missing"), (F.size(F.array_except(F.array(*[F.lit(k) for k in NESTED]), "_dk")) > 0, "dicdata_missing_keys"),
    ]
    codes = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in bad], F.when(F.col("_dk").isNotNull(), F.col("_code"))), lambda x: x.isNotNull())
    out = row.select(*packets.columns, F.col("_type").alias("data_type"), ms.alias("received_at_ms"), F.get_json_object(j, "$.dicData.Time").try_cast("double").alias("nested_time"), F.col("_values").alias("payload"), codes.alias("codes"))
    return out.withColumn("schema_ok", F.size("codes") == 0)


def usable(packets: DataFrame, length: int = 66) -> DataFrame:
    """Packets with a time and a payload of ``length``; sessions left without any vanish."""
    return packets.where(F.col("payload").isNotNull() & F.col("received_at_ms").isNotNull() & (F.size("payload") == length))


def validation(sessions: DataFrame, cell: str = "raw_packets_json", key: str = "session_ordinal", length: int = 66) -> DataFrame:
    """All that is counted over the packets of ``sessions``, as rows (kind, name, n): ``schema`` (ok, anomaly), ``data_type``
    and ``payload_length`` (``<missing>`` where there is none), ``code``, and ``nested``, the codes of broken payloads.

    A packet's time is compared with the last one before it in its session that has any. Codes that a session's cell gets
    (cell_empty, cell_malformed) count once; kinds and names are few, so the result is small.
    """
    cells = stored(cell_states(sessions, cell, key), "packet-cells")  # told apart once, looked at twice
    states = cells.where(F.col("state") != "packets").select(F.concat(F.lit("cell_"), "state").alias("name"))
    told = stored(validated(_packets(cells, key)).select(key, "packet_ordinal", "received_at_ms", "data_type", "payload", "schema_ok", "codes"), "packets")
    packets = previous(told, [key], "packet_ordinal", "received_at_ms", "_before")  # by blocks, as a cell may hold very many
    before = F.col("_before")
    size = F.size("payload")
    has, typed = F.col("payload").isNotNull(), F.coalesce(F.col("data_type") == EXPECTED_TYPE, F.lit(False))
    late = F.when(F.col("received_at_ms") < before, "timestamp_regression").when(F.col("received_at_ms") == before, "timestamp_duplicate")
    more = F.array(late, F.when(~typed, "datatype_unexpected"), F.when(has & (size != length), "payload_length_mismatch"))
    fine = has & (size == length) & F.col("schema_ok") & typed
    item = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    each = packets.select(F.col("codes"), more.alias("more"), fine.alias("fine"), F.coalesce("data_type", F.lit("<missing>")).alias("type"), F.when(has, size.cast("string")).otherwise("<missing>").alias("size"))
    codes = F.concat("codes", F.filter("more", lambda x: x.isNotNull()))
    nested = F.filter("codes", lambda x: F.startswith(x, F.lit("ppg_")))
    rows = each.select(F.inline(F.concat(
        F.array(item("schema", F.when(F.col("fine"), "ok").otherwise("anomaly")), item("data_type", F.col("type")), item("payload_length", F.col("size"))),
        F.transform(codes, lambda c: item("code", c)), F.transform(nested, lambda c: item("nested", c)))))
    return rows.unionByName(states.select(F.lit("code").alias("kind"), "name")).groupBy("kind", "name").agg(F.count("*").alias("n"))


def rates(counts: DataFrame) -> DataFrame:
    """From validation(): packets, the most frequent data type (of equals the first by name), and the shares of packets with
    an anomaly and with a broken payload."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    is_type = F.col("kind") == "data_type"
    row = counts.agg(n(F.col("kind") == "schema").alias("packets"), n((F.col("kind") == "schema") & (F.col("name") == "anomaly")).alias("a"), n(F.col("kind") == "nested").alias("b"), F.min_by(F.when(is_type, F.col("name")), F.when(is_type, F.struct(-F.col("n"), F.col("name")))).alias("data_type_mode"))
    whole = F.greatest("packets", F.lit(1))
    return row.select("packets", "data_type_mode", (F.col("a") / whole).alias("schema_anomaly_rate"), (F.col("b") / whole).alias("malformed_nested_rate"))
