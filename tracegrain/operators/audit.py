"""Session audit: modality status, and rules that a session's columns and JSON cells must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.functions import names
from tracegrain.functions.store import stored, tasks_for

from .cells import cell_status, column_profile
from .walk import WALKED, walk

EMPTY = ["null", "empty", "empty_array", "empty_object"]
STATUSES = ["column_absent", "payload_empty", "payload_malformed", "samples_present", "structure_present_no_samples", "not_evaluable"]
JSON_KINDS = ["json_like", "mixed_malformed"]
# fixed values: names of the fields of an upload and of a duration
SENT = ("sent", "chunks_sent", "sent_chunks")
TOTAL = ("total", "chunks_total", "total_chunks")
FAILED = ("failed", "chunks_failed", "failed_chunks")
PENDING = ("pending", "upload_pending", "pending_upload")
DURATION = ("duration", "session_duration", "duration_s", "duration_ms", "duration_sec")


def unpivot(sessions: DataFrame, key: str = "session") -> DataFrame:
    """Cells of a wide table of text: key, col_pos, column, cell (null: empty)."""
    columns = [c for c in sessions.columns if c != key]
    each = F.array(*[F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`"), F.lit("")).alias("cell")) for i, c in enumerate(columns)])
    return sessions.select(key, F.explode(each).alias("x")).select(key, "x.*")


def with_status(cells: DataFrame) -> DataFrame:
    """Cells with their status and their column's kind; columns are few, so kinds are a small table."""
    cells = cells.repartition(tasks_for(cells))  # parsing is dear, and a table may come in one file
    told = stored(cells.withColumn("status", cell_status(F.col("cell"))), "cell-statuses")  # read twice; parsing is dear
    return told.join(F.broadcast(column_profile(told).select("column", "kind")), "column")


def json_nodes(cells: DataFrame, key: str = "session", tasks: int | None = None, whole: bool = False) -> DataFrame:
    """Walked cells of the columns that hold JSON (``whole``: without the limits of a profile), dealt by session to as many
    tasks as their number asks for."""
    some = cells.where(F.col("kind").isin(JSON_KINDS))
    return walk(some.repartition(tasks or tasks_for(cells), key), [key, "col_pos", "column"], whole=whole)


def _may_hold_times(cell: Column) -> Column:
    """Whether some key of the cell's text has a word of a time field's name in it, or an escape that could hide one."""
    some = "|".join(sorted({max(n.split("_"), key=len) for n in names.TIME_FIELDS}))
    return F.regexp_like(cell, F.lit(f'(?i)"[^"]*({some})[^"]*"\\s*:|\\\\'))


def _by_name(rows: DataFrame, column: str, told: Column) -> DataFrame:
    """(``column``, told) of each different name of ``rows`` that tells something: an array, of which each element is a row.

    Both steps are stored. Otherwise the optimizer moves what is asked of a name, which is dear, below the distinct and
    over to the other side of joins, and asks it of every row.
    """
    names_ = stored(rows.select(column).distinct(), "names")
    return stored(names_.select(column, F.explode(told).alias("told")), "told-names")


def modality_statuses(cells: DataFrame, key: str = "session") -> DataFrame:
    """(key, modality, status) for every session and modality. ``cells`` come from ``with_status``.

    Names of columns and of paths count; a path's cell brings all its samples, once for the column and once for paths. Cells
    are walked whole: every value and every name counts, however deep, long or wide its cell.
    Names are matched once per distinct name; each session is then summed up by one aggregation.
    """
    tasks = tasks_for(cells)
    nodes = json_nodes(cells, key, tasks, whole=True)
    path_key = [key, "column", "path"]
    seen = stored(nodes.groupBy(*path_key).agg(F.sum("samples").alias("s")), "paths")  # looked at three times: cells are walked once
    seen, cells = seen.repartition(tasks, key), cells.repartition(tasks, key)  # so that nothing below shuffles by less than a session
    known = _by_name(seen.where(F.col("path") != ""), "path", names.modalities(F.col("path"))).withColumnRenamed("told", "modality")
    named = _by_name(cells, "column", names.modalities(F.col("column"))).withColumnRenamed("told", "modality")
    total = seen.groupBy(key, "column").agg(F.sum("s").alias("samples"))
    walked = F.col("status").isin(WALKED) & F.col("kind").isin(JSON_KINDS)
    by_column = cells.join(F.broadcast(named), "column").join(total, [key, "column"], "left").select(key, "modality", "status", F.lit(True).alias("is_column"), walked.alias("hit"), F.coalesce("samples", F.lit(0)).alias("samples"))
    hit_cells = seen.join(known, "path").select(key, "column", "modality").distinct()
    by_path = hit_cells.join(total, [key, "column"]).select(key, "modality", F.lit(None).cast("string").alias("status"), F.lit(False).alias("is_column"), F.lit(True).alias("hit"), F.coalesce("samples", F.lit(0)).alias("samples"))
    every = cells.select(key).distinct().select(key, F.explode(F.array(*[F.lit(m) for m in names.MODALITIES])).alias("modality"))
    none = every.select(key, "modality", F.lit(None).cast("string").alias("status"), F.lit(None).cast("boolean").alias("is_column"), F.lit(False).alias("hit"), F.lit(0).cast("long").alias("samples"))
    column = F.col("is_column")
    is_empty, is_bad = F.col("status").isin(EMPTY), F.col("status") == "malformed"
    each = by_column.unionByName(by_path).unionByName(none).repartition(tasks, key)  # merged partitions would grow with the table
    some = each.groupBy(key, "modality").agg(
        F.count_if(column).alias("columns"), F.count_if(column & is_empty).alias("empties"), F.count_if(column & is_bad).alias("bad"),
        F.count_if(column & F.col("status").isin(WALKED)).alias("populated"), F.max("hit").alias("hit"), F.sum("samples").alias("samples"))
    return some.select(key, "modality", _ladder().alias("status"))


def _ladder() -> Column:
    n, empties, bad, hit = F.col("columns"), F.col("empties"), F.col("bad"), F.col("hit")
    broken = (bad > 0) & ((bad == n) | (F.col("populated") == 0))
    out = F.when((n == 0) & ~hit, "column_absent").when(~hit & (empties == n), "payload_empty").when(~hit & broken, "payload_malformed")
    return out.when(F.col("samples") > 0, "samples_present").when(~hit & (empties > 0), "payload_empty").otherwise("structure_present_no_samples")


def modality_coverage(statuses: DataFrame) -> DataFrame:
    """Sessions of each modality and status, those without any included."""
    counts = statuses.groupBy("modality").pivot("status", STATUSES).agg(F.count(F.lit(1)))
    each = F.array(*[F.struct(F.lit(s).alias("status"), F.coalesce(F.col(s), F.lit(0)).alias("n")) for s in STATUSES])
    return counts.select("modality", F.explode(each).alias("x")).select("modality", "x.*")


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def numeric_fields(cells: DataFrame, key: str = "session") -> DataFrame:
    """Per session and field (sent, total, failed, pending, duration): the first matching column with a number, as
    ``ordinary``, and the first such key of an object cell, as ``nested``; each is (name, value)."""
    fields = {"sent": SENT, "total": TOTAL, "failed": FAILED, "pending": PENDING, "duration": DURATION}
    kind = lambda name: F.filter(F.array(*[F.when(names.matches_any(name, v), F.lit(k)) for k, v in fields.items()]), lambda x: x.isNotNull())
    named = F.broadcast(_by_name(cells, "column", kind(F.col("column"))).withColumnRenamed("told", "field"))
    top = cells.join(named, "column").select(key, "field", F.lit(0).alias("depth"), "col_pos", F.lit(0).alias("at"), F.col("column").alias("name"), _number(F.col("cell")).alias("value"))
    obj = cells.where(F.col("status") == "object").select(key, "col_pos", F.explode(F.map_entries(F.from_json("cell", "map<string,string>"))).alias("e"), "cell")
    keys = obj.select(key, "col_pos", F.col("e.key").alias("name"), _number(F.col("e.value")).alias("value"), F.array_position(F.json_object_keys("cell"), F.col("e.key")).cast("int").alias("at"))
    keys = stored(keys, "object-keys")
    known = _by_name(keys, "name", kind(F.col("name"))).withColumnRenamed("told", "field")
    deep = keys.join(known, "name").select(key, "field", F.lit(1).alias("depth"), "col_pos", "at", "name", "value")
    found = top.unionByName(deep).where(F.col("value").isNotNull())
    first = lambda d: F.min_by(F.when(F.col("depth") == d, F.struct("name", "value")), F.when(F.col("depth") == d, F.struct("col_pos", "at")))
    return found.groupBy(key, "field").agg(first(0).alias("ordinary"), first(1).alias("nested"))


def time_spans(nodes: DataFrame, key: str = "session") -> DataFrame:
    """Per session: whether there are time fields, and the span in seconds of the times whose unit is known, null for
    under two of them."""
    leaves = stored(nodes.where(F.col("leaf") != "").select(key, "leaf", "value"), "leaves")
    asked = F.when(names.is_time_field(F.col("leaf")), F.array(F.struct(names.time_unit(F.col("leaf")).alias("unit"))))
    known = _by_name(leaves, "leaf", asked).select("leaf", "told.unit")
    times = leaves.join(known, "leaf")
    scale = F.create_map(*[F.lit(x) for kv in names.UNIT_SECONDS.items() for x in kv])
    stamp = F.regexp_like("value", F.lit("^[0-9]{4}-"))
    at = F.when(stamp, F.when(F.col("unit").isNotNull(), F.unix_micros(F.try_to_timestamp("value")) / 1e6)).otherwise(F.col("value").try_cast("double") * scale[F.col("unit")])
    spans = times.groupBy(key).agg(F.count(at).alias("n"), (F.max(at) - F.min(at)).alias("s"))
    return spans.select(key, F.when(F.col("n") >= 2, F.col("s")).alias("span"))


def findings(cells: DataFrame, key: str = "session") -> DataFrame:
    """(key, code, column, detail) of all that does not agree. ``cells`` come from ``with_status``.

    Nested fields are used only where ``sent`` or ``total`` is no column of its own. Spans are those of all times, wherever they
    are in their cells.
    """
    asked = F.array(F.struct((F.size(names.modalities(F.col("column"))) > 0).alias("physio"), names.matches_any(F.col("column"), PENDING).alias("flag")))
    has_modality = F.broadcast(_by_name(cells, "column", asked).select("column", "told.*"))
    each = cells.join(has_modality, "column")
    is_json = F.col("kind").isin(JSON_KINDS)
    own = F.array(
        F.when(is_json & (F.col("status") == "malformed"), F.lit("invalid_json")),
        F.when(is_json & F.col("status").isin(EMPTY) & F.col("physio"), F.lit("empty_physiology")),
        F.when(F.col("flag") & F.lower(F.trim("cell")).isin("1", "true", "yes", "pending"), F.lit("pending_upload")),
    )
    per_cell = each.select(key, "column", F.explode(F.filter(own, lambda x: x.isNotNull())).alias("code")).select(key, "code", "column", F.col("code").alias("detail"))
    names_of = ["sent", "total", "failed", "pending", "duration"]
    wide = numeric_fields(cells, key).groupBy(key).pivot("field", names_of).agg(F.first(F.struct("ordinary", "nested")))
    missing = F.col("sent.ordinary").isNull() | F.col("total.ordinary").isNull()
    pick = {f: F.coalesce(F.col(f"{f}.ordinary"), F.when(missing, F.col(f"{f}.nested"))) if f != "duration" else F.col("duration.ordinary") for f in names_of}
    session = cells.select(key).distinct().join(wide, key, "left").select(key, *[c.alias(f) for f, c in pick.items()])
    session = session.join(time_spans(json_nodes(cells.where(_may_hold_times(F.col("cell"))), key, tasks_for(cells), whole=True), key).withColumn("timed", F.lit(True)), key, "left")
    per_session = session.select(key, F.inline(F.filter(F.array(*_session_rules()), lambda x: x.isNotNull())))
    return per_cell.unionByName(per_session)


def _session_rules() -> list[Column]:
    v = lambda f: F.col(f"{f}.value")
    name = lambda *fs: F.coalesce(*[F.col(f"{f}.name") for f in fs])
    unit = F.when(F.array_contains(names.tokens(name("duration")), "ms"), 1e-3).when(F.array_contains(names.tokens(name("duration")), "us"), 1e-6).when(F.arrays_overlap(names.tokens(name("duration")), F.array(*[F.lit(x) for x in names.UNIT_WORDS["s"]])), 1.0)
    seconds = v("duration") * unit
    known = seconds.isNotNull() & F.col("span").isNotNull()
    tried = F.col("duration").isNotNull() | F.coalesce("timed", F.lit(False))
    off = F.when(known & (seconds > 0), F.abs(F.col("span") - seconds) > 0.25 * seconds)
    row = lambda when, code, column, detail: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), column.alias("column"), F.lit(detail).alias("detail")))
    return [
        row(v("sent") > v("total"), "chunk_mismatch", name("sent", "total"), "sent_gt_total"),
        row(v("failed") > v("total"), "chunk_mismatch", name("failed", "total"), "failed_gt_total"),
        row(v("sent") + v("failed") > v("total") + 1e-9, "chunk_mismatch", name("total"), "sent_plus_failed_gt_total"),
        row(v("pending") > 0, "pending_upload", name("pending"), "pending_upload"),
        row(~known & tried, "duration_not_evaluable", name("duration"), "duration_not_evaluable"),
        row(off, "duration_mismatch", name("duration"), "duration_mismatch"),
    ]


def counts_by_code(found: DataFrame) -> DataFrame:
    """How many findings there are of each code, without the sessions they are in: what a safe report may show."""
    return found.groupBy("code").agg(F.count("*").alias("n"))
