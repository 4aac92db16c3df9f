"""Behavior log import: raw CSV/TSV lines, multi-file unions and typed rebuilds.

All readers work on DataFrames (raw text lines with ``value`` / ``line_no``,
or CSV files already read by ``spark.read.csv``), so files of any size are
parsed in parallel; header and delimiter follow from the first line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.functions.columns import (
    ACTIONS,
    action_names_or_codes,
    first_rows_by,
    int_or_null,
    long_or_null,
    parse_event_ts,
    project_once,
    resolve_columns,
    strip_ws,
)

# ---------------------------------------------------------------------------
# Fixed values of the analysed application
# ---------------------------------------------------------------------------
HEAD_CHARS = 1024
CSV_FIELDS = ("user_id", "item_id", "category_id", "behavior", "timestamp")
MULTI_FILE_COLUMNS = ("user_id", "item_id", "behavior_type", "user_geohash", "item_category", "time")
REBUILD_TS_FORMATS = ("yyyy-MM-dd HH", "yyyy-MM-dd HH:mm:ss")


def _head(lines: DataFrame) -> tuple[Column, Column]:
    """(comma-delimited?, line number) of the first line, over the whole input."""
    first = lines.agg(F.min(F.struct("line_no", "value")).alias("h")).select("h.line_no", F.substring("h.value", 1, HEAD_CHARS).alias("text"))
    count = lambda mark: F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit("")))
    head = first.select("line_no", (count(",") > count("\t")).alias("comma"))
    return head.select("comma").scalar(), head.select("line_no").scalar()


def _fields(line: Column, delimiter: str) -> Column:
    """The five fields of a CSV line as a struct: quotes group, a doubled quote is one quote, missing fields are NULL."""
    schema = ", ".join(f"{name} string" for name in CSV_FIELDS)
    return F.from_csv(line, F.lit(schema), {"sep": delimiter, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "emptyValue": ""})


def import_behavior_csv(lines: DataFrame, limit: int | None = None,
                        delimiter: str | None = None) -> DataFrame:
    """Raw 5-field user/item/category/behavior/timestamp lines -> behavior rows.

    Fields may be quoted.  Unless given, the delimiter is a comma when the
    first line (smallest ``line_no``) has more commas than tabs at its head; a
    first line whose first field is not all digits is a header; rows with fewer
    than 5 fields, a non-numeric time or an action other than pv/fav/cart/buy
    are skipped; times are truncated to whole seconds.  ``limit`` keeps the
    first N imported rows in file order.
    """
    if delimiter is None:
        is_comma, first_line = _head(lines)
        fields = F.when(is_comma, _fields(F.col("value"), ",")).otherwise(_fields(F.col("value"), "\t"))
    else:
        first_line = lines.select(F.min("line_no")).scalar()
        fields = _fields(F.col("value"), delimiter)
    parts = project_once(lines, ["line_no"], f=fields)
    header = (F.col("line_no") == first_line) & ~F.coalesce(F.col("f.user_id"), F.lit("")).rlike(r"^[0-9]+$")
    rows = parts.where(~header & F.col("f.timestamp").isNotNull()).select(
        "line_no", *[strip_ws(F.coalesce(F.col("f")[n], F.lit(""))).alias(n) for n in CSV_FIELDS])
    ts_d = F.col("timestamp").try_cast("double")
    ts_ok = ts_d.isNotNull() & ~F.isnan(ts_d) & (F.abs(ts_d) < F.lit(9.2e18))
    out = rows.select(
        "line_no", "user_id", "item_id", F.lower("behavior").alias("behavior"),
        F.when(ts_ok, ts_d.cast("bigint")).alias("timestamp"), "category_id")
    out = out.where(F.col("timestamp").isNotNull() & F.col("behavior").isin(*ACTIONS))
    if limit:
        out = first_rows_by(out, "line_no", int(limit))
    return out.drop("line_no")


def _first_rows(df: DataFrame, n: int | None) -> DataFrame:
    if not n:
        return df
    if "_line" not in df.columns:
        raise ValueError("a row limit needs a _line column for file order")
    return first_rows_by(df, "_line", int(n))


def _map_behavior_code(c: Column) -> Column:
    """Integer-like values 1..4 become names; anything else is kept as text."""
    s = c.cast("string")
    t = strip_ws(s)
    as_int = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))
    names = F.create_map(*[x for i, a in enumerate(ACTIONS, 1) for x in (F.lit(i), F.lit(a))])
    return F.coalesce(F.element_at(names, as_int), s)


def union_behavior_files(files: Sequence[DataFrame], nrows_each: int | None = None) -> DataFrame:
    """All rows of every file (or the first ``nrows_each`` by a ``_line`` column), ``Unnamed*``
    columns dropped, the six required columns kept, all files stacked, codes 1..4 named."""
    out = None
    for i, df in enumerate(files):
        df = df.select([c for c in df.columns if not c.startswith("Unnamed")])
        missing = [c for c in MULTI_FILE_COLUMNS if c not in df.columns]
        if missing:
            raise ValueError(f"file {i} lacks columns {missing}; has {df.columns}")
        part = _first_rows(df, nrows_each).select(
            *[F.col(c).cast("string").alias(c) for c in MULTI_FILE_COLUMNS])
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no files")
    return out.withColumn("behavior_type", _map_behavior_code(F.col("behavior_type")))


def rebuild_user_behavior(raw: DataFrame, limit: int = 0, order_by: str | None = None) -> DataFrame:
    """Typed behavior table from loose CSV columns.

    ids and category are tolerant casts, actions are names or codes 1..4 (other
    values lower-cased), an empty geohash is NULL, time is a cast or one of two
    text layouts.  ``limit`` > 0 keeps the first N rows by the integral column ``order_by``.
    """
    t = F.col("time").cast("string")
    ts = F.coalesce(t.try_cast("timestamp_ntz"),
                    *[F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in REBUILD_TS_FORMATS])
    src = raw
    if limit and limit > 0:
        if not order_by:
            raise ValueError("a row limit needs order_by")
        src = first_rows_by(src, order_by, int(limit))
    return src.select(
        long_or_null(F.col("user_id")).alias("user_id"),
        long_or_null(F.col("item_id")).alias("item_id"),
        action_names_or_codes(F.col("behavior_type")).alias("behavior_type"),
        F.nullif(F.col("user_geohash").cast("string"), F.lit("")).alias("user_geohash"),
        int_or_null(F.col("item_category")).alias("item_category"),
        ts.alias("timestamp"))


def event_ts(df: DataFrame, column: str = "time") -> DataFrame:
    """The tolerant event-time parse as a column ``ts`` next to the input."""
    return df.withColumn("ts", parse_event_ts(df, column))


def behavior_distribution(behavior: DataFrame, roles: dict | None = None) -> DataFrame:
    """Rows per action value, most frequent first."""
    r = resolve_columns(behavior, roles, required=("action",))
    return behavior.groupBy(F.col(r["action"]).alias("action")).agg(F.count(F.lit(1)).alias("cnt")) \
        .orderBy(F.col("cnt").desc(), F.col("action"))
