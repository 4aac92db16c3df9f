"""Catalog import from JSON-lines item metadata and reviews.

Readers take a DataFrame of raw lines in a ``value`` column -- what
``spark.read.text(path)`` returns for ``.jsonl`` and ``.jsonl.gz`` alike --
so the same operator runs on files at scale and on lines built in tests.  An
optional ``line_no`` column gives file order for the bounded-import limits.

Scalars are declared as strings in the JSON schema so numbers written as text
("4.5") are still read, then converted with ``try_cast``; malformed lines
yield NULL fields and are dropped with the id check, never failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.functions.columns import (
    category_alias,
    first_rows_by,
    parse_price,
    project_once,
    strip_ws,
)

_S = T.StringType()

META_SCHEMA = T.StructType([
    T.StructField("parent_asin", _S), T.StructField("title", _S),
    T.StructField("main_category", _S), T.StructField("categories", T.ArrayType(_S)),
    T.StructField("store", _S), T.StructField("price", _S),
    T.StructField("average_rating", _S), T.StructField("rating_number", _S),
])

REVIEW_SCHEMA = T.StructType([T.StructField(n, _S) for n in (
    "parent_asin", "asin", "user_id", "reviewerID", "rating", "overall", "timestamp",
    "unixReviewTime", "title", "reviewTitle", "text", "reviewText")])


def nonblank_lines(lines: DataFrame) -> DataFrame:
    """Lines stripped of surrounding whitespace, blank ones removed."""
    keep = [c for c in lines.columns if c != "value"]
    return project_once(lines, keep, value=strip_ws(F.col("value"))).where(F.col("value") != "")


def _parsed(nb: DataFrame, schema: T.StructType) -> DataFrame:
    """``raw_json``, ``line_no`` (if any) and the schema fields of each line.

    The parse sits in a generator so later filters on its fields are not
    pushed below it (which would parse every line once per referenced field).
    """
    keep = [c for c in nb.columns if c == "line_no"]
    return nb.select(F.col("value").alias("raw_json"), *keep,
                     F.inline(F.array(F.from_json("value", schema))))


def _first_n(df: DataFrame, n: int | None) -> DataFrame:
    """First ``n`` rows in file order (``line_no``); the import cap feature."""
    if not n:
        return df
    if "line_no" not in df.columns:
        raise ValueError("a row limit needs a line_no column for file order")
    return first_rows_by(df, "line_no", int(n))


def _json_list_text(arr: Column) -> Column:
    """A string array as ``json.dumps`` writes it: ``["a", "b"]``."""
    quoted = F.transform(arr, lambda x: F.regexp_extract(F.to_json(F.array(x)), r"^\[(.*)\]$", 1))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def _to_long(c: Column) -> Column:
    """Integer text or a number truncated toward zero."""
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))


def parse_item_meta(lines: DataFrame, category: str, meta_limit: int | None = None) -> DataFrame:
    """Item metadata lines -> items, stamped with the (aliased) import category."""
    nb = _first_n(nonblank_lines(lines), meta_limit)
    j = _parsed(nb, META_SCHEMA)
    asin = F.col("parent_asin")
    cats_null = F.col("raw_json").rlike(r'"categories"\s*:\s*null')
    cats = (F.when(F.col("categories").isNotNull(), _json_list_text(F.col("categories")))
            .when(cats_null, F.lit("null")).otherwise(F.lit("[]")))
    return j.where(asin.isNotNull() & (asin != "")).select(
        asin.alias("parent_asin"), "title", "main_category", cats.alias("categories_json"),
        "store", parse_price(F.col("price")).alias("price"),
        F.col("average_rating").try_cast("double").alias("average_rating"),
        _to_long(F.col("rating_number")).alias("rating_number"),
        "raw_json", category_alias(F.lit(category)).alias("category"),
        *[c for c in j.columns if c == "line_no"])


def _truthy_text(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _truthy_number(c: Column) -> Column:
    """Python truthiness of a JSON number read as text: NULL, '' and 0 are false."""
    return _truthy_text(c) & F.coalesce(c.try_cast("double") != 0, F.lit(True))


def _py_or(a: Column, b: Column, truthy=_truthy_text) -> Column:
    """Python's ``a or b``: ``a`` when truthy, otherwise ``b`` as it is."""
    return F.when(truthy(a), a).otherwise(b)


def parse_reviews(lines: DataFrame, category: str) -> DataFrame:
    """Review lines -> reviews, with the old field names as fallbacks."""
    j = _parsed(nonblank_lines(lines), REVIEW_SCHEMA)
    g = F.col
    asin = _py_or(g("parent_asin"), g("asin"))
    rating = _py_or(g("rating"), g("overall"), _truthy_number)
    ts = _py_or(_py_or(g("timestamp"), g("unixReviewTime"), _truthy_number), F.lit("0"), _truthy_number)
    return j.where(_truthy_text(asin)).select(
        asin.alias("parent_asin"), _py_or(g("user_id"), g("reviewerID")).alias("user_id"),
        rating.try_cast("double").alias("rating"),
        F.coalesce(_to_long(ts), F.lit(0).cast("bigint")).alias("timestamp"),
        _py_or(g("title"), g("reviewTitle")).alias("title"),
        _py_or(g("text"), g("reviewText")).alias("text"),
        "raw_json", category_alias(F.lit(category)).alias("category"),
        *[c for c in j.columns if c == "line_no"])


def reviews_for_items(lines: DataFrame, items: DataFrame, category: str,
                      scan_limit: int | None = None, reviews_limit: int | None = None) -> DataFrame:
    """Reviews of imported items only: scan at most ``scan_limit`` non-blank lines,
    keep at most ``reviews_limit`` matching reviews (both in file order)."""
    scanned = _first_n(nonblank_lines(lines), scan_limit)
    parsed = parse_reviews(scanned, category)
    keys = items.select("parent_asin").where(F.col("parent_asin").isNotNull())
    kept = parsed.join(keys, "parent_asin", "left_semi")
    return _first_n(kept, reviews_limit)


def category_import_counts(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items and reviews per import category, with a total row (``is_total``)."""
    marks = (items.select("category", F.lit(1).alias("i"), F.lit(0).alias("r"))
             .unionByName(reviews.select("category", F.lit(0).alias("i"), F.lit(1).alias("r"))))
    return marks.rollup("category").agg(
        F.sum("i").cast("bigint").alias("items"), F.sum("r").cast("bigint").alias("reviews"),
        (F.grouping_id() == 1).alias("is_total"))
