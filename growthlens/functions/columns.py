"""Column-level helpers shared by the operators.

Everything here returns a ``Column`` built from Spark's built-in expressions,
so it stays inside whole-stage code generation.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.session import settle

# ---------------------------------------------------------------------------
# Fixed values of the analysed application
# ---------------------------------------------------------------------------
# behavior action names and the numeric codes 1..4 used by the raw logs
ACTIONS = ("pv", "fav", "cart", "buy")
ACTION_CODES = {"1": "pv", "2": "fav", "3": "cart", "4": "buy"}

# candidate column names per role, tried in this order
ROLE_CANDIDATES = {
    "user": ("user_id", "userid", "uid", "user"),
    "item": ("item_id", "itemid", "iid", "item"),
    "action": ("behavior_type", "behavior", "action", "event_type", "type"),
    "ts": ("ts", "timestamp", "time", "event_time"),
}

# accepted text layouts of a timestamp string, tried after a plain cast
TS_FORMATS = ("yyyy-MM-dd HH", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")

# first number of a price text
PRICE_PATTERN = r"(\d+(\.\d+)?)"

# category aliases of the catalog importer
CATEGORY_ALIASES = {"3c": "Electronics", "3C": "Electronics", "electronics": "Electronics"}


# ---------------------------------------------------------------------------
# schema helpers (driver-side, no data pass)
# ---------------------------------------------------------------------------
def pick_column(columns: Sequence[str], candidates: Iterable[str],
                case_insensitive: bool = True) -> str | None:
    """First candidate present in ``columns`` (optionally ignoring case)."""
    if case_insensitive:
        lower = {c.lower(): c for c in columns}
        for cand in candidates:
            if cand.lower() in lower:
                return lower[cand.lower()]
        return None
    for cand in candidates:
        if cand in columns:
            return cand
    return None


def resolve_columns(df: DataFrame, roles: Mapping[str, str | None] | None = None,
                    required: Sequence[str] = ("user", "item", "action", "ts")) -> dict[str, str]:
    """Map roles (user/item/action/ts) to actual column names.

    Explicit names in ``roles`` win; otherwise the candidate lists are tried
    case-insensitively.  A missing required role raises with the candidates.
    """
    roles = dict(roles or {})
    out: dict[str, str] = {}
    for role, cands in ROLE_CANDIDATES.items():
        name = roles.get(role) or pick_column(df.columns, cands)
        if name is None:
            if role in required:
                raise ValueError(
                    f"no {role} column: candidates={list(cands)} actual={df.columns}")
            continue
        out[role] = name
    return out


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


# ---------------------------------------------------------------------------
# timestamps
# ---------------------------------------------------------------------------
def ntz_literal(value) -> Column:
    """A TIMESTAMP_NTZ literal from a datetime / date / ISO text.

    Built from ISO text: a Python ``datetime`` literal would pass through the
    driver's local time zone and then the session's, shifting wall-clock values
    whenever the two differ.
    """
    if isinstance(value, _dt.datetime):
        text = value.replace(tzinfo=None).isoformat(sep=" ")
    elif isinstance(value, _dt.date):
        text = value.isoformat()
    else:
        text = None if value is None else str(value)
    return F.lit(text).cast("timestamp_ntz")


def _epoch_ntz() -> Column:
    return ntz_literal("1970-01-01 00:00:00")


def parse_event_ts(df: DataFrame, name: str) -> Column:
    """Tolerant event time as TIMESTAMP_NTZ.

    Timestamps pass through, integral numbers are epoch seconds, strings are a
    plain cast or one of ``TS_FORMATS``; anything else is NULL.
    """
    dt = _dtype(df, name)
    c = F.col(name)
    if isinstance(dt, T.TimestampNTZType):
        return c
    if isinstance(dt, T.TimestampType):
        return c.cast("timestamp_ntz")
    if isinstance(dt, T.DateType):
        return c.cast("timestamp_ntz")
    if isinstance(dt, (T.LongType, T.IntegerType, T.ShortType)):
        return F.timestamp_seconds(c).cast("timestamp_ntz")
    s = c.cast("string")
    parsed = [s.try_cast("timestamp_ntz")]
    parsed += [F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz") for fmt in TS_FORMATS]
    return F.coalesce(*parsed)


def epoch_seconds(ts: Column) -> Column:
    """Whole epoch seconds of a TIMESTAMP_NTZ, rounding half to even.

    Computed as a difference of wall-clock values, so it does not depend on
    the session time zone.
    """
    micros = F.timestamp_diff("MICROSECOND", _epoch_ntz(), ts)
    return F.bround(micros / F.lit(1e6), 0).cast("bigint")


def epoch_millis(ts: Column) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ (truncating sub-millisecond parts)."""
    return F.timestamp_diff("MILLISECOND", _epoch_ntz(), ts)


def as_ts_column(value, default: Column | None = None) -> Column:
    """An ``as_of`` argument as a TIMESTAMP_NTZ column.

    Accepts a Column (e.g. a scalar subquery), a datetime/date or an ISO
    string; ``None`` means the current time.
    """
    if value is None:
        return default if default is not None else F.localtimestamp()
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return ntz_literal(value)


def as_date_column(value) -> Column:
    """An ``as_of`` argument as a DATE column (``None`` = today)."""
    if value is None:
        return F.current_date()
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, _dt.datetime):
        return F.lit(value.date())
    if isinstance(value, _dt.date):
        return F.lit(value)
    return F.lit(str(value)).cast("date")


# ---------------------------------------------------------------------------
# action codes
# ---------------------------------------------------------------------------
def _whole_number(c: Column, kind: str) -> Column:
    """Number text as a whole number, as a SQL cast reads it; NULL for other text or out of range.

    Decimal notation ("1.0", "12.5") is accepted and rounded half away from
    zero.  Only text matching the pattern reaches the cast: a failing cast
    inside a conditional takes Spark's exception path (microseconds per row),
    which a pattern check avoids.
    """
    s = F.trim(c.cast("string"))
    plain = s.rlike(r"^[+-]?[0-9]{1,18}$")
    decimal = s.rlike(r"^[+-]?([0-9]{1,18}\.[0-9]{0,18}|\.[0-9]{1,18})$")
    return F.when(plain, s.try_cast(kind)).when(
        decimal, F.round(s.try_cast("decimal(38,18)"), 0).cast("decimal(20,0)").try_cast(kind))


def int_or_null(c: Column) -> Column:
    """Integer value of number text, else NULL."""
    return _whole_number(c, "int")


def long_or_null(c: Column) -> Column:
    """Long value of number text, else NULL."""
    return _whole_number(c, "bigint")


def _code_map() -> Column:
    return F.create_map(*[x for k, v in ACTION_CODES.items() for x in (F.lit(k), F.lit(v))])


def action_from_int_or_text(c: Column) -> Column:
    """Integer-looking values map 1..4 to names (others NULL); text is lower-cased."""
    as_int = int_or_null(c)
    return F.when(as_int.isNotNull(), F.element_at(_code_map(), as_int.cast("string"))) \
        .otherwise(F.lower(c.cast("string")))


def action_names_or_codes(c: Column) -> Column:
    """Names pass (case-insensitive), codes 1..4 become names, others lower-cased."""
    low = F.lower(c.cast("string"))
    as_int = int_or_null(c)
    return F.when(low.isin(*ACTIONS), low) \
        .when(as_int.between(1, 4), F.element_at(_code_map(), as_int.cast("string"))) \
        .otherwise(low)


def action_strict(c: Column) -> Column:
    """Trimmed, lower-cased name or code mapped to one of the four actions, else NULL."""
    k = F.lower(strip_ws(c))
    return F.when(k.isin(*ACTIONS), k).otherwise(F.element_at(_code_map(), k))


def is_buy(c: Column) -> Column:
    """Buy predicate of the retention metrics: 'buy' in any case, or code 4."""
    s = c.cast("string")
    return (F.lower(s) == "buy") | (s == "4")


# ---------------------------------------------------------------------------
# catalog text
# ---------------------------------------------------------------------------
def parse_price(c: Column) -> Column:
    """Commas removed, first ``\\d+(\\.\\d+)?`` taken as a double; NULL if none."""
    cleaned = F.regexp_replace(c.cast("string"), ",", "")
    found = F.regexp_extract(cleaned, PRICE_PATTERN, 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def category_alias(c: Column) -> Column:
    """Trimmed category name, with the importer's aliases applied."""
    t = strip_ws(c)
    m = F.create_map(*[x for k, v in CATEGORY_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, t), t)


# characters Python's str.strip() removes (all of them lie below U+3001)
_PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip_ws(c: Column) -> Column:
    """Leading and trailing whitespace removed, as Python's ``str.strip()`` does."""
    return F.btrim(c.cast("string"), F.lit(_PY_WHITESPACE))


def norm_category(c: Column) -> Column:
    """Category key for matching: trimmed, lower case, spaces as underscores."""
    return F.replace(F.lower(strip_ws(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit("_"))


def first_text(*cols: Column) -> Column:
    """First value that is neither NULL nor empty (Python's ``a or b``)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


# ---------------------------------------------------------------------------
# ratios
# ---------------------------------------------------------------------------
def ratio_or_null(num: Column, den: Column) -> Column:
    """num / den as double, NULL when den is 0 (SQL ``NULLIF``)."""
    return num.cast("double") / F.nullif(den, F.lit(0)).cast("double")


def ratio_or_zero(num: Column, den: Column, scale: float = 1.0) -> Column:
    """(num / den) * scale as double, 0.0 when den is not positive."""
    q = num.cast("double") / den.cast("double")
    if scale != 1.0:
        q = q * F.lit(float(scale))
    return F.when(den > 0, q).otherwise(F.lit(0.0))


def fetch_scalar(df: DataFrame):
    """The single value of a one-row, one-column aggregate (a bounded driver fetch).

    Used for data-dependent constants (an anchor day, an as-of date): as a
    literal the value is computed once and can be pushed into file scans,
    where a scalar subquery would be re-planned for every reference.
    """
    row = df.first()
    return None if row is None else row[0]


def _cutoff(df: DataFrame, key: Column, n: int, buckets: int = 4096):
    """(value of the n-th smallest ``key``, rows still wanted at that value), or None if there are fewer rows.

    A histogram over at most ``buckets`` equal value ranges (a bounded fetch)
    locates the range that holds the n-th row; the search goes on inside it
    until the range is a single value.
    """
    lo, hi, total = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if total is None or total <= n:
        return None
    while lo < hi:
        width = -(-(hi - lo + 1) // buckets)
        inside = df.where(key.between(F.lit(lo), F.lit(hi)))
        counts = dict(inside.groupBy(F.floor((key - F.lit(lo)) / F.lit(width)).cast("bigint")).count().collect())
        for b in sorted(counts):
            if counts[b] >= n:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            n -= counts[b]
    return lo, n


def first_rows_by(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest ``order_col`` (integral; e.g. a line number).

    One method at every size: the order column and a hash of each row are written
    once, the cutoff is searched in those two columns, then every task filters its own rows; rows that are
    parsed from text are thus parsed once for the search, and again only as far as the cutoff.
    Rows tied at the cutoff are taken by the hash; rows equal in that too are repeats of
    each other.  Rows without an order value come last and are not taken.
    """
    n = int(n)
    key = F.col(order_col).cast("bigint")
    tie = F.shiftright(F.xxhash64(*df.columns), 12)
    narrow = settle(df.select(key.alias("k"), tie.alias("t")))
    cut = _cutoff(narrow, F.col("k"), n)
    if cut is None:
        return df.where(key.isNotNull())
    value, wanted = cut
    below, at = df.where(key < F.lit(value)), df.where(key == F.lit(value))
    cut = _cutoff(narrow.where(F.col("k") == F.lit(value)), F.col("t"), wanted)
    if cut is None:
        return df.where(key <= F.lit(value))
    t, wanted = cut
    return below.unionByName(at.where(tie < F.lit(t))).unionByName(at.where(tie == F.lit(t)).limit(wanted))


def project_once(df: DataFrame, keep: Sequence[str], **named: Column) -> DataFrame:
    """Columns ``keep`` plus the ``named`` expressions, each computed once per row.

    The expressions go through a one-row generator: the optimizer does not
    rewrite later filters or projections into a generator's input, so an
    expensive expression (JSON parse, split, a wide CASE upstream) is not
    re-evaluated for every later reference to its result.
    """
    packed = F.struct(*[c.alias(n) for n, c in named.items()])
    return df.select(*keep, F.inline(F.array(packed)))


def nonfinite_to_null(c: Column) -> Column:
    """NaN and +/-Infinity become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)
