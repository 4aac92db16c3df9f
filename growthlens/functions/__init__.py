"""Column-level helpers."""

from growthlens.functions.columns import (  # noqa: F401
    ACTIONS,
    action_from_int_or_text,
    action_names_or_codes,
    action_strict,
    as_date_column,
    as_ts_column,
    category_alias,
    epoch_millis,
    epoch_seconds,
    fetch_scalar,
    first_rows_by,
    first_text,
    int_or_null,
    long_or_null,
    is_buy,
    nonfinite_to_null,
    ntz_literal,
    norm_category,
    parse_event_ts,
    parse_price,
    pick_column,
    project_once,
    ratio_or_null,
    ratio_or_zero,
    resolve_columns,
    strip_ws,
)
