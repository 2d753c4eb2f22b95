"""SQL fragments shared by the checking queries."""

from __future__ import annotations

from lakeprofile.functions import patterns as P


def rounded(x: str, places: str | int) -> str:
    """Half-away rounding, the formula of the Spark side."""
    scale = f"pow(10.0, {places})"
    return (
        f"(case when abs({x}) * {scale} + 0.5 < 9007199254740992.0"
        f" then sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale} else {x} end)"
    )


def decimals(x: str) -> str:
    """Digits behind the point of the number's shortest text, less its exponent."""
    text = f"cast({x} as varchar)"
    digits = f"length(regexp_extract({text}, '\\.(\\d*?)0*(?:e.*)?$', 1))"
    exponent = f"coalesce(try_cast(nullif(regexp_extract({text}, 'e(.*)$', 1), '') as integer), 0)"
    return f"greatest({digits} - {exponent}, 0)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\t\\n\\v\\f\\r ]+|[\\t\\n\\v\\f\\r ]+$', '', 'g')"


def is_number(x: str) -> str:
    return f"regexp_matches({x}, '{P.NUMBER}')"


def profile(cells: str, keys: str, n_rows: str) -> str:
    """CTE chain giving the profile of ``cells(keys, ordinal, name, v)`` as ``profiled``.

    ``n_rows`` is a query (keys, n_rows) of the value rows.
    """
    key = f"{keys}, " if keys else ""
    join_rows = f"join n_rows_of using ({keys})" if keys else "cross join n_rows_of"
    sides = ", ".join(
        f"max(v) filter (where {s} = {i}) as {n}_{i}" for s, n in (("lo", "min"), ("hi", "max")) for i in (1, 2, 3)
    )
    places = "greatest(" + ", ".join(decimals(f"{n}_{i}") for n in ("min", "max") for i in (1, 2, 3)) + ")"
    return f"""
      cells as ({cells}),
      n_rows_of as ({n_rows}),
      sums as (select {key}ordinal, name, count(v) as n_values, {rounded('sum(v)', 2)} as total
               from cells group by all),
      d as (select distinct {key}ordinal, v from cells where v is not null),
      ranked as (select *, row_number() over (partition by {key}ordinal order by v) as lo,
                        row_number() over (partition by {key}ordinal order by v desc) as hi from d),
      ext as (select {key}ordinal, {sides} from ranked group by all),
      joined as (select * from sums left join ext using ({key}ordinal) {join_rows}),
      profiled as (
        select {key}ordinal, name, n_values, n_rows, min_1, min_2, min_3, max_1, max_2, max_3,
               total,
               {places} as precision,
               {rounded('total / n_values', 6)} as avg_exact,
               {rounded('total / n_values', places)} as avg,
               {rounded('total / n_rows', places)} as avg_compat
        from joined)"""
