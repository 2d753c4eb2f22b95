"""Finding the delimited table buried in a text, one text per row and without any shuffle.

A table is read from the bottom of the text: the last five non-blank lines may be a footer, the line above
them fixes the width and the column types, and the body runs upward until a line of another width. The body
must start (from below) with five value rows, so the verdict and the dialect depend only on the sixth to the
tenth line from the bottom; the whole text is split once, with the dialect already known.

All steps are array expressions over the lines of one text. Files above a size limit take the line-wise form
in `lakeprofile.operators.lines`, which yields the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.functions import patterns as P
from lakeprofile.functions import scalar as S
from lakeprofile.functions.rows import explode_computed
from lakeprofile.operators.profile import EXTREMES, averages

PROBE_DEPTH = P.FOOTER_LINES + P.MIN_VALUE_ROWS


def _accepted_by(probe: Column, delimiter: str) -> Column:
    """Whether the five probe lines are value rows of one width in a dialect."""
    rows = F.transform(probe, lambda line: S.split_fields_by(line, delimiter))
    one_width = F.size(F.array_distinct(F.transform(rows, F.size))) == 1
    return (F.size(probe) == P.MIN_VALUE_ROWS) & one_width & ~F.exists(rows, S.is_header_row)


def dialect(probe: Column) -> Column:
    """First accepted delimiter for the lines above the footer, NULL if there is no table."""
    return F.coalesce(*[F.when(_accepted_by(probe, d), F.lit(d)) for d, _ in P.DIALECTS])


def _line_positions(raw: Column) -> Column:
    """Zero-based positions of the non-blank lines."""
    return F.filter(F.transform(raw, lambda x, i: F.when(~S.is_blank(x), i)), lambda i: i.isNotNull())


def _stripped_lines(raw: Column, at: Column) -> Column:
    return F.transform(at, lambda i: S.strip(F.get(raw, i)))


def _probe(lines: Column) -> Column:
    """The sixth to tenth line from the bottom, empty for a shorter text."""
    n = F.size(lines)
    return F.when(n >= PROBE_DEPTH, F.slice(lines, n - (PROBE_DEPTH - 1), F.lit(P.MIN_VALUE_ROWS))).otherwise(
        F.array().cast("array<string>")
    )


def detected_dialect(text: Column) -> Column:
    """Delimiter of the table in a text, the same verdict as the full pass; NULL for no table."""
    raw = F.filter(S.split_lines(text), lambda x: ~S.is_blank(x))
    return S.let(raw, lambda kept: S.let(F.transform(_probe(kept), S.strip), dialect))


def _split_lines(lines: Column, delimiter: Column) -> Column:
    def by(d: str) -> Column:
        return F.transform(lines, lambda line: S.split_fields_by(line, d))

    rows = F.lit(None).cast("array<array<string>>")
    for d, _ in P.DIALECTS:
        rows = F.when(delimiter == d, by(d)).otherwise(rows)
    return rows


def _break_position(rows: Column, body_bottom: Column, width: Column) -> Column:
    """One-based position of the lowest line above the footer whose width differs, 0 if none does."""
    off = F.transform(F.slice(rows, F.lit(1), body_bottom), lambda x, i: F.when(F.size(x) != width, i + 1))
    return F.coalesce(F.array_max(off), F.lit(0))


def _column_numbers(rows: Column, position: Column, sentinels: Column | None) -> Column:
    """Numbers of one column, blanks, text and sentinels left out."""
    values = F.transform(rows, lambda x: S.literal_value(F.get(x, position)))
    if sentinels is not None:
        values = F.transform(values, lambda v: S.without_sentinel(v, F.get(sentinels, position)))
    return F.filter(values, S.is_finite)


def _column_profile(position: Column, name: Column, n_rows: Column, values: Column) -> Column:
    def from_parts(s: Column) -> Column:
        fields = {
            "ordinal": position.cast("int"), "name": name, "n_values": s["n"], "n_rows": n_rows,
            "min": s["min"], "max": s["max"], "total": s["total"],
        }
        fields |= averages(s["total"], s["n"], n_rows, s["min"], s["max"])
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def summed(v: Column) -> Column:
        return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x))

    def from_sorted(v: Column, ordered: Column) -> Column:
        n = F.size(ordered)
        largest = F.slice(ordered, F.greatest(n - (EXTREMES - 1), F.lit(1)), F.lit(EXTREMES))
        parts = F.struct(
            F.size(v).cast("long").alias("n"),
            F.slice(ordered, F.lit(1), F.lit(EXTREMES)).alias("min"),
            F.reverse(largest).alias("max"),
            summed(v).alias("total"),
        )
        return S.let(parts, from_parts)

    return S.let(values, lambda v: S.let(F.sort_array(F.array_distinct(v)), lambda o: from_sorted(v, o)))


def _table_names(heads: Column, width: Column, first: Column) -> Column:
    """Lower-cased fields of the topmost header row whose fields differ, placeholders otherwise."""
    unique = F.filter(heads, lambda x: F.size(F.array_distinct(x)) == width)
    placeholders = F.transform(first, lambda _, i: F.concat(F.lit("__"), i.cast("string"), F.lit("__")))
    return S.let(
        F.transform(F.get(unique, F.lit(0)), F.lower),
        lambda top: F.when(F.size(F.array_distinct(top)) == width, top).otherwise(placeholders),
    )


def _preamble(raw: Column, at: Column, break_position: Column) -> Column:
    """Up to a thousand characters of text ending with the line that broke the table off."""
    last = F.get(at, break_position - 1)
    first = F.greatest(last - P.PREAMBLE_CHARS, F.lit(0))
    text = F.array_join(F.slice(raw, first + 1, last - first + 1), "\n")
    return F.when(break_position > 0, F.right(text, F.lit(P.PREAMBLE_CHARS)))


def find_tables(
    files: DataFrame,
    text: str = "text",
    sentinels: str | None = None,
) -> DataFrame:
    """Add a struct ``found`` describing the table in each text, NULL where there is none.

    Fields: delimiter, width, n_rows, types, names, headers, preamble and ``columns``, the profiles of the
    numeric columns. ``sentinels`` names an array column with one value per ordinal (NULL or 0 for none) whose
    neighbourhood is left out of the aggregates.
    """
    hidden = F.col(sentinels) if sentinels is not None else None

    def described(raw: Column, at: Column, delimiter: Column, rows: Column, first: Column, brk: Column) -> Column:
        width, body_bottom = F.size(first), F.size(rows) - P.FOOTER_LINES
        body = F.slice(rows, brk + 1, body_bottom - brk)
        footer = F.filter(F.slice(rows, body_bottom + 1, F.lit(P.FOOTER_LINES)), lambda x: F.size(x) == width)

        def assembled(p: Column) -> Column:
            heads, values, names, types = p["heads"], p["values"], p["names"], p["types"]
            cells, counted = F.concat(values, p["footer"]), F.size(values).cast("long")

            def columns(cell_rows: Column) -> Column:
                profiles = F.transform(
                    types,
                    lambda t, i: F.when(
                        t == "num",
                        _column_profile(i, F.get(names, i), counted, _column_numbers(cell_rows, i, hidden)),
                    ),
                )
                return F.filter(profiles, lambda x: x.isNotNull())

            return F.struct(
                delimiter.alias("delimiter"),
                width.alias("width"),
                F.size(values).cast("long").alias("n_rows"),
                types.alias("types"),
                names.alias("names"),
                F.sort_array(F.array_distinct(F.flatten(F.transform(heads, S.header_names)))).alias("headers"),
                _preamble(raw, at, brk).alias("preamble"),
                S.let(cells, columns).alias("columns"),
            )

        def named(b: Column) -> Column:
            def told_apart(rows_: Column) -> Column:
                parts = S.let(
                    F.filter(rows_, lambda x: x["is_head"])["row"],
                    lambda h: F.struct(
                        h.alias("heads"),
                        F.filter(rows_, lambda x: ~x["is_head"])["row"].alias("values"),
                        footer.alias("footer"),
                        _table_names(h, width, first).alias("names"),
                        F.transform(first, lambda x: F.when(S.is_number(x), "num").otherwise("str")).alias("types"),
                    ),
                )
                return S.let(parts, assembled)

            return S.let(F.transform(b, lambda x: F.struct(S.is_header_row(x).alias("is_head"), x.alias("row"))), told_apart)

        return S.let(body, named)

    def parsed(raw: Column, at: Column, delimiter: Column, rows: Column) -> Column:
        body_bottom = F.size(rows) - P.FOOTER_LINES
        return S.let(
            F.get(rows, body_bottom - 1),
            lambda first: S.let(
                _break_position(rows, body_bottom, F.size(first)),
                lambda brk: described(raw, at, delimiter, rows, first, brk),
            ),
        )

    def probed(raw: Column, at: Column, lines: Column) -> Column:
        return S.let(
            dialect(_probe(lines)),
            lambda d: F.when(d.isNotNull(), S.let(_split_lines(lines, d), lambda rows: parsed(raw, at, d, rows))),
        )

    found = S.let(
        S.split_lines(F.col(text)),
        lambda raw: S.let(
            _line_positions(raw),
            lambda at: S.let(_stripped_lines(raw, at), lambda lines: probed(raw, at, lines)),
        ),
    )
    return files.withColumn("found", found)


def table_columns(found: DataFrame, *keys: str) -> DataFrame:
    """One row per profiled column of the found tables."""
    return explode_computed(found, "found.columns", "_c", *keys).select(*keys, "_c.*")


def table_headers(found: DataFrame, *keys: str) -> DataFrame:
    """One row per distinct header of the found tables."""
    return explode_computed(found, "found.headers", "header", *keys)
