"""Table discovery: hand-written texts, and both forms against a plain reading of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lakeprofile.functions import patterns as P
from lakeprofile.operators.discover import detected_dialect, find_tables, table_columns
from lakeprofile.operators.lines import find_tables_in_lines

ROWS = [f"{i},{i * 0.5},x{i}" for i in range(1, 11)]


def found(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    return {r["path"]: r["found"] for r in find_tables(df, **options).select("path", "found").collect()}


def one(spark, text, **options):
    return found(spark, [text], **options)[0]


def test_ten_lines_are_needed(spark):
    results = found(spark, ["\n".join(ROWS), "\n".join(ROWS[:9]), "", "\n\n", "word " * 500])
    assert results[0]["delimiter"] == "," and results[0]["n_rows"] == 5
    assert [results[i] for i in range(1, 5)] == [None] * 4


def test_footer_rows_count_for_values_but_not_for_rows(spark):
    table = one(spark, "\n".join(ROWS))
    first = table["columns"][0]
    assert (first["n_values"], first["n_rows"], first["total"]) == (10, 5, 55.0)
    assert (first["avg"], first["avg_compat"]) == (6.0, 11.0)  # 5.5 shown without decimals, 55 / 5
    assert first["min"] == [1.0, 2.0, 3.0] and first["max"] == [10.0, 9.0, 8.0]


def test_text_columns_are_not_profiled(spark):
    table = one(spark, "\n".join(ROWS))
    assert table["types"] == ["num", "num", "str"]
    assert [c["ordinal"] for c in table["columns"]] == [0, 1]


@pytest.mark.parametrize("eol", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("delimiter", [",", "\t", "   "])
def test_dialects_and_line_ends(spark, eol, delimiter):
    table = one(spark, eol.join(r.replace(",", delimiter) for r in ROWS) + eol)
    assert table["delimiter"] == delimiter[0] and table["width"] == 3


def test_topmost_unique_header_names_the_columns(spark):
    lines = ["A,B,C", "unit,unit,code", *ROWS[:3], "lower,names,here", *ROWS]
    table = one(spark, "\n".join(lines))
    assert table["names"] == ["a", "b", "c"]
    assert table["headers"] == ["a", "b", "c", "code", "here", "lower", "names", "unit"]
    assert table["n_rows"] == 8


def test_names_that_differ_only_in_case_stay_placeholders(spark):
    assert one(spark, "\n".join(["A,a,B", *ROWS]))["names"] == ["__0__", "__1__", "__2__"]


def test_header_below_five_rows_rejects(spark):
    assert one(spark, "\n".join([*ROWS, "a,b,c", *ROWS[:7]])) is None


def test_preamble_ends_with_the_breaking_line(spark):
    lines = ["x" * 1200, "", "Title of the table", "a,b,c", *ROWS]
    table = one(spark, "\n".join(lines))
    assert len(table["preamble"]) == 1000
    assert table["preamble"].endswith("x\n\nTitle of the table")
    assert one(spark, "\n".join(["a,b,c", *ROWS]))["preamble"] is None


def test_cells_that_are_no_numbers_are_skipped(spark):
    rows = [f"{i},{v}" for i, v in enumerate(["1", "", "n/a", "nan", "inf", "2", "2", "1e1", "3", "4", "5", "6"])]
    value = one(spark, "\n".join(reversed(rows)))["columns"]
    second = [c for c in value if c["ordinal"] == 1]
    assert second[0]["n_values"] == 8 and second[0]["min"] == [1.0, 2.0, 3.0] and second[0]["max"] == [10.0, 6.0, 5.0]


def test_sentinels_are_left_out(spark):
    rows = [f"{i},{-999 if i % 2 else i}" for i in range(1, 21)]
    df = spark.createDataFrame([(0, "\n".join(rows), [None, -999.0])], "path int, text string, s array<double>")
    columns = table_columns(find_tables(df, sentinels="s"), "path").orderBy("ordinal").collect()
    assert columns[1]["n_values"] == 10 and columns[1]["min"][0] == 2.0


def test_classification_agrees_with_the_full_pass(spark):
    texts = ["\n".join(ROWS), "\n".join(ROWS[:9]), "a b c\n" * 20, "1 2\n" * 12, "1\t2\n" * 12]
    df = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    verdict = df.select("path", detected_dialect(F.col("text")).alias("delimiter"))
    verdicts = {r["path"]: r["delimiter"] for r in verdict.collect()}
    tables = found(spark, texts)
    assert verdicts == {i: t["delimiter"] if t else None for i, t in tables.items()}


# ---- both forms against the rules read line by line --------------------------------------------------

def _number(field):
    return re.match(P.NUMBER, field) is not None


def _read(line, delimiter):
    fields = [f.strip() for f in re.split(dict(P.DIALECTS)[delimiter], line)]
    return fields if delimiter == "," else [f for f in fields if f]


def by_the_rules(text):
    """The table of a text found by walking its lines from the bottom, None if there is none."""
    lines = [line for line in re.split(P.EOL, text) if line.strip()]
    for delimiter, _ in P.DIALECTS:
        rows = [_read(line, delimiter) for line in reversed(lines)]
        footer, above = rows[:5], rows[5:]
        if not above:
            continue
        width, values, heads, rejected = len(above[0]), [], [], False
        for row in above:
            is_head = not any(_number(f) for f in row)
            if (len(row) != width or is_head) and len(values) < 5:
                rejected = True
                break
            if len(row) != width:
                break
            (heads if is_head else values).append(row)
        if rejected or len(values) < 5:
            continue
        names = [f"__{i}__" for i in range(width)]
        unique = [h for h in heads if len(set(h)) == width]
        if unique and len({f.lower() for f in unique[-1]}) == width:
            names = [f.lower() for f in unique[-1]]
        cells = values + [r for r in footer if len(r) == width]
        columns = {}
        for i in range(width):
            if _number(above[0][i]):
                numbers = [float(r[i]) for r in cells if re.match(P.FINITE_NUMBER, r[i])]
                distinct = sorted(set(numbers))
                columns[i] = (len(numbers), distinct[:3], distinct[::-1][:3], round(sum(numbers), 6))
        headers = sorted({f.lower() for h in heads for f in h if f})
        return delimiter, width, len(values), names, headers, columns
    return None


def _random_text(rng):
    delimiter = rng.choice([",", "\t", " "])
    width = rng.randint(1, 4)
    cell = lambda: rng.choice(["1", "2.5", "-7", "3e2", "nan", "x", "Abc", "-999", "0", "12", "40"])
    row = lambda n: delimiter.join(cell() for _ in range(n))
    lines = []
    for _ in range(rng.randint(0, 3)):
        lines.append(row(rng.randint(1, 5)))
    for _ in range(rng.randint(0, 2)):
        lines.append(delimiter.join(rng.choice(["a", "B", "c", "D", "b"]) for _ in range(width)))
    for _ in range(rng.randint(3, 30)):
        fields = [rng.choice(["1", "2", "3.25"])] + [cell() for _ in range(width - 1)]
        lines.append(delimiter.join(fields))
        if rng.random() < 0.05:
            lines.append("")
    for _ in range(rng.randint(0, 6)):
        lines.append(row(rng.randint(1, 4)))
    return rng.choice(["\n", "\r\n", "\r"]).join(lines)


def test_both_forms_follow_the_rules_on_random_texts(spark):
    rng = random.Random(3)
    texts = [_random_text(rng) for _ in range(400)]
    expected = {i: by_the_rules(t) for i, t in enumerate(texts)}
    assert sum(e is not None for e in expected.values()) > 100

    def described(table):
        columns = {
            c["ordinal"]: (c["n_values"], c["min"], c["max"], round(c["total"] or 0.0, 6)) for c in table["columns"]
        }
        return table["delimiter"], table["width"], table["n_rows"], table["names"], table["headers"], columns

    by_row = found(spark, texts)
    assert {i: t and described(t) for i, t in by_row.items()} == expected

    df = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    lines = df.select("path", F.posexplode(F.split("text", P.EOL, -1)).alias("position", "line"))
    result = find_tables_in_lines(lines)
    by_line = {}
    for t in result.tables.collect():
        by_line[t["path"]] = [t["delimiter"], t["width"], t["n_rows"], t["names"], [], {}]
        assert t["preamble"] == by_row[t["path"]]["preamble"]
    for c in result.columns.collect():
        by_line[c["path"]][5][c["ordinal"]] = (c["n_values"], c["min"], c["max"], round(c["total"] or 0.0, 6))
    for h in result.headers.orderBy("header").collect():
        by_line[h["path"]][4].append(h["header"])
    assert {i: tuple(t) for i, t in by_line.items()} == {i: e for i, e in expected.items() if e is not None}


def test_cells_are_read_once(spark):
    texts = spark.createDataFrame([("x",)], "text string")
    plan = find_tables(texts).select("found.columns")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(P.FINITE_NUMBER) == 1


def test_values_too_large_for_a_double_are_none(spark):
    rows = [f"{v},x" for v in ("1e999", "-1e999", "1", "-0", "nan", "3", "inf", "4")]
    text = "\n".join([*rows, "1,x", "2,x", *["end"] * 5])
    for hidden in (None, "hidden"):
        df = spark.createDataFrame([(0, text, [4.5, None])], "path int, text string, hidden array<double>")
        [column] = table_columns(find_tables(df, sentinels=hidden), "path").collect()
        left = [1.0, 0.0, 3.0, 1.0, 2.0] + [4.0] * (hidden is None)
        assert (column["n_values"], column["n_rows"], column["total"]) == (len(left), 10, sum(left))
        assert column["min"] == [0.0, 1.0, 2.0] and column["max"] == ([4.0, 3.0, 2.0] if hidden is None else [3.0, 2.0, 1.0])
