"""Checks of workbooks as tables of cells: (book, sheet, row, col, formula, value), formula with its equals sign or null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Error texts, functions that older programs lack, and patterns.
ERRORS = ["#VALUE!", "#DIV/0!", "#REF!", "#NAME?", "#NULL!", "#NUM!", "#N/A"]
FORBIDDEN = ["FILTER", "UNIQUE", "SORT", "SORTBY", "XLOOKUP", "XMATCH", "SEQUENCE", "LET", "LAMBDA", "RANDARRAY", "ARRAYFORMULA", "QUERY", "IMPORTRANGE"]
IMPLICIT = [r"MATCH\s*\(\s*TRUE\s*\(\s*\)", r"MATCH\s*\(\s*TRUE\s*,", r"MATCH\s*\([^,]+[<>=!]+[^,]+,"]
REAL_FORMULA = r"[A-Z]{2,}\s*\(|\$?[A-Z]{1,3}\$?\d+"
OTHER_FILE = r"\[([^\]]+\.(xlsx?|xlsm|xlsb|csv))\]"
RANGE = r"([A-Z]{1,3})(\d+):([A-Z]{1,3})(\d+)"
SHEET_RANGE = r"([A-Za-z_]\w*?)!([A-Z]{1,3})(\d+):([A-Z]{1,3})(\d+)"
AGGREGATE = r"(SUM|AVERAGE|AVG|COUNT|COUNTA|MIN|MAX|SUMPRODUCT)\s*\(\s*([A-Z]{1,3})1:"
SMALL = r"(SUM|AVERAGE|AVG|COUNT|COUNTA)\s*\(\s*([A-Z]{1,3})(\d+):([A-Z]{1,3})(\d+)\s*\)"

CELL = ["book", "sheet", "row", "col"]


def is_formula(c: Column) -> Column:
    return F.coalesce(F.startswith(c, F.lit("=")), F.lit(False))


def a1(row: Column, col: Column) -> Column:
    """The name of a cell; columns from 1 to 18,278."""
    a, b, c = col - 1, F.floor((col - 27) / 26), F.floor((col - 703) / 676)
    letter = lambda x: F.char(F.pmod(x, F.lit(26)) + 65)
    return F.concat(F.when(col > 702, letter(c)).otherwise(""), F.when(col > 26, letter(b)).otherwise(""), letter(a), row.cast("string"))


def _found(cells: DataFrame, *kinds: tuple[str, Column]) -> DataFrame:
    """One row for each kind that a cell has."""
    marks = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds]))
    return cells.select(*CELL, "formula", F.explode(marks).alias("finding"))


def validate(cells: DataFrame) -> DataFrame:
    """(cell, formula, finding, detail): functions that older programs lack, text behind an equals sign, other files."""
    f = F.col("formula")
    asked = cells.where(is_formula(f))
    names = F.filter(F.array(*[F.lit(n) for n in FORBIDDEN]), lambda n: F.rlike(F.upper(f), F.concat(F.lit(r"\b"), n, F.lit(r"\s*\("))))
    body = F.substring(f, 2, 1 << 30)
    text = ~F.startswith(F.trim(body), F.lit('"')) & ~body.rlike("(?i)" + REAL_FORMULA)
    found = F.concat(
        F.transform(names, lambda n: F.struct(F.lit("forbidden_function").alias("finding"), n.alias("detail"))),
        F.when(text, F.array(F.struct(F.lit("text_as_formula").alias("finding"), f.alias("detail")))).otherwise(F.array().cast("array<struct<finding:string,detail:string>>")),
        F.transform(F.regexp_extract_all(F.upper(f), F.lit("(?i)" + OTHER_FILE), F.lit(1)), lambda n: F.struct(F.lit("external_file_ref").alias("finding"), n.alias("detail"))),
    )
    return asked.select(*CELL, "formula", F.inline(found))


def audit(cells: DataFrame) -> DataFrame:
    """(cell, formula, finding): formulas whose value is an error or zero, and implicit array formulas."""
    f, v = F.col("formula"), F.col("value")
    error = reduce(lambda a, b: a | b, [F.contains(v, F.lit(e)) for e in ERRORS])
    implicit = f.rlike("(?i)" + "|".join(IMPLICIT))
    return _found(cells.where(is_formula(f)), ("error", error), ("zero", F.expr("try_cast(value AS double)") == 0), ("implicit_array", implicit))


def scan(cells: DataFrame) -> DataFrame:
    """(cell, formula, finding): ranges far beyond a sheet's data, ranges that take in the header, tiny aggregates.

    A range is far beyond if it ends over 100 and over three times the sheet's last row. Sheets' last rows are joined by name.
    """
    f = F.col("formula")
    last = cells.groupBy("book", "sheet").agg(F.max("row").alias("last"))
    asked = cells.where(is_formula(f)).withColumn("cross", F.regexp_extract_all(f, F.lit(SHEET_RANGE), F.lit(0)))
    other = asked.where(F.size("cross") > 0).select(*CELL, "formula", F.explode("cross").alias("r"))
    other = other.select(*CELL, "formula", F.regexp_extract("r", SHEET_RANGE, 1).alias("target"), F.regexp_extract("r", SHEET_RANGE, 5).cast("long").alias("end"))
    own = asked.where(F.size("cross") == 0).select(*CELL, "formula", F.explode(F.regexp_extract_all(f, F.lit(RANGE), F.lit(4))).alias("end")).select(*CELL, "formula", F.col("sheet").alias("target"), F.col("end").cast("long").alias("end"))
    ends = other.unionByName(own).join(last.withColumnRenamed("sheet", "target"), ["book", "target"])
    far = ends.where((F.col("end") > F.col("last") * 3) & (F.col("end") > 100)).select(*CELL, "formula", F.lit("out_of_range").alias("finding"))
    header = asked.where(f.rlike("(?i)" + AGGREGATE) & (F.col("row") > 1)).select(*CELL, "formula", F.lit("header_included").alias("finding"))
    spans = asked.select(*CELL, "formula", F.explode(F.regexp_extract_all(f, F.lit("(?i)" + SMALL), F.lit(0))).alias("r"))
    size = F.abs(F.regexp_extract("r", "(?i)" + SMALL, 5).cast("long") - F.regexp_extract("r", "(?i)" + SMALL, 3).cast("long")) + 1
    small = spans.where(size <= 2).select(*CELL, "formula", F.lit("small_aggregate").alias("finding"))
    return far.unionByName(header).unionByName(small)


def inspect(cells: DataFrame) -> DataFrame:
    """(book, sheet, data_range, n_rows, n_columns, data_rows, n_formulas, headers) of each sheet.

    The first row holds the headers; rows and formulas are counted below it.
    """
    some = cells.where(F.coalesce("formula", "value").isNotNull())
    below = F.col("row") > 1
    heads = F.transform(F.sort_array(F.collect_list(F.when(~below, F.struct("col", F.coalesce("formula", "value").alias("h"))))), lambda x: x["h"])  # one row of a sheet
    rows = some.where(below).groupBy("book", "sheet", "row").agg(F.count_if(is_formula(F.col("formula"))).alias("f")).groupBy("book", "sheet").agg(F.count("*").alias("data_rows"), F.sum("f").alias("n_formulas"))
    size = some.groupBy("book", "sheet").agg(F.max("row").alias("n_rows"), F.max("col").alias("n_columns"), heads.alias("headers"))
    out = size.join(rows, ["book", "sheet"], "left").na.fill(0, ["data_rows", "n_formulas"])
    return out.select("book", "sheet", F.concat(F.lit("A1:"), a1(F.col("n_rows"), F.col("n_columns"))).alias("data_range"), "n_rows", "n_columns", "data_rows", "n_formulas", "headers")


def relations(parts: DataFrame) -> DataFrame:
    """(book, part, finding) of a package's parts (book, part, content): absolute paths and local files in relations."""
    c = F.col("content")
    kinds = F.array_compact(F.array(F.when(c.rlike(r'Target="[A-Z]:\\'), F.lit("absolute_path")), F.when(F.contains(F.lower(c), F.lit("file:///")), F.lit("local_file_ref"))))
    return parts.where(F.endswith("part", F.lit(".rels"))).select("book", "part", F.explode(kinds).alias("finding"))
