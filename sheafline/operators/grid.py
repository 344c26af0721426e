"""Tables as grids: header handling, cell types and renderers.

A grid has one row a table row: key columns, row_pos (1-based) and cells (array of string).  Renderers give one line a row;
where a line needs something of the whole table, as column widths do, that is an aggregate joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheafline.functions import text as X
from sheafline.plans.tables import numbered

CELL_STYLE = "border:1px solid #d0d7de;padding:6px 10px;text-align:left;vertical-align:top"
HEAD_STYLE = CELL_STYLE + ";background:#f2f4f7;font-weight:600"


def from_table(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """A table as a grid whose first row holds the names; order must be a unique column."""
    columns = columns or df.columns
    body = df.select(F.col(order).alias("__order"), F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("cells"))
    body = numbered(body, F.col("__order"), name="__n")
    head = df.sparkSession.createDataFrame([(1, list(columns))], "row_pos int, cells array<string>")
    return head.unionByName(body.select((F.col("__n") + 1).cast("int").alias("row_pos"), "cells"))


def header_names(cells: list[str | None], wide: int = 0) -> list[str]:
    """What `headers` gives for one row of headers, at least `wide` names."""
    out, seen = [], {}
    for i, c in enumerate([*cells, *[None] * (wide - len(cells))], 1):
        name = (c or "").strip() or f"列{i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def normalise(grid: DataFrame, *key: str) -> DataFrame:
    """Trailing rows without a filled cell go, and rows are padded with null to the widest of their table."""
    w = W.partitionBy(*key)
    filled = F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    g = grid.withColumns({"__last": F.max(F.when(filled, F.col("row_pos"))).over(w), "__wide": F.max(F.size("cells")).over(w)})
    pad = F.array_repeat(F.lit(None).cast("string"), F.col("__wide") - F.size("cells"))
    return g.where("row_pos <= __last").withColumn("cells", F.concat("cells", pad)).drop("__last", "__wide")


def headers(grid: DataFrame, *key: str, header_pos: int = 1) -> DataFrame:
    """key, pos, header, name: blank headers become 列N, the n-th of equal ones gets _n."""
    cells = grid.where(F.col("row_pos") == header_pos).select(*key, F.posexplode("cells").alias("at", "cell"))
    named = cells.select(*key, (F.col("at") + 1).alias("pos"), X.column_name("cell", F.col("at") + 1).alias("header"))
    nth = F.row_number().over(W.partitionBy(*key, "header").orderBy("pos"))
    return named.withColumn("name", F.when(nth == 1, F.col("header")).otherwise(F.concat("header", F.lit("_"), nth.cast("string"))))


def cells(grid: DataFrame, *key: str) -> DataFrame:
    """key, row_pos, pos, cell."""
    return grid.select(*key, "row_pos", F.posexplode("cells").alias("__at", "cell")).select(*key, "row_pos", (F.col("__at") + 1).alias("pos"), "cell")


def _with_one(rows: DataFrame, of_table: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """rows with what there is once for each table; without a key that is one row, which every task gets."""
    if key:
        return rows.join(of_table, list(key))
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(of_table.withColumn("__one", F.lit(1))), "__one").drop("__one")


def json_records(grid: DataFrame, *key: str) -> DataFrame:
    """key, row_pos, record: each body row as a JSON object, in header order, its cells by their kind.

    The names of a table are one short array, which every row gets by a join on the table's key.
    """
    names = headers(grid, *key).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda h: h["name"]).alias("names"))
    body = grid.where("row_pos > 1")
    both = _with_one(body, names, key)
    quoted = lambda s: F.regexp_extract(F.to_json(F.struct(s.alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    pair = F.transform("names", lambda n, i: F.concat(quoted(n), F.lit(":"), X.json_scalar(F.try_element_at("cells", i + 1))))
    return both.select(*key, "row_pos", F.concat(F.lit("{"), F.array_join(pair, ","), F.lit("}")).alias("record"))


def csv_lines(grid: DataFrame, *key: str, delimiter: str = ",") -> DataFrame:
    line = F.array_join(F.transform("cells", lambda c: X.csv_quote(c, delimiter)), delimiter)
    return grid.select(*key, "row_pos", line.alias("line"))


def markdown_lines(grid: DataFrame, *key: str) -> DataFrame:
    """key, row_pos, line: a Markdown table whose columns line up; the rule under the header has row_pos 1.5."""
    marked = grid.withColumn("cells", F.transform("cells", lambda c: X.markdown_cell(c)))
    long = cells(marked, *key)
    widths = long.groupBy(*key, "pos").agg(F.greatest(F.lit(3), F.max(X.display_width("cell"))).alias("width"))
    widths = widths.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "width"))), lambda w: w["width"]).alias("widths"))
    both = marked.join(widths, list(key)) if key else marked.join(widths, how="cross")
    padded = F.transform("widths", lambda w, i: X.pad_display(F.coalesce(F.try_element_at("cells", i + 1), F.lit("")), w))
    line = F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform("widths", lambda w: F.concat(F.repeat(F.lit("-"), w + 2), F.lit("|"))), ""))
    body = both.select(*key, F.col("row_pos").cast("double").alias("row_pos"), line.alias("line"))
    return body.unionByName(both.where("row_pos = 1").select(*key, F.lit(1.5).alias("row_pos"), rule.alias("line")))


def html_rows(grid: DataFrame, *key: str, header: bool = True) -> DataFrame:
    """key, row_pos, line: table rows with inline styles, the first one of header cells."""
    def row(tag: str, style: str):
        cell = lambda c: F.concat(F.lit(f'<{tag} style="{style}">'), F.regexp_replace(X.html_escape(c), "\r?\n", "<br>"), F.lit(f"</{tag}>"))
        return F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", cell), ""), F.lit("</tr>"))

    line = F.when((F.col("row_pos") == 1) & F.lit(header), row("th", HEAD_STYLE)).otherwise(row("td", CELL_STYLE))
    return grid.select(*key, "row_pos", line.alias("line"))


def column_widths(grid: DataFrame, *key: str) -> DataFrame:
    """key, pos, width: the widest cell of each column, plus 2, between 8 and 60."""
    wide = F.greatest(F.lit(6), F.max(X.display_width("cell"))) + 2
    return cells(grid, *key).groupBy(*key, "pos").agg(F.least(F.lit(60), wide).cast("int").alias("width"))


def coerced(grid: DataFrame, *key: str) -> DataFrame:
    """key, n_coerced: body cells whose text is taken for a number, a boolean or null."""
    c = cells(grid.where("row_pos > 1"), *key)
    return c.groupBy(*key).agg(F.count_if((X.scalar_kind("cell") != "string") & F.col("cell").isNotNull()).cast("long").alias("n_coerced"))
