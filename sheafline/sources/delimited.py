"""Delimited text: large files by Spark's own splittable reader, whole texts by RFC 4180 with its odd cases."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sheafline.operators.detect import split_quoted
from sheafline.plans.rows import CodedError, explode_rows


def read_table(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | None = None, multiline: bool = False) -> DataFrame:
    """Files of one table.  Without quoted line breaks files are split over tasks; name a schema to spare the pass that infers
    one."""
    reader = spark.read.option("sep", sep).option("header", header).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).csv(path)


def parse(text: str | None, delimiter: str = ",") -> list[list[str]]:
    """Rows of cells: quotes open only empty cells, doubled quotes are one, line breaks of any kind end a row outside quotes,
    text after a closing quote is added to the cell."""
    text = (text or "").removeprefix("﻿")
    rows, row, cell, quoted, i, n = [], [], [], False, 0, len(text)
    special = re.compile('["\r\n' + re.escape(delimiter) + "]")
    while i < n:
        if quoted:
            j = text.find('"', i)
            if j < 0:
                cell.append(text[i:])
                break
            cell.append(text[i:j])
            if text[j + 1 : j + 2] == '"':
                cell.append('"')
                i = j + 2
            else:
                quoted, i = False, j + 1
            continue
        m = special.search(text, i)
        if m is None:
            cell.append(text[i:])
            break
        cell.append(text[i : m.start()])
        c, i = m.group(), m.end()
        if c == '"':
            if "".join(cell):
                cell.append(c)
            else:
                quoted = True
        elif c == delimiter:
            row.append("".join(cell))
            cell = []
        else:
            i += c == "\r" and text[i : i + 1] == "\n"
            rows.append([*row, "".join(cell)])
            row, cell = [], []
    if row or cell:
        rows.append([*row, "".join(cell)])
    return rows


def sniff(text: str | None, preferred: str = ",") -> str:
    """The preferred delimiter if the first line with text has two cells by it, else tab, comma, semicolon or bar."""
    first = next((x for x in re.split(r"\r\n|\r|\n", text or "") if x.strip()), "")
    return next((d for d in (preferred, "\t", ",", ";", "|") if len(split_quoted(first, d)) > 1), preferred)


def grid_of(text: str | None, preferred: str = ",") -> list[list[str]]:
    rows = parse(text, sniff(text, preferred))
    while rows and not any(c.strip() for c in rows[-1]):
        rows.pop()
    if not rows:
        raise CodedError("TABLE_EMPTY", "there is no filled cell")
    return rows


def read(df: DataFrame, text: str = "text", preferred: str = ",", mode: str = "PERMISSIVE") -> DataFrame:
    """One row for each row of each text: row_pos and cells."""
    keep = [c for c in df.columns if c != text]
    return explode_rows(df, lambda t: list(enumerate(grid_of(t, preferred), 1)), [text], "row_pos int, cells array<string>", keep, mode)
