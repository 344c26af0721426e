"""Positioned text items of pages to lines, and page ranges."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheafline.plans.rows import CodedError, map_rows
from sheafline.plans.tables import numbered

CJK = re.compile("[⺀-鿿가-힣豈-﫿＀-￯]")


def assemble(items: list[dict]) -> str:
    """Lines of a page's items (text, x, y, size, width), top to bottom.

    An item starts a new line if it stands lower than the line's first item by more than half its size (2 at least).  Pieces
    are parted by a space if the gap is over a quarter of the size, between CJK characters over one and a half.
    """
    lines: list[list[dict]] = []
    for it in sorted((i for i in items if i["text"]), key=lambda i: (-i["y"], i["x"])):
        if lines and abs(it["y"] - lines[-1][0]["y"]) <= max(2.0, 0.5 * it["size"]):
            lines[-1].append(it)
        else:
            lines.append([it])
    out = []
    for line in lines:
        line.sort(key=lambda i: i["x"])
        text = line[0]["text"]
        for a, b in zip(line, line[1:]):
            gap, size = b["x"] - (a["x"] + a["width"]), max(b["size"], 1.0)
            wide = CJK.match(b["text"]) is not None or CJK.match(text[-1:]) is not None
            space = gap > (1.5 if wide else 0.25) * size and not text.endswith(" ") and not b["text"].startswith(" ")
            text += (" " if space else "") + b["text"]
        out.append(text.rstrip())
    return "\n".join(out)


def page_lines(items: DataFrame, *key: str) -> DataFrame:
    """key, page, text: a row a page; items has key, page, text, x, y, size, width.  A page's items are few."""
    cols = [F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in ("x", "y", "size", "width")]
    pages = items.groupBy(*key, "page").agg(F.collect_list(F.struct(F.col("text"), *cols)).alias("__items"))
    return map_rows(pages, lambda xs: (assemble(xs),), ["__items"], "text string", keep=[*key, "page"])


def page_range(spec: str | None, n_pages: int) -> list[int]:
    """Pages of `1-3,7`, in the order named, none twice; a blank range is all of them."""
    spec = re.sub(r"[，、；;]", ",", (spec or "").strip()).replace("－", "-").replace("—", "-").replace("~", "-")
    if not spec:
        return list(range(1, n_pages + 1))
    out: list[int] = []
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d{1,6})\s*(?:-\s*(\d{1,6})\s*)?", part)
        if not m:
            raise CodedError("PDF_PAGES_INVALID", f"not a page range: {part!r}")
        first, last = int(m.group(1)), int(m.group(2) or m.group(1))
        if not 1 <= first <= last <= n_pages:
            raise CodedError("PDF_PAGES_INVALID", f"{part.strip()} is not within 1 to {n_pages}")
        out += [p for p in range(first, last + 1) if p not in out]
    return out


def ranges(df: DataFrame, spec: str = "pages", n_pages: str = "n_pages") -> DataFrame:
    """df with selected: the pages of each row's range."""
    return map_rows(df, lambda s, n: (page_range(s, n),), [spec, n_pages], "selected array<int>")


def page_runs(pages: DataFrame, *key: str) -> DataFrame:
    """key, label: consecutive pages as 1-3, runs parted by underscores."""
    island = F.col("page") - F.row_number().over(W.partitionBy(*key).orderBy("page"))
    runs = pages.select(*key, "page").distinct().withColumn("__island", island).groupBy(*key, "__island").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.withColumn("__run", text).groupBy(*key).agg(F.expr("listagg(__run, '_') WITHIN GROUP (ORDER BY a)").alias("label"))


#: Ways of handling pages and what each gives; characters beyond Latin-1 that the standard fonts have.
MODES = {"extractText": ("txt", "md", "html"), "render": ("png", "jpg"), "merge": ("pdf",), "split": ("pdf",), "rotate": ("pdf",)}
STANDARD_FONT = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def mode_of(sources: list[str], target: str, mode: str | None = "auto", pages: str | None = "", rotate: str | None = "0") -> str | None:
    """How sources (endings) become the target; None where nothing does."""
    if mode and mode != "auto":
        if mode not in MODES:
            raise CodedError("PDF_MODE_UNSUPPORTED", f"no such mode: {mode}")
        if target not in MODES[mode]:
            raise CodedError("PDF_MODE_TARGET_CONFLICT", f"{mode} gives {'/'.join(MODES[mode])}, not {target}")
        return mode
    if "pdf" not in (sources or []):
        return "merge" if target == "pdf" else None
    if target == "pdf":
        return "split" if (pages or "").strip() else "rotate" if (rotate or "0") != "0" else "merge"
    return next((m for m in ("extractText", "render") if target in MODES[m]), None)


def modes(df: DataFrame, sources: str = "sources", target: str = "target", mode: str = "mode", pages: str = "pages", rotate: str = "rotate") -> DataFrame:
    """df with resolved: the mode of each row's request, or its error."""
    return map_rows(df, lambda *a: (mode_of(*a),), [sources, target, mode, pages, rotate], "resolved string")


def to_markdown(text: str = "text", title: str | None = None):
    """A Column: every line a paragraph, below the title where there is one."""
    head = F.when(F.coalesce(F.col(title), F.lit("")) != "", F.concat(F.lit("# "), F.col(title), F.lit("\n\n"))).otherwise(F.lit("")) if title else F.lit("")
    return F.concat(head, F.replace(F.col(text), F.lit("\n"), F.lit("\n\n")), F.lit("\n"))


def standard_font_text(text: str = "text"):
    """Columns (safe, n_dropped, needs_cjk): the text with a question mark for each character the standard fonts lack, how many
    those are, and whether it has CJK characters, without whose fonts it should not be drawn at all."""
    lacking = F.lit(f"[^\\n\\t\\x20-\\x7E\\x{{A0}}-\\x{{FF}}{STANDARD_FONT}]")
    t = F.coalesce(F.col(text), F.lit(""))
    return F.regexp_replace(t, lacking, F.lit("?")), F.regexp_count(t, lacking).cast("long"), t.rlike(CJK.pattern)


def merged(*documents: DataFrame) -> DataFrame:
    """The pages of several frames of pages (page and more), one after the other, numbered anew: source_pos, page, new_page."""
    out = None
    for i, d in enumerate(documents, 1):
        part = d.withColumn("source_pos", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return numbered(out, F.col("source_pos"), F.col("page"), name="new_page")
