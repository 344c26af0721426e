"""Conversations: filters, order, summaries and renderers over message rows.

A message row has conv (any key), msg (position), role, text and, where there are any, name, time, kind and title.  Nothing
here gathers more than one conversation in a row, and rows that are one rendered message each are the primary form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheafline.functions import text as X
from sheafline.functions.time import format_time
from sheafline.plans.tables import numbered

THINKING = ("thinking", "tool_use", "tool_result")
#: Fixed value: the line above and below a title.
RULE = "─" * 32


def messages(df: DataFrame, conv: str, msg: str, role: str = "role", text: str = "text", **extra: str) -> DataFrame:
    """A table's columns under the names used here; absent ones are null."""
    out = {"conv": F.col(conv), "msg": F.col(msg), "role": X.normal_role(role), "text": F.coalesce(F.col(text), F.lit(""))}
    for name, kind in (("name", "string"), ("time", "timestamp"), ("kind", "string"), ("title", "string")):
        out[name] = F.col(extra[name]).cast(kind) if name in extra else F.lit(None).cast(kind)
    return df.select(*(c.alias(n) for n, c in out.items()))


def keep_role(df: DataFrame, role: str = "all") -> DataFrame:
    """Only messages of a role; `all` keeps every one."""
    if role not in ("all", "user", "assistant", "system", "tool"):
        raise ValueError(f"no such role filter: {role}")
    return df if role == "all" else df.where(F.col("role") == role)


def drop_system(df: DataFrame) -> DataFrame:
    return df.where(F.col("role") != "system")


def drop_thinking(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("kind").isin(*THINKING), F.lit(False)))


def drop_blank(df: DataFrame) -> DataFrame:
    return df.where(F.trim("text") != "")


def emptied(before: DataFrame, after: DataFrame) -> DataFrame:
    """Conversations that a filter left without a message."""
    return before.select("conv").distinct().join(after.select("conv").distinct(), "conv", "left_anti")


def conversations(df: DataFrame) -> DataFrame:
    """conv, title, created_at, first_text and counts by role of each conversation."""
    by_role = {f"n_{r}": F.count_if(F.col("role") == r).cast("long") for r in ("user", "assistant", "system")}
    named = F.col("role").isin("user", "assistant", "system")
    blank = F.trim("text") == ""
    return df.groupBy("conv").agg(
        F.first("title", ignorenulls=True).alias("title"),
        F.min("time").alias("created_at"),
        F.max("time").alias("updated_at"),
        F.count("*").cast("long").alias("n_messages"),
        *(c.alias(n) for n, c in by_role.items()),
        F.count_if(~named).cast("long").alias("n_other"),
        F.min_by(F.when(~blank, F.substring("text", 1, 120)), F.when(~blank, F.col("msg"))).alias("preview"),
        F.array_sort(F.collect_set("name")).alias("models"),
    )


def in_order(convs: DataFrame) -> DataFrame:
    """conv_pos, 1-based: by creation, those without a time last, then by key."""
    return numbered(convs, F.col("created_at").asc_nulls_last(), F.col("conv").asc(), name="conv_pos")


def select_conversations(ordered: DataFrame, wanted: list[int]) -> tuple[DataFrame, DataFrame]:
    """The conversations at the wanted ordinals, and the ordinals that there are none of."""
    spark = ordered.sparkSession
    ids = spark.createDataFrame([(i,) for i in sorted(set(wanted))], "conv_pos long")
    return ordered.join(ids, "conv_pos", "left_semi"), ids.join(ordered, "conv_pos", "left_anti")


def overview(df: DataFrame) -> DataFrame:
    """One row: conversations, messages, first and last time, up to four models."""
    return df.agg(
        F.count_distinct("conv").cast("long").alias("n_conversations"),
        F.count("*").cast("long").alias("n_messages"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.slice(F.array_sort(F.collect_set("name")), 1, 4).alias("models"),
    )


def merge_adjacent(df: DataFrame, *same: str) -> DataFrame:
    """Neighbouring messages that agree in `same` (role by default) become one; their texts are parted by a blank line."""
    same = same or ("role",)
    by_msg = W.partitionBy("conv").orderBy("msg")
    fresh = F.lit(False)
    for c in same:
        fresh = fresh | ~F.col(c).eqNullSafe(F.lag(c).over(by_msg))
    islands = df.withColumn("__new", (fresh | (F.row_number().over(by_msg) == 1)).cast("int")).withColumn("__island", F.sum("__new").over(by_msg))
    return islands.groupBy("conv", "__island", *same).agg(
        F.min("msg").alias("msg"), F.count("*").cast("long").alias("n_merged"), F.expr("listagg(text, '\\n\\n') WITHIN GROUP (ORDER BY msg)").alias("text")
    ).drop("__island")


def heading(df: DataFrame, role_names: bool = True, timestamps: bool = True) -> DataFrame:
    """df with label (role, model and kind) and stamp (time or empty)."""
    stamp = F.coalesce(format_time("time"), F.lit("")) if timestamps else F.lit("")
    return df.withColumns({"label": X.role_label("role", F.col("name"), F.col("kind"), role_names), "stamp": stamp})


def _indent(text: Column, by: str = "  ") -> Column:
    """Lines indented but for blank ones and those of fenced code, fences included."""
    lines = F.split(text, "\n")
    is_fence = lambda s: s.rlike(r"^\s*(```|~~~)")
    step = lambda acc, line: F.struct(
        F.when(is_fence(line), ~acc["open"]).otherwise(acc["open"]).alias("open"),
        F.array_append(acc["out"], F.when(is_fence(line) | acc["open"] | (line == ""), line).otherwise(F.concat(F.lit(by), line))).alias("out"),
    )
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(lines, start, step, lambda acc: acc["out"]), "\n")


def _body() -> Column:
    return F.trim("text")


def message_blocks(df: DataFrame, layout: str = "chat", markdown: bool = False, role_names: bool = True, timestamps: bool = True) -> DataFrame:
    """conv, msg, block: each message as the layout shows it."""
    h = heading(df, role_names, timestamps)
    stamp = F.when(F.col("stamp") != "", F.concat(F.lit("["), F.col("stamp"), F.lit("] "))).otherwise(F.lit(""))
    if layout == "plain":
        return drop_blank(df).select("conv", "msg", _body().alias("block"))
    if layout == "transcript":
        when = F.when(F.col("stamp") != "", F.concat(F.lit(" · "), F.col("stamp"))).otherwise(F.lit(""))
        block = F.concat(F.lit("**"), F.col("label"), F.lit("**"), when, F.lit("\n\n"), _body())
    elif layout in ("chat", "timeline"):
        scope = F.when(F.col("title").isNotNull(), F.concat(F.col("title"), F.lit(" · "))).otherwise(F.lit("")) if layout == "timeline" else F.lit("")
        name = F.concat(stamp, scope, F.col("label"), F.lit("："))
        block = F.concat(F.lit("**"), name, F.lit("**\n"), _body()) if markdown else F.concat(name, F.lit("\n"), _indent(_body()))
    elif layout == "html":
        meta = X.html_escape(F.concat(stamp, F.col("label")))
        block = F.concat(F.lit('<div class="message">\n<div class="meta"><span class="role">'), meta, F.lit('</span></div>\n<pre class="body">'), X.html_escape(_body()), F.lit("</pre>\n</div>"))
        h = drop_blank(h)
    else:
        raise ValueError(f"no such layout: {layout}")
    return h.select("conv", "msg", "time", block.alias("block"))


def documents(blocks: DataFrame, between: str = "\n\n") -> DataFrame:
    """conv, body: the blocks of each conversation in order, in one text."""
    sep = between.replace("\n", "\\n")
    return blocks.groupBy("conv").agg(F.expr(f"listagg(block, '{sep}') WITHIN GROUP (ORDER BY msg)").alias("body"))


def timeline(df: DataFrame) -> DataFrame:
    """pos, 1-based: all messages by time, those without one last, in the order of conversation and message."""
    return numbered(df, F.col("time").asc_nulls_last(), F.col("conv").asc(), F.col("msg").asc())


def jsonl_rows(df: DataFrame) -> DataFrame:
    """conv, msg, line: one JSON object a message that is not blank; index counts blank ones too, and conversation, where df
    has conv_pos, is that."""
    nth = F.row_number().over(W.partitionBy("conv").orderBy("msg"))
    pos = [F.col("conv_pos").alias("conversation")] if "conv_pos" in df.columns else []
    row = F.struct(*pos, F.coalesce("title", F.lit("")).alias("title"), F.col("index"), F.col("role"), F.coalesce(format_time("time"), F.lit("")).alias("time"), F.col("text"))
    return drop_blank(df.withColumn("index", nth)).select("conv", "msg", F.to_json(row).alias("line"))


def csv_rows(df: DataFrame, role_names: bool = True) -> DataFrame:
    """conv, msg, line: 会话, 序号, 角色, 时间, 内容."""
    nth = F.row_number().over(W.partitionBy("conv").orderBy("msg"))
    h = drop_blank(df.withColumn("index", nth))
    line = X.csv_line(F.coalesce("title", F.lit("")), F.col("index").cast("string"), X.role_label("role", F.col("name"), None, role_names), F.coalesce(format_time("time"), F.lit("")), F.col("text"))
    return h.select("conv", "msg", line.alias("line"))


#: How an HTML page of conversations looks.
PAGE_STYLE = "body{margin:2em auto;max-width:54em;line-height:1.6;font-family:sans-serif}.meta{color:#666}pre.body{white-space:pre-wrap;background:#f6f6f6;padding:.6em}"
PAGE_HEAD = '<!DOCTYPE html>\n<html lang="zh-CN">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n'


def _listed(col: str, order: str, sep: str) -> Column:
    return F.expr(f"listagg({col}, '{sep}') WITHIN GROUP (ORDER BY {order})")


def contents(df: DataFrame, *key: str, timestamps: bool = True) -> DataFrame:
    """key, conv, conv_pos (1-based within the key), n_conv, title, n_messages, span: what a table of contents says."""
    span = F.lit("")
    if timestamps:
        first, last = format_time("first_time"), format_time("last_time")
        span = F.when(F.col("first_time").isNull(), "").when(first == last, first).otherwise(F.concat(first, F.lit(" ~ "), last))
    convs = df.groupBy(*key, "conv").agg(F.first("title", ignorenulls=True).alias("title"), F.count("*").cast("long").alias("n_messages"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    by = W.partitionBy(*key)
    return convs.select(*key, "conv", F.row_number().over(by.orderBy("conv")).alias("conv_pos"), F.count("*").over(by).alias("n_conv"), F.coalesce("title", F.lit("")).alias("title"), "n_messages", span.alias("span"))


def render(df: DataFrame, *key: str, target: str = "txt", layout: str = "chat", titles: bool = True, role_names: bool = True, timestamps: bool = True) -> DataFrame:
    """key, name, body: one document for each key, of its conversations in their order; with conv among the keys, one each.

    txt and md in the layouts chat, transcript, plain and timeline; html, jsonl and csv in their own.  Documents of several
    conversations begin with a table of contents and each conversation with its title, unless `titles` is off.  A document
    is put together in one row, as it is written.
    """
    per = [F.col(k) for k in key]
    group = F.struct(*per, F.col("conv").alias("__conv"))
    toc = contents(df, *key, timestamps=timestamps)
    at = df.drop("conv_pos").join(toc.select(*key, "conv", "conv_pos"), [*dict.fromkeys([*key, "conv"])]).withColumn("conv", group)
    unpack = [F.col(f"conv.{k}").alias(k) for k in key]
    markdown, html = target == "md", target == "html"
    item = F.concat(F.col("title"), F.lit(" —— "), F.col("n_messages").cast("string"), F.lit(" 条"), F.when(F.col("span") != "", F.concat(F.lit("，"), F.col("span"))).otherwise(F.lit("")))
    dotted = F.concat(F.col("conv_pos").cast("string"), F.lit(". "), item)
    several = F.col("n_conv") > 1
    whole = F.when(several, F.concat(F.lit("聊天记录（"), F.col("n_conv").cast("string"), F.lit(" 个会话）"))).otherwise(F.col("only"))
    heads = toc.withColumn("__item", F.concat(F.lit("<li>"), X.html_escape(item), F.lit("</li>")) if html else dotted if markdown else F.concat(F.lit("  "), dotted))
    heads = heads.groupBy(*key).agg(F.max("n_conv").alias("n_conv"), F.max("title").alias("only"), _listed("__item", "conv_pos", "" if html else "\\n").alias("items")).withColumn("whole", whole)
    stem = F.when(several, F.concat(F.lit("会话记录-"), F.col("n_conv").cast("string"), F.lit("个会话"))).otherwise(F.when(F.col("only") == "", F.lit("会话记录")).otherwise(X.safe_file_name("only")))
    name = F.concat(stem, F.lit(f".{target}")).alias("name")

    if target in ("jsonl", "csv"):
        rows = (jsonl_rows(at) if target == "jsonl" else csv_rows(at, role_names)).select(*unpack, F.struct("conv", "msg").alias("o"), "line")
        end = "\\n" if target == "jsonl" else "\\r\\n"
        body = rows.groupBy(*key).agg(_listed("line", "o", end).alias("body"))
        first = "" if target == "jsonl" else "会话,序号,角色,时间,内容\r\n"
        made = heads.join(body, list(key), "left")
        text = F.when(F.col("body").isNotNull(), F.concat("body", F.lit("\n" if target == "jsonl" else "\r\n"))).otherwise(F.lit(""))
        return made.select(*key, name, F.concat(F.lit(first), text).alias("body"))

    if layout == "timeline" and not html:
        blocks = message_blocks(at if titles else at.withColumn("title", F.lit(None).cast("string")), layout, markdown, role_names, timestamps)
        if titles:  # a document of one conversation does not name it on every line
            single = message_blocks(at.withColumn("title", F.lit(None).cast("string")), layout, markdown, role_names, timestamps).withColumnRenamed("block", "bare").drop("time")
            blocks = blocks.join(single, ["conv", "msg"])
            counts = heads.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), "n_conv")
            on = [F.col(f"conv.{k}").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
            blocks = blocks.join(counts, on).withColumn("block", F.when(several, F.col("block")).otherwise(F.col("bare")))
        order = F.struct(F.col("time").isNull(), "time", "conv", "msg") if timestamps else F.struct("conv", "msg")
        parts = blocks.select(*unpack, order.alias("o"), "block")
        body = parts.groupBy(*key).agg(_listed("block", "o", "\\n\\n").alias("body"))
    else:
        blocks = message_blocks(at, "plain" if layout == "plain" else "html" if html else layout, markdown, role_names, timestamps)
        if html and layout == "plain":
            blocks = blocks.withColumn("block", X.html_escape("block"))
        each = blocks.groupBy("conv").agg(_listed("block", "msg", "\\n" if html and layout != "plain" else "\\n\\n").alias("block"))
        each = each.withColumn("block", F.regexp_replace("block", r"\s+$", "") if not html else F.concat(F.lit('<pre class="body">'), "block", F.lit("</pre>")) if layout == "plain" else F.col("block"))
        parts = each.select(*unpack, F.col("conv.__conv").alias("__conv"), F.lit(1).alias("__part"), "block")
        if (titles and layout != "plain") or html:
            title = F.col("title")
            shown = F.concat(F.lit("<hr>"), F.concat(F.lit("\n<h2>"), X.html_escape("title"), F.lit("</h2>")) if titles else F.lit("")) if html else F.concat(F.lit("## "), title) if markdown or layout == "transcript" else F.concat(F.lit(f"{RULE}\n会话标题："), title, F.lit(f"\n{RULE}"))
            parts = parts.unionByName(toc.select(*key, F.col("conv").alias("__conv"), F.lit(0).alias("__part"), shown.alias("block")).select(*parts.columns))
        parts = parts.select(*key, F.struct("__conv", "__part").alias("o"), "block")
        body = parts.groupBy(*key).agg(_listed("block", "o", "\\n" if html else "\\n\\n\\n" if layout == "plain" else "\\n\\n").alias("body"))
    made = heads.join(body, list(key), "left").withColumn("body", F.coalesce("body", F.lit("")))
    with_toc = several & F.lit(titles)
    if html:
        top = F.concat(F.lit(f"{PAGE_HEAD}<title>"), X.html_escape("whole"), F.lit(f"</title>\n<style>{PAGE_STYLE}</style>\n</head>\n<body>\n<main>\n<h1>"), X.html_escape("whole"), F.lit("</h1>\n"))
        listed = F.when(with_toc, F.concat(F.lit('<ul class="toc">'), "items", F.lit("</ul>\n"))).otherwise(F.lit(""))
        return made.select(*key, name, F.concat(top, listed, "body", F.lit("\n</main>\n</body>\n</html>\n")).alias("body"))
    if layout != "plain" and (markdown or layout == "chat"):
        first = F.concat(F.lit("> 共 "), F.col("n_conv").cast("string"), F.lit(" 个会话\n\n")) if markdown else F.concat(F.lit("会话目录（共 "), F.col("n_conv").cast("string"), F.lit(" 个）\n"))
        made = made.withColumn("body", F.when(with_toc, F.concat(first, "items", F.lit("\n\n"), "body")).otherwise(F.col("body")))
    text = F.regexp_replace("body", r"\s+$", "")
    return made.select(*key, name, F.when(text == "", F.lit("")).otherwise(F.concat(text, F.lit("\n"))).alias("body"))
