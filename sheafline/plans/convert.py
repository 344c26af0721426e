"""Files to files: what each file is decides which converters may take it, the first that can does.

Converters are functions from a frame of files to a frame of outputs.  They run by falling priority over the files that are
still without one; a file leaves for the next converter if the last one failed softly.  Every converter is one plan over all
its files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.functions import encoding
from sheafline.functions import text as X
from sheafline.operators import archive, chat, detect, document, grid, image, structured, subtitle
from sheafline.plans import registry
from sheafline.plans.rows import CodedError, map_rows
from sheafline.plans.tables import written
from sheafline.sources import chat_exports, delimited, workbook

OUT = "id, name, converter, target, output, error_code, error_message"


def _outputs(df: DataFrame) -> DataFrame:
    """id, output, error_code, error_message, whatever else a converter made."""
    have = df.columns
    code = F.col("error_code") if "error_code" in have else F.lit(None).cast("string")
    message = F.col("error_message") if "error_message" in have else F.lit(None).cast("string")
    return df.select("id", F.col("output").cast("binary").alias("output"), code.alias("error_code"), message.alias("error_message"))


def _text(files: DataFrame) -> DataFrame:
    return map_rows(files, lambda b: (encoding.decode(b),), ["content"], "text string", keep=["id", "ext"]).drop("error_code", "error_message")


def _failed(rows: DataFrame) -> DataFrame:
    return rows.where("error_code is not null").select("id", F.lit(None).cast("binary").alias("output"), "error_code", "error_message")


def _structured(files: DataFrame, target: str, options: dict) -> DataFrame:
    style = {"txt": options.get("txt_style", "tree")}.get(target, target)

    def run(text, ext):
        if ext == "csv":
            head, *rows = delimited.grid_of(text) or [[]]
            names = grid.header_names(head, max(map(len, [head, *rows])))
            value = [dict(zip(names, [*r, *[None] * (len(names) - len(r))])) for r in rows]
        else:
            value = structured.PARSERS[ext](text)
        value = structured.sort_keys(value) if options.get("sort_keys") else value
        more = {"indent": options["indent"]} if "indent" in options and style in ("json", "yaml", "xml") else {}
        return (structured.WRITERS[style](value, **more).encode(),)

    return _outputs(map_rows(_text(files), run, ["text", "ext"], "output binary"))


def _document(files: DataFrame, target: str, options: dict) -> DataFrame:
    def run(content, ext):
        md, title, _ = document.to_markdown(content, ext, options.get("keep_images", True))
        md = document.restyle_headings(md, options.get("heading_style", "hash"))
        return (document.WRITERS[target](md, options.get("title") or title),)

    return _outputs(map_rows(files, run, ["content", "ext"], "output binary"))


def _image(files: DataFrame, target: str, options: dict) -> DataFrame:
    return _outputs(image.convert(files, target, max_edge=int(options.get("max_edge", 0)), background=options.get("background", "#ffffff")))


def _archive(files: DataFrame, target: str, options: dict) -> DataFrame:
    if target not in ("txt", "json"):
        kind = "tgz" if target == "gz" and options.get("gz_of_many", False) else target
        return _outputs(archive.repackage(files, kind=kind, hidden=options.get("include_hidden", False)).withColumnRenamed("packed", "output"))
    found = archive.entries(files.select("id", "name", "content"))
    listed = archive.manifest(found, "id").withColumnRenamed("listing", "output") if target == "txt" else archive.manifest_json(found, "id").withColumnRenamed("manifest", "output")
    return _outputs(listed.select("id", "output")).unionByName(_failed(found))


def _table(files: DataFrame, target: str, options: dict) -> DataFrame:
    def rows(content, ext):
        if ext == "xls":
            raise CodedError("TABLE_UNSUPPORTED_FORMAT", "old binary workbooks are not read")
        if ext in ("xlsx", "ods"):
            sheets = workbook.sheets(content)
            return [(n, r) for n, r in (sheets[:1] if options.get("sheet") == "first" or target not in ("xlsx", "ods") else sheets)]
        text = encoding.decode(content)
        if ext == "json":
            value = structured.to_rows(structured.parse_json(text))
            return [("Sheet1", [[None if c is None else structured.scalar_text(c) if c != "" else "" for c in r] for r in value])]
        return [("Sheet1", delimited.grid_of(text, "\t" if ext == "tsv" else options.get("delimiter", ",")))]

    if target in ("xlsx", "ods"):
        writer = workbook.write_xlsx if target == "xlsx" else workbook.write_ods
        return _outputs(map_rows(files, lambda b, e: (writer(rows(b, e)),), ["content", "ext"], "output binary"))
    from sheafline.plans.rows import explode_rows

    g = explode_rows(files, lambda b, e: [(i, [None if c is None else str(c) for c in r]) for i, r in enumerate(rows(b, e)[0][1], 1)], ["content", "ext"], "row_pos int, cells array<string>", ["id"])
    good = grid.normalise(g.where("error_code is null").select("id", "row_pos", "cells"), "id")
    if target in ("csv", "tsv"):
        lines, sep, end = grid.csv_lines(good, "id", delimiter="\t" if target == "tsv" else options.get("delimiter", ",")), "\\r\\n", "\r\n"
    elif target == "md":
        lines, sep, end = grid.markdown_lines(good, "id"), "\\n", "\n"
    elif target == "html":
        lines, sep, end = grid.html_rows(good, "id"), "\\n", "\n"
    else:
        lines, sep, end = grid.json_records(good, "id").withColumnRenamed("record", "line"), ",\\n  ", "\n]\n"
    whole = lines.groupBy("id").agg(F.expr(f"listagg(line, '{sep}') WITHIN GROUP (ORDER BY row_pos)").alias("body"))
    head = {"json": "[\n  ", "html": '<!doctype html>\n<meta charset="utf-8">\n<table>\n'}.get(target, "﻿" if target == "csv" and options.get("bom", True) else "")
    return _outputs(whole.select("id", F.concat(F.lit(head), "body", F.lit("</table>\n" if target == "html" else ""), F.lit(end if target != "html" else "")).alias("output"))).unionByName(_failed(g))


def _subtitle(files: DataFrame, target: str, options: dict) -> DataFrame:
    t = _text(files)
    cues = subtitle.read_srt_vtt(t.where("ext in ('srt', 'vtt')"), "id").unionByName(subtitle.read_ass(t.where("ext = 'ass'"), "id"))
    bad = cues.where("error_code is not null").groupBy("id").agg(F.first("error_code").alias("error_code"))
    good = cues.join(bad, "id", "left_anti").drop("error_code")
    if options.get("shift"):
        good = subtitle.shift(good, float(options["shift"]))
    if options.get("strip_tags"):
        good = good.withColumn("text", X.strip_style_tags("text"))
    if options.get("merge"):
        good = subtitle.merge_same_times(good, "id").withColumn("style", F.lit(subtitle.DEFAULT_STYLE))
    made = subtitle.render(good, target, "id").withColumnRenamed("body", "output")
    none = t.join(cues.select("id").distinct(), "id", "left_anti").select("id", F.lit("SUBTITLE_EMPTY").alias("error_code"))
    late = bad.unionByName(none).select("id", F.lit(None).cast("binary").alias("output"), "error_code", F.lit("no cue could be read").alias("error_message"))
    return _outputs(made).unionByName(late)


def _chat(files: DataFrame, target: str, options: dict) -> DataFrame:
    said = written(chat_exports.read(_text(files).select("id", "text"), max_conversations=options.get("max_conversations")), "chats")
    good = said.where("error_code is null").withColumns({"conv": F.col("conv_pos"), "msg": F.col("msg_pos")})
    good = chat.keep_role(good, options.get("role_filter", "all"))
    good = good if options.get("include_system") else chat.drop_system(good)
    good = good if options.get("include_thinking", True) else chat.drop_thinking(good)
    shown = {k: options[k] for k in ("layout", "titles", "role_names", "timestamps") if k in options}
    made = chat.render(good, "id", target=target, **shown)
    return _outputs(made.withColumnRenamed("body", "output")).unionByName(_failed(said))


CONVERTERS: dict[str, Callable[[DataFrame, str, dict], DataFrame]] = {"chat-export": _chat, "table": _table, "archive": _archive, "document": _document, "image": _image, "subtitle": _subtitle, "data": _structured}


def register(name: str, priority: int, sources: str, targets: str, fn: Callable[[DataFrame, str, dict], DataFrame]) -> None:
    """Adds a converter of one's own, or replaces one: fn takes files (id, name, content, ext), a target and options, and gives
    id, output and, where it may fail, error_code and error_message."""
    registry.CONVERTERS = (*(c for c in registry.CONVERTERS if c[0] != name), (name, priority, sources, targets))
    CONVERTERS[name] = lambda files, target, options: _outputs(fn(files, target, options))


def convert(files: DataFrame, target: str, converter: str | None = None, **options) -> DataFrame:
    """id, name, converter, target, output, error_code, error_message: one row per file.

    files: id, name, content.  A file whose kind no converter takes to the target has error_code NO_CONVERTER.
    """
    # files are told apart by a number of their own, whatever their ids are
    listed = files.select(F.monotonically_increasing_id().alias("__file"), F.col("id").alias("__id"), "name", "content")
    known = written(detect.analyze(listed).select(F.col("__file").alias("id"), "__id", "name", "content", "ext"), "analyzed")
    order = [n for n, _, _, dst in sorted(registry.CONVERTERS, key=lambda c: -c[1]) if target in dst.split() and n in CONVERTERS]
    order = [converter, *(n for n in order if n != converter)] if converter in order else order
    pending, done, failed = known, None, None
    for name in order:
        sources = [s for _, _, src, dst in (c for c in registry.CONVERTERS if c[0] == name) for s in src.split() if name in registry.candidates(s, target, converter)]
        mine = pending.where(F.col("ext").isin(sources)).drop("__id")
        made = written(CONVERTERS[name](mine, target, options).withColumn("converter", F.lit(name)), "converted")
        soft = F.coalesce(F.col("error_code").rlike("(" + "|".join(registry.SOFT) + ")$"), F.lit(False))
        kept, again = made.where(~soft), made.where(soft)
        done = kept if done is None else done.unionByName(kept)
        failed = again if failed is None else failed.unionByName(again)
        pending = pending.join(kept.select("id"), "id", "left_anti")
    empty = known.limit(0).select("id", F.lit(None).cast("binary").alias("output"), F.lit("").alias("error_code"), F.lit("").alias("error_message"), F.lit("").alias("converter"))
    done, failed = done if done is not None else empty, failed if failed is not None else empty
    # files that every converter passed on keep their last failure
    last = failed.join(done.select("id"), "id", "left_anti").groupBy("id").agg(F.last("error_code").alias("error_code"), F.last("error_message").alias("error_message"), F.last("converter").alias("converter"))
    rest = known.select("id", "ext").join(done.select("id"), "id", "left_anti").join(last, "id", "left")
    rest = rest.select("id", F.lit(None).cast("binary").alias("output"), F.coalesce("error_code", F.lit("NO_CONVERTER")).alias("error_code"), F.coalesce("error_message", F.concat(F.lit("nothing takes "), "ext", F.lit(f" to {target}"))).alias("error_message"), "converter")
    named = known.select("id", "__id", F.concat(X.base_name("name"), F.lit(f".{target}")).alias("name"))
    return done.unionByName(rest).join(named, "id").drop("id").withColumnRenamed("__id", "id").withColumn("target", F.lit(target)).select(*OUT.split(", "))
