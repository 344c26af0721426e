"""Subtitles: reading, shifting, merging and rendering cues.

A cue row has key columns, idx (1-based), start_ms, end_ms, text and style.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheafline.functions import text as X
from sheafline.functions import time as CLOCK

DEFAULT_STYLE = "Default"
#: The head of an ASS script.
ASS_HEAD = (
    "[Script Info]", "ScriptType: v4.00+", "WrapStyle: 0", "ScaledBorderAndShadow: yes", "PlayResX: 1280", "PlayResY: 720", "", "[V4+ Styles]",
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding",
)
ASS_STYLE = ",Arial,48,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,1,2,10,10,10,1"
ASS_EVENTS = ("", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text")


def kind_of(text: Column | str, ext: Column | str | None = None) -> Column:
    """vtt, ass or srt, by what the text says, then by its extension."""
    t = F.col(text) if isinstance(text, str) else text
    e = F.lit("") if ext is None else F.lower(F.col(ext) if isinstance(ext, str) else ext)
    return F.when(t.rlike(r"^\x{FEFF}?\s*WEBVTT"), "vtt").when(t.rlike(r"(?im)^\s*\[(script info|events)\]"), "ass").when(e.isin("vtt", "ass"), e).when(e == "ssa", "ass").otherwise("srt")


def _lines(df: DataFrame, text: str) -> DataFrame:
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\x{FEFF}", ""), "\r\n?", "\n")
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(clean, "\n")).alias("__n", "__line"))


def read_srt_vtt(df: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """Cues of SRT and VTT texts: a line with an arrow opens one, a blank line or the next arrow ends it.

    Settings after the end time, and a line of digits just before the next arrow, are not text.  A timing line that cannot be
    read has null times and error_code SUBTITLE_BAD_TIME.
    """
    w = W.partitionBy(*key).orderBy("__n")
    ln = _lines(df.select(*key, text), text)
    ln = ln.withColumn("__arrow", F.col("__line").contains("-->")).withColumn("__cue", F.sum(F.col("__arrow").cast("int")).over(w))
    next_is_arrow = F.coalesce(F.lead("__arrow").over(w), F.lit(False))
    ln = ln.withColumn("__stop", (F.trim("__line") == "").cast("int")).where("__cue > 0")
    in_cue = W.partitionBy(*key, "__cue").orderBy("__n")
    ln = ln.withColumn("__stopped", F.sum("__stop").over(in_cue)).withColumn("__index", next_is_arrow & F.col("__line").rlike(r"^\s*\d+\s*$"))
    side = lambda i: F.split(F.trim(F.regexp_extract("__line", r"^(.*?)-->(.*)$", i)), r"\s+")[0]
    heads = ln.where("__arrow").select(*key, "__cue", CLOCK.parse_timecode(side(1)).alias("start_ms"), CLOCK.parse_timecode(side(2)).alias("end_ms"))
    body = ln.where("not __arrow and __stopped = 0 and not __index").groupBy(*key, "__cue").agg(F.expr("listagg(__line, '\\n') WITHIN GROUP (ORDER BY __n)").alias("text"))
    got = heads.join(body, [*key, "__cue"], "left").withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    bad = F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), F.lit("SUBTITLE_BAD_TIME"))
    return got.select(*key, F.col("__cue").cast("int").alias("idx"), "start_ms", "end_ms", "text", F.lit(DEFAULT_STYLE).alias("style"), bad.alias("error_code"))


def read_ass(df: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """Dialogue lines of the events section, fields in the order of its Format line; the text is what is left, commas too."""
    w = W.partitionBy(*key).orderBy("__n")
    ln = _lines(df.select(*key, text), text).withColumn("__line", F.trim("__line"))
    section = F.nullif(F.regexp_extract("__line", r"^\[(.+)\]$", 1), F.lit(""))
    form = F.when(F.col("__line").rlike(r"(?i)^format\s*:"), F.regexp_replace("__line", r"(?i)^format\s*:\s*", ""))
    ln = ln.withColumns({"__section": F.lower(F.last(section, ignorenulls=True).over(w)), "__format": form})
    ln = ln.where("__section = 'events'").withColumn("__format", F.last("__format", ignorenulls=True).over(w)).where(F.col("__line").rlike(r"(?i)^dialogue\s*:"))
    default = "layer,start,end,style,name,marginl,marginr,marginv,effect,text"
    fields = F.transform(F.split(F.lower(F.coalesce("__format", F.lit(default))), ","), lambda f: F.trim(f))
    ln = ln.withColumn("__fields", fields)
    rest = F.regexp_replace("__line", r"(?i)^dialogue\s*:\s*", "")
    ln = ln.withColumn("__parts", F.split(rest, ",", F.size("__fields")))
    at = lambda name: F.try_element_at("__parts", F.array_position("__fields", F.lit(name)).cast("int"))
    plain = F.trim(F.replace(F.regexp_replace(at("text"), r"\\[Nn]", "\n"), F.lit("\\h"), F.lit(" ")))
    style = F.coalesce(F.nullif(F.trim(at("style")), F.lit("")), F.lit(DEFAULT_STYLE))
    start, end = CLOCK.parse_timecode(at("start")), CLOCK.parse_timecode(at("end"))
    bad = F.when(start.isNull() | end.isNull(), F.lit("SUBTITLE_BAD_TIME"))
    return ln.select(*key, F.row_number().over(w).cast("int").alias("idx"), start.alias("start_ms"), end.alias("end_ms"), plain.alias("text"), style.alias("style"), bad.alias("error_code"))


def shift(cues: DataFrame, seconds: float) -> DataFrame:
    """Cues moved in time; what falls before zero is zero, and clamped says so."""
    ms = F.lit(round(seconds * 1000)).cast("long")
    start, end = F.col("start_ms") + ms, F.col("end_ms") + ms
    first = F.greatest(F.lit(0), start)
    return cues.withColumns({"clamped": (start < 0) | (end < 0), "start_ms": first, "end_ms": F.greatest(F.lit(0), end, first)})


def merge_same_times(cues: DataFrame, *key: str) -> DataFrame:
    """Cues of one start and end become one, with each line once, in order; cues are numbered anew."""
    lines = cues.select(*key, "idx", "start_ms", "end_ms", F.posexplode(F.split("text", "\n")).alias("__n", "__line"))
    lines = lines.where("trim(__line) <> '' or __n = 0")
    ordered = F.array_sort(F.collect_list(F.struct("idx", "__n", "__line")))
    once = F.array_distinct(F.transform(ordered, lambda x: x["__line"]))
    got = lines.groupBy(*key, "start_ms", "end_ms").agg(F.min("idx").alias("__first"), F.array_join(once, "\n").alias("text"), F.count_distinct("idx").cast("long").alias("n_merged"))
    return got.withColumn("idx", F.row_number().over(W.partitionBy(*key).orderBy("__first")).cast("int")).drop("__first")


def drop_repeats(cues: DataFrame, *key: str) -> DataFrame:
    """Cues without text, and those whose text is that of the cue before, go."""
    said = cues.withColumn("text", F.trim("text")).where("text <> ''")
    return said.withColumn("__last", F.lag("text").over(W.partitionBy(*key).orderBy("idx"))).where("__last is null or __last <> text").drop("__last")


def cue_blocks(cues: DataFrame, target: str) -> DataFrame:
    """cues with block: how a cue stands in an srt, vtt, ass, csv or txt file."""
    arrow = lambda sep: F.concat(CLOCK.clock("start_ms", sep), F.lit(" --> "), CLOCK.clock("end_ms", sep))
    if target == "srt":
        block = F.concat_ws("\r\n", F.col("idx").cast("string"), arrow(","), F.col("text"))
    elif target == "vtt":
        safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        block = F.concat_ws("\n", arrow("."), safe)
    elif target == "ass":
        safe = F.regexp_replace(F.regexp_replace("text", r"\{(?!\\)", r"\\{"), r"(?<!\{\\[^{}]{0,255})\}", r"\\}")
        safe = F.replace(safe, F.lit("\n"), F.lit("\\N"))
        block = F.concat(F.lit("Dialogue: 0,"), CLOCK.ass_clock("start_ms"), F.lit(","), CLOCK.ass_clock("end_ms"), F.lit(","), F.coalesce("style", F.lit(DEFAULT_STYLE)), F.lit(",,0,0,0,,"), safe)
    elif target == "csv":
        block = X.csv_line(F.col("idx").cast("string"), CLOCK.clock("start_ms", "."), CLOCK.clock("end_ms", "."), F.col("text"))
    elif target == "txt":
        block = F.trim("text")
    else:
        raise ValueError(f"no such subtitle format: {target}")
    return cues.withColumn("block", block)


def render(cues: DataFrame, target: str, *key: str) -> DataFrame:
    """key, body: whole files.  Used styles of an ass file get a definition each, in the order they first occur."""
    shown = cue_blocks(drop_repeats(cues, *key) if target == "txt" else cues, target)
    sep = {"srt": "\\r\\n\\r\\n", "vtt": "\\n\\n", "ass": "\\r\\n", "csv": "\\r\\n", "txt": "\\n"}[target]
    got = shown.groupBy(*key).agg(F.expr(f"listagg(block, '{sep}') WITHIN GROUP (ORDER BY idx)").alias("body"))
    body = F.col("body")
    if target == "ass":
        first = cues.groupBy(*key, F.coalesce("style", F.lit(DEFAULT_STYLE)).alias("style")).agg(F.min("idx").alias("__at"))
        styles = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "style"))), lambda s: F.concat(F.lit("Style: "), s["style"], F.lit(ASS_STYLE))).alias("__styles"))
        got = got.join(styles, list(key)) if key else got.join(styles, how="cross")
        lines = F.concat(F.array(*(F.lit(x) for x in ASS_HEAD)), F.col("__styles"), F.array(*(F.lit(x) for x in ASS_EVENTS)), F.array(body, F.lit("")))
        return got.select(*key, F.array_join(lines, "\r\n").alias("body"))
    before = {"vtt": "WEBVTT\n\n", "csv": "序号,开始,结束,文本\r\n"}.get(target, "")
    after = {"srt": "\r\n", "csv": "\r\n"}.get(target, "\n")
    return got.select(*key, F.concat(F.lit(before), body, F.lit(after)).alias("body"))
