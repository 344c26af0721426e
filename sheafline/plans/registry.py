"""Formats, converters and which targets each source can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, priority, sources, targets.
CONVERTERS = (
    ("chat-export", 95, "json jsonl", "txt md html jsonl csv"),
    ("document", 70, "docx txt md html rtf epub odt", "txt md html docx epub"),
    ("table", 80, "xlsx xls csv tsv ods json", "csv tsv xlsx json md html ods"),
    ("data", 40, "json jsonl yaml xml ini csv", "json jsonl yaml txt xml ini"),
    ("image", 90, "png jpg webp gif bmp ico avif heic svg tiff pnm", "png jpg webp bmp ico avif"),
    ("pdf", 85, "pdf png jpg webp bmp txt md html svg", "pdf png jpg txt md html"),
    ("archive", 60, "zip gz tar tgz", "zip gz tar txt json"),
    ("subtitle", 75, "srt vtt ass", "srt vtt ass txt csv"),
    ("media", 85, "mp3 wav ogg flac m4a aac opus mp4 webm mkv mov avi gif", "mp3 wav ogg flac m4a aac mp4 webm gif png jpg mp3cut"),
)
#: What a source is turned into unless told otherwise, as sources by target.
DEFAULTS = {
    "txt": "json jsonl rtf epub odt html pdf zip", "md": "docx", "docx": "txt", "html": "md", "csv": "xlsx xls ods tsv", "xlsx": "csv", "json": "yaml xml ini", "png": "png jpg tiff svg pnm bmp ico",
    "jpg": "heic avif webp", "mp4": "gif mkv mov avi webm", "mp3": "mp3 m4a flac wav ogg opus aac mp4", "zip": "gz tar tgz", "vtt": "srt", "srt": "vtt ass",
}
DEFAULT_TARGETS = {s: t for t, sources in DEFAULTS.items() for s in sources.split()}
#: Which converters may write the format they read: those whose own formats these are.
OWN = {
    "document": "txt md html rtf docx odt epub", "data": "txt md json jsonl yaml xml ini csv", "table": "csv tsv xlsx xls ods", "image": "png jpg webp avif bmp ico heic tiff svg gif",
    "pdf": "pdf", "media": "mp3 wav ogg flac m4a aac opus mp4 webm mkv mov avi gif", "subtitle": "srt vtt ass", "archive": "zip gz tar tgz",
}
#: Failures after which the next converter is tried.
SOFT = ("UNKNOWN", "NOT_APPLICABLE", "MISMATCH", "UNSUPPORTED_FORMAT")


def candidates(source: str, target: str, forced: str | None = None) -> list[str]:
    """Converters for a pair, by falling priority; a forced one comes first if it can do it."""
    found = [n for n, _, src, dst in sorted(CONVERTERS, key=lambda c: -c[1]) if source in src.split() and target in dst.split() and (source != target or source in OWN.get(n, "").split())]
    return [forced, *(n for n in found if n != forced)] if forced in found else found


def targets(source: str) -> list[str]:
    return list(dict.fromkeys(t for _, _, src, dst in sorted(CONVERTERS, key=lambda c: -c[1]) if source in src.split() for t in dst.split()))


def default_target(source: str) -> str | None:
    return DEFAULT_TARGETS.get(source) or next(iter(targets(source)), None)


def is_soft(code: str | None) -> bool:
    return bool(code) and code.endswith(SOFT)


def converters(spark: SparkSession) -> DataFrame:
    """converter, priority, source, target: a row for each pair a converter takes."""
    rows = [(n, p, s, t) for n, p, src, dst in CONVERTERS for s in src.split() for t in dst.split()]
    return spark.createDataFrame(rows, "converter string, priority int, source string, target string")


def matrix(spark: SparkSession) -> DataFrame:
    """source, target, cascade: the ordered converters of each pair, and the source's default target."""
    from pyspark.sql import functions as F

    ordered = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "converter")))
    own = F.lit(False)
    for name, formats in OWN.items():
        own = own | ((F.col("converter") == name) & F.col("source").isin(formats.split()))
    rows = converters(spark).where((F.col("source") != F.col("target")) | own).groupBy("source", "target").agg(F.array_join(F.transform(ordered, lambda c: c["converter"]), ">").alias("cascade"))
    defaults = spark.createDataFrame(sorted(DEFAULT_TARGETS.items()), "source string, default_target string")
    return rows.join(defaults, "source", "left")
