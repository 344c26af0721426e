"""What a file is: by its first bytes where those decide, else by a look inside."""

from __future__ import annotations

import gzip
import io
import json
import re
import zipfile
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions import encoding
from sheafline.functions import text as X
from sheafline.plans import registry
from sheafline.plans.rows import map_rows

#: Offset, bytes in hex, format, confidence; the first that fits decides.
MAGIC = (
    (0, "89504E470D0A1A0A", "png", 1.0), (0, "FFD8FF", "jpg", 1.0), (0, "47494638", "gif", 1.0), (0, "00000100", "ico", 0.95), (0, "25504446", "pdf", 1.0),
    (0, "1F8B", "gz", 0.95), (0, "377ABCAF271C", "7z", 1.0), (0, "526172211A07", "rar", 1.0), (0, "4F676753", "ogg", 0.95), (0, "664C6143", "flac", 1.0), (0, "494433", "mp3", 0.95),
    (0, "FFFB", "mp3", 0.8), (0, "FFF3", "mp3", 0.8), (0, "FFF1", "aac", 0.8), (0, "FFF9", "aac", 0.8), (0, "1A45DFA3", "mkv", 0.9), (0, "D0CF11E0A1B11AE1", "xls", 0.7), (0, "49492A00", "tiff", 1.0),
    (0, "4D4D002A", "tiff", 1.0), (0, "774F4632", "woff2", 1.0), (0, "00010000", "ttf", 0.8), (0, "4F54544F", "otf", 0.9), (0, "774F4646", "woff", 1.0),
    (0, "53514C69", "sqlite", 1.0), (0, "0061736D", "wasm", 1.0), (0, "CAFEBABE", "class", 0.9), (257, "7573746172", "tar", 0.98),
)
RIFF = {"57415645": "wav", "41564920": "avi", "57454250": "webp"}
BRANDS = {
    "heic": "heic", "heix": "heic", "hevc": "heic", "heim": "heic", "heis": "heic", "mif1": "heic", "msf1": "heic", "avif": "avif", "avis": "avif", "M4A ": "m4a", "M4B ": "m4a", "qt  ": "mov", "3gp4": "3gp",
    "3gp5": "3gp",
}
FAMILIES = {
    "image": "png jpg gif ico webp bmp tiff svg heic avif pnm", "audio": "mp3 ogg flac aac wav m4a opus", "video": "mkv avi mp4 mov webm 3gp", "archive": "zip gz tar tgz 7z rar",
    "font": "ttf otf woff woff2", "binary": "sqlite wasm class", "document": "pdf docx odt epub rtf pptx", "table": "xlsx xls ods csv tsv", "subtitle": "srt vtt ass", "text": "txt md json jsonl html xml yaml ini",
}


def by_magic(content: Column | str) -> Column:
    """The format that the first bytes name, or null; built-ins only."""
    c = F.col(content) if isinstance(content, str) else content
    at = lambda offset, n: F.hex(F.substring(c, offset + 1, n))
    out = F.when(at(0, 4) == "52494646", X.lookup(RIFF, at(8, 4)))
    brand = F.substring(c, 9, 4).cast("string")
    out = out.when(at(4, 4) == "66747970", F.coalesce(X.lookup(BRANDS, brand), F.lit("mp4")))
    for offset, magic, name, _ in MAGIC:
        out = out.when(at(offset, len(magic) // 2) == magic, name)
    # two-byte marks need the rest of the head to fit
    size = F.conv(F.concat(at(5, 1), at(4, 1), at(3, 1), at(2, 1)), 16, 10).cast("long")
    return out.when((at(0, 2) == "424D") & (size == F.octet_length(c)), "bmp").when(at(0, 1).eqNullSafe(F.lit("50")) & F.substring(c, 1, 3).cast("string").rlike(r"^P[2356]\s"), "pnm")


def zip_kind(data: bytes) -> str:
    """docx, xlsx, pptx, epub, odt or ods by the names within, else zip."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            said = z.read("mimetype")[:100].decode("latin-1") if "mimetype" in names else ""
    except (zipfile.BadZipFile, zlib.error, OSError):
        return "zip"
    for word, kind in (("epub", "epub"), ("opendocument.text", "odt"), ("opendocument.spreadsheet", "ods")):
        if word in said:
            return kind
    for start, kind in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"), ("META-INF/container.xml", "epub")):
        if any(n.startswith(start) for n in names):
            return kind
    return "zip"


def split_quoted(line: str, delimiter: str) -> list[str]:
    """Cells of one line of RFC 4180: a quote opens only an empty field, doubled quotes are one."""
    out, cell, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if quoted:
            if c == '"' and line[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            elif c == '"':
                quoted = False
            else:
                cell += c
        elif c == '"' and not cell:
            quoted = True
        elif c == delimiter:
            out.append(cell)
            cell = ""
        else:
            cell += c
        i += 1
    return [*out, cell]


def delimiter_of(text: str) -> str | None:
    """Comma, semicolon, bar or tab, if four of five of the first twelve lines have as many cells as the first, two at least."""
    lines = [x for x in re.split(r"\r\n|\r|\n", text) if x.strip()][:12]
    if len(lines) < 2:
        return None
    for d in ("\t", ",", ";", "|"):
        n = [len(split_quoted(x, d)) for x in lines]
        if n[0] >= 2 and 5 * sum(k == n[0] for k in n) >= 4 * len(n):
            return d
    return None


def _is_json(s: str) -> bool:
    try:
        json.loads(s)
        return True
    except ValueError:
        return False


RULES = (
    (r"(?i)\s*(?:<\?xml[\s\S]{0,200}?)?<svg[\s>]", "svg", 0.95), (r"(?i)\s*<!doctype html|\s*<html[\s>]", "html", 0.9), (r"(?i)\s*<\?xml", "xml", 0.85),
    (r"\s*\{\\(?:rtf|fonttbl)", "rtf", 0.9), (r"\s*WEBVTT", "vtt", 0.95), (r"(?i)\s*\[Script Info\]", "ass", 0.9), (r"\s*\d+\s*\r?\n\d{1,2}:\d{2}:\d{2}[,.]\d{1,3}\s*-->", "srt", 0.95),
)


#: A garbled text with control characters beyond this share is no text.
MOST_CONTROL = 0.02
GARBLED = [(re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), p)), most) for p, most in X.GARBLED.values()]


def garbled(text: str) -> bool:
    """What text.looks_garbled says of a column, of one text."""
    return any(len(p.findall(text)) > most * len(text) for p, most in GARBLED)


def text_kind(text: str, name: str = "") -> tuple[str, float]:
    """Format and confidence of a text; `bin` if it does not read as text."""
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    t = text.removeprefix("﻿")
    head = t.strip()[:1]
    if head in ("{", "["):
        if _is_json(t):
            return "json", 0.99
        lines = [x for x in t.splitlines() if x.strip()][:5]
        if lines and all(map(_is_json, lines)):
            return "jsonl", 0.95
    sample = t[: 1 << 16]
    if sum(c < " " and c not in "\t\n\r" for c in sample) > MOST_CONTROL * len(sample) and garbled(t[:4000]):
        return "bin", 0.3
    for rule, kind, sure in RULES:
        if re.match(rule, sample):
            return kind, sure
    if ext in ("md", "markdown", "mdx"):
        return "md", 0.8 if re.search(r"(?m)^(?:---$|#{1,6}\s|\s*[-*+]\s|\s*>\s)", sample) else 0.7
    if ext in ("yaml", "yml"):
        return "yaml", 0.8
    if ext in ("ini", "conf", "cfg", "env", "properties") and re.search(r"(?m)^[A-Za-z_][\w.-]*\s*[:=]\s*\S", sample):
        return "ini", 0.7
    d = delimiter_of(sample)
    if d:
        return ("tsv", 0.8) if d == "\t" else ("csv", 0.75)
    printable = sum(c in "\t\n\r" or "\x20" <= c <= "\x7e" or c >= "\xa0" for c in sample)
    return ("txt", 0.6) if sample and printable > 0.92 * len(sample) else ("bin", 0.3)


def look_inside(data: bytes | None, name: str | None, magic: str | None) -> tuple[str, float]:
    data, name = data or b"", name or ""
    if magic == "gz":
        try:
            with gzip.open(io.BytesIO(data)) as f:
                return ("tgz", 0.95) if f.read(512)[257:262] == b"ustar" else ("gz", 0.95)
        except (OSError, EOFError, zlib.error):
            return "gz", 0.9
    if magic:
        return magic, next((c for _, _, n, c in MAGIC if n == magic), 0.95)
    if data[:4] in (b"PK\3\4", b"PK\5\6", b"PK\7\x08"):
        return zip_kind(data), 0.98
    if not data:
        return "bin", 0.0
    return text_kind(encoding.decode(data), name)


def analyze(df: DataFrame, content: str = "content", name: str = "name") -> DataFrame:
    """df with size, size_label, declared_ext, ext, mime, family, confidence, encoding, targets and default_target."""
    df = df.withColumn("__magic", by_magic(content))
    textual = frozenset(FAMILIES["text"].split() + FAMILIES["subtitle"].split() + ["csv", "tsv", "svg", "rtf"])

    def run(data, name, magic):
        kind, sure = look_inside(data, name, magic)
        code, certain = encoding.detect(data) if kind in textual else (None, None)
        family = next((f for f, names in FAMILIES.items() if kind in names.split()), "other")
        return kind, sure, family, code, certain, registry.targets(kind), registry.default_target(kind)

    got = map_rows(df, run, [content, name, "__magic"], "ext string, confidence double, family string, encoding string, encoding_confidence double, targets array<string>, default_target string")
    size = F.coalesce(F.octet_length(content), F.lit(0)).cast("long")
    return got.withColumns({"size": size, "size_label": X.format_bytes(size), "declared_ext": X.canonical_ext(X.ext_of(name)), "mime": X.mime_of("ext")}).drop("__magic")


def text_format(text: Column | str) -> Column:
    """The rules for texts that built-ins can express, in their order; null where none fits."""
    t = F.col(text) if isinstance(text, str) else text
    head = F.substring(F.trim(t), 1, 1)
    out = F.when(head.isin("{", "[") & F.try_parse_json(t).isNotNull(), "json")
    for rule, kind, _ in RULES:
        out = out.when(t.rlike("^(?:" + rule + ")"), kind)
    return out
