"""String, file-name and markup functions as Column expressions: built-ins only, so they stay within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters two cells wide, and of no width, as Java and RE2 character classes.
WIDE = "[\\x{1100}-\\x{115F}\\x{2E80}-\\x{303E}\\x{3041}-\\x{33FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{A000}-\\x{A4CF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE4F}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}\\x{1F300}-\\x{1F64F}\\x{1F900}-\\x{1F9FF}\\x{20000}-\\x{3FFFD}]"
NO_WIDTH = "[\\x{200B}-\\x{200D}\\x{FE00}-\\x{FE0F}]"
CJK = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]"
LATIN_WORD = "[A-Za-z0-9_'’-]+"
ILLEGAL_IN_NAMES = '[\\\\/:*?"<>|\\x00-\\x1f]'
#: Aliases of formats, media types of extensions, names of roles.
ALIASES = {
    "jpeg": "jpg", "jpe": "jpg", "htm": "html", "xhtml": "html", "yml": "yaml", "markdown": "md", "mdx": "md", "tif": "tiff", "ndjson": "jsonl",
    "ssa": "ass", "text": "txt", "log": "txt", "tgz": "tar", "conf": "ini", "cfg": "ini", "properties": "ini", "jfif": "jpg", "heif": "heic", "mpga": "mp3", "wavpack": "wav", "ssml": "txt",
}
MIME = {
    "txt": "text/plain", "md": "text/markdown", "json": "application/json", "jsonl": "application/x-ndjson", "csv": "text/csv", "tsv": "text/tab-separated-values",
    "html": "text/html", "htm": "text/html", "xml": "application/xml", "yaml": "application/yaml", "yml": "application/yaml", "png": "image/png", "jpg": "image/jpeg",
    "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "ico": "image/x-icon", "avif": "image/avif", "heic": "image/heic",
    "svg": "image/svg+xml", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "odt": "application/vnd.oasis.opendocument.text",
    "ods": "application/vnd.oasis.opendocument.spreadsheet", "epub": "application/epub+zip", "rtf": "application/rtf", "zip": "application/zip", "gz": "application/gzip",
    "tar": "application/x-tar", "7z": "application/x-7z-compressed", "rar": "application/vnd.rar", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg",
    "flac": "audio/flac", "m4a": "audio/mp4", "aac": "audio/aac", "opus": "audio/opus", "mp4": "video/mp4", "webm": "video/webm", "mkv": "video/x-matroska",
    "mov": "video/quicktime", "avi": "video/x-msvideo", "srt": "application/x-subrip", "vtt": "text/vtt", "ass": "text/x-ssa", "base64": "text/plain",
}
ROLES = {
    "user": "user", "human": "user", "prompt": "user", "我": "user", "你": "user", "用户": "user", "提问": "user", "me": "user", "您": "user", "customer": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "gpt": "assistant", "机器人": "assistant", "助手": "assistant", "模型": "assistant", "回答": "assistant",
    "chatgpt": "assistant", "claude": "assistant", "gemini": "assistant",
    "system": "system", "developer": "system", "系统": "system", "指令": "system", "tool": "tool", "function": "tool", "observation": "tool", "工具": "tool",
}
ENCODING_NAMES = {
    "utf-8": "UTF-8", "utf-8-bom": "UTF-8 (带 BOM)", "utf-16le": "UTF-16 LE", "utf-16be": "UTF-16 BE", "gb18030": "GB18030 (国标全集)", "gbk": "GBK / GB2312 (简体常见)", "big5": "Big5 (繁体)",
    "shift_jis": "Shift_JIS (日文)", "euc-kr": "EUC-KR (韩文)", "windows-1252": "Windows-1252 (西欧)",
}
ROLE_NAMES = {"user": "我", "assistant": "AI", "system": "系统", "tool": "工具", "unknown": "未知"}
KIND_TAGS = {"thinking": "（思考）", "tool_use": "（工具调用）", "tool_result": "（工具结果）"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(table: dict[str, str], key: Column) -> Column:
    """A small fixed map as a Column; null where the key is missing."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


# file names ---------------------------------------------------------------------------------------------------------


def file_name(path: Column | str) -> Column:
    """What stands after the last slash or backslash."""
    return F.regexp_extract(_c(path), r"([^\\/]*)$", 1)


def ext_of(path: Column | str) -> Column:
    """Extension in lower case; none for dotfiles and names that end in a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def base_name(path: Column | str) -> Column:
    """File name without its last extension."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def canonical_ext(ext: Column | str) -> Column:
    low = F.lower(_c(ext))
    return F.coalesce(lookup(ALIASES, low), low)


def mime_of(ext: Column | str) -> Column:
    return F.coalesce(lookup(MIME, F.lower(_c(ext))), F.lit("application/octet-stream"))


def safe_file_name(name: Column | str, fallback: str = "untitled") -> Column:
    """A name that every file system takes: no illegal characters, outer dots or runs of spaces, at most 120 characters."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(_c(name), F.lit("")), ILLEGAL_IN_NAMES, "_"), r"\s+", " "))
    out = F.regexp_replace(F.regexp_replace(out, r"^\.+", ""), r"\.+$", "")
    out = F.when(out == "", F.lit(fallback)).otherwise(out)
    stem, ext = F.substring(base_name(out), 1, 100), ext_of(out)
    return F.when(F.length(out) <= 120, out).when(ext == "", stem).otherwise(F.concat(stem, F.lit("."), ext))


def safe_path(path: Column | str) -> Column:
    """Each segment made safe; empty, `.` and `..` segments go, so nothing leads out of a folder."""
    parts = F.filter(F.split(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", ".", ".."))
    return F.array_join(F.transform(parts, lambda s: safe_file_name(s)), "/")


def format_bytes(n: Column | str) -> Column:
    """1023 B, 1.0 KB, 100 KB and so on."""
    n = F.coalesce(_c(n).cast("double"), F.lit(0.0))
    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        value = n / F.lit(float(1024**power))
        label = F.when(value >= 100, F.format_string("%.0f", F.round(value, 0))).otherwise(F.format_string("%.1f", F.round(value, 1)))
        label = F.concat(label, F.lit(f" {unit}"))
        out = out.when(value < 1024, label) if unit != "TB" else out.otherwise(label)
    return out


# cells and markup -----------------------------------------------------------------------------------------------------


def csv_quote(value: Column | str, delimiter: str = ",") -> Column:
    """RFC 4180: quoted only if need be; null is empty."""
    v = F.coalesce(_c(value).cast("string"), F.lit(""))
    need = F.contains(v, F.lit('"')) | F.contains(v, F.lit("\n")) | F.contains(v, F.lit("\r")) | F.contains(v, F.lit(delimiter))
    return F.when(need, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_line(*values: Column | str, delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *(csv_quote(v, delimiter) for v in values))


def html_escape(text: Column | str) -> Column:
    out = F.coalesce(_c(text).cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def markdown_cell(text: Column | str) -> Column:
    """Pipes escaped, line breaks as <br>."""
    v = F.replace(F.coalesce(_c(text).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(v, "\r?\n", "<br>")


def display_width(text: Column | str) -> Column:
    """Cells a text takes in a terminal: CJK and emoji two, joiners and selectors none."""
    t = F.coalesce(_c(text).cast("string"), F.lit(""))
    return (F.length(t) + F.regexp_count(t, F.lit(WIDE)) - F.regexp_count(t, F.lit(NO_WIDTH))).cast("int")


def pad_display(text: Column | str, width: Column) -> Column:
    t = F.coalesce(_c(text).cast("string"), F.lit(""))
    return F.concat(t, F.repeat(F.lit(" "), F.greatest(F.lit(0), width - display_width(t)).cast("int")))


def clean_title(text: Column | str, most: int = 80) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def column_name(header: Column | str, position: Column) -> Column:
    """A header cell, or 列N where it is blank."""
    t = F.trim(F.coalesce(_c(header).cast("string"), F.lit("")))
    return F.when(t == "", F.concat(F.lit("列"), position.cast("string"))).otherwise(t)


NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]*[1-9])?$"


def scalar_kind(text: Column | str) -> Column:
    """What a text cell is taken for: boolean, null, number or string.

    Numbers are canonical ones only, of at most 15 digits: `007`, `+5`, `1.50` and `1e5` stay text, and so does `-0`.
    """
    t = _c(text)
    number = t.rlike(NUMBER) & (F.length(F.regexp_replace(t, "[^0-9]", "")) <= 15) & (t != "-0")
    return F.when(t.isin("true", "false"), "boolean").when(t.isNull() | (t == "null"), "null").when(number, "number").otherwise("string")


def json_scalar(text: Column | str) -> Column:
    """The cell as JSON text, by scalar_kind."""
    t = _c(text)
    kind = scalar_kind(t)
    quoted = F.regexp_extract(F.to_json(F.struct(t.alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    return F.when(kind == "null", F.lit("null")).when(kind == "string", quoted).otherwise(t)


def strip_style_tags(text: Column | str) -> Column:
    """Override blocks in braces, tags in angle brackets and spaces at line ends go."""
    t = F.regexp_replace(F.regexp_replace(_c(text), r"\{[^}]*\}", ""), r"</?[^>]+>", "")
    return F.trim(F.regexp_replace(t, r"[ \t]+\n", "\n"))


def fenced_code(text: Column | str, language: str = "") -> Column:
    """The text in a fence longer than any run of backticks in it."""
    runs = F.transform(F.regexp_extract_all(_c(text), F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(fence, F.lit(f"{language}\n"), _c(text), F.lit("\n"), fence)


def chinese_number(n: Column | str) -> Column:
    """1 to 99 in Chinese, else in digits."""
    n = _c(n).cast("int")
    digit = F.array(*(F.lit(x) for x in ["", "一", "二", "三", "四", "五", "六", "七", "八", "九"]))
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    word = F.concat(F.when(tens > 1, digit[tens]).otherwise(F.lit("")), F.when(tens > 0, F.lit("十")).otherwise(F.lit("")), digit[ones])
    return F.when(n.between(1, 99), word).otherwise(n.cast("string"))


# roles ------------------------------------------------------------------------------------------------------------------


def normal_role(role: Column | str) -> Column:
    """One of user, assistant, system, tool for the usual names in several languages; others pass in lower case."""
    low = F.lower(F.trim(F.coalesce(_c(role), F.lit(""))))
    return F.when(low == "", F.lit("unknown")).otherwise(F.coalesce(lookup(ROLES, low), low))


def role_label(role: Column | str, name: Column | None = None, kind: Column | None = None, role_names: bool = True) -> Column:
    """The heading of a message: the role, a model's name in brackets, and what kind of message it is."""
    r = F.coalesce(_c(role), F.lit("unknown"))
    out = F.coalesce(lookup(ROLE_NAMES, r), r) if role_names else r
    if name is not None:
        tag = F.concat(F.lit("（"), name, F.lit("）"))
        out = F.when(r.isin("assistant", "tool") & (F.coalesce(name, F.lit("")) != ""), F.concat(out, tag)).otherwise(out)
    return out if kind is None else F.concat(out, F.coalesce(lookup(KIND_TAGS, kind), F.lit("")))


# text measures ------------------------------------------------------------------------------------------------------------


def text_stats(text: Column | str) -> dict[str, Column]:
    """chars (code points), lines, cjk and words; an empty or null text has no line."""
    t = F.coalesce(_c(text), F.lit(""))
    return {
        "chars": F.length(t).cast("long"),
        "lines": F.when(t == "", 0).otherwise(F.regexp_count(t, F.lit("\r\n|\r|\n")) + 1).cast("long"),
        "cjk": F.regexp_count(t, F.lit(CJK)).cast("long"),
        "words": F.regexp_count(t, F.lit(LATIN_WORD)).cast("long"),
    }


#: Signs of text that was decoded wrongly, and the share of characters above which each of them tells.
GARBLED = {
    "replaced": ("\\x{FFFD}", 0.02),
    "mojibake": ("[ÃÂÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞß][\\x{80}-\\x{FF}]", 0.05),
    "private": ("[\\x{E000}-\\x{F8FF}]", 0.02),
    "rare": ("[\\x{3000}-\\x{303F}\\x{3100}-\\x{312F}\\x{31C0}-\\x{31EF}]", 0.3),
}


def garbled_measures(text: Column | str, most: int = 4000) -> dict[str, Column]:
    """Replacement characters, mojibake pairs, private-use and rare characters in the first `most` characters (a probe)."""
    t = F.substring(F.coalesce(_c(text), F.lit("")), 1, most)
    return {k: F.regexp_count(t, F.lit(pattern)).cast("long") for k, (pattern, _) in GARBLED.items()} | {"size": F.length(t).cast("long")}


def looks_garbled(text: Column | str) -> Column:
    m = garbled_measures(text)
    out = F.lit(False)
    for k, (_, most) in GARBLED.items():
        out = out | (m[k] / F.greatest(m["size"], F.lit(1)) > most)
    return out


def preview(text: Column | str, most: int = 2000) -> Column:
    """The first characters of a text, as a report shows it; null is empty."""
    return F.substring(F.coalesce(_c(text), F.lit("")), 1, most)


def encoding_label(encoding: Column | str, confidence: Column | str) -> Column:
    """An encoding's name with what speaks for it: certain, or a share in percent."""
    e, c = _c(encoding), _c(confidence)
    name = F.coalesce(lookup(ENCODING_NAMES, e), e)
    sure = (e == "utf-8") & (c >= 0.95)
    return F.concat(name, F.when(sure, F.lit("（确定）")).otherwise(F.concat(F.lit("（置信度 "), F.floor(c * 100 + 0.5).cast("string"), F.lit("%）"))))


def control_share(text: Column | str) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return F.regexp_count(t, F.lit("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")) / F.greatest(F.length(t), F.lit(1))


def printable_share(text: Column | str) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return F.regexp_count(t, F.lit("[\\t\\n\\r\\x20-\\x7E\\x{A0}-\\x{10FFFF}]")) / F.greatest(F.length(t), F.lit(1))


# HTML ------------------------------------------------------------------------------------------------------------------------

NOISE_TAGS = "script|style|noscript|template|iframe|svg|canvas"


def strip_noise_html(html: Column | str) -> Column:
    """Comments and elements whose content is not text go."""
    out = F.regexp_replace(_c(html), r"(?is)<!--.*?-->", "")
    for tag in NOISE_TAGS.split("|"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def html_title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def declared_charset(content: Column | str) -> Column:
    """The charset that the first kilobyte of an HTML or XML file names, in lower case; empty if none."""
    head = F.decode(F.substring(_c(content), 1, 1024), "ISO-8859-1")
    return F.lower(F.regexp_extract(head, r"(?i)(?:charset|encoding)\s*=\s*[\"']?\s*([\w.:-]+)", 1))


def html_body(html: Column | str) -> Column:
    """What stands in body, or all of it."""
    b = F.regexp_extract(_c(html), r"(?is)<body[^>]*>(.*?)(?:</body>|$)", 1)
    return F.when(_c(html).rlike(r"(?i)<body"), b).otherwise(_c(html))


def strip_tags(html: Column | str) -> Column:
    return F.regexp_replace(_c(html), r"(?s)<[^>]*>", "")


def attribute_of(tag: Column | str, name: str) -> Column:
    t = _c(tag)
    return F.coalesce(F.nullif(F.regexp_extract(t, rf'(?i)\b{name}\s*=\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(t, rf"(?i)\b{name}\s*=\s*'([^']*)'", 1))


#: The five references every markup knows, and those of common typography; ampersand last.
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&"))


def decode_entities(text: Column | str) -> Column:
    out = _c(text)
    for ref, char in ENTITIES:
        out = F.replace(out, F.lit(ref), F.lit(char))
    return out


#: Ordered rewrites from HTML to plain text: pattern, replacement.
HTML_TO_TEXT = (
    (r"(?is)<!--.*?-->", ""),
    *((rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "") for t in ("head", "script", "style", "noscript", "template")),
    (r"\s+", " "),
    (r"(?i)<img\b[^>]*\balt\s*=\s*\"([^\"]+)\"[^>]*>", "[$1]"),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<hr\b[^>]*>", "\n----------\n"),
    (r"(?i)<br\b[^>]*>", "\n"),
    (r"(?i)</t[dh]>\s*", "\t"),
    (r"(?i)</?(?:p|div|section|article|main|header|footer|nav|aside|h[1-6]|ul|ol|table|tr|blockquote|pre|figure|title)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
)


def html_to_text(html: Column | str) -> Column:
    """Plain text: blocks on lines of their own, lists with dashes, cells by tabs, entities decoded, blank lines folded."""
    out = F.coalesce(_c(html), F.lit(""))
    for pattern, by in HTML_TO_TEXT:
        out = F.regexp_replace(out, pattern, by)
    out = decode_entities(out)
    out = F.regexp_replace(F.regexp_replace(out, "[ \\t]*\n[ \\t]*", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def markdown_to_text(md: Column | str) -> Column:
    """Marks of headings, emphasis, links, images, quotes, lists and fences go; what they mark stays."""
    out = F.coalesce(_c(md), F.lit(""))
    for pattern, by in (
        (r"(?m)^```.*$\n?", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^>\s?", ""),
        (r"(?m)^(\s*)[*+]\s+", "$1- "), (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"\*([^*\n]+)\*", "$1"), (r"`([^`\n]+)`", "$1"), (r"~~([^~]+)~~", "$1"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return out
