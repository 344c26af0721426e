"""Queries over small made inputs, for what the driver's tables do not hold, with results written out as SQL literals.

The expected values are the formats' own and those of the behaviour that is matched; none of them is computed by this package.
"""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions import encoding
from sheafline.functions import text as X
from sheafline.functions import time as CLOCK
from sheafline.operators import archive, chat, detect, document, grid, image, media, pdf_items, structured, subtitle
from sheafline.plans import report
from sheafline.plans.convert import convert
from sheafline.plans.rows import map_rows
from sheafline.sources import chat_exports, delimited, workbook

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for rows; columns: name type, with types of both engines."""
    named = [c.split() for c in columns.split(", ")]
    select = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in named)
    return f"SELECT {select} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS v({', '.join(n for n, _ in named)})"


def case(columns: str, expected: list[tuple]):
    """Registers a query of a session under its function's name, with its expected rows."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(spark)
        ORACLES[fn.__name__] = values(columns, expected)
        return fn

    return add


def rows_of(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# formats and routing ----------------------------------------------------------------------------------------------------------

#: What each source is turned into by default, and by which converters into each target, as sources sharing a line.
ROUTES = """
json > txt : txt=chat-export>data md=chat-export>table html=chat-export>table jsonl=chat-export>data csv=chat-export>table tsv=table xlsx=table json=data ods=table yaml=data xml=data ini=data
jsonl > txt : txt=chat-export>data md=chat-export html=chat-export jsonl=data csv=chat-export json=data yaml=data xml=data ini=data
docx > md : txt=document md=document html=document docx=document epub=document
txt > docx : pdf=pdf png=pdf jpg=pdf txt=document md=pdf>document html=pdf>document docx=document epub=document
md > html : pdf=pdf png=pdf jpg=pdf txt=pdf>document md=document html=pdf>document docx=document epub=document
html > txt : pdf=pdf png=pdf jpg=pdf txt=pdf>document md=pdf>document html=document docx=document epub=document
rtf epub odt > txt : txt=document md=document html=document docx=document epub=document
xlsx xls tsv ods > csv : csv=table tsv=table xlsx=table json=table md=table html=table ods=table
csv > xlsx : csv=table tsv=table xlsx=table json=table>data md=table html=table ods=table jsonl=data yaml=data txt=data xml=data ini=data
yaml xml ini > json : json=data jsonl=data yaml=data txt=data xml=data ini=data
png > png : png=image jpg=image>pdf webp=image bmp=image ico=image avif=image pdf=pdf txt=pdf md=pdf html=pdf
jpg > png : png=image>pdf jpg=image webp=image bmp=image ico=image avif=image pdf=pdf txt=pdf md=pdf html=pdf
webp > jpg : png=image>pdf jpg=image>pdf webp=image bmp=image ico=image avif=image pdf=pdf txt=pdf md=pdf html=pdf
bmp svg > png : png=image>pdf jpg=image>pdf webp=image bmp=image ico=image avif=image pdf=pdf txt=pdf md=pdf html=pdf
gif > mp4 : png=image>media jpg=image>media webp=image bmp=image ico=image avif=image mp3=media wav=media ogg=media flac=media m4a=media aac=media mp4=media webm=media gif=media mp3cut=media
ico tiff pnm > png : png=image jpg=image webp=image bmp=image ico=image avif=image
avif heic > jpg : png=image jpg=image webp=image bmp=image ico=image avif=image
pdf > txt : pdf=pdf png=pdf jpg=pdf txt=pdf md=pdf html=pdf
zip > txt : zip=archive gz=archive tar=archive txt=archive json=archive
gz tar tgz > zip : zip=archive gz=archive tar=archive txt=archive json=archive
srt > vtt : srt=subtitle vtt=subtitle ass=subtitle txt=subtitle csv=subtitle
vtt ass > srt : srt=subtitle vtt=subtitle ass=subtitle txt=subtitle csv=subtitle
mp3 wav ogg flac m4a aac opus mp4 > mp3 : mp3=media wav=media ogg=media flac=media m4a=media aac=media mp4=media webm=media gif=media png=media jpg=media mp3cut=media
webm mkv mov avi > mp4 : mp3=media wav=media ogg=media flac=media m4a=media aac=media mp4=media webm=media gif=media png=media jpg=media mp3cut=media
""".strip()
_ROUTES = [
    (source, target, cascade, default.strip())
    for line in ROUTES.splitlines()
    for head, _, routes in [line.partition(" : ")]
    for sources, _, default in [head.partition(" > ")]
    for source in sources.split()
    for target, _, cascade in (r.partition("=") for r in routes.split())
]
MATRIX_SQL = values("source VARCHAR, target VARCHAR, cascade VARCHAR, default_target VARCHAR", _ROUTES)


def _zip(*files: tuple[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files:
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 2, 3, 4, 6)), body)
    return out.getvalue()


def _tar(*files: tuple[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, body in files:
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(body), 1704164646
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def _ftyp(brand: str) -> bytes:
    return b"\0\0\0\x18ftyp" + brand.encode() + b"\0\0\0\0mp42isom"


ODF_HEAD = '<?xml version="1.0"?><office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"><office:body>'
ODT = _zip(("mimetype", "application/vnd.oasis.opendocument.text"), ("content.xml", ODF_HEAD + '<office:text><text:h text:outline-level="1">标题</text:h><text:p>正文一</text:p></office:text></office:body></office:document-content>'))
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
XLSX = _zip(
    ("[Content_Types].xml", "<Types/>"),
    ("xl/workbook.xml", f'<workbook xmlns="{SHEET}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="人员" sheetId="1" r:id="rId1"/></sheets></workbook>'),
    ("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>'),
    ("xl/sharedStrings.xml", f'<sst xmlns="{SHEET}"><si><t>姓名</t></si><si><r><t>张</t></r><r><t>三</t></r></si></sst>'),
    ("xl/styles.xml", f'<styleSheet xmlns="{SHEET}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'),
    ("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{SHEET}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>30</v></c><c r="C2" s="1"><v>45292</v></c></row></sheetData></worksheet>'),
)
SRT = "1\n00:00:01,000 --> 00:00:04,000\n你好<i>世界</i>\n\n2\n00:00:05,500 --> 00:00:08,250\nsecond\nline\n"
VTT = "WEBVTT\n\nNOTE a remark\n\n00:01.000 --> 00:02.500 align:start\nA &amp; B\n\nintro\n00:03.000 --> 00:04.000\nlast\n"
ASS = "[Script Info]\nTitle: t\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,one, two\\Nthree\nDialogue: 0,0:00:03.00,0:00:04.00,Top,,0,0,0,,four\n"
RTF = b"{\\rtf1\\ansi\\ansicpg936{\\fonttbl{\\f0 x;}}\\'c4\\'e3\\'ba\\'c3\\par \\u20320?x}"
KINDS = [
    ("png", "a", b"\x89PNG\r\n\x1a\n" + bytes(8)), ("jpg", "a", b"\xff\xd8\xff\xe0" + bytes(8)), ("gif", "a", b"GIF89a" + bytes(8)), ("pdf", "a", b"%PDF-1.7\n"), ("wav", "a", b"RIFF\0\0\0\0WAVEfmt "),
    ("avi", "a", b"RIFF\0\0\0\0AVI LIST"), ("webp", "a", b"RIFF\0\0\0\0WEBPVP8 "), ("mp3", "a", b"ID3\4" + bytes(8)), ("flac", "a", b"fLaC" + bytes(8)), ("ogg", "a", b"OggS" + bytes(8)), ("mkv", "a", b"\x1aE\xdf\xa3" + bytes(8)),
    ("ttf", "a", b"\0\1\0\0" + bytes(8)), ("otf", "a", b"OTTO" + bytes(8)), ("woff", "a", b"wOFF" + bytes(8)), ("sqlite", "a", b"SQLite format 3\0"), ("wasm", "a", b"\0asm\1\0\0\0"), ("class", "a", b"\xca\xfe\xba\xbe\0\0\0\x34"),
    ("heic", "a", _ftyp("heic")), ("heic", "b", _ftyp("msf1")), ("avif", "a", _ftyp("avif")), ("mp4", "a", _ftyp("isom")), ("m4a", "a", _ftyp("M4A ")), ("mov", "a", _ftyp("qt  ")), ("3gp", "a", _ftyp("3gp4")),
    ("ico", "a", b"\0\0\1\0\1\0" + bytes(16)), ("tiff", "a", b"II*\0" + bytes(8)), ("7z", "a", b"7z\xbc\xaf\x27\x1c" + bytes(8)), ("zip", "a", _zip(("x.txt", "x"))), ("docx", "a", _zip(("word/document.xml", "<w/>"))),
    ("xlsx", "a", XLSX), ("odt", "a", ODT), ("epub", "a", _zip(("mimetype", "application/epub+zip"))), ("gz", "a", gzip.compress(b"x" * 20, mtime=0)), ("tgz", "a", gzip.compress(_tar(("x", b"x")), mtime=0)), ("tar", "a", _tar(("x", b"x"))),
    ("json", "a", b'{"a": [1, 2]}'), ("json", "large", b"[" + b'{"key": "value"},' * 80_000 + b"{}]"), ("jsonl", "a", b'{"a":1}\n{"a":2}\n'), ("srt", "a", SRT.encode()), ("vtt", "a", VTT.encode()), ("ass", "a", ASS.encode()),
    ("rtf", "a", RTF), ("svg", "a", b"<svg xmlns='x'></svg>"), ("html", "a", b"<!DOCTYPE html><p>x"), ("xml", "a", b"<?xml version='1.0'?><a/>"), ("csv", "a", b"a,b\n1,2\n3,4\n"), ("tsv", "a", b"a\tb\n1\t2\n3\t4\n"),
    ("md", "a.md", b"# Title\n\ntext"), ("ini", "a.ini", b"[s]\nk = v\n"), ("yaml", "a.yaml", b"k: v\n"), ("txt", "a.txt", b"plain words here"), ("txt", "gbk.txt", "今天天气很好，我们去公园散步吧".encode("gbk")), ("bin", "a", bytes(8)),
]


@case("pos INTEGER, ext VARCHAR", [(i, k) for i, (k, _, _) in enumerate(KINDS)])
def detect_kinds(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "pos int, name string, content binary", [(i, n, b) for i, (_, n, b) in enumerate(KINDS)])
    return detect.analyze(df).select("pos", "ext")


ENCODED = [
    ("gb18030", "今天天气很好，我们去公园散步吧", "gbk"), ("big5", "今天天氣很好，我們去公園散步吧", "big5"), ("shift_jis", "今日はとても天気がいいですね。公園に行きましょう", "cp932"), ("windows-1252", "Café déjà vu naïve", "cp1252"),
    ("utf-8", "混合 mixed текст", "utf-8"), ("utf-8-bom", "带标记", "utf-8-sig"), ("utf-16le", "plain text", "utf-16-le"), ("utf-16be", "plain text", "utf-16-be"),
]


@case("pos INTEGER, encoding VARCHAR, text VARCHAR", [(i, e, t) for i, (e, t, _) in enumerate(ENCODED)])
def encoding_detect(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "pos int, content binary", [(i, t.encode(c)) for i, (_, t, c) in enumerate(ENCODED)])
    return encoding.with_encoding(df).select("pos", "encoding", "text")


@case("encoding VARCHAR, label VARCHAR", [("utf-8", "UTF-8（确定）"), ("big5", "Big5 (繁体)（置信度 88%）"), ("gb18030", "GB18030 (国标全集)（置信度 100%）"), ("koi8-r", "koi8-r（置信度 50%）")])
def encoding_labels(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "encoding string, confidence double", [("utf-8", 0.99), ("big5", 0.876), ("gb18030", 1.0), ("koi8-r", 0.5)])
    return df.select("encoding", X.encoding_label("encoding", "confidence").alias("label"))


@case("ext VARCHAR, canonical VARCHAR", [("JPEG", "jpg"), ("jfif", "jpg"), ("heif", "heic"), ("tgz", "tar"), ("ssa", "ass"), ("ndjson", "jsonl"), ("mpga", "mp3"), ("wavpack", "wav"), ("ssml", "txt"), ("log", "txt"), ("xhtml", "html"), ("pdf", "pdf")])
def format_aliases(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "ext string", [(e,) for e in "JPEG jfif heif tgz ssa ndjson mpga wavpack ssml log xhtml pdf".split()])
    return df.select("ext", X.canonical_ext(F.lower("ext")).alias("canonical"))


# chat exports -------------------------------------------------------------------------------------------------------------------


def _node(i: str, parent: str | None, role: str, text: str, time: float) -> dict:
    return {"id": i, "parent": parent, "children": [], "message": {"author": {"role": role}, "create_time": time, "content": {"content_type": "text", "parts": [text]}, "metadata": {}}}


EXPORTS = [
    [{"title": "树", "create_time": 1700000000, "current_node": "b", "mapping": {"b": _node("b", "a", "assistant", "答", 1700000020), "x1": _node("x1", "a", "assistant", "弃", 1700000010), "a": _node("a", "r", "user", "问", 1700000005000), "r": {"id": "r", "parent": None, "children": ["a"], "message": None}}}],
    [{"uuid": "u", "name": "克", "created_at": "2024-01-01T00:00:00Z", "chat_messages": [{"uuid": "1", "sender": "human", "created_at": "2024-01-01T00:00:00Z", "text": "hi", "content": []}, {"uuid": "2", "sender": "assistant", "created_at": "2024-01-01T00:00:05Z", "text": "", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hello"}]}]}],
    {"data": {"sections": [{"title": "s", "conversations": [{"title": "节", "messages": [{"role": "user", "content": "一"}, {"role": "model", "content": "二"}]}]}]}},
    [{"role": "prompt", "content": "q"}, {"role": "回答", "content": "a"}],
    {"dialogue": [{"speaker": "提问", "text": "q2"}, {"speaker": "observation", "text": "t"}]},
    [{"header": "h", "title": "双", "time": "2024-01-01T00:00:00Z", "products": ["p"], "subtasks": [{"title": "你", "snippets": [{"name": "问题"}]}, {"title": "它", "snippets": [{"name": "回应"}]}]}],
    "2024-03-01 20:11:33 小明(123)\n早\n\n20:12 \n无名\n小红 2024-03-01 20:13\n好\n阿强（9） 20:14:05\n走\n",
]
SAID = [
    (0, 1, "user", None, "text", "问"), (0, 2, "assistant", None, "text", "答"), (1, 1, "user", None, "text", "hi"), (1, 2, "assistant", None, "thinking", "hm"), (1, 3, "assistant", None, "text", "hello"),
    (2, 1, "user", None, "text", "一"), (2, 2, "assistant", None, "text", "二"), (3, 1, "user", None, "text", "q"), (3, 2, "assistant", None, "text", "a"), (4, 1, "user", None, "text", "q2"), (4, 2, "tool", None, "text", "t"),
    (5, 1, "user", None, "text", "问题"), (5, 2, "assistant", None, "text", "回应"),
    (6, 1, "user", "小明", "text", "早"), (6, 2, "assistant", None, "text", "无名"), (6, 3, "user", "小红", "text", "好"), (6, 4, "user", "阿强", "text", "走"),
]


def _exports(spark: SparkSession) -> DataFrame:
    return rows_of(spark, "pos int, text string, ext string", [(i, x if isinstance(x, str) else json.dumps(x, ensure_ascii=False), "txt" if isinstance(x, str) else "json") for i, x in enumerate(EXPORTS)])


@case("pos INTEGER, msg_pos INTEGER, role VARCHAR, name VARCHAR, kind VARCHAR, text VARCHAR", SAID)
def chat_exports_read(spark: SparkSession) -> DataFrame:
    return chat_exports.read(_exports(spark)).select("pos", "msg_pos", "role", "name", "kind", "text")


@case("pos INTEGER, shown VARCHAR", [(0, "2023-11-14 22:13"), (0, "2023-11-14 22:13"), (1, "2024-01-01 00:00"), (1, "2024-01-01 00:00"), (1, "2024-01-01 00:00"), (6, "2024-03-01 20:11"), (6, "2024-03-01 20:12"), (6, "2024-03-01 20:13"), (6, "2024-03-01 20:14")])
def chat_export_times(spark: SparkSession) -> DataFrame:
    return chat_exports.read(_exports(spark)).where("time is not null").select("pos", CLOCK.format_time("time").alias("shown"))


@case("pos INTEGER, is_chat BOOLEAN", [(0, True), (1, True), (2, True), (3, True), (4, True), (5, True), (6, False), (7, False)])
def chat_probe(spark: SparkSession) -> DataFrame:
    more = rows_of(spark, "pos int, text string, ext string", [(7, '{"a": 1}', "json")])
    return chat_exports.probe(_exports(spark).union(more)).select("pos", "is_chat")


MANY = [{"title": f"t{i}", "messages": [{"role": "user", "content": f"m{i}", "created_at": 1700000000 + 60 * i}]} for i in (2, 0, 3, 1)]


@case("conv_pos INTEGER, title VARCHAR", [(1, "t0"), (2, "t1"), (3, "t2")])
def chat_row_cap(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "text string", [(json.dumps(MANY),)])
    return chat_exports.read(df, max_conversations=3).select("conv_pos", "title")


RULE = "─" * 32
TALK = [
    (1, 1, 1, "user", None, "2024-01-01 08:00:00", "text", "甲", "早上好\n```\ncode\n```"), (1, 1, 2, "assistant", "m1", "2024-01-01 08:01:00", "text", "甲", "好 & <b>"), (1, 2, 1, "user", None, "2024-01-01 07:30:00", "text", "乙", "先"),
    (1, 2, 2, "assistant", None, None, "thinking", "乙", "想"), (2, 1, 1, "user", None, None, "text", "独", "一句"),
]


def _talk(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "file int, conv int, msg int, role string, name string, at string, kind string, title string, text string", TALK)
    return df.withColumn("time", F.col("at").cast("timestamp")).drop("at")


def _rendered(**how):
    return lambda spark: chat.render(_talk(spark), "file", **how).select("file", "name", "body")


TOC = "会话目录（共 2 个）\n  1. 甲 —— 2 条，2024-01-01 08:00 ~ 2024-01-01 08:01\n  2. 乙 —— 2 条，2024-01-01 07:30"
MD_TOC = "> 共 2 个会话\n\n1. 甲 —— 2 条，2024-01-01 08:00 ~ 2024-01-01 08:01\n2. 乙 —— 2 条，2024-01-01 07:30"
DOCUMENTS = {
    "txt_chat": (dict(target="txt"), [
        f"{TOC}\n\n{RULE}\n会话标题：甲\n{RULE}\n\n[2024-01-01 08:00] 我：\n  早上好\n```\ncode\n```\n\n[2024-01-01 08:01] AI（m1）：\n  好 & <b>\n\n{RULE}\n会话标题：乙\n{RULE}\n\n[2024-01-01 07:30] 我：\n  先\n\nAI（思考）：\n  想\n",
        f"{RULE}\n会话标题：独\n{RULE}\n\n我：\n  一句\n",
    ]),
    "md_chat": (dict(target="md"), [
        f"{MD_TOC}\n\n## 甲\n\n**[2024-01-01 08:00] 我：**\n早上好\n```\ncode\n```\n\n**[2024-01-01 08:01] AI（m1）：**\n好 & <b>\n\n## 乙\n\n**[2024-01-01 07:30] 我：**\n先\n\n**AI（思考）：**\n想\n",
        "## 独\n\n**我：**\n一句\n",
    ]),
    "md_transcript": (dict(target="md", layout="transcript"), [
        f"{MD_TOC}\n\n## 甲\n\n**我** · 2024-01-01 08:00\n\n早上好\n```\ncode\n```\n\n**AI（m1）** · 2024-01-01 08:01\n\n好 & <b>\n\n## 乙\n\n**我** · 2024-01-01 07:30\n\n先\n\n**AI（思考）**\n\n想\n",
        "## 独\n\n**我**\n\n一句\n",
    ]),
    "txt_timeline": (dict(target="txt", layout="timeline"), [
        "[2024-01-01 07:30] 乙 · 我：\n  先\n\n[2024-01-01 08:00] 甲 · 我：\n  早上好\n```\ncode\n```\n\n[2024-01-01 08:01] 甲 · AI（m1）：\n  好 & <b>\n\n乙 · AI（思考）：\n  想\n", "我：\n  一句\n",
    ]),
    "txt_plain": (dict(target="txt", layout="plain", timestamps=False), ["早上好\n```\ncode\n```\n\n好 & <b>\n\n\n先\n\n想\n", "一句\n"]),
    "txt_bare": (dict(target="txt", titles=False, timestamps=False, role_names=False), ["user：\n  早上好\n```\ncode\n```\n\nassistant（m1）：\n  好 & <b>\n\nuser：\n  先\n\nassistant（思考）：\n  想\n", "user：\n  一句\n"]),
    "jsonl": (dict(target="jsonl"), [
        '{"conversation":1,"title":"甲","index":1,"role":"user","time":"2024-01-01 08:00","text":"早上好\\n```\\ncode\\n```"}\n{"conversation":1,"title":"甲","index":2,"role":"assistant","time":"2024-01-01 08:01","text":"好 & <b>"}\n'
        '{"conversation":2,"title":"乙","index":1,"role":"user","time":"2024-01-01 07:30","text":"先"}\n{"conversation":2,"title":"乙","index":2,"role":"assistant","time":"","text":"想"}\n',
        '{"conversation":1,"title":"独","index":1,"role":"user","time":"","text":"一句"}\n',
    ]),
    "csv": (dict(target="csv"), [
        '会话,序号,角色,时间,内容\r\n甲,1,我,2024-01-01 08:00,"早上好\n```\ncode\n```"\r\n甲,2,AI（m1）,2024-01-01 08:01,好 & <b>\r\n乙,1,我,2024-01-01 07:30,先\r\n乙,2,AI,,想\r\n', "会话,序号,角色,时间,内容\r\n独,1,我,,一句\r\n",
    ]),
}
for _key, (_how, _bodies) in DOCUMENTS.items():
    _fn = _rendered(**_how)
    _fn.__name__ = f"chat_document_{_key}"
    case("file INTEGER, name VARCHAR, body VARCHAR", [(1, f"会话记录-2个会话.{_how['target']}", _bodies[0]), (2, f"独.{_how['target']}", _bodies[1])])(_fn)


@case("file INTEGER, n_title INTEGER, items VARCHAR, bodies INTEGER, escaped BOOLEAN", [(1, 2, "<li>甲 —— 2 条，2024-01-01 08:00 ~ 2024-01-01 08:01</li><li>乙 —— 2 条，2024-01-01 07:30</li>", 4, True), (2, 1, "", 1, False)])
def chat_document_html(spark: SparkSession) -> DataFrame:
    body = chat.render(_talk(spark), "file", target="html").select("file", "body")
    count = lambda p: F.regexp_count("body", F.lit(p)).cast("int")
    return body.select("file", count("<h2>").alias("n_title"), F.regexp_extract("body", '<ul class="toc">(.*)</ul>', 1).alias("items"), count('<pre class="body">').alias("bodies"), F.col("body").contains("好 &amp; &lt;b&gt;").alias("escaped"))


@case("file INTEGER, name VARCHAR, size INTEGER", [(1, "甲.txt", 153), (1, "乙.txt", 113), (2, "独.txt", 82)])
def chat_files_by_conversation(spark: SparkSession) -> DataFrame:
    return chat.render(_talk(spark), "file", "conv").select("file", "name", F.length("body").cast("int").alias("size"))


# documents, tables, archives ----------------------------------------------------------------------------------------------------

EPUB = _zip(
    ("mimetype", "application/epub+zip"), ("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>'),
    ("OEBPS/c.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>书</dc:title></metadata><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'),
    ("OEBPS/a.xhtml", "<html><body><h1>第一章</h1><p>甲</p></body></html>"), ("OEBPS/b.xhtml", "<html><body><h1>第二章</h1><p>乙</p></body></html>"),
)
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DOCX = _zip(
    ("[Content_Types].xml", "<Types/>"),
    ("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>标题</w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve">正文 </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>粗</w:t></w:r></w:p></w:body></w:document>'),
)


@case("kind VARCHAR, text VARCHAR", [("odt", "标题\n正文一"), ("rtf", "你好\n你x"), ("epub", "第一章\n甲\n第二章\n乙"), ("docx", "标题\n正文 粗"), ("html", "T\nx"), ("md", "T\nx")])
def documents_read(spark: SparkSession) -> DataFrame:
    files = [("odt", ODT), ("rtf", RTF), ("epub", EPUB), ("docx", DOCX), ("html", b"<html><body><h1>T</h1><p>x</p></body></html>"), ("md", b"# T\n\nx\n")]
    df = rows_of(spark, "kind string, content binary", files)
    got = map_rows(df, lambda b, k: (document.plain_text(document.to_markdown(b, k)[0]),), ["content", "kind"], "text string", keep=["kind"])
    return got.select("kind", F.regexp_replace(F.regexp_replace("text", "^\\s+|\\s+$", ""), "\\s*\n\\s*", "\n").alias("text"))


@case("style VARCHAR, text VARCHAR", [
    ("hash", "# 甲\n## 乙\n## 丙\n### 丁\n#### 戊\n# 己\n## 庚"), ("number", "一、甲\n（一）乙\n（二）丙\n1. 丁\n  (1) 戊\n二、己\n（一）庚"), ("plain", "甲\n乙\n丙\n丁\n戊\n己\n庚"),
])
def heading_styles(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "style string, md string", [(s, "# 甲\n## 乙\n## 丙\n### 丁\n#### 戊\n# 己\n## 庚") for s in ("hash", "number", "plain")])
    return map_rows(df, lambda m, s: (document.restyle_headings(m, s),), ["md", "style"], "text string", keep=["style"]).select("style", "text")


@case("n INTEGER, text VARCHAR", [(1, "一、x"), (10, "十、x"), (11, "十一、x"), (20, "二十、x"), (21, "二十一、x"), (99, "九十九、x"), (100, "100、x")])
def heading_numerals(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "n int", [(n,) for n in (1, 10, 11, 20, 21, 99, 100)])
    return map_rows(df, lambda n: (document.restyle_headings("\n".join(["# x"] * n), "number").split("\n")[-1],), ["n"], "text string", keep=["n"]).select("n", "text")


@case("row_pos INTEGER, sheet VARCHAR, cells VARCHAR[]", [(1, "人员", ["姓名", None, "x"]), (2, "人员", ["张三", "30", "2024-01-01"])])
def workbook_read(spark: SparkSession) -> DataFrame:
    return workbook.read(rows_of(spark, "content binary", [(XLSX,)])).select("row_pos", "sheet", "cells")


@case("row_pos INTEGER, sheet VARCHAR, cells VARCHAR[]", [(1, "表", ["编号", "邮编"]), (2, "表", ["007", "100080"]), (3, "表", ["true", "a\nb"])])
def ods_round_trip(spark: SparkSession) -> DataFrame:
    df = map_rows(rows_of(spark, "n int", [(1,)]), lambda n: (workbook.write_ods([("表", [["编号", "邮编"], ["007", "100080"], ["true", "a\nb"]])]),), ["n"], "content binary")
    return workbook.read(df.select("content")).select("row_pos", "sheet", "cells")


ARCHIVES = {"a.zip": _zip(("甲.txt", "one"), (".hid", "h"), ("d/二.txt", "twotwo")), "b.tar": _tar(("甲.txt", b"one"), ("d/b", b"twotwo")), "c.tgz": gzip.compress(_tar(("甲.txt", b"one")), mtime=0), "e.txt.gz": gzip.compress(b"inner", mtime=0), "bad.zip": b"PK\3\4junk"}


@case("name VARCHAR, entry VARCHAR, body VARCHAR, error_code VARCHAR", [
    ("a.zip", ".hid", "h", None), ("a.zip", "d/二.txt", "twotwo", None), ("a.zip", "甲.txt", "one", None), ("b.tar", "d/b", "twotwo", None), ("b.tar", "甲.txt", "one", None), ("c.tgz", "甲.txt", "one", None), ("e.txt.gz", "e.txt", "inner", None), ("bad.zip", None, None, "ARCHIVE_READ_FAILED"),
])
def archives_read(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "name string, content binary", list(ARCHIVES.items()))
    return archive.entries(df).select("name", "entry", F.col("bytes").cast("string").alias("body"), "error_code")


@case("name VARCHAR, manifest VARCHAR", [("a.zip", '{"file":"a.zip","entryCount":2,"totalSize":9,"hiddenSkipped":1,"entries":[{"name":"甲.txt","size":3,"compressedSize":3,"modified":"2024-01-02T03:04:06.000Z","crc32":"7A6C86F1"},{"name":"d/二.txt","size":6,"compressedSize":6,"modified":"2024-01-02T03:04:06.000Z","crc32":"E74D668A"}]}')])
def archive_manifest_json(spark: SparkSession) -> DataFrame:
    found = archive.entries(rows_of(spark, "name string, content binary", [("a.zip", ARCHIVES["a.zip"])]).withColumn("id", F.lit(1)))
    return archive.manifest_json(found, "id").select(F.lit("a.zip").alias("name"), "manifest")


@case("name VARCHAR, target VARCHAR, magic VARCHAR, error_code VARCHAR", [
    ("a.csv", "ods", "504B0304", None), ("a.csv", "xlsx", "504B0304", None), ("one.zip", "gz", "1F8B0800", None), ("a.zip", "gz", None, "ARCHIVE_UNSUPPORTED_FORMAT"), ("a.zip", "tar", "622E7478", None), ("a.srt", "vtt", "57454256", None), ("a.md", "docx", "504B0304", None),
])
def convert_targets(spark: SparkSession) -> DataFrame:
    inputs = {"a.csv": b"a,b\n1,2\n3,4\n", "one.zip": _zip(("x.txt", "x")), "a.zip": _zip(("b.txt", "1"), ("c", "2")), "a.srt": SRT.encode(), "a.md": b"# T\n\nx\n"}
    out = None
    for name, target in (("a.csv", "ods"), ("a.csv", "xlsx"), ("one.zip", "gz"), ("a.zip", "gz"), ("a.zip", "tar"), ("a.srt", "vtt"), ("a.md", "docx")):
        df = rows_of(spark, "id int, name string, content binary", [(1, name, inputs[name])])
        got = convert(df, target).select(F.lit(name).alias("name"), "target", F.hex(F.substring("output", 1, 4)).alias("magic"), "error_code")
        out = got if out is None else out.unionByName(got)
    return out


# subtitles, times -----------------------------------------------------------------------------------------------------------------

CUES = [("srt", 1, 1000, 4000, "你好<i>世界</i>"), ("srt", 2, 5500, 8250, "second\nline"), ("vtt", 1, 1000, 2500, "A &amp; B"), ("vtt", 2, 3000, 4000, "last"), ("ass", 1, 1000, 2500, "one, two\nthree"), ("ass", 2, 3000, 4000, "four")]


@case("kind VARCHAR, idx INTEGER, start_ms BIGINT, end_ms BIGINT, text VARCHAR", CUES)
def subtitles_read(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "kind string, text string", [("srt", SRT), ("vtt", VTT), ("ass", ASS)])
    got = subtitle.read_srt_vtt(df.where("kind <> 'ass'"), "kind").unionByName(subtitle.read_ass(df.where("kind = 'ass'"), "kind"))
    return got.select("kind", "idx", "start_ms", "end_ms", "text")


@case("value VARCHAR, ms BIGINT", [("00:00:01,000", 1000), ("0:01:02.34", 62340), ("1:02:03", 3723000), ("01:02", 62000), ("12.5", 12500), ("abc", None), ("", None)])
def timecodes(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "value string", [(v,) for v in ("00:00:01,000", "0:01:02.34", "1:02:03", "01:02", "12.5", "abc", "")])
    return df.select("value", CLOCK.parse_timecode("value").alias("ms"))


@case("value VARCHAR, shown VARCHAR", [("1700000000", "2023-11-14 22:13"), ("1700000000000", "2023-11-14 22:13"), ("2024-01-01T08:30:00Z", "2024-01-01 08:30"), ("soon", None), ("-5", None)])
def timestamps_read(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "value string", [(v,) for v in ("1700000000", "1700000000000", "2024-01-01T08:30:00Z", "soon", "-5")])
    return df.select("value", CLOCK.format_time(CLOCK.parse_timestamp("value")).alias("shown"))


# structured values ------------------------------------------------------------------------------------------------------------------


@case("kind VARCHAR, error_code VARCHAR, place VARCHAR", [("json", "DATA_JSON_INVALID", "line 4"), ("jsonl", "DATA_JSONL_INVALID", "line 2"), ("yaml", "DATA_YAML_INVALID", "line 2"), ("xml", "DATA_XML_INVALID", "line 1"), ("ini", "DATA_INI_INVALID", "line 1")])
def structured_errors(spark: SparkSession) -> DataFrame:
    bad = [("json", '{\n  "a": 1,\n  "b": 2,\n}'), ("jsonl", '{"a":1}\n{bad\n'), ("yaml", "k: [1, 2\n"), ("xml", "<a><b></a>"), ("ini", "[open\nk = v")]
    df = rows_of(spark, "kind string, text string", bad)
    got = map_rows(df, lambda t, k: (len(str(structured.PARSERS[k](t))),), ["text", "kind"], "n int", keep=["kind"])
    return got.select("kind", "error_code", F.regexp_extract("error_message", "^line \\d+", 0).alias("place"))


VALUE = '{"名":"样例","n":1,"ok":true,"none":null,"list":[1,"二"],"in":{"a":"x"}}'


@case("kind VARCHAR, text VARCHAR", [
    ("jsonl", VALUE + "\n"), ("yaml", "名: 样例\nn: 1\nok: true\nnone: null\nlist:\n- 1\n- 二\nin:\n  a: x\n"), ("kv", "名      = 样例\nn       = 1\nok      = true\nnone    = null\nlist[0] = 1\nlist[1] = 二\nin.a    = x\n"),
])
def structured_written(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "kind string, json string", [(k, VALUE) for k in ("jsonl", "yaml", "kv")])
    return map_rows(df, lambda j, k: (structured.WRITERS[k](structured.parse_json(j)),), ["json", "kind"], "text string", keep=["kind"]).select("kind", "text")


@case("text VARCHAR, cells VARCHAR", [('a,"b,1"\r\n"x""y","l\n2"\n', 'a|b,1/x"y|l\n2'), ("a;b\n1;2", "a|b/1|2"), ("a\tb\n1\t2", "a|b/1|2")])
def delimited_read(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "text string", [('a,"b,1"\r\n"x""y","l\n2"\n',), ("a;b\n1;2",), ("a\tb\n1\t2",)])
    return map_rows(df, lambda t: ("/".join("|".join(r) for r in delimited.parse(t, delimited.sniff(t))),), ["text"], "cells string", keep=["text"]).select("text", "cells")


@case("json VARCHAR", [('[{"a":"1","a_2":"x","列3":"z"},{"a":"2","a_2":"","列3":""}]',)])
def repeated_headers(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "id int, name string, content binary", [(1, "x.csv", "a,a,\n1,x,z\n2,,\n".encode())])
    return convert(df, "json", converter="data", indent="0").select(F.regexp_replace(F.trim(F.col("output").cast("string")), "\\s+$", "").alias("json"))


# pages, pictures, media ---------------------------------------------------------------------------------------------------------------

REQUESTS = [
    (1, ["pdf"], "txt", "auto", "", "0", "extractText", None), (2, ["pdf"], "png", "auto", "", "0", "render", None), (3, ["pdf", "png"], "pdf", "auto", "", "0", "merge", None), (4, ["pdf"], "pdf", "auto", "1-2", "90", "split", None),
    (5, ["pdf"], "pdf", "auto", "", "90", "rotate", None), (6, ["png"], "pdf", "auto", "", "0", "merge", None), (7, ["png"], "txt", "auto", "", "0", None, None), (8, ["pdf"], "pdf", "render", "", "0", None, "PDF_MODE_TARGET_CONFLICT"), (9, ["pdf"], "pdf", "fold", "", "0", None, "PDF_MODE_UNSUPPORTED"),
]


@case("n INTEGER, resolved VARCHAR, error_code VARCHAR", [(r[0], r[6], r[7]) for r in REQUESTS])
def pdf_modes(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "n int, sources array<string>, target string, mode string, pages string, rotate string", [r[:6] for r in REQUESTS])
    return pdf_items.modes(df).select("n", "resolved", "error_code")


ITEMS = [("world", 40.0, 100.0, 30.0), ("Hello", 0.0, 101.0, 30.0), ("你", 0.0, 80.0, 10.0), ("好", 12.0, 80.0, 10.0), ("end", 0.0, 60.0, 20.0)]


@case("page INTEGER, text VARCHAR, markdown VARCHAR", [(1, "Hello world\n你好\nend", "# 题\n\nHello world\n\n你好\n\nend\n")])
def pdf_lines(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "doc int, page int, text string, x double, y double, size double, width double", [(1, 1, t, x, y, 10.0, w) for t, x, y, w in ITEMS])
    return pdf_items.page_lines(df, "doc").withColumn("title", F.lit("题")).select("page", "text", pdf_items.to_markdown("text", "title").alias("markdown"))


@case("text VARCHAR, safe VARCHAR, n_dropped BIGINT, needs_cjk BOOLEAN", [("plain", "plain", 0, False), ("€ “q” café", "€ “q” café", 0, False), ("中文 x", "?? x", 2, True), ("Привет", "??????", 6, False)])
def pdf_font_text(spark: SparkSession) -> DataFrame:
    safe, dropped, cjk = pdf_items.standard_font_text("text")
    return rows_of(spark, "text string", [("plain",), ("€ “q” café",), ("中文 x",), ("Привет",)]).select("text", safe.alias("safe"), dropped.alias("n_dropped"), cjk.alias("needs_cjk"))


@case("new_page BIGINT, source_pos INTEGER, page INTEGER", [(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 3, 1), (5, 3, 2)])
def pdf_merge_pages(spark: SparkSession) -> DataFrame:
    pages = lambda n: rows_of(spark, "page int", [(i,) for i in range(1, n + 1)])
    return pdf_items.merged(pages(2), pages(1), pages(2)).select("new_page", "source_pos", "page")


BAD_MEDIA = [
    ("explode", "in.mp4", "o.mp4", {}, "MEDIA_BAD_ACTION"), ("convert", "in.mp4", "o.docx", {}, "MEDIA_UNSUPPORTED_TARGET"), ("convert", "in.mp4", "o", {}, "MEDIA_BAD_OUTPUT"), ("extractFrame", "in.mp4", "o.mp4", {}, "MEDIA_UNSUPPORTED_TARGET"),
    ("extractAudio", "in.mp4", "o.mp4", {}, "MEDIA_UNSUPPORTED_TARGET"), ("trim", "in.mp4", "o.mp4", {}, "MEDIA_BAD_TRIM"), ("trim", "in.mp4", "o.mp4", {"trimStart": "10", "trimEnd": "10"}, "MEDIA_BAD_TRIM"), ("trim", "in.mp4", "o.mp4", {"trimStart": "-3"}, "MEDIA_BAD_TIME"),
    ("extractFrame", "in.mp4", "o.png", {"frameAt": "第3秒"}, "MEDIA_BAD_TIME"), ("convert", "in.mp4", "o.mp4", {"videoCrf": "99"}, "MEDIA_BAD_PARAM"), ("convert", "in.mp4", "o.gif", {"gifFps": "0"}, "MEDIA_BAD_PARAM"), ("convert", "in.mp4", "o.mp4", {"scale": "big"}, "MEDIA_BAD_PARAM"),
    ("convert", "in.mp4", "o.mp3", {"audioBitrate": "192"}, "MEDIA_BAD_PARAM"), ("convert", "", "o.mp3", {}, "MEDIA_BAD_INPUT"),
]


@case("n INTEGER, error_code VARCHAR", [(i, c) for i, (*_, c) in enumerate(BAD_MEDIA)])
def media_errors(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "n int, action string, source string, target string, options map<string, string>", [(i, *r[:4]) for i, r in enumerate(BAD_MEDIA)])
    return media.commands(df).select("n", "error_code")


@case("action VARCHAR, name VARCHAR, resolved VARCHAR, output VARCHAR", [("extractFrame", "a/b.mp4", "extractFrame", "b.png"), ("extractAudio", "b.mkv", "extractAudio", "b.mp3"), ("trim", "b.webm", "trim", "b.webm"), ("compress", "b.mov", "compress", "b.mp4"), ("convert", "b.opus", "convert", "b.mp3"), ("mp3cut", "b.wav", "trim", "b.mp3")])
def media_names(spark: SparkSession) -> DataFrame:
    rows = [("extractFrame", "a/b.mp4"), ("extractAudio", "b.mkv"), ("trim", "b.webm"), ("compress", "b.mov"), ("convert", "b.opus"), ("mp3cut", "b.wav")]

    def run(action, name):
        cut = action == "mp3cut"
        action, target = media.resolve(None if cut else action, "mp3cut" if cut else None, name.rpartition(".")[2])
        return action, media.output_name(name, target)

    return map_rows(rows_of(spark, "action string, name string", rows), run, ["action", "name"], "resolved string, output string").select("action", "name", "resolved", "output")


@case("name VARCHAR, width INTEGER, height INTEGER, first VARCHAR", [("p3", 2, 1, "010203FF"), ("bmp", 1, 1, "0A141EFF")])
def pictures_read(spark: SparkSession) -> DataFrame:
    bmp = b"BM" + (58).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + b"\1\0\x18\0" + bytes(24) + b"\x1e\x14\x0a\0"
    df = rows_of(spark, "name string, content binary", [("p3", b"P3 2 1 255\n1 2 3 4 5 6"), ("bmp", bmp)])

    def run(b):
        px = image.decode(b)
        return px.shape[1], px.shape[0], bytes(px[0, 0]).hex().upper()

    return map_rows(df, run, ["content"], "width int, height int, first string", keep=["name"]).select("name", "width", "height", "first")


# texts and reports ------------------------------------------------------------------------------------------------------------------------


@case("role VARCHAR, label VARCHAR", [("human", "我"), ("提问", "我"), ("model", "AI（m）"), ("回答", "AI（m）"), ("指令", "系统"), ("observation", "工具（m）"), ("robot", "robot"), ("", "未知")])
def role_labels(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, "role string", [(r,) for r in ("human", "提问", "model", "回答", "指令", "observation", "robot", "")])
    return df.select("role", X.role_label(X.normal_role("role"), F.lit("m"), None).alias("label"))


@case("text VARCHAR, width INTEGER", [("abc", 3), ("中文a", 5), ("ｆｕ", 4), ("한글", 4), ("", 0)])
def display_widths(spark: SparkSession) -> DataFrame:
    return rows_of(spark, "text string", [("abc",), ("中文a",), ("ｆｕ",), ("한글",), ("",)]).select("text", X.display_width("text").alias("width"))


@case("line VARCHAR", [("| 名   | a\\|b   |",), ("|------|--------|",), ("| 张三 | x<br>y |",)])
def markdown_table(spark: SparkSession) -> DataFrame:
    return grid.markdown_lines(rows_of(spark, "row_pos int, cells array<string>", [(1, ["名", "a|b"]), (2, ["张三", "x\ny"])])).select("line")


@case("notes VARCHAR", [("warn:a,info:a,info:b",)])
def notes_merged(spark: SparkSession) -> DataFrame:
    df = rows_of(spark, f"x {report.NOTE}, y {report.NOTE}, z {report.NOTE}", [([("warn", "a"), ("info", "a")], None, [("warn", "a"), ("info", "b")])])
    return df.select(F.array_join(F.transform(report.merged_notes("x", "y", "z"), lambda n: F.concat(n["level"], F.lit(":"), n["message"])), ",").alias("notes"))


@case("n_passed BIGINT, n_failed BIGINT, n_skipped BIGINT, n_total BIGINT", [(2, 1, 1, 4)])
def selftest_rollup(spark: SparkSession) -> DataFrame:
    return report.rollup(rows_of(spark, "status string", [("passed",), ("failed",), ("passed",), ("skipped",)]))


@case("done INTEGER, share DOUBLE, preview VARCHAR", [(-1, 0.0, "ab"), (5, 0.5, "ab"), (20, 1.0, "ab")])
def progress_and_preview(spark: SparkSession) -> DataFrame:
    return rows_of(spark, "done int", [(-1,), (5,), (20,)]).select("done", report.progress("done", F.lit(10)).alias("share"), X.preview(F.lit("abc"), 2).alias("preview"))
