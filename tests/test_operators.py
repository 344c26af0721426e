import datetime
import io
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.functions import encoding
from sheafline.functions import text as X
from sheafline.functions import time as CLOCK
from sheafline.operators import archive, chat, detect, document, grid, image, media, pdf_items, structured, subtitle
from sheafline.plans import registry, tables
from sheafline.plans.rows import CodedError
from sheafline.sources import chat_exports, files, workbook


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return df.select(column).first()[0]


def code(fn, *args):
    with pytest.raises(CodedError) as e:
        fn(*args)
    return e.value.code


# names and cells


@pytest.mark.parametrize("name,ext,base", [("a/b.TXT", "txt", "b"), (".bashrc", "", ".bashrc"), ("x.", "", "x"), ("c:\\d\\e.tar.gz", "gz", "e.tar"), ("", "", "")])
def test_names(spark, name, ext, base):
    assert (one(spark, X.ext_of("n"), n=name), one(spark, X.base_name("n"), n=name)) == (ext, base)


@pytest.mark.parametrize("name,safe", [("a:b?.txt", "a_b_.txt"), ("  ..x..  ", "x"), ("", "untitled"), (None, "untitled"), ("y" * 130 + ".md", "y" * 100 + ".md")])
def test_safe_names(spark, name, safe):
    assert one(spark, X.safe_file_name("n"), n=name) == safe


def test_safe_path(spark):
    assert one(spark, X.safe_path("n"), n="../../etc/./pass:wd") == "etc/pass_wd"


@pytest.mark.parametrize("n,label", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (102400, "100 KB"), (1536 * 1024, "1.5 MB")])
def test_bytes(spark, n, label):
    assert one(spark, X.format_bytes("n"), n=n) == label


@pytest.mark.parametrize("cell,kind", [("007", "string"), ("100080", "number"), ("1.50", "string"), ("1e5", "string"), ("-0", "string"), ("-2.5", "number"), ("true", "boolean"), ("True", "string"), ("null", "null"), ("1234567890123456", "string"), ("", "string")])
def test_scalar_kinds(spark, cell, kind):
    assert one(spark, X.scalar_kind("c"), c=cell) == kind


def test_display_width(spark):
    assert one(spark, X.display_width("t"), t="ab甲") == 4
    assert one(spark, X.pad_display("t", F.lit(6)), t="ab甲") == "ab甲  "


@pytest.mark.parametrize("n,word", [(1, "一"), (10, "十"), (11, "十一"), (20, "二十"), (99, "九十九"), (100, "100")])
def test_chinese_numbers(spark, n, word):
    assert one(spark, X.chinese_number("n"), n=n) == word


def test_roles(spark):
    assert [one(spark, X.normal_role("r"), r=r) for r in ("Human", "助手", " GPT ", "custom", None)] == ["user", "assistant", "assistant", "custom", "unknown"]


def test_html_to_text(spark):
    html = "<head><title>t</title></head><body><h1>A &amp; B</h1><p>x<br>y</p><ul><li>1</li><li>2</li></ul><script>no()</script></body>"
    assert one(spark, X.html_to_text("h"), h=html) == "A & B\n\nx\ny\n\n- 1\n- 2"


def test_fence_is_longer_than_runs_within(spark):
    assert one(spark, X.fenced_code("t"), t="a ```` b").startswith("`````\n")


# times


@pytest.mark.parametrize("text,ms", [("00:00:01,000", 1000), ("0:01:02.34", 62340), ("1:02:03", 3723000), ("01:02", 62000), ("12.5", 12500), ("abc", None), ("", None)])
def test_timecodes(spark, text, ms):
    assert one(spark, CLOCK.parse_timecode("t"), t=text) == ms


def test_clocks(spark):
    assert one(spark, CLOCK.clock("n", ","), n=3723004) == "01:02:03,004"
    assert one(spark, CLOCK.ass_clock("n"), n=3723045) == "1:02:03.04"
    assert one(spark, CLOCK.clock("n", "."), n=-5) == "00:00:00.000"


@pytest.mark.parametrize("value,year", [("1700000000", 2023), ("1700000000000", 2023), ("2024-01-01T00:00:00Z", 2024), ("x", None), ("-5", None)])
def test_timestamps(spark, value, year):
    got = one(spark, CLOCK.parse_timestamp("t"), t=value)
    assert (got and got.year) == year


# encodings


@pytest.mark.parametrize("label", ["utf-8", "utf-8-bom", "utf-16le", "utf-16be", "gbk", "big5", "shift_jis", "euc-kr"])
def test_encodings_round_trip(label):
    text = {"euc-kr": "안녕하세요 세계", "shift_jis": "これはテストです", "big5": "這是一個測試"}.get(label, "这是一个测试")
    data, lost = encoding.encode(text, label)
    assert lost == 0 and encoding.decode(data, label) == text


def test_encoding_losses_are_counted():
    assert encoding.encode("a😀é", "gbk")[1] == 0
    assert encoding.encode("a😀甲", "windows-1252") == (b"a??", 2)
    assert code(encoding.encode, "a", "klingon") == "ENCODING_UNKNOWN"


@pytest.mark.parametrize("label,text", [("gb18030", "我们的时间在这里，他们说的是一个大问题"), ("shift_jis", "これはとても大きな問題であると思います"), ("utf-16le", "plain letters only")])
def test_detection_of_encodings(label, text):
    data = text.encode(encoding.CODECS[label])
    assert encoding.detect(data)[0] == label


def test_bad_bytes_do_not_stop_a_query(spark):
    df = spark.createDataFrame([(bytearray(b"\xc4\xe3\x81"),), (None,), (bytearray(b""),)], "content binary")
    assert encoding.with_encoding(df).count() == 3


# grids


def test_ragged_grid_and_headers(spark):
    g = spark.createDataFrame([("t", 1, ["a", "", "a"]), ("t", 2, ["1"]), ("t", 3, ["", " "])], "k string, row_pos int, cells array<string>")
    n = grid.normalise(g, "k")
    assert sorted((r.row_pos, r.cells) for r in n.collect()) == [(1, ["a", "", "a"]), (2, ["1", None, None])]
    assert [r.name for r in grid.headers(n, "k").orderBy("pos").collect()] == ["a", "列2", "a_2"]
    assert grid.json_records(n, "k").first().record == '{"a":1,"列2":null,"a_2":null}'


def test_markdown_table_lines_up(spark):
    g = spark.createDataFrame([("t", 1, ["姓名", "n"]), ("t", 2, ["a|b", "1\n2"])], "k string, row_pos int, cells array<string>")
    assert [r.line for r in grid.markdown_lines(g, "k").orderBy("row_pos").collect()] == ["| 姓名 | n      |", "|------|--------|", "| a\\|b | 1<br>2 |"]


# structured values

TRICKY = {"a": "", "b": " ", "c": [], "d": {}, "e": [[]], "f": [[1, 2], [3, 4]], "g": "007", "h": 0, "i": "你好"}


@pytest.mark.parametrize("indent", ["2", "4", "tab", "0"])
@pytest.mark.parametrize("value", [TRICKY, {"@lang": "zh", "#text": "x"}, {"x": [1], "y": [None, True, {"k": 1.5}]}, [1, "a", None]])
def test_xml_round_trip(value, indent):
    assert structured.parse_xml(structured.to_xml(value, indent=indent)) == value


def test_yaml_keeps_words(spark):
    assert structured.parse_yaml("a: yes\nb: 010\nc: 2024-01-01\nd: true\ne: 1.5") == {"a": "yes", "b": 10, "c": "2024-01-01", "d": True, "e": 1.5}
    assert structured.parse_yaml(structured.to_yaml(TRICKY)) == TRICKY


def test_ini_paths():
    value = {"x": 1, "s": {"标签": ["稳定", "1"], "deep": {"k": [{"v": True}]}}}
    assert structured.parse_ini(structured.to_ini(value)) == value


@pytest.mark.parametrize(
    "fn,text,expected",
    [(structured.parse_json, '{"a":1,\n"b":2,\n"c":3,\n}', "DATA_JSON_INVALID"), (structured.parse_json, " ", "DATA_EMPTY"), (structured.parse_jsonl, '{"a":1}\nx', "DATA_JSONL_INVALID"), (structured.parse_yaml, "a: [1", "DATA_YAML_INVALID"), (structured.parse_xml, "<a><b></a>", "DATA_XML_INVALID"), (structured.parse_ini, "[x\na=1", "DATA_INI_INVALID"), (structured.to_ini, [1], "DATA_INI_ROOT")],
)
def test_coded_errors(fn, text, expected):
    assert code(fn, text) == expected


def test_errors_stay_in_their_row(spark):
    df = spark.createDataFrame([('{"a":1}',), ("{",), (None,)], "text string")
    got = sorted((r.json or "", r.error_code or "") for r in structured.read(df, "json").collect())
    assert got == [("", "DATA_EMPTY"), ("", "DATA_JSON_INVALID"), ('{"a":1}', "")]


def test_text_views():
    assert structured.to_kv({"a": [1, {"b": None}]}) == "a[0]   = 1\na[1].b = null\n"
    assert structured.to_tree({"a": {"b": [1, 2]}, "k": "x\ny"}) == "a:\n  b: [1, 2]\nk: x\n   y\n"
    assert structured.to_fixed_table([{"a": 1, "b": "甲"}, {"a": 22}]) == "a   b\n1   甲\n22\n"
    assert structured.sort_keys({"b": 1, "a": {"d": 1, "c": 2}}) == {"a": {"c": 2, "d": 1}, "b": 1}
    assert structured.unflatten(structured.flatten({"a": {"b": [{"c": 1}, 2]}})) == {"a": {"b": [{"c": 1}, 2]}}


# subtitles

SRT = "1\r\n00:00:01,000 --> 00:00:04,000\r\n第一行\r\n<i>第二行</i>\r\n\r\n2\r\n00:00:05,500 --> 00:00:08,250\r\nEnd\r\n"


def test_srt(spark):
    df = spark.createDataFrame([("f", SRT), ("g", ""), ("h", None)], "f string, text string")
    got = [(r.idx, r.start_ms, r.end_ms, r.text) for r in subtitle.read_srt_vtt(df, "f").orderBy("idx").collect()]
    assert got == [(1, 1000, 4000, "第一行\n<i>第二行</i>"), (2, 5500, 8250, "End")]
    moved = subtitle.shift(subtitle.read_srt_vtt(df, "f"), -2).orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms, r.clamped) for r in moved] == [(0, 2000, True), (3500, 6250, False)]


def test_ass_round_trip(spark):
    cues = spark.createDataFrame([("f", 1, 0, 1500, "a, b\n{x} {\\an8}y", "Top"), ("f", 2, 2000, 3000, "c", "Default")], "f string, idx int, start_ms long, end_ms long, text string, style string")
    body = subtitle.render(cues, "ass", "f")
    text = body.first().body
    assert text.count("\nStyle: ") == 2 and "\\{x\\} {\\an8}y" in text
    back = subtitle.read_ass(body, "f", text="body").orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms, r.style, r.text.split("\n")[0]) for r in back] == [(0, 1500, "Top", "a, b"), (2000, 3000, "Default", "c")]


def test_same_timeline(spark):
    cues = spark.createDataFrame([(1, 1000, 2000, "甲"), (2, 1000, 2000, "乙"), (3, 1000, 2000, "甲")], "idx int, start_ms long, end_ms long, text string")
    assert [(r.idx, r.text, r.n_merged) for r in subtitle.merge_same_times(cues).collect()] == [(1, "甲\n乙", 3)]


# chat

CHATGPT = [
    {
        "title": "t", "create_time": 1700000000, "current_node": "n3",
        "mapping": {
            "n0": {"id": "n0", "parent": None, "children": ["n1"], "message": None},
            "n1": {"id": "n1", "parent": "n0", "children": ["x1", "n2"], "message": {"author": {"role": "user"}, "create_time": 1700000001, "content": {"content_type": "text", "parts": ["hi"]}}},
            "x1": {"id": "x1", "parent": "n1", "children": [], "message": {"author": {"role": "assistant"}, "content": {"content_type": "text", "parts": ["abandoned"]}}},
            "n2": {"id": "n2", "parent": "n1", "children": ["n3"], "message": {"author": {"role": "assistant"}, "content": {"content_type": "text", "parts": ["hello"]}, "metadata": {"model_slug": "m"}}},
            "n3": {"id": "n3", "parent": "n2", "children": [], "message": {"author": {"role": "user"}, "create_time": 1700000002000, "content": {"content_type": "text", "parts": ["bye"]}}},
        },
    }
]
CLAUDE = [{"uuid": "u", "name": "c", "chat_messages": [{"sender": "human", "text": "q"}, {"sender": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "a"}, {"type": "tool_use", "name": "f", "input": {"x": 1}}]}]}]
GEMINI = [{"header": "G", "title": "g", "time": "2024-01-01T00:00:00Z", "subtasks": [{"title": "你", "snippets": [{"name": "q"}]}, {"title": "Gemini", "snippets": [{"name": "a"}]}]}]
SECTIONS = {"data": {"sections": [{"title": "s", "conversations": [{"title": "c", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}]}]}}


@pytest.mark.parametrize(
    "value,provider,said",
    [(CHATGPT, "chatgpt", ["hi", "hello", "bye"]), (CLAUDE, "claude", ["q", "hm", "a", 'f\n{\n  "x": 1\n}']), (GEMINI, "gemini", ["q", "a"]), (SECTIONS, "sections", ["q", "a"]), ({"messages": [{"role": "user", "content": "q"}]}, "generic", ["q"]), ({"x": {"y": [{"sender": "me", "text": "q"}]}}, "discovered", ["q"])],
)
def test_chat_exports(value, provider, said):
    got = chat_exports.conversations_of(json.dumps(value))
    assert [(c["provider"], [m["text"] for m in c["messages"]]) for c in got] == [(provider, said)]


def test_deepest_branch_without_a_current_node():
    tree = json.loads(json.dumps(CHATGPT))
    del tree[0]["current_node"]
    assert [m["text"] for m in chat_exports.conversations_of(json.dumps(tree))[0]["messages"]] == ["hi", "hello", "bye"]


def test_messenger_and_unknown():
    log = "2024-01-02 10:00 甲\n你好\n2024-01-02 10:01 乙\n好\n丙 10:02\n再见"
    got = chat_exports.conversations_of(log)[0]["messages"]
    assert [(m["name"], m["text"]) for m in got] == [("甲", "你好"), ("乙", "好"), ("丙", "再见")] and got[2]["time"].day == 2
    assert code(chat_exports.conversations_of, '{"a": 1}') == "CHAT_FORMAT_UNKNOWN"


def test_layouts(spark):
    m = spark.createDataFrame([(1, 1, "user", "a\n```\nx\n```\n\nb", None, None, None, None)], "conv int, msg int, role string, text string, name string, time timestamp, kind string, title string")
    assert chat.message_blocks(m, "chat").first().block == "我：\n  a\n```\nx\n```\n\n  b"
    assert chat.message_blocks(m, "transcript").first().block.startswith("**我**\n\na")
    with pytest.raises(ValueError):
        chat.message_blocks(m, "spiral")


# detection, archives, workbooks, documents


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in files.items():
            z.writestr(n, b)
    return out.getvalue()


@pytest.mark.parametrize(
    "data,name,ext",
    [(b"\x89PNG\r\n\x1a\n", "x", "png"), (b"%PDF-1.7", "x", "pdf"), (b"RIFF\0\0\0\0WAVE", "x", "wav"), (b"\0\0\0\x18ftypheic", "x", "heic"), (_zip({"word/document.xml": "x"}), "x", "docx"), (_zip({"mimetype": "application/vnd.oasis.opendocument.text"}), "x", "odt"), (_zip({"a": "b"}), "x", "zip"), (b'{"a":1}', "x", "json"), (b'{"a":1}\n{"a":2}', "x", "jsonl"), (b"a,b\n1,2\n", "x", "csv"), (b"a\tb\n1\t2\n", "x", "tsv"), (b"WEBVTT\n", "x", "vtt"), (SRT.encode(), "x", "srt"), (b"# t\n\nx", "a.md", "md"), (b"BM is only text", "x", "txt"), (b"key = v\n", "a.ini", "ini"), (b"\0\1\2\3\4", "x", "bin"), (b"", "x", "bin"), (None, None, "bin")],
)
def test_detection(spark, data, name, ext):
    df = spark.createDataFrame([(bytearray(data) if data is not None else None, name)], "content binary, name string")
    assert detect.analyze(df).first().ext == ext


def test_archives(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("d/x.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    zipped = _zip({"a.txt": "1", ".hidden/b": "22", "../up": "333"})
    df = spark.createDataFrame([("z", bytearray(zipped)), ("t", bytearray(tar.getvalue())), ("bad", bytearray(b"PK\3\4oops")), ("none", None)], "name string, content binary")
    got = archive.entries(df)
    assert sorted((r.name, r.entry or "", r.error_code or "") for r in got.collect()) == [("bad", "", "ARCHIVE_READ_FAILED"), ("none", "", "ARCHIVE_EMPTY"), ("t", "d/x.txt", ""), ("z", "../up", ""), ("z", ".hidden/b", ""), ("z", "a.txt", "")]
    assert sorted(r.entry for r in archive.visible(got).where("name = 'z'").select(archive.output_name("entry").alias("entry")).collect()) == ["a.txt", "up"]
    packed = archive.repackage(df.where("name = 'z'")).first().packed
    assert zipfile.ZipFile(io.BytesIO(bytes(packed))).namelist() == ["a.txt", "../up"]
    assert code(archive.entries_of, zipped, "z", 2) == "ARCHIVE_TOO_LARGE"


def test_unique_names_step_over_taken_ones(spark):
    df = spark.createDataFrame([(1, "x.txt"), (2, "x.txt"), (3, "x-1.txt"), (4, "x.txt"), (5, "y")], "n int, name string")
    assert [r.unique_name for r in archive.unique_names(df, "name", "n").orderBy("n").collect()] == ["x.txt", "x-2.txt", "x-1.txt", "x-3.txt", "y"]


def test_workbooks(spark, tmp_path):
    data = workbook.write_xlsx([("第一表", [["a", "b"], ["1", "007"], [None, "true"]]), ("第一表", [["中文列"], ["广州"]]), ("empty", [])])
    assert workbook.sheets(data) == [("第一表", [["a", "b"], ["1", "007"], [None, "true"]]), ("第一表(2)", [["中文列"], ["广州"]])]
    assert code(workbook.sheets, b"PK\3\4\0\1\2\3") == "TABLE_READ_FAILED"
    (tmp_path / "w.xlsx").write_bytes(data)
    spark.dataSource.register(workbook.WorkbookSource)
    assert spark.read.format("workbook").load(str(tmp_path)).count() == 5
    assert files.read(spark, str(tmp_path)).first().name == "w.xlsx"
    assert workbook.date_text(datetime.datetime(2023, 12, 31, 23, 59, 59, 999000)) == "2024-01-01"


MD = "# 标题\n\n正文 **粗**\n\n- a\n- b\n\n| 甲 | 乙 |\n| --- | --- |\n| 1 | 2 |\n"


def test_documents():
    assert document.html_to_markdown(document.docx_to_html(document.to_docx(MD)))[0] == MD
    title, parts = document.epub_chapters(document.to_epub(MD))
    assert title == "标题" and [t for t, _ in parts] == ["标题"]
    rtf = b"{\\rtf1\\ansi\\ansicpg936{\\fonttbl{\\f0 x;}}\\'c4\\'e3\\'ba\\'c3\\par \\u20320?x}"
    assert document.rtf_to_text(rtf) == "你好\n\n你x\n"
    assert document.restyle_headings("# a\n## b\n## c\n# d", "number") == "一、a\n（一）b\n（二）c\n二、d"
    assert document.plain_text("> q\n\n1. x") == "> q\n- x\n"
    assert code(document.to_markdown, b"x", "docx") == "DOCUMENT_DOCX_INVALID"


# pictures, pages, media


def test_images():
    px = np.random.default_rng(1).integers(0, 255, (5, 7, 4), dtype=np.uint8)
    assert (image.decode(image.encode_png(px)) == px).all() and (image.decode(image.encode_ico(px)) == px).all()
    assert (image.decode(image.encode_bmp(px))[..., :3] == px[..., :3]).all()
    assert (image.decode(b"P3 2 1 255\n1 2 3 4 5 6")[0, :, :3] == [[1, 2, 3], [4, 5, 6]]).all()
    blocks = np.full((4, 4, 4), 255, np.uint8)
    blocks[:2, :2, 0] = [[0, 10], [20, 30]]
    assert image.resize(blocks, 2, 2)[0, 0, 0] == 15
    assert image.flatten(np.zeros((1, 1, 4), np.uint8), "#fff")[0, 0].tolist() == [255, 255, 255, 255]
    assert image.plan(4000, 10, 800) == (800, 2)
    assert code(image.decode, b"GIF89a") == "IMAGE_UNSUPPORTED_FORMAT" and code(image.decode, b"BM") == "IMAGE_DECODE_FAILED"


@pytest.mark.parametrize("spec,pages", [("1-3,7", [1, 2, 3, 7]), ("3,1-2", [3, 1, 2]), ("2,2", [2]), ("1，3", [1, 3]), ("", list(range(1, 11)))])
def test_page_ranges(spec, pages):
    assert pdf_items.page_range(spec, 10) == pages


@pytest.mark.parametrize("spec", ["0", "11", "3-1", "a", "1-", "-2", ",", "1.5"])
def test_bad_page_ranges(spec):
    assert code(pdf_items.page_range, spec, 10) == "PDF_PAGES_INVALID"


def test_lines_of_items(spark):
    item = lambda t, x, y, w: {"text": t, "x": x, "y": y, "size": 10.0, "width": w}
    assert pdf_items.assemble([item("world", 40.0, 100.0, 30.0), item("Hello", 0.0, 101.0, 30.0), item("你", 0.0, 80.0, 10.0), item("好", 12.0, 80.0, 10.0)]) == "Hello world\n你好"


def test_media():
    assert media.command("extractAudio", "a.mp4", "b.mp3", {"audioBitrate": "128k"}) == ["-y", "-i", "a.mp4", "-vn", "-c:a", "libmp3lame", "-b:a", "128k", "b.mp3"]
    assert code(media.command, "trim", "a.mp4", "b.mp4", {"trimStart": "9", "trimEnd": "1"}) == "MEDIA_BAD_TRIM"
    assert code(media.command, "spin", "a", "b") == "MEDIA_BAD_ACTION"


def test_routing():
    assert registry.candidates("json", "txt") == ["chat-export", "data"] and registry.candidates("csv", "json", "data") == ["data", "table"]
    assert registry.default_target("csv") == "xlsx" and registry.is_soft("CHAT_FORMAT_UNKNOWN") and not registry.is_soft("TABLE_EMPTY")


def test_row_numbers_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = tables.numbered(df, F.col("x").asc())
    assert got.where("pos <> x + 1").count() == 0 and got.count() == 1000


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x")
    s = files.stream(spark, str(tmp_path / "in"))
    q = s.select("name", "length").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("arrived").collect()] == [("a.txt", 1)]
