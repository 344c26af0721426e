import json

import pytest

from sheafline.plans.convert import convert
from sheafline.sources import delimited


@pytest.mark.parametrize(
    "text,rows",
    [('a,"b,1"\r\n"x""y","l\n2"\n', [["a", "b,1"], ['x"y', "l\n2"]]), ("a\rb\rc", [["a"], ["b"], ["c"]]), ('a"b,"c"d\n', [['a"b', "cd"]]), ("﻿a,\n,b", [["a", ""], ["", "b"]]), ('"open', [["open"]]), ("", [])],
)
def test_delimited(text, rows):
    assert delimited.parse(text) == rows


def test_sniffing():
    assert [delimited.sniff(x) for x in ("a;b", "a\tb", '"a,b"|c', "a")] == [";", "\t", "|", ","]


RULE = "─" * 32
SRT = "1\n00:00:01,000 --> 00:00:02,000\nhi\n"
CHAT = json.dumps([{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}])
FILES = [
    (1, "a.csv", "姓名,年龄\n张三,30\n"), (2, "b.json", '[{"x":1,"y":"007"}]'), (3, "c.srt", SRT), (4, "d.json", CHAT), (5, "e.html", "<html><h1>T</h1><p>x</p></html>"), (6, "f.bin", "\0\1\2\3"), (7, "g.yaml", "k: [1"), (8, "h.json", "{"),
]


@pytest.mark.parametrize(
    "target,expected",
    [
        ("csv", {1: "﻿姓名,年龄\r\n张三,30\r\n", 2: "﻿x,y\r\n1,007\r\n", 3: "序号,开始,结束,文本\r\n1,00:00:01.000,00:00:02.000,hi\r\n", 4: "会话,序号,角色,时间,内容\r\n未命名会话,1,我,,q\r\n未命名会话,2,AI,,a\r\n", 5: "NO_CONVERTER"}),
        ("json", {1: '[\n  {"姓名":"张三","年龄":30}\n]\n', 7: "DATA_YAML_INVALID"}),
        ("txt", {2: "1.\n  x: 1\n  y: 007\n", 3: "hi\n", 4: f"{RULE}\n会话标题：未命名会话\n{RULE}\n\n我：\n  q\n\nAI：\n  a\n", 5: "T\nx\n", 6: "NO_CONVERTER"}),
        ("md", {1: "| 姓名 | 年龄 |\n|------|------|\n| 张三 | 30   |\n", 5: "# T\n\nx\n"}),
    ],
)
def test_convert(spark, target, expected):
    files = spark.createDataFrame([(i, n, bytearray(t.encode())) for i, n, t in FILES], "id long, name string, content binary")
    got = {r.id: (bytes(r.output).decode() if r.output is not None else r.error_code, r.name) for r in convert(files, target).collect()}
    assert len(got) == len(FILES) and all(n.endswith(f".{target}") for _, n in got.values())
    assert {i: got[i][0] for i in expected} == expected


def test_binary_targets(spark):
    files = spark.createDataFrame([(1, "a.csv", bytearray(b"a,b\n1,2\n")), (2, "x.md", bytearray(b"# T\n\ntext"))], "id long, name string, content binary")
    assert convert(files.where("id = 1"), "xlsx").first().output[:2] == b"PK"
    assert convert(files.where("id = 2"), "docx").first().output[:2] == b"PK"


def test_own_converter(spark):
    from pyspark.sql import functions as F

    from sheafline.plans import convert as module
    from sheafline.plans import registry

    before = registry.CONVERTERS
    try:
        module.register("shout", 99, "txt", "loud", lambda files, target, options: files.select("id", F.upper(F.col("content").cast("string")).alias("output")))
        files = spark.createDataFrame([(1, "a.txt", bytearray(b"hey you"))], "id long, name string, content binary")
        assert bytes(convert(files, "loud").first().output) == b"HEY YOU"
    finally:
        registry.CONVERTERS = before
        module.CONVERTERS.pop("shout")


def test_equal_ids_are_files_of_their_own(spark):
    files = spark.createDataFrame([(1, "a.csv", bytearray(b"a,b\n1,2\n")), (1, "b.md", bytearray(b"# T\n\nx\n")), (None, "c.bin", None)], "id int, name string, content binary")
    got = sorted((r.id, r.name, r.error_code) for r in convert(files, "html").fillna(0, "id").collect())
    assert got == [(0, "c.html", "NO_CONVERTER"), (1, "a.html", None), (1, "b.html", None)]


def test_every_route_gives_its_format_or_an_error(spark):
    """Each source is taken to each of its targets: what comes out is of that kind, or the row has an error."""
    from sheafline import cases
    from sheafline.operators import detect
    from sheafline.plans import registry

    made = {k: (n, b) for k, n, b in reversed(cases.KINDS)}
    made["json"] = ("x.json", b'[{"a": 1, "b": "x"}]')
    made["zip"] = ("x.zip", cases._zip(("x.txt", "x")))
    sources = [k for k in made if registry.targets(k)]
    files = spark.createDataFrame([(k, made[k][0], bytearray(made[k][1])) for k in sources], "id string, name string, content binary")
    expected = {"txt": {"txt", "md", "csv", "srt", "ini", "yaml"}, "md": {"txt", "md", "csv"}, "ini": {"ini", "txt"}, "yaml": {"yaml", "txt", "ini", "csv"}, "tar": {"tar"}, "gz": {"gz", "tgz"}, "csv": {"csv", "txt"}, "tsv": {"tsv", "txt"}, "jsonl": {"jsonl", "json"}, "html": {"html"}, "xml": {"xml"}}
    wrong = []
    for target in ("txt", "md", "json", "csv", "ods", "docx", "yaml", "png", "jpg", "zip", "gz", "ass", "mp3"):
        got = convert(files, target).collect()
        assert len(got) == len(sources)
        out = [(r.id, f"x.{target}", r.output) for r in got if r.error_code is None]
        assert all(b is not None for _, _, b in out), target
        if out:
            kinds = detect.analyze(spark.createDataFrame(out, "id string, name string, content binary")).select("id", "ext").collect()
            by_id = {i: bytes(b)[:60] for i, _, b in out}
            wrong += [(target, r.id, r.ext, by_id[r.id]) for r in kinds if r.ext not in expected.get(target, {target}) and bytes(by_id[r.id]) != b'""\n']  # an empty element
        able = [s for s in sources if target in registry.targets(s)]
        assert all(r.error_code for r in got if r.id not in able), target
    assert wrong == []
