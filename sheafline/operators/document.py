"""Documents: readers of HTML, RTF, docx, odt and epub to Markdown, Markdown blocks, headings, and docx and epub writers."""

from __future__ import annotations

import html as entities
import io
import posixpath
import re
import urllib.parse
import zipfile
import xml.etree.ElementTree as ET
from html.parser import HTMLParser
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from sheafline.functions import encoding
from sheafline.plans.rows import CodedError, explode_rows, map_rows

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SKIPPED = frozenset("script style noscript template head iframe svg canvas".split())
BLOCKS = frozenset("p div section article main header footer nav aside ul ol li blockquote pre table tr hr figure figcaption h1 h2 h3 h4 h5 h6 dl dt dd body html".split())


class _Markdown(HTMLParser):
    """Builds Markdown as the elements pass."""

    def __init__(self, keep_images: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line = ""
        self.skip = self.quote = self.pre = 0
        self.lists: list[list] = []
        self.prefix = ""
        self.link: list[str | None] = []
        self.row: list[str] | None = None
        self.rows: list[list[str]] = []
        self.keep_images, self.n_images = keep_images, 0
        self.title, self.in_title = "", False

    def end_block(self, blank: bool = True):
        text = self.line if self.pre else re.sub(r"[ \t\r\n]+", " ", self.line).strip()
        self.line = ""
        if not text.strip():
            return
        lead = "> " * self.quote
        self.out += [lead + self.prefix + x for x in text.strip("\n").split("\n")] if not self.pre else [lead + x for x in text.strip("\n").split("\n")]
        self.prefix = " " * len(self.prefix) if self.lists else ""
        if blank and not self.lists:
            self.out.append("")

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "title":
            self.in_title = True
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if tag in ("td", "th"):
            self.line = ""
            return
        if tag in BLOCKS and self.row is None:
            self.end_block()
        if tag[0] == "h" and tag[1:].isdigit():
            self.prefix = "#" * int(tag[1]) + " "
        elif tag in ("ul", "ol"):
            self.lists.append([tag, int(a.get("start") or 1) if (a.get("start") or "1").isdigit() else 1])
        elif tag == "li":
            depth = max(0, len(self.lists) - 1)
            kind = self.lists[-1] if self.lists else ["ul", 1]
            self.prefix = "  " * depth + (f"{kind[1]}. " if kind[0] == "ol" else "- ")
            kind[1] += 1
        elif tag == "blockquote":
            self.quote += 1
        elif tag == "pre":
            self.pre += 1
            self.out.append("```")
        elif tag == "hr":
            self.out += ["---", ""]
        elif tag == "br":
            self.line += "\n" if self.pre else "  \n" if self.row is None else " "
        elif tag == "table":
            self.rows = []
        elif tag == "tr":
            self.row = []
        elif tag in ("strong", "b"):
            self.line += "**"
        elif tag in ("em", "i"):
            self.line += "*"
        elif tag == "code" and not self.pre:
            self.line += "`"
        elif tag == "a":
            self.link.append(a.get("href"))
            if a.get("href"):
                self.line += "["
        elif tag == "img":
            self.n_images += 1
            if self.keep_images:
                self.line += f"![{a.get('alt') or ''}]({a.get('src') or ''})"

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in ("td", "th") and self.row is not None:
            self.row.append(re.sub(r"\s+", " ", self.line).strip().replace("|", "\\|"))
            self.line = ""
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.rows.append(self.row)
            self.row = None
        elif tag == "table" and self.rows:
            wide = max(map(len, self.rows))
            show = lambda r: "| " + " | ".join(r + [""] * (wide - len(r))) + " |"
            self.out += [show(self.rows[0]), "|" + " --- |" * wide, *map(show, self.rows[1:]), ""]
            self.rows = []
        elif tag in BLOCKS and self.row is None:
            self.end_block()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
                self.prefix = ""
                if not self.lists:
                    self.out.append("")
            elif tag == "blockquote":
                self.quote = max(0, self.quote - 1)
            elif tag == "pre" and self.pre:
                self.pre -= 1
                self.out += ["```", ""]
            elif tag[0] == "h" and tag[1:].isdigit() or tag == "li":
                self.prefix = ""
        elif tag in ("strong", "b"):
            self.line += "**"
        elif tag in ("em", "i"):
            self.line += "*"
        elif tag == "code" and not self.pre:
            self.line += "`"
        elif tag == "a" and self.link:
            href = self.link.pop()
            if href:
                self.line += f"]({href})"

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.skip:
            self.line += data


def html_to_markdown(html: str | None, keep_images: bool = True) -> tuple[str, str, int]:
    """Markdown, title and number of images."""
    p = _Markdown(keep_images)
    p.feed(html or "")
    p.close()
    p.end_block()
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(p.out)).strip()
    return (text + "\n" if text else ""), re.sub(r"\s+", " ", p.title).strip(), p.n_images


# RTF ---------------------------------------------------------------------------------------------------------------------

RTF_TOKEN = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")
RTF_SKIP = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr themedata datastore listtable listoverridetable rsidtbl generator xmlnstbl latentstyles filetbl".split())
RTF_TEXT = {"par": "\n\n", "line": "\n", "tab": "\t", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "emspace": " ", "enspace": " "}


def rtf_to_text(data: bytes | None) -> str:
    """Text of RTF: escaped bytes in the document's code page, \\u characters with the bytes that stand in for them skipped."""
    source = (data or b"").decode("latin-1")
    if not source.lstrip().startswith("{\\rtf"):
        raise CodedError("DOCUMENT_RTF_INVALID", "it does not start as RTF")
    page = re.search(r"\\ansicpg(\d+)", source)
    codec = {"936": "gb18030", "950": "big5hkscs", "932": "cp932", "949": "cp949"}.get(page.group(1), f"cp{page.group(1)}") if page else "cp1252"
    out: list[str] = []
    run = bytearray()
    state, stack, pending = {"skip": False, "uc": 1}, [], 0

    def flush():
        if run:
            try:
                out.append(bytes(run).decode(codec, "replace"))
            except LookupError:
                out.append(bytes(run).decode("cp1252", "replace"))
            run.clear()

    for m in RTF_TOKEN.finditer(source):
        word, number, hexed, symbol, brace, text = m.groups()
        if brace == "{":
            flush()
            stack.append(dict(state))
            pending = 0
        elif brace == "}":
            flush()
            state = stack.pop() if stack else state
            pending = 0
        elif symbol == "*":
            state["skip"] = True
        elif word in RTF_SKIP:
            state["skip"] = True
        elif state["skip"]:
            continue
        elif hexed:
            if pending:
                pending -= 1
            else:
                run.append(int(hexed, 16))
        elif word == "u" and number:
            flush()
            out.append(chr(int(number) % 65536))
            pending = state["uc"]
        elif word == "uc":
            state["uc"] = int(number or 1)
        elif word in RTF_TEXT:
            flush()
            out.append(RTF_TEXT[word])
        elif symbol:
            flush()
            out.append({"~": "\u00a0", "_": "‑", "-": ""}.get(symbol, symbol))
        elif text:
            flush()
            skipped = min(pending, len(text))
            pending -= skipped
            out.append(text[skipped:])
    flush()
    joined = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return re.sub(r"\n{3,}", "\n\n", joined).strip() + "\n"


# zipped documents ----------------------------------------------------------------------------------------------------------


def _opened(data: bytes | None, code: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data or b""))
    except (zipfile.BadZipFile, OSError) as e:
        raise CodedError(code, str(e)) from e


def docx_to_html(data: bytes | None) -> str:
    """Headings, paragraphs, lists, tables and emphasis of a docx file."""
    with _opened(data, "DOCUMENT_DOCX_INVALID") as z:
        if "word/document.xml" not in z.namelist():
            raise CodedError("DOCUMENT_DOCX_INVALID", "there is no document in it")
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            styles = {s.get(f"{W}styleId"): (s.find(f"{W}name").get(f"{W}val") if s.find(f"{W}name") is not None else "") for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{W}style")}

    def runs(p) -> str:
        out = []
        for r in p.iter(f"{W}r"):
            text = "".join("\n" if x.tag == f"{W}br" else "\t" if x.tag == f"{W}tab" else (x.text or "") for x in r if x.tag in (f"{W}t", f"{W}br", f"{W}tab"))
            if any(x.tag == f"{W}drawing" for x in r):
                out.append('<img alt="" src="">')
            if not text:
                continue
            props = r.find(f"{W}rPr")
            on = lambda n: props is not None and props.find(f"{W}{n}") is not None and props.find(f"{W}{n}").get(f"{W}val") not in ("0", "false")
            text = escape(text).replace("\n", "<br>")
            text = f"<em>{text}</em>" if on("i") else text
            out.append(f"<strong>{text}</strong>" if on("b") else text)
        return "".join(out)

    def block(e) -> str:
        if e.tag == f"{W}tbl":
            rows = "".join("<tr>" + "".join("<td>" + " ".join(runs(p) for p in c.iter(f"{W}p")) + "</td>" for c in r.iter(f"{W}tc")) + "</tr>" for r in e.iter(f"{W}tr"))
            return f"<table>{rows}</table>"
        props = e.find(f"{W}pPr")
        style = props.find(f"{W}pStyle").get(f"{W}val") if props is not None and props.find(f"{W}pStyle") is not None else ""
        level = re.search(r"(?i)(?:heading|标题)\s*(\d)", f"{style} {styles.get(style, '')}")
        inner = runs(e)
        if level:
            return f"<h{level.group(1)}>{inner}</h{level.group(1)}>"
        if props is not None and props.find(f"{W}numPr") is not None:
            return f"<ul><li>{inner}</li></ul>"
        return f"<blockquote>{inner}</blockquote>" if "quote" in style.lower() else f"<p>{inner}</p>"

    html = "".join(block(e) for e in body if e.tag in (f"{W}p", f"{W}tbl"))
    return html.replace("</ul><ul>", "")


def odt_to_html(data: bytes | None) -> str:
    with _opened(data, "DOCUMENT_ODT_INVALID") as z:
        if "content.xml" not in z.namelist():
            raise CodedError("DOCUMENT_ODT_INVALID", "there is no content in it")
        root = ET.fromstring(z.read("content.xml"))
    name = lambda e: e.tag.rpartition("}")[2]
    level = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}outline-level"

    def inner(e) -> str:
        out = escape(e.text or "")
        for c in e:
            n = name(c)
            out += {"line-break": "<br>", "tab": "\t", "s": " "}.get(n) or (inner(c) if n in ("span", "a") else "")
            out += escape(c.tail or "")
        return out

    def block(e) -> str:
        n = name(e)
        if n == "h":
            k = e.get(level, "1")
            return f"<h{k}>{inner(e)}</h{k}>"
        if n == "p":
            return f"<p>{inner(e)}</p>"
        wrap = {"list": "ul", "list-item": "li", "table": "table", "table-row": "tr", "table-cell": "td"}.get(n)
        body = "".join(map(block, e))
        return f"<{wrap}>{body}</{wrap}>" if wrap else body

    text = next((e for e in root.iter() if name(e) == "text"), None)
    return "".join(map(block, text)) if text is not None else ""


def epub_chapters(data: bytes | None) -> tuple[str, list[tuple[str, str]]]:
    """Title, and (title, html) of the chapters in the order of the spine, or of the manifest without one."""
    with _opened(data, "DOCUMENT_EPUB_INVALID") as z:
        names = {n.lower(): n for n in z.namelist()}

        def read(path: str) -> bytes:
            real = names.get(posixpath.normpath(urllib.parse.unquote(path)).lower())
            if real is None:
                raise CodedError("DOCUMENT_EPUB_INVALID", f"{path} is missing")
            return z.read(real)

        local = lambda e: e.tag.rpartition("}")[2]
        box = ET.fromstring(read("META-INF/container.xml"))
        opf_path = next((e.get("full-path") for e in box.iter() if local(e) == "rootfile"), None)
        if not opf_path:
            raise CodedError("DOCUMENT_EPUB_INVALID", "no package is named")
        opf = ET.fromstring(read(opf_path))
        items = {e.get("id"): (e.get("href"), e.get("media-type") or "") for e in opf.iter() if local(e) == "item"}
        spine = [e.get("idref") for e in opf.iter() if local(e) == "itemref"]
        title = next(((e.text or "").strip() for e in opf.iter() if local(e) == "title"), "")
        pages = [items[i][0] for i in spine if i in items] or [h for h, kind in items.values() if "html" in kind]
        chapters = []
        for href in pages:
            raw = read(posixpath.join(posixpath.dirname(opf_path), href))
            page = encoding.decode(raw, "auto")
            head = re.search(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", page) or re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
            body = re.search(r"(?is)<body[^>]*>(.*)</body>", page)
            chapters.append((entities.unescape(re.sub(r"<[^>]*>", "", head.group(1))).strip() if head else "", body.group(1) if body else page))
        return title, chapters


def to_markdown(data: bytes | None, kind: str, keep_images: bool = True) -> tuple[str, str, int]:
    """(markdown, title, images) of a document's bytes."""
    if kind in ("txt", "md"):
        return encoding.decode(data).strip() + "\n", "", 0
    if kind == "rtf":
        return rtf_to_text(data), "", 0
    if kind == "epub":
        title, chapters = epub_chapters(data)
        got = [html_to_markdown(h, keep_images) for _, h in chapters]
        return "\n".join(g[0] for g in got), title, sum(g[2] for g in got)
    html = {"html": encoding.decode, "docx": docx_to_html, "odt": odt_to_html}.get(kind)
    if html is None:
        raise CodedError("DOCUMENT_UNSUPPORTED_FORMAT", f"cannot read {kind}")
    return html_to_markdown(html(data), keep_images)


# Markdown blocks -----------------------------------------------------------------------------------------------------------


def blocks(md: str | None) -> list[tuple[str, int, str]]:
    """(type, depth, text) of headings, paragraphs, items, quotes, code, tables and rules."""
    out: list[tuple[str, int, str]] = []
    lines = (md or "").replace("\r\n", "\n").split("\n")
    i, para = 0, []

    def close():
        if para:
            out.append(("paragraph", 0, " ".join(para)))
            para.clear()

    while i < len(lines):
        line = lines[i]
        if fence := re.match(r"^\s*(`{3,}|~{3,})", line):
            close()
            body, i = [], i + 1
            while i < len(lines) and not lines[i].strip().startswith(fence.group(1)):
                body.append(lines[i])
                i += 1
            out.append(("code", 0, "\n".join(body)))
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line):
            close()
            out.append(("heading", len(m.group(1)), m.group(2)))
        elif re.match(r"^\s*([-*_])(?:\s*\1){2,}\s*$", line):
            close()
            out.append(("rule", 0, ""))
        elif m := re.match(r"^(\s*)(?:[-*+]|\d+[.)])\s+(.*)$", line):
            close()
            out.append(("item", 1 + len(m.group(1).expandtabs(2)) // 2, m.group(2)))
        elif m := re.match(r"^>\s?(.*)$", line):
            close()
            out.append(("quote", 1, m.group(1)))
        elif line.lstrip().startswith("|") and line.rstrip().endswith("|"):
            close()
            if not re.fullmatch(r"[\s|:-]+", line):
                out.append(("row", 0, "\t".join(c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip()[1:-1]))))
        elif line.strip():
            para.append(line.strip())
        else:
            close()
        i += 1
    close()
    return out


def inline_text(s: str) -> str:
    """A run of Markdown without its marks; links keep their target in brackets."""
    s = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", s)
    s = re.sub(r"\[([^\]]*)\]\(([^)]*)\)", r"\1 (\2)", s)
    return re.sub(r"(\*\*|__|~~|`)(.+?)\1", r"\2", re.sub(r"(?<![*\w])\*([^*\n]+)\*", r"\1", s))


def plain_text(md: str | None) -> str:
    out = []
    for kind, depth, text in blocks(md):
        out.append({"item": "  " * (depth - 1) + "- ", "quote": "> "}.get(kind, "") + ("-" * 10 if kind == "rule" else text if kind == "code" else inline_text(text)))
    return "\n".join(out) + ("\n" if out else "")


def _chinese_number(n: int) -> str:
    """1 to 99 in Chinese numerals; larger numbers in figures."""
    if n > 99:
        return str(n)
    tens, ones = divmod(n, 10)
    return ("" if tens < 2 else DIGITS[tens]) + ("十" if tens else "") + (DIGITS[ones] if ones else "")


#: Numerals of one digit, and how a numbered heading of each level begins.
DIGITS = "零一二三四五六七八九"
NUMBERED = {1: "{c}、", 2: "（{c}）", 3: "{n}. "}


def restyle_headings(md: str | None, style: str = "hash") -> str:
    """hash leaves headings; number writes 一、 （一） 1. (1) before them, by level; plain takes their marks."""
    if style not in ("hash", "number", "plain"):
        raise CodedError("DOCUMENT_BAD_OPTION", f"no such heading style: {style}")
    n, out, fenced = [0] * 6, [], False
    for line in (md or "").split("\n"):
        fenced ^= bool(re.match(r"^\s*(```|~~~)", line))
        m = None if fenced else re.match(r"^(#{1,6})\s+(.*)$", line)
        if m and style != "hash":
            k, label = len(m.group(1)), m.group(2).strip()
            n[k - 1] += 1
            n[k:] = [0] * (6 - k)
            mark = NUMBERED[k].format(c=_chinese_number(n[k - 1]), n=n[k - 1]) if k <= 3 else "  " * (k - 3) + f"({n[k - 1]}) "
            line = label if style == "plain" else mark + label
        out.append(line)
    return "\n".join(out)


def chapters(md: str | None) -> list[tuple[str, str]]:
    """(title, markdown) of the parts that first-level headings begin; one part without any."""
    parts = re.split(r"(?m)^(?=# )", md or "")
    return [(m.group(1).strip() if (m := re.match(r"# (.*)", p)) else "", p) for p in parts if p.strip()] or [("", "")]


def to_html(md: str | None, title: str = "") -> str:
    """A page of its own."""
    out, open_list, table = [], 0, False
    mark = lambda s: re.sub(r"`(.+?)`", r"<code>\1</code>", re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", re.sub(r"\[([^\]]*)\]\(([^)]*)\)", r'<a href="\2">\1</a>', escape(s))))
    for kind, depth, text in blocks(md):
        if table and kind != "row":
            out.append("</table>")
        if kind == "row" and not table:
            out.append("<table>")
        table = kind == "row"
        while open_list > (depth if kind == "item" else 0):
            out.append("</ul>")
            open_list -= 1
        while kind == "item" and open_list < depth:
            out.append("<ul>")
            open_list += 1
        if kind == "row":
            out.append("<tr>" + "".join(f"<td>{mark(c)}</td>" for c in text.split("\t")) + "</tr>")
        else:
            out.append({"heading": f"<h{depth}>{mark(text)}</h{depth}>", "paragraph": f"<p>{mark(text)}</p>", "item": f"<li>{mark(text)}</li>", "quote": f"<blockquote>{mark(text)}</blockquote>", "code": f"<pre><code>{escape(text)}</code></pre>", "rule": "<hr>"}[kind])
    out += ["</table>"] * table + ["</ul>"] * open_list
    return f'<!doctype html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>{escape(title)}</title>\n</head>\n<body>\n' + "\n".join(out) + "\n</body>\n</html>\n"


def to_docx(md: str | None) -> bytes:
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    space = W[1:-1]

    def run(s: str) -> str:
        parts = re.split(r"(\*\*.+?\*\*)", s)
        return "".join(f'<w:r>{"<w:rPr><w:b/></w:rPr>" if p.startswith("**") and p.endswith("**") and len(p) > 4 else ""}<w:t xml:space="preserve">{escape(inline_text(p))}</w:t></w:r>' for p in parts if p)

    para = lambda s, props="": f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{run(s)}</w:p>"
    body, rows = [], []

    def close_table():
        if rows:
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>")
            rows.clear()

    for kind, depth, text in blocks(md):
        if kind == "row":
            rows.append(text.split("\t"))
            continue
        close_table()
        props = {"heading": f'<w:pStyle w:val="Heading{depth}"/>', "item": f'<w:numPr><w:ilvl w:val="{depth - 1}"/><w:numId w:val="1"/></w:numPr>', "quote": '<w:pStyle w:val="Quote"/>', "code": '<w:pStyle w:val="Code"/>'}.get(kind, "")
        body += [para(x, props) for x in (text.split("\n") if kind == "code" else [text])]
    close_table()
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:rPr><w:b/><w:sz w:val="{40 - 4 * k}"/></w:rPr></w:style>' for k in range(1, 7))
    styles += '<w:style w:type="paragraph" w:styleId="Quote"><w:name w:val="Quote"/></w:style><w:style w:type="paragraph" w:styleId="Code"><w:name w:val="Code"/></w:style>'
    kinds = "http://schemas.openxmlformats.org/package/2006/content-types"
    links = "http://schemas.openxmlformats.org/package/2006/relationships"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{kinds}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{word}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{word}.styles+xml"/><Override PartName="/word/numbering.xml" ContentType="{word}.numbering+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{links}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/_rels/document.xml.rels", f'{head}<Relationships xmlns="{links}"><Relationship Id="rId1" Type="{office}/styles" Target="styles.xml"/><Relationship Id="rId2" Type="{office}/numbering" Target="numbering.xml"/></Relationships>')
        z.writestr("word/document.xml", f'{head}<w:document xmlns:w="{space}"><w:body>{"".join(body)}</w:body></w:document>')
        z.writestr("word/styles.xml", f'{head}<w:styles xmlns:w="{space}">{styles}</w:styles>')
        z.writestr("word/numbering.xml", f'{head}<w:numbering xmlns:w="{space}"><w:abstractNum w:abstractNumId="0">{"".join(f"""<w:lvl w:ilvl="{k}"><w:numFmt w:val="bullet"/><w:lvlText w:val="•"/></w:lvl>""" for k in range(9))}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
    return out.getvalue()


def to_epub(md: str | None, title: str = "") -> bytes:
    parts = chapters(md)
    title = title or parts[0][0] or "untitled"
    out = io.BytesIO()
    files = [f"c{i}.xhtml" for i in range(1, len(parts) + 1)]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        manifest = "".join(f'<item id="{f[:-6]}" href="{f}" media-type="application/xhtml+xml"/>' for f in files)
        spine = "".join(f'<itemref idref="{f[:-6]}"/>' for f in files)
        z.writestr("OEBPS/content.opf", f'<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:sheafline:{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>und</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{manifest}</manifest><spine>{spine}</spine></package>')
        items = "".join(f'<li><a href="{f}">{escape(t or title)}</a></li>' for f, (t, _) in zip(files, parts))
        z.writestr("OEBPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title></head><body><nav epub:type="toc"><ol>{items}</ol></nav></body></html>')
        for f, (t, body) in zip(files, parts):
            page = to_html(body, t or title).replace("<!doctype html>\n<html>", '<html xmlns="http://www.w3.org/1999/xhtml">').replace('<meta charset="utf-8">', '<meta charset="utf-8"/>').replace("<hr>", "<hr/>")
            z.writestr(f"OEBPS/{f}", page)
    return out.getvalue()


WRITERS = {"md": lambda m, t: (m or "").encode(), "txt": lambda m, t: plain_text(m).encode(), "html": lambda m, t: to_html(m, t).encode(), "docx": lambda m, t: to_docx(m), "epub": to_epub}


# DataFrames ------------------------------------------------------------------------------------------------------------------


def read(df: DataFrame, kind: str, content: str = "content", keep_images: bool = True, mode: str = "PERMISSIVE") -> DataFrame:
    """df with markdown, title and n_images of each document."""
    return map_rows(df, lambda b: to_markdown(b, kind, keep_images), [content], "markdown string, title string, n_images long", mode=mode)


def write(df: DataFrame, target: str, markdown: str = "markdown", title: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """df with output: each document's bytes in a format."""
    writer = WRITERS.get(target)
    if writer is None:
        raise CodedError("DOCUMENT_UNSUPPORTED_FORMAT", f"cannot write {target}")
    if title is None:
        return map_rows(df, lambda m: (writer(m, ""),), [markdown], "output binary", mode=mode)
    return map_rows(df, lambda m, t: (writer(m, t or ""),), [markdown, title], "output binary", mode=mode)


def block_rows(df: DataFrame, markdown: str = "markdown", keep: list[str] | None = None) -> DataFrame:
    """One row for each block: block_pos, type, depth, block."""
    return explode_rows(df, lambda m: [(i, *b) for i, b in enumerate(blocks(m), 1)], [markdown], "block_pos int, type string, depth int, block string", keep)
