"""Structured values: JSON, JSON Lines, YAML, XML and INI, their paths, and plain-text renderings.

Values stand as JSON text in columns, which keeps the order of keys.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
import xml.parsers.expat as expat
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

from sheafline.plans.rows import CodedError, explode_rows, map_rows

MARK = "value-type"
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d*[1-9])?")
WIDE = re.compile("[ᄀ-ᅟ⺀-〾ぁ-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦\U0001f300-\U0001f64f\U0001f900-\U0001f9ff\U00020000-\U0003fffd]")


def width(s: str) -> int:
    return len(s) + len(WIDE.findall(s))


def pad(s: str, n: int) -> str:
    return s + " " * max(0, n - width(s))


# reading ------------------------------------------------------------------------------------------------------------------


def parse_json(text: str | None):
    """Strict JSON; an error names its line and column."""
    text = (text or "").removeprefix("﻿")
    if not text.strip():
        raise CodedError("DATA_EMPTY", "there is nothing but white space")

    def refuse(name):
        raise CodedError("DATA_JSON_INVALID", f"{name} is not JSON")

    try:
        return json.loads(text, parse_constant=refuse)
    except json.JSONDecodeError as e:
        at = e.pos
        if text[at : at + 1] == ",":  # after a comma too many, what cannot stand there is the next character
            at += 1 + len(text[at + 1 :]) - len(text[at + 1 :].lstrip())
        line = text.count("\n", 0, at) + 1
        raise CodedError("DATA_JSON_INVALID", f"line {line} column {at - text.rfind(chr(10), 0, at)}: {e.msg}") from e


def parse_jsonl(text: str | None) -> list:
    """One value a line; blank lines are skipped, an error names the line in the file."""
    out = []
    for n, line in enumerate((text or "").removeprefix("﻿").splitlines(), 1):
        if line.strip():
            try:
                out.append(json.loads(line))
            except json.JSONDecodeError as e:
                raise CodedError("DATA_JSONL_INVALID", f"line {n}: {e.msg}") from e
    if not out:
        raise CodedError("DATA_EMPTY", "there is no line with a value")
    return out


@lru_cache(1)
def _yaml_loader():
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        """Core schema: only true and false are booleans, numbers are decimal, dates stay text."""

    Loader.yaml_implicit_resolvers = {
        k: [(tag, rx) for tag, rx in v if tag not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:int", "tag:yaml.org,2002:float")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^[-+]?[0-9]+$"), list("-+0123456789"))
    Loader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: int(node.value))
    Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$"), list("-+.0123456789"))
    return Loader


def parse_yaml(text: str | None):
    import yaml

    try:
        value = yaml.load((text or "").removeprefix("﻿"), Loader=_yaml_loader())
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        where = f"line {mark.line + 1} column {mark.column + 1}: " if mark else ""
        raise CodedError("DATA_YAML_INVALID", where + str(getattr(e, "problem", e))) from e
    if value is None:
        raise CodedError("DATA_EMPTY", "there is no value")
    return value


def scalar(text: str):
    """A text cell as a boolean, null, canonical number of at most 15 digits, or itself."""
    if text in ("true", "false"):
        return text == "true"
    if text == "null":
        return None
    if NUMBER.fullmatch(text) and text != "-0" and sum(c.isdigit() for c in text) <= 15:
        return float(text) if "." in text else int(text)
    return text


def parse_xml(text: str | None):
    """The root's value: attributes as @name, text beside them as #text, repeated children as arrays; marks of to_xml restore
    types."""
    text = (text or "").removeprefix("﻿")
    if not text.strip():
        raise CodedError("DATA_EMPTY", "there is nothing but white space")
    stack: list = [["", {}, [], []]]  # tag, attributes, children, text

    def start(tag, attributes):
        stack.append([tag, attributes, [], []])

    def end(tag):
        node = stack.pop()
        stack[-1][2].append((tag, _xml_value(node)))

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: stack[-1][3].append(data)
    try:
        parser.Parse(re.sub(r"^(\s*<\?xml[^>]*?)\s+encoding=([\"'])[^\"']*\2", r"\1", text).encode("utf-8"), True)
    except expat.ExpatError as e:
        raise CodedError("DATA_XML_INVALID", f"line {e.lineno} column {e.offset + 1}: {expat.errors.messages[e.code]}") from e
    return stack[0][2][0][1]


def _xml_value(node):
    _, attributes, children, texts = node
    attributes = dict(attributes)
    kind = attributes.pop(MARK, None)
    text = "".join(texts)
    if kind == "null":
        return None
    if kind in ("number", "boolean"):
        return scalar(text.strip())
    if kind == "array":
        return [v for _, v in children]
    if kind == "string":
        return text
    if not attributes and not children:
        return {} if kind == "object" else text.strip()
    out: dict = {f"@{k}": v for k, v in attributes.items()}
    groups: dict[str, list] = {}
    for tag, value in children:
        groups.setdefault(tag, []).append(value)
    out |= {tag: values[0] if len(values) == 1 else values for tag, values in groups.items()}
    if text.strip():
        out["#text"] = text.strip()
    return out


PATH = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def unflatten(pairs: list[tuple[str, object]]):
    """Nested values of paths such as a.b[0].c."""
    root: dict = {}
    for path, value in pairs:
        steps = [int(i) if i else name for name, i in PATH.findall(path)]
        if not steps:
            continue
        at = root
        for step, following in zip(steps, [*steps[1:], None]):
            fresh = value if following is None else [] if isinstance(following, int) else {}
            if isinstance(step, int):
                if not isinstance(at, list) or step > 100_000:
                    raise CodedError("DATA_PATH_INVALID", f"{path} does not fit what stands there")
                at.extend([None] * (step + 1 - len(at)))
                if following is None or at[step] is None:
                    at[step] = fresh
                at = at[step]
            else:
                if not isinstance(at, dict):
                    raise CodedError("DATA_PATH_INVALID", f"{path} does not fit what stands there")
                if following is None or step not in at:
                    at[step] = fresh
                at = at[step]
    return root


def parse_ini(text: str | None):
    """Sections and key = value lines; paths in keys are expanded, quoted values stay text."""
    pairs, section = [], ""
    for n, line in enumerate((text or "").removeprefix("﻿").splitlines(), 1):
        line = line.strip()
        if not line or line[0] in ";#":
            continue
        if line[0] == "[":
            if line[-1] != "]":
                raise CodedError("DATA_INI_INVALID", f"line {n}: the section has no end")
            section = line[1:-1].strip()
            continue
        key, eq, value = line.partition("=")
        if not eq:
            raise CodedError("DATA_INI_INVALID", f"line {n}: there is no equals sign")
        value = value.strip()
        quoted = len(value) > 1 and value[0] == value[-1] == '"'
        pairs.append((f"{section}.{key.strip()}" if section else key.strip(), json.loads(value) if quoted else {"[]": [], "{}": {}}.get(value, scalar(value))))
    if not pairs:
        raise CodedError("DATA_EMPTY", "there is no key")
    return unflatten(pairs)


PARSERS = {"json": parse_json, "jsonl": parse_jsonl, "yaml": parse_yaml, "xml": parse_xml, "ini": parse_ini}

# paths and text ----------------------------------------------------------------------------------------------------------------


def flatten(value, at: str = "") -> list[tuple[str, object]]:
    """(path, scalar) in order; empty containers are leaves."""
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in flatten(v, f"{at}.{k}" if at else str(k))]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in flatten(v, f"{at}[{i}]")]
    return [(at, value)]


def scalar_text(value) -> str:
    if value is None:
        return "null"
    if value == "" and isinstance(value, str):
        return '""'
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def sort_keys(value):
    """Keys of all objects in order of their UTF-16 code units."""
    if isinstance(value, dict):
        return {k: sort_keys(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
    return [sort_keys(v) for v in value] if isinstance(value, list) else value


def to_json(value, indent: str = "2") -> str:
    by = {"0": None, "tab": "\t"}.get(indent, int(indent) if indent.isdigit() and indent != "0" else None)
    return json.dumps(value, ensure_ascii=False, indent=by, separators=(",", ":") if by is None else None) + "\n"


def to_jsonl(value) -> str:
    return "".join(json.dumps(v, ensure_ascii=False, separators=(",", ":")) + "\n" for v in (value if isinstance(value, list) else [value]))


@lru_cache(1)
def _yaml_dumper():
    import yaml

    class Dumper(getattr(yaml, "CSafeDumper", yaml.SafeDumper)):
        def ignore_aliases(self, data):
            return True

    return Dumper


def to_yaml(value, indent: str = "2") -> str:
    import yaml

    return yaml.dump(value, Dumper=_yaml_dumper(), allow_unicode=True, width=1 << 30, sort_keys=False, indent=int(indent) if indent in ("2", "4") else 2, default_flow_style=indent == "0")


def xml_tag(name: str) -> str:
    """A name that XML takes."""
    out = re.sub(r"[^\w.:-]", "_", name) or "_"
    return "_" + out if not (out[0].isalpha() or out[0] == "_") else out


def to_xml(value, root: str = "root", indent: str = "2") -> str:
    """The value as XML; what XML alone cannot tell apart carries a mark, so that parse_xml gives the value again."""
    step = {"0": None, "tab": "\t"}.get(indent, " " * int(indent) if indent.isdigit() and indent != "0" else None)
    out = ['<?xml version="1.0" encoding="UTF-8"?>']

    def element(tag: str, v, depth: int) -> None:
        lead = (step or "") * depth
        if isinstance(v, dict):
            attributes = {k[1:]: x for k, x in v.items() if k.startswith("@") and isinstance(x, str) and xml_tag(k[1:]) == k[1:] and k[1:] != MARK}
            rest = {k: x for k, x in v.items() if not (k.startswith("@") and k[1:] in attributes)}
            text = rest.pop("#text", None) if isinstance(rest.get("#text"), str) and rest["#text"].strip() == rest["#text"] != "" else None
            attrs = "".join(f" {k}={quoteattr(x)}" for k, x in attributes.items())
            if not rest and text is None:
                out.append(f"{lead}<{tag}{attrs}{'' if attributes else f' {MARK}="object"'}/>")
            elif not rest and attributes:
                out.append(f"{lead}<{tag}{attrs}>{escape(text)}</{tag}>")
            else:
                out.append(f"{lead}<{tag}{attrs}>{escape(text or '')}")
                for k, x in rest.items():
                    many = isinstance(x, list) and len(x) > 1 and not any(isinstance(y, list) for y in x)
                    for y in x if many else [x]:
                        element(xml_tag(k), y, depth + 1)
                out.append(f"{lead}</{tag}>")
        elif isinstance(v, list):
            out.append(f'{lead}<{tag} {MARK}="array">')
            for x in v:
                element("item", x, depth + 1)
            out.append(f"{lead}</{tag}>")
        elif v is None:
            out.append(f'{lead}<{tag} {MARK}="null"/>')
        elif isinstance(v, (bool, int, float)):
            out.append(f'{lead}<{tag} {MARK}="{"boolean" if isinstance(v, bool) else "number"}">{scalar_text(v)}</{tag}>')
        else:
            mark = f' {MARK}="string"' if v.strip() != v or v == "" else ""
            out.append(f"{lead}<{tag}{mark}>{escape(v)}</{tag}>")

    element(xml_tag(root), value, 0)
    return ("\n" if step is not None else "").join(out) + "\n"


def to_ini(value) -> str:
    """Scalars first, then a section for each object; what is deeper becomes a path."""
    if not isinstance(value, dict):
        raise CodedError("DATA_INI_ROOT", "only an object can be written as INI")

    def line(path, v):
        plain = isinstance(v, str) and scalar(v) == v and v.strip() == v != "" and v[0] != '"' and v not in ("[]", "{}") and "\n" not in v
        return f"{path} = {v if plain else json.dumps(v, ensure_ascii=False) if isinstance(v, str) else scalar_text(v)}"

    top = [line(p, v) for k, x in value.items() if not (isinstance(x, dict) and x) for p, v in flatten(x, k)]
    blocks = ["\n".join(top)] if top else []
    for k, x in value.items():
        if isinstance(x, dict) and x:
            blocks.append("\n".join([f"[{k}]", *(line(p, v) for p, v in flatten(x))]))
    return "\n\n".join(blocks) + "\n"


def to_kv(value) -> str:
    """path = value, the equals signs below each other."""
    pairs = [(p or "(root)", scalar_text(v)) for p, v in flatten(value)]
    most = max(width(p) for p, _ in pairs)
    return "".join(f"{pad(p, most)} = {v}\n" for p, v in pairs)


def to_tree(value) -> str:
    """Aligned keys, numbered items, short lists of scalars on one line."""
    out: list[str] = []

    def inline(v) -> str | None:
        if not isinstance(v, (dict, list)):
            return scalar_text(v)
        if not v:
            return "[]" if isinstance(v, list) else "{}"
        if isinstance(v, list) and len(v) <= 5 and not any(isinstance(x, (dict, list)) for x in v):
            line = "[" + ", ".join(map(scalar_text, v)) + "]"
            return line if width(line) <= 48 else None
        return None

    def walk(v, depth: int) -> None:
        lead = "  " * depth
        items = list(v.items()) if isinstance(v, dict) else [(f"{i}.", x) for i, x in enumerate(v, 1)]
        most = max((width(str(k)) for k, x in items if inline(x) is not None), default=0)
        for k, x in items:
            line, end = inline(x), "" if isinstance(v, list) else ":"
            if line is None:
                out.append(f"{lead}{k}{end}")
                walk(x, depth + 1)
            else:
                first, *more = line.split("\n")
                out.append(f"{lead}{pad(f'{k}{end}', most + len(end))} {first}".rstrip())
                out.extend(f"{lead}{' ' * (most + len(end) + 1)}{m}" for m in more)

    if isinstance(value, (dict, list)) and value:
        walk(value, 0)
    else:
        out.append(scalar_text(value) if not isinstance(value, (dict, list)) else "[]" if isinstance(value, list) else "{}")
    return "\n".join(out) + "\n"


def key_union(records: list) -> list[str]:
    """Keys of all objects, in the order in which they are first seen."""
    return list(dict.fromkeys(k for r in records if isinstance(r, dict) for k in r))


def to_rows(value) -> list[list]:
    """The grid of a value: arrays of arrays as they are, records by the union of keys, an object as key and value."""
    if isinstance(value, dict) and isinstance(value.get("rows"), list):
        head = [value["columns"]] if isinstance(value.get("columns"), list) else []
        return head + to_rows(value["rows"]) if value["rows"] and isinstance(value["rows"][0], list) else to_rows(value["rows"])
    cell = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":")) if isinstance(v, (dict, list)) else v
    if isinstance(value, list):
        if value and all(isinstance(r, list) for r in value):
            return [[cell(c) for c in r] for r in value]
        if value and all(isinstance(r, dict) for r in value):
            keys = key_union(value)
            return [keys, *([cell(r.get(k)) for k in keys] for r in value)]
        return [["value"], *([cell(v)] for v in value)]
    if isinstance(value, dict):
        return [["key", "value"], *([k, cell(v)] for k, v in value.items())]
    return [["value"], [value]]


def to_fixed_table(value) -> str:
    """A text table of records or rows; of anything else key = value lines."""
    if not (isinstance(value, list) and value and all(isinstance(r, (dict, list)) for r in value)):
        return to_kv(value)
    rows = [["" if c is None else scalar_text(c) if c != "" else "" for c in r] for r in to_rows(value)]
    wide = max(map(len, rows))
    rows = [r + [""] * (wide - len(r)) for r in rows]
    most = [max(width(r[i]) for r in rows) for i in range(wide)]
    return "".join("  ".join(pad(c, n) for c, n in zip(r, most)).rstrip() + "\n" for r in rows)


WRITERS = {"json": to_json, "jsonl": to_jsonl, "yaml": to_yaml, "xml": to_xml, "ini": to_ini, "kv": to_kv, "tree": to_tree, "table": to_fixed_table}


# DataFrames --------------------------------------------------------------------------------------------------------------------


def read(df: DataFrame, source: str, text: str = "text", mode: str = "PERMISSIVE") -> DataFrame:
    """df with json: the value of each row's text in a format, keys in their order."""
    parser = PARSERS.get(source)
    if parser is None:
        raise CodedError("DATA_UNSUPPORTED", f"no such format: {source}")
    return map_rows(df, lambda t: (json.dumps(parser(t), ensure_ascii=False, separators=(",", ":")),), [text], "json string", mode=mode)


def write(df: DataFrame, target: str, value: str = "json", mode: str = "PERMISSIVE", **options) -> DataFrame:
    """df with output: each row's JSON value in a format."""
    writer = WRITERS.get(target)
    if writer is None:
        raise CodedError("DATA_UNSUPPORTED", f"no such format: {target}")
    return map_rows(df, lambda j: (writer(parse_json(j), **options),), [value], "output string", mode=mode)


def paths(df: DataFrame, value: str = "json", keep: list[str] | None = None) -> DataFrame:
    """One row for each leaf: path_pos, path, leaf (its text)."""
    return explode_rows(df, lambda j: [(i, p, scalar_text(v)) for i, (p, v) in enumerate(flatten(parse_json(j)), 1)], [value], "path_pos int, path string, leaf string", keep)


def grids(df: DataFrame, value: str = "json", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of the value's grid: row_pos and cells."""
    text = lambda c: None if c is None else scalar_text(c) if c != "" else ""
    return explode_rows(df, lambda j: [(i, [text(c) for c in r]) for i, r in enumerate(to_rows(parse_json(j)), 1)], [value], "row_pos int, cells array<string>", keep)
