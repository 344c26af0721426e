"""Chat exports of several services as message rows.

A file's text is JSON, JSON Lines or a messenger's text log.  Each reader turns the value into conversations with messages;
the first that fits decides.  Trees of messages are resolved to the branch that is current, or to the deepest.
"""

from __future__ import annotations

import datetime
import json
import re
from collections import deque

from pyspark.sql import DataFrame

from sheafline.functions.text import ROLES
from sheafline.operators.structured import parse_json
from sheafline.plans.rows import CodedError, explode_rows, map_rows

FIELDS = "provider string, conv_pos int, title string, created_at timestamp, msg_pos int, role string, name string, time timestamp, kind string, text string"
#: Keys under which services keep roles, texts, messages and wrapped lists.
ROLE_KEYS = ("role", "sender", "author", "from", "speaker", "type")
TEXT_KEYS = ("content", "text", "message", "body", "value", "parts")
LIST_KEYS = (
    "messages", "message_list", "msgs", "conversation", "chat", "history", "chat_messages", "turns", "dialogue", "items", "list", "records", "dialog", "chats", "data", "logs", "entries",
)
WRAPPERS = ("data", "result", "conversations", "items", "list", "chats", "sessions", "records", "export", "payload", "response")
TIME_KEYS = ("time", "timestamp", "created_at", "create_time", "createdAt", "date", "inserted_at")
#: Depth to which lists of messages are looked for, and values looked at before an export is given up as an error.
MOST_DEPTH, MOST_NODES = 6, 1_000_000


def role_of(value) -> str:
    if isinstance(value, dict):
        value = value.get("role") or value.get("name")
    low = str(value or "").strip().lower()
    return ROLES.get(low, low or "unknown")


def time_of(value) -> datetime.datetime | None:
    """Seconds, milliseconds, numbers as text or ISO dates; naive times are UTC."""
    if isinstance(value, bool) or value in (None, ""):
        return None
    try:
        n = float(value)
    except (TypeError, ValueError):
        try:
            t = datetime.datetime.fromisoformat(str(value).strip().replace("Z", "+00:00"))
        except ValueError:
            return None
        return t.astimezone(datetime.timezone.utc).replace(tzinfo=None) if t.tzinfo else t
    n = n if n < 1e11 else n / 1000
    return datetime.datetime.fromtimestamp(n, datetime.timezone.utc).replace(tzinfo=None) if 0 < n < 2.5e11 else None


def text_of(value) -> str:
    """Text of whatever holds it: a string, a list of parts, or an object with one of the usual keys."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(t for t in map(text_of, value) if t)
    if isinstance(value, dict):
        return next((t for k in ("text", *TEXT_KEYS) if k in value and (t := text_of(value[k]))), "")
    return "" if value is None or isinstance(value, bool) else str(value)


def _first(d: dict, keys) -> object:
    return next((d[k] for k in keys if d.get(k) not in (None, "")), None)


def _pretty(value) -> str:
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return value
    return json.dumps(value, ensure_ascii=False, indent=2)


def parts_of(role: str, content, name=None, time=None) -> list[dict]:
    """Messages of a content list: text, thinking, tool calls and results apart; media as placeholders."""
    made = lambda kind, text: {"role": role, "name": name, "time": time, "kind": kind, "text": text}
    if not isinstance(content, list):
        return [made("text", text_of(content))] if text_of(content) else []
    out: list[dict] = []
    for p in content:
        kind = p.get("type") if isinstance(p, dict) else "text"
        if kind == "thinking":
            out.append(made("thinking", text_of(p.get("thinking") or p)))
        elif kind == "tool_use":
            out.append(made("tool_use", f"{p.get('name', '')}\n{_pretty(p.get('input'))}".strip()))
        elif kind == "tool_result":
            out.append(made("tool_result", text_of(p.get("content"))))
        else:
            text = "[图片]" if kind and "image" in str(kind) else "[语音]" if kind and "audio" in str(kind) else text_of(p)
            if text and out and out[-1]["kind"] == "text":
                out[-1]["text"] += "\n\n" + text
            elif text:
                out.append(made("text", text))
    return out


def branch(mapping: dict, current: str | None) -> list[dict]:
    """Nodes of the tree in order: those above the current one, else the deepest path from a root (the last of equals)."""
    if current in mapping:
        path, at, seen = [], current, set()
        while at in mapping and at not in seen:
            seen.add(at)
            path.append(mapping[at])
            at = mapping[at].get("parent")
        return path[::-1]
    roots = [k for k, n in mapping.items() if n.get("parent") not in mapping]
    if not roots:
        return sorted(mapping.values(), key=lambda n: ((n.get("message") or {}).get("create_time") or 0))
    depth: dict[str, int] = {}
    order, waiting, seen = [], [roots[0]], set()
    while waiting:
        k = waiting.pop()
        if k in seen or k not in mapping:
            continue
        seen.add(k)
        order.append(k)
        waiting.extend(mapping[k].get("children") or [])
    for k in reversed(order):
        depth[k] = 1 + max((depth.get(c, 0) for c in mapping[k].get("children") or []), default=0)
    path, at = [], roots[0]
    while at is not None:
        path.append(mapping[at])
        below = [c for c in mapping[at].get("children") or [] if c in depth and depth[c] < depth[at]]
        most = max((depth[c] for c in below), default=0)
        at = next((c for c in reversed(below) if depth[c] == most), None)
    return path


def _tree_messages(item: dict) -> list[dict]:
    out = []
    for node in branch(item["mapping"], item.get("current_node")):
        m = node.get("message")
        if not isinstance(m, dict):
            continue
        content, meta = m.get("content") or {}, m.get("metadata") or {}
        kind = content.get("content_type") if isinstance(content, dict) else None
        if meta.get("is_visually_hidden_from_conversation") or kind == "user_editable_context":
            continue
        role = role_of(m.get("author") or m.get("role"))
        time = time_of(_first(m, TIME_KEYS) or _first(node, TIME_KEYS))
        if isinstance(m.get("fragments"), list):
            text = "\n\n".join(filter(None, map(text_of, m["fragments"])))
        elif kind == "multimodal_text":
            text = "\n".join(p if isinstance(p, str) else "[语音]" if "audio" in str(p.get("content_type")) else "[图片]" if "image" in str(p.get("content_type")) else text_of(p) for p in content.get("parts") or [])
        elif kind in ("code", "execution_output"):
            text = f"```\n{text_of(content)}\n```"
        else:
            text = text_of(content)
        if text.strip():
            out.append({"role": role, "name": meta.get("model_slug"), "time": time, "kind": "tool_result" if role == "tool" else "text", "text": text})
    return out


def _conv(provider: str, item: dict, messages: list[dict]) -> dict:
    title = text_of(_first(item, ("title", "name", "topic", "subject"))) if isinstance(item, dict) else ""
    times = [m["time"] for m in messages if m["time"]]
    created = time_of(_first(item, ("create_time", "created_at", "createdAt", "inserted_at", "time"))) if isinstance(item, dict) else None
    return {"provider": provider, "title": title.strip() or "未命名会话", "created_at": created or min(times, default=None), "messages": messages}


def _records(value) -> list[dict]:
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]


def read_mapping(value) -> list[dict]:
    items = [x for x in _records(value) if isinstance(x.get("mapping"), dict)]
    provider = "deepseek" if any("inserted_at" in x and "create_time" not in x for x in items) else "chatgpt"
    return _each(items, lambda x: _conv(provider, x, _tree_messages(x)))


def read_claude(value) -> list[dict]:
    def build(x):
        said = []
        for m in x["chat_messages"]:
            role, time = role_of(m.get("sender")), time_of(m.get("created_at"))
            got = parts_of(role, m.get("content"), None, time) if isinstance(m.get("content"), list) and m["content"] else []
            said += got or parts_of(role, m.get("text") or "", None, time)
            said += [{"role": role, "name": None, "time": time, "kind": "text", "text": f"[附件] {a.get('file_name', '')}".strip()} for a in m.get("attachments") or [] if isinstance(a, dict)]
        return _conv("claude", x, said)

    return _each([x for x in _records(value) if isinstance(x.get("chat_messages"), list)], build)


def read_gemini(value) -> list[dict]:
    items = [x for x in _records(value) if "header" in x and isinstance(x.get("subtasks"), list)]
    mine = {"you", "me", "i", "你", "您", "我"}
    return [
        _conv("gemini", x, [m for s in x["subtasks"] if (m := {"role": "user" if str(s.get("title", "")).strip().lower() in mine else "assistant", "name": None, "time": time_of(s.get("time")), "kind": "text", "text": text_of([p.get("name") for p in s.get("snippets") or []])})["text"]])
        for x in items
    ]


def _nodes(value, deepest: int | None = None, whole=lambda x: False):
    """Lists and objects in a value, breadth first, but for what is in those that are `whole`; more than MOST_NODES values
    are an error."""
    waiting, seen = deque([(value, 0)]), 0
    while waiting:
        at, depth = waiting.popleft()
        yield at
        if whole(at) or depth == deepest or not isinstance(at, (dict, list)):
            continue
        inner = list(at.values()) if isinstance(at, dict) else at
        seen += len(inner)
        if seen > MOST_NODES:
            raise CodedError("CHAT_TOO_LARGE", f"more than {MOST_NODES} values would have to be looked at")
        waiting.extend((x, depth + 1) for x in inner if isinstance(x, (dict, list)))


def _each(items: list, build) -> list[dict]:
    """What is built of each item; an item that cannot be read is counted and does no harm to the others."""
    out = []
    for x in items:
        try:
            out.append(build(x))
        except (TypeError, ValueError, KeyError, AttributeError, IndexError, RecursionError):
            out.append({"skipped": True, "messages": []})
    return out


def read_sections(value) -> list[dict]:
    """Conversations grouped in sections, found breadth first."""
    for at in _nodes(value):
        if isinstance(at, dict):
            if isinstance(at.get("sections"), list):
                inner = [c for s in _records(at["sections"]) for k in ("conversations", "items", "chats", "list", "sessions") for c in _records(s.get(k) or [])]
                return _each(inner, lambda c: _conv("sections", c, generic_messages(c)))
    return []


def is_message(x) -> bool:
    return isinstance(x, dict) and any(k in x for k in ROLE_KEYS) and any(k in x for k in TEXT_KEYS)


def is_message_list(x) -> bool:
    return isinstance(x, list) and bool(x) and 10 * sum(map(is_message, x)) >= 6 * len(x)


def generic_messages(item) -> list[dict]:
    found = item if is_message_list(item) else next((item[k] for k in LIST_KEYS if is_message_list(item.get(k))), None) if isinstance(item, dict) else None
    out = []
    for m in found or []:
        if not isinstance(m, dict):
            continue
        role, time = role_of(_first(m, ROLE_KEYS)), time_of(_first(m, TIME_KEYS))
        name = _first(m, ("model", "model_slug", "name"))
        if m.get("thinking") or m.get("reasoning_content"):
            out += parts_of(role, [{"type": "thinking", "thinking": text_of(m.get("thinking") or m["reasoning_content"])}], name, time)
        out += parts_of(role, _first(m, TEXT_KEYS), name, time)
        for call in [*(m.get("tool_calls") or []), *([m["function_call"]] if m.get("function_call") else [])]:
            f = call.get("function", call) if isinstance(call, dict) else {}
            out += parts_of(role, [{"type": "tool_use", "name": f.get("name", ""), "input": f.get("arguments")}], name, time)
    return out


def read_generic(value) -> list[dict]:
    if is_message_list(value):
        return [_conv("generic", {}, generic_messages(value))]
    if isinstance(value, dict):
        said = generic_messages(value)
        return [_conv("generic", value, said)] if said else []
    return _each(_records(value), lambda x: _conv("generic", x, generic_messages(x)))


def read_discovered(value) -> list[dict]:
    """Lists of messages anywhere in the value, breadth first."""
    return _each([x for x in _nodes(value, MOST_DEPTH, is_message_list) if is_message_list(x)], lambda x: _conv("discovered", {}, generic_messages(x)))


READERS = (read_mapping, read_claude, read_gemini, read_sections, read_generic)
DAY, CLOCK = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}", r"\d{1,2}:\d{2}(?::\d{2})?"
#: Lines that begin a message of a text log: a day and time, a time, either with a name before or after it.
HEADERS = (
    re.compile(rf"(?P<day>{DAY})\s+(?P<clock>{CLOCK})"),
    re.compile(rf"(?P<clock>{CLOCK})"),
    re.compile(rf"(?P<day>{DAY})\s+(?P<clock>{CLOCK})\s+(?P<name>\S.{{0,39}})"),
    re.compile(rf"(?P<name>\S.{{0,39}}?)\s+(?P<day>{DAY})\s+(?P<clock>{CLOCK})"),
    re.compile(rf"(?P<name>[^\d。！？，,.!?][^。！？，,.!?]{{0,39}}?)(?:[（(][^）)]{{1,40}}[）)])?\s+(?P<clock>{CLOCK})"),
)
NUMBER_OF_NAME = re.compile(r"[（(][^）)]*[）)]\s*$")
LONGEST_HEADER, LEAST_HEADERS = 120, 3


def _header(line: str) -> dict | None:
    line = line.strip()
    found = None if len(line) > LONGEST_HEADER else next((m for h in HEADERS if (m := h.fullmatch(line))), None)
    return found.groupdict() if found else None


def read_messenger(text: str) -> list[dict]:
    """Text logs whose messages begin with a line of a time and mostly a name; times without a day take the last one.

    Messages with a name are the user's.  Fewer than LEAST_HEADERS such lines make no log."""
    said, day, heads = [], None, 0
    for line in text.splitlines():
        if found := _header(line):
            heads += 1
            said.append({**found, "lines": []})
        elif said:
            said[-1]["lines"].append(line)
    out = []
    for m in said if heads >= LEAST_HEADERS else []:
        body = "\n".join(m["lines"]).strip()
        if not body:
            continue
        name = NUMBER_OF_NAME.sub("", m.get("name") or "").strip()
        day = m.get("day") or day
        time = None
        if day:
            try:
                time = datetime.datetime(*map(int, re.split(r"[-/.]", day)), *map(int, m["clock"].split(":")))
            except ValueError:
                time = None
        out.append({"role": "user" if name else "assistant", "name": name or None, "time": time, "kind": "text", "text": body})
    return [_conv("messenger", {"title": "聊天记录"}, out)] if out else []


def conversations_of(text: str | None) -> list[dict]:
    """All conversations of an export, in the order of their times, those without one last."""
    text = (text or "").removeprefix("﻿")
    lines = [x for x in text.splitlines() if x.strip()]
    value, found = None, []
    try:
        value = parse_json(text)
    except CodedError:
        try:
            per_line = [json.loads(x) for x in lines] if len(lines) > 1 else []
        except ValueError:
            per_line = []
        if per_line:
            found = [_conv("jsonl", {}, generic_messages(per_line))] if is_message_list(per_line) else [c for v in per_line for c in _read(v)]
        else:
            found = read_messenger(text)
    else:
        found = _read(value)
    skipped = sum("skipped" in c for c in found)
    found = [c | {"n_skipped": skipped} for c in found if c["messages"]]
    if not found:
        raise CodedError("CHAT_FORMAT_UNKNOWN", "no conversation was found")
    return sorted(found, key=lambda c: (c["created_at"] is None, c["created_at"] or datetime.datetime.min))


def _read(value) -> list[dict]:
    tried = [value]
    for _ in range(3):
        tried += [v[k] for v in list(tried) if isinstance(v, dict) for k in WRAPPERS if isinstance(v.get(k), (dict, list)) and not any(v[k] is t for t in tried)]
    for reader in READERS:
        for v in tried:
            got = reader(v)
            if any(c["messages"] for c in got):
                return [c for c in got if c["messages"] or "skipped" in c]
    return read_discovered(value)


def read(df: DataFrame, text: str = "text", mode: str = "PERMISSIVE", max_conversations: int | None = None) -> DataFrame:
    """One row for each message of each export; an export in which nothing is found has one row with its error.

    n_skipped counts the export's conversations that could not be read; max_conversations keeps the first so many of each.
    """

    def run(t):
        got = conversations_of(t)
        return [(c["provider"], i, c["title"], c["created_at"], j, m["role"], m["name"], m["time"], m["kind"], m["text"], c["n_skipped"]) for i, c in enumerate(got[:max_conversations], 1) for j, m in enumerate(c["messages"], 1)]

    return explode_rows(df, run, [text], f"{FIELDS}, n_skipped int", [c for c in df.columns if c != text], mode)


def probe(df: DataFrame, text: str = "text", ext: str = "ext") -> DataFrame:
    """df with is_chat: whether a json or jsonl text is a chat export; other files are not asked."""

    def run(t, e):
        if e not in ("json", "jsonl"):
            return (False,)
        try:
            return (bool(conversations_of(t)),)
        except CodedError:
            return (False,)

    return map_rows(df, run, [text, ext], "is_chat boolean").drop("error_code", "error_message")
