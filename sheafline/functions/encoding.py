"""Character encodings: labels, decoding, encoding with counts of what is lost, and detection."""

from __future__ import annotations

import codecs
import re
from collections import Counter

from pyspark.sql import DataFrame

from sheafline.plans.rows import CodedError, map_rows

#: Public labels and the codecs they stand for; aliases of labels.
CODECS = {
    "utf-8": "utf-8", "utf-8-bom": "utf-8-sig", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "utf-32le": "utf-32-le", "utf-32be": "utf-32-be",
    "gbk": "gb18030", "gb18030": "gb18030", "big5": "big5hkscs", "shift_jis": "cp932", "euc-kr": "cp949", "euc-jp": "euc_jp", "windows-1252": "cp1252",
}
LABELS = {
    "utf8": "utf-8", "unicode": "utf-16le", "utf-16": "utf-16le", "utf16": "utf-16le", "utf-8-sig": "utf-8-bom", "gb2312": "gbk", "cp936": "gbk", "ansi": "gbk", "chinese": "gbk",
    "big5-hkscs": "big5", "cp950": "big5", "sjis": "shift_jis", "shift-jis": "shift_jis", "cp932": "shift_jis", "ms932": "shift_jis", "euckr": "euc-kr", "cp949": "euc-kr",
    "ks_c_5601-1987": "euc-kr", "eucjp": "euc-jp", "latin1": "windows-1252", "iso-8859-1": "windows-1252", "cp1252": "windows-1252", "ascii": "utf-8",
}
BOMS = ((b"\xff\xfe\x00\x00", "utf-32le"), (b"\x00\x00\xfe\xff", "utf-32be"), (b"\xef\xbb\xbf", "utf-8-bom"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))
LEGACY = ("gb18030", "big5", "shift_jis", "euc-kr", "windows-1252")
CJK = re.compile("[㐀-鿿]")
CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
#: Frequent characters of Chinese, simplified and traditional; weights and full marks of the four measures.
COMMON = frozenset(
    "的一是不了在人有我他这个们来到时大地为子中你说生国年着就那和要她出也得里后自以会家可下而过天去能对小多然于心学么之都好看起发当没成只如事把还用第样道想作种"
    "开美總從無情己面最女但現前些所同日手又行意動方期它頭經長兒回位分愛老因很給名法間斯知世什兩次使身者被高已親其進此話常與活正感個這為裡著於麼頭"
)
WEIGHTS = {"valid": 0.42, "control": 0.08, "common": 0.38, "cjk": 0.12}
PENALTY, FULL_COMMON, FULL_CJK = 8, 0.06, 0.5
PROBE = 20_000


def codec_of(label: str | None) -> str:
    low = (label or "utf-8").strip().lower()
    low = LABELS.get(low, low)
    if low not in CODECS:
        raise CodedError("ENCODING_UNKNOWN", f"unknown encoding: {label}")
    return CODECS[low]


def decode(data: bytes | None, label: str | None = "auto") -> str:
    """Text of bytes; a mark at the start wins over the label, bytes that fit nothing become U+FFFD."""
    data = data or b""
    for mark, name in BOMS:
        if data.startswith(mark):
            return data[len(mark) :].decode(CODECS[name].replace("-sig", ""), "replace")
    if label in (None, "", "auto"):
        label = detect(data)[0]
    return data.decode(codec_of(label), "replace")


def encode(text: str | None, label: str = "utf-8") -> tuple[bytes, int]:
    """Bytes, and how many characters the encoding lacks (they become question marks); UTF-16 and -32 get a mark."""
    codec = codec_of(label)
    lost = Counter()

    def lose(error):
        lost["n"] += error.end - error.start
        return "?" * (error.end - error.start), error.end

    codecs.register_error("sheafline-count", lose)
    data = (text or "").encode(codec, "sheafline-count")
    mark = next((m for m, name in BOMS if CODECS[name] == codec and codec.startswith(("utf-16", "utf-32"))), b"")
    return mark + data, lost["n"]


def score(data: bytes, label: str) -> float:
    """How well bytes read in an encoding, 0 to 1: valid, free of control characters, of common and of any CJK characters."""
    text = data.decode(CODECS[label], "replace")[:PROBE]
    n = max(1, len(text))
    part = {
        "valid": 1 - min(1.0, PENALTY * text.count("\ufffd") / n),
        "control": 1 - min(1.0, PENALTY * len(CONTROL.findall(text)) / n),
        "common": min(1.0, sum(c in COMMON for c in text) / n / FULL_COMMON),
        "cjk": min(1.0, len(CJK.findall(text)) / n / FULL_CJK),
    }
    return sum(w * part[k] for k, w in WEIGHTS.items())


def candidates(data: bytes | None) -> list[tuple[str, float, str]]:
    """Legacy encodings by falling score, each with a sample of what the bytes would say."""
    data = data or b""
    found = [(e, score(data, e), data[:400].decode(CODECS[e], "replace")[:120]) for e in LEGACY]
    return sorted(found, key=lambda x: -x[1])


def detect(data: bytes | None) -> tuple[str, float]:
    """(label, confidence): a mark, else the zeros of UTF-16, else strict UTF-8, else the best legacy encoding."""
    data = data or b""
    for mark, name in BOMS:
        if data.startswith(mark):
            return name, 1.0
    probe = data[:4096]
    if probe and b"\0" in probe:  # looked at first: plain letters in UTF-16 are also valid UTF-8
        even, odd = probe[::2].count(0) / max(1, len(probe[::2])), probe[1::2].count(0) / max(1, len(probe[1::2]))
        if odd > 0.3 and even < 0.05:
            return "utf-16le", 0.9
        if even > 0.3 and odd < 0.05:
            return "utf-16be", 0.9
    try:
        data.decode("utf-8")
        return "utf-8", 0.99
    except UnicodeDecodeError:
        best = candidates(data)[0]
        return best[0], round(best[1], 3)


def with_encoding(df: DataFrame, content: str = "content") -> DataFrame:
    """df with encoding, confidence and text of binary content."""
    return map_rows(df, lambda b: (*detect(b), decode(b)), [content], "encoding string, confidence double, text string")


def with_candidates(df: DataFrame, content: str = "content") -> DataFrame:
    """df with candidates: encoding, score and sample of each legacy encoding, best first."""
    return map_rows(df, lambda b: (candidates(b),), [content], "candidates array<struct<encoding: string, score: double, sample: string>>")


def encoded(df: DataFrame, label: str, text: str = "text") -> DataFrame:
    """df with content (bytes in the encoding) and n_lost."""
    return map_rows(df, lambda t: encode(t, label), [text], "content binary, n_lost long")
