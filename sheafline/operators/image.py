"""Images: PNG, BMP, ICO and PNM decoded to RGBA, resized, flattened, and written as PNG, BMP and ICO."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.plans.rows import CodedError, map_rows

PNG = b"\x89PNG\r\n\x1a\n"
MOST_PIXELS = 1 << 28


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return a if da <= db and da <= dc else b if db <= dc else c


def decode_png(data: bytes) -> np.ndarray:
    at, idat, head, palette, alpha = 8, b"", None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise CodedError("IMAGE_DECODE_FAILED", "the file ends too early")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            idat += body
        elif kind == b"IEND":
            break
    if head is None:
        raise CodedError("IMAGE_DECODE_FAILED", "there is no header")
    w, h, depth, color, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if channels is None or interlaced or depth not in (1, 2, 4, 8) or (depth < 8 and color not in (0, 3)) or w * h > MOST_PIXELS:
        raise CodedError("IMAGE_UNSUPPORTED_FORMAT", "only plain PNG files of up to 8 bits a channel can be read")
    stride = (w * channels * depth + 7) // 8
    bpp = max(1, channels * depth // 8)
    raw = zlib.decompress(idat)
    if len(raw) < h * (stride + 1):
        raise CodedError("IMAGE_DECODE_FAILED", "the pixels end too early")
    rows = np.zeros((h, stride), np.uint8)
    above = bytearray(stride)
    for y in range(h):
        start = y * (stride + 1)
        kind, line = raw[start], bytearray(raw[start + 1 : start + 1 + stride])
        if kind == 1:
            for i in range(bpp, stride):
                line[i] = (line[i] + line[i - bpp]) & 255
        elif kind == 2:
            line = bytearray(((np.frombuffer(line, np.uint8).astype(np.uint16) + np.frombuffer(above, np.uint8)) & 255).astype(np.uint8))
        elif kind == 3:
            for i in range(stride):
                line[i] = (line[i] + ((line[i - bpp] if i >= bpp else 0) + above[i]) // 2) & 255
        elif kind == 4:
            for i in range(stride):
                a, c = (line[i - bpp], above[i - bpp]) if i >= bpp else (0, 0)
                line[i] = (line[i] + _paeth(a, above[i], c)) & 255
        rows[y] = np.frombuffer(line, np.uint8)
        above = line
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)[:, :w]
        px = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
        px = px if color == 3 else (px.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        px = px[..., None]
    else:
        px = rows.reshape(h, w, channels)
    out = np.full((h, w, 4), 255, np.uint8)
    if color == 3:
        out[..., :3] = palette[px[..., 0]]
        if alpha is not None:
            full = np.full(256, 255, np.uint8)
            full[: len(alpha)] = alpha
            out[..., 3] = full[px[..., 0]]
    elif color in (0, 4):
        out[..., :3] = px[..., :1]
    else:
        out[..., :3] = px[..., :3]
    if color in (4, 6):
        out[..., 3] = px[..., -1]
    return out


def encode_png(px: np.ndarray) -> bytes:
    """RGBA; each line by the filter whose differences sum up least."""
    h, w, _ = px.shape
    flat = px.reshape(h, w * 4).astype(np.int16)
    lines = bytearray()
    zero = np.zeros(w * 4, np.int16)
    for y in range(h):
        up = flat[y - 1] if y else zero
        left = np.concatenate((np.zeros(4, np.int16), flat[y, :-4]))
        tries = [flat[y], flat[y] - left, flat[y] - up, flat[y] - (left + up) // 2]
        best = min(range(4), key=lambda k: int(np.abs(((tries[k] + 128) & 255) - 128).sum()))
        lines.append(best)
        lines += (tries[best] & 255).astype(np.uint8).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(lines), 6)) + chunk(b"IEND", b"")


def _dib(data: bytes, pixels_at: int | None, halved: bool) -> np.ndarray:
    size, w, h, _, bits, packed = struct.unpack("<IiiHHI", data[:20])
    top_down, h = h < 0, abs(h)
    mask_rows = h // 2 if halved else 0
    h -= mask_rows
    if bits not in (8, 24, 32) or packed not in (0, 3) or w <= 0 or w * h > MOST_PIXELS:
        raise CodedError("IMAGE_UNSUPPORTED_FORMAT", "only plain bitmaps of 8, 24 and 32 bits can be read")
    colors = struct.unpack("<I", data[32:36])[0] or 256
    at = pixels_at if pixels_at is not None else size + (4 * colors if bits == 8 else 0)
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, h * stride, at).reshape(h, stride)
    out = np.full((h, w, 4), 255, np.uint8)
    if bits == 8:
        table = np.frombuffer(data, np.uint8, 4 * colors, size).reshape(-1, 4)
        out[..., :3] = table[rows[:, :w]][..., 2::-1]
    else:
        px = rows[:, : w * bits // 8].reshape(h, w, bits // 8)
        out[..., :3] = px[..., 2::-1]
        if bits == 32 and px[..., 3].any():  # all zero means that the channel is not used
            out[..., 3] = px[..., 3]
    out = out if top_down else out[::-1].copy()
    if halved and bits != 32:
        mask_stride = (w + 31) // 32 * 4
        mask = np.unpackbits(np.frombuffer(data, np.uint8, mask_rows * mask_stride, at + h * stride).reshape(mask_rows, mask_stride), axis=1)[:, :w]
        out[..., 3] = np.where(mask[::-1], 0, 255)
    return out


def decode_bmp(data: bytes) -> np.ndarray:
    return _dib(data[14:], struct.unpack("<I", data[10:14])[0] - 14, False)


def encode_bmp(px: np.ndarray) -> bytes:
    h, w, _ = px.shape
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = px[::-1, :, 2::-1].reshape(h, w * 3)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_ico(data: bytes) -> np.ndarray:
    """The largest image of the file."""
    n = struct.unpack("<H", data[4:6])[0]
    entries = [struct.unpack("<BBBBHHII", data[6 + 16 * i : 22 + 16 * i]) for i in range(n)]
    if not entries:
        raise CodedError("IMAGE_DECODE_FAILED", "the icon is empty")
    e = max(entries, key=lambda e: (e[0] or 256) * (e[1] or 256))
    body = data[e[7] : e[7] + e[6]]
    return decode_png(body) if body.startswith(PNG) else _dib(body, None, True)


def encode_ico(px: np.ndarray) -> bytes:
    if max(px.shape[:2]) > 256:
        h, w = plan(px.shape[1], px.shape[0], 256)[::-1]
        px = resize(px, w, h)
    body = encode_png(px)
    return struct.pack("<HHH", 0, 1, 1) + struct.pack("<BBBBHHII", px.shape[1] % 256, px.shape[0] % 256, 0, 0, 1, 32, len(body), 22) + body


def decode_pnm(data: bytes) -> np.ndarray:
    at, words = 2, []
    while len(words) < 3:
        m = re.compile(rb"(?:\s+|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise CodedError("IMAGE_DECODE_FAILED", "the header is not complete")
        words.append(int(m.group(1)))
        at = m.end()
    (w, h, most), kind = words, data[1:2]
    channels = 3 if kind in (b"3", b"6") else 1
    if w * h > MOST_PIXELS or not 0 < most < 65536:
        raise CodedError("IMAGE_UNSUPPORTED_FORMAT", "its size or depth cannot be read")
    if kind in (b"2", b"3"):
        px = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h * channels], dtype=np.int64)
    else:
        px = np.frombuffer(data, ">u2" if most > 255 else np.uint8, w * h * channels, at + 1).astype(np.int64)
    if len(px) < w * h * channels:
        raise CodedError("IMAGE_DECODE_FAILED", "the pixels end too early")
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = ((px * 255 + most // 2) // most).reshape(h, w, channels)
    return out


def decode(data: bytes | None) -> np.ndarray:
    data = data or b""
    try:
        if data.startswith(PNG):
            return decode_png(data)
        if data[:2] == b"BM":
            return decode_bmp(data)
        if data[:4] == b"\0\0\1\0":
            return decode_ico(data)
        if data[:1] == b"P" and data[1:2] in b"2356" and len(data) > 2:
            return decode_pnm(data)
    except (struct.error, ValueError, zlib.error, IndexError) as e:
        raise CodedError(getattr(e, "code", "IMAGE_DECODE_FAILED"), str(e)) from e
    raise CodedError("IMAGE_UNSUPPORTED_FORMAT", "only PNG, BMP, ICO and PNM can be read")


ENCODERS = {"png": encode_png, "bmp": encode_bmp, "ico": encode_ico}


def plan(width: int, height: int, most: int) -> tuple[int, int]:
    """Size after scaling the longer edge down to `most`; 0 leaves it."""
    scale = min(1.0, most / max(width, height)) if most else 1.0
    return max(1, int(width * scale + 0.5)), max(1, int(height * scale + 0.5))


def plan_columns(width: Column | str, height: Column | str, most: int) -> tuple[Column, Column]:
    w, h = (F.col(x) if isinstance(x, str) else x for x in (width, height))
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h)) if most else F.lit(1.0)
    size = lambda x: F.greatest(F.lit(1), F.floor(x * scale + 0.5)).cast("int")
    return size(w), size(h)


def resize(px: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear between pixel centres, colours weighted by their alpha; downscaling averages what a pixel covers."""
    a = px[..., 3:4].astype(np.float64) / 255
    src = np.concatenate((px[..., :3] * a, a * 255), axis=2)
    for axis, n in ((0, height), (1, width)):
        old = src.shape[axis]
        at = np.arange(n)
        if n < old:
            edges = np.concatenate((np.zeros_like(src.take([0], axis)), np.cumsum(src, axis=axis)), axis=axis)
            cut = np.arange(n + 1) * old / n
            low = np.minimum(np.floor(cut).astype(int), old)
            frac = (cut - low).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
            sums = edges.take(low, axis) + frac * (edges.take(np.minimum(low + 1, old), axis) - edges.take(low, axis))
            src = np.diff(sums, axis=axis) * n / old
        elif n > old:
            pos = np.clip((at + 0.5) * old / n - 0.5, 0, old - 1)
            low = np.floor(pos).astype(int)
            frac = (pos - low).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
            src = src.take(low, axis) * (1 - frac) + src.take(np.minimum(low + 1, old - 1), axis) * frac
    alpha = src[..., 3:4] / 255
    rgb = np.divide(src[..., :3], alpha, out=np.zeros_like(src[..., :3]), where=alpha > 0)
    return np.clip(np.concatenate((rgb, src[..., 3:4]), axis=2) + 0.5, 0, 255).astype(np.uint8)


def flatten(px: np.ndarray, background: str = "#ffffff") -> np.ndarray:
    m = re.fullmatch(r"#?([0-9a-fA-F]{6})", background) or re.fullmatch(r"#?([0-9a-fA-F]{3})", background)
    if not m:
        raise CodedError("IMAGE_BAD_OPTION", f"not a colour: {background}")
    digits = m.group(1) if len(m.group(1)) == 6 else "".join(2 * c for c in m.group(1))
    back = np.array([int(digits[i : i + 2], 16) for i in (0, 2, 4)], dtype=np.float64)
    a = px[..., 3:4].astype(np.float64) / 255
    out = np.full_like(px, 255)
    out[..., :3] = np.clip(px[..., :3] * a + back * (1 - a) + 0.5, 0, 255)
    return out


def convert(df: DataFrame, target: str = "png", content: str = "content", max_edge: int = 0, keep_transparency: bool = True, background: str = "#ffffff", mode: str = "PERMISSIVE") -> DataFrame:
    """df with width, height and output of each image in a format."""
    encoder = ENCODERS.get(target)

    def run(data):
        if encoder is None:
            raise CodedError("IMAGE_UNSUPPORTED_FORMAT", f"cannot write {target}")
        px = decode(data)
        w, h = plan(px.shape[1], px.shape[0], max_edge)
        px = px if (w, h) == (px.shape[1], px.shape[0]) else resize(px, w, h)
        return w, h, encoder(px if keep_transparency and target != "bmp" else flatten(px, background))

    return map_rows(df, run, [content], "width int, height int, output binary", mode=mode)
