"""Command lines for media conversions; running them is left to the cluster's own tools."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from sheafline.operators.structured import scalar_text
from sheafline.plans import registry
from sheafline.plans.rows import CodedError, map_rows

#: Encoders of audio formats, those that take no bit rate, video and picture formats, actions, palette graph.
AUDIO = {"mp3": "libmp3lame", "m4a": "aac", "aac": "aac", "ogg": "libvorbis", "opus": "libopus", "flac": "flac", "wav": "pcm_s16le"}
LOSSLESS = frozenset(("flac", "wav"))
VIDEO = frozenset(("mp4", "webm", "mkv", "mov", "avi"))
PICTURE = frozenset(("png", "jpg"))
ACTIONS = ("convert", "extractAudio", "extractFrame", "trim", "compress")
PALETTE = "split[a][b];[a]palettegen[p];[b][p]paletteuse"
DEFAULTS = {"audioBitrate": "192k", "videoCrf": "28", "trimStart": "", "trimEnd": "", "frameAt": "1", "scale": "source", "gifFps": "12"}
#: Kilobits a second that compressed audio gets at most.
MOST_RATE = 128


def seconds(value) -> float | None:
    """Seconds of a number or a clock h:m:s or m:s; blank is None."""
    text = str(value if value is not None else "").strip()
    if not text:
        return None
    if not re.fullmatch(r"(?:\d{1,4}:)?(?:\d{1,3}:)?\d{1,3}(?:\.\d+)?|\d+(?:\.\d+)?", text):
        raise CodedError("MEDIA_BAD_TIME", f"not a time: {text}")
    total = 0.0
    for part in text.split(":"):
        total = 60 * total + float(part)
    return total


def _number(value, least: float, most: float, name: str) -> str:
    try:
        n = float(value)
    except (TypeError, ValueError):
        n = float("nan")
    if not least <= n <= most:
        raise CodedError("MEDIA_BAD_PARAM", f"{name} is not a number from {least:g} to {most:g}: {value}")
    return scalar_text(n)


def default_target(action: str, ext: str) -> str:
    """The format an action gives unless told otherwise."""
    if action in ("extractFrame", "extractAudio"):
        return "png" if action == "extractFrame" else "mp3"
    if ext in OFFERED:
        return ext
    return "mp4" if ext in VIDEO or ext == "gif" else "mp3"


OFFERED = frozenset(next(t for n, _, _, t in registry.CONVERTERS if n == "media").split())


def resolve(action: str | None, target: str | None, ext: str) -> tuple[str, str]:
    """Action and target: no action converts, no target is the default one, mp3cut is a trim to mp3."""
    action = action or "convert"
    if action not in ACTIONS:
        raise CodedError("MEDIA_BAD_ACTION", f"no such action: {action}")
    target = (target or "").strip().lower().removeprefix(".") or default_target(action, ext)
    return ("trim", "mp3") if target == "mp3cut" else (action, target)


def output_name(source: str | None, target: str) -> str:
    """The source's own name with the target's ending."""
    base = re.split(r"[\\/]", source or "output")[-1]
    stem = base.rpartition(".")[0] or base
    return f"{stem or 'output'}.{target}"


def command(action: str, source: str, target: str, options: dict | None = None) -> list[str]:
    """Arguments for an action on a file, the output file last; options as in DEFAULTS."""
    o = DEFAULTS | {k: str(v).strip() for k, v in (options or {}).items() if v is not None}
    if action not in ACTIONS:
        raise CodedError("MEDIA_BAD_ACTION", f"no such action: {action}")
    if not (source or "").strip():
        raise CodedError("MEDIA_BAD_INPUT", "no input file is named")
    ext, from_ext = (x.rpartition(".")[2].lower() if "." in x else "" for x in (target, source))
    if not ext:
        raise CodedError("MEDIA_BAD_OUTPUT", f"{target} has no ending that says what it is")
    if not re.fullmatch(r"\d{2,3}k", o["audioBitrate"]):
        raise CodedError("MEDIA_BAD_PARAM", f"not a bit rate: {o['audioBitrate']}")
    scaled = o["scale"] not in ("", "source")

    def longest_edge() -> list[str]:
        if not scaled:
            return []
        n = _number(o["scale"], 1, 1e5, "scale")
        return ["-vf", f"scale='if(gt(iw,ih),min({n},iw),-2)':'if(gt(iw,ih),-2,min({n},ih))'"]

    def sound(rate: str) -> list[str]:
        return ["-vn", "-c:a", AUDIO[ext], *([] if ext in LOSSLESS else ["-b:a", rate])]

    def picture() -> list[str]:
        crf = _number(o["videoCrf"], 1, 51, "videoCrf")
        coder = ["libvpx-vp9", "-crf", crf, "-b:v", "0"] if ext == "webm" else ["libx264", "-preset", "veryfast", "-crf", crf, "-pix_fmt", "yuv420p"]
        return [*longest_edge(), "-c:v", *coder, "-c:a", "libopus" if ext == "webm" else "aac", "-b:a", o["audioBitrate"]]

    def animation() -> list[str]:
        fps, width = _number(o["gifFps"], 1, 60, "gifFps"), _number(o["scale"], 1, 1e5, "scale") if scaled else "iw"
        return ["-filter_complex", f"fps={fps},scale={width}:-1:flags=lanczos,{PALETTE}", "-an"]

    unsupported = CodedError("MEDIA_UNSUPPORTED_TARGET", f"{action} does not give {ext}")
    if action == "extractFrame" or action == "convert" and ext in PICTURE:
        if ext not in PICTURE:
            raise unsupported
        return ["-y", "-ss", scalar_text(round(seconds(o["frameAt"]) or 0.0, 3)), "-i", source, "-frames:v", "1", *longest_edge(), *(["-q:v", "2"] if ext == "jpg" else []), target]
    head, start = ["-y"], None
    if action == "trim":
        start, end = seconds(o["trimStart"]), seconds(o["trimEnd"])
        if start is None and end is None or None not in (start, end) and end <= start:
            raise CodedError("MEDIA_BAD_TRIM", "a trim needs a start or an end, and an end after the start")
        # the clock begins anew after -ss, so the end is given as a length
        head += [] if start is None else ["-ss", scalar_text(round(start, 3))]
        tail = [] if end is None else ["-t", scalar_text(round(end - (start or 0), 3))]
    else:
        tail = []
    if action == "extractAudio" and ext not in AUDIO or action == "compress" and ext in VIDEO and from_ext in AUDIO:
        raise unsupported
    if ext in AUDIO:
        body = sound(f"{min(int(o['audioBitrate'][:-1]), MOST_RATE)}k" if action == "compress" else o["audioBitrate"])
    elif ext == "gif":
        body = animation()
    elif ext in PICTURE and action == "trim":
        body = ["-frames:v", "1"]
    elif ext in VIDEO:
        body = picture()
    else:
        raise unsupported
    return [*head, "-i", source, *tail, *body, target]


def commands(df: DataFrame, action: str = "action", source: str = "source", target: str = "target", options: str = "options") -> DataFrame:
    """df with argv; options is a map of strings."""
    return map_rows(df, lambda a, s, t, o: (command(a, s, t, dict(o or {})),), [action, source, target, options], "argv array<string>")
