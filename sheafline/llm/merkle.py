"""Document fingerprints as Merkle trees over sections and paragraphs (operator 8).

A text is cut into sections (at blank lines and at headings), those into paragraphs (lines), those into pieces.  Pieces end
where a rolling hash of the last `WINDOW` characters says so, or where they would get too long; they are short at the
beginning of a text and longer further on, so that short texts have pieces too.  All cuts follow from the characters near
them, so an edit changes the pieces it touches and few others.

Every hash has 128 bits and is marked with its level: a piece's is of its characters, a paragraph's of its pieces' hashes, a
section's of its paragraphs' hashes and the root of the sections' hashes.  Roots test equality, and walking down differing
branches locates an edit.  The fingerprint is the tree as text: the root, then each section's paragraphs with the hash and
length of each of their pieces; the hashes between follow from those, and reading a fingerprint checks its root.
"""

from __future__ import annotations

import hashlib
import re
from base64 import urlsafe_b64encode
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.llm.common import prepare, ranges

#: Characters whose hash decides whether a piece ends after the last of them; a power of two.
WINDOW = 16
#: From these characters of the text on, one place in 2**bits ends a piece, and no piece is longer than 4 * 2**bits.
SIZES = ((0, 3), (32, 4), (128, 5), (1024, 6), (8192, 7))
HEADING = re.compile(r"(?:#{1,6} |\d+(?:\.\d+)*\.? +[A-Z])")
_FACTOR, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _hash(level: bytes, data: bytes) -> str:
    """22 characters; level: 0 piece, 1 paragraph, 2 section, 3 root."""
    return urlsafe_b64encode(hashlib.blake2b(level + data, digest_size=16).digest())[:22].decode()


@dataclass(frozen=True)
class Paragraph:
    hash: str
    pieces: tuple[tuple[str, int], ...]  # hash, code points


@dataclass(frozen=True)
class Section:
    hash: str
    paragraphs: tuple[Paragraph, ...]


@dataclass(frozen=True)
class Tree:
    root: str
    sections: tuple[Section, ...]

    def __str__(self) -> str:
        parts = [self.root]
        for s in self.sections:
            parts.append("/")
            parts += ["." + ",".join(f"{h}{n:x}" for h, n in p.pieces) for p in s.paragraphs]
        return "".join(parts)


def _built(sections: list[list[list[tuple[str, int]]]]) -> Tree:
    """The tree above the pieces."""
    done = []
    for s in sections:
        paragraphs = tuple(Paragraph(_hash(b"\1", "".join(h for h, _ in p).encode()), tuple(p)) for p in s)
        done.append(Section(_hash(b"\2", "".join(p.hash for p in paragraphs).encode()), paragraphs))
    return Tree(_hash(b"\3", "".join(s.hash for s in done).encode()), tuple(done))


def ends(text: str) -> list[int]:
    """Where pieces end by their content: offsets after their last characters, in order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    h, factor, width = c * np.uint64(_MIX), _FACTOR, 1
    while width < WINDOW:  # the hash of twice as many characters, from the two halves
        h[width:] = h[width:] + h[:-width] * np.uint64(factor)
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        width *= 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX)
    out = []
    for (start, bits), (stop, _) in zip(SIZES, (*SIZES[1:], (len(text), 0))):
        out.append(np.flatnonzero(h[start:stop] >> np.uint64(64 - bits) == 0) + start + 1)
    return np.concatenate(out).tolist()


def _most(at: int) -> int:
    """The greatest length of a piece that begins at an offset."""
    return 4 << next(bits for start, bits in reversed(SIZES) if start <= at)


def tree(text: str | None, known: dict[str, str] | None = None) -> Tree:
    """The text's tree; a null text is an empty one, whose tree has a root and nothing below.

    known: hashes of pieces, for texts that share some; it grows.
    """
    text = text or ""
    known = {} if known is None else known
    sections: list[list[list[tuple[str, int]]]] = []
    cuts, k, at, fresh = ends(text) if text else [], 0, 0, True
    for line in text.split("\n") if text else ():
        if fresh or HEADING.match(line):
            sections.append([])
        fresh = not line.strip()
        stop, pieces = at + len(line), []
        while at < stop:
            while k < len(cuts) and cuts[k] <= at:
                k += 1
            end = min(cuts[k] if k < len(cuts) else stop, stop, at + _most(at))
            part = text[at:end]
            if (h := known.get(part)) is None:
                h = known[part] = _hash(b"\0", part.encode("utf-8", "surrogatepass"))
            pieces.append((h, end - at))
            at = end
        at = stop + 1
        sections[-1].append(pieces)
    return _built(sections)


def parse(fingerprint: str) -> Tree:
    """The tree of a fingerprint's text; one whose root does not follow from its pieces is an error."""
    root, *sections = fingerprint.split("/")
    got = _built([[[(x[:22], int(x[22:], 16)) for x in p.split(",") if x] for p in s.split(".")[1:]] for s in sections])
    if got.root != root:
        raise ValueError("the root is not that of the pieces")
    return got


def _leaves(parts: list[Section]) -> Counter:
    n: Counter = Counter()
    for s in parts:
        for p in s.paragraphs:
            n.update(p.pieces)
    return n


def likeness(a: Tree, b: Tree) -> float:
    """Twice the code points of the pieces that both have, of those of both; equal roots are 1.

    Branches with equal hashes are taken as a whole; pieces are compared only below branches that differ.  Trees without a
    character (but not equal) are 0.
    """
    if a.root == b.root:
        return 1.0
    same_sections = Counter(s.hash for s in a.sections) & Counter(s.hash for s in b.sections)

    def rest(sections, same):
        same, left, shared, size = Counter(same), [], 0, 0
        for s in sections:
            n = sum(k for p in s.paragraphs for _, k in p.pieces)
            size += n
            if same[s.hash]:
                same[s.hash] -= 1
                shared += n
            else:
                left.append(s)
        return left, shared, size

    left_a, shared, size_a = rest(a.sections, same_sections)
    left_b, _, size_b = rest(b.sections, same_sections)
    shared += sum(k * n for (_, k), n in (_leaves(left_a) & _leaves(left_b)).items())
    return 2 * shared / (size_a + size_b) if size_a + size_b else 0.0


def differing(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) numbers in a whose branches b does not have: where an edit is."""
    if a.root == b.root:
        return []
    in_b = {s.hash for s in b.sections}
    paragraphs = {p.hash for s in b.sections for p in s.paragraphs}
    return [(i, j) for i, s in enumerate(a.sections) if s.hash not in in_b for j, p in enumerate(s.paragraphs) if p.hash not in paragraphs]


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first code points of the following text, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_pairs(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per document.

    Documents stand by descending id, nulls last; equal ids stand by their texts' hashes, equal rows in any order.  The next
    document of the last is the first; a single document is its own next.  A null text is an empty one; other columns are
    left out.

    Texts are dealt out by ranges of the id and sorted within them once.  Each task pairs neighbours as they pass; a range
    begins with a copy of the row that stands before it, so nothing has to be joined afterwards.
    """
    prepare(df.sparkSession)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # by ascending id the next document is the one before
    dealt = ranges(docs, ["doc_id"], ["tie"], before=True, wrap=True).select("doc_id", "text", "__guest")
    strings, doubles = ("edited_sha256", "fingerprint", "edited_fingerprint"), ("near_edited", "near_next")
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in strings), *(T.StructField(n, T.DoubleType()) for n in doubles)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following, next_tree = "", tree("")
        for b in batches:
            for at in range(0, b.num_rows, 128):
                rows = []
                for i, t, guest in zip(*(x.to_pylist() for x in b.slice(at, 128).columns)):
                    known: dict[str, str] = {}
                    own = tree(t, known)
                    if not guest:
                        new = edited(t, following)
                        new_tree = tree(new, known)
                        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                        rows.append((i, len(t), sha, str(own), str(new_tree), likeness(own, new_tree), likeness(own, next_tree)))
                    following, next_tree = t, own
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema)
