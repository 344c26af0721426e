"""SentencePiece encoding and decoding (operator 3).

An Aho-Corasick automaton over the pieces reads a text once.  At each position its output links name the pieces that end
there; each of them relaxes the best score at that position from the best score where it begins, and the best path is read
back from the end (Viterbi).

The score of an arc depends on the model file.  In a unigram model it is the piece's log-probability.  In a BPE model the
file's scores are merge ranks, whose sums mean nothing; there an arc is admitted if the piece may follow the last piece of
the best path to its beginning, that is if merging the two pieces' characters by rank gives the two pieces again.  A text
has one path of such arcs, which is what merging the whole text by rank gives, so ids equal the SentencePiece library's for
both kinds.

The vocabulary file's path is a parameter; the driver reads the file and tasks get its pieces.
"""

from __future__ import annotations

import re
import struct
from array import array
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheafline.llm.common import map_rows

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Chunks that a task remembers of late and from before, and half of the pairs of pieces, at most; what is forgotten is
#: computed anew.
REMEMBERED = 200_000
#: Marks that close words.
MARKS = ".,;:!?*#$%&|+=()[]{}<>\"'"
#: What an unknown character costs below the worst piece, in unigram models.
UNKNOWN_COST = 10.0


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message's fields; values of length-delimited and fixed fields are bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class Vocabulary:
    """Pieces, scores and kinds by id; what the file says of the model."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    model: int
    dummy_prefix: bool

    def __hash__(self) -> int:
        return hash((len(self.pieces), self.pieces[-1:], self.model))


def read_vocabulary(data: bytes) -> Vocabulary:
    """The vocabulary of a SentencePiece model file.  Models with a character map, or that drop white space, are refused."""
    pieces, scores, kinds, model, dummy = [], [], [], UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            pieces.append(got[1].decode())
            scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
            kinds.append(got.get(3, NORMAL))
        elif number == 2:
            model = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            rules = dict(_fields(value))
            dummy = bool(rules.get(3, 1))
            if rules.get(2) or rules.get(4, 1):
                raise ValueError("only models that leave characters and white space as they are can be used")
    if model not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be used")
    return Vocabulary(tuple(pieces), tuple(scores), tuple(kinds), model, dummy)


class Coder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.ids = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k in (NORMAL, USER)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.unknown = v.kinds.index(UNKNOWN)
        self.bytes_at = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == BYTE}
        self.unknown_score = min((v.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_COST
        # no piece goes on with a space mark, or has a newline: paths never cross the chunks that this cuts
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        line = any("\n" in p for p in self.ids)
        self.chunk = re.compile(r".+" if inner else (rf"{SPACE}*[^{SPACE}]+|{SPACE}+" if line else rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"), re.S)
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.single = {c for p in self.ids for c in p}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.out = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds)]

    def merged(self, text: str) -> list[str]:
        """The text's characters merged by rank, leftmost first among equals."""
        parts, get, scores = list(text), self.ids.get, self.v.scores
        none = float("-inf")

        def rank(i: int) -> float:
            got = get(parts[i] + parts[i + 1])
            return none if got is None else scores[got]

        ranks = [rank(i) for i in range(len(parts) - 1)]
        while ranks:
            best = max(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(i - 1)
            if i < len(ranks):
                ranks[i] = rank(i)
        return parts

    def _judge(self, last: int, piece: int) -> bool:
        """Whether merging leaves the two pieces as they are; last is -1 at the beginning and after unknown characters."""
        own = self.v.pieces[piece]
        before = [] if last < 0 else [self.v.pieces[last]]
        got = self.merged("".join(before) + own) == [*before, own]
        if len(self.pairs) >= 2 * REMEMBERED:
            self.pairs.clear()
        self.pairs[(last + 1) * len(self.v.pieces) + piece] = got
        return got

    def path(self, text: str) -> list[int]:
        """Ids of the best path of a text whose spaces are marks; -1 for each character that no piece has."""
        n = len(text)
        size = [1] * (n + 1)
        last = self._ranked(text, size) if self.v.model == BPE else self._weighted(text, size)
        out, at = [], n
        while at > 0:
            out.append(-1 if last[at] is None else last[at])
            at -= size[at]
        out.reverse()
        return out

    def _ranked(self, text: str, size: list[int]) -> list[int | None]:
        """For each position the piece by which its one path ends; arcs score nothing or do not exist.

        A position at which no piece ends comes after a character that no piece has.
        """
        last: list[int | None] = [None] * len(size)
        pairs, many = self.pairs, len(self.v.pieces)
        for end, (piece, length) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                before = last[end - length]
                if before is None:
                    before = -1
                fits = pairs.get((before + 1) * many + piece)
                if fits is None:
                    fits = self._judge(before, piece)
                if fits:
                    last[end], size[end] = piece, length
        return last

    def _weighted(self, text: str, size: list[int]) -> list[int | None]:
        """For each position the piece by which its best path ends, by the sum of the pieces' scores."""
        last: list[int | None] = [None] * len(size)
        best = [0.0, *([None] * (len(size) - 1))]
        scores, done = self.v.scores, 0
        for end, (piece, length) in self.automaton.iter(text):
            end += 1
            while done < end - 1:  # positions that have their best score by now; without a piece, an unknown character ends there
                done += 1
                if best[done] is None:
                    best[done] = best[done - 1] + self.unknown_score
            score = best[end - length] + scores[piece]
            unknown = best[end - 1] + self.unknown_score
            if best[end] is None and unknown > score:
                best[end] = unknown
            if best[end] is None or score > best[end]:
                best[end], last[end], size[end] = score, piece, length
        return last

    def _encode_chunk(self, text: str) -> bytes:
        """Ids of a chunk, cut once more before its closing marks if no piece goes on into them: no path crosses that.

        A word and the marks after it are each met again with others.
        """
        stem = text.rstrip(MARKS)
        at = len(stem)
        # a run of unknown characters may be one id, so it stays together
        if 0 < at < len(text) and text[at - 1 : at + 1] not in self.beside and (text[at - 1] in self.single or text[at] in self.single):
            return self._known(stem) + self._known(text[at:])
        ids, at = [], 0
        for i in self.path(text):
            if i >= 0:
                ids.append(i)
                at += len(self.v.pieces[i])
            else:
                if self.bytes_at:
                    ids += [self.bytes_at[b] for b in text[at].encode("utf-8", "replace")]
                elif not ids or ids[-1] != self.unknown or at == 0:
                    ids.append(self.unknown)  # a run of unknown characters is one
                at += 1
        return array("i", ids).tobytes()

    def _known(self, text: str) -> bytes:
        """Ids of a chunk that is not among the latest: remembered from before, or found."""
        got = self.chunks.get(text)
        if got is None:
            got = self.older.get(text)
            if got is None:
                got = self._encode_chunk(text)
            if len(text) <= 64:
                if len(self.chunks) >= REMEMBERED:  # what was met of late stays for another round
                    self.older = dict(self.chunks)
                    self.chunks.clear()
                self.chunks[text] = got
        return got

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as 4-byte integers; a null or empty text has none."""
        if not text:
            return b""
        text = (" " + text if self.v.dummy_prefix else text).replace(" ", SPACE)
        out, known = [], self.chunks
        for c in self.chunk.findall(text):
            got = known.get(c)
            out.append(self._known(c) if got is None else got)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        out = b"".join([self.out[i] for i in ids])
        if self.v.dummy_prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


@lru_cache(2)
def coder(v: Vocabulary) -> Coder:
    return Coder(v)


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    with open(path, "rb") as f:
        return read_vocabulary(f.read())


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """df with `ids` (array of int) and n_tokens.

    A null or empty text has no ids.  Characters that no piece has are their UTF-8 bytes' pieces, or the unknown piece where
    the model has none of those.
    """

    def run(texts: list) -> list:
        c = coder(vocabulary)
        parts = [c.encode_bytes(t) for t in texts]
        size = np.array([len(p) // 4 for p in parts], dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))
        return [ids.cast(pa.list_(pa.int32())), pa.array(size)]

    return map_rows(df, run, [text], [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())], rows=128)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """df with the text of each row's ids; null ids give an empty text."""

    def run(lists: list) -> list:
        c = coder(vocabulary)
        return [[c.decode(x or []) for x in lists]]

    return map_rows(df, run, [ids], [T.StructField(name, T.StringType())], rows=128)
