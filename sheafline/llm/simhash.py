"""SimHash near-duplicate classes by multi-index hashing (operator 2).

A document's 64-bit fingerprint is cut into two segments of 32 bits.  Two fingerprints that differ in at most three bits
differ in at most one bit in one of the segments, so each distinct fingerprint enters the table of each segment once and
looks up the Hamming ball of radius one around its own segment.  A pair that differs in one bit of a segment is met from
both sides; looking up only the words with a zero bit raised keeps one of them (17 lookups a segment instead of 33, on
average).  The table entries and lookups of a segment word meet in one partition, where complete distances are verified.

What meets under a word is a set of *distinct* fingerprints with 32 equal bits, as 8-byte integers.  Of these only a
spanning forest of the links leaves the task, never all pairs: from a fingerprint everything within the distance is taken
out of the set, then the search goes on from what was taken out.

The pipeline's near copies are found the same way, from fingerprints of 192 bits over five-word shingles in 16 segments, and
are then held against the exact share of their shingles (near_copy_classes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.llm.common import ASCII_LOWER, WORD_RE, discard, map_rows, may_be_in, prepare, written
from sheafline.llm.graph import connected_components

SEED = 42
BITS = 3
#: Words of more fingerprints than HOT are split; they are counted on one fingerprint in HOT_SAMPLE.
HOT, HOT_SAMPLE = 4096, 16


def shingles(text: str | None, width: int) -> list[str]:
    """Runs of `width` words, repeats included; of fewer words the whole sequence, of none nothing."""
    words = WORD_RE.findall((text or "").translate(ASCII_LOWER))
    if len(words) <= width:
        return [" ".join(words)] if words else []
    return [" ".join(x) for x in zip(*(words[i:] for i in range(width)))]


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """64 bits as an unsigned integer; a bit is set if it is in more than half of the shingles' hashes; no word: 0."""
    parts = shingles(text, width)
    if not parts:
        return 0
    of = xxhash.xxh64_intdigest
    h = np.array([of(x, seed) for x in parts], dtype="<u8")
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        count += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * count > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", width: int = 3, seed: int = SEED, name: str = "fp") -> DataFrame:
    """df with the fingerprint of each text as a signed long."""

    def run(texts: list) -> list:
        return [pa.array(np.array([fingerprint(t, width, seed) for t in texts], dtype=np.uint64).view(np.int64))]

    return map_rows(df, run, [text], [T.StructField(name, T.LongType(), False)])


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word, or of several in the last of two axes."""
    count = np.bitwise_count(x ^ y)
    return count if count.ndim == 1 else count.sum(-1, dtype=np.int64)


def _forest(ids: np.ndarray, fps: np.ndarray, bits: int) -> tuple[list, list]:
    """Links that connect what pairs within the distance connect, one fewer than members for each class."""
    a, b = [], []
    while len(ids) > 1:
        queue = [(ids[0], fps[0])]
        ids, fps = ids[1:], fps[1:]
        while queue and len(ids):
            i, f = queue.pop()
            near = _differ(fps, f) <= bits
            if near.any():
                found, far = np.flatnonzero(near), ~near
                a += [int(i)] * len(found)
                b += ids[found].tolist()
                queue.extend(zip(ids[found], fps[found]))
                ids, fps = ids[far], fps[far]
    return a, b


def _ball(word: str, bits: int) -> str:
    """SQL: a word of so many bits, and the word with each of its zero bits raised."""
    return f"array_insert(filter(transform(sequence(0, {bits - 1}), i -> if(({word} & shiftleft(1L, i)) = 0, {word} | shiftleft(1L, i), -1L)), k -> k >= 0), 1, {word})"


def _hot_words(named: DataFrame, words: list[str]) -> DataFrame:
    """key of the words that more than about HOT of the fingerprints have, counted on one in HOT_SAMPLE of these."""
    own = F.array(*(F.expr(f"{w} + {seg << 33}L") for seg, w in enumerate(words)))
    some = named.where(F.pmod(F.xxhash64("fp"), F.lit(HOT_SAMPLE)) == 0).select(F.explode(own).alias("key"))
    return some.groupBy("key").count().where(F.col("count") > HOT // HOT_SAMPLE).select("key")


def fingerprint_links(nodes: DataFrame, fp: str = "fp", node: str = "id", bits: int = BITS) -> DataFrame:
    """(a, b) of nodes: a forest with the same connected components as all pairs within `bits` <= 3 bits.

    nodes: a row for each node (long) with its fingerprint (signed long); nulls are ignored.

    A word that very many fingerprints have is split by multi-index hashing once more: what meets under it differs in three
    bits of the other segment at most, so in one bit of one of that segment's halves, and the balls around these are the
    tables.  Which words are split follows from a sample, and changes the work but not the links' components.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two segments with balls of radius one find pairs of up to 3 differing bits")
    prepare(nodes.sparkSession)
    # a key is a segment's word with the segment's number above it
    words = ["shiftrightunsigned(fp, 32)", "fp & 4294967295L"]
    keys = F.concat(*(F.expr(f"transform({_ball(w, 32)}, k -> k + {seg << 33}L)") for seg, w in enumerate(words)))
    named = nodes.select(F.col(node).alias("id"), F.col(fp).alias("fp")).where("fp is not null and id is not null")
    rows = named.select("*", F.explode(keys).alias("key"))
    hot = written(_hot_words(named, words), "hot-words")
    if not hot.isEmpty():
        # names of two words may fall together: what meets is compared in full anyway
        other = named.select("*", F.explode(keys).alias("key")).join(hot, "key", "left_semi").withColumn("other", F.expr(f"if(key < {1 << 33}L, {words[1]}, {words[0]})"))
        halves = F.concat(*(F.expr(f"transform({_ball(w, 16)}, k -> k + {half << 17}L)") for half, w in enumerate(["shiftrightunsigned(other, 16)", "other & 65535L"])))
        split = other.select("id", "fp", "key", F.explode(halves).alias("half")).select("id", "fp", F.xxhash64("key", "half").alias("key"))
        rows = rows.join(hot, "key", "left_anti").select("id", "fp", "key").union(split)
    rows = rows.repartition("key").sortWithinPartitions("key")

    def links(k: np.ndarray, i: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(k)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(k)]))
        s = starts[ends - starts == 2]  # by far the most frequent case beside single rows
        ok = s[np.bitwise_count(f[s] ^ f[s + 1]) <= bits]
        a, b = i[ok].tolist(), i[ok + 1].tolist()
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            more_a, more_b = _forest(i[s:e], f[s:e], bits)
            a += more_a
            b += more_b
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a key may span batches: the last key of a batch waits for the next batch
        waiting: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            k, i, f = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("key", "id", "fp"))
            if not len(k):
                continue
            f = f.view(np.uint64)
            cut = int(np.searchsorted(k, k[-1]))  # keys are sorted within the batch
            if cut == 0 and (not waiting or waiting[-1][0][-1] == k[-1]):
                waiting.append((k, i, f))
                continue
            yield links(*(np.concatenate([*(w[n] for w in waiting), x[:cut]]) for n, x in enumerate((k, i, f))))
            waiting = [tuple(x[cut:] for x in (k, i, f))]
        if waiting:
            yield links(*(np.concatenate([w[n] for w in waiting]) for n in range(3)))

    return rows.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def simhash_classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """doc_id, fp (signed long), component_id: one row per document.

    Null and empty texts have fingerprint zero and are linked like any other.  Documents without an id are left out: they
    could not be named by a class.  Copies fall together before any link is looked for, so a group of copies is one
    fingerprint however large it is.
    """
    docs = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    fp = written(fingerprints(docs, "__text", width, seed).select("doc_id", "fp"), "fingerprints")
    nodes = written(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    # a fingerprint is named by its smallest id, and so is a class in the end
    comp = connected_components(fingerprint_links(nodes, "fp", "first_id", bits))
    by_fp = nodes.join(comp, nodes.first_id == comp.node, "left").select("fp", F.coalesce("component", "first_id").alias("component_id"))
    return fp.join(by_fp, "fp").select("doc_id", "fp", "component_id")


#: For keeping one of each group of near copies.  Two texts are near copies if they share NEAR_SHARE (a fraction) of their
#: different five-word shingles.  Candidates are fingerprints of COPY_WORDS x 64 bits that differ in COPY_BITS at most, found by
#: COPY_SEGMENTS tables of SEGMENT bits with balls of radius one: of pairs that share just 0.8, about 29 bits differ.
COPY_WIDTH, NEAR_SHARE = 5, (4, 5)
COPY_WORDS, COPY_BITS, SEGMENT = 3, 48, 12
COPY_SEGMENTS = 64 * COPY_WORDS // SEGMENT
#: Sets of fewer shingles have no near copy but equal sets.
LEAST_SHARED = -(-NEAR_SHARE[0] // (NEAR_SHARE[1] - NEAR_SHARE[0]))
#: Entries of a segment's word that one task holds; of words with more each pair of blocks goes to a task.
COPY_HOT = 1 << 20
#: Fingerprints whose entries are dealt out at once, entries from which on large groups are looked for first, and pairs compared at once.
COPY_CHUNK, COPY_GROUP, COPY_PAIRS = 8192, 4096, 1 << 21
#: Fingerprints in a row that may bring little before links are made to all that wait.
COPY_TRIES = 64
#: Hashes of the sets of a group that one task holds; of larger groups each pair of blocks goes to a task.
BLOCK = 1_000_000
_SEEDS = np.random.default_rng(SEED).integers(0, 2**64, (COPY_WORDS, 1), dtype=np.uint64)
_SHIFTS, _ONES = np.arange(8, dtype=np.uint64)[:, None], np.uint64(0x0101010101010101)


def shingle_set(text: str | None, width: int = COPY_WIDTH, seed: int = SEED) -> np.ndarray:
    """The hashes of a text's different shingles, sorted."""
    return np.unique(np.array([xxhash.xxh64_intdigest(x, seed) for x in shingles(text, width)], dtype=np.uint64))


def _mixed(members: np.ndarray) -> np.ndarray:
    """COPY_WORDS further hashes of each hash (the finaliser of SplitMix64), by row."""
    x = members + _SEEDS
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def copy_fingerprint(members: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes, COPY_WORDS unsigned longs: a bit is set if it is in more than half of the hashes."""
    count = np.zeros((COPY_WORDS, 8, 8), dtype=np.int64)
    for at in range(0, len(members), 16 * 255):
        x = _mixed(members[at : at + 16 * 255])
        # bits i, i + 8 and so on of a word are counted in its bytes, 255 times at most
        sums = np.add.reduceat((x[:, None] >> _SHIFTS) & _ONES, np.arange(0, x.shape[1], 255), axis=2)
        count += sums.astype("<u8").view(np.uint8).reshape(COPY_WORDS, 8, -1, 8).sum(2, dtype=np.int64)
    more = 2 * count.transpose(0, 2, 1).reshape(COPY_WORDS, 64) > len(members)
    return np.packbits(more, axis=1, bitorder="little").view("<u8").reshape(-1)


def _segments(fps: np.ndarray) -> np.ndarray:
    """The words of each fingerprint's segments, as integers."""
    bits = np.unpackbits(np.ascontiguousarray(fps, dtype="<u8").view(np.uint8), axis=1, bitorder="little")
    return bits.reshape(len(fps), COPY_SEGMENTS, SEGMENT).astype(np.int32) @ (1 << np.arange(SEGMENT, dtype=np.int32))


def _entries(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the entries of fingerprints in the tables: each segment's word, and the word with each zero bit raised; a
    key is a word with the segment's number above it."""
    word = _segments(fps)[:, :, None]
    ball = word | np.concatenate(([0], 1 << np.arange(SEGMENT))).astype(np.int32)
    here = ball != word
    here[:, :, 0] = True
    key = ball + (np.arange(COPY_SEGMENTS, dtype=np.int32) << SEGMENT)[:, None]
    return key[here], np.nonzero(here)[0]


def _places(ids: np.ndarray) -> np.ndarray:
    """A hash of each node; modulo the blocks of a word it is the node's block there."""
    return (_mixed(ids.view(np.uint64))[0] >> np.uint64(8)).astype(np.int64)


def _new_links(some: np.ndarray, ids: np.ndarray, fps: np.ndarray, before: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list, list]:
    """Links that connect what pairs of `some` (rows) within COPY_BITS connect, where before(row, rows) are linked elsewhere.

    From a fingerprint those within the distance that are linked to it elsewhere are taken out of the set, and the search goes
    on from these.  The others within the distance wait; a link is made to one that waits when the search has ended, and to
    all that wait when COPY_TRIES fingerprints in a row have brought little."""
    a, b = [], []
    left, words = some, fps[some]
    by = np.full(len(ids), -1)  # from where a row that waits was met
    while len(left):
        queue, tries = [int(left[0])], 0
        left, words = left[1:], words[1:]
        waits = np.zeros(len(left), dtype=bool)
        while queue or waits.any():
            if waits.any() and (not queue or tries >= COPY_TRIES):
                now = np.flatnonzero(waits) if tries >= COPY_TRIES else np.array([waits.argmax()])
                tries = 0 if tries >= COPY_TRIES else tries
                a += ids[by[left[now]]].tolist()
                b += ids[left[now]].tolist()
                queue += left[now].tolist()
                stay = np.ones(len(left), dtype=bool)
                stay[now] = False
                left, words, waits = left[stay], words[stay], waits[stay]
            if not len(left):
                break
            i, tries = queue.pop(), tries + bool(waits.any())
            near = np.flatnonzero(_differ(words, fps[i]) <= COPY_BITS)
            if not len(near):
                continue
            by[left[near[~waits[near]]]] = i
            waits[near] = True
            found = near[before(i, left[near])]
            if len(found):
                queue += left[found].tolist()
                if 8 * len(found) >= len(left):
                    tries = 0
                stay = np.ones(len(left), dtype=bool)
                stay[found] = False
                left, words, waits = left[stay], words[stay], waits[stay]
    return a, b


def _met(key: int, ids: np.ndarray, fps: np.ndarray, block: np.ndarray | None = None) -> tuple[list, list]:
    """Links that connect what pairs of entries of a key within COPY_BITS connect, where one at least has the very word; but
    none that other keys' links make needless.  `block`: of two blocks that meet, to which an entry belongs.

    A pair that meets in a segment before this one is linked there.  So is a pair that has another word of this segment, under
    that word, which has a bit less; and a pair of one block, where that block meets itself.  As every such place comes before
    this one in that order, all links together connect what all pairs connect, but a group's pairs are not linked anew under
    each of its words.

    Of many entries, groups within the distance of some entry are joined first, and their pairs are not looked at."""
    words, segment = _segments(fps), key >> SEGMENT
    own = words[:, segment] == key & ((1 << SEGMENT) - 1)

    def before(i: int, j: np.ndarray) -> np.ndarray:
        linked = (np.bitwise_count(words[j, :segment] ^ words[i, :segment]) <= 1).any(axis=1)
        if not own[i]:
            linked |= words[j, segment] == words[i, segment]
        if block is not None:
            linked |= (block[j] == block[i]) & (own[j] | own[i])
        return linked

    group = np.zeros(len(ids), dtype=np.int64)
    a, b = [], []
    if len(ids) > COPY_GROUP:
        for c in np.linspace(0, len(ids) - 1, 8).astype(int):
            near = (group == 0) & (_differ(fps, fps[c]) <= COPY_BITS)
            if not group[c] and 16 * near.sum() >= len(ids):
                group[near] = c + 1
                near[c] = False
                more_a, more_b = _new_links(np.concatenate(([c], np.flatnonzero(near))), ids, fps, before)
                a += more_a
                b += more_b
    some = np.zeros(len(ids), dtype=bool)
    for g in np.unique(group[own]):
        mine, other = np.flatnonzero(own & (group == g)), np.flatnonzero((group != g) | (g == 0))
        step = max(1, COPY_PAIRS // max(1, len(other)))
        for at in range(0, len(mine), step):
            x, y = fps[mine[at : at + step]], fps[other]
            count = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            for w in range(1, COPY_WORDS - 1):
                count += np.bitwise_count(x[:, None, w] ^ y[None, :, w])
            i, j = np.nonzero(count <= COPY_BITS)
            i, j = mine[at + i], other[j]
            apart = ids[i] != ids[j]
            i, j = i[apart], j[apart]
            near = _differ(fps[i], fps[j]) <= COPY_BITS
            some[i[near]] = some[j[near]] = True
    if some.any():
        more_a, more_b = _new_links(np.flatnonzero(some), ids, fps, before)
        a += more_a
        b += more_b
    return a, b


def _copy_blocks(nodes: DataFrame) -> dict[int, int]:
    """Blocks of the keys that have more than about COPY_HOT entries, counted on one node in HOT_SAMPLE; there are
    COPY_SEGMENTS << SEGMENT keys at most."""
    if nodes.count() <= COPY_HOT:  # a node enters a key once
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(COPY_SEGMENTS << SEGMENT, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                count += np.bincount(_entries(_words(batch))[0], minlength=len(count))
        keys = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(count[keys], pa.int64())], names=["key", "n"])

    some = nodes.where(F.pmod(F.xxhash64("id"), F.lit(HOT_SAMPLE)) == 0).select("id", "fp")
    rows = some.mapInArrow(run, "key long, n long").groupBy("key").agg((F.sum("n") * HOT_SAMPLE).alias("n")).where(F.col("n") > COPY_HOT)
    return {r.key: -(-r.n // COPY_HOT) for r in rows.collect()}


def _words(batch: pa.RecordBatch) -> np.ndarray:
    """The fingerprints of a batch, a row of unsigned words each."""
    return batch.column(batch.schema.get_field_index("fp")).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, COPY_WORDS)


def copy_links(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes (id, fp: COPY_WORDS longs) whose fingerprints differ in COPY_BITS at most; links that connect what all
    pairs that meet connect.

    Pairs that differ in up to 2 * COPY_SEGMENTS - 1 bits are always met, as one segment differs in a bit at most; pairs up to
    COPY_BITS are met where one does.  The entries of a key travel packed, ids and whole fingerprints, a row for each chunk of
    nodes.
    """
    spark = nodes.sparkSession
    prepare(spark)
    blocks = _copy_blocks(nodes)

    def packed(ids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        key, row = _entries(fps)
        full = key.astype(np.int64) << 32
        if blocks:
            of_key = np.ones(COPY_SEGMENTS << SEGMENT, dtype=np.int64)
            of_key[list(blocks)] = list(blocks.values())
            n = of_key[key]
            own = _places(ids)[row] % n
            at = np.repeat(np.arange(len(key)), n)
            other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            full, row = full[at] | np.minimum(own[at], other) << 16 | np.maximum(own[at], other), row[at]
        order = np.argsort(full, kind="stable")
        full = full[order]
        data = np.column_stack([ids.view(np.uint64), fps])[row[order]]
        start = np.concatenate(([0], np.flatnonzero(np.diff(full)) + 1, [len(full)]))
        at = (start * data.itemsize * data.shape[1]).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
        return pa.RecordBatch.from_arrays([pa.array(full[start[:-1]], pa.int64()), blobs], names=["key", "entries"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = [], 0
        for batch in batches:
            if batch.num_rows:
                now.append((batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False), _words(batch)))
                n += batch.num_rows
            if n >= COPY_CHUNK:
                yield packed(*(np.concatenate(x) for x in zip(*now)))
                now, n = [], 0
        if now:
            yield packed(*(np.concatenate(x) for x in zip(*now)))

    def links(key: int, pieces: list) -> pa.RecordBatch:
        at = np.concatenate(pieces).reshape(-1, COPY_WORDS + 1)
        ids, two = at[:, 0].view(np.int64), key >> 16 & 0xFFFF != key & 0xFFFF
        a, b = _met(key >> 32, ids, at[:, 1:], _places(ids) % blocks[key >> 32] if two else None)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, []  # the key that is being read, and its entries so far
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            blobs = batch.column(batch.schema.get_field_index("entries"))
            _, offsets, data = blobs.buffers()
            at = np.frombuffer(offsets, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
            data = np.frombuffer(data, np.uint8)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:]):
                if now is not None and key[s] != now:
                    yield links(now, pieces)
                    pieces = []
                now = int(key[s])
                pieces.append(np.frombuffer(data[at[s] : at[e]].tobytes(), np.uint64))
        if pieces:
            yield links(now, pieces)

    rows = nodes.select("id", "fp").mapInArrow(pack, "key long, entries binary").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(meet, "a long, b long").where("a <> b").distinct()


def _near_copies(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (id, members) share at least NEAR_SHARE."""
    both = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
    both = both.select("a", "b", (F.size("of_a") + F.size("of_b")).alias("total"), F.size(F.array_intersect("of_a", "of_b")).alias("common"))
    return both.where(F.col("common") * NEAR_SHARE[1] >= (F.col("total") - F.col("common")) * NEAR_SHARE[0]).select("a", "b")


def _forest_across(ids: np.ndarray, parts: np.ndarray, values: np.ndarray, size: np.ndarray) -> tuple[list, list]:
    """Links between near copies in different parts, one fewer than the parts that they join; sets lie in `values`, one after
    the other.  Pairs with one end outside the largest part are all compared, by their exact shares."""
    some = size > 0
    ids, parts, size = ids[some], parts[some], size[some]
    names, root, count = np.unique(parts, return_inverse=True, return_counts=True)
    a, b = [], []
    if len(names) < 2:
        return a, b
    known, at = np.unique(values, return_inverse=True)
    start = np.cumsum(size) - size
    mark = np.zeros(len(known), dtype=np.int8)
    for x in np.flatnonzero(root != count.argmax()):
        own = at[start[x] : start[x] + size[x]]
        mark[own] = 1
        common = np.add.reduceat(mark[at], start, dtype=np.int64)
        mark[own] = 0
        near = (common * NEAR_SHARE[1] >= (size + size[x] - common) * NEAR_SHARE[0]) & (root != root[x])
        for y in np.flatnonzero(near):
            if root[y] != root[x]:
                a.append(int(ids[x]))
                b.append(int(ids[y]))
                root[root == root[y]] = root[x]
    return a, b


def _links_across(rows: DataFrame) -> DataFrame:
    """(a, b) of near copies of different components that meet in a group; rows: key (any columns), id, component, members."""
    prepare(rows.sparkSession)
    keys = [c for c in rows.columns if c not in ("id", "component", "members")]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def links(pieces: list) -> pa.RecordBatch:
        a, b = _forest_across(*(np.concatenate(x) for x in zip(*pieces)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, []  # the group that is being read, and its rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            key = np.stack([column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], axis=1)
            ids, parts = (column(n).to_numpy(zero_copy_only=False) for n in ("id", "component"))
            lists = column("members")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for s, e in zip(cuts, cuts[1:]):
                this = tuple(key[s])
                if now is not None and this != now:
                    yield links(pieces)
                    pieces = []
                now = this
                pieces.append((ids[s:e].copy(), parts[s:e].copy(), values[ends[s] : ends[e]].copy(), np.diff(ends[s : e + 1])))
        if pieces:
            yield links(pieces)

    return dealt.mapInArrow(run, "a long, b long")


def near_copy_components(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of nodes (id, fp) that have a near copy, by their whole texts in docs (doc_id, __text).

    Candidates are the components of fingerprints within COPY_BITS, by multi-index hashing.  The result's components are those
    of all pairs of a candidate component that are near copies, but pairs are not made rows of.  First each node is compared
    with one other, the least of its candidates.  Where near copies have not joined all candidates of one least id, their sets
    come to one task, or to one for each pair of blocks where they are more than BLOCK hashes; there every pair across
    components is compared, and links that join components are all that leaves.
    """
    met = written(connected_components(copy_links(nodes)).toDF("id", "key"), "copy-met")
    members = T.StructField("members", T.ArrayType(T.LongType(), False), False)
    named = written(met.select("id"), "copy-named")
    texts = may_be_in(docs, "doc_id", named).where("__may").drop("__may")
    texts = texts.join(named, texts.doc_id == named.id, "left_semi")
    sets = written(map_rows(texts, lambda ts: [[shingle_set(t).view(np.int64) for t in ts]], ["__text"], [members], keep=["doc_id"]).toDF("id", "members"), "copy-sets")
    first = met.where("key <> id").select(F.col("key").alias("a"), F.col("id").alias("b"))
    links = written(_near_copies(first, sets), "copy-links")
    at = written(connected_components(links), "copy-components")
    placed = met.join(at.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    live = written(placed.join(written(apart, "copy-apart"), "key").join(sets.select("id", F.size("members").alias("n")), "id"), "copy-live")
    blocks = written(live.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")), "copy-blocks")
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    rows = live.join(blocks, "key").select("key", "id", "component", F.explode(pairs).alias("pair")).select("key", "pair.i", "pair.j", "id", "component")
    more = written(_links_across(rows.join(sets, "id").select("key", "i", "j", "id", "component", "members")).distinct(), "copy-links")
    got = connected_components(more.union(at.select("component", "node")))
    for t in (met, sets, live):
        discard(t)
    return got


def near_copy_classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, component_id of the documents.

    Two documents are linked if they share 0.8 of their different five-word shingles, counted exactly; candidates come from
    SimHash fingerprints of the shingles.  Texts with the same shingles are one node.  Rows of one id are one document; ids
    must be longs; rows without an id are left out.  Documents without a word are copies of each other.
    """

    def run(texts: list) -> list:
        sets = [shingle_set(t) for t in texts]
        return [[xxhash.xxh3_128_digest(x.tobytes()) for x in sets], [copy_fingerprint(x).view(np.int64) if len(x) >= LEAST_SHARED else None for x in sets]]

    fields = [T.StructField("digest", T.BinaryType(), False), T.StructField("fp", T.ArrayType(T.LongType(), False), True)]
    docs = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    seen = written(map_rows(docs, run, ["__text"], fields, keep=["doc_id"]), "copy-fingerprints")
    nodes = written(seen.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp")), "copy-nodes")
    comp = near_copy_components(nodes.where("fp is not null"), docs)
    of_node = nodes.join(comp, nodes.id == comp.node, "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    return seen.select("doc_id", "digest").join(of_node, "digest").select("doc_id", "component_id")


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df without the documents that have a near copy of a smaller id in their class: one document of each class stays.

    Rows that repeat the id that stays all stay, and so do rows without an id.  Null and empty texts, and others without a
    word, are copies of each other.  All columns pass through, whatever their names.
    """
    gone = near_copy_classes(df, text, doc_id).where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    gone = written(gone, "copies")
    marked = may_be_in(df, doc_id, gone)  # most documents stay where they are; only what may have to go is looked up
    left = marked.where("__may").join(gone, doc_id, "left_anti").unionByName(marked.where("not __may"))
    return left.select(*("`" + c.replace("`", "``") + "`" for c in df.columns))
