"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import gzip
import hashlib
import io
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.llm import common, graph, html_extract, langid, linear, merkle, mixing, quality, queries, secret_scan, sentencepieces, simhash, toxicity, warc

LONG = "long " * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, packed string, ids string"


def docs(spark, texts, sources=None, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", s, len(t or ""), 9.0, "clash", "clash", "clash") for i, t, s in zip(ids, texts, sources or ["s"] * len(texts))]
    return spark.createDataFrame(rows, SCHEMA)


EDGE = [None, "", " \n\t", "x", LONG, "same words here again", "same words here again", "Ünïcode 日本 😀", '\\N {"q": \'$1\'} %s\r\nb']


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# graph


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_no_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ranges and samples


@pytest.mark.parametrize("seed,n", [(0, 0), (1, 1), (2, 2), (3, 60), (4, 400)])
def test_ranges_show_each_row_its_neighbours(spark, seed, n):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(n)]), i) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, t long").repartition(7)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for wrap in (False, True):
        parts = {}
        for x in common.ranges(df, ["k"], ["t"], before=True, after=True, wrap=wrap).collect():
            parts.setdefault(x["__part"], []).append((x["__guest"], (x.k, x.t)))
        seen = {}
        for p in parts.values():  # a partition comes whole and in its order
            assert [g for g, _ in p] == sorted(g for g, _ in p)
            for j, (g, x) in enumerate(p):
                if not g:
                    seen[x] = (p[j - 1][1] if j else None, p[j + 1][1] if j + 1 < len(p) else None)
        want = {x: (order[i - 1] if i or wrap else None, order[(i + 1) % n] if i + 1 < n or wrap else None) for i, x in enumerate(order)}
        assert seen == want


@pytest.mark.parametrize("bits", [1 << 29, 1 << 15])
def test_filter_passes_all_that_are_in(spark, bits, monkeypatch):
    monkeypatch.setattr(common, "MOST_FILTER_BITS", bits)
    df = spark.range(0, 200_000).selectExpr("id", "id AS __x").union(spark.createDataFrame([(None, 1)], "id long, __x long"))
    ids = spark.range(0, 200_000, 40).selectExpr("id AS one")
    got = common.may_be_in(df, "id", ids)
    assert got.columns == ["id", "__x", "__may"] and got.count() == 200_001
    assert got.where("id % 40 = 0 and not __may").count() == 0 and got.where("id is null and __may").count() == 0
    assert got.where("id % 40 > 0 and __may").count() < (0.1 if bits > 1 << 20 else 0.25) * 195_000
    assert common.may_be_in(df, "id", ids.where("false")).where("__may").count() == 0


def test_limits_hold_at_any_count():
    for n in (10**3, 10**7, 10**10, 10**13):
        limit = linear.hash_limit(2000, n)
        assert limit is None if n <= 2000 else abs((limit + 2**63) / 2**64 * n - 2000) < 1e-3 * 2000


def test_samples_are_bounded_and_lose_no_label(spark):
    ids = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 1000 = 0, 'rare', 'often') AS lang").union(spark.createDataFrame([(5, "often")] * 3000 + [(None, "often"), (1, None)], "doc_id long, lang string"))
    docs = ids.selectExpr("doc_id", "lang", "concat('text ', doc_id) AS text")
    got = linear.sample(ids, docs, "lang", 40)
    assert Counter(y for _, y in got) == {"rare": 30, "often": 40} and len(set(got)) == 70
    assert got == linear.sample(ids.repartition(9), docs.repartition(3), "lang", 40)
    # counts as of a hundred billion rows: a limit remains, and what passes it is ranked
    chosen = linear.bounded_ids(spark.range(3_000_000).selectExpr("id AS doc_id", "'often' AS lang"), "lang", 40, "doc_id", {"often": 10**11 // 2**10})
    assert chosen.count() <= 40
    with pytest.raises(ValueError):
        linear.sample(ids, docs.where("lang <> 'rare'"), "lang", 40)
    assert [len(t) for t, _ in linear.sample(ids, docs, "lang", 40, most_bytes=1)] and len(linear.sample(ids, docs, "lang", 40, most_bytes=1)) == 2


def test_shared_folder_is_asked_for_on_a_cluster():
    class Fake:
        def __init__(self, master):
            self.sparkContext = type("C", (), {"master": master})
            self.conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    assert common.shared_dir(Fake("local[4]")).startswith("file:")
    for master in ("local-cluster[2,1,1024]", "spark://h:7077", "yarn"):
        with pytest.raises(ValueError):
            common.shared_dir(Fake(master))


# 1 toxicity


def _labelled(n=160):
    r = random.Random(3)
    plain = "the of and to in is that it was for on are with as be at one have this from".split()
    texts, toxic = [], []
    for i in range(n):
        w = r.choices(plain, k=40)
        if i % 4 == 0:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["zorgoth", "zorgling", "idiot", "scum"]))
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    return texts, toxic


def test_toxicity_learns_what_no_lexicon_has():
    texts, toxic = _labelled()
    model = toxicity.train(texts[:120], toxic[:120])
    got = model.score(texts[120:]) >= 0.5
    assert (got == np.array(toxic[120:], bool)).mean() > 0.95
    assert model.score(["a zorgothian zorgoth zorgling of it"])[0] > model.score(["a quiet day of it"])[0]
    assert (toxicity.train(texts[::-1], toxic[::-1]).score(texts) == toxicity.train(texts, toxic).score(texts)).all()


def test_label_model_finds_the_better_voter():
    r = np.random.default_rng(0)
    y = r.random(2000) < 0.3
    vote = lambda right: np.where(r.random(2000) < right, y, ~y).astype(int)
    good, bad = vote(0.95), vote(0.6)
    model = toxicity.label_model(np.stack([good, vote(0.9), bad, bad], axis=1), 0.2 + 0.6 * good)
    assert model.accuracy[1, 0, 1] > model.accuracy[1, 2, 1] + 0.2
    assert model.weight[2] < model.weight[0] and model.correlation[2, 3] > 0.99  # two copies count as about one
    assert ((model.posterior(np.stack([good, vote(0.9), bad, bad], axis=1)) > 0.5) == y).mean() > 0.9


def test_hashes_agree_with_the_scalar_ones():
    h, who, n = toxicity.terms_of(["Idiot, idi x" + "y" * 100, ""])
    assert toxicity.term_hash("idiot", False) in h and toxicity.term_hash("idi", True) in h and toxicity.term_hash("x" + "y" * 100, False) in h
    assert n.tolist() == [3, 0]


def test_toxicity_edges(spark):
    texts, toxic = _labelled()
    model = toxicity.train(texts, toxic)
    got = toxicity.score(docs(spark, EDGE), model).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.text in (None, "", " \n\t")}) == 1
    for few in (([], []), (["a"], [1])):
        assert len(toxicity.train(*few).score(["x", None])) == 2
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_toxicity_query_never_learns_from_held_out_rows(spark, sf):
    got = queries.op1_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = [(r.score, labels[r.doc_id]) for r in got if r.doc_id in labels and not r.held_out]
    assert np.mean([s for s, y in seen if y]) > np.mean([s for s, y in seen if not y])


def test_toxicity_scores_by_brute_force(spark, sf):
    """Every score of the query from term counts and sums spelled out, given the trained weights."""
    frame = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(frame, spark.read.parquet(f"{sf}/labels.parquet"), where=~common.held_out())
    place = {int(h): i for i, h in enumerate(model.known)}
    got = {r.doc_id: (r.score, r.predicted) for r in queries.op1_toxicity(spark, sf).collect()}
    for r in frame.collect():
        found, n = Counter(), 0
        for w in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (r.text or "").lower())):
            n += 1
            found[place.get(toxicity.term_hash(w, False))] += 1
            for k in range(3, min(8, len(w)) + 1):
                found[place.get(toxicity.term_hash(w[:k], True))] += 1
        del found[None]
        z = model.bias + sum(model.weights[i] * math.log(1 + k) for i, k in found.items()) + model.weights[-1] * math.log(1 + 100 * sum(found.values()) / max(n, 1))
        score = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert got[r.doc_id][0] == pytest.approx(score, rel=1e-5, abs=1e-9) and got[r.doc_id][1] == int(got[r.doc_id][0] >= 0.5)


def test_posteriors_by_brute_force():
    r = np.random.default_rng(5)
    y = r.random(300) < 0.4
    ballot = np.stack([np.where(r.random(300) < 0.2, -1, np.where(r.random(300) < right, y, ~y)) for right in (0.9, 0.8, 0.7)], axis=1)
    model = toxicity.label_model(ballot, 0.25 + 0.5 * (ballot[:, 0] == 1))
    for row, got in zip(ballot[:60], model.posterior(ballot)):
        chance = [1 - model.prior, model.prior]
        for k in (0, 1):
            for v, said in enumerate(row):
                chance[k] *= model.accuracy[k, v, 2 if said < 0 else said] ** model.weight[v]
        assert got == pytest.approx(chance[1] / sum(chance))
    # a round of expectation and maximisation leaves the estimates where they are
    q = model.posterior(ballot)
    again = [(q @ (ballot[:, v] == s) + 0.5) / (q.sum() + 1.5) for v in range(3) for s in (0, 1)]
    assert again == pytest.approx([model.accuracy[1, v, s] for v in range(3) for s in (0, 1)], abs=0.01)


# 2 SimHash


def _fingerprint(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _near_texts(n=120):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    out = list(EDGE)
    for _ in range(n // 6):
        base = r.choices(vocabulary, k=200)
        for k in range(6):
            w = list(base)
            for _ in range(k // 2):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
    return out


def test_simhash_classes(spark):
    texts = _near_texts()
    ids = [3 * i + 7 for i in range(len(texts))]
    fps = [_fingerprint(t) for t in texts]
    best = list(ids)
    for _ in range(len(texts)):
        before = list(best)
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    best[i] = min(best[i], best[j])
        if best == before:
            break
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.simhash_classes(docs(spark, texts, ids=ids)).collect()}
    assert got == {i: (f, c) for i, f, c in zip(ids, fps, best)}


@pytest.mark.parametrize("seed", range(4))
def test_links_connect_what_brute_force_connects(spark, seed, monkeypatch):
    if seed % 2:  # words of more than five fingerprints are split
        monkeypatch.setattr(simhash, "HOT", 5)
        monkeypatch.setattr(simhash, "HOT_SAMPLE", 1)
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(12)]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(30):
            f = c
            for b in r.sample(range(64), r.randrange(6)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    rows = [(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "id long, fp long")
    group = list(range(len(fps)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    mine = {r.node: r.component for r in graph.connected_components(simhash.fingerprint_links(nodes)).collect()}
    assert mine == {i: find(i) for i in range(len(fps)) if any(find(i) == find(j) for j in range(len(fps)) if j != i)}


def _near_classes(texts, ids):
    """Least id of each text's class, by comparing all pairs."""
    sets = [set(zip(*(words(t.translate(common.ASCII_LOWER) if t else t)[i:] for i in range(5)))) or tuple(words(t)) for t in texts]
    best, again = list(ids), True
    while again:
        again = False
        for i in range(len(texts)):
            for j in range(i):
                a, b = sets[i], sets[j]
                near = len(a & b) >= 0.8 * len(a | b) if isinstance(a, set) and isinstance(b, set) else a == b
                if near and best[i] != best[j]:
                    best[i] = best[j] = min(best[i], best[j])
                    again = True
    return dict(zip(ids, best))


def test_one_of_each(spark):
    texts = _near_texts()
    ids = [7 * i % 1009 for i in range(len(texts))]
    kept = simhash.one_of_each(docs(spark, texts, ids=ids))
    assert kept.columns == docs(spark, []).columns
    want = _near_classes(texts, ids)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert {r.doc_id: r.component_id for r in simhash.near_copy_classes(docs(spark, texts, ids=ids)).collect()} == want
    assert simhash.one_of_each(docs(spark, [])).count() == 0
    assert simhash.one_of_each(docs(spark, ["a", "b"], ids=[None, 1])).count() == 2


@pytest.mark.parametrize("block", [1_000_000, 6000])
def test_large_groups_are_met_without_all_pairs(spark, monkeypatch, block):
    """A star of near copies, a chain whose ends share little, and texts that meet the others without being copies."""
    r = random.Random(17)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    texts = []
    for _ in range(160):
        w = list(base)
        w[r.randrange(150)] = f"x{r.randrange(9999)}"
        texts.append(" ".join(w))
    chain = list(base)
    for i in range(40):  # each step changes three words
        for k in range(3):
            chain[(3 * i + k) % 150] = f"y{i}-{k}"
        texts.append(" ".join(chain))
    for _ in range(20):  # a fourth of the words new: below the bound
        w = list(base)
        at = r.randrange(110)
        w[at : at + 38] = [f"z{r.randrange(9999)}" for _ in range(38)]
        texts.append(" ".join(w))
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[i] for i in order]
    monkeypatch.setattr(simhash, "BLOCK", block)
    made = []
    monkeypatch.setattr(simhash, "_near_copies", lambda pairs, sets, f=simhash._near_copies: (made.append(pairs.count()), f(pairs, sets))[1])
    got = {x.doc_id: x.component_id for x in simhash.near_copy_classes(docs(spark, texts)).collect()}
    assert got == _near_classes(texts, list(range(len(texts))))
    assert len(made) == 1 and made[0] < len(texts)


def _share(a, b):
    a, b = (set(zip(*(words(t)[i:] for i in range(5)))) for t in (a, b))
    return len(a & b) / len(a | b)


def test_block_edited_copies_go_and_lesser_ones_stay(spark):
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    pairs = []
    for k in range(120):
        w = fresh(200)
        n = 42 if k < 60 else 70  # words in the block: shares of 0.82 and of 0.74 and less
        pairs.append((" ".join(w), " ".join([w + fresh(n), w[: -(n * 4 // 5)], w[:60] + fresh(n // 2 - 4) + w[60 + n // 2 - 4 :]][k % 3])))
    for j in range(20):  # scattered edits far below the bound
        w = fresh(200)
        pairs.append((" ".join(w), " ".join(x if i % 18 else "other" for i, x in enumerate(w))))
    left = {x.doc_id for x in simhash.one_of_each(docs(spark, [t for p in pairs for t in p])).collect()}
    near = [_share(*p) >= 0.8 for p in pairs]
    assert 60 <= sum(near) < 100
    assert left == {2 * i for i in range(len(pairs))} | {2 * i + 1 for i, n in enumerate(near) if not n}


def test_copy_fingerprint():
    r = random.Random(3)
    for n in (4, 5, 255, 256, 4081):
        h = np.array([r.getrandbits(64) for _ in range(n)], dtype=np.uint64)
        mixed = [[int(x) for x in w] for w in simhash._mixed(h)]
        want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in w) > n) for w in mixed]
        assert simhash.copy_fingerprint(h).tolist() == want


@pytest.mark.parametrize("split", [False, True])
def test_copy_links_connect_what_brute_force_connects(spark, monkeypatch, split):
    """Fingerprints around some centres, and pairs of 31 differing bits, which are always met."""
    if split:  # words of more than five entries go to pairs of blocks
        for name, value in (("COPY_HOT", 5), ("HOT_SAMPLE", 1), ("COPY_GROUP", 8), ("COPY_CHUNK", 20)):
            monkeypatch.setattr(simhash, name, value)
    r = random.Random(8)
    fps = []
    for k in range(12):
        centre = r.getrandbits(192)
        fps += [centre] + [centre ^ sum(1 << b for b in r.sample(range(192), 31 if k < 6 else r.randrange(1, 16))) for _ in range(1 if k < 6 else 12)]
    group = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 48:
                    group[i] = group[j] = min(group[i], group[j])
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    rows = [(i, [signed(f >> 64 * w & 2**64 - 1) for w in range(3)]) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "id long, fp array<long>")
    got = {x.node: x.component for x in graph.connected_components(simhash.copy_links(nodes)).collect()}
    assert got == dict(enumerate(group))


@pytest.mark.parametrize("split", [1, 3])
@pytest.mark.parametrize("n, large", [(150, 4096), (300, 4096), (300, 8)])
def test_copy_links_are_not_made_anew_under_each_word(monkeypatch, n, large, split):
    """What leaves the tasks follows the size of a group, not the words or pairs of blocks that its pairs meet under."""
    monkeypatch.setattr(simhash, "COPY_GROUP", large)
    r = random.Random(n)
    flip = lambda x, k: x ^ sum(1 << b for b in r.sample(range(192), k))
    centre = r.getrandbits(192)
    near = [flip(centre, r.randrange(1, 20)) for _ in range(n)]
    fps = near + [flip(x, 26) for x in near[:20]] + [r.getrandbits(192) for _ in range(30)]
    words_of = np.array([[f >> 64 * w & 2**64 - 1 for w in range(3)] for f in fps], dtype=np.uint64)
    ids = np.arange(len(fps), dtype=np.int64)
    block = ids % split
    key, row = simhash._entries(words_of)
    links = []
    for k in np.unique(key):
        here = np.sort(row[key == k])
        for i in range(split):
            for j in range(i, split):
                at = here[(block[here] == i) | (block[here] == j)]
                a, b = simhash._met(int(k), ids[at], words_of[at], *([block[at]] if i < j else []))
                assert all((fps[x] ^ fps[y]).bit_count() <= simhash.COPY_BITS for x, y in zip(a, b))
                links += zip(a, b)

    def groups(pairs):
        group = list(range(len(fps)))
        for x, y in pairs:
            if group[x] != group[y]:
                lo, hi = sorted((group[x], group[y]))
                group = [lo if g == hi else g for g in group]
        return group

    seg = simhash._segments(words_of)
    every = [(x, y) for y in range(len(fps)) for x in range(y) if (fps[x] ^ fps[y]).bit_count() <= simhash.COPY_BITS and (np.bitwise_count(seg[x] ^ seg[y]) <= 1).any()]
    assert groups(links) == groups(every)
    assert len(links) < 3 * len(fps)


def test_near_copies_come_from_fingerprints(spark, monkeypatch):
    """The pipeline's candidates are what multi-index hashing of SimHash fingerprints finds, and nothing beside it."""
    w = [f"w{i}" for i in range(100)]
    texts = docs(spark, [" ".join(w), " ".join(w[:-3])])
    assert simhash.one_of_each(texts).count() == 1
    monkeypatch.setattr(simhash, "copy_links", lambda nodes, f=simhash.copy_links: f(nodes).where("false"))
    assert simhash.one_of_each(texts).count() == 2


# 3 SentencePiece


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepieces.load()


@pytest.fixture(scope="module")
def coder(vocabulary):
    return sentencepieces.Coder(vocabulary)


PARTS = ["a", "b", "the", " ", "  ", "\n", "é", "日本", "\t", "ing", "😀", "▁", "0", "==", "---", "     ", "function", "\r\n", "ß", "The", "XXX", "."]


def test_bpe_ids_are_the_librarys(coder):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.DEFAULT_MODEL)
    r = random.Random(1)
    for text in [*(t for t in EDGE if t), *("".join(r.choices(PARTS, k=r.randrange(40))) for _ in range(1500))]:
        assert coder.encode(text) == library.encode(text), text
        assert "▁" in text or coder.decode(coder.encode(text)) == text


def test_unigram_path_is_the_best_one(vocabulary):
    pieces = ("<unk>", "▁", "a", "b", "ab", "▁a", "ba", "bab", "▁ab")
    v = sentencepieces.Vocabulary(pieces, (0.0, -2.0, -3.0, -3.1, -4.0, -4.2, -3.9, -5.5, -4.9), (2, *[1] * 8), sentencepieces.UNIGRAM, True)
    c = sentencepieces.Coder(v)

    def brute(text):
        best = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            arcs = [(best[s][0] + v.scores[c.ids[text[s:end]]], [*best[s][1], text[s:end]]) for s in range(end) if text[s:end] in c.ids]
            arcs.append((best[end - 1][0] + c.unknown_score, [*best[end - 1][1], text[end - 1]]))
            best[end] = max(arcs, key=lambda x: x[0])
        return best[len(text)]

    r = random.Random(2)
    for _ in range(500):
        text = "".join(r.choices("ab ab ?", k=r.randrange(1, 12)))
        marked = (" " + text).replace(" ", "▁")
        got = c.path(marked)
        spelled, at = [], 0
        for i in got:
            spelled.append(pieces[i] if i >= 0 else marked[at])
            at += len(spelled[-1])
        score = sum(v.scores[i] if i >= 0 else c.unknown_score for i in got)
        assert "".join(spelled) == marked and abs(score - brute(marked)[0]) < 1e-9


def test_sentencepiece_frames(spark, vocabulary):
    got = sentencepieces.decode(sentencepieces.encode(docs(spark, EDGE), vocabulary), vocabulary).collect()
    assert all(r.decoded == (r.text or "") and r.n_tokens == len(r.ids) for r in got)
    assert sentencepieces.encode(docs(spark, []), vocabulary).count() == 0


# 4 quality


def _counts(text):
    text = text or ""
    w, lines = words(text), text.split("\n")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    dup = sum(bool(words(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts():
    r = random.Random(4)
    texts = [t for t in EDGE if t != LONG] + ["".join(r.choices(["a ", "b ", "c\n", "\n", "#", "| "], k=r.randrange(60))) for _ in range(300)] + ["x y z " * 30]
    for t in texts:
        assert quality.counts(t) == _counts(t), t


@pytest.fixture(scope="module")
def crf():
    good = ["The first line says something plain.\nThe second line says a little more than that."] * 6
    bad = ["BUY!! NOW!! $$$ ### %%%\nBUY!! NOW!! $$$ ### %%%\n| a | b | c | d |\nAll rights reserved."] * 6
    return quality.train(good + bad, [1] * 6 + [0] * 6)


def test_viterbi_finds_the_best_path(crf):
    r = random.Random(6)
    for _ in range(50):
        lines, w = quality.split_lines("\n".join(r.choice(["A plain line of words.", "$$$ ### !!", "| a | b |", "licensed under"]) for _ in range(r.randrange(1, 8))))
        score = quality.line_features(lines, w) @ crf.unary
        best = max(
            (sum(score[i, y >> i & 1] for i in range(len(lines))) + sum(crf.step[y >> i & 1, y >> i + 1 & 1] for i in range(len(lines) - 1)), y) for y in range(1 << len(lines))
        )[0]
        y = crf.labels(lines, w)
        assert abs(sum(score[i, k] for i, k in enumerate(y)) + sum(crf.step[a, b] for a, b in zip(y, y[1:])) - best) < 1e-9


def test_gradient_of_the_crf():
    r = np.random.default_rng(1)
    xs, ys, size = r.random((2, 4, len(quality.FEATURES))), r.integers(0, 2, (2, 4)), np.array([4, 2])
    unary, step = r.normal(size=(len(quality.FEATURES), 2)), r.normal(size=(2, 2))

    def value(u, s):
        total = 0.0
        for x, y, n in zip(xs, ys, size):
            f = x[:n] @ u
            path = lambda p: sum(f[i, k] for i, k in enumerate(p)) + sum(s[a, b] for a, b in zip(p, p[1:]))
            total += path(y[:n]) - np.logaddexp.reduce([path([k >> i & 1 for i in range(n)]) for k in range(1 << n)])
        return total / size.sum()

    g_unary, g_step = quality._log_likelihood(xs, ys, size, unary, step)
    for param, g in ((unary, g_unary), (step, g_step)):
        for i in np.ndindex(param.shape):
            param[i] += 1e-5
            up = value(unary, step)
            param[i] -= 2e-5
            down = value(unary, step)
            param[i] += 1e-5
            assert abs((up - down) / 2e-5 - g[i]) < 1e-4


def test_quality_verdicts(spark, crf):
    clean = "Here is a line that holds some ordinary words.\nAnd another one that holds a few more of them."
    junk = "\n".join(f"BUY!! {i} $$$ ### %%% && {i}" for i in range(20))
    got = {r.doc_id: r for r in quality.judge(docs(spark, [clean, junk, *EDGE]), crf).collect()}
    assert got[0].kept and not got[1].kept and not got[1].base_failed and not got[2].kept and got[2].base_failed
    assert got[6].base_failed and got[6].n_words == 20_000
    assert quality.judge(docs(spark, []), crf).count() == 0 and quality.train([], []).labels(["x"], [["x"]]) == [0]


# 5 language


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 6, 20):
        code = langid.codewords(k)
        apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(apart) >= (code.shape[1] / 2 if k <= 5 else 0.2 * code.shape[1])


TEXTS = {"en": "the cat sat on the mat and then it went away with the others ", "de": "die Katze saß auf der Matte und dann ging sie mit den anderen weg ", "fr": "le chat était assis sur le tapis et puis il est parti avec les autres "}


def test_language(spark):
    texts = [t * k for t in TEXTS.values() for k in (1, 3, 9)]
    model = langid.train(texts, [x for x in TEXTS for _ in range(3)])
    got = langid.identify(docs(spark, [*TEXTS.values(), *EDGE, "123 ?!"]), model).collect()
    assert [r.lang_pred for r in got[:3]] == list(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in got if not any(c.isalpha() for c in r.text or "")] == ["und"] * 4
    assert all(r.lang_pred in TEXTS for r in got if any(c.isalpha() for c in r.text or ""))
    alone = model.predict(["der die das"])
    assert model.predict(["x", "der die das", ""])[0][1] == alone[0][0] and model.predict(["x", "der die das"])[1][1] == pytest.approx(alone[1][0])
    assert langid.train([], []).predict(["x"])[0] == ["und"] and langid.train(["aa"], ["q"]).predict(["b"])[0] == ["q"]
    assert langid.identify(docs(spark, []), model).count() == 0


def _naive_ngrams(text):
    """Counts by slot of the n-grams of one to three characters, one after the other."""
    m, chars = 2**64 - 1, [0]
    for c in text.lower():
        if c.isalpha() or chars[-1]:
            chars.append(ord(c) if c.isalpha() else 0)
    if chars[-1]:
        chars.append(0)
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            if chars[i] or chars[i + n - 1]:
                h = 0
                for c in chars[i : i + n]:
                    h = h * 0x9E3779B97F4A7C15 + c + 1 & m
                out[(h * 0xD6E8FEB86659FD93 & m) >> 51] += 1
    return out


def test_language_by_brute_force(spark, sf):
    """Every answer of the query from n-gram counts and decoding spelled out, given the trained weights."""
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(frame, where=~common.held_out())
    got = {r.doc_id: r for r in queries.op5_language(spark, sf).collect()}
    for r in frame.collect():
        x = got[r.doc_id]
        if not any(c.isalpha() for c in r.text or ""):
            assert (x.lang_pred, x.score, x.ambiguous) == ("und", 0, True)
            continue
        n = _naive_ngrams(r.text)
        margin = [sum(k / n.total() * float(model.weights[i, b]) for i, k in n.items()) + float(model.bias[b]) for b in range(model.code.shape[1])]
        loss = [sum(math.log(1 + math.exp(-g * c)) for g, c in zip(margin, word)) for word in model.code.tolist()]
        low = sorted(loss)
        assert x.lang_pred == model.langs[loss.index(low[0])] or low[1] - low[0] < 1e-3
        assert x.score == pytest.approx(1 / sum(math.exp(low[0] - v) for v in loss), abs=1e-3)
        assert x.ambiguous == (low[1] - low[0] < langid.MARGIN) or abs(low[1] - low[0] - langid.MARGIN) < 1e-3


# 6 mixing


@pytest.mark.parametrize("n,few", [(0, 50_000), (1, 50_000), (3, 50_000), (400, 50_000), (399, 1)])
def test_mix(spark, duck, same, n, few, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", few)  # 1: parts are cut until a document is alone
    r = random.Random(n)
    texts = [None if i % 50 == 3 else "w " * r.randrange(40) for i in range(n)]
    sources = [r.choice(["a", "a", "a", "b", "c", "Z", None]) for _ in range(n)]
    df = docs(spark, texts, sources)
    got = mixing.mix(df)
    import duckdb

    c = duckdb.connect()
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(texts, sources))]
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    same(got, c, mixing.MIX_SQL)
    for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.count("*").alias("k"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert r.over <= 0


def test_targets_by_water_filling(spark):
    r = random.Random(9)
    for _ in range(4):
        sizes = [(f"s{i:02}", r.randrange(1, 1000)) for i in range(r.randrange(1, 9))]
        got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        budget = 1.5 * sum(n for _, n in sizes)
        weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(sizes)}
        full, left = {}, dict(sizes)
        while left:
            each = (budget - sum(full.values())) / sum(weight[s] for s in left)
            over = [s for s in left if each * weight[s] > 2 * left[s]]
            if not over:
                full |= {s: each * weight[s] for s in left}
                break
            for s in over:
                full[s] = 2.0 * left.pop(s)
        assert got == pytest.approx(full)


def test_repeated_rows_share_the_cut(spark):
    got = mixing.mix(docs(spark, ["a b c d"] * 6 + ["x " * 100], ["a"] * 6 + ["b"], [1] * 6 + [2])).collect()
    by = Counter()
    for r in got:
        by[r.target] += r.taken
    assert all(t - 6 <= n <= t for t, n in by.items())


def test_mixed_documents(spark):
    df = docs(spark, ["a b"] * 40 + [None], ["x"] * 20 + ["y"] * 20 + ["x"])
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    n = Counter(r.doc_id for r in got.collect())
    assert set(n.values()) <= {1, 2} and 55 <= sum(n.values()) <= 63 and n[40] == 1


# 7 WARC


def test_warc(spark, duck, same):
    big = "<p>" + "x" * 2000
    pages = [(i, f"http://h/{i} a\r\nb", h) for i, h in enumerate([big, big, "small", "small", None, "", "é" * 600, big, "é" * 600, LONG])] + [(None, None, "n" * 1500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages[:-1])
    same(warc.round_trip(df.where("page_id is not null")), c, queries.WARC_SQL)
    assert warc.round_trip(df).where("page_id is null and record_type = 'response'").count() == 1
    assert warc.round_trip(df.where("false")).count() == 0
    ties = spark.createDataFrame([(5, "u", big), (5, "v", big), (4, "w", big)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(ties).collect()) == [(4, "revisit", 5), (5, "response", None), (5, "response", None)]


def test_normaliser_makes_members_and_an_index():
    made = [warc.page_record(i, f"http://h/{i}", bytes([65 + i]) * (i * 70_000), None, "2024-01-01T00:00:00Z") for i in range(5)]
    whole = b"".join(r.to_bytes() for r in made)
    out, index = io.BytesIO(), io.BytesIO()
    for source in (gzip.compress(whole), b"".join(gzip.compress(whole[i : i + 999]) for i in range(0, len(whole), 999))):
        out, index = io.BytesIO(), io.BytesIO()
        assert warc.normalise_stream(io.BytesIO(source), out, index) == 5
        data = out.getvalue()
        for line, r in zip(index.getvalue().decode().splitlines(), made):
            at, size, kind, name = line.split("\t")
            assert gzip.decompress(data[int(at) : int(at) + int(size)]) == r.to_bytes() and name == r.get("warc-record-id")
        assert gzip.decompress(data) == whole
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(whole)[:-20])))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(whole[:-80]))))


# 8 fingerprints


def _naive_pieces(line, at, text):
    """Pieces of a line that begins at an offset of the text, by the rolling hash spelled out."""
    bits = lambda i: 3 if i < 32 else 4 if i < 128 else 5 if i < 1024 else 6 if i < 8192 else 7
    m = 2**64 - 1
    out, run = [], ""
    for i in range(at, at + len(line)):
        run += text[i]
        h = 0
        for c in text[max(0, i - 15) : i + 1]:
            h = h * 0x9E3779B97F4A7C15 + (ord(c) + 1) * 0xD6E8FEB86659FD93 & m
        h = (h ^ h >> 29) * 0xD6E8FEB86659FD93 & m
        start = i + 1 - len(run)
        if h >> 64 - bits(i) == 0 or len(run) == 4 << bits(start):
            out.append(run)
            run = ""
    return out + [run] * bool(run)


def _naive_tree(text):
    """(root, fingerprint, multiset of pieces)."""
    digest = lambda level, data: base64.urlsafe_b64encode(hashlib.blake2b(bytes([level]) + data.encode(), digest_size=16).digest()).decode()[:22]
    sections, blank, at = [], True, 0
    for line in text.split("\n") if text else []:
        if blank or re.match(r"#{1,6} |\d+(\.\d+)*\.? +[A-Z]", line):
            sections.append([])
        blank = not line.strip()
        sections[-1].append(_naive_pieces(line, at, text))
        at += len(line) + 1
    shown, tops = "", ""
    for s in sections:
        tops += digest(2, "".join(digest(1, "".join(digest(0, x) for x in p)) for p in s))
        shown += "/" + "".join("." + ",".join(f"{digest(0, x)}{len(x):x}" for x in p) for p in s)
    root = digest(3, tops)
    return root, root + shown, Counter(x for s in sections for p in s for x in p)


def _naive_likeness(a, b):
    size = lambda n: sum(len(x) * k for x, k in n.items())
    whole = size(a[2]) + size(b[2])
    return 1.0 if a[0] == b[0] else 2 * size(a[2] & b[2]) / whole if whole else 0.0


def test_merkle_pairs(spark):
    r = random.Random(12)
    prose = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon", "x", "é😀"]) + r.choice(["", "", ".", ",", "\n", "\n\n"]) for _ in range(n))
    texts = [*EDGE, *["A first sentence here. A second one.\nNext line.\n\n# Head\nmore text of it."] * 2, "\n", "ab", "abc", "z" * 700, *(prose(n) for n in (5, 40, 40, 300))]
    texts[4] = "long " * 2000
    ids = [5 * i for i in range(len(texts))]
    got = {x.doc_id: x for x in merkle.fingerprint_pairs(docs(spark, texts, ids=ids).repartition(5)).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        own, new, following, x = _naive_tree(t), _naive_tree(e), _naive_tree(n), got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (own[1], new[1])
        assert x.near_edited == pytest.approx(_naive_likeness(own, new)) and x.near_next == pytest.approx(_naive_likeness(own, following))
        assert str(merkle.parse(x.fingerprint)) == x.fingerprint
    with pytest.raises(ValueError):
        merkle.parse(got[0].fingerprint + "/." + "A" * 22 + "5")
    assert merkle.fingerprint_pairs(docs(spark, [])).count() == 0
    assert merkle.fingerprint_pairs(docs(spark, ["one."])).first().near_next == 1.0
    assert merkle.fingerprint_pairs(docs(spark, ["a", "b", "b"], ids=[None, 1, 1])).count() == 3
    hot = merkle.fingerprint_pairs(docs(spark, ["a"] * 300 + ["b"], ids=[7] * 300 + [8]).repartition(4)).collect()
    assert len(hot) == 301 and len({x.fingerprint for x in hot}) == 2


def test_the_edit_costs_few_pieces():
    r = random.Random(2)
    for n, least in ((60, 0.3), (400, 0.5), (3000, 0.6)):
        texts = ["".join(r.choices("abcdefghij klmnop", k=n)) for _ in range(40)]
        near = [merkle.likeness(merkle.tree(t), merkle.tree(merkle.edited(t, u))) for t, u in zip(texts, texts[1:])]
        assert np.mean(near) > least and max(near) < 0.75
        assert max(merkle.likeness(merkle.tree(t), merkle.tree(u)) for t, u in zip(texts, texts[1:])) < 0.2
    assert merkle.likeness(merkle.tree("same " * 900), merkle.tree("same " * 600 + "other " * 250)) > 0.5


def test_branches_locate_an_edit():
    lines = [f"Line number {i} says this and that." for i in range(30)]
    a = merkle.tree("\n".join(lines[:15]) + "\n\n" + "\n".join(lines[15:]))
    lines[20] = "Another line."
    b = merkle.tree("\n".join(lines[:15]) + "\n\n" + "\n".join(lines[15:]))
    assert merkle.differing(a, b) == [(1, 5)] and merkle.differing(a, a) == [] and 0.9 < merkle.likeness(a, b) < 1


# 9 secrets

SUM_OF_RATIOS = 8737020
KEY = "ghp_16C7e42F292c6912E7710c838347Ae178B4a"
SECRET = [
    None, "", LONG, 'token="abcdef1" password: x', "PASSWD = 'a/b+c=.-_' AKIA" + "Q" * 16 + " AKIAQ" , "é😀 " + "0a" * 12 + "f" * 5 + " and " + KEY, "api_key=api-key=secret:zzzzzzz", "token=token:abcdefgh",
    KEY + " " + "getElementsByClassNameAndMore /usr/local/lib/python3/site-packages 192.168.100.200.10.20 9807915762804490", "token = " + KEY, "x" * 50_000, "secret=abcdef," * 700,
]


def _spans(text, model):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    base = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    base += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    base += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    more = [(m.start(), 3, "markov", m.end()) for m in re.finditer(secret_scan.CANDIDATE, text) if model.is_secret(m.group()) and not any(b[0] < m.end() and m.start() < b[3] for b in base)]
    show = lambda v: ",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in sorted(v))
    return show(base), show(base + more)


def test_secrets(spark):
    model = secret_scan.default_model()
    got = {r.doc_id: r for r in secret_scan.scan(docs(spark, SECRET)).select("doc_id", secret_scan.joined("base_spans").alias("b"), secret_scan.joined("spans").alias("a")).collect()}
    for i, t in enumerate(SECRET):
        assert (got[i].b, got[i].a) == _spans(t, model), t and t[:60]
    assert got[5].a.endswith(f"markov:{len(SECRET[5]) - 40}:{len(SECRET[5])}") and got[8].a == "markov:0:40"
    assert secret_scan.scan(docs(spark, [])).count() == 0


def _all_spans(text, model):
    """What scan should find, with runs cut at base findings and searched for stretches."""
    base = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in _spans(text, model)[0].split(",") if x)]
    more = []
    for m in re.finditer(secret_scan.CANDIDATE, text or ""):
        at = m.start()
        for a, b in [(a, b) for a, _, b in sorted(base, key=lambda x: x[0]) if a < m.end() and m.start() < b] + [(m.end(), m.end())]:
            more += [(at + x, "markov", at + y) for x, y in model.stretches(text[at : max(at, a)])]
            at = max(at, b)
    order = {"assign": 0, "access": 1, "hex": 2, "markov": 3}
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(base + more, key=lambda x: (x[0], order[x[1]])))


def test_secrets_joined_to_other_text(spark):
    model, r = secret_scan.default_model(), random.Random(4)
    key = lambda n=32: "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=n))
    heads = ["https://hooks.example.com/services/incoming/webhook/", "DATABASE_CONNECTION_AUTH=", "/srv/www/static/assets/images/", "AKIA" + "Q7" * 8 + "/"]
    made = [(h, key(n), t) for h in heads for n in (24, 32, 40) for t in ("", "/settings/index.html")]
    texts = [f"see {h}{k}{t} now" for h, k, t in made]
    more = [f"é {heads[0]}{key()}/services/incoming/webhook/messages/{key()}.json", "0a" * 14 + "/" + key() + "=" + "1b" * 14, heads[0] * 40, "/usr/local/lib/python3/site-packages/" * 9, *(x for x in SECRET if x)]
    got = {x.doc_id: x for x in secret_scan.redact(secret_scan.scan(docs(spark, texts + more)).withColumn("found", secret_scan.joined("spans"))).collect()}
    for i, t in enumerate(texts + more):
        assert got[i].found == _all_spans(t, model), t[:90]
    gone = lambda k, text: not any(k[j : j + 3] in text for j in range(len(k) - 2))
    for i, (h, k, t) in enumerate(made):
        assert gone(k, got[i].text) and got[i].text.startswith("see ") and got[i].text.endswith(" now"), texts[i]
    n = len(texts)
    assert got[n].text.count("[SECRET]") == 2 and got[n].text.startswith("é https") and got[n].text.endswith(".json")
    assert got[n + 1].text.count("[SECRET]") >= 3 and got[n + 2].text == more[2] and got[n + 3].text == more[3]


def test_secret_models_tell_samples_apart():
    secrets, ordinary = secret_scan.labelled_samples(1500, 99)
    model = secret_scan.default_model()
    assert np.mean([model.is_secret(s) for s in secrets]) > 0.99
    assert not any(model.is_secret(s) for s in ordinary if len(s) >= secret_scan.LEAST)
    assert secret_scan.labelled_samples(1500, 99) == (secrets, ordinary) and sum(model.ratio) == SUM_OF_RATIOS  # the same anywhere


def test_redaction(spark):
    got = [r.text for r in secret_scan.redact(docs(spark, SECRET)).orderBy("doc_id").collect()]
    assert got[0] is None and got[1] == "" and got[3] == '[SECRET]" password: x' and KEY not in "".join(g or "" for g in got)
    assert got[11] == "[SECRET]," * 700 and got[10] == SECRET[10]


def test_secret_scan_is_native(spark):
    plan = secret_scan.scan(docs(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("LogicalRDD", "") and "Pandas" not in plan and "Arrow" not in plan


# 10 HTML


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<p>a<br>b &amp; c &lt;d&gt; &#233;", "a b & c <d> é"), ("<nav><ul><li>m</nav><div class='main-ad'>x</div><p>Hello <b>big</b>\n world<p>two<table><tr><td>a<td>b<tr><td>c</table>", "Hello big world\ntwo\na b\nc"),
        ("<div class=comments><article>bad</article></div><article><header><h1>T</h1></header>x<aside><article>no</article></aside></article>out", "T\nx"), ("<article><p><b>Les.<br></article><footer>f", "Les."),
        ("<script>var t='</p>';<b></script><p>x<style>p{}</style>y", "x y"), ("<form><p>in</form><main>m<div hidden>h</div><p role=navigation>n</main>", "m"), ("<a<a<a", "<a<a"), ("a < b <!-- c --> d", "a < b d"),
    ],
)
def test_main_text(page, text):
    lines = html_extract.lines_of(page)
    assert html_extract.main_text(lines, [False] * len(lines))[0] == text


@pytest.mark.parametrize("held", [32 << 20, 1])
def test_shared_is_a_longest_common_subsequence(held, monkeypatch):
    monkeypatch.setattr(html_extract, "HELD", held)
    r = random.Random(8)
    for _ in range(1500):
        letters = "abcdefgh"[: r.randrange(1, 9)]
        a, b = ([r.choice(letters) for _ in range(r.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = html_extract.shared(a, b)
        assert sum(got) == best[-1][-1]
        rest = iter(b)
        assert all(x in rest for x, s in zip(a, got) if s)
    assert html_extract.shared(["x", "a"], ["a", "x", "a"]) == [True, True]
    assert html_extract.shared(["Read more", "Terms"], ["Terms", "Story", "Read more", "Terms"]) == [True, True]


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p>one<select><option>x</article><p>two", "one"), ("<article>x <math>y=2</math> z</article>", "x y=2 z"), ("<article>a <object>b</object> <noscript>c</noscript><select><option>q</select>d</article>", "a b c\nd"),
        ("<article>a<svg><title>s</title></svg>b<svg>c", "a b c"), ("<article>a<script>b", "a"), ("<article>a</i></b></section><p>b</article>", "a\nb"),
    ],
)
def test_no_text_is_lost(page, text):
    lines = html_extract.lines_of(page)
    assert html_extract.main_text(lines, [False] * len(lines))[0] == text


def test_long_pages_take_linear_time():
    began = time.perf_counter()
    for page in ("<div>" * 40_000 + "</span>" * 40_000 + "x", "<svg>" * 40_000 + "x", "<p>same" * 40_000, "<a \"" * 20_000):
        html_extract.lines_of(page)
    lines = [str(i % 7) for i in range(20_000)]
    html_extract.shared(lines, lines[3:] + ["1"] * 5000)
    assert time.perf_counter() - began < 20


def test_pairs_are_the_nearest_by_path(spark):
    """Against a pairing by brute force: pages without an article lose the lines that their nearest page has, too."""
    r = random.Random(3)
    pages = []
    for i in range(90):
        url = f"http://h{r.randrange(3)}/" + "/".join(r.choice(["a", "b", "news"]) for _ in range(r.randrange(4))) + (f"/{i}" if i % 9 else "")
        pages.append((i, url, "".join(f"<p>{r.choice('abcdefghij')}" for _ in range(r.randrange(9)))))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {x.page_id: x for x in html_extract.extract(df.repartition(6)).collect()}
    split = lambda u: (u.split("/")[2], u[len("http://h0") :])
    order = sorted(pages, key=lambda p: (*split(p[1]), p[0]))
    for k, (i, u, h) in enumerate(order):
        host, path = split(u)
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and split(order[j][1])[0] == host]
        alike = lambda p: len(os.path.commonprefix([split(p[1])[1], path]))
        best = next((p for p in near if alike(p) == max(map(alike, near))), None)
        lines, other = ([x for x in p.split("<p>") if x] for p in (h, best[2] if best else ""))
        assert got[i].n_shared == sum(html_extract.shared(lines, other)) and got[i].n_elements == got[i].n_kept == 0
        assert got[i].text == "\n".join(x for x, s in zip(lines, html_extract.shared(lines, other)) if not s)


def test_extraction(spark):
    site = lambda i, body: f"<html><body><div>Site name</div><div>{body}</div><div>Imprint and terms</div></body></html>"
    pages = [(i, f"http://Host.example/a/{i:02}?q=1", site(i, f"own text {i}")) for i in range(20)] + [(100, "http://alone.example/", site(0, "alone")), (101, None, site(0, "nowhere")), (102, "http://Host.example/b", None), (103, "http://h2/x", "<article>kept</article>"), (104, "http://h2/y", "<article>kept</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extract(df.repartition(5)).collect()}
    assert len(got) == len(pages) and all(got[i].text == f"own text {i}" and got[i].n_shared == 2 for i in range(20))
    assert got[100].text == got[101].text.replace("nowhere", "alone") == "Site name\nalone\nImprint and terms"
    assert got[102].text == "" and got[103].text == got[104].text == "kept" and all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract(df.where("false")).count() == 0
    twice = html_extract.extract(df.where("page_id = 0").union(df.where("page_id = 0")))
    assert twice.count() == 2


# all


def test_queries_and_their_sql(spark, sf, duck, same):
    for name, sql in queries.ORACLES.items():
        same(queries.QUERIES[name](spark, sf), duck, sql)
    assert [re.match(r"op(\d+)_", n).group(1) for n in queries.QUERIES] == [str(i) for i in range(1, 11)]


@pytest.mark.parametrize("name", ["op2_simhash", "op3_sentencepiece", "op4_quality", "op5_language", "op8_merkle", "op9_secrets", "op10_html"])
def test_queries_return_every_row(name, spark, sf):
    key, table = ("page_id", "pages") if name == "op10_html" else ("doc_id", "documents")
    want = sorted(r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in queries.QUERIES[name](spark, sf).select(key).collect()) == want


CLASHES = "target epochs source_size cut_key cut_rest cut_size size key row times taken source_key part digest id component lang_pred ambiguous score base_spans spans found held_out __text a.b".split()


@pytest.mark.parametrize("stage", range(4))
def test_stages_pass_any_column_through(spark, sf, stage):
    import corpus_pipeline

    made = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(["one text of words", "one text of words", None, "", "another text here"])] + [(4, "another text here", "en", None, 17)], "doc_id long, text string, lang string, source string, n_chars long")
    wide = made.select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASHES))
    got = corpus_pipeline.STAGES[stage][1](spark, wide, sf)
    assert got.columns == wide.columns
    rows = got.collect()
    assert rows and all(r[c] == f"mine {c}" for r in rows for c in CLASHES)
    plain = corpus_pipeline.STAGES[stage][1](spark, made, sf)
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.select(*made.columns).collect()))


def test_clashing_columns_are_replaced(spark):
    got = common.map_rows(docs(spark, ["x"]), lambda t: [[1.5]], ["text"], [T.StructField("score", T.DoubleType())])
    assert got.columns.count("score") == 1 and got.first().score == 1.5
