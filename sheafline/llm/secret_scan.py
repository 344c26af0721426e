"""Secret scans with character Markov models (operator 9), in DataFrame functions alone.

Three patterns give the base findings.  Beside them every run of 20 and more key characters is compared under two Markov
models of character pairs, one of random strings and one of ordinary identifiers; runs whose log-likelihood ratio passes
the threshold, in total and for each pair, and that have some variety, are found as `markov`.  Base findings are cut out of
a run, what stands before and after them being runs of their own.  In a run that fails as a whole, as where a path leads to
a secret, the stretches that stand out are found, widened to whole words of letters and digits.  The models are counted from labelled samples; those
given here are random strings of a fixed generator, and identifiers, paths and numbers.
"""

from __future__ import annotations

import json
import math
import random
import string
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, and which group's length must reach what.
BASE = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 2, 6, r"(?i)password|passwd|secret|token|api_?key"),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    ("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_.=-"
WORD = string.ascii_letters + string.digits
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}"
#: Log-likelihood ratio (nats) asked for in total and for each character pair.
TOTAL, EACH = 12.0, 0.6
#: Rules and fillers, of few different characters, are no secrets however rare their pairs are in names.
DIFFERENT = 8
#: A stretch ends where its sum beyond EACH has fallen by DROP (nats) from its height.
DROP = 12.0


@dataclass(frozen=True)
class Model:
    """ratio[a * size + b]: thousandths of a nat by which the pair (a, b) of ALPHABET speaks for a random string."""

    ratio: tuple[int, ...]

    def score(self, token: str) -> int:
        at = [ALPHABET.index(c) for c in token]
        return sum(self.ratio[a * len(ALPHABET) + b] for a, b in zip(at, at[1:]))

    def is_secret(self, token: str) -> bool:
        got = self.score(token)
        return len(set(token)) >= DIFFERENT and got >= 1000 * TOTAL and got >= 1000 * EACH * (len(token) - 1)

    def stretches(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of the secrets in a run: the run itself, or the stretches in it that pass."""
        if len(run) < LEAST:
            return []
        if self.is_secret(run):
            return [(0, len(run))]
        each, drop = round(1000 * EACH), round(1000 * DROP)
        at = [ALPHABET.index(c) for c in run]
        rises, total, high, start, stop = [], 0, 0, 0, 0
        for i, (a, b) in enumerate(zip(at, at[1:])):
            total += self.ratio[a * len(ALPHABET) + b] - each
            if total > high:
                high, stop = total, i + 1
            if total <= 0 or high - total >= drop:
                rises.append((start, stop, high))
                total, high, start, stop = 0, 0, i + 1, i + 1
        rises.append((start, stop, high))
        out: list[tuple[int, int]] = []
        for start, stop, high in rises:
            if high + each * (stop - start) < 1000 * TOTAL:
                continue
            a, b = start, stop + 1
            while a and run[a - 1] in WORD:
                a -= 1
            while b < len(run) and run[b] in WORD:
                b += 1
            if b - a >= LEAST and len(set(run[a:b])) >= DIFFERENT:
                if out and a < out[-1][1]:
                    a, _ = out.pop()
                out.append((a, b))
        return out


def train(secrets: list[str], ordinary: list[str]) -> Model:
    """Pair counts of the two labelled samples, one added to each, as ratios; characters outside ALPHABET break a run."""
    size = len(ALPHABET)
    index = {c: i for i, c in enumerate(ALPHABET)}
    chance = []
    for sample in (secrets, ordinary):
        n = [[1.0] * size for _ in range(size)]
        for token in sample:
            for a, b in zip(token, token[1:]):
                if a in index and b in index:
                    n[index[a]][index[b]] += 1
        chance.append([[x / sum(row) for x in row] for row in n])
    return Model(tuple(round(1000 * math.log(p / q)) for s, o in zip(*chance) for p, q in zip(s, o)))


#: Words of which ordinary identifiers are made.
NAMES = (
    "abs access account action active add address admin agent all alpha api app archive arg array async attr auth back base batch begin beta binary bind block body bool buffer build byte cache call "
    "cell change char check child class clean client clock close code color column command commit common compare config connect content context control copy count create current cursor data date "
    "debug default define delete delta depth detail device digest dict direct disk display document domain double download draft driver edge element email empty enable encode end engine entry "
    "error event exception exec exit export extend factory failed field file filter final find first flag float flush folder font footer force form format frame from function gamma gateway get "
    "global graph group handle hash head height hidden history home host hour html icon image import index info init inner input insert instance int internal invoice item iterator job join journal"
).split()


def labelled_samples(n: int = 6000, seed: int = 7) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers): n strings over six alphabets; words of NAMES joined in the usual styles, host
    names and paths, and numbers, dates and addresses.  The same on every machine."""
    rng = random.Random(seed)
    kinds = (string.hexdigits[:16], string.hexdigits[:10] + "ABCDEF", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "_-")
    secrets = ["".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(20, 64))) for i in range(n)]
    ordinary = []
    for i in range(2 * n):
        parts = rng.choices(NAMES, k=rng.randint(2, 5))
        style = i % 6
        if style == 0:
            ordinary.append("_".join(parts).lower())
        elif style == 1:
            ordinary.append("".join(p.capitalize() for p in parts))
        elif style == 2:
            ordinary.append(".".join(parts).lower() + rng.choice(("", ".com", ".org", ".html", f".{rng.randint(0, 99)}")))
        elif style == 3:
            ordinary.append("/" + "/".join(parts).lower() + rng.choice(("", f"-{rng.randint(1, 9999)}")))
        elif style == 4:
            ordinary.append("-".join(str(rng.randint(0, 10 ** rng.randint(1, 12))) for _ in range(rng.randint(1, 4))))
        else:
            ordinary.append("".join(parts).lower() if i % 12 == 5 else ".".join(str(rng.randint(0, 255)) for _ in range(4)) + "_".join(parts).upper())
    return secrets, ordinary


@lru_cache(1)
def default_model() -> Model:
    return train(*labelled_samples())


def _prefix(a: str) -> str:
    """SQL: for each element of an array of longs, the sum of those before it."""
    return f"aggregate({a}, named_struct('out', cast(array() as array<bigint>), 'at', 0L), (s, x) -> named_struct('out', array_append(s.out, s.at), 'at', s.at + x), s -> s.out)"


def _starts(gap: str, size: str) -> str:
    """SQL: where each match starts, from the lengths of the gaps (one more than matches) and of the matches.

    Sums are made in runs of 256, so that many matches in one text cost no square of their number.
    """
    step = f"transform({size}, (x, i) -> x + {gap}[i])"
    runs = f"transform(sequence(0, (size({size}) - 1) div 256), c -> slice({step}, c * 256 + 1, 256))"
    ahead = _prefix(f"transform({runs}, r -> aggregate(r, 0L, (t, x) -> t + x))")
    # named once each, so that nothing is computed anew for every element
    return (
        f"element_at(transform(array(named_struct('runs', {runs}, 'ahead', {ahead})), "
        f"w -> flatten(transform(w.runs, (r, c) -> transform({_prefix('r')}, p -> p + w.ahead[c])))), 1)"
    )


def _found(df: DataFrame, text: str, kind: str, order: int, pattern: str, group: int, least: int, quick: str, with_text: bool = False) -> DataFrame:
    """df with __<kind>: spans (at, kind_no, kind, end), and with_text what is in them (val), of one kind, in order."""
    t, lit = f"`{text}`", F.lit(pattern)
    some = F.col(text).rlike(quick)
    none = "cast(array() as array<string>)"
    df = df.withColumn("__hit", F.when(some, F.regexp_extract_all(text, lit, F.lit(0))).otherwise(F.expr(none)))
    df = df.withColumn("__val", F.when(F.size("__hit") > 0, F.regexp_extract_all(text, lit, F.lit(group))).otherwise(F.expr(none)) if group else F.col("__hit"))
    df = df.withColumn("__gap", F.when(F.size("__hit") > 0, F.expr(f"transform(split({t}, {_quoted(pattern)}, -1), x -> cast(length(x) as bigint))")))
    df = df.withColumn("__len", F.expr("transform(__hit, x -> cast(length(x) as bigint))"))
    df = df.withColumn("__at", F.expr(f"if(size(__hit) > 0, {_starts('__gap', '__len')}, cast(array() as array<bigint>))"))
    span = f"'at', p + __gap[i], 'kind_no', {order}, 'kind', '{kind}', 'end', p + __gap[i] + __len[i]" + (", 'val', __val[i]" if with_text else "")
    spans = f"filter(transform(__at, (p, i) -> if(length(__val[i]) >= {least}, named_struct({span}), null)), x -> x is not null)"
    return df.withColumn(f"__{kind}", F.expr(spans)).drop("__hit", "__val", "__gap", "__len", "__at")


def _pieces() -> str:
    """SQL: (at, val) of what base_spans leave of the runs in __markov."""
    part = lambda start, *n: f"named_struct('at', {start}, 'val', substring(r.val, cast({start} - r.at + 1 as int){''.join(f', cast({x} as int)' for x in n)}))"
    left = (
        "aggregate(filter(base_spans, b -> b.at < r.end and r.at < b.end), named_struct('out', cast(array() as array<struct<at:bigint,val:string>>), 'from', r.at), "
        f"(s, b) -> named_struct('out', if(b.at > s.from, array_append(s.out, {part('s.from', 'b.at - s.from')}), s.out), 'from', greatest(s.from, b.end)), "
        f"s -> if(s.from < r.end, array_append(s.out, {part('s.from')}), s.out))"
    )
    return f"filter(flatten(transform(__markov, r -> {left})), p -> length(p.val) >= {LEAST})"


def _stretches(ratio: str) -> str:
    """SQL: the spans that Model.stretches finds in the pieces in __pieces."""
    size, each, least = len(ALPHABET), round(1000 * EACH), round(1000 * TOTAL)
    pair = f"{ratio}[(locate(a, '{ALPHABET}') - 1) * {size} + locate(b, '{ALPHABET}') - 1]"
    pairs = f"zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> cast({pair} as bigint))"
    scored = f"transform(__pieces, p -> element_at(transform(array(split(p.val, '')), c -> named_struct('at', p.at, 'val', p.val, 'kinds', size(array_distinct(c)), 'score', {pairs})), 1))"
    whole = f"q.kinds >= {DIFFERENT} and aggregate(q.score, 0L, (s, x) -> s + x) >= greatest({least}, {each} * (length(q.val) - 1))"
    # a rise from start to stop, if it is high enough; total and high are beyond EACH
    add = lambda high, stop: f"if({high} + {each} * ({stop} - s.start) >= {least}, array_append(s.out, named_struct('start', s.start, 'stop', {stop})), s.out)"
    grown = f"transform(array(s.total + x - {each}L), t -> named_struct('t', t, 'high', greatest(s.high, t), 'stop', if(t > s.high, s.i + 1, s.stop)))"
    step = (
        f"element_at(transform({grown}, g -> if(g.t <= 0 or g.high - g.t >= {round(1000 * DROP)}, "
        f"named_struct('out', {add('g.high', 'g.stop')}, 'i', s.i + 1, 'total', 0L, 'high', 0L, 'start', s.i + 1, 'stop', s.i + 1), "
        "named_struct('out', s.out, 'i', s.i + 1, 'total', g.t, 'high', g.high, 'start', s.start, 'stop', g.stop))), 1)"
    )
    zero = "named_struct('out', cast(array() as array<struct<start:int,stop:int>>), 'i', 0, 'total', 0L, 'high', 0L, 'start', 0, 'stop', 0)"
    rises = f"aggregate(q.score, {zero}, (s, x) -> {step}, s -> {add('s.high', 's.stop')})"
    word = "length(regexp_extract({}, '^[A-Za-z0-9]*', 0))"
    wide = f"transform({rises}, x -> named_struct('a', x.start - {word.format('reverse(substring(q.val, 1, x.start))')}, 'b', x.stop + 1 + {word.format('substring(q.val, x.stop + 2)')}))"
    wide = f"filter({wide}, w -> w.b - w.a >= {LEAST} and size(array_distinct(split(substring(q.val, w.a + 1, w.b - w.a), ''))) >= {DIFFERENT})"
    merged = (
        f"aggregate({wide}, cast(array() as array<struct<a:int,b:int>>), (o, w) -> if(w.a < coalesce(try_element_at(o, -1).b, 0), "
        "concat(slice(o, 1, size(o) - 1), array(named_struct('a', try_element_at(o, -1).a, 'b', w.b))), array_append(o, w)))"
    )
    span = lambda a, b: f"named_struct('at', q.at + {a}, 'kind_no', {len(BASE)}, 'kind', 'markov', 'end', q.at + {b})"
    return f"flatten(transform({scored}, q -> if({whole}, array({span('0', 'length(q.val)')}), transform({merged}, m -> {span('m.a', 'm.b')}))))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(df: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """df with `base_spans` and `spans`: arrays of (at, kind_no, kind, end), in code points, the end exclusive, by start and kind.

    base_spans has what the patterns find, leftmost and without overlap for each kind; spans has the Markov findings too,
    in what the base spans leave of the text.  A null or empty text has none.
    """
    model = model or default_model()
    ratio = "from_json('" + json.dumps(model.ratio) + "', 'array<int>')"
    # whatever the text column's name, and whatever columns of ours df has already
    df = df.drop("base_spans", "spans") if text not in ("base_spans", "spans") else df
    out = df.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    for order, (kind, pattern, group, least, quick) in enumerate(BASE):
        out = _found(out, "__text", kind, order, pattern, group, least, quick)
    out = _found(out, "__text", "markov", len(BASE), CANDIDATE, 0, LEAST, CANDIDATE, True)
    out = out.withColumn("base_spans", F.array_sort(F.concat(*(F.col(f"__{k[0]}") for k in BASE))))
    out = out.withColumn("__pieces", F.expr(_pieces()))
    out = out.withColumn("spans", F.array_sort(F.concat("base_spans", F.expr(_stretches(ratio)))))
    return out.drop("__text", "__markov", "__pieces", *(f"__{k[0]}" for k in BASE))


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.at, ':', s.end)), ',')")


def counted(kind: str, spans: str = "spans") -> Column:
    return F.expr(f"cast(size(filter({spans}, s -> s.kind = '{kind}')) as bigint)")


def redact(df: DataFrame, text: str = "text", model: Model | None = None, by: str = "[SECRET]") -> DataFrame:
    """df with every found span of the text replaced; overlapping spans share one replacement.  A null text stays null."""
    got = scan(df, text, model)
    t = f"`{text}`"
    step = f"named_struct('out', if(x.at >= s.at, concat(s.out, substring({t}, cast(s.at + 1 as int), cast(x.at - s.at as int)), '{by}'), s.out), 'at', greatest(s.at, x.end))"
    whole = f"aggregate(spans, named_struct('out', '', 'at', 0L), (s, x) -> {step}, s -> concat(s.out, substring({t}, cast(s.at + 1 as int))))"
    return got.withColumn(text, F.when(F.size("spans") > 0, F.expr(whole)).otherwise(F.col(t))).drop("base_spans", "spans")
