"""Mixing sources to target weights (operator 6).

Each document gets a hash-random key.  Within its source, documents stand in the order of their keys; prefix sums of their
sizes say where the source's budget ends.  The sums are made level by level: the keys' range is cut into 16**DIGITS equal
parts, which a hash fills evenly whatever the source's size; sizes are summed for each part and part totals are summed up in
order; the part in which the budget ends is cut into as many parts again, until it holds no more than FEW documents, which
are summed one by one.  No source is ever gathered in one task, and what every document takes then follows from its own key
and its source's cut alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheafline.llm.common import n_words, written

WEIGHTS = (5, 2, 1)
#: The mix holds this share of all sizes; no source more than MOST times its own size.
SHARE = 1.5
MOST = 2
#: Hex digits of the key that name a part of a level, and documents of a source that one task sums one by one.
DIGITS, FEW = 2, 50_000


def mix_key(doc_id: Column) -> Column:
    """32 hex digits, the same on every run and in every engine."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target of a table (source, source_size) with one row per source, the null source included.

    Sources by code point, null last, weigh `weights`, repeating.  The budget is shared by weight; where that passes
    `most` times a source's size the source stops there and the rest is shared among the others, until none is above.
    Solved at once: in the order of size to weight the sources stop one after another.  What is left for each unit of weight
    rises while they do and falls afterwards, so its greatest value is the right one.  The table has a row for each source.
    """
    by_name = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap"))
    by_ratio = W.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    s = s.withColumns(
        {
            "budget": F.sum("source_size").over(whole) * F.lit(float(share)),
            "stopped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "rest": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    each = (F.col("budget") - F.col("stopped")) / F.col("rest")
    s = s.withColumn("each", F.max(each).over(whole))
    target = F.least(F.col("each") * F.col("weight"), F.col("cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def cuts(docs: DataFrame, **params) -> DataFrame:
    """source, source_size, target, epochs, cut_key, cut_rest, cut_size: where each source's budget ends.

    docs: source, key, size.  Documents before cut_key are taken epochs + 1 times, those after it epochs times; those at
    it share cut_rest words, in proportion to their sizes, whose sum is cut_size.
    """
    named = docs.withColumn("source_key", _name(F.col("source")))

    def totals(rows: DataFrame, digits: int, *also: str) -> DataFrame:
        return rows.groupBy("source_key", *also, F.substring("key", 1, digits).alias("part")).agg(F.sum("size").alias("part_size"), F.count("*").alias("n"))

    first = written(totals(named, DIGITS, "source"), "mix-parts")
    goal = targets(first.groupBy("source").agg(F.sum("part_size").alias("source_size")), **params)
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    goal = written(goal.withColumn("source_key", _name(F.col("source"))).drop("source"), "mix-goals")
    # the part of each source in which what is left of its budget ends, narrowed down until it is small
    parts, digits = first.join(goal, "source_key").select("source_key", "part", "part_size", "n", F.lit(0).cast("long").alias("ahead"), "rest"), DIGITS
    while True:
        before = F.col("ahead") + F.sum("part_size").over(W.partitionBy("source_key").orderBy("part")) - F.col("part_size")
        found = parts.withColumn("before", before).where("before <= rest and rest < before + part_size")
        ends = written(found.select("source_key", F.col("part").alias("prefix"), F.col("before").alias("ahead"), "rest", "n"), "mix-ends")
        most = ends.agg(F.max("n")).first()[0]
        ends = ends.drop("n")
        if most is None or most <= FEW or digits >= 32:
            break
        parts, digits = totals(in_part_of(named, ends, digits), digits + DIGITS, "ahead", "rest"), digits + DIGITS
    near = in_part_of(named, ends, digits).groupBy("source_key", "key", "ahead", "rest").agg(F.sum("size").alias("cut_size"))
    before = F.col("ahead") + F.sum("cut_size").over(W.partitionBy("source_key").orderBy("key")) - F.col("cut_size")
    last = near.withColumn("before", before).where("before <= rest and rest < before + cut_size")
    last = last.select("source_key", F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("cut_rest"), "cut_size")
    return goal.join(last, "source_key", "left").select("source_key", "source_size", "target", "epochs", "cut_key", "cut_rest", "cut_size")


def in_part_of(docs: DataFrame, ends: DataFrame, digits: int) -> DataFrame:
    """The documents (source_key, key) of one part of each source; ends: source_key, prefix of so many digits."""
    return docs.withColumn("prefix", F.substring("key", 1, digits)).join(ends, ["source_key", "prefix"])


def _name(source: Column) -> Column:
    """A join key in which null has a place of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def taken(size: Column, key: Column) -> Column:
    """Words the mix takes of a document joined with cuts(): whole rounds, then what is left of the budget at its place."""
    more = F.when(F.col("cut_key").isNull() | (key > F.col("cut_key")), F.lit(0)).when(key < F.col("cut_key"), size)
    # where equal ids share the last place, each gives its part
    return (F.col("epochs") * size + more.otherwise(F.expr("cut_rest") * size / F.col("cut_size"))).cast("long")


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document; size is its number of words.

    A source's taken words are its target, rounded down (documents of one id at the cut: less a word each at most); no
    document is taken more than `most` times.  Null and empty texts have size 0 and take 0; the null source is a source.
    Equal ids have equal keys.  An empty table gives an empty one.
    """
    docs = written(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")).withColumn("key", mix_key(F.col("doc_id"))), "mix-sizes")
    cut = written(cuts(docs, weights=weights, share=share, most=most), "mix-cuts")
    got = docs.withColumn("source_key", _name(F.col("source"))).join(cut, "source_key")
    return got.select("doc_id", "size", "source_size", "target", taken(F.col("size"), F.col("key")).alias("taken"))


def mixed_documents(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: df's rows, each as often as it is taken.

    A row stands once for each whole round and once more if at least half of its words are taken in the last one; texts
    are never cut.  Rows without words (null and empty texts), which cost nothing, stay once; rows of one id are taken alike
    but at the cut.  All columns pass through, whatever their names.  An empty table gives an empty one.
    """
    # the row goes as one value, so that no name of its columns meets one of ours
    row = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)).alias("row")
    docs = df.select(row, n_words(F.col(text)).alias("size"), mix_key(F.col(doc_id)).alias("key"), F.col(source).alias("source"))
    slim = written(docs.select("source", "key", "size"), "mix-sizes")
    # written first: a row a source, whose size Spark then knows, so that where it is small documents stay where they are
    cut = written(cuts(slim, weights=weights, share=share, most=most), "mix-cuts")
    got = docs.select("row", "size", "key", _name(F.col("source")).alias("source_key")).join(cut, "source_key")
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(taken(F.col("size"), F.col("key")) / F.col("size") + 0.5)).cast("int")
    return got.select("row", times.alias("times")).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


#: DuckDB SQL for mix() over documents.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 2 AS cap FROM s
), r AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
    coalesce(sum(cap) OVER b, 0)::DOUBLE AS stopped, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS rest
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), e AS (
  SELECT *, max((budget - stopped) / rest) OVER () AS each FROM r
), t AS (
  SELECT source, source_size, least(each * weight::DOUBLE, cap::DOUBLE) AS target FROM e
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + least(size, greatest(0, budget % source_size - before)) END)::BIGINT AS taken
FROM p
"""
