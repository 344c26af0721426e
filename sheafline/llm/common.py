"""What the operators of this subpackage share.

Conventions that hold for every operator here:

* An operator reads the columns it is told to read.  Other columns pass through where the operator keeps rows, and an
  input column whose name equals a result column is replaced by the result.
* A null text counts as an empty text unless the operator's docstring says otherwise.
* Repeated rows are rows of their own.
* Intermediate tables are Parquet in the folder that ``spark.checkpoint.dir`` names, so a lost executor costs tasks only.
"""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but the ASCII white space; the same text for Python, Java and RE2.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: Lower-cases A-Z and nothing else.
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where that is unset, as in tests, a temporary folder if the
    whole of Spark runs in this process; on a cluster, whose machines have temporary folders of their own, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/sheafline-shared"
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/sheafline/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once and read from a table in the shared folder from then on."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sheafline_path = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table behind written(); the frame must not be used afterwards."""
    delete_path(df.sparkSession, df._sheafline_path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text is divisible by 5: such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def n_words(text: Column) -> Column:
    """Words of a text as long, JVM-side; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_shipped: set[str] = set()


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Makes Python on the executors ready for this package's functions.

    The package goes to the executors by way of the shared folder, once an application, so that it need not be installed
    there.  Arrow batches are kept at `rows` rows where the session has Spark's default of 10000, which suits short rows: of
    texts of several kilobytes such a batch takes tens of megabytes, in the JVM and again in Python.  That is a setting of
    the session, and stays; a value of the caller's own is left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.writestr(str(f.relative_to(top.parent)), f.read_bytes())
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sheafline/{top.name}-{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    _shipped.add(sc.applicationId)


def map_rows(df: DataFrame, fn: Callable[..., list], inputs: list[str], fields: list[T.StructField], keep: list[str] | None = None, rows: int = 512) -> DataFrame:
    """Appends columns that fn computes in Arrow batches.

    fn gets one Python list per input column and returns one list or Arrow array per field.  It sees at most `rows` rows
    at a time, so that memory follows the length of a few texts and not of a partition.
    """
    new = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = schema.names
    # the same column may be kept and read; inputs ride along under names of their own
    read = [f"__in{i}" for i in range(len(inputs))]
    src = df.select(*[F.col(_q(c)) for c in keep], *[F.col(_q(c)).alias(r) for c, r in zip(inputs, read)])
    n_keep = len(keep)
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                got = fn(*[b.column(n_keep + i).to_pylist() for i in range(len(read))])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(got, kinds)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_keep)), *arrays], names=names)

    return src.mapInArrow(run, schema)


def input_bytes(df: DataFrame) -> int | None:
    """What Spark takes the tables behind df to hold, in bytes; None where it does not know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < 1 << 60 else None


def parts_for(df: DataFrame, rows: int, bytes_each: int = 64 << 20, rows_each: int = 100_000) -> int:
    """Tasks for a shuffle of df: the session's number, or more where a task would get more than bytes_each (where Spark does
    not know the size, more than rows_each)."""
    size = input_bytes(df)
    wanted = -(-rows // rows_each) if size is None else -(-size // bytes_each)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(wanted, 1 << 17))


def _place(key: Column, bounds: Column, n: int) -> Column:
    """How many of the n sorted bounds are at or below the key, by binary search."""
    steps = F.sequence(F.lit(1), F.lit(max(1, n).bit_length()))
    mid = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    state = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    halve = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(F.get(bounds, mid(s)) <= key, state(mid(s) + 1, s["hi"])).otherwise(state(s["lo"], mid(s))))
    return F.aggregate(steps, state(F.lit(0), F.lit(n)), halve, lambda s: s["lo"])


def ranges(df: DataFrame, key: list[str], tie: list[str], before: bool = False, after: bool = False, wrap: bool = False, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df dealt out by ranges of `key` and sorted by key and tie within each, nulls first, with __part and __guest.

    __guest is 0 for df's rows.  With `before`, a range begins with a guest (-1), the last row before it; with `after` it ends
    with a guest (1), the first row after it; with `wrap` the last row of all stands before the first and the other way
    round.  So a task sees both neighbours of each of its rows in passing, and each range costs two rows more at most.
    `made` is applied to df and to the guests when the ranges are known, before rows are dealt out.

    Bounds are keys of a sample that is bounded by the number of ranges; what comes to the driver are those and the first
    and last key of each range.  Rows of equal key and tie are interchangeable neighbours; rows of equal keys share a range.
    An empty table gives an empty one.
    """
    spark, made = df.sparkSession, made or (lambda x: x)
    rows = df.count()
    parts = parts_for(df, rows)
    wanted = 32 * parts
    keys = F.struct(*(F.col(_q(c)) for c in key))
    at = df.select(*key)
    if rows > wanted:
        at = at.where(F.xxhash64(*key) < F.lit(((wanted << 64) // rows) - (1 << 63)))
    sample = at.distinct().orderBy(*key).collect()
    bounds = sorted({i * len(sample) // parts for i in range(1, parts)}) if sample else []
    kinds = [df.schema[c].dataType for c in key]
    lit = lambda r: F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(r, kinds, key)))
    part = _place(keys, F.array(*(lit(sample[i]) for i in bounds)), len(bounds)).cast("int") if bounds else F.lit(0)
    df = df.withColumn("__part", part)
    whole = [*key, *tie]
    edge = F.struct(*whole)
    edges = df.groupBy("__part").agg(F.min(edge).alias("first"), F.max(edge).alias("last")).orderBy("__part").collect()
    guests = []
    for i, e in enumerate(edges):
        if before and (i or wrap):
            guests.append((*edges[i - 1]["last"], e["__part"], -1))
        if after and (i + 1 < len(edges) or wrap):
            guests.append((*edges[(i + 1) % len(edges)]["first"], e["__part"], 1))
    out = made(df).withColumn("__guest", F.lit(0))
    if guests:
        to = T.StructType([*(T.StructField(f"__k{i}", df.schema[c].dataType) for i, c in enumerate(whole)), T.StructField("__to", T.IntegerType()), T.StructField("__guest", T.IntegerType())])
        asked = F.broadcast(spark.createDataFrame(guests, to))  # two rows a range
        on = [F.col(_q(c)).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(whole)]
        # of rows that are equal in key and tie any one will do
        met = df.join(asked, on).groupBy("__to", "__guest").agg(F.first(F.struct(*(F.col(_q(c)) for c in df.columns))).alias("__row"))
        met = made(met.select("__row.*", "__to", "__guest").withColumn("__part", F.col("__to")).drop("__to"))
        out = out.unionByName(met)
    return out.repartitionById(parts, F.col("__part")).sortWithinPartitions("__part", "__guest", *whole)


#: Bits of a filter that tasks get of a set of ids: FILTER_BITS for each id, MOST_FILTER_BITS (64 MB) at most.
FILTER_BITS, MOST_FILTER_BITS, BITMAP = 16, 1 << 29, 32768


def may_be_in(df: DataFrame, key: str, ids: DataFrame, name: str = "__may") -> DataFrame:
    """df with a boolean: false where the key is surely not one of ids (one column), so that such rows need not be shuffled to
    find that out.  The filter is one hash in a row of bitmaps, of bounded size; where ids are too many for it, more rows are
    true, at last all.  A null key is false.
    """
    (column,) = ids.columns
    buckets = max(1, min(MOST_FILTER_BITS, FILTER_BITS * ids.count()) // BITMAP)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets * BITMAP))
    set_bits = ids.select(place(F.col(column)).alias("at")).groupBy(F.expr(f"cast(at div {BITMAP} as int)").alias("__bucket")).agg(F.bitmap_construct_agg(F.expr(f"at % {BITMAP}")).alias("__bits"))
    bits = F.broadcast(written(set_bits, "filter"))  # at most MOST_FILTER_BITS
    got = df.withColumn("__at", place(F.col(_q(key)))).withColumn("__bucket", F.expr(f"cast(__at div {BITMAP} as int)")).join(bits, "__bucket", "left")
    byte = F.expr(f"cast(conv(hex(substring(__bits, cast((__at % {BITMAP}) div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.coalesce(F.expr("cast(__at % 8 as int)").isNotNull() & (F.call_function("getbit", byte, F.expr("cast(__at % 8 as int)")) == 1), F.lit(False))
    return got.withColumn(name, hit & F.col(_q(key)).isNotNull()).select(*(F.col(_q(c)) for c in df.columns), name)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"

