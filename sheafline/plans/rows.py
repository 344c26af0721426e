"""Python functions over rows, in small Arrow batches, for parsers and codecs that Column expressions cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sheafline.session import ship


class CodedError(ValueError):
    """A failure a caller can act on: a stable code and a message."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


#: Characters and bytes of results that are held before they are handed on.
MOST_HELD = 32 << 20
ERROR_FIELDS = [T.StructField("error_code", T.StringType()), T.StructField("error_message", T.StringType())]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _schema(fields: str | list[T.StructField]) -> list[T.StructField]:
    return T._parse_datatype_string(fields).fields if isinstance(fields, str) else list(fields)


def map_rows(df: DataFrame, fn: Callable[..., tuple], inputs: list[str], fields: str | list[T.StructField], keep: list[str] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """One row in, one row out: fn(*inputs) gives the new columns' values.

    A CodedError, or any other failure, of a row leaves its new columns null and fills error_code and error_message; in mode
    FAILFAST it ends the query.
    """
    return _mapped(df, lambda *a: [fn(*a)], inputs, fields, keep, mode)


def explode_rows(df: DataFrame, fn: Callable[..., list[tuple]], inputs: list[str], fields: str | list[T.StructField], keep: list[str] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """One row in, any number out: fn(*inputs) gives tuples.  A failing row gives one row with its error."""
    return _mapped(df, fn, inputs, fields, keep, mode)


def _mapped(df, fn, inputs, fields, keep, mode) -> DataFrame:
    ship(df.sparkSession)
    new = [*_schema(fields), *ERROR_FIELDS]
    taken = {f.name for f in new}
    keep = [c for c in (df.columns if keep is None else keep) if c not in taken]
    schema = T.StructType([*(df.schema[c] for c in keep), *new])
    kinds = [to_arrow_type(f.dataType) for f in new]
    names, n_keep, n_new = schema.names, len(keep), len(new) - 2
    src = df.select(*(F.col(_quoted(c)) for c in keep), *(F.col(_quoted(c)).alias(f"__in{i}") for i, c in enumerate(inputs)))

    def batch(b: pa.RecordBatch, out: list, source: list) -> pa.RecordBatch:
        kept = [b.column(k).take(pa.array(source, pa.int32())) for k in range(n_keep)]
        return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, type=t) for c, t in zip(zip(*out), kinds))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                out, source, held = [], [], 0
                for i in range(b.num_rows):
                    args = [b.column(n_keep + k)[i].as_py() for k in range(len(inputs))]
                    try:
                        got = [(*r, None, None) for r in fn(*args)]
                    except Exception as e:  # every failure of a row is that row's result
                        if mode == "FAILFAST":
                            raise
                        got = [(*[None] * n_new, getattr(e, "code", "CONVERT_FAILED"), str(e))]
                    for r in got:
                        out.append(r)
                        source.append(i)
                        held += sum(len(x) for x in r if isinstance(x, (str, bytes)))
                        if held > MOST_HELD:  # rows go on before they fill the task's memory or a batch's limits
                            yield batch(b, out, source)
                            out, source, held = [], [], 0
                if out:
                    yield batch(b, out, source)

    return src.mapInArrow(run, schema)
