"""Row-wise Python in Arrow batches, shared words and stored steps."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A-Z to lower case, other ASCII but digits and a-z to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128
                   else 32 for b in range(256))
BROADCAST_BYTES = 32 << 20
ROWS = 256         # rows of an Arrow batch that are Python objects at once
BATCH_ROWS = 1000  # rows of an Arrow batch: texts can be long, and both sides hold whole batches
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return text.translate(WORD_BYTES).split() if text else []


def raw(column: str | Column) -> Column:
    """A text as its UTF-8 bytes; null stays null."""
    return (F.col(column) if isinstance(column, str) else column).cast("string").cast("binary")


def without(df: DataFrame, names) -> list[str]:
    """Columns of `df` but those named like a result column, in either case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def hidden(df: DataFrame, needed) -> tuple[DataFrame, list[Column]]:
    """`df` with all columns but the needed ones under names that nothing uses, and the columns
    that bring every name back."""
    names = {c: c if c in needed else f"__{i}" for i, c in enumerate(df.columns)}
    return df.select(*[col(c).alias(n) for c, n in names.items()]), [col(n).alias(c) for c, n in names.items()]


def append(df: DataFrame, inputs: list[Column], fields: T.StructType, fn, keep: list[str] | None = None,
           rows: int = ROWS) -> DataFrame:
    """`df` with new columns made by `fn`, in one narrow pass.

    fn gets one Python list per input for every `rows` rows and returns one list
    per new field, so that a worker holds few texts as Python objects; the
    session's Arrow batches are cut to `BATCH_ROWS` if they are larger. Input
    columns named like a new field are replaced; the columns in `keep` (default:
    all) go through untouched.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    kept = [c for c in (df.columns if keep is None else keep) if c in without(df, fields.names)]
    source = df.select(*[col(c).alias(f"k{i}") for i, c in enumerate(kept)],
                       *[c.alias(f"i{i}") for i, c in enumerate(inputs)])
    out = T.StructType([source.schema[f"k{i}"] for i in range(len(kept))] + list(fields.fields))
    made = to_arrow_schema(fields)
    n = len(kept)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                new = fn(*[batch.column(n + i).to_pylist() for i in range(batch.num_columns - n)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(n)] +
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(new, made)],
                    names=[f"k{i}" for i in range(n)] + made.names)

    done = source.mapInArrow(run, out)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *fields.names)


def shared(spark, value):
    """A broadcast value, as a function that opens it once per task. Classes travel by value."""
    sent, held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get():
        if not held:
            held.append(pickle.loads(sent.value))
        return held[0]
    return get


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a counted frame for broadcast while it is below a size; else leave it to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
