"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import durable, run_arrow, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(*tables: DataFrame) -> None:
    """Delete tables that durable() wrote and that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith("lectern-"):
                jvm = df.sparkSession._jvm
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of a side that is broadcast, at most; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32_000_000


def _width(name: str, kind: T.DataType) -> F.Column:
    """Bytes of a value, about; texts and arrays by their lengths."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 24
    if isinstance(kind, T.ArrayType):
        each = 8 * len(kind.elementType.fields) + 24 if isinstance(kind.elementType, T.StructType) else 8
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType)):
            return F.lit(BROADCAST_BYTES)  # not bounded by its length
        return F.coalesce(F.size(c), F.lit(0)) * each + 24
    return F.lit(8 if not isinstance(kind, T.StructType) else 8 * len(kind.fields) + 24)


def if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its values are measured to take at most `most` bytes."""
    width = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(24))
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def map_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]]) -> DataFrame:
    """mapInArrow with a per-task set-up: make() returns the function for one batch,
    which returns the output columns in the order of the schema."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows and (out := one(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return run_arrow(df, run, schema)


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about `most` units, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def bit_blocks(keys: DataFrame, column: str, bits: int):
    """Set bits of `column` (a long hash) as one long per 64 positions, gathered by a
    grouped bit_or: at most bits / 64 rows, whatever the input.  Returns a numpy array."""
    import numpy as np

    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    rows = (
        keys.select(F.shiftright(at, 6).alias("k"), F.expr(f"shiftleft(1L, cast(({column} & 63L) as int))").alias("b"))
        .groupBy("k").agg(F.bit_or("b").alias("b")).toArrow()
    )
    out = np.zeros(max(1, bits // 64), np.uint64)
    out[rows["k"].to_numpy()] = rows["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def has_bits(blocks, hashes):
    """Which of the hashes (int64) have their bit set: no false negatives."""
    import numpy as np

    at = hashes.view(np.uint64) & np.uint64(len(blocks) * 64 - 1)
    return (blocks[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def bits_for(n: int, most: int) -> int:
    return min(most, 1 << max(16, (8 * max(n, 1) - 1).bit_length()))
