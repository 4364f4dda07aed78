"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import checkpoint_folder, materialize, shipped

__all__ = ["discard", "fresh", "kept", "map_batches", "map_groups", "map_text", "materialize", "raw", "shared_folder", "stored"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to `names` that `df` does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach, under spark.checkpoint.dir."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet to the shared folder and read again: smaller than a checkpoint of rows, and
    kept until the folder is emptied."""
    to = shared_folder(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


_KEPT: dict[str, object] = {}
KEPT_AT_ONCE = 4


def kept(key: str, make: Callable[[], object], alone: bool = False) -> object:
    """What `make` gives, made once in a worker process; the last few keys are kept. With `alone` all others
    go first, and the memory that they and Arrow's last batches held is given back."""
    if key not in _KEPT:
        while len(_KEPT) >= (1 if alone else KEPT_AT_ONCE):
            _KEPT.pop(next(iter(_KEPT)))
        if alone:
            gc.collect()
            pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


def discard(df: DataFrame) -> None:
    """Remove the table that `stored` wrote, once nothing will read `df` again."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """`run` over the Arrow batches of each task."""
    return shipped(df).mapInArrow(run, schema)


def map_groups(df: DataFrame, by: list[str], run: Callable[[pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """`run` over the Arrow table of each group of `by`; callers see to it that groups are bounded."""

    def each(t: pa.Table) -> pa.Table:
        return run(t)

    return shipped(df).groupBy(*by).applyInArrow(each, schema)


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def map_text(df: DataFrame, keep: list[str], text: str, build: Callable[[], Callable[[pa.Array], dict[str, object]]], adds: str, piece: int = 2000) -> DataFrame:
    """`keep` columns of `df` plus the columns in DDL `adds`, computed from `text` in Arrow batches.

    `build` runs once per task and returns the function from a text column to the new columns; it
    sees at most `piece` rows at once, so that memory does not follow the batch size. Rows stay in
    place: one comes out for each that goes in, no shuffle.
    """
    cols = [*dict.fromkeys([*keep, text])]
    new = StructType.fromDDL(adds)
    schema = StructType([df.schema[c] for c in keep] + list(new))
    names = [f.name for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = build()
        for whole in batches:
            for at in range(0, whole.num_rows, piece):
                b = whole.slice(at, piece)
                got = make(b.column(cols.index(text)))
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [got[n] if isinstance(got[n], pa.Array) else pa.array(got[n]) for n in names], names=[*keep, *names])

    return map_batches(df.select(*cols), run, schema)
