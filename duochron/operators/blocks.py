"""Dense columns over many rows, kept as files of bounded blocks, and a sparse symmetric matrix over the same rows.

An iteration that goes over the same rows hundreds of times pays more for shuffles and jobs than for its sums. Here a
block of rows stays one file in the shared folder, a task reads the blocks it needs, and only small matrices and names
of files reach the driver. A product with the matrix reads the other blocks one after the other, so a task holds one
block of edges, of columns and of neighbours, whatever the number of rows.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_folder, materialize, shipped
from ..sources.files import opened

ROWS_A_BLOCK = 16_384
SLICES_A_CORE = 4
EDGES_AT_ONCE = 262_144


def _write(folder: str, *arrays: np.ndarray) -> str:
    """A new file of arrays; an attempt that is repeated writes another one."""
    name = f"{folder}/{uuid.uuid4().hex}"
    fs, path = opened(name)
    with fs.open_output_stream(path) as out:
        for a in arrays:
            pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(a)), out)
    return name


def _read(name: str, count: int = 1) -> list[np.ndarray]:
    fs, path = opened(name)
    with fs.open_input_file(path) as f:
        whole = pa.BufferReader(f.read_buffer())
    return [pa.ipc.read_tensor(whole).to_numpy() for _ in range(count)]


def _beside(names: Sequence[str]) -> np.ndarray:
    return np.hstack([_read(n)[0] for n in names])


def _times(edges: str, xs: Sequence[str], rows: int, width: int) -> np.ndarray:
    """A block's rows of the matrix times the columns whose blocks are `xs`."""
    y = np.zeros((width, rows))
    ends, row, col, value = _read(edges, 4)
    for j in np.flatnonzero(np.diff(ends)):
        x = np.ascontiguousarray(_read(xs[j])[0].T)
        for lo in range(ends[j], ends[j + 1], EDGES_AT_ONCE):
            at = slice(lo, min(lo + EDGES_AT_ONCE, ends[j + 1]))
            first = np.flatnonzero(np.diff(row[at], prepend=-1))
            for c in range(width):
                y[c, row[at][first]] += np.add.reduceat(value[at] * x[c][col[at]], first)
    return y.T


class Blocks:
    """Rows of the vertices of `t` (src, dst, t), symmetric; columns are lists of files, one a block."""

    def __init__(self, t: DataFrame, start: Callable[[Column], Column]) -> None:
        self.spark = t.sparkSession
        self.folder = f"{checkpoint_folder(self.spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
        fs, path = opened(self.folder)
        fs.create_dir(path, recursive=True)
        try:
            self._fill(t, start)
        except BaseException:
            self.close()
            raise

    def _fill(self, t: DataFrame, start: Callable[[Column], Column]) -> None:
        vertices = materialize(t.select(F.col("src").alias("v")).distinct())
        self.parts = parts = max(1, -(-vertices.count() // ROWS_A_BLOCK))
        self.kind = vertices.schema["v"].dataType.simpleString()
        self.slices = max(1, min(parts, SLICES_A_CORE * self.spark.sparkContext.defaultParallelism))
        place = F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int")
        rows = materialize(vertices.withColumn("part", place).withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1))
        folder = self.folder

        def keep(t: pa.Table) -> pa.Table:
            t = t.sort_by("at")
            x = t["x"].combine_chunks()
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            names = _write(folder, t["v"].to_numpy()), _write(folder, x)
            return pa.table({"part": t["part"][:1], "n": [t.num_rows], "ids": [names[0]], "x": [names[1]]})

        got = {r.part: r for r in shipped(rows.withColumn("x", start(F.col("v")))).groupBy("part").applyInArrow(keep, "part int, n bigint, ids string, x string").collect()}
        self.held = sorted(got)  # blocks that have rows
        self.rows, self.ids, self.start = ([getattr(got[i], c) for i in self.held] for c in ("n", "ids", "x"))
        order = {i: k for k, i in enumerate(self.held)}

        def link(t: pa.Table) -> pa.Table:
            j = np.array([order.get(p, -1) for p in range(parts)])[t["dpart"].to_numpy()]
            row, col, value = (t[c].to_numpy() for c in ("sat", "dat", "t"))
            by = np.lexsort((col, row, j))
            ends = np.searchsorted(j[by], np.arange(len(order) + 1))
            return pa.table({"part": t["spart"][:1], "edges": [_write(folder, ends, row[by], col[by], value[by])]})

        side = lambda e: rows.select(F.col("v").alias(e), F.col("part").alias(f"{e[0]}part"), F.col("at").alias(f"{e[0]}at"))
        placed = t.where(F.col("t").isNotNull()).join(side("src"), "src").join(side("dst"), "dst").select("spart", "sat", "dpart", "dat", "t")
        edges = dict(shipped(placed).groupBy("spart").applyInArrow(link, "part int, edges string").collect())
        self.edges = [edges.get(i) for i in self.held]

    def iterate(self, run: Callable[[Blocks], object]) -> object:
        """`run` with these rows: in the driver, which sends each operation to tasks, or, where all rows are one
        block, as a whole in the task that holds it."""
        if len(self.held) > 1:
            return run(self)
        alone = copy.copy(self)
        alone.spark = None
        return self.spark.sparkContext.parallelize([0], 1).map(lambda _: run(alone)).first()

    def _in_tasks(self, run: Callable[[list[int]], object]) -> list:
        """`run` on the blocks of each slice, in the blocks' order."""
        n = len(self.held)
        if self.spark is None:
            return [run(list(range(n)))]
        return self.spark.sparkContext.parallelize(range(n), max(1, min(self.slices, n))).mapPartitions(lambda of: [run(list(of))]).collect()

    def multiply(self, basis: list[list[str]], last: list[str], width: int) -> tuple[list[str], np.ndarray]:
        """The matrix times the columns `last`, and the Gram matrix of `basis`, `last` and that product."""
        folder, edges, rows = self.folder, self.edges, self.rows

        def run(of: list[int]) -> tuple[list[str], np.ndarray | float]:
            names, gram = [], 0.0
            for i in of:
                y = _times(edges[i], last, rows[i], width) if edges[i] else np.zeros((rows[i], width))
                names.append(_write(folder, y))
                all_of = np.hstack([_beside([b[i] for b in [*basis, last]]), y])
                gram = gram + all_of.T @ all_of
            return names, gram

        got = self._in_tasks(run)
        return [n for names, _ in got for n in names], sum(g for _, g in got)

    def gram(self, columns: list[list[str]]) -> np.ndarray:
        def run(of: list[int]) -> np.ndarray | float:
            out = 0.0
            for i in of:
                x = _beside([c[i] for c in columns])
                out = out + x.T @ x
            return out

        return sum(self._in_tasks(run))

    def combine(self, columns: list[list[str]], *mixes: np.ndarray) -> list[list[str]]:
        """The columns side by side times each of the small matrices."""
        folder = self.folder

        def run(of: list[int]) -> list[list[str]]:
            out = []
            for i in of:
                x = _beside([c[i] for c in columns])
                out.append([_write(folder, x @ m) for m in mixes])
            return out

        got = [names for some in self._in_tasks(run) for names in some]
        return [[names[k] for names in got] for k in range(len(mixes))]

    def drop(self, columns: list[list[str]]) -> None:
        """Files of columns that nothing reads any more."""
        for name in (n for c in columns for n in c):
            fs, path = opened(name)
            fs.delete_file(path)

    def frame(self, column: list[str], name: str) -> DataFrame:
        """(v, `name`): the columns as an array per vertex, written as a checkpoint."""
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for ids, x in zip(pdf["ids"], pdf["x"]):
                    yield pd.DataFrame({"v": _read(ids)[0], name: list(_read(x)[0])})

        at = self.spark.createDataFrame(list(zip(self.ids, column)), "ids string, x string").repartition(self.slices)
        return materialize(shipped(at).mapInPandas(rows, f"v {self.kind}, `{name}` array<double>"))

    def close(self) -> None:
        fs, path = opened(self.folder)
        fs.delete_dir(path)
