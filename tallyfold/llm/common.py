"""Shared plumbing: reading tables, shared scratch tables, Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every operator that counts words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one step of a Python kernel holds at a time (a single longer text comes alone).
STEP_BYTES = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session names none, one on a single machine (as in tests) gets a temporary folder; on a
    cluster, where executors would write to disks of their own, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows of an Arrow batch where the session keeps Spark's default, which is meant for narrow rows.
BATCH_ROWS = 1000


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Sets a session up for Python kernels: batches of texts of a few megabytes (a number that the
    session has set itself stays), and this package on the executors where nothing else puts it there."""
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, BATCH_ROWS)
    sc = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    root = str(package.parent)
    found = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if sc.applicationId in _shipped or root in found:
        return
    _shipped.add(sc.applicationId)
    zipped = os.path.join(tempfile.mkdtemp(prefix="tallyfold-"), "tallyfold.zip")
    with zipfile.ZipFile(zipped, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(zipped)


class Scratch:
    """Tables written once to the shared folder, which cut lineage and outlive lost executors.

    ``save`` computes a frame a single time (``checkpoint()`` would compute it twice and write it
    uncompressed).  ``drop`` frees a table that nothing lazy reads any more; the rest goes when the
    driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        prepare(spark)
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._at: dict[int, str] = {}
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            sc = self.spark.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone when the driver ends
            pass


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes that a written table takes."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def slices(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts take about ``most`` bytes; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def pieces(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts that the JVM can take one by one."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def by_slices(
    column: str, schema: pa.Schema, kernel: Callable[[pa.RecordBatch], dict | None], most: int = STEP_BYTES
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that applies ``kernel`` to slices of bounded size."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, most):
                out = kernel(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [v if isinstance(v, pa.Array) else pa.array(v, f.type) for f in schema for v in [out[f.name]]],
                        schema=schema,
                    )

    return run


def code_points(text: Column) -> Column:
    """Length in code points."""
    return F.char_length(text).cast("long")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
