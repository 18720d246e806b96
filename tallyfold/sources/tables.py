"""Reading and writing the domain's tables: CSV with declared types, parquet, an append-only log."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import RESULTS, SCHEMAS


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that driver and executors share (``spark.checkpoint.dir``).

    Where none is set, a session on one machine gets a temporary one; on a cluster that would lose data, so
    it is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_sent: set[str] = set()


def on_executors(spark: SparkSession) -> None:
    """Sends this package to the executors where neither the working folder nor the path has it."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    found = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if sc.applicationId in _sent or str(package.parent) in found:
        return
    _sent.add(sc.applicationId)
    zipped = os.path.join(tempfile.mkdtemp(prefix="tallyfold-"), "tallyfold.zip")  # the driver's own, Spark fetches it from there
    with zipfile.ZipFile(zipped, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(zipped)


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, computed and kept in the shared folder, without what it came from."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def read_csv(spark: SparkSession, path: str, table: str, columns: Iterable[str] | None = None, strict: bool = True) -> DataFrame:
    """A CSV table with its declared types; nothing is inferred.  Only ``columns`` are parsed.

    ``strict``: a value that doesn't fit its type fails the job; otherwise it becomes null."""
    read = spark.read.schema(SCHEMAS[table]).option("header", True).option("dateFormat", "yyyy-MM-dd").option("enforceSchema", False)
    frame = read.option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)
    return frame.select(*columns) if columns is not None else frame


def read_parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_submission(submission: DataFrame, path: str, order: str = "grid_order") -> None:
    """The submission (``id``, ``sales_hat``) as one CSV file with a header, in the order of ``order``."""
    submission.orderBy(order).select("id", "sales_hat").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_results(log: DataFrame, path: str, run: str) -> None:
    """Adds a run's rows to the experiment log, numbers with ten decimals.

    A run has a folder of its own, so one that is retried or repeated replaces what it wrote, and adds nothing twice."""
    if not run or not set(run) <= set("-_.abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") or run[0] in "._":
        raise ValueError(f"a run's name is made of letters, digits, dashes, dots and underscores: {run!r}")
    numbers = {f.name for f in RESULTS if f.dataType.typeName() == "double"}
    rows = log.select(*[F.format_string("%.10f", F.col(c).cast("double")).alias(c) if c in numbers else F.col(c).cast("string").alias(c) for c in RESULTS.names])
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/run={run}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS).option("header", True).csv(f"{path}/run=*")


def stage_means(log: DataFrame, stages: Iterable[str]) -> DataFrame:
    """Mean metrics of the log's rows of some stages."""
    return log.filter(F.col("stage").isin(*stages)).groupBy("stage").agg(
        *[F.avg(c).alias(c) for c in ("local_wmae", "local_wape", "local_bias")], F.count("*").alias("rows")
    )


def as_json(one_row: DataFrame) -> str:
    """A small report as JSON; meant for frames of a bounded number of rows."""
    return json.dumps([r.asDict(recursive=True) for r in one_row.collect()], indent=2, sort_keys=True, default=str)


def as_markdown(report: DataFrame) -> str:
    """A small report as a Markdown table."""
    rows = report.collect()
    lines = ["| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows])
