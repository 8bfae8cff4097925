"""Session helpers: shared scratch folder and small result frames."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """Fresh path in the folder named by ``spark.checkpoint.dir``, which all executors reach."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{shared.rstrip('/')}/cleanframe-{purpose}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The archive is made beside the driver and handed out by Spark's own file server.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cleanframe-")) / "cleanframe_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``write_table`` once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cleanframe-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def write_table(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and read it back.

    Cuts the lineage with data that survives the loss of executors, and lets later
    passes read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_frame(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """DataFrame of a few driver-side rows (statistics, logs)."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def aggregate_row(df: DataFrame, measures: list, at_once: int = 500) -> dict:
    """Values of named global aggregates as driver values.

    Very wide tables are read in a few passes, since one aggregate with thousands of
    expressions would no longer compile; each pass scans only its own columns.
    """
    row: dict = {}
    for start in range(0, len(measures), at_once):
        row.update(df.agg(*measures[start:start + at_once]).first().asDict())
    return row
