"""Written intermediate tables and the package on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import parcelio
from parcelio.session import new_shared_path

_shipped: set[str] = set()


#: Text that a task handles at a time, so that its memory doesn't depend on the length of the rows.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, and bounds Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(parcelio.__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="parcelio-package-"), "parcelio")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "parcelio"))
    _shipped.add(app)


def written(table: DataFrame, label: str) -> DataFrame:
    """The table, written to the shared folder and read again.

    Later plans start from the files, so a lost executor costs no recomputation
    of what came before.
    """
    path = new_shared_path(table.sparkSession, label)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text` alone, whatever else the table holds."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def filtered(docs: DataFrame, keep: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The rows that `keep` passes on, with all columns; it finds `text`, and the others under other names.

    Arrow functions can't take column names with dots, which a table may have.
    """
    ship(docs.sparkSession)
    plain = docs.toDF(*[c if c == "text" else f"column{k}" for k, c in enumerate(docs.columns)])
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
