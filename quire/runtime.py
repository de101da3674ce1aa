"""What every query needs from the session: the package on the workers, and tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Workers import the kernels by name, so the package has to be there even
    where the repository is not on their path.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    target = Path(tempfile.mkdtemp(prefix="quire-")) / "quire_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted([*_ROOT.glob("quire/**/*.py"), *_ROOT.glob("corpus_pipeline.py")]):
            out.write(path, path.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)




def spread(scan: DataFrame) -> DataFrame:
    """A plain scan in at least as many partitions as there are cores, for costly work on its rows; one that has them isn't shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


_OWN: dict[str, str] = {}
#: Folders that no one reads once this process ends.
_ROOTS: set[str] = set()


@atexit.register
def _clean() -> None:
    """Delete what this process has written to the shared folder; nothing if its JVM is gone already."""
    with contextlib.suppress(Exception):
        jvm = SparkContext._gateway.jvm
        for root in _ROOTS | set(_OWN.values()):
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only in local mode.

    Raises on a cluster that names none: a folder of one machine would lose
    its files with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="quire-shared-"))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one query in the shared folder.

    ``keep`` writes a DataFrame and reads it back, which cuts its lineage: a
    lost executor costs at most the tasks after the last table.  ``drop``
    deletes a table that no later step reads; the rest goes when the driver
    process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _ROOTS.add(self.root)

    def keep(self, df: DataFrame, name: str, *, file_rows: int = 0) -> DataFrame:
        """With ``file_rows`` no part has more rows, so that a batch of the reader, which is counted in rows of one part, stays small however large they are."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.quire_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove(self.spark, table.quire_path)
