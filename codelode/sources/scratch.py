"""Intermediate results that several steps read: worked out once and written to the shared
folder of the cluster, so that they also survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}

#: Session setting: shuffled rows are dropped when what they were for has been written, and not only when
#: the driver happens to collect its garbage. Steps of a job then do not add up on disk.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a session whose executors run inside
    the driver (``local[..]``, as in tests) may leave it unset: a temporary folder serves then.
    Elsewhere executors would write to disks that others cannot read, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and (
                spark.sparkContext.master != "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId,
                                   tempfile.mkdtemp(prefix="codelode-"))
    return folder.rstrip("/")


def saved(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """Write the rows as Parquet under the shared folder and read them back. Readers get
    column pruning and sizes from it, and the work before it is done once.

    ``plain``: neither compressed nor by dictionary. Whether a join broadcasts a table goes by the size of
    its files, and rows that repeat much are a tenth of their size there; the driver would hold all of it."""
    path = f"{shared_folder(df.sparkSession)}/codelode/{name}-{uuid.uuid4().hex}"
    how = {"compression": "none", "parquet.enable.dictionary": "false"} if plain else {}
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, "false")
    conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.options(**how).parquet(path)
    finally:
        conf.set(DROP_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Session setting: into how many partitions queries deal out a table they read, whatever its size.
READ_PARTITIONS = "codelode.read.partitions"
#: Rows of a narrow table that become one task's work, and the fewest worth a task of their own.
ROWS_PER_TASK = 4_000
LEAST_ROWS_PER_TASK = 250


def _tasks(df: DataFrame, rows: int) -> int:
    """As many tasks as the session asks for; else at most about ``rows`` rows each, and some for every core."""
    given = df.sparkSession.conf.get(READ_PARTITIONS, None)
    if given:
        return int(given)
    count = df.count()
    by_cores = min(-(-count // LEAST_ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism)
    return max(1, -(-count // rows), by_cores)


def dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows as the reader splits them, or dealt out as the session asks for. With ``rows`` they are also
    dealt out where the reader makes fewer tasks than there would be with so many rows each: a file with
    one row group cannot be split, however long it is."""
    if rows is None and not df.sparkSession.conf.get(READ_PARTITIONS, None):
        return df
    n = _tasks(df, rows or ROWS_PER_TASK)
    asked = df.sparkSession.conf.get(READ_PARTITIONS, None)
    return df.repartition(n) if asked or n > df.rdd.getNumPartitions() else df


def spread(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Rows of a narrow table dealt out by their number. A row that becomes a source file is much work
    behind few bytes, so the reader, which splits by bytes, leaves a large table to one or two tasks.
    Files of at most about ``rows`` rows are written, and small tables still give every core some. They
    are written because filters on what is made of the rows would move in front of a shuffle."""
    return saved(df.repartition(_tasks(df, rows)), "rows")
