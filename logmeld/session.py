"""Session settings, and the shared folder for checkpoints and intermediate tables."""

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Settings of a running session that these operators count on.
TUNING = {
    # The optimizer's constraint inference grows exponentially with chains of derived columns,
    # and has nothing to infer here: no operator joins on a computed column.
    "spark.sql.constraintPropagation.enabled": "false",
    # Methods above 8000 bytes of bytecode are never JIT-compiled: let Spark split them.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A repeated JSON key keeps its last value instead of making the document invalid.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session built elsewhere."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "logmeld", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings these operators are tuned for; all stay overridable."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Recording a Python call site for every column expression doubles the time to build a plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **TUNING,
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="logmeld-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage ends here. Wide text is worth ``codec`` zstd."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the job that made them ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Rows that a task of per-line work takes, some ten seconds of it.
TASK_ROWS = 25_000


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """The same rows dealt evenly over tasks of at most about ``rows``.

    A columnar file is divided by row groups, and one of some megabytes may hold a million short rows: minutes of per-line work for one
    task while others wait. What is dealt is counted first, so give rows as they are read, before any work on them.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows))
    return df.repartition(tasks)
