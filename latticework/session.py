"""Session helpers: a local session for tests and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def local_session(cores: str = "8", app: str = "latticework", memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one is made only where the cluster names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _LOCAL
    try:
        return _LOCAL
    except NameError:
        _LOCAL = "file://" + tempfile.mkdtemp(prefix="latticework-")
        return _LOCAL


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, never a re-run of the stages before. The table
    is compressed and columnar, so later passes read only the columns they need. Tables are removed
    when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/latticework/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget_materialized() -> None:
    """Delete every table that ``materialize`` wrote in this process."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already
            return


atexit.register(forget_materialized)


def parallelism(spark: SparkSession) -> int:
    """Cores that can run tasks now, at least 2."""
    return max(2, spark.sparkContext.defaultParallelism)
