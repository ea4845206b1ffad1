"""Session, table loading and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local sessions, by application.
_OWN: dict[str, str] = {}


def local_session(app: str = "attestra", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster session comes from spark-submit."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers of a session import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than the session has cores, such as one small file, over all cores.

    Texts cost much CPU a byte, and a file under the split size is one task. Larger tables have more
    partitions than cores and are read as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A local session without it gets a temporary one, a cluster raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        path = tempfile.mkdtemp(prefix="attestra-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[app] = "file://" + path
    return _OWN[app]


#: Applications whose tables are removed at exit.
_CLEANED: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """The application's folder of intermediate tables; it is removed when the driver's Python ends, or by ``clean``."""
    app = spark.sparkContext.applicationId
    if app not in _CLEANED:
        _CLEANED.add(app)
        atexit.register(_clean_quietly, spark)
    return f"{shared_dir(spark)}/attestra/{app}"


def clean(spark: SparkSession) -> None:
    """Remove all tables that ``cut`` wrote in this application; DataFrames that read them can't be used any more."""
    forget(spark, f"{shared_dir(spark)}/attestra/{spark.sparkContext.applicationId}")


def _clean_quietly(spark: SparkSession) -> None:
    try:
        clean(spark)
    except Exception:  # the session is gone
        pass


#: The setting by which an execution's shuffle files are removed when it ends.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, drop: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that its lineage ends there.

    Survives the loss of executors, unlike a local checkpoint. The write's shuffle files, which nothing
    reads again, are removed at its end and not when the driver collects its garbage. ``drop`` is a path returned by
    ``cut_path`` of an older step that is no longer needed; it is removed after the write.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_END) if before is None else spark.conf.set(SHUFFLES_END, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._attestra_path = path
    if drop:
        forget(spark, drop)
    return back


def cut_path(df: DataFrame) -> str | None:
    return getattr(df, "_attestra_path", None)


def forget(spark: SparkSession, path: str | None) -> None:
    """Remove a table written by ``cut``."""
    if not path:
        return
    if path.startswith("file:/") and os.path.isdir(path[5:].replace("//", "/", 1)):
        shutil.rmtree(path[5:].replace("//", "/", 1), ignore_errors=True)
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
