"""Session set-up, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Used only where the cluster names no shared folder (tests, a laptop).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/orrery"
#: Input that is dealt out over all cores at most.
SPREAD_BYTES = 1 << 30


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python finds it wherever they run.

    Spark serves the archive from the driver, as it does files named to spark-submit.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="orrery-")) / "orrery.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"orrery/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow() with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def local_session(name: str = "orrery", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, a file or a folder; any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, and of SPREAD_BYTES at most, dealt out over all of them; any other as it is.

    For small files that cannot be split. A large input is never moved, however many cores there are.
    """
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    small = int(str(plan.optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES
    return df.repartition(cores) if small and plan.toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's spark.checkpoint.dir names it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise RuntimeError(f"{master}: set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or LOCAL_CHECKPOINTS


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a URI, and the path in it, for Python code on executors. Hadoop's names of stores are taken as well."""
    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    elif scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; nothing is created."""
    return f"{shared_dir(spark).rstrip('/')}/orrery-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    What follows no longer depends on the executors that computed ``df``: a lost executor costs a
    re-read, not the recomputation of the whole lineage.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, so that any store works."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def clean_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application has cut; results that are still to be read from them are lost."""
    drop_path(spark, f"{shared_dir(spark).rstrip('/')}/orrery-{spark.sparkContext.applicationId}")
