"""Session defaults and the shared scratch folder that cuts lineage."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("loreforge")
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions)} | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        named = "file://" + tempfile.mkdtemp(prefix="loreforge-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def version(spark: SparkSession, paths: list[str]) -> str:
    """A name for what the files under ``paths`` hold now: it changes with their names, sizes and times."""
    facts = []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in sorted(paths):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(conf).listFiles(p, True)
        while found.hasNext():
            f = found.next()
            facts.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(facts)).encode()).hexdigest()[:24]


def kept_table(spark: SparkSession, name: str, of: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of the version ``of``: made and written by the first who asks, read by all later ones.

    The success marker of the writer tells a whole table from one that was broken off.
    """
    path = f"{scratch(spark)}/{name}-{of}"
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        atexit.register(_drop, spark, path)
    return spark.read.parquet(path)


def counted_table(df: DataFrame, cond: Column, name: str = "t") -> tuple[DataFrame, int]:
    """``table`` and how many of its rows meet ``cond``, counted while they are written."""
    seen = Observation()
    out = table(df.observe(seen, F.count_if(cond).alias("n")), name)
    return out, seen.get["n"]


def observed_table(df: DataFrame, name: str = "t", **facts: Column) -> tuple[DataFrame, dict]:
    """``table`` and aggregates of its rows, taken while they are written."""
    seen = Observation()
    out = table(df.observe(seen, *[c.alias(n) for n, c in facts.items()]), name)
    return out, seen.get


def table(df: DataFrame, name: str = "t", partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Unlike ``localCheckpoint`` the result outlives any executor, and unlike
    ``checkpoint`` it is columnar and compressed, so later reads prune columns.
    The table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)
