"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "inkfield", **conf) -> SparkSession:
    """Session with the settings the library relies on; cluster settings win when present.

    Shuffle partitions are left to the cluster (AQE coalesces them); ``conf`` keys use ``__`` for dots.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",  # the last one counts
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package known to the Python workers, once per application.

    Spark sends the archive to every executor, wherever the driver was started.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="inkfield-")) / "inkfield.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else the session's warehouse.

    A folder of one machine is refused under a master that has others.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    base = (base or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    scheme = base.partition(":")[0] if ":" in base else "file"
    if scheme == "file" and not context.master.startswith("local") and not spark.conf.get("spark.checkpoint.dir", None):
        raise ValueError(f"{base} is a folder of one machine; name a shared one in spark.checkpoint.dir")
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so retries cannot mix runs."""
    return f"{shared_folder(spark)}/inkfield/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Rows of a plain scan dealt out evenly when the input has too few splits to keep the cores busy.

    Meant in front of costly work per row. An input with more than two splits per core, and so any large
    one, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= 2 * cores else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage without tying the data to an executor: a lost executor costs one task, not the table.
    Used where a result is scanned several times and must be the same each time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
