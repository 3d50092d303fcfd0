"""Source snapshots: what changed, whether anything changed, what has to be rebuilt."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = ["path", "length", "modified"]


def collect_state(files: DataFrame) -> DataFrame:
    """The state of a file listing; the files' bytes are not read."""
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    """A saved state, or None where there is none or it cannot be read."""
    try:
        df = spark.read.parquet(path)
        return df.select(*STATE)
    except AnalysisException:
        return None
    except Exception as e:  # a damaged file surfaces as a Java error while its footer is read
        if "CANNOT_READ_FILE" in str(e) or "FAILED_READ_FILE" in str(e) or "footer" in str(e):
            return None
        raise


def save_state(state: DataFrame, path: str) -> None:
    state.select(*STATE).write.mode("overwrite").parquet(path)


def diff(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Every path with its status: added, removed, modified or same. Paths are unique on both sides."""
    s = saved.select("path", F.struct("length", "modified").alias("old"))
    c = current.select("path", F.struct("length", "modified").alias("new"))
    status = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(~F.col("old").eqNullSafe(F.col("new")), "modified")
        .otherwise("same")
    )
    return s.join(c, "path", "full").select("path", status.alias("status"))


def changed(saved: DataFrame | None, current: DataFrame) -> bool:
    """Whether a rebuild is due; no saved state counts as a change. Stops at the first difference."""
    if saved is None:
        return True
    return not diff(saved, current).where(F.col("status") != "same").isEmpty()


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number differs between two tables, with that difference.

    One aggregation instead of two set differences; copies are counted map-side.
    """
    cols = a.columns
    marked = a.select(*cols, F.lit(1).alias("__w")).unionByName(b.select(*cols, F.lit(-1).alias("__w")))
    return marked.groupBy(*cols).agg(F.sum("__w").alias("surplus")).where(F.col("surplus") != 0)


def tables_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same rows, and how many rows differ."""
    return differences(a, b).agg(
        (F.count("*") == 0).alias("equal"), F.coalesce(F.sum(F.abs("surplus")), F.lit(0)).alias("differing")
    )


def rebuild_plan(saved: DataFrame | None, current: DataFrame, force: bool = False) -> DataFrame:
    """Per path: ``build``, ``drop`` or ``keep``. Modified paths are dropped and built again."""
    if saved is None or force:
        plan = current.select("path", F.lit("build").alias("action"))
        if saved is not None:
            gone = saved.join(current, "path", "left_anti").select("path", F.lit("drop").alias("action"))
            plan = plan.unionByName(gone)
        return plan
    action = (
        F.when(F.col("status").isin("added", "modified"), "build")
        .when(F.col("status") == "removed", "drop")
        .otherwise("keep")
    )
    return diff(saved, current).select("path", action.alias("action"))
