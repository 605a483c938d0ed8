"""Tables that a job writes for itself, in a folder that every executor shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: paths alone: functions that are sent to executors may carry their module's globals
_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset a fresh folder of this machine, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts lineage and survives lost executors.

    The table stays until ``discard`` or the end of the program, since results are read lazily."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for df in tables:
        _delete(df._tessera_path)


def _delete(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if path not in _written or spark is None:
        return
    _written.discard(path)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@atexit.register
def _clean() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session, and with it the way to the folder, may be gone
            return


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than those (a small file of one row group); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(name: str, taken) -> str:
    """``name``, lengthened until it clashes with none of ``taken`` (case-insensitively)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
