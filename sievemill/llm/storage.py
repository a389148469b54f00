"""Tables and files in the folder that the cluster shares.

``spark.checkpoint.dir`` names the folder.  Only where it is unset and all tasks
run on this machine (tests) a temporary folder is made; elsewhere that is an
error.  Lineage is cut by writing a table there and
reading it back, so a lost executor costs a re-read, never a restart.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Paths that this driver has handed out.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sievemill-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def made() -> int:
    """How many paths have been handed out; `sweep` takes it."""
    return len(_MADE)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession, since: int, kept: DataFrame) -> None:
    """Delete what was written since `made` said so, but for the table `kept`, which no longer depends on it."""
    own = {part for f in kept.inputFiles() for part in f.split("/")[:-1]}
    gone = [p for p in _MADE[since:] if p.rpartition("/")[2] not in own]
    for path in gone:
        _delete(spark, path)
    _MADE[since:] = [p for p in _MADE[since:] if p not in gone]


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back."""
    path = fresh(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            _delete(spark, path)


def free(taken: Iterable[str], *names: str) -> list[str]:
    """`names`, each with as many underscores behind as it takes to be none of `taken`, nor the same but for case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def n_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(df: DataFrame, rows: int = 2000, size: int = 16 << 20) -> DataFrame:
    """`df`; from now on its session hands Python Arrow batches of whole texts that are small beside a worker's memory."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = df.sparkSession.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            df.sparkSession.conf.set(key, str(most))
    return df
