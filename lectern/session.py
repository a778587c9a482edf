"""Session settings and the shipping of this package to Python workers."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def session(name: str = "lectern", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine relies on; the cluster decides the rest."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is
    unset, a local session gets a folder of its own, and a cluster an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir is not set, and executors of {master} share no other folder")
        place = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


#: Spark's own switch: delete the shuffle files of a query as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back, so that
    a lost executor costs a reread, not a recomputation.  Nothing needs the shuffle files
    of the write once it has ended; they are deleted."""
    path = f"{shared_dir(df.sparkSession)}/lectern-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEAN_UP) if before is None else conf.set(CLEAN_UP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent).as_posix())
    place = Path(tempfile.mkdtemp(prefix="lectern-code-")) / "lectern.zip"
    place.write_bytes(data.getvalue())
    sc.addPyFile(str(place))
    _shipped.add(sc.applicationId)


def run_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
