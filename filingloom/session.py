"""Session settings, table loading and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app: str = "filingloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; a cluster's own values win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # texts are long: fewer rows per Arrow batch keep Python workers small
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Arrow functions are found by module name on the workers, which need not share
    the driver's folders. Helpers that use such functions call this themselves.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="filingloom-code-"), "filingloom")
    shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(f"{archive}.zip")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; naive timestamps become session-zone timestamps (UTC)."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, for heavy work per row on tables of few row groups.

    A file is read by no more tasks than it has row groups, however long each row takes.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts)


_local_roots: dict[str, str] = {}


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent a local master (tests, a laptop) gets a local folder, one
    per application. On a cluster that would be another folder on each machine, so there
    the setting is required.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="filingloom-")
        root = _local_roots[app]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a folder made with :func:`scratch_dir` that no table is read from any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, dropping its lineage."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; ``right``'s keys are dropped."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    joined = left.join(named, reduce(Column.__and__, same), how)
    return joined.drop(*[f"_right_{k}" for k in keys])
