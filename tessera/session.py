"""Session helpers.

``get_session`` builds a local session for tests and the bench; on a cluster
the caller passes its own session and only ``checkpoint_dir`` is consulted.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("TESSERA_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("TESSERA_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    It is a launch-time setting: read it from the session.  Only when it is
    unset and the master is local (tests) is a private scratch folder created
    and registered with the context, once per session; on a cluster a folder
    of one machine would lose rows, so there an unset folder is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    # the context may have appended a unique subfolder; use what it reports
    return sc.getCheckpointDir() or d


def landed(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written to a new table of the shared folder, in a folder for each
    value of ``partition_by`` if given, and read back: its rows are fixed from
    here on, and lineage ends."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch of rows for a Python worker, where the session sets no limit.
BATCH_BYTES = 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Rows go to the Python workers in batches of a few MB.  Executor and
    worker each hold a batch more than once, and the default is 10,000 rows
    however long.  A limit that the session has stays."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in the Python workers.

    Arrow functions and stateful stream functions defined at module level
    are pickled by reference, so executors must be able to import the
    package.  It is zipped once per application and registered with
    ``addPyFile`` (the runtime form of ``--py-files``): Spark's file server
    ships the archive to every executor.
    """
    import shutil

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    ckpt = checkpoint_dir(spark)
    if ckpt.startswith("file:"):
        ckpt = ckpt[len("file:"):]
    if "://" in ckpt:
        # a cluster store (hdfs://, s3a://): the archive only has to exist on
        # the driver, whose file server ships it; executors never read it
        dest = tempfile.mkdtemp(prefix=f"tessera-pyfiles-{app}-")
    else:
        dest = os.path.join(ckpt, f"tessera-pyfiles-{app}")
        os.makedirs(dest, exist_ok=True)
    archive = shutil.make_archive(os.path.join(dest, "tessera"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="tessera")
    sc.addPyFile(archive)
    _SHIPPED.add(app)
