"""Shared scratch storage: where derived tables are written to cut lineage.

On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared file
system every executor and the driver can reach). Only a local-mode session
without that setting gets a private temporary folder, as in tests.
"""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.RLock()
_MEMO: dict[tuple[str, str], str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session (set one only in local mode)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder (HDFS, S3, ...)"
        )
    path = tempfile.mkdtemp(prefix="contactlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def fingerprint(*parts: object) -> str:
    """Stable key for a derived table: its version, and its inputs as they are now.

    A part that names an existing file or folder of any file system counts
    with the path, length and modification time of every file in it.
    """
    sc = SparkSession.getActiveSession().sparkContext
    h = hashlib.sha1()
    for p in parts:
        h.update(repr(p).encode())
        if isinstance(p, str) and "/" in p:
            path = sc._jvm.org.apache.hadoop.fs.Path(p)
            fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
            if fs.exists(path):
                files, found = fs.listFiles(path, True), []
                while files.hasNext():
                    f = files.next()
                    found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
                h.update("\n".join(sorted(found)).encode())
    return h.hexdigest()[:16]


def materialize(spark: SparkSession, df: DataFrame | Callable[[], DataFrame], name: str,
                key: str) -> DataFrame:
    """Write ``df`` once as Parquet under the scratch folder and read it back.

    ``df`` may be a builder, called only when the table is not written yet.
    The written table cuts the lineage (a lost executor recomputes from the
    files, not from the sources) and gives later queries column pruning and
    filter pushdown. Each build writes its own folder and then publishes it
    in a one-row ``_done`` marker table; readers follow the marker, so a
    half-written or concurrently written table is never read.
    """
    base = f"{scratch_dir(spark)}/contactlens/{name}-{key}"
    memo_key = (spark.sparkContext.applicationId, base)
    with _LOCK:
        if memo_key not in _MEMO:
            marker = f"{base}/_done"
            if not exists(spark, marker):
                data = f"{base}/data-{uuid.uuid4().hex[:12]}"
                (df() if callable(df) else df).write.mode("errorifexists").parquet(data)
                spark.createDataFrame([(data,)], "path string").coalesce(1) \
                    .write.mode("overwrite").parquet(marker)
            _MEMO[memo_key] = spark.read.parquet(marker).first()["path"]
    return spark.read.parquet(_MEMO[memo_key])


def exists(spark: SparkSession, path: str) -> bool:
    """Path test on whatever file system the path names (HDFS, S3, local)."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p))
