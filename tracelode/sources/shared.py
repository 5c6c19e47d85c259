"""The folder that driver and executors share (spark.checkpoint.dir), and tables kept there while an application runs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system's scheme and host, as Spark itself would complete it; an absolute one where the path is not."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()


#: Schemes of Hadoop's file systems that Arrow knows by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def arrow_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path, for Python workers, and the path there."""
    scheme, _, rest = path.partition(":") if re.match(r"[a-z][a-z0-9+.-]*:/", path) else ("file", "", path)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which goes when the application ends. Where that is unset, local sessions get a folder of their own, and clusters an error."""
    sc = spark.sparkContext
    if sc.applicationId not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        root = qualified(spark, f"{base or 'file://' + tempfile.gettempdir()}/tracelode-{uuid.uuid4().hex[:12]}")
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots[sc.applicationId] = root
    return f"{_roots[sc.applicationId]}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df in the shared folder and read it back: later work does not repeat it, and lost executors cost nothing."""
    path = run_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
