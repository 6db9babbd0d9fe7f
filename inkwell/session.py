"""Session set-up shared by the command line, the bench and the tests."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(name: str = "inkwell", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; the master and the sizes come from the cluster, or from `conf`."""
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false", "spark.sql.parquet.pushdown.inFilterThreshold": "1000"}
    builder = SparkSession.builder.appName(name)
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that Python workers find it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="inkwell-ship-"), "inkwell.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset on one machine, as in tests, a temporary one is set.

    A cluster must name one: a folder of the driver's machine is not there for the executors.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(sc, "_inkwell_dir", None)
        if at is None:
            keep = tempfile.TemporaryDirectory(prefix="inkwell-")
            atexit.register(keep.cleanup)
            at = sc._inkwell_dir = "file://" + keep.name
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage by checkpoint() in the shared folder, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _fs(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, at: str) -> None:
    path, fs = _fs(spark, at)
    fs.delete(path, True)


def read_text(spark: SparkSession, at: str) -> str | None:
    """A small file of any Hadoop file system, None if it is not there."""
    path, fs = _fs(spark, at)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, at: str, text: str, *, replace: bool = True) -> bool:
    """Writes a small file whole, by a rename; without `replace` False if another one is there already."""
    jvm = spark._jvm
    path, fs = _fs(spark, at)
    draft, _ = _fs(spark, f"{at}.{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE if replace else option.NONE
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(path), options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if not replace and "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True
