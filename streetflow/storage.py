"""The folder that the driver and all executors share: tables that cut the lineage, and small files of state."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a folder of this machine is set if Spark runs in this process only;
    on a cluster it must be set, since executors don't see each other's disks."""
    base = spark.conf.get(SETTING, None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{SETTING} must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="streetflow-")
        atexit.register(shutil.rmtree, folder, True)
        base = f"file://{folder}"
        spark.conf.set(SETTING, base)
    return f"{base.rstrip('/')}/streetflow-{uuid.uuid4().hex}"


def table(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut of the lineage that outlives any executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    trim(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._streetflow_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_streetflow_path", None):
            files, where = file_system(t.sparkSession, path)
            files.delete(where, True)


def trim(spark: SparkSession) -> bool:
    """Has the driver's JVM give the native memory that it has freed back to the machine: compiling the plans of some hundred stages
    leaves its allocator some hundred MB. False where the JVM can't."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(beans, args)
    except Py4JError:
        return False
    return True


def file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = file_system(spark, path)
    return files.exists(where)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced as a whole: written beside the old one, then renamed."""
    files, where = file_system(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    out = files.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(where, False)
    files.rename(new, where)


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; after a stop between put_text's last two steps that of the new one."""
    for name in (path, f"{path}.new"):
        if exists(spark, name):
            return spark.read.text(name, wholetext=True).first()[0]
    return None
