"""Things several operators share: word splitting, tables that cut a lineage, the shared folder."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, for Java's and Python's regular expressions alike.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once per row, however often body uses it.

    Inside a higher-order function an outer expression is evaluated again for each
    element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where spark.checkpoint.dir is unset, a local folder is made and used if the session
    runs in one process (as in tests); on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="quillon-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def written(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, and where it lies: its lineage is cut, lost executors cost
    nothing that came before, and a reader takes the columns it needs."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.parquet(at)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(at), at


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared folder."""
    return written(df)[0]


def give_back(spark: SparkSession) -> None:
    """Give memory that is free but held back to the system.

    Python's, Arrow's, and what compilers and codecs of the driver's JVM left in malloc's
    arenas, which grow by some MB with each plan of many operators and never shrink by themselves.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    methods = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()

    def call(name: str, *args):  # by the interface, as the server's own class isn't open to callers
        packed = gateway.new_array(jvm.java.lang.Object, len(args))
        for k, x in enumerate(args):
            packed[k] = x
        return next(m for m in methods if m.getName() == name and len(m.getParameterTypes()) == len(args)).invoke(server, packed)

    if call("isRegistered", commands) and any(o.getName() == "systemTrimNativeHeap" for o in call("getMBeanInfo", commands).getOperations()):
        call("invoke", commands, "systemTrimNativeHeap", None, None)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of a path of any scheme that Spark can open."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def create_once(spark: SparkSession, temp, final) -> bool:
    """Give a file its final name, at once and only if no other has it; else it goes, and False."""
    fs = temp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":  # where rename writes over what is there
        jvm = spark.sparkContext._jvm
        if fs.exists(final):
            done = False
        else:
            at = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, temp)]
            try:
                jvm.java.nio.file.Files.createLink(*at)
                done = True
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
                done = False
        fs.delete(temp, False)
        return done
    done = not fs.exists(final) and fs.rename(temp, final)
    if not done:
        fs.delete(temp, False)
    return done


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def text_slices(texts: pa.Array, most_bytes: int = 2 << 20, most_texts: int = 1 << 16) -> Iterator[pa.Array]:
    """A batch's texts in runs of about ``most_bytes`` (one text at least) and ``most_texts`` at most, so that what is made of them stays small."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(size):
        if held and held + n > most_bytes or k - start == most_texts:
            yield texts.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < len(size):
        yield texts.slice(start)
    pa.default_memory_pool().release_unused()  # workers live on between tasks
