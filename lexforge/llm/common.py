"""Helpers shared by the training-data operators: table access and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

#: Word separators of every contract here: space and U+0009 to U+000D.
WHITE_SPACE = " \t\n\x0b\x0c\r"
NOT_WORD = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where it is unset, a local master gets a temporary one,
    and any other an error: there, a folder of the driver's machine would not be seen by executors."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lexforge-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a lineage cut that outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexforge/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexforge_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by cut() that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_lexforge_path", None):
            delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage (plans, broadcasts and compiled classes of queries that have ended) and then
    give back to the system what its C library holds free. A loop of many queries else fills the whole heap, which only a
    full collection gives back, and compilers and class loading leave hundreds of MB in the C library, which keeps them."""
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Has the C library of the driver's JVM give back its free memory; False where that JVM has no such command."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    types, args = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[i] = jvm.java.lang.Class.forName(name)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:  # by reflection: the server's own class is not open to callers
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return False
    return True


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, a table of short rows made by cut(), marked for broadcast if it has at most ``most`` rows; else as it is,
    so that joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch of texts, so that a worker holds few long texts at once. Frames are lazy, so the bound is
    the same for all operators and stays set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null: none."""
    return F.coalesce(F.array_remove(F.split(text, f"{NOT_WORD}++"), ""), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def printed_bytes() -> list[str]:
    """The character that prints each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    alphabet = sorted(ByteLevel.alphabet())
    own = [ord(c) for c in alphabet if ord(c) < 256]
    others = dict(zip(sorted(set(range(256)) - set(own)), alphabet[len(own) :], strict=True))
    return [others.get(b, chr(b)) for b in range(256)]
