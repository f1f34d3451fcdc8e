"""Session helpers shared by every operator: table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a table's values up to which it may be broadcast; its hash table takes some three times as much.
BROADCAST_BYTES = 64 << 20
#: Bytes that a row and each value of varying length count for besides their contents.
ROW, VALUE = 16, 8


def build_session(app: str = "tarnflow", cpus: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delete_at_end(spark: SparkSession, folder: str) -> None:
    """Has a folder deleted when the application ends."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where none is set, a temporary one, on a local master only.

    A folder set here is deleted when the application ends; one that was set before is left to its owner.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tarnflow-checkpoint-"))
        delete_at_end(spark, sc.getCheckpointDir())
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of an executor and has no lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") + VALUE
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(VALUE).cast("bigint"))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.aggregate(c, F.lit(VALUE).cast("bigint"), lambda n, x: n + _bytes(x, kind.elementType)), F.lit(0).cast("bigint"))
        return F.greatest(F.size(c), F.lit(0)).cast("bigint") * 8 + VALUE
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(c), T.ArrayType(kind.keyType)) + _bytes(F.map_values(c), T.ArrayType(kind.valueType))
    return F.lit(8).cast("bigint")


def measure(df: DataFrame) -> tuple[int, int]:
    """The rows of a table and the bytes of all its values, counted where they are."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW).cast("bigint"))
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()
    return n["rows"], n["bytes"]


def weigh(df: DataFrame) -> int:
    """The bytes of all values of a table."""
    return measure(df)[1]


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` cut and, if its values have at most ``most`` bytes (BROADCAST_BYTES), marked for broadcast; larger ones join by shuffle."""
    kept = cut(df)
    return F.broadcast(kept) if weigh(kept) <= (BROADCAST_BYTES if most is None else most) else kept
