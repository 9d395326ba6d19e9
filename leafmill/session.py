"""Session defaults, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: A side is broadcast only if its measured bytes stay below this limit.
BROADCAST_BYTES = 64 << 20


def build_session(app: str = "leafmill", master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """A session with UTC time and adaptive execution; cluster settings are left to the cluster."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one all executors share (spark.checkpoint.dir). Only where everything runs on
    this machine may the setting be missing: then a local folder is used. It is removed when the driver's Python ends."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _OWN:
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if where is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = where or "file://" + tempfile.mkdtemp(prefix="leafmill-")
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(where)
        _OWN[app] = f"{where.rstrip('/')}/leafmill-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _OWN[app])
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; what is left is in the shared folder
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later uses don't compute it again."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a broadcast table."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 24 + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return 48 + 2 * F.coalesce(F.octet_length(F.to_json(F.struct(value.alias("v")))), F.lit(0))
    return F.lit(8)


def _row_width(df: DataFrame) -> Column:
    """Bytes of a row with what its headers, pointers and its share of a half-filled table of hashes take."""
    return sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(96))


def measured(df: DataFrame) -> int:
    """Bytes of ``df`` as a broadcast table, from all its rows."""
    return df.agg(F.sum(_row_width(df).cast("bigint"))).head()[0] or 0


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that isn't broadcast. Without a word Spark broadcasts what it takes to be small, and its
    guess, the bytes of compressed files however much is made of their rows, may be a hundred times too low."""
    return df.hint("merge")


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already cut, so it isn't computed again) to be broadcast if it is measured to be small, else shuffled."""
    return F.broadcast(df) if measured(df) <= limit else shuffled(df)


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row of each key; rows with a null key can't be told to be repeats and all stay."""
    return df.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(df.filter(F.col(key).isNull()))


def drop_redelivered(df: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` without later deliveries of a key, found from (key, order) alone: only keys delivered more than once meet
    the rows again, broadcast where they are counted to be few. Of deliveries equal in ``order``, too, one stays; only
    their rows are shuffled, if there are any. Rows with a null key all stay."""
    each = df.groupBy(key, order).agg(F.count("*").alias("_c")).filter(F.col(key).isNotNull())
    again = each.groupBy(key).agg(F.sum("_c").alias("_n"), F.min(order).alias("_first"), F.min_by("_c", order).alias("_ties"))
    again = cut(again.filter("_n > 1").select(key, "_first", (F.coalesce("_ties", F.lit(2)) > 1).alias("_tied")))
    found = again.agg(F.count_if("_tied").alias("ties"), F.sum(_row_width(again).cast("bigint")).alias("bytes")).head()
    marked = df.join(F.broadcast(again) if (found["bytes"] or 0) <= BROADCAST_BYTES else shuffled(again), key, "left")
    marked = marked.filter(F.col("_first").isNull() | F.coalesce(F.col(order) <= F.col("_first"), F.lit(False)))
    tied = F.coalesce("_tied", F.lit(False))
    if found["ties"]:
        one = marked.filter(tied).dropDuplicates([key])
        marked = marked.filter(~tied).unionByName(one)
    return marked.drop("_first", "_tied")
