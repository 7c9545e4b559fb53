"""Shared helpers: table access, the folder that driver and executors share, and joins that stay even under hot keys."""
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a task may take; keys with more are dealt over shares.
SHARE = 10_000
#: Ids (a long each) up to which a counted list is broadcast.
IDS = 4_000_000
#: Bytes of a batch sent to a Python worker; a longer row goes alone.
BATCH = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); only where it is unset in local mode, as in tests, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "/tmp/quirefold-shared"
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete written tables that no later result reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df itself, after limiting the session's Arrow batches to BATCH bytes; a smaller limit of the caller's stays.

    By rows alone a batch, which both the JVM and the worker hold, would grow with the length of texts."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH:
        spark.conf.set(key, str(BATCH))
    return df


def restricted(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", most: int = IDS) -> DataFrame:
    """Rows of df whose key is (left_semi) or isn't (left_anti) in the written one-column table ids.

    Ids counted to be at most ``most`` are broadcast, so wide rows of df stay where they are; beyond that both are shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids.hint("merge"), key, how)


def meet(big: DataFrame, small: DataFrame, key: str, counts: DataFrame | None = None, share: int = SHARE, how: str = "inner") -> DataFrame:
    """big joined with small on key, where no key of big lands in one task with more than ``share`` rows or so.

    counts(key, n) has the rows of big by key (counted here if None). Keys with more than ``share`` are few, at most one
    for each ``share`` rows of big, and are broadcast; their rows are dealt over shares by a hash of the row, and small's
    rows repeated for each. big must be cheap to read twice, and hold no null keys."""
    counts = big.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    hot = F.broadcast(counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("long").alias("__shares")))
    plain = [c for c in big.columns if big.schema[c].dataType.simpleString() in ("bigint", "int", "string", "binary")]
    left = big.join(hot, key, "left").withColumn("__share", F.when(F.col("__shares").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*plain), "__shares"))).drop("__shares")
    right = small.join(hot, key, "left").withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__shares", F.lit(1).cast("long")) - 1))).drop("__shares")
    return left.join(right, [key, "__share"], how).drop("__share")
