"""Tables on shared storage that change sets are applied to: rows lie in buckets of their key, and only touched buckets are rewritten."""
import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of the table itself: the bucket (a folder each), the batch that last rewrote it, and whether a row holds data or only tells the batch.
OWN = ("_bucket", "_batch", "_live")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares (spark.checkpoint.dir); a local one where that is unset in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/quirefold-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, worked out once: written to a new shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")


def _told(df: DataFrame, batch: str, touched: DataFrame) -> DataFrame:
    """df (with _bucket) and a row a touched bucket that tells the batch, so that an emptied bucket tells it too."""
    live = df.withColumns({"_batch": F.lit(batch), "_live": F.lit(True)})
    marks = touched.select("_bucket").distinct().select(*(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns if c != "_bucket"), "_bucket", F.lit(batch).alias("_batch"), F.lit(False).alias("_live"))
    return live.unionByName(marks)


def create(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Write a table whose rows lie in buckets by a hash of their keys."""
    df = df.withColumn("_bucket", _bucket(keys, buckets))
    rows = _told(df, "", df.limit(0)).repartition("_bucket")
    rows.write.partitionBy("_bucket").parquet(f"{path}/rows")
    told = (json.dumps(keys), buckets, rows.schema.json())
    df.sparkSession.createDataFrame([told], "keys string, buckets int, schema string").coalesce(1).write.parquet(f"{path}/keys")


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], int]:
    told = spark.read.parquet(f"{path}/keys").first()
    schema = StructType.fromJson(json.loads(told["schema"]))
    return spark.read.schema(schema).parquet(f"{path}/rows"), json.loads(told["keys"]), told["buckets"]


def read(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path)[0].where("_live").drop(*OWN)


def applied(spark: SparkSession, path: str) -> dict[str, dict]:
    """Counts of each batch that has been applied to the end."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batches")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return {}
    return {r["batch"]: json.loads(r["counts"]) for r in spark.read.parquet(f"{path}/batches").collect()}


def _merged(path: str, changes: DataFrame, batch: str, how: str, add: str | None) -> tuple[DataFrame, DataFrame, Observation]:
    """(rows of the touched buckets after the changes, changes with their bucket, counts by action)."""
    spark = changes.sparkSession
    stored, keys, buckets = _stored(spark, path)
    columns = [c for c in stored.columns if c not in OWN]
    changes = changes.withColumn("_bucket", _bucket(keys, buckets))
    # Buckets that a broken run of this very batch has rewritten are left as they are.
    done = [r[0] for r in stored.where(F.col("_batch") == batch).select("_bucket").distinct().collect()]
    changes = changes.where(~F.col("_bucket").isin(*done)) if done else changes
    touched = sorted(r[0] for r in changes.select("_bucket").distinct().collect())
    held = stored.where("_live").where(F.col("_bucket").isin(*touched) if touched else F.lit(False)).drop("_batch", "_live")
    side = lambda df, name: df.select("_bucket", *keys, F.struct(*(c for c in df.columns if c not in ("_bucket", *keys))).alias(name))
    old, new = side(held, "old"), side(changes, "new")
    same = (old["_bucket"] == new["_bucket"])
    for k in keys:
        same = same & old[k].eqNullSafe(new[k])
    both = old.join(new, same, "full")
    plain = [F.coalesce(new[k], old[k]).alias(k) for k in keys] + [F.coalesce(new["_bucket"], old["_bucket"]).alias("_bucket"), "old", "new"]
    both = both.select(*plain)
    values = [c for c in columns if c not in keys]
    gone = F.coalesce(F.col("new._delete"), F.lit(False)) if "_delete" in changes.columns else F.lit(False)

    def after(c: str) -> Column:
        if c not in changes.columns:
            return F.col(f"old.{c}")
        if c == add:
            return F.coalesce(f"old.{c}", F.lit(0)) + F.coalesce(f"new.{c}", F.lit(0))
        if how == "fill":
            return F.coalesce(f"old.{c}", f"new.{c}")
        return F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
    both = both.withColumn("_after", F.struct(*(after(c).alias(c) for c in values)) if values else F.struct(F.lit(0).alias("_none")))
    if add:
        gone = gone | (F.coalesce(f"_after.{add}", F.lit(0)) == 0)
    was = F.struct(*(F.col(f"old.{c}").alias(c) for c in values)) if values else F.col("_after")
    action = (F.when(F.col("new").isNull(), "kept").when(gone & F.col("old").isNull(), "skipped").when(gone, "deleted").when(F.col("old").isNull(), "created")
              .when(was.eqNullSafe(F.col("_after")), "skipped").otherwise("updated"))
    both = both.withColumn("_action", action)
    counts = Observation()
    seen = both.observe(counts, *(F.count(F.when(F.col("_action") == a, 1)).alias(a) for a in ("created", "updated", "skipped", "deleted")))
    # Written so that the changes and what they meet are worked out once.
    rows = seen.where(~((F.col("_action") == "deleted") | F.col("old").isNull() & (F.col("_action") == "skipped"))).select(*keys, *(F.col(f"_after.{c}").alias(c) for c in values), "_bucket").select(*columns, "_bucket")
    return rows, changes, counts


def dry_run(path: str, changes: DataFrame, how: str = "replace", add: str | None = None) -> dict[str, int]:
    """What apply() would count, from the same plan, nothing written."""
    rows, _, counts = _merged(path, changes, str(uuid.uuid4()), how, add)
    rows.write.format("noop").mode("overwrite").save()
    return counts.get


def apply(path: str, changes: DataFrame, batch: str, how: str = "replace", add: str | None = None) -> dict[str, int]:
    """Apply changes (keys, some of the columns, and _delete if rows go) to a table, and return counts by action.

    Of a known key the given columns replace the stored ones (how='replace'), or fill its nulls (how='fill'); columns not
    given stay. Other keys are created, unless they are to go. With ``add`` that column's changes are signed amounts, and
    a row that reaches zero goes. Keys of changes must be unique; nulls in them count as equal.
    Only buckets with changed keys are rewritten, each as a whole, in one pass that also counts. A batch that was applied
    before changes nothing and gives its counts anew. After a lost driver a repeat goes on with the buckets that are left;
    its counts are then those of the rest."""
    spark = changes.sparkSession
    known = applied(spark, path)
    if batch in known:
        return known[batch]
    rows, changed, counts = _merged(path, changes, batch, how, add)
    # Rows leave through a new folder: a bucket is never read while it is replaced.
    staged = f"{path}/staged/{uuid.uuid4().hex}"
    _told(rows, batch, changed).repartition("_bucket").write.partitionBy("_bucket").parquet(staged)
    found = counts.get
    spark.read.schema(_stored(spark, path)[0].schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{path}/rows")
    spark.createDataFrame([(batch, json.dumps(found))], "batch string, counts string").coalesce(1).write.mode("append").parquet(f"{path}/batches")
    gone = spark._jvm.org.apache.hadoop.fs.Path(staged)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return found
