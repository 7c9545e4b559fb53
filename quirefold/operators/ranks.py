"""Places of rows in their groups, however many rows a group has."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import buckets


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """rows with their place in the group, from 1 on, nulls first; a null group counts like any other.

    A window by the group would put it into one task. Instead rows are dealt by ranges of group and order, written once,
    and numbered range by range; the sizes of ranges before are added. Equal rows stand in any order."""
    # Equal rows are dealt by a random number too, else they would meet in one range.
    parts = rows.withColumn("__salt", F.rand(7)).repartitionByRange(group, *order, "__salt").withColumn("__part", F.spark_partition_id())
    parts = buckets.written(parts, "ranks")
    over = Window.partitionBy("__g")
    sizes = parts.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__ahead", F.coalesce(F.sum("__n").over(over.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = parts.withColumn(name, F.row_number().over(Window.partitionBy("__part", group).orderBy(*order, "__salt")))
    out = inside.join(sizes.drop("__n"), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return out.withColumn(name, (F.col(name) + F.col("__ahead")).cast("long")).select(*rows.columns, name)
