"""Entity matching and idempotent loading."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def exact_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(id, name) to the most active of right(id, name, activity) with the same name key; ties by id."""
    # An aggregate, so that rows of one key are reduced before they are shuffled.
    best = right.groupBy(T.name_key("name").alias("key")).agg(F.min(F.struct((-F.coalesce("activity", F.lit(0))).alias("less"), F.col("id").alias("match_id"))).alias("best"))
    best = best.select("key", "best.match_id", (-F.col("best.less")).alias("activity"))
    return left.select("id", "name", T.name_key("name").alias("key")).join(best, "key", "left").select("id", "name", "match_id", "activity")


def fuzzy_match(left: DataFrame, right: DataFrame, least: float = 0.5, k: int = 3) -> DataFrame:
    """Up to k candidates that share significant name words: overlap, then Jaccard, then activity, then id."""
    a = left.select("id", T.significant("name").alias("words")).distinct()
    b = right.select(F.col("id").alias("match_id"), T.significant("name").alias("other"), F.coalesce("activity", F.lit(0)).alias("activity"))
    b = b.groupBy("match_id", "other").agg(F.max("activity").alias("activity"))
    # Names of the same words have the same scores: each set of words is compared once, and only its k first ids can be among the k best.
    first = Window.partitionBy("other").orderBy(F.desc("activity"), "match_id")
    b = b.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r")
    # The smaller of two near sets has one of its rarest words in common with the other: frequent words are met by few sets.
    left, right = a.select("words").distinct(), b.select("other").distinct()
    often = left.select(F.explode("words").alias("w")).union(right.select(F.explode("other").alias("w"))).groupBy("w").agg(F.count("*").alias("often"))

    def rarest(sets: DataFrame, column: str) -> DataFrame:
        """column, w: so many of each set's words, the rarest first, that the others are too few for a near set."""
        each = sets.select(column, F.explode(column).alias("w")).join(often, "w").groupBy(column).agg(F.array_sort(F.collect_list(F.struct("often", "w"))).alias("__o"))
        first = F.size("__o") - F.greatest(F.lit(1), F.ceil(F.lit(least) * F.size("__o"))).cast("int") + 1
        return each.select(column, F.explode(F.slice("__o", F.lit(1), first)).alias("__r")).select(column, F.col("__r.w").alias("w"))
    whole = lambda sets, column: sets.select(column, F.explode(column).alias("w"))
    small = rarest(left, "words").join(whole(right, "other"), "w").where(F.size("words") <= F.size("other")).select("words", "other")
    large = whole(left, "words").join(rarest(right, "other"), "w").where(F.size("words") > F.size("other")).select("words", "other")
    sets = small.union(large).distinct()
    shared = F.size(F.array_intersect("words", "other"))
    sets = sets.withColumns({"overlap": shared / F.least(F.size("words"), F.size("other")), "jaccard": shared / F.size(F.array_union("words", "other"))}).where(F.col("overlap") >= least)
    best = [F.desc("overlap"), F.desc("jaccard"), F.desc("activity"), "match_id"]
    pairs = sets.join(b, "other").withColumn("of", F.row_number().over(Window.partitionBy("words", "match_id").orderBy(*best))).where("of = 1")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("words").orderBy(*best))).where(F.col("rank") <= k).drop("other", "of", "rank")
    pairs = a.join(pairs, "words").dropDuplicates(["id", "match_id"])
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*best))).where(F.col("rank") <= k).select("id", "match_id", "overlap", "jaccard", "rank")


def insert_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys are not there yet; the new rows themselves are not merged."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def fill(old: str, new: str, force: bool = False):
    """Update that fills nulls only, unless forced."""
    return F.coalesce(F.col(new), F.col(old)) if force else F.coalesce(F.col(old), F.col(new))


def with_drafts(df: DataFrame) -> DataFrame:
    """Each row as a draft and as a published row."""
    return df.withColumn("published", F.explode(F.array(F.lit(False), F.lit(True))))


def geocode(places: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """places(place) to gazetteer(priority, city, lat, lng): equal folded names, else the first city that the place holds."""
    p = places.withColumn("folded", T.collapse(T.fold("place")))
    keys = gazetteer.withColumn("key", T.fold("city")).where("key != ''")
    # Each distinct place is cut into the lengths that city names have, so that holding a city is an equality.
    sizes = sorted(r[0] for r in keys.select(F.length("key")).distinct().collect() if r[0])
    cuts = F.array_distinct(F.flatten(F.array(*(F.expr(f"case when length(folded) >= {n} then transform(sequence(1, length(folded) - {n - 1}), i -> substring(folded, i, {n})) else cast(array() as array<string>) end") for n in sizes or [1]))))
    best = p.select("folded").where("folded is not null").distinct().select("folded", F.explode(cuts).alias("key")).join(keys, "key")
    best = best.groupBy("folded").agg(F.min(F.struct((F.col("folded") != F.col("key")).alias("part"), "priority", "lat", "lng")).alias("b"))
    return p.join(best, "folded", "left").select(*places.columns, "b.lat", "b.lng")
