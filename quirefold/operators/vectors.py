"""TF-IDF in long form, sparse and dense cosine, drift and nearest neighbours."""
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..sources import buckets

# Worker code travels with the job, so executors need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tfidf(groups: DataFrame, by: list[str], column: str = "body", stopwords=T.STOPWORDS) -> DataFrame:
    """by, token, weight = n / length * (ln((1 + N) / (1 + df)) + 1); groups without tokens don't count in N."""
    return weighted(token_counts(groups, by, column, stopwords), by)


def token_counts(groups: DataFrame, by: list[str], column: str = "body", stopwords=T.STOPWORDS) -> DataFrame:
    # The tokens are a generated column's, so that no filter on them makes them again.
    held = groups.select(*by, F.explode(F.array(T.tokens(F.col(column), stopwords))).alias("tokens"))
    return held.select(*by, F.explode_outer("tokens").alias("token")).where("token is not null").groupBy(*by, "token").agg(F.count("*").alias("n"))


def weighted(counts: DataFrame, by: list[str]) -> DataFrame:
    """TF-IDF weights of counts(by, token, n)."""
    length = counts.groupBy(*by).agg(F.sum("n").alias("length"))
    df = counts.groupBy("token").agg(F.count("*").alias("df"))
    total = length.agg(F.count("*").alias("total"))  # one row
    out = counts.join(length, by).join(df, "token").crossJoin(F.broadcast(total))
    return out.select(*by, "token", (F.col("n") / F.col("length") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1)).alias("weight"))


def stylometry(left: DataFrame, right: DataFrame) -> DataFrame:
    """token, w1, w2 of two bodies of text."""
    both = left.select("body", F.lit(1).alias("side")).union(right.select("body", F.lit(2).alias("side")))
    side = lambda k: F.sum(F.when(F.col("side") == k, F.col("weight")).otherwise(0.0))
    return tfidf(both, ["side"]).groupBy("token").agg(side(1).alias("w1"), side(2).alias("w2"))


def style_distance(weights: DataFrame) -> DataFrame:
    dot, a, b = F.sum(F.col("w1") * F.col("w2")), F.sqrt(F.sum(F.col("w1") ** 2)), F.sqrt(F.sum(F.col("w2") ** 2))
    out = weights.agg(F.when((a > 0) & (b > 0), dot / (a * b)).otherwise(0.0).alias("similarity"))
    return out.withColumn("distance", 1 - F.col("similarity")).withColumn("label", T.distance_label(F.col("distance")))


def drift(articles: DataFrame, authors: DataFrame) -> DataFrame:
    """Per author and year: cosine distance to the mean vector and its z-score over all author-years.

    Counts, weights and distances are each used several times, so each is written once to the shared folder."""
    by = ["author", "year"]
    written = buckets.written
    counts = written(token_counts(articles.where("year is not null").join(authors.select("article_id", "author"), "article_id"), by), "counts")
    weights = written(weighted(counts, by), "weights")
    total = weights.select(*by).distinct().agg(F.count("*").alias("total"))
    centre = weights.groupBy("token").agg(F.sum("weight").alias("sum")).crossJoin(F.broadcast(total)).select("token", (F.col("sum") / F.col("total")).alias("c"))
    centre = written(centre, "centre")
    norm = centre.agg(F.sqrt(F.sum(F.col("c") ** 2)).alias("cn"))
    each = weights.join(centre, "token").groupBy(*by).agg(F.sum(F.col("weight") * F.col("c")).alias("dot"), F.sqrt(F.sum(F.col("weight") ** 2)).alias("vn"))
    each = written(each.crossJoin(F.broadcast(norm)).select(*by, (1 - F.col("dot") / (F.col("vn") * F.col("cn"))).alias("distance")), "distances")
    stats = each.agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"))
    return each.crossJoin(F.broadcast(stats)).withColumn("z", F.when(F.col("std") > 1e-12, (F.col("distance") - F.col("mean")) / F.col("std")).otherwise(0.0)).drop("mean", "std")


def style_words(weights: DataFrame, k: int = 10) -> DataFrame:
    """side, token, weight: the k tokens that weigh most more on the first side than on the second, and the reverse."""
    apart = F.round(F.col("w1") - F.col("w2"), 9)
    first = weights.orderBy(apart.desc(), "token").limit(k).select(F.lit(1).alias("side"), "token", F.col("w1").alias("weight"))
    return first.union(weights.orderBy(apart, "token").limit(k).select(F.lit(2).alias("side"), "token", F.col("w2").alias("weight")))


def trend(points: DataFrame) -> DataFrame:
    """author, points and trend of each trajectory of points(author, year, z)."""
    ends = points.groupBy("author").agg(F.count("*").alias("points"), (F.max_by("z", "year") - F.min_by("z", "year")).alias("difference"))
    return ends.select("author", "points", V.trend_label(F.col("points"), F.col("difference")).alias("trend"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: DataFrame, k: int = 200, least: float = 0.35) -> DataFrame:
    """vec_id and similarity of the k nearest rows to a one-row query, those of at least ``least``."""
    one = F.broadcast(query.select(F.col("embedding").alias("q"), "vec_id").orderBy("vec_id").limit(1).select("q"))
    out = vectors.crossJoin(one).select("vec_id", cosine("embedding", "q").alias("similarity"))
    return out.orderBy(F.desc_nulls_last("similarity"), "vec_id").limit(k).where(F.col("similarity") >= least)


def trends(vectors: DataFrame, categories: DataFrame, by: str = "label", least: float = 0.28, most: int = 10_000) -> DataFrame:
    """Rows per category and another column, as the year, of vectors as similar as ``least``.

    Categories go to the workers in blocks of about ``most``, dealt by a hash, and every block meets all vectors by
    matrix products over Arrow batches. Null vectors, vectors of another length and zero vectors are similar to none."""
    spark = vectors.sparkSession
    known = categories.select(F.col("vec_id").cast("long").alias("category"), F.col("embedding").cast("array<double>").alias("c")).where("category is not null and size(c) > 0 and not exists(c, x -> x is null)")
    blocks = max(1, -(-known.count() // most))
    kind = vectors.schema[by].dataType.simpleString()
    counts = None
    for i in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("category"), F.lit(blocks)) == i).toPandas()
        groups = [(np.array(own["category"]), np.array(own["c"].tolist())) for _, own in rows.groupby(rows["c"].map(len))] if len(rows) else []
        held = spark.sparkContext.broadcast([(ids, c / np.maximum(np.sqrt((c**2).sum(axis=1, keepdims=True)), 1e-300)) for ids, c in groups])

        def run(batches, held=held):
            for pdf in batches:
                out = []
                sizes = pdf["v"].map(lambda v: -1 if v is None else len(v))
                for ids, c in held.value:
                    own = pdf[sizes == c.shape[1]]
                    for lo in range(0, len(own), 1024):
                        part = own.iloc[lo:lo + 1024]
                        v = np.array(part["v"].tolist(), dtype="f8")
                        with np.errstate(invalid="ignore", divide="ignore"):
                            v = v / np.sqrt((v**2).sum(axis=1, keepdims=True))
                        row, column = np.nonzero(v @ c.T >= least)
                        out.append(pd.DataFrame({"category": ids[column], by: part[by].to_numpy()[row]}).groupby(["category", by], dropna=False).size().reset_index(name="n"))
                if out:
                    yield pd.concat(out)
        found = vectors.select(F.col("embedding").cast("array<double>").alias("v"), by).mapInPandas(run, f"category long, {by} {kind}, n long")
        counts = found if counts is None else counts.union(found)
    return counts.groupBy("category", by).agg(F.sum("n").alias("n"))
