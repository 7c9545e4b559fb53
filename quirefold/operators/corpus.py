"""Corpus model: articles, authors and the shared scope filters."""
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """Optional restrictions; None leaves a side open, and an empty list matches nothing. Null flags count as false, null years fail year bounds."""

    languages: tuple[str, ...] | None = None
    adverts: bool | None = None
    poems: bool | None = None
    magazine: str | None = None
    author: str | None = None
    year: int | None = None
    year_from: int | None = None
    year_to: int | None = None
    issue: int | None = None
    themes: tuple[str, ...] | None = None
    ids: tuple[int, ...] | None = None
    published: bool | None = None

    def apply(self, articles: DataFrame, authors: DataFrame | None = None, themes: DataFrame | None = None) -> DataFrame:
        if self.issue is not None and self.magazine is None:
            raise ValueError("an issue number needs a magazine")
        df, flag = articles, lambda c: F.coalesce(c, F.lit(False))
        if self.languages is not None:
            df = df.where(F.col("language").isin(*self.languages))
        if self.adverts is not None:
            df = df.where(flag("is_advert") == self.adverts)
        if self.poems is not None:
            df = df.where(flag("is_poem") == self.poems)
        for column, value in (("magazine", self.magazine), ("year", self.year), ("issue_order", self.issue)):
            if value is not None:
                df = df.where(F.col(column) == value)
        if self.year_from is not None:
            df = df.where(F.col("year") >= self.year_from)
        if self.year_to is not None:
            df = df.where(F.col("year") <= self.year_to)
        if self.ids is not None:
            df = df.where(F.col("article_id").isin(*self.ids) if self.ids else F.lit(False))
        if self.published is not None:
            df = df.where(F.col("published_at").isNotNull() == self.published)
        if self.themes is not None:
            df = df.join(themes.where(F.col("theme").isin(*self.themes) if self.themes else F.lit(False)), "article_id", "left_semi")
        if self.author is not None:
            df = df.join(authors.where(F.col("author") == self.author), "article_id", "left_semi")
        return df


def articles(spark: SparkSession, sf_dir: str, flags: bool = True) -> DataFrame:
    """The article view over documents and labels.

    Without ``flags`` labels are not read and is_advert and is_poem are null: beyond a broadcast the join would shuffle
    every text."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    df = docs.join(labels, "doc_id", "left") if flags else docs.select("*", F.lit(None).cast("int").alias("toxic"), F.lit(None).cast("int").alias("quality"))
    return df.select(
        F.col("doc_id").alias("article_id"), F.left("text", F.lit(60)).alias("title"), F.col("text").alias("body"), F.col("lang").alias("language"),
        F.col("source").alias("magazine"), F.when(F.col("doc_id") % 41 != 0, (F.lit(1900) + F.col("doc_id") % 37).cast("int")).alias("year"),
        (F.col("doc_id") % 12 + 1).cast("int").alias("issue_order"), (F.col("toxic") == 1).alias("is_advert"), (F.col("quality") == 0).alias("is_poem"))


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, author, place in the list; some articles have two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    first, second = F.concat(F.lit("a"), F.col("doc_id") % 23), F.concat(F.lit("a"), F.col("doc_id") % 7)
    names = F.when((F.col("doc_id") % 5 == 0) & (first != second), F.array(first, second)).otherwise(F.array(first))
    return docs.select(F.col("doc_id").alias("article_id"), F.posexplode(names).alias("place", "author")).withColumn("place", F.col("place") + 1)


def with_authors(articles: DataFrame) -> DataFrame:
    """Adds authors, the names of authors() as an array in order of their places, without another pass over documents."""
    first, second = F.concat(F.lit("a"), F.col("article_id") % 23), F.concat(F.lit("a"), F.col("article_id") % 7)
    return articles.withColumn("authors", F.when((F.col("article_id") % 5 == 0) & (first != second), F.array(first, second)).otherwise(F.array(first)))


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, theme: one theme an article, every fourth has a second."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("article_id"))
    theme = lambda n: F.concat(F.lit("t"), (F.col("article_id") % n).cast("string")).alias("theme")
    return docs.select("article_id", theme(9)).union(docs.where("article_id % 4 = 0").select("article_id", theme(5))).distinct()
