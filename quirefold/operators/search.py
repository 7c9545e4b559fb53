"""Boolean search, captions and paging."""
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def clause(columns: list[str], term: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(T.fold(F.coalesce(c, F.lit(""))), F.lit(term))
    return out


def boolean(articles: DataFrame, first: str, then: list[tuple[str, str]] = [], columns: list[str] = ["title", "body"]) -> DataFrame:
    """Terms combined strictly from left to right; NOT is 'and not'. Terms under three letters are ignored, and ones after them."""
    if len(first.strip()) < 3 or not columns:
        raise ValueError("a search needs a term of three letters and a column")
    keep = clause(columns, first)
    if len(then) > 2:
        raise ValueError("a search has three terms at most")
    for op, term in then:
        if op not in ("AND", "OR", "NOT") or len(term.strip()) < 3:
            break
        c = clause(columns, term)
        keep = keep & c if op == "AND" else keep | c if op == "OR" else keep & ~c
    return articles.where(keep)


def page(df: DataFrame, number: int = 1, size: int = 20, key: str = "article_id") -> DataFrame:
    number, size = max(1, number), max(1, size)
    return df.orderBy(key).offset((number - 1) * size).limit(size)


def page_count(total: int, size: int) -> int:
    return math.ceil(total / size)


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
