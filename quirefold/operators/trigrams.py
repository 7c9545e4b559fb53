"""Substring search by an index: posting lists of trigrams, intersected from the rarest on, then confirmed on the folded text."""
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Worker code travels with the job, so executors need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Articles whose ids may meet in one list: ids of a list lie in one block of so many numbers.
BLOCK = 1 << 16
#: Entries of posting lists that a task makes at a time.
LISTED = 1 << 20
#: Candidates up to which their counted list is broadcast; beyond that both sides are shuffled.
CANDIDATES = 4_000_000


def folded(articles: DataFrame, columns: list[str], key: str = "article_id") -> DataFrame:
    """key, scope (a column's name), text: the folded text of each column."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("scope"), T.fold(F.coalesce(F.col(c), F.lit(""))).alias("text")) for c in columns)))
    return articles.select(F.col(key).alias("id"), each.alias("s")).select("id", "s.scope", "s.text")


def _grouped(scope: str, ids: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
    """Posting lists of some texts of a scope."""
    each, gram = np.repeat(np.array(ids, np.int64), [len(g) for g in grams]), np.concatenate(grams)
    order = np.lexsort((each, gram))
    each, gram = each[order], gram[order]
    block = each // BLOCK
    starts = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])])
    first = gram[starts]
    signs = np.stack([first >> 42, first >> 21 & 0x1FFFFF, first & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(each)], pa.int32()), pa.array(each))
    return pa.RecordBatch.from_arrays([pa.array([scope] * len(starts)), pa.array([signs[i:i + 3] for i in range(0, len(signs), 3)]), pa.array(block[starts]), lists], ["scope", "trigram", "block", "ids"])


def posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """scope, trigram, block, ids of batches of id, scope, text: lists of LISTED entries or so at a time.

    A trigram is held as a number of three code points, and a text's are made distinct by pieces of LISTED signs."""
    held, size = {}, 0
    for batch in batches:
        for key, scope, text in zip(batch["id"].to_pylist(), batch["scope"].to_pylist(), batch["text"]):
            signs = np.frombuffer(text.as_py().encode("utf-32-le"), "<u4").astype(np.int64)
            for at in range(0, len(signs) - 2, LISTED):
                c = signs[at:at + LISTED + 2]
                ids, grams = held.setdefault(scope, ([], []))
                ids.append(key)
                grams.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
                size += len(grams[-1])
                if size >= LISTED:
                    yield from (_grouped(s, *x) for s, x in held.items())
                    held, size = {}, 0
    yield from (_grouped(s, *x) for s, x in held.items())


def write(articles: DataFrame, path: str, columns: list[str], key: str = "article_id", buckets: int = 64) -> None:
    """Write posting lists (scope, trigram, block, ids) of the columns' folded texts; keys are whole numbers, null ones are left out.

    Lists of many texts are made before anything is shuffled, and dealt to their buckets once. A list holds ascending ids of one block, so a trigram that every article has is many short lists."""
    texts = folded(articles, columns, key).where("id is not null and length(text) >= 3").select(F.col("id").cast("long"), "scope", "text")
    some = texts.mapInArrow(posting_lists, "scope string, trigram string, block long, ids array<long>")
    some = some.withColumn("bucket", F.pmod(F.xxhash64("trigram"), F.lit(buckets)).cast("int")).repartition("bucket")
    ids = F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids"))))
    lists = some.groupBy("bucket", "trigram", "scope", "block").agg(ids.alias("ids")).select("scope", "trigram", "block", "ids", F.size("ids").alias("n"), "bucket")
    lists.sortWithinPartitions("bucket", "trigram").write.partitionBy("bucket").parquet(path)
    articles.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}-told")


def containing(spark: SparkSession, path: str, term: str, scopes: list[str]) -> DataFrame:
    """id of the articles whose texts in one of the scopes hold all trigrams of a folded term: all that can hold the term, and few others.

    Only the buckets, and by their statistics the row groups, of the term's trigrams are read. Per block the lists are
    intersected from the shortest on; a block that lacks one has no candidates."""
    wanted = sorted({term[i:i + 3] for i in range(len(term) - 2)})
    if not wanted:
        raise ValueError("an indexed term has three signs at least")
    buckets = spark.read.parquet(f"{path}-told").first()["buckets"]
    numbers = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "trigram string").select(F.pmod(F.xxhash64("trigram"), F.lit(buckets))).collect()]
    lists = spark.read.schema("scope string, trigram string, block long, ids array<long>, n int, bucket int").parquet(path).where(F.col("bucket").isin(*set(numbers)) & F.col("trigram").isin(*wanted) & F.col("scope").isin(*scopes))
    held = lists.groupBy("scope", "block").agg(F.count("*").alias("lists"), F.array_sort(F.collect_list(F.struct("n", "ids"))).alias("held")).where(F.col("lists") == len(wanted))
    both = F.expr("aggregate(slice(held, 2, size(held)), held[0].ids, (a, x) -> case when size(a) = 0 then a else array_intersect(a, x.ids) end)")
    return held.select(F.explode(both).alias("id")).distinct()


def holds(scopes: list[str], term: str) -> Column:
    out = F.lit(False)
    for c in scopes:
        out = out | F.contains(T.fold(F.coalesce(F.col(c), F.lit(""))), F.lit(term))
    return out


def search(articles: DataFrame, path: str, first: str, then: list[tuple[str, str]] = [], scopes: list[str] = ["title", "body"], key: str = "article_id") -> DataFrame:
    """Articles that a chain of terms finds, as search.boolean() gives them, read by the index at ``path``.

    Terms are combined from left to right, NOT is 'and not'; those under three letters, and all after them, are ignored;
    the first must have three. Candidates of the whole chain come from posting lists (NOT takes none away), and the chain
    is then confirmed on their folded texts alone."""
    term = lambda x: x.strip()
    if len(term(first)) < 3 or not scopes:
        raise ValueError("a search needs a term of three letters and a column")
    if len(then) > 2:
        raise ValueError("a search has three terms at most")
    spark = articles.sparkSession
    fold = lambda x: spark.range(1).select(T.fold(F.lit(x))).first()[0]
    one = fold(term(first))
    if len(one) < 3:
        raise ValueError("a search needs a term of three letters and a column")
    ids, keep = containing(spark, path, one, scopes), holds(scopes, one)
    for op, raw in then:
        if op not in ("AND", "OR", "NOT") or len(term(raw)) < 3:
            break
        word = fold(term(raw))
        c = holds(scopes, word)
        if op == "AND":
            ids, keep = ids.join(containing(spark, path, word, scopes), "id", "left_semi") if len(word) >= 3 else ids, keep & c
        elif op == "OR":
            if len(word) < 3:
                raise ValueError("an indexed term has three signs at least")
            ids, keep = ids.union(containing(spark, path, word, scopes)), keep | c
        else:
            keep = keep & ~c
    ids = ids.distinct().withColumnRenamed("id", key)
    few = ids.limit(CANDIDATES + 1).count() <= CANDIDATES
    return articles.join(F.broadcast(ids) if few else ids.hint("merge"), key, "left_semi").where(keep)
