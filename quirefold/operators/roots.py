"""Search by word root, and deviation of an author from the corpus in word pairs."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fragments, stem
from . import lexis

WORD = r"[\p{L}\p{N}]+"


def words(articles: DataFrame, column: str = "body") -> DataFrame:
    return articles.select("article_id", F.posexplode(F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(WORD), 0)).alias("pos", "word"))


def root_search(articles: DataFrame, word: str, lemmas: DataFrame | None = None, column: str = "body") -> DataFrame:
    """article_id, first place and count of the words that share word's root.

    Roots are computed once for each distinct word; the word's own root comes by the same way, as one string."""
    spark, found = articles.sparkSession, words(articles, column)
    target = stem.roots(spark.createDataFrame([(word,)], "word string"), lemmas).select("root")
    same = stem.roots(found, lemmas).join(target, "root", "left_semi").select("word")
    return found.join(same, "word", "left_semi").groupBy("article_id").agg(F.min("pos").alias("first"), F.count("*").alias("n"))


def _forms(articles: DataFrame, columns: list[str], wanted: list[str], lemmas: DataFrame | None) -> DataFrame:
    """One row: kinds, a map of each form in the columns that shares the root of a wanted word to the sum of their bits (1, 2)."""
    spark = articles.sparkSession
    asked = spark.createDataFrame([(i, w.lower()) for i, w in enumerate(wanted)], "i int, word string")
    target = stem.roots(asked, lemmas).join(asked, "word").select("root", F.expr("shiftleft(1, i)").alias("bit")).groupBy("root").agg(F.sum("bit").cast("int").alias("bit"))
    text = F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
    found = articles.select(F.explode(F.array(text)).alias("text")).select(F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0))).alias("word")).where("word is not null")
    same = stem.roots(found, lemmas).join(F.broadcast(target), "root").select("word", "bit")
    return same.agg(F.map_from_entries(F.collect_list(F.struct("word", "bit"))).alias("kinds"))


def root_hits(articles: DataFrame, word: str, second: str | None = None, distance: int = 0, lemmas: DataFrame | None = None, texts: bool = True, heads: bool = True) -> DataFrame:
    """article_id, separation, fragment of articles(article_id, title, authors: array, body) that hold a word's root.

    Without a second word: the fragment of its first place in the body (``texts``), else, where the title or an author's
    name holds it (``heads``), the title. With one: the closest places of both roots in the body, ``distance`` words apart
    at most, the earliest among equals; words of one root are closest to themselves. Null texts count as empty.
    The forms that share a root are few and broadcast as one map. Places are sorted arrays within a row, merged in one
    pass that keeps the last place of either root, so no pairs are made and no words are shuffled."""
    if len(word.strip()) < 3 or second is not None and len(second.strip()) < 3 or not (texts or heads or second is not None):
        raise ValueError("a root search needs words of three letters and a place to look in")
    wanted = [word.strip()] + ([second.strip()] if second is not None else [])
    heads = heads and second is None
    names = F.array_join(F.coalesce("authors", F.array().cast("array<string>")), "\n")
    base = articles.select("article_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), names.alias("names"))
    kinds = _forms(base, ["body"] * (texts or second is not None) + ["title", "names"] * heads, wanted, lemmas)
    found = F.struct(F.regexp_extract_all("body", F.lit(WORD), 0).alias("words"), F.split("body", WORD, -1).alias("gaps"), F.regexp_extract_all(F.concat_ws("\n", "title", "names"), F.lit(WORD), 0).alias("head"))
    df = base.crossJoin(F.broadcast(kinds)).select("article_id", "title", "body", "kinds", F.explode(F.array(found)).alias("f"))
    df = df.select("article_id", "title", "body", "f.*", F.expr("exists(f.head, w -> coalesce(kinds[lower(w)], 0) & 1 = 1)").alias("named"),
                   F.expr("filter(transform(f.words, (w, i) -> named_struct('i', i, 'bits', coalesce(kinds[lower(w)], 0))), h -> h.bits > 0)").alias("hits"))
    if second is None:
        pair = F.expr("case when size(hits) > 0 then named_struct('separation', 0, 'a', hits[0].i, 'b', hits[0].i) end") if texts else F.lit(None).cast("struct<separation:int,a:int,b:int>")
    else:
        none = "cast(null as struct<separation:int,a:int,b:int>)"
        step = ("named_struct('one', case when h.bits & 1 = 1 then h.i else s.one end, 'two', case when h.bits & 2 = 2 then h.i else s.two end, 'best', least(s.best, "
                f"case when h.bits = 3 then named_struct('separation', 0, 'a', h.i, 'b', h.i) when h.bits = 1 and h.i - s.two <= {int(distance)} then named_struct('separation', h.i - s.two, 'a', h.i, 'b', s.two) "
                f"when h.bits = 2 and h.i - s.one <= {int(distance)} then named_struct('separation', h.i - s.one, 'a', s.one, 'b', h.i) end))")
        pair = F.expr(f"aggregate(hits, named_struct('one', cast(null as int), 'two', cast(null as int), 'best', {none}), (s, h) -> {step}, s -> s.best)")
    df = df.select("*", F.explode(F.array(pair)).alias("pair")).where(F.col("pair").isNotNull() | F.col("named") if heads else F.col("pair").isNotNull())
    # 1-based place of a word in its text: the gaps and words before it.
    place = lambda k: F.expr(f"1 + aggregate(slice(gaps, 1, pair.{k} + 1), 0, (s, x) -> s + length(x)) + aggregate(slice(words, 1, pair.{k}), 0, (s, x) -> s + length(x))")
    width = lambda k: F.expr(f"length(words[pair.{k}])")
    told = fragments.pair("body", place("a"), width("a"), place("b"), width("b")) if second is not None else fragments.single("body", place("a"), width("a"))
    return df.select("article_id", F.when(F.lit(second is not None), F.col("pair.separation")).alias("separation"), F.when(F.col("pair").isNotNull(), told).otherwise(F.col("title")).alias("fragment"))


def author_deviation(pairs: DataFrame, by_author: DataFrame, author: str, word: str) -> DataFrame:
    """successor, p_author, p_corpus (0 where missing), deviation; by_author has author beside article_id and words."""
    own = lexis.successors(by_author.where(F.col("author") == author).drop("author"), word, None).select("successor", F.col("p").alias("p_author"))
    out = own.join(lexis.successors(pairs, word, None).select("successor", F.col("p").alias("p_corpus")), "successor", "left")
    return out.withColumn("p_corpus", F.coalesce("p_corpus", F.lit(0.0))).withColumn("deviation", F.col("p_author") - F.col("p_corpus"))
