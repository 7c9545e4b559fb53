"""Concordance, word clouds, word-pair tables, chains and entropy."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def word_cloud(articles: DataFrame, k: int | None = 150, column: str = "body", stopwords=T.STOPWORDS) -> DataFrame:
    """Most frequent tokens, numbers left out; ties by token."""
    out = articles.select(F.explode(T.tokens(F.col(column), stopwords)).alias("token")).where(~F.col("token").rlike(r"^\p{N}+$"))
    out = out.groupBy("token").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "token").limit(k) if k else out


def hits(articles: DataFrame, word: str) -> DataFrame:
    """Whole-word hits of a folded word in body and title, with the body's word count."""
    pattern = F.lit(T.whole_word(word))
    return articles.withColumns({"n_body": F.regexp_count(T.fold(F.coalesce("body", F.lit(""))), pattern), "n_title": F.regexp_count(T.fold(F.coalesce("title", F.lit(""))), pattern),
                                 "n_words": T.word_count(F.col("body"))}).withColumn("n", F.col("n_body") + F.col("n_title"))


def concordance_by(articles: DataFrame, word: str, by: str) -> DataFrame:
    # Sums of none are dropped after the aggregate: a filter on the count would make the scan fold and count every text twice.
    found = hits(articles, word).where(F.col(by).isNotNull()).groupBy(by).agg(F.sum("n").cast("long").alias("occurrences"), F.countDistinct(F.when(F.col("n") > 0, F.col("article_id"))).alias("articles"))
    return found.where("occurrences > 0")


def concordance_by_author(articles: DataFrame, authors: DataFrame, word: str) -> DataFrame:
    return concordance_by(articles.join(authors, "article_id"), word, "author")


def yearly_density(articles: DataFrame, word: str) -> DataFrame:
    """Hits per 10,000 words of all articles of the year, matched or not; years with hits only."""
    out = hits(articles, word).where("year is not null").groupBy("year").agg(F.sum("n").cast("long").alias("occurrences"), F.sum("n_words").cast("long").alias("words"))
    return out.where("occurrences > 0").withColumn("density", F.when(F.col("words") > 0, T.half_up(F.col("occurrences") / F.col("words") * 10000, 2)).otherwise(0.0))


def keyword_lines(articles: DataFrame, word: str, around: int = 50) -> DataFrame:
    """One row a body hit, with the text around it; offsets come from summed lengths of the pieces between hits."""
    pieces = F.split(T.fold(F.coalesce("body", F.lit(""))), T.whole_word(word), -1)
    df = articles.select("article_id", "magazine", "year", "body", F.explode(F.array(F.transform(pieces, F.length))).alias("sizes")).where("size(sizes) > 1")
    # A hit stands after the pieces up to it and the hits before.
    df = df.withColumn("before", F.expr(T.running("sizes"))).select("article_id", "magazine", "year", "body", F.posexplode(F.expr(f"transform(slice(before, 2, size(before)), (x, i) -> x + 1 + i * {len(word)})")).alias("hit", "place"))
    return df.select("article_id", "magazine", "year", "hit", F.col("place"), T.fragment("body", F.col("place"), len(word), around).alias("line"))


def pair_words(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", T.pair_tokens(F.col("body")).alias("words"))


def unigrams(words: DataFrame) -> DataFrame:
    return words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def bigrams(words: DataFrame, by: list[str] = []) -> DataFrame:
    """Counts of neighbouring words within an article; no window, no shuffle before the partial count."""
    pairs = F.expr("case when size(words) > 1 then zip_with(slice(words, 1, size(words) - 1), slice(words, 2, size(words) - 1), (a, b) -> named_struct('a', a, 'b', b)) else array() end")
    return words.select(*by, F.explode(pairs).alias("p")).groupBy(*by, F.col("p.a").alias("word"), F.col("p.b").alias("successor")).agg(F.count("*").alias("n"))


def resolve(table: DataFrame, prefix: str) -> DataFrame:
    """One row: the word itself, else the most frequent word that starts with it; ties by word."""
    return table.where(F.col("word").startswith(prefix)).orderBy(F.desc(F.col("word") == prefix), F.desc("n"), "word").limit(1)


def followers(words: DataFrame, word: str | None = None) -> DataFrame:
    """word, successor, n from one explode; the last word of an article has a null successor, so a word's rows sum up to its frequency."""
    pairs = F.expr("transform(words, (w, i) -> named_struct('word', w, 'successor', get(words, i + 1)))")
    if word is not None:
        pairs = F.filter(pairs, lambda p: (p["word"] == word) | F.coalesce(p["successor"] == word, F.lit(False)))
    # A generated column is a barrier: the words are made once, not wherever they are used.
    held = words.select(F.explode(F.array("words")).alias("words"))
    return held.select(F.inline_outer(pairs)).where("word is not null").groupBy("word", "successor").agg(F.count("*").alias("n"))


def _chain(words: DataFrame, word: str, token: str, k: int | None) -> DataFrame:
    """Pairs that hold the word are few rows, so its frequency is a sum over all of them."""
    rows = followers(words, word)
    rows = rows.withColumn("total", F.sum(F.when(F.col("word") == word, F.col("n")).otherwise(0)).over(Window.partitionBy(F.lit(0))))
    rows = rows.where((F.col("word") == word) & F.col("successor").isNotNull()) if token == "successor" else rows.where(F.col("successor") == word)
    out = rows.select(F.col("successor" if token == "successor" else "word").alias(token), "n", (F.col("n") / F.col("total")).alias("p"))
    return out.orderBy(F.desc("n"), token).limit(k) if k else out


def successors(words: DataFrame, word: str, k: int | None = 10) -> DataFrame:
    """p = n(word, next) / n(word); words that end an article count below the line."""
    return _chain(words, word, "successor", k)


def predecessors(words: DataFrame, word: str, k: int | None = 10) -> DataFrame:
    """p = n(before, word) / n(word)."""
    return _chain(words, word, "predecessor", k)


def entropy(words: DataFrame) -> DataFrame:
    """Per word: frequency, successor entropy in bits, its maximum, normalised value and reliability (5 or more).

    With t the frequency and s the sum of the successors' counts n, the entropy is s / t * log2(t) - sum(n * log2(n)) / t,
    so one aggregate over the pairs gives all. Words without successors are left out."""
    there = F.col("successor").isNotNull()
    out = followers(words).groupBy("word").agg(F.sum("n").alias("frequency"), F.count("successor").alias("followers"), F.sum(F.when(there, F.col("n"))).alias("__s"), F.sum(F.when(there, F.col("n") * F.log2("n"))).alias("__h"))
    out = out.where("followers > 0").withColumn("h", F.greatest(F.lit(0.0), F.col("__s") / F.col("frequency") * F.log2("frequency") - F.col("__h") / F.col("frequency")))
    top = F.log2(F.col("followers").cast("double"))
    return out.select("word", "frequency", "followers", "h", top.alias("h_max"), F.when(top > 0, F.col("h") / top).otherwise(0.0).alias("h_norm"), (F.col("frequency") >= 5).alias("reliable"))


def prefix_counts(articles: DataFrame, prefix: str, by: str = "magazine") -> DataFrame:
    out = articles.select(by, F.explode(T.pair_tokens(F.col("body"))).alias("word")).where(F.col("word").startswith(prefix))
    return out.groupBy(by).agg(F.count("*").alias("n"))


def nearest_pair(articles: DataFrame, first: str, second: str, distance: int) -> DataFrame:
    """Per article the closest places of two words within ``distance`` words; the earliest wins ties."""
    words = articles.select("article_id", F.posexplode(F.regexp_extract_all(T.fold("body"), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("pos", "word"))
    # Neighbours in the merged order of places hold a closest pair, so no pairs of all places are made.
    w = Window.partitionBy("article_id").orderBy("pos")
    if first == second:
        return words.where(F.col("word") == first).groupBy("article_id").agg(F.lit(0).alias("separation"), F.min("pos").alias("a"), F.min("pos").alias("b"))
    near = words.where(F.col("word").isin(first, second)).withColumns({"before": F.lag("word").over(w), "there": F.lag("pos").over(w)}).where("before != word")
    near = near.withColumns({"a": F.when(F.col("word") == first, F.col("pos")).otherwise(F.col("there")), "b": F.when(F.col("word") == first, F.col("there")).otherwise(F.col("pos"))})
    near = near.withColumn("separation", F.abs(F.col("a") - F.col("b"))).where(F.col("separation") <= distance)
    return near.groupBy("article_id").agg(F.min(F.struct("separation", "a", "b")).alias("m")).select("article_id", "m.separation", "m.a", "m.b")
