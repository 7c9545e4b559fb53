"""Word-pair index of a corpus and its authors, and lexical chains of a word at both levels from one pass."""
import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..sources import buckets

#: Kinds of counts: texts of an author at all, texts with words in scope, and words with their followers.
KNOWN, TEXTS, PAIR = "known", "texts", "pair"
#: Buckets of a written index: an entry's rows of all batches lie in one, so they are added up without a shuffle.
BUCKETS = 256


def pair_counts(articles: DataFrame, scope: Column | None = None, authors: list[str] | None = None, word: str | None = None) -> DataFrame:
    """author, kind, word, successor, n of articles(body, authors: array); a null author stands for the whole corpus.

    One pass: every text is tokenised once, and its counts go to the corpus and, once each, to its authors (those asked
    for, if a list is given). A word that ends a text has a null successor, so a word's frequency is the sum of its rows.
    Texts outside of ``scope`` only make their authors known. With ``word`` only pairs that hold it are kept."""
    own = F.array_distinct(F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: a.isNotNull() & a.isin(*authors) if authors is not None else a.isNotNull()))
    words = F.when(F.coalesce(scope, F.lit(False)), T.pair_tokens(F.col("body"))) if scope is not None else T.pair_tokens(F.col("body"))
    # A generated column is a barrier: the optimiser can't tokenise anew wherever words are used.
    df = articles.select(own.alias("own"), F.explode(F.array(F.coalesce(words, F.array().cast("array<string>")))).alias("words"))
    pairs = F.expr(f"transform(words, (w, i) -> named_struct('kind', '{PAIR}', 'word', w, 'successor', get(words, i + 1)))")
    if word is not None:
        pairs = F.filter(pairs, lambda p: (p["word"] == word) | F.coalesce(p["successor"] == word, F.lit(False)))
    none = F.lit(None).cast("string")
    mark = lambda kind: F.struct(F.lit(kind).alias("kind"), none.alias("word"), none.alias("successor"))
    events = F.concat(F.array(mark(KNOWN)), F.when(F.size("words") > 0, F.array(mark(TEXTS))).otherwise(F.array().cast("array<struct<kind:string,word:string,successor:string>>")), pairs)
    df = df.select(F.explode_outer(F.concat(F.array(none), "own")).alias("author"), events.alias("events"))
    return df.select("author", F.inline_outer("events")).groupBy("author", "kind", "word", "successor").agg(F.count("*").alias("n"))


def resolved_word(counts: DataFrame, prefix: str) -> str:
    """The word itself where the corpus has it, else its most frequent word with that beginning (ties by word), else the word as it is."""
    rows = counts.where((F.col("kind") == PAIR) & F.col("author").isNull() & F.col("word").startswith(prefix)).groupBy("word").agg(F.sum("n").alias("n"))
    best = rows.orderBy(F.desc(F.col("word") == prefix), F.desc("n"), "word").limit(1).collect()
    return best[0]["word"] if best else prefix


def lexical_chains(counts: DataFrame, word: str, authors: list[str] = [], k: int = 10) -> DataFrame:
    """Chains of a word in the corpus (null author) and at each author asked for, of pair_counts() or a written index.

    A level has one row of part 'level' with its state, and if the word occurs there frequency, entropy of the successors
    in bits, its maximum, normalised value, reliability, label and difference to the corpus; and the ``k`` most frequent
    tokens of the parts 'successor' and 'predecessor' with rank, n, p (n by the word's frequency), for successors also
    p_corpus (0 where missing) and deviation. Ties go by token. States of levels: 'ok', 'absent' (the word), 'no texts' (none with
    words in scope) and 'unknown' (author of no text). The counts are read once.

    Entropies come from sums, as in lexis.entropy(): s / t * log2(t) - sum(n * log2(n)) / t."""
    spark = counts.sparkSession
    asked = spark.createDataFrame([(a, "asked", None, None, 0) for a in [None, *dict.fromkeys(authors)]], "author string, kind string, word string, successor string, n long")
    wanted = F.col("author").isNull() | F.col("author").isin(*authors) if authors else F.col("author").isNull()
    rows = counts.where(wanted & ((F.col("kind") != PAIR) | (F.col("word") == word) | (F.col("successor") == word))).select(asked.columns).union(asked)
    # A pair of the word with itself is a successor and a predecessor.
    role = lambda name, token, when: F.when(when, F.struct(F.lit(name).alias("part"), token.alias("token")))
    pair, none = F.col("kind") == PAIR, F.lit(None).cast("string")
    roles = F.array_compact(F.array(role("successor", F.col("successor"), pair & (F.col("word") == word)), role("predecessor", F.col("word"), pair & (F.col("successor") == word)), role("level", none, F.col("kind") == "asked"), role("count", none, F.col("kind").isin(KNOWN, TEXTS))))
    # The word's own rows are few and used several times, so they are written once.
    rows = buckets.written(rows.select("author", "kind", "n", F.explode(roles).alias("r")).select("author", "kind", "n", "r.*"), "chain")
    n, following = F.col("n"), (F.col("part") == "successor") & F.col("token").isNotNull()
    total = lambda when, value=n: F.coalesce(F.sum(F.when(when, value)), F.lit(0))
    # Sums by level are reduced before they are shuffled, however many tokens follow the word.
    stats = rows.groupBy("author").agg(total(F.col("part") == "successor").alias("frequency"), F.count(F.when(following, 1)).alias("followers"), total(F.col("kind") == TEXTS).alias("texts"), total(F.col("kind") == KNOWN).alias("known"),
                                       total(following).alias("__s"), total(following, n * F.log2("n")).alias("__h"))
    stats = stats.withColumn("entropy", F.when(F.col("frequency") > 0, F.greatest(F.lit(0.0), F.col("__s") / F.col("frequency") * F.log2("frequency") - F.col("__h") / F.col("frequency"))))
    stats = stats.select(F.col("author").alias("__author"), "frequency", "followers", "texts", "known", "entropy")
    whole = stats.where("__author is null").select(F.col("frequency").alias("frequency_corpus"), F.col("entropy").alias("entropy_corpus"))
    stats = stats.crossJoin(F.broadcast(whole))

    held = rows.where("part in ('successor', 'predecessor') and token is not null")
    held = held.withColumn("n_corpus", F.max(F.when(F.col("author").isNull(), n)).over(Window.partitionBy("part", "token")))
    held = held.withColumn("rank", F.row_number().over(Window.partitionBy("author", "part").orderBy(F.desc("n"), "token"))).where(F.col("rank") <= k)
    held = held.join(F.broadcast(stats), F.col("author").eqNullSafe(F.col("__author")))
    p, p_corpus = F.try_divide(n, F.col("frequency")), F.when(F.col("part") == "successor", F.coalesce(F.try_divide("n_corpus", "frequency_corpus"), F.lit(0.0)))
    held = held.select("author", "part", "rank", "token", "n", p.alias("p"), p_corpus.alias("p_corpus"), (p - p_corpus).alias("deviation"))

    own = F.col("author").isNotNull()
    state = F.when(own & (F.col("known") == 0), "unknown").when(own & (F.col("texts") == 0), "no texts").when(F.col("frequency") == 0, "absent").otherwise("ok")
    top, reliable = F.when(F.col("followers") > 0, F.log2(F.col("followers").cast("double"))).otherwise(0.0), F.col("frequency") >= 5
    norm = F.when(top > 0, F.col("entropy") / top).otherwise(0.0)
    told = lambda c: F.when(F.col("state") == "ok", c)
    levels = stats.withColumnRenamed("__author", "author").withColumn("state", state).select(
        "author", F.lit("level").alias("part"), "state", "frequency", told(F.col("entropy")).alias("entropy"), told(top).alias("entropy_max"), told(norm).alias("entropy_norm"), told(reliable).alias("reliable"),
        told(V.entropy_label(norm, reliable)).alias("label"), told(F.when(own, F.col("entropy") - F.col("entropy_corpus"))).alias("entropy_difference"))
    return held.unionByName(levels, allowMissingColumns=True)


def changed_counts(old: DataFrame, new: DataFrame, **more) -> DataFrame:
    """Signed counts by which the texts before (old) and after (new) a change differ, of the changed articles alone.

    An article that only one side has is inserted or deleted."""
    both = pair_counts(new, **more).unionByName(pair_counts(old, **more).withColumn("n", -F.col("n")))
    return both.groupBy("author", "kind", "word", "successor").agg(F.sum("n").alias("n")).where("n != 0")


def entries(articles: DataFrame, scope: Column | None = None) -> DataFrame:
    """owners, entry of articles(body, authors: array): what pair_counts() counts, but each text's rows once, with all its authors.

    An entry is 'word successor', 'word' where it ends the text, or '#known' or '#texts'; words hold neither space nor '#'."""
    own = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("authors", F.array().cast("array<string>")))))
    words = F.when(F.coalesce(scope, F.lit(False)), T.pair_tokens(F.col("body"))) if scope is not None else T.pair_tokens(F.col("body"))
    df = articles.select(own.alias("owners"), F.explode(F.array(F.coalesce(words, F.array().cast("array<string>")))).alias("words"))
    pairs = F.expr("transform(words, (w, i) -> concat_ws(' ', w, get(words, i + 1)))")
    marks = F.when(F.size("words") > 0, F.array(F.lit(f"#{KNOWN}"), F.lit(f"#{TEXTS}"))).otherwise(F.array(F.lit(f"#{KNOWN}")))
    return df.select("owners", F.explode(F.concat(marks, pairs)).alias("entry"))


def open_index(spark: SparkSession, path: str) -> str:
    """Name of the table of an index folder; one that is new, or that another session wrote, is made known to this one."""
    name = "pairs_" + hashlib.sha256(path.encode()).hexdigest()[:32]
    if not spark.catalog.tableExists(name):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.sql(f"create table {name} (owners array<string>, entry string, n long, batch string) using parquet partitioned by (batch) clustered by (entry) into {BUCKETS} buckets location '{path}'")
        spark.sql(f"msck repair table {name}")
    return name


def add_batch(path: str, batch: str, after: DataFrame, before: DataFrame | None = None, scope: Column | None = None) -> None:
    """Add a batch to an index folder: the counts of the articles ``after``, less those of the same articles ``before``.

    The signed counts alone are shuffled and written, however large the index is. A batch has a folder of its own, so a
    repeat writes the same folder anew and adds nothing twice."""
    if not re.fullmatch(r"[\w-]+", batch):
        raise ValueError("a batch is named by letters, digits, _ and -")
    spark = after.sparkSession
    name = open_index(spark, path)
    rows = entries(after, scope).withColumn("n", F.lit(1))
    if before is not None:
        rows = rows.union(entries(before, scope).withColumn("n", F.lit(-1)))
    # Dealt by entry as the table's buckets are, so counting and writing need no further shuffle.
    counts = rows.repartition(BUCKETS, "entry").groupBy("owners", "entry").agg(F.sum("n").alias("n")).where("n != 0")
    spark.sql(f"insert overwrite table {name} partition (batch = '{batch}') select owners, entry, n from {{counts}}", counts=counts)


def indexed_counts(spark: SparkSession, path: str, author: str | None = None) -> DataFrame:
    """kind, word, successor, n of the corpus, or of an author, over all batches of an index folder, as pair_counts() has them."""
    rows = spark.table(open_index(spark, path))
    rows = rows if author is None else rows.where(F.array_contains("owners", author))
    counts = rows.groupBy("entry").agg(F.sum("n").alias("n")).where("n != 0")
    mark, word = F.startswith("entry", F.lit("#")), F.split("entry", " ")
    return counts.select(F.when(mark, F.substring("entry", 2, 10)).otherwise(PAIR).alias("kind"), F.when(~mark, F.get(word, F.lit(0))).alias("word"), F.when(~mark, F.get(word, F.lit(1))).alias("successor"), "n")
