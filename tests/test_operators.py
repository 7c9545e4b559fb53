from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import lexis, search, vectors


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, T.tokens(F.lit("El Mar, azul; MAR 1927!"), [])) == ["el", "mar", "azul", "mar", "1927"]
    assert one(spark, T.fold(F.lit("Añoranza CANCIÓN"))) == "anoranza cancion"
    assert one(spark, T.html_text(F.lit("<p>a</p>&amp;lt;"))) == "a\n<"
    assert one(spark, T.name_key(F.lit("García Lorca, Federico"))) == one(spark, T.name_key(F.lit("Federico García Lorca")))
    assert one(spark, T.half_up(F.lit(3) / F.lit(7000) * 10000, 2)) == 4.29


def test_tfidf(spark):
    a, b = (spark.createDataFrame([(x,)], "body string") for x in ("mar mar luna", "luna sol"))
    r = vectors.style_distance(vectors.stylometry(a, b)).first()
    assert round(r["similarity"], 6) == 0.194314 and r["label"] == "muy distinto"


def test_entropy(spark):
    words = lexis.pair_words(spark.createDataFrame([(1, "mar azul mar negro mar azul")], "article_id long, body string"))
    rows = {r["word"]: r for r in lexis.entropy(words).collect()}
    assert round(rows["mar"]["h"], 6) == 0.918296 and rows["mar"]["h_max"] == 1 and not rows["mar"]["reliable"]
    assert rows["azul"]["h"] == 0.5 and rows["azul"]["h_norm"] == 0


def test_nearest_pair(spark):
    text = " ".join({2: "aaa", 10: "aaa", 5: "bbb", 11: "bbb"}.get(i, "x") for i in range(12))
    r = lexis.nearest_pair(spark.createDataFrame([(1, text)], "article_id long, body string"), "aaa", "bbb", 3).first()
    assert (r["a"], r["b"], r["separation"]) == (10, 11, 1)


def test_boolean_left_to_right(spark):
    df = spark.createDataFrame([(1, "aaa ccc", ""), (2, "bbb", "")], "article_id long, body string, title string")
    assert [r[0] for r in search.boolean(df, "aaa", [("OR", "bbb"), ("NOT", "ccc")]).select("article_id").collect()] == [2]
