from pyspark.sql import functions as F

from quirefold.functions import article, stem
from quirefold.functions import values as V
from quirefold.operators import loading, roots


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_stem():
    words = "cantar cantaba cantando nacionales rápidamente comprándolo torneo chicharrones construyendo siguen"
    assert [stem.stem(w) for w in words.split()] == "cant cant cant nacional rapid compr torne chicharron constru sig".split()


def test_root_search(spark):
    df = spark.createDataFrame([(1, "Ella cantaba, y él cantó"), (2, "luces"), (3, None)], "article_id long, body string")
    lemmas = spark.createDataFrame([("luces", "luz"), ("luz", "luz")], "form string, lemma string")
    assert [tuple(r) for r in roots.root_search(df, "cantar").collect()] == [(1, 1, 2)]
    assert [r["article_id"] for r in roots.root_search(df, "Luz", lemmas).collect()] == [2]


def test_article_functions(spark):
    html = '<div class="Titulo">t</div><div class="Estrofa">a&#241;o &amp;lt;</div><div class="Normal"> </div><a class="page" x>3</a>'
    assert one(spark, article.plain(article.without_head(F.lit(html)))) == "año <"
    assert one(spark, article.is_poem(F.lit(html))) and not one(spark, article.is_artwork(F.lit(html)))
    art = '<div class="imgbox"><div class="TituloI"> A &amp; <b>B</b></div><div class="NormalI"> </div></div>'
    assert one(spark, article.captions(F.lit(art))) == "A & B" and one(spark, article.is_artwork(F.lit(art.replace("NormalI", "AutorI"))))
    assert one(spark, article.caption_line(F.lit("uno\nÁrbol viejo"), "arbol")) == "**Árbol** viejo"
    assert one(spark, article.snippet(F.lit("x" * 301))) == "x" * 300 + "…"
    assert one(spark, article.poem_default_theme(F.lit(True), F.array().cast("array<string>"), "t")) == ["t"]


def test_values(spark):
    assert one(spark, V.slug_words(F.lit("¡El Ñandú -- azul! "))) == "el-nandu-azul"
    assert one(spark, V.title_key(F.lit("La Luz (Madrid)"))) == "la luz"
    assert one(spark, V.id_list(F.lit("[42] 7|42"))) == [42, 7]
    assert one(spark, V.comma_list(F.lit("a, ,b"))) == ["a", "b"]
    assert one(spark, V.is_true(F.lit("TRUE"))) and not one(spark, V.is_true(F.lit(None).cast("string")))
    assert one(spark, V.language_code(F.lit("Francés"))) == "fr" and one(spark, V.language_code(F.lit("x"))) == "es"
    assert one(spark, V.unfenced(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}'
    assert one(spark, V.json_keys(F.lit('{"a":1,"b":2}'))) == "a, b"
    assert one(spark, V.known_place(F.lit("Lugo *ERR"))) is None and one(spark, V.month(F.lit(13))) is None
    assert [r["text"] for r in one(spark, V.paragraphs(F.lit("a\n\n b ")))] == ["a", "b"]


def test_loading(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, None, "b")], "id long, legacy long, slug string")
    new = spark.createDataFrame([(10, "z"), (11, "b"), (12, "c"), (None, None)], "legacy long, slug string")
    got = sorted((str(r["legacy"]), r["action"], r["match_id"]) for r in loading.classify(new, old, [["legacy"], ["slug"]]).collect())
    assert got == [("10", "update", 1), ("11", "update", 2), ("12", "create", None), ("None", "create", None)]
    slugs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "n")], "k long, slug string")
    assert sorted((r["k"], r["slug"]) for r in loading.unique_slugs(slugs, "slug", old, ["k"]).collect()) == [(1, "a-1"), (2, "a-2"), (3, "n")]
    now = spark.createDataFrame([(1, None, "x"), (2, 5, "y")], "id long, year int, place string")
    more = spark.createDataFrame([(1, 1900, "q"), (2, 6, None)], "id long, year int, place string")
    assert [tuple(r) for r in loading.merge_filled(now, more, "id", ["year", "place"]).collect()] == [(1, 1900, "x")]
    assert sorted(tuple(r) for r in loading.merge_filled(now, more, "id", ["year", "place"], True).collect()) == [(1, 1900, "q"), (2, 6, "y")]
    links, held = (spark.createDataFrame(x, "a long, b long") for x in ([(1, 2), (3, 4)], [(1, 1)]))
    assert sorted(map(tuple, loading.new_links(links, held, ["a", "b"]).collect())) == [(1, 1), (1, 2), (3, 4)]
    assert sorted(map(tuple, loading.new_links(links, held, ["a", "b"], True).collect())) == [(1, 2), (3, 4)]
    assert [tuple(r) for r in loading.links_without_owner(links, held, "a").collect()] == [(3, 4)]
    people = spark.createDataFrame([("Ana ", [("s1",), ("gone",)])], "canon string, articulos array<struct<slug string>>")
    assert [tuple(r) for r in loading.mentioned(people, spark.createDataFrame([("s1", 9)], "slug string, article_id long")).collect()] == [("Ana", 9)]
    good, bad = loading.valid(new, ["slug"])
    assert (good.count(), bad.count()) == (3, 1)
    names = spark.createDataFrame([(" Ocio",), ("Moda",)], "nombre string")
    assert [r[0] for r in loading.insert_names(names, spark.createDataFrame([("OCIO",)], "nombre string")).collect()] == ["Moda"]
    toggled = loading.toggled(spark.createDataFrame([(1, True), (2, True)], "id long, activa boolean"), 1)
    assert [r["activa"] for r in toggled.orderBy("id").collect()] == [False, True]
