"""Functions and operators added for fragments, HTML, themes, imports and files."""
import re
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirefold.functions import fragments, html
from quirefold.functions import values as V
from quirefold.operators import corpus, lexis, loading, search, vectors
from quirefold.sources import readers, spreadsheets


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_fragments(spark):
    df = spark.createDataFrame([("a  b hit c hat d", "t", "cap hut")], "body string, title string, captions string")
    got = df.select(fragments.single("body", F.lit(6), F.lit(3)).alias("s"), fragments.pair("body", F.lit(12), F.lit(3), F.lit(6), F.lit(3)).alias("p"),
                    fragments.search("body", "title", ["none", "hit"]).alias("q"), fragments.search("body", "title", ["none"]).alias("n"), fragments.search("body", "title", ["hut", "hit"], "captions").alias("c")).first()
    assert tuple(got) == ("a b **hit** c hat d", "a b **hit** c **hat** d", "a b **hit** c hat d", "t", "cap **hut**")


def test_html(spark):
    assert one(spark, html.index_text(F.lit('x<a href="javascript:go()">y</a><p>a</p><b>c</b>&amp;&#39;'))) == "x a c &'"
    assert one(spark, html.search_text(F.lit("<b>a</b>&#241;&#xF1;&mdash;&ldquo;"))) == "aññ—“"
    assert one(spark, html.sanitised(F.lit(' <a class="z" href="javascript:x">y</a>&nbsp;b '))) == "b"
    assert one(spark, html.index_text(F.lit(None).cast("string"))) == one(spark, html.sanitised(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("text, want", [
    ('<div class="Normal">a</div>', '<div class="Normal">a</div>'),
    ('x</div><div class="Normal">a</div></div>b', 'x<div class="Normal">a</div>b'),
    ('<div class="imgbox"><div class="TituloI">t</div><div class="Normal">a</div>', '<div class="imgbox"><div class="TituloI">t</div></div>\n<div class="Normal">a</div>'),
    ('<div class="Normal">a<div class="Cita">b  ', '<div class="Normal">a<div class="Cita">b\n</div>\n</div>\n'),
    ("</div>", ""), ("", ""), (None, None)])
def test_balanced(spark, text, want):
    assert html.balanced(spark.createDataFrame([(text,)], "html string"), "html").first()["html"] == want


def test_values(spark):
    assert [one(spark, V.two_decimals(F.lit(x))) for x in (1.615, 0.125, 1234.5, -0.5)] == ["1.61", "0.13", "1234.50", "-0.50"]
    assert one(spark, V.activity(F.lit(2), F.lit(None).cast("int"), F.lit(3))) == 5
    assert one(spark, V.vector(F.lit("[1, 2.5]"))) == [1.0, 2.5] and one(spark, V.vector_text(F.array(F.lit(1.0), F.lit(2.5)))) == "[1.0,2.5]"
    assert one(spark, V.file_key(F.lit("/a/La_Última Hora.v2.JPG"))) == "la ultima hora.v2" and one(spark, V.title_name(F.lit("La Última  Hora.v2"))) == "la ultima hora.v2"
    assert [one(spark, V.colour(F.lit(i))) for i in (1, 5)] == ["#2563eb", "#6b7280"]
    assert one(spark, V.id_list(F.lit("7 " + "9" * 30))) == [7]
    lat, lng = V.filled_place(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert (one(spark, lat), one(spark, lng)) == (2.0, 3.0)
    assert one(spark, V.author_warning(F.lit(0), "prosas")) == "Este autor no tiene prosas en español." and one(spark, V.author_warning(F.lit(3), "prosas")) is None


def test_unique_slugs(spark):
    rows = [(1, "a"), (2, "a"), (3, "a-1"), (4, "a"), (5, None), (6, ""), (7, "b"), (8, "a-1"), (9, "c")]
    old = spark.createDataFrame([("b",), ("b-1",), ("a-3",)], "slug string")
    got = {r["k"]: r["slug"] for r in loading.unique_slugs(spark.createDataFrame(rows, "k long, slug string"), "slug", old, ["k"]).collect()}
    assert got == {1: "a", 2: "a-2", 3: "a-1", 4: "a-4", 5: "", 6: "-1", 7: "b-2", 8: "a-1-1", 9: "c"}
    assert not set(got.values()) & {"b", "b-1", "a-3"} and len(set(got.values())) == len(got)


def test_imports(spark):
    themes = spark.createDataFrame([(1, "Arte"), (2, "arte "), (3, "Moda")], "id long, name string")
    got = loading.theme_links(spark.createDataFrame([(" ARTE",), ("x",)], "theme string"), themes).collect()
    assert [tuple(r) for r in got] == [(" ARTE", 1)]
    files = spark.createDataFrame([("/i/La_Hora.png",), ("/j/La_Hora.jpg",)], "path string")
    got = loading.image_files(spark.createDataFrame([("La  hora",), ("Otra",)], "title string"), files).collect()
    assert sorted(map(tuple, got), key=str) == [("La  hora", "/j/La_Hora.jpg"), ("Otra", None)]
    assert loading.seeded(themes.limit(0), themes).count() == loading.seeded(themes, themes.limit(1)).count() == 3
    owned = spark.createDataFrame([(1, "x"), (2, "y")], "owner long, name string")
    left, kept = loading.cascade(themes, spark.createDataFrame([(1,)], "id long"), owned, "id", "owner")
    assert left.count() == 2 and [r["name"] for r in kept.collect()] == ["y"]
    assert loading.by_id(themes.union(themes)).count() == 3 and loading.missing_keys(["Moda", "q", "q", "Arte"], themes, "name") == ["q"]


def test_scope(spark):
    df = spark.createDataFrame([(1, "2020-01-01"), (2, None), (3, None)], "article_id long, published_at string")
    links = spark.createDataFrame([(1, "t1"), (1, "t2"), (3, "t9")], "article_id long, theme string")
    ids = lambda **more: [r["article_id"] for r in corpus.Scope(**more).apply(df, themes=links).orderBy("article_id").collect()]
    assert ids(themes=("t1", "t2")) == [1] and ids(themes=()) == ids(ids=()) == [] and ids(ids=(2, 5)) == [2]
    assert ids(published=True) == [1] and ids(published=False) == [2, 3]
    with pytest.raises(ValueError):
        search.boolean(df, "uno", [("OR", "dos"), ("OR", "tres"), ("NOT", "cuatro")])


def test_chains(spark):
    words = lexis.pair_words(spark.createDataFrame([(1, "mar azul sol azul mar azul")], "article_id long, body string"))
    assert [tuple(r) for r in lexis.predecessors(words, "azul").collect()] == [("mar", 2, 2 / 3), ("sol", 1, 1 / 3)]
    w = spark.createDataFrame([("x", 3.0, 1.0), ("y", 1.0, 3.0), ("z", 0.0, 0.0)], "token string, w1 double, w2 double")
    assert [tuple(r) for r in vectors.style_words(w, 1).collect()] == [(1, "x", 3.0), (2, "y", 3.0)]
    points = spark.createDataFrame([("a", 1901, 1.0), ("a", 1900, 0.0), ("b", 1900, 1.0), ("b", 1902, 0.5), ("c", 1900, 0.0)], "author string, year int, z double")
    assert {r["author"]: r["trend"].split()[0] for r in vectors.trend(points).collect()} == {"a": "Innovador", "b": "Convergente", "c": "Sin"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name , Text\n x ,"two\nlines, ""q"""\n,\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("x", 'two\nlines, "q"')]
    (tmp_path / "a.json").write_text('[{"canon": "A", "articulos": [{"slug": "s"}]}]')
    assert readers.read_json(spark, str(tmp_path / "a.json")).first()["articulos"][0]["slug"] == "s"
    (tmp_path / "l.tsv").write_text("﻿Luz\tluces\nir\tvoy\nir\n", encoding="utf-8")
    assert {tuple(r) for r in readers.read_lemmas(spark, str(tmp_path / "l.tsv")).select("form", "lemma").collect()} == {("luces", "luz"), ("voy", "ir"), ("luz", "luz"), ("ir", "ir")}
    df = spark.createDataFrame([(1, 'a "b", c', None)], "i long, s string, n string")
    readers.write_csv(df, str(tmp_path / "out"))
    assert readers.read_csv(spark, str(tmp_path / "out")).first()["s"] == 'a "b", c'
    readers.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["s"] == 'a "b", c'
    assert readers.list_files(spark, str(tmp_path / "a.json")).first()["length"] > 0


def sheet(path, rows):
    """A small workbook: shared, inline and number cells."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared, lines = [], []
    for i, row in enumerate(rows, 1):
        cells = ""
        for j, x in enumerate(row):
            if isinstance(x, int):
                cells += f'<c r="{"ABC"[j]}{i}"><v>{x}</v></c>'
            elif x and j == 0:
                cells += f'<c r="A{i}" t="inlineStr"><is><t>{x}</t></is></c>'
            elif x:
                shared.append(x)
                cells += f'<c r="{"ABC"[j]}{i}" t="s"><v>{len(shared) - 1}</v></c>'
        lines.append(f'<row r="{i}">{cells}</row>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>")


def test_spreadsheets(spark, tmp_path):
    sheet(tmp_path / "a.xlsx", [["id", "Título", "n"], ["x", "uno", 3], ["", "", ""], ["y", "", 4]])
    assert [tuple(r) for r in spreadsheets.read_xlsx(spark, str(tmp_path / "a.xlsx")).collect()] == [("x", "uno", "3"), ("y", "", "4")]
    sheet(tmp_path / "b.xlsx", [["ficha"], ["", "", "x"], ["id", "Título", "n"], ["z", "dos", 5]])
    assert [tuple(r) for r in spreadsheets.read_xlsx(spark, str(tmp_path / "b.xlsx"), "Título").collect()] == [("z", "dos", "5")]


def plain_balance(text):
    return len(re.findall("<div", text)) - len(re.findall("</div>", text))


def test_balanced_pages(spark):
    """Every page ends with as many closing tags as opening ones or fewer opening ones without a class."""
    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")[["page_id", "html"]]
    got = html.balanced(spark.createDataFrame(pages), "html").toPandas()
    assert all(plain_balance(b) == 0 or b == a for a, b in zip(pages.sort_values("page_id").html.dropna(), got.sort_values("page_id").html.dropna()))
