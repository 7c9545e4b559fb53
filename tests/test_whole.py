"""Queries read whole texts; rows that a shorter reading would lose."""
import re

import pandas as pd
from pyspark.sql import functions as F

from quirefold.functions import values as V
from quirefold.plans import archive, composed, finding, index, reports, values  # noqa: F401 - they register their queries
from quirefold.plans.queries import QUERIES


def rows(spark, path, name, **tables):
    for table, df in tables.items():
        df.to_parquet(path / f"{table}.parquet", index=False)
    return sorted(map(tuple, QUERIES[name](spark, str(path)).collect()))


def test_id_list_whole_text(spark, tmp_path):
    docs = pd.DataFrame({"doc_id": [1, 2], "text": ["a 7 " + "x" * 500 + " 8 08 123456789012 " + "9" * 25, "x" * 400]})
    assert rows(spark, tmp_path, "fn35_id_list", documents=docs) == [(1, 3), (2, 0)]


def test_unique_slugs_whole_url(spark, tmp_path):
    pages = pd.DataFrame({"page_id": [1, 2, 3], "url": ["http://example.com/en/page/one", "http://example.com/en/page/two", "http://example.com/en/page/One/"]})
    want = [("http-example-com-en-page-one", 1), ("http-example-com-en-page-one-1", 3), ("http-example-com-en-page-two", 2)]
    assert rows(spark, tmp_path, "fn31_unique_slugs", pages=pages) == want


def test_html_whole_text(spark, tmp_path):
    long = "w " * 150
    docs = pd.DataFrame({"doc_id": [4, 5, 6, 7], "text": [long + "fin", long + '</div><div class="Estrofa">y', long + "QUÉ", long + '</div><div class="EstrofaX">z']})
    got = {r[0]: r[1:] for r in rows(spark, tmp_path, "q25_article_columns", documents=docs)}
    assert got[4][0].startswith(long + "fin") and got[5][0].endswith("y c <") and got[6][1] == long + "QUÉ& D" and got[7][0].endswith("z")
    assert rows(spark, tmp_path, "q23_caption_search", documents=docs) == [(6, long + "QUÉ& D")]
    assert rows(spark, tmp_path, "fn20_has_verse", documents=docs) == [(4, False), (5, True), (6, False), (7, True)]


def test_fuzzy_match_all_parts(spark, tmp_path):
    """Every part name against every other, by brute force; only one of the ids is a supplier's."""
    names = ["red bolt", "bolt red", "red nut", "blue nut plate", "plate of steel", "Réd Bolt plate", "alone", "", None, "x y", "red bolt", "nut red", "nut", "red red"]
    part = pd.DataFrame({"p_partkey": range(1, len(names) + 1), "p_name": names})
    plain = [re.sub("[^a-z]+", " ", (n or "").lower().replace("é", "e")).split() for n in names]
    words = {i: {w for w in ws if len(w) >= 3} for i, ws in zip(part.p_partkey, plain)}
    want = []
    for i, a in words.items():
        near = [(-len(a & b) / min(len(a), len(b)), -len(a & b) / len(a | b), j) for j, b in words.items() if a & b and 2 * len(a & b) >= min(len(a), len(b))]
        want += [(i, j, round(-o, 6), round(-q, 6), r) for r, (o, q, j) in enumerate(sorted(near)[:3], 1)]
    assert rows(spark, tmp_path, "q29_fuzzy_match", part=part, supplier=pd.DataFrame({"s_suppkey": [1]})) == sorted(want)


def test_entropy_all_words(spark, tmp_path):
    """Rare words stay, and so do words on a band edge: 'edge' has nine followers of 1/27 each, so exactly 0.5."""
    texts = ["rare word"] + [f"edge {c * 3}" for c in "abcdefghi"] + ["edge"] * 18
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "s"})
    labels = pd.DataFrame({"doc_id": [0], "quality": [1], "toxic": [0]})
    assert rows(spark, tmp_path, "fn53_entropy_level", documents=docs, labels=labels) == [("edge", "variado"), ("rare", "insuficiente")]
    got = {r[0]: (r[1], r[-1]) for r in rows(spark, tmp_path, "ag26_entropy", documents=docs, labels=labels)}
    assert got == {"edge": (27, True), "rare": (1, False)}
    below = spark.range(1).select(V.entropy_label(F.lit(0.5 - 1e-12), F.lit(True)).alias("x"))
    assert below.first()["x"] == "variado"


def test_author_counts_all_magazines(spark, tmp_path):
    """Articles of every magazine, and of none, count."""
    docs = pd.DataFrame({"doc_id": [24, 47, 70, 93, 25], "text": "uno dos", "lang": ["es", "fr", "es", "en", "fr"], "source": ["src1", "src2", None, "src1", "src3"]})
    few = "Este autor tiene solo {} prosas publicado(s); los resultados pueden ser poco fiables."
    want = [("a0", 1, 4, few.format(1)), ("a1", 3, 4, None), ("a2", 1, 4, few.format(1)), ("a4", 1, 4, few.format(1))]
    labels = pd.DataFrame({"doc_id": [24], "quality": [1], "toxic": [0]})
    assert rows(spark, tmp_path, "ag20_author_counts", documents=docs, labels=labels) == want
