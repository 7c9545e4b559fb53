"""Landed pages, places in hot groups, running sums, publications, and name matching with frequent words."""
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions import values as V
from quirefold.operators import entities, lexis, loading, ranks
from quirefold.sources import pages


@pytest.fixture
def source(tmp_path):
    """23 elements in pages of 5; two come twice, with other names, and every fetch leaves a file."""
    log = tmp_path / "log"
    log.mkdir()
    folder = str(log)
    items = [{"id": i % 21, "l": f"név {i}", "n": None if i == 4 else i} for i in range(23)]

    def fetch(page):
        open(os.path.join(folder, f"{page}-{len(os.listdir(folder))}"), "w").close()
        return {"total": len(items), "elements": items[(page - 1) * 5:page * 5]}
    return fetch, log


def test_landing(spark, source, tmp_path):
    fetch, log = source
    path = str(tmp_path / "landed")
    landed = pages.land(spark, fetch, path, pages_a_task=2, pause=0)
    got = {r["id"]: (r["l"], r["n"]) for r in pages.elements(landed, "id int, l string, n int").collect()}
    assert got == {i: (f"név {i}", None if i == 4 else i) for i in range(21)} and landed.count() == 23
    assert sorted(int(x.split("-")[0]) for x in os.listdir(log)) == [1, 2, 3, 4, 5]
    assert pages.land(spark, fetch, path).count() == 23 and len(os.listdir(log)) == 5
    assert pages.land(spark, fetch, path, force=True, pause=0).count() == 23 and len(os.listdir(log)) == 10
    none = pages.land(spark, lambda page: {"total": 0, "elements": []}, str(tmp_path / "none"))
    assert none.count() == 0


def test_places_in_hot_groups(spark):
    """A null group with half of the rows is dealt over many tasks, and every place is given once."""
    rng = random.Random(3)
    rows = [(rng.choice([None, None, "a", "b"]), rng.choice([None, 1, 2, 3]), i) for i in range(2000)] + [(None, 1, 5)] * 50
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(8)
    # So few rows would be put together again.
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        out = ranks.numbered(df, "g", ["x", "i"])
        spread = out.where("g is null").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset(key)
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], []).append((r["place"], r["x"] is not None, r["x"] or 0, r["i"]))
    want = {g: sorted((x is not None, x or 0, i) for h, x, i in rows if h == g) for g in (None, "a", "b")}
    assert {g: [x[1:] for x in sorted(v)] for g, v in got.items()} == want and all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    assert max(r["count"] for r in spread) < 0.7 * len(want[None])
    assert ranks.numbered(df.limit(0), "g", ["x"]).isEmpty()


def test_slugs_of_null_urls(spark):
    """Half of the rows have no slug: all get different ones, in order."""
    df = spark.range(600).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("s"), F.col("id"))).alias("slug"))
    got = {r["k"]: r["slug"] for r in loading.unique_slugs(df, "slug", spark.createDataFrame([], "slug string"), ["k"]).collect()}
    assert got == {k: f"s{k}" if k % 2 == 0 else f"-{k // 2}" if k > 1 else "" for k in range(600)}


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 1001])
def test_running_sums(spark, n):
    values = [random.Random(n).randint(0, 9) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "x array<int>").select(F.expr(T.running("x")).alias("s"))
    assert df.first()["s"] == [sum(values[:i]) for i in range(n)]


def test_keyword_lines_of_a_long_text(spark):
    text = " ".join(random.Random(1).choice(["mar", "Már", "sol"]) for _ in range(5000))
    df = spark.createDataFrame([(1, text, "m", 1900), (2, None, "m", 1900), (3, "sol", "m", None)], "article_id long, body string, magazine string, year int")
    got = lexis.keyword_lines(df, "mar").orderBy("hit").collect()
    assert [r["place"] for r in got] == [m.start() + 1 for m in re.finditer("m[aá]r", text.lower())] and [r["hit"] for r in got] == list(range(len(got)))


def test_publications(spark):
    sheet = spark.createDataFrame([(1, " La Luz ", "1920", "x", " "), (2, "La luz", "0", "1925", "Sevilla"), (3, "Alfar", None, None, None), (4, "Mar", "1927", "1927", "Lugo"), (5, None, None, None, None)], "n int, title string, first string, last string, place string")
    files = spark.createDataFrame([("/c/La_Luz.jpg",), ("/c/alfar.png",)], "path string")
    got = loading.new_publications(sheet, spark.createDataFrame([("mar",)], "slug string"), files, ["n"]).collect()
    assert sorted(((r["title"], r["slug"], r["first_year"], r["last_year"], r["place"], r["cover"], r["action"]) for r in got), key=str) == sorted([
        ("La Luz", "la-luz", 1920, None, None, "/c/La_Luz.jpg", "create"), ("La luz", "la-luz", None, 1925, "Sevilla", "/c/La_Luz.jpg", "skip"), ("Alfar", "alfar", None, None, None, "/c/alfar.png", "create"),
        ("Mar", "mar", 1927, 1927, "Lugo", None, "skip"), ("", "", None, None, None, None, "create")], key=str)


def plain_matches(left, right, k=3):
    out = []
    for i, a in left.items():
        near = sorted((-len(a & b) / min(len(a), len(b)), -len(a & b) / len(a | b), j) for j, b in right.items() if a & b and 2 * len(a & b) >= min(len(a), len(b)))
        out += [(i, j, round(-o, 9), round(-q, 9), r) for r, (o, q, j) in enumerate(near[:k], 1)]
    return sorted(out)


def test_matches_with_frequent_words(spark):
    """A word that most names have meets few sets, and no match is lost."""
    rng = random.Random(9)
    words = ["garcia"] + ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(30)]
    names = {i: " ".join(["garcia"] * (rng.random() < 0.7) + rng.sample(words[1:], rng.randint(1, 4))) for i in range(150)}
    names |= {200: "garcia", 201: "Garcia de la", 202: ""}
    df = spark.createDataFrame(list(names.items()), "id long, name string").withColumn("activity", F.lit(0))
    sets = {i: {w.lower() for w in n.split() if len(w) >= 3} for i, n in names.items()}
    got = sorted((r["id"], r["match_id"], round(r["overlap"], 9), round(r["jaccard"], 9), r["rank"]) for r in entities.fuzzy_match(df, df).collect())
    assert got == plain_matches({i: s for i, s in sets.items() if s}, {i: s for i, s in sets.items() if s})


def test_small_ones(spark):
    now = spark.range(1).select(V.iso_now().alias("t"), F.unix_millis(F.current_timestamp()).alias("ms")).first()
    import datetime
    assert datetime.datetime.strptime(now["t"], "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=datetime.timezone.utc).timestamp() * 1000 == pytest.approx(now["ms"], abs=1)
    table = spark.createDataFrame([(2, "b"), (1, "a")], "id int, nombre string")
    assert [r["id"] for r in loading.categories(table, table.limit(0)).collect()] == [1, 2] == [r["id"] for r in loading.categories(table.limit(0), table).collect()]
