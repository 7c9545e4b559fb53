"""Trigram index against scans, filter trees against plain Python, keyset pages against the whole order."""
import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.operators import filters, search, trigrams

SCHEMA = "article_id long, title string, body string"


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Short words of three letters, accents and empty texts, a very long text, ids in several blocks, and its index."""
    rng = random.Random(1)
    line = lambda n: "".join(rng.choice("abcá ") for _ in range(n))
    rows = [(i * 9000, rng.choice([None, "", "ab", line(6)]), rng.choice([None, "ab", line(rng.randint(0, 40))])) for i in range(60)]
    rows += [(7, "Ábc", line(3000) + "zzxy"), (8, "xyz", "a\nb"), (9, "\U0001f600ab", "ñandú")]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path_factory.mktemp("index") / "lists")
    trigrams.write(df, path, ["title", "body"], buckets=4)
    return df, path


def ids(df):
    return sorted(r["article_id"] for r in df.collect())


def test_every_term_of_three_letters(spark, texts):
    df, path = texts
    folded = {r["article_id"]: (r["t"], r["b"]) for r in df.select("article_id", *(search.T.fold(F.coalesce(c, F.lit(""))).alias(n) for c, n in (("title", "t"), ("body", "b")))).collect()}
    terms = ["".join(x) for x in random.Random(2).sample(list(itertools.product("abc", repeat=3)), 6)] + ["a b", "zzxy", "\U0001f600ab", "nandu", "qqq", "a\nb"]
    for term in terms:
        got = ids(trigrams.search(df, path, term))
        assert got == sorted(i for i, (t, b) in folded.items() if term in t or term in b), term
    assert ids(trigrams.search(df, path, "abc", scopes=["title"])) == sorted(i for i, (t, _) in folded.items() if "abc" in t)


@pytest.mark.parametrize("then", [[("AND", "bca")], [("OR", "cab"), ("NOT", "aab")], [("NOT", "abc")], [("AND", "ab"), ("OR", "cab")], [("XOR", "cab")], [("OR", "Áb c")]])
def test_chains_equal_scans(spark, texts, then):
    df, path = texts
    assert ids(trigrams.search(df, path, "Abá", then)) == ids(search.boolean(df, "aba", [(op, w.lower().replace("á", "a")) for op, w in then]))


def test_many_candidates_and_wrong_terms(spark, texts, monkeypatch):
    df, path = texts
    few = ids(trigrams.search(df, path, "abc"))
    monkeypatch.setattr(trigrams, "CANDIDATES", 0)
    assert ids(trigrams.search(df, path, "abc")) == few != []
    for wrong in (lambda: trigrams.search(df, path, "ab "), lambda: trigrams.search(df, path, "abc", scopes=[]), lambda: trigrams.search(df, path, "abc", [("OR", "abc")] * 3)):
        with pytest.raises(ValueError):
            wrong()


def test_posting_lists_of_pieces(monkeypatch):
    """Lists of many texts leave a task together, and a long text's pieces lose no trigram."""
    rng = random.Random(5)
    rows = [(i * 40000 - 80000, scope, "".join(rng.choice("ab\U0001f600ñ ") for _ in range(n))) for i, n in enumerate([3, 50, 4, 200, 7]) for scope in ("title", "body")]
    want = {(s, t[j:j + 3], i // trigrams.BLOCK, i) for i, s, t in rows for j in range(len(t) - 2)}
    batch = lambda part: pa.RecordBatch.from_pylist([dict(zip(("id", "scope", "text"), r)) for r in part])
    for listed in (1 << 20, 16):
        monkeypatch.setattr(trigrams, "LISTED", listed)
        lists = [r for b in trigrams.posting_lists(iter([batch(rows[:3]), batch(rows[3:])])) for r in b.to_pylist()]
        assert {(r["scope"], r["trigram"], r["block"], i) for r in lists for i in r["ids"]} == want and all(r["ids"] == sorted(r["ids"]) for r in lists)
        assert listed == 16 or len(lists) == len({x[:3] for x in want})
    assert list(trigrams.posting_lists(iter([]))) == []


def test_only_the_terms_lists_are_read(spark, texts):
    _, path = texts
    plan = trigrams.containing(spark, path, "abca", ["body"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") and "In(trigram" in plan


ROWS = [(i, ["x", "y", "Xy", None][i % 4], [3, 1, None, 2, 2][i % 5], i % 7) for i in range(70)]
LINKS = [(i, f"a{i % 3}", i % 2) for i in range(0, 70, 2)] + [(0, "a1", 1), (None, "a0", 0)]


def plain(tree, row, links):
    """Whether a row (dict) fits a tree; comparisons with null are out."""
    def field(v, value):
        if isinstance(value, list):
            return v is not None and v in value
        if not isinstance(value, dict):
            return v is None if value is None else v == value
        ops = {"$eq": lambda x: v is None if x is None else v == x, "$ne": lambda x: v is not None if x is None else v != x, "$eqi": lambda x: v is not None and v.lower() == x.lower(), "$gt": lambda x: v is not None and v > x,
               "$lte": lambda x: v is not None and v <= x, "$in": lambda x: v is not None and v in x, "$notIn": lambda x: v is None or v not in x, "$between": lambda x: v is not None and x[0] <= v <= x[1],
               "$null": lambda x: (v is None) == x, "$notNull": lambda x: (v is not None) == x, "$containsi": lambda x: v is not None and x.lower() in v.lower(), "$notContains": lambda x: v is None or x not in v,
               "$endsWith": lambda x: v is not None and v.endswith(x), "$not": lambda x: not field(v, x), "$or": lambda x: not x or any(field(v, y) for y in x), "$and": lambda x: all(field(v, y) for y in x)}
        return all(ops[k](x) for k, x in value.items())
    out = True
    for k, v in tree.items():
        if k == "$and":
            out &= all(plain(x, row, links) for x in v)
        elif k == "$or":
            out &= not v or any(plain(x, row, links) for x in v)
        elif k == "$not":
            out &= not plain(v, row, links)
        elif k == "links":
            out &= any(plain(v, dict(zip(("of", "author", "place"), x)), []) for x in links if x[0] == row["id"])
        else:
            out &= field(row[k], v)
    return out


TREES = [{}, {"name": "x"}, {"name": None, "n": {"$gt": 1}}, {"name": ["x", "Xy"]}, {"name": {"$in": []}}, {"name": {"$notIn": []}}, {"$or": []}, {"$not": {"n": {"$between": [2, 3]}}}, {"name": {"$ne": "x"}}, {"name": {"$ne": None}},
         {"name": {"$not": {"$containsi": "X"}}}, {"name": {"$or": [{"$eqi": "XY"}, {"$null": True}], "$notContains": "y"}}, {"$or": [{"n": 1}, {"$and": [{"n": 2}, {"k": {"$lte": 3}}]}], "$not": {"name": {"$endsWith": "y"}}},
         {"links": {"author": "a1"}}, {"links": {"author": "a1", "place": 1}, "n": {"$notNull": True}}, {"$not": {"links": {"place": 0}}}, {"$or": [{"links": {"author": "a2"}}, {"links": {"author": "a0", "place": 0}}, {"n": 3}]},
         {"$and": [{"$not": {"links": {"$or": [{"author": "a1"}, {"place": {"$eq": 0}}]}}}, {"name": {"$notNull": True}}]}]


@pytest.mark.parametrize("tree", TREES, ids=range(len(TREES)))
def test_filter_trees(spark, tree):
    df = spark.createDataFrame(ROWS, "id long, name string, n int, k int")
    links = spark.createDataFrame(LINKS, "of long, author string, place int")
    got = filters.filtered(df, tree, {"links": filters.Relation(links, "of", "id")})
    assert got.columns == df.columns
    assert sorted(r["id"] for r in got.collect()) == [r[0] for r in ROWS if plain(tree, dict(zip(("id", "name", "n", "k"), r)), LINKS)]


def test_filter_errors_and_pushdown(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for wrong in ({"nothing": 1}, {"lang": {"$like": "x"}}, {"$xor": []}, {"$or": {"lang": "es"}}):
        with pytest.raises(ValueError):
            filters.filtered(df, wrong)
    plan = filters.filtered(df, {"lang": {"$in": ["es", "fr"]}, "doc_id": {"$gte": 10}}).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1].split("\n")[0]
    assert "In(lang" in pushed and "GreaterThanOrEqual(doc_id,10)" in pushed


@pytest.mark.parametrize("order", [["n", "id"], ["n:desc", "name", "id:desc"], ["name:desc", "n:desc", "id"], ["id"]])
def test_pages_joined_are_the_whole_order(spark, order):
    df = spark.createDataFrame(ROWS, "id long, name string, n int, k int")
    whole = [tuple(r) for r in df.orderBy(*(F.desc_nulls_last(x.split(":")[0]) if x.endswith(":desc") else F.asc_nulls_first(x.split(":")[0]) for x in order)).collect()]
    joined, after = [], None
    names = [x.split(":")[0] for x in order]
    while page := filters.page_after(df, order, 16, after).collect():
        joined += map(tuple, page)
        after = tuple(page[-1][n] for n in names)
    assert joined == whole
    bounds = {r["page"]: (r["total"], tuple(r["bound"])) for r in filters.page_bounds(df, order, 16).collect()}
    at = df.columns.index
    assert bounds == {p: (70, tuple(whole[min(16 * p, 70) - 1][at(n)] for n in names)) for p in range(1, 6)}
    assert filters.page_bounds(df.limit(0), order).isEmpty()


def test_page_sizes(spark):
    df = spark.range(500)
    assert filters.page_after(df, ["id"], 300).count() == 100 and filters.page_after(df, ["id"], 0).count() == 1
    for wrong in (["id:up"], ["x"]):
        with pytest.raises(ValueError):
            filters.page_after(df, wrong)
    with pytest.raises(ValueError):
        filters.page_after(df, ["id"], 5, (1, 2))


def test_pages_with_relations(spark):
    """Fields and related rows of a page, empty arrays included; unknown names are refused."""
    df = spark.createDataFrame(ROWS, "id long, name string, n int, k int")
    links = {"links": filters.Relation(spark.createDataFrame(LINKS, "of long, author string, place int"), "of", "id")}
    got = filters.found(df, {"k": {"$gt": 2}}, ["name"], {"links": ["place", "author"]}, links, ["id:desc"], 9).collect()
    rows = sorted((r for r in ROWS if r[3] > 2), reverse=True)[:9]
    want = [(r[1], sorted((p, a) for i, a, p in LINKS if i == r[0])) for r in rows]
    assert sorted((str(r["name"]), [tuple(x) for x in r["links"]]) for r in got) == sorted((str(n), x) for n, x in want) and any(not x for _, x in want)
    for wrong in (dict(fields=["x"]), dict(populate={"x": ["y"]}), dict(order=["x"])):
        with pytest.raises(ValueError):
            filters.found(df, relations=links, **wrong)
