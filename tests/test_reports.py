"""Root proximity against plain loops, parameterised statements, nested responses, relation differences, and plans that read once."""
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quirefold.functions import html, stem
from quirefold.operators import lexis, loading, responses, roots, vectors
from quirefold.plans import composed  # noqa: F401 - it registers its queries
from quirefold.plans.queries import QUERIES
from quirefold.sources import readers

SMALL = "/root/testdata/sf0.001"
LEMMAS = {"luces": "luz", "luz": "luz"}


def root(word):
    return LEMMAS.get(word.lower(), stem.stem(word.lower()))


def squash(x):
    return re.sub(r"\s+", " ", x).strip()


def plain_hits(rows, word, second=None, distance=0, texts=True, heads=True):
    out = []
    for i, title, authors, body in rows:
        body, title = body or "", title or ""
        found = [(k, m.start(), m[0], root(m[0])) for k, m in enumerate(re.finditer(r"[^\W_]+", body))]
        one = [h for h in found if h[3] == root(word)]
        told, separation = None, None
        if second is not None:
            best = min(((abs(a[0] - b[0]), a, b) for a in one for b in found if b[3] == root(second) and abs(a[0] - b[0]) <= distance), default=None, key=lambda x: (x[0], x[1][0], x[2][0]))
            if best:
                separation, a, b = best
                (_, p, x, _), (_, q, y, _) = sorted((a, b), key=lambda h: h[1])
                told = f"{squash(body[max(0, p - 50):p])} **{x}** {squash(body[p + len(x):max(q, p + len(x))])} **{y}** {squash(body[q + len(y):q + len(y) + 50])}".strip()
        elif texts and one:
            _, p, x, _ = one[0]
            told = f"{squash(body[max(0, p - 50):p])} **{x}** {squash(body[p + len(x):p + len(x) + 50])}".strip()
        named = second is None and heads and any(root(w) == root(word) for t in [title, *(authors or [])] for w in re.findall(r"[^\W_]+", t))
        if told is not None or named:
            out.append((i, separation, told if told is not None else title))
    return sorted(out)


@pytest.fixture(scope="module")
def articles(spark):
    rng = random.Random(5)
    words = ["cantar", "Cantaba", "luz", "LUCES", "mar", "azul.", "niño", "12", "cantó,"]
    rows = [(i, rng.choice([None, "La luz", "mar"]), rng.choice([None, [], ["Ana Luces"], ["x", "y mar"]]), rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))])) for i in range(80)]
    rows += [(100, "t", None, "ñ" * 200 + " cantar " + "sol " * 300 + "luz  \n luces"), (101, "t", [], "luz luz")]
    lemmas = spark.createDataFrame(list(LEMMAS.items()), "form string, lemma string")
    return spark.createDataFrame(rows, "article_id long, title string, authors array<string>, body string"), rows, lemmas


@pytest.mark.parametrize("args", [dict(word="cantaban"), dict(word="luz", texts=False), dict(word="luz", heads=False), dict(word="luz", second="cantar", distance=3), dict(word="cantar", second="luces", distance=0), dict(word="mar", second="mar", distance=2),
                                  dict(word="luz", second="luces", distance=9), dict(word="azul", second="cantando", distance=50), dict(word="nada"), dict(word="nada", second="luz", distance=5)])
def test_root_hits(articles, args):
    df, rows, lemmas = articles
    got = sorted(map(tuple, roots.root_hits(df, lemmas=lemmas, **args).collect()))
    assert got == plain_hits(rows, **args)


def test_root_hits_errors(articles):
    df, _, _ = articles
    for args in (dict(word="ab"), dict(word="abc", second="x"), dict(word="abc", texts=False, heads=False)):
        with pytest.raises(ValueError):
            roots.root_hits(df, **args)
    assert roots.root_hits(df.limit(0), "luz").isEmpty()


def test_statements(spark):
    df = spark.createDataFrame([(1, "it's"), (2, "$1"), (3, "x' or '1'='1"), (4, None)], "id long, name string")
    run = lambda text, values=(): sorted(r["id"] for r in readers.sql(spark, text, values, people=df).collect())
    assert run("select id from people") == [1, 2, 3, 4]
    assert run("select id from people where name = ?", ["it's"]) == [1] and run("select id from people where name = :n", {"n": "x' or '1'='1"}) == [3]
    assert run("select id from people where name = '$1' or id = $2 -- $1\n or name = $1", ["it's", 3]) == [1, 2, 3]
    assert run("select id from people where array_contains($1, id)", [F.array(F.lit(1), F.lit(4))]) == [1, 4]
    assert run("select id from people where name = $1", ["x'; drop table people; --"]) == []
    with pytest.raises(ValueError):
        run("select id from people where id = $2", [1])
    assert not spark.catalog.tableExists("people")


def test_partitioned_bounds(spark):
    """The options of a partitioned database read."""
    class Reader:
        def __init__(self):
            self.held = {}

        def format(self, _):
            return self

        def options(self, **o):
            self.held = o
            return self

        def load(self):
            return self.held

    class Session:
        read = Reader()
    got = readers.read_jdbc(Session(), "jdbc:x", "articles", ("id", 0, 1000, 8), user="u")
    assert got == {"url": "jdbc:x", "dbtable": "articles", "partitionColumn": "id", "lowerBound": 0, "upperBound": 1000, "numPartitions": 8, "user": "u"}


def test_responses(spark):
    df = spark.createDataFrame([("b", 2, None), ("a", 2, 1.5), (None, 1, 0.0)], "k string, n int, x double")
    items = responses.listed(df, [("n", True), ("k", False)], {"clave": "k", "valor": "x"})
    text = responses.response(("q", F.lit('a"b')), items, ("none", F.lit(None).cast("string"))).first()[0]
    assert text == '{"q":"a\\"b","items":[{"clave":"a","valor":1.5},{"clave":"b","valor":null},{"clave":null,"valor":0.0}],"none":null}'
    assert json.loads(responses.response(items, ("none", F.lit(None).cast("string")), nulls=False).first()[0]) == {"items": [{"clave": "a", "valor": 1.5}, {"clave": "b"}, {"valor": 0.0}]}
    assert responses.response(responses.listed(df.limit(0), [("n", False)])).first()[0] == '{"items":[]}'
    inner = {r["n"]: [tuple(x) for x in r["rows"]] for r in responses.grouped(df, ["n"], [("k", False)], {"k": "k"}, "rows").collect()}
    assert inner == {2: [("a",), ("b",)], 1: [(None,)]}


def test_relation_changes(spark):
    """Applied differences give the sheet's relations; null leaves them, an empty list empties them, unknown names are told."""
    sheet = spark.createDataFrame([(1, ["Arte", " MODA ", "nada"], None), (2, [], ["x"]), (3, None, None), (4, ["arte"], []), (5, ["arte", "ARTE", None, " "], None)], "a long, temas array<string>, autores array<string>")
    links = {"temas": spark.createDataFrame([(1, 10), (1, 30), (2, 10), (3, 20), (4, 10), (9, 30)], "a long, id long"), "autores": spark.createDataFrame([(2, 7), (4, 7)], "a long, id long")}
    known = {"temas": spark.createDataFrame([(10, "arte"), (11, "Arte"), (20, "moda"), (30, "ocio")], "id long, name string"), "autores": spark.createDataFrame([(7, "x"), (8, "y")], "id long, name string")}
    changes = loading.relation_changes(sheet, links, known, "a")
    got = {(r["a"], r["relation"]): (r["connect"], r["disconnect"], r["unresolved"]) for r in changes.collect()}
    assert got == {(1, "temas"): ([20], [30], ["nada"]), (2, "temas"): ([], [10], []), (4, "autores"): ([], [7], []), (5, "temas"): ([10], [], [])}
    after = {r: sorted(map(tuple, loading.related(links[r], changes, r, "a").collect())) for r in links}
    assert after == {"temas": [(1, 10), (1, 20), (3, 20), (4, 10), (5, 10), (9, 30)], "autores": [(2, 7)]}


def test_trends_by_blocks(spark):
    """More categories than a block holds, other lengths, null and zero vectors: as pairs one by one."""
    rng = random.Random(7)
    vec = lambda n: [round(rng.gauss(0, 1), 3) for _ in range(n)]
    rows = [(i, vec(4), rng.choice([1, 2, None])) for i in range(60)] + [(70, None, 1), (71, [0.0] * 4, 1), (72, vec(3), 1), (73, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    cats = [r for r in rows if r[0] % 3 == 0 or r[0] > 69]
    want = {}
    for c, v, _ in cats:
        for _, w, y in rows:
            if v and w and len(v) == len(w) and any(v) and any(w) and sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) * sum(b * b for b in w)) ** 0.5 >= 0.28:
                want[c, y] = want.get((c, y), 0) + 1
    for most in (3, 10_000):
        got = vectors.trends(df, df.where("vec_id % 3 = 0 or vec_id > 69"), most=most).collect()
        assert {(r["category"], r["label"]): r["n"] for r in got} == want


def test_processed_balances(spark):
    """Surplus closing tags go and open boxes are closed before texts and flags are read."""
    rows = [(1, '</div><div class="imgbox"><div class="TituloI">A</div><div class="Normal">b</div>'), (2, None)]
    got = {r["k"]: r for r in html.processed(spark.createDataFrame(rows, "k long, html string")).collect()}
    assert got[1]["html"].count("<div") == got[1]["html"].count("</div>") and got[1]["captions"] == "A" and got[1]["body"] == "A b" and got[2]["html"] is None


@pytest.mark.parametrize("name, most", [("q07_chain_successors", 1), ("q07_chain_predecessors", 1), ("ag26_entropy", 1), ("q01_concordance_magazine", 2)])
def test_one_tokenisation(spark, name, most):
    """Texts are folded once for each column that is searched; before, entropies folded three times and chains five."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("lower(translate(") <= most or 1 <= plan.count("translate(") <= most, plan.count("translate(")


def test_entropy_formula(spark):
    """The one-pass formula gives the sum over successors."""
    import math
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["mar", "sol", "luz", "azul"]) for _ in range(rng.randint(1, 9)))) for i in range(30)]
    pairs, freq = {}, {}
    for _, text in rows:
        w = text.split()
        for a, b in zip(w, [*w[1:], None]):
            freq[a] = freq.get(a, 0) + 1
            if b:
                pairs.setdefault(a, {}).setdefault(b, 0)
                pairs[a][b] += 1
    got = {r["word"]: r for r in lexis.entropy(lexis.pair_words(spark.createDataFrame(rows, "article_id long, body string"))).collect()}
    assert set(got) == set(pairs)
    for w, r in got.items():
        assert math.isclose(r["h"], -sum(n / freq[w] * math.log2(n / freq[w]) for n in pairs[w].values()), abs_tol=1e-12) and (r["frequency"], r["followers"]) == (freq[w], len(pairs[w]))
