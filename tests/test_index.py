"""Lexical chains at two levels, incremental word-pair index, and change sets applied to bucketed tables."""
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirefold.operators import chains
from quirefold.plans import index
from quirefold.plans.queries import QUERIES
from quirefold.sources import buckets

ARTICLES = "article_id long, body string, authors array<string>, language string"
KEYS = ["author", "kind", "word", "successor"]


def plain_counts(rows):
    out = Counter()
    for _, body, authors, language in rows:
        for a in [None, *dict.fromkeys(x for x in authors or [] if x is not None)]:
            out[a, "known", None, None] += 1
            words = [w for w in (body or "").lower().split() if len(w) >= 3] if language == "es" else []
            if words:
                out[a, "texts", None, None] += 1
            for w, nxt in zip(words, [*words[1:], None]):
                out[a, "pair", w, nxt] += 1
    return dict(out)


def articles(spark, rows):
    return spark.createDataFrame(rows, ARTICLES)


def counted(df):
    return {tuple(r[k] for k in KEYS): r["n"] for r in df.collect()}


def corpus(rng, ids):
    words = ["mar", "azul", "sol", "luna", "roja", "cielo"]
    return [(i, rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))]), rng.choice([None, [], ["a"], ["a", "b"], ["b", None, "b"], ["c"]]), rng.choice(["es", "es", "en", None])) for i in ids]


def test_pair_counts(spark):
    rows = corpus(random.Random(1), range(60))
    scope = F.col("language") == "es"
    assert counted(chains.pair_counts(articles(spark, rows), scope)) == plain_counts(rows)
    some = counted(chains.pair_counts(articles(spark, rows), scope, ["b"], "mar"))
    assert some == {k: n for k, n in plain_counts(rows).items() if k[0] in (None, "b") and (k[1] != "pair" or "mar" in k[2:])}
    assert counted(chains.pair_counts(articles(spark, []), scope)) == {}


def plain_chain(counts, word, author, corpus_p):
    """(frequency, entropy, followers, successors with p, predecessors with p) of one level."""
    own = {k[2:]: n for k, n in counts.items() if k[0] == author and k[1] == "pair"}
    total = sum(n for (w, _), n in own.items() if w == word)
    after = sorted(((-n, s) for (w, s), n in own.items() if w == word and s is not None))
    before = sorted(((-n, w) for (w, s), n in own.items() if s == word))
    h = -sum(-n / total * math.log2(-n / total) for n, _ in after) if total else None
    return total, h, len(after), [(s, -n / total) for n, s in after], [(w, -n / total) for n, w in before]


def test_lexical_chains(spark):
    """Every state of a level, ties, a pair of the word with itself, deviations and entropy differences."""
    rows = corpus(random.Random(2), range(80)) + [(100, "mar mar sol mar", ["d"], "es"), (101, "mar azul", ["e"], "en"), (102, "luna sol", ["f"], "es")]
    counts = plain_counts(rows)
    df = chains.pair_counts(articles(spark, rows), F.col("language") == "es")
    got = chains.lexical_chains(df, "mar", ["a", "d", "e", "f", "zz", "a"], k=3).collect()
    levels = {r["author"]: r for r in got if r["part"] == "level"}
    assert {a: r["state"] for a, r in levels.items()} == {None: "ok", "a": "ok", "d": "ok", "e": "no texts", "f": "absent", "zz": "unknown"}
    _, h_corpus, _, corpus_after, _ = plain_chain(counts, "mar", None, {})
    for author in (None, "a", "d"):
        total, h, m, after, before = plain_chain(counts, "mar", author, {})
        r = levels[author]
        assert r["frequency"] == total and math.isclose(r["entropy"], h, abs_tol=1e-12) and math.isclose(r["entropy_max"], math.log2(m), abs_tol=1e-12) and r["reliable"] == (total >= 5)
        assert r["entropy_difference"] is None if author is None else math.isclose(r["entropy_difference"], h - h_corpus, abs_tol=1e-12)
        rows_ = sorted((x["rank"], x["token"], x["p"], x["p_corpus"], x["deviation"]) for x in got if x["author"] == author and x["part"] == "successor")
        known = dict(corpus_after)
        assert [x[:2] for x in rows_] == [(i, s) for i, (s, _) in enumerate(after[:3], 1)]
        assert all(math.isclose(x[2], p) and math.isclose(x[3], known.get(s, 0)) and math.isclose(x[4], p - known.get(s, 0), abs_tol=1e-12) for x, (s, p) in zip(rows_, after))
        assert sorted((x["rank"], x["token"]) for x in got if x["author"] == author and x["part"] == "predecessor") == [(i, w) for i, (w, _) in enumerate(before[:3], 1)]
    none = chains.lexical_chains(df, "nieve").collect()
    assert [(r["author"], r["state"], r["frequency"], r["entropy"]) for r in none] == [(None, "absent", 0, None)]
    assert chains.resolved_word(df, "ma") == "mar" and chains.resolved_word(df, "nieve") == "nieve"


def test_chains_scan_once(spark):
    """Both levels, deviations and entropies come from one scan and one tokenisation of documents."""
    counts = chains.pair_counts(index._corpus(spark, "/root/testdata/sf0.001"), F.col("language").isin("fr", "en"), index.CHAIN_AUTHORS, "the")
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("translate(") == 1
    # What follows reads the word's own rows, written once.
    after = chains.lexical_chains(counts, "the", index.CHAIN_AUTHORS)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in after and "/chain-" in after


def test_index_follows_random_edits(spark, tmp_path):
    """After each batch of edits, deletions and insertions the written index equals one built anew; a repeat changes nothing."""
    rng = random.Random(3)
    rows = {r[0]: r for r in corpus(rng, range(40))}
    scope = F.col("language") == "es"
    path = str(tmp_path / "index")
    buckets.create(chains.pair_counts(articles(spark, list(rows.values())), scope), path, KEYS, 4)
    for batch in range(3):
        gone = rng.sample(sorted(rows), 4)
        new = {r[0]: r for r in corpus(rng, [*rng.sample([i for i in rows if i not in gone], 5), 1000 + batch])}
        old = [rows[i] for i in rows if i in gone or i in new]
        delta = chains.changed_counts(articles(spark, old), articles(spark, list(new.values())), scope=scope)
        first = buckets.apply(path, delta, f"b{batch}", add="n")
        assert buckets.apply(path, delta, f"b{batch}", add="n") == first
        rows = {i: r for i, r in (rows | new).items() if i not in gone}
        assert counted(buckets.read(spark, path)) == plain_counts(rows.values())
    # All articles go: every count reaches zero.
    buckets.apply(path, chains.changed_counts(articles(spark, list(rows.values())), articles(spark, []), scope=scope), "all", add="n")
    assert buckets.read(spark, path).isEmpty() and set(buckets.applied(spark, path)) == {"b0", "b1", "b2", "all"}


def test_written_index_follows_batches(spark, tmp_path):
    """Corpus and authors after each batch equal counts made anew; a repeated batch adds nothing, and another session finds the index."""
    rng = random.Random(4)
    rows, scope, path = {r[0]: r for r in corpus(rng, range(40))}, F.col("language") == "es", str(tmp_path / "pairs")

    def same():
        want = plain_counts(rows.values())
        for a in (None, "a", "b", "c", "nobody"):
            got = {(r["kind"], r["word"], r["successor"]): r["n"] for r in chains.indexed_counts(spark, path, a).collect()}
            assert got == {k[1:]: n for k, n in want.items() if k[0] == a}
    chains.add_batch(path, "first", articles(spark, list(rows.values())), scope=scope)
    same()
    for batch in range(2):
        gone = rng.sample(sorted(rows), 4)
        new = {r[0]: r for r in corpus(rng, [*rng.sample([i for i in rows if i not in gone], 5), 1000 + batch])}
        old = [rows[i] for i in rows if i in gone or i in new]
        for _ in range(2):
            chains.add_batch(path, f"b-{batch}", articles(spark, list(new.values())), articles(spark, old), scope)
        rows = {i: r for i, r in (rows | new).items() if i not in gone}
        same()
    spark.sql(f"drop table {chains.open_index(spark, path)}")
    same()
    with pytest.raises(ValueError):
        chains.add_batch(path, "b'", articles(spark, []))


def test_index_update_reshuffles_no_index(spark, monkeypatch):
    """An update shuffles the changed articles alone, and reading the index adds up its batches where they lie."""
    monkeypatch.setattr(chains, "BUCKETS", 4)
    plan = QUERIES["q27_index_update"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan


ROWS = [(1, "a", 10), (2, None, 20), (3, "c", None), (None, "n", 1)]
TABLE = "id long, name string, n int"


def table(spark, tmp_path, rows=ROWS, name="t"):
    path = str(tmp_path / name)
    buckets.create(spark.createDataFrame(rows, TABLE), path, ["id"], 8)
    return path


def rows_of(spark, path):
    return sorted(map(tuple, buckets.read(spark, path).collect()), key=str)


def test_change_sets(spark, tmp_path):
    path = table(spark, tmp_path)
    changes = spark.createDataFrame([(1, "A", 11, None), (2, "b", None, False), (3, "c", None, False), (4, "new", 4, False), (None, None, None, True), (9, None, None, True)], TABLE + ", _delete boolean")
    want = {"created": 1, "updated": 2, "skipped": 2, "deleted": 1}
    assert buckets.dry_run(path, changes) == want and rows_of(spark, path) == sorted(ROWS, key=str)
    assert buckets.apply(path, changes, "x") == want
    after = sorted([(1, "A", 11), (2, "b", None), (3, "c", None), (4, "new", 4)], key=str)
    assert rows_of(spark, path) == after
    other = spark.createDataFrame([(1, "other", 0)], TABLE)
    assert buckets.apply(path, other, "x") == want and rows_of(spark, path) == after
    # Nulls are filled, known values stay, columns that are not given stay, and so do rows that no change names.
    assert buckets.apply(path, spark.createDataFrame([(1, None, 99), (2, "z", 22)], TABLE), "fill", how="fill") == {"created": 0, "updated": 1, "skipped": 1, "deleted": 0}
    assert buckets.apply(path, spark.createDataFrame([(3, "C")], "id long, name string"), "part")["updated"] == 1
    assert rows_of(spark, path) == sorted([(1, "A", 11), (2, "b", 22), (3, "C", None), (4, "new", 4)], key=str)
    assert buckets.apply(path, changes.limit(0), "none") == {"created": 0, "updated": 0, "skipped": 0, "deleted": 0}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    import os
    path = table(spark, tmp_path, [(i, str(i), i) for i in range(200)])
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(f"{path}/rows") for f in names if f.endswith(".parquet")}
    before = files()
    buckets.apply(path, spark.createDataFrame([(5, "five", 5)], TABLE), "one")
    assert len(before) == 8 and len(before - files()) == 1 and len(rows_of(spark, path)) == 200


def test_broken_run_is_finished_by_its_repeat(spark, tmp_path, monkeypatch):
    """Some buckets have the batch already when the driver is lost: the repeat adds the rest, and nothing twice."""
    path = table(spark, tmp_path, [(i, str(i), i) for i in range(1, 50)])
    delta = spark.createDataFrame([(i, 100) for i in range(1, 50)], "id long, n int")
    half = buckets._bucket(["id"], 8) < 4
    rows, changed, counts = buckets._merged(path, delta.where(half), "add", "replace", "n")
    buckets._told(rows, "add", changed).repartition("_bucket").write.partitionBy("_bucket").parquet(str(tmp_path / "staged"))
    spark.read.parquet(str(tmp_path / "staged")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{path}/rows")
    assert buckets.applied(spark, path) == {}
    buckets.apply(path, delta, "add", add="n")
    assert rows_of(spark, path) == sorted([(i, str(i), i + 100) for i in range(1, 50)], key=str)


def test_empty_table(spark, tmp_path):
    path = table(spark, tmp_path, [])
    assert rows_of(spark, path) == []
    assert buckets.apply(path, spark.createDataFrame(ROWS, TABLE), "fill")["created"] == 4 and rows_of(spark, path) == sorted(ROWS, key=str)


@pytest.mark.parametrize("name", ["q27_index_update", "sk05_apply_changes"])
def test_changes_take_effect(spark, name):
    """The edits of the registered queries change what they return."""
    d = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, d)
    if name == "q27_index_update":
        assert got.where("word = 'edited' and successor = 'text'").first()["n"] > 0
    else:
        assert got.where("o_orderstatus = 'R'").count() > 0 and got.where("o_orderkey < 0").count() > 0 and index._orders is not None
