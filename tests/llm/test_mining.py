"""Hard negatives, fingerprints and Merkle manifest against plain versions, and on odd rows."""
import base64
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from quirefold.llm import fingerprints, hardneg, merkle
from quirefold.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plain_negatives(rows):
    """(anchor, positive, rank, negative, positive score, negative score) with Python's integers."""
    points = list({(v, (l + 1) % 10 if v % 7 == 0 else l, tuple(math.floor(256 * x) for x in e)) for v, e, l in rows if v is not None and l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)})
    out = []
    for i, (v, label, q) in enumerate(points):
        if v % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, p[2])), p[0], p[1], j) for j, p in enumerate(points))
            for s, p, _, _ in [x for x in scored if x[2] == label and x[3] != i][:5]:
                near = [x for x in scored if x[2] != label and -80 * s <= -100 * x[0] <= -100 * s][:5]
                out += [(v, p, r, n, -s, -t) for r, (t, n, _, _) in enumerate(near, 1)]
    return sorted(out)


def mined(df):
    return sorted(map(tuple, hardneg.hard_negatives(df).collect()))


@pytest.mark.parametrize("leaf", [40, 4096])
def test_hard_negatives_against_brute_force(spark, monkeypatch, leaf):
    """Clusters, a vector that a third of the rows have, ties, repeated rows, one vec_id with two vectors, and rows that take no part."""
    monkeypatch.setattr(hardneg, "LEAF", leaf)
    rng = random.Random(3)
    common, centres = [0.5, 0.25, -0.5, 0.125, 0.0, 1.0], [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [round(x + rng.gauss(0, 0.1), 2) for x in centres[i % 12]] if i % 3 else common, rng.randint(0, 9)) for i in range(900)]
    rows += [(100, None, 1), (200, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2), (300, [float("nan")] + [0.0] * 5, 3), (400, [float("inf")] + [0.0] * 5, 3), (None, [0.1] * 6, 2), (700, [0.1] * 6, None),
             (800, [0.3] * 6, 2), (900, [0.0] * 6, 4), (100, common, 1), (100, common, 1), (-500, [-0.2] * 6, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("x"))
    assert mined(df) == plain_negatives(rows)
    assert mined(df.limit(0)) == []


def test_hard_negatives_odd_vectors(spark):
    """Short vectors count as padded; large components are scored exactly; larger ones raise an error."""
    rows = [(0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [], 1), (3, [0.5, 1.5, 9.0], 2), (4, [1.0, 1.25], 2), (5, [1.0, 1.875], 1), (100, [90000.25, 1.0], 3), (101, [90000.5, 1.0], 3), (102, [89999.0], 4)]
    pad = [(v, [*e, 0.0, 0.0, 0.0][:3], l) for v, e, l in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df) == plain_negatives(pad) != []
    with pytest.raises(Exception, match="too large"):
        mined(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e9)))


def test_dual_traversal_keeps_every_needed_pair():
    """A pair of leaves is only pruned where no inner product of theirs lies in the window; far clusters are pruned."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c * 50, 1, (64, 4)) for c in range(-4, 5)])
    labels = rng.integers(0, 3, len(x))
    tree = hardneg.fit(x, labels, 3)
    at, apart = hardneg.place(tree, x, labels)
    node = labels % hardneg.GROUPS * 8 + at
    levels = []
    for level in range(4):
        prefix = node >> (3 - level)
        held = {k: np.zeros(hardneg.GROUPS << level) for k in ("n", "radius", "label_low", "label_high", "low", "high")}
        for p in set(prefix.tolist()):
            own = prefix == p
            held["n"][p], held["radius"][p], held["label_low"][p], held["label_high"][p] = own.sum(), apart[own, level].max() + 1e-6, labels[own].min(), labels[own].max()
            held["low"][p], held["high"][p] = 9000, 30000
        levels.append(held)
    alive = hardneg.traversed(tree, levels, levels, True)
    scores = x @ x.T
    wanted = {(node[i], node[j]) for i, j in zip(*np.nonzero((scores >= 9000) & (scores <= 30000))) if labels[i] == labels[j]}
    assert all(alive[p] for p in wanted) and alive.sum() < 0.5 * len(set(node.tolist())) ** 2 / 3


def plain_cuts(data):
    """Byte by byte, as the rule says."""
    table = [xxhash.xxh32_intdigest(bytes([b])) for b in range(256)]
    out, at, h = [], 0, 0
    for i, b in enumerate(data):
        h = (h * 2 + table[b]) % 2**32
        n = i + 1 - at
        bits = fingerprints.STRICT if n < fingerprints.USUAL else fingerprints.LOOSE
        if len(data) - at > fingerprints.LEAST and (n >= fingerprints.LEAST and h >> (32 - bits) == 0 or n == fingerprints.MOST) or i + 1 == len(data):
            out.append(i + 1)
            at = i + 1
    return out


def plain_print(text):
    data = text.encode()
    ends = plain_cuts(data)
    held = {xxhash.xxh64_intdigest(data[a:b]): b - a for a, b in zip([0, *ends], ends)}
    return held, base64.b64encode(b"".join(struct.pack("<QB", d, n) for d, n in sorted(held.items()))).decode()


def plain_near(a, b):
    return sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else float(not b)


def plain_edits(docs):
    """docs: (doc_id, text) with different doc_ids, none of them null."""
    docs = sorted(((i, t or "") for i, t in docs), reverse=True)
    out = {}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        (own, told), (new, told_new), (nxt, _) = map(plain_print, (text, edited, after))
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), told, told_new, plain_near(own, new), plain_near(own, nxt))
    return out


def edits(df):
    return [(r["doc_id"], tuple(r)[1:]) for r in fingerprints.edited_documents(df).collect()]


def test_cuts():
    rng = random.Random(6)
    table = fingerprints.gears()
    for n in [*range(40), 500, 5000]:
        for data in (bytes(rng.randrange(256) for _ in range(n)), b"a" * n, bytes(rng.choice(b"ab ") for _ in range(n))):
            ends = fingerprints.cuts(data, table)
            assert ends == plain_cuts(data) and all(b - a <= fingerprints.MOST for a, b in zip([0, *ends], ends))


def test_fingerprints_against_brute_force(spark, monkeypatch):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    want = plain_edits(zip(docs.doc_id, docs.text))
    for stretch in (7, 500):
        monkeypatch.setattr(fingerprints, "STRETCH", stretch)
        got = QUERIES["op12_fingerprints"](spark, SMALL).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_fingerprints_odd_rows(spark):
    df = spark.createDataFrame([(3, "", "x"), (2, None, "y"), (2**60, "é" * 30, "z"), (2**60 + 1, "b" * 20000, None), (-4, "tail", "t")], "doc_id long, text string, n_chars string")
    got = dict(edits(df))
    assert got == plain_edits([(3, ""), (2, None), (2**60, "é" * 30), (2**60 + 1, "b" * 20000), (-4, "tail")]) and got[3][4:] == (1.0, 1.0)
    # Repeated rows, one doc_id with two texts, and null ids: each row has its place, equal rows are next to each other.
    rows = [(1, "one two three four five"), (1, "one two three four five"), (1, "another text"), (None, "nobody's own text here"), (None, "nobody's own text here")]
    got = edits(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str(i) for i, _ in got) == sorted(str(i) for i, _ in rows) and sum(x[5] == 1.0 for _, x in got) == 2
    alone = edits(spark.createDataFrame([(None, "by itself")], "doc_id long, text string"))
    assert alone == [(None, (9, hashlib.sha256(b"by itby i").hexdigest(), *alone[0][1][2:]))] and alone[0][1][5] == 1.0
    assert edits(spark.createDataFrame([], "doc_id long, text string")) == []


def test_containment(spark):
    """A passage that moves inside other text stays contained, whatever stands before it."""
    rng = random.Random(7)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = line(200)
    df = spark.createDataFrame([(passage, line(37) + " " + passage + line(500)), (passage, line(700)), (None, passage), ("", "")], "a string, b string")
    df = df.select(fingerprints.fingerprint("a").alias("a"), fingerprints.fingerprint("b").alias("b"))
    got = [r["x"] for r in df.select(fingerprints.containment("a", "b").alias("x")).collect()]
    assert got[0] > 0.9 and got[1:] == [0.0, 0.0, 1.0]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """(top, proofs) of digests, runs of 3."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 3 * 3:k // 3 * 3 + 3]
            proofs[i].append((run[:k % 3], run[k % 3 + 1:]))
        nodes = [H(*nodes[k:k + 3]) for k in range(0, len(nodes), 3)]
        at = [k // 3 for k in at]
    return nodes[0], proofs


def plain_manifest(rows):
    told = lambda *xs: H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in xs))
    groups = {}
    for i, source, lang, n, text in rows:
        leaf = told(i, source, lang, n, text)
        cut = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        groups.setdefault(source, []).append(((i is not None, i or 0), leaf, told(i, source, lang, n, cut), i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[1] for x in sorted(groups[s])]) for s in order}
    root, upper = plain_tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, upper):
        for (_, leaf, other, i), proof in zip(sorted(groups[s]), trees[s][1]):
            held = other
            for before, after in proof + up:
                held = H(*before, held, *after)
            out.append((i, leaf, trees[s][0], root, H(*(x for a, b in proof + up for x in a + b)), held, held == root))
    return sorted(out, key=str)


def manifested(df):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    cut = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted(map(tuple, merkle.manifest(df, {"text": cut}).collect()), key=str)


def test_manifest_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "é", "-", None, f"own{i}"]), rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", "x\ny", "z" * 5000, f"line {i}\n"])) for i in range(150)]
    rows += [rows[3], rows[3], (3, "a", "en", 1, "other text of the same id"), (None, "a", "en", 1, "x\n"), (None, None, None, None, None)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame(rows, schema).withColumn("leaf", F.lit("clash")).withColumn("root", F.lit(1))
    got = manifested(df)
    assert got == plain_manifest(rows) and {r[6] for r in got} == {True, False}
    for few in ([], rows[:1], rows[:3]):
        assert manifested(spark.createDataFrame(few, schema)) == (plain_manifest(few) if few else [])


def test_manifest_query(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")[["doc_id", "source", "lang", "n_chars", "text"]]
    got = sorted(map(tuple, QUERIES["op13_merkle"](spark, SMALL).collect()), key=str)
    assert got == plain_manifest(docs.itertuples(index=False, name=None))
