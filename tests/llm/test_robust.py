"""Workers without the library, damaged files, hot keys on both sides, and personal data side by side."""
import os
import random
import struct
import subprocess
import sys

import pytest

from quirefold.llm import media, neardup, packing, pii, urls
from quirefold.llm.common import written
from quirefold.llm.queries import RULES

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_workers_without_the_library(tmp_path):
    """Every operator with Python workers runs where only the driver can import the library."""
    script = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") and name[2].isdigit() or name == "pipeline":
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name
        print("ran", name)
"""
    (tmp_path / "run.py").write_text(script)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("PYTEST")}
    if "PYTHONPATH" in os.environ:
        env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ["PYTHONPATH"].split(os.pathsep) if os.path.abspath(p) != REPO and os.path.isabs(p))
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    assert done.returncode == 0 and done.stdout.count("ran ") == 14, done.stderr[-2000:]


def small_file(stsz, stts, stsc):
    """A container of a few hundred bytes with given tables of one track."""
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"raw ", bytes(8))), media.full(b"stts", stts), media.full(b"stsc", stsc), media.full(b"stsz", stsz), media.full(b"stco", struct.pack(">II", 1, 8)))
    mdhd = media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 8000, 8, 0, 0))
    return media.box(b"ftyp", b"isom") + media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))


def test_media_counts_that_no_file_holds(spark):
    """Huge counts in a tiny file cost no memory: too many samples give null columns, runs end with the samples."""
    import resource
    many = 4_000_000_000
    one, times, runs = struct.pack(">II", 4, 2), struct.pack(">III", 1, 2, 10), struct.pack(">IIII", 1, 1, 2, 1)
    files = [small_file(one, times, runs), small_file(struct.pack(">II", 1, many), times, runs), small_file(struct.pack(">II", 0, many), times, runs),
             small_file(one, struct.pack(">III", 1, many, 10), runs), small_file(one, struct.pack(">II", many, 2), runs), small_file(one, times, struct.pack(">IIII", 1, 1, many, 1)), small_file(one, times, struct.pack(">I", many))]
    got = {r["id"]: r["samples"] for r in media.described(spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "id long, film binary"), "film", "id").collect()}
    assert got == {0: 2, 1: None, 2: None, 3: 2, 4: 2, 5: 2, 6: None}
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for f in files:
        try:
            media.probe(f)
        except (ValueError, struct.error, IndexError):
            pass
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000


def test_hot_ids_on_both_sides(spark, monkeypatch):
    """One id in very many pairs, as the smaller or the larger one, is dealt over shares, and no pair is lost."""
    from quirefold.llm import common
    monkeypatch.setattr(common.meet, "__defaults__", (None, 50, "inner"))
    sets = spark.createDataFrame([(i, list(range(10)) + [1000 + i]) for i in range(301)], "rep long, shingles array<long>")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(i, 300) for i in range(300)], "a long, b long")
    path = common.written(pairs, "pairs")
    assert neardup.confirmed(path, sets, 80).count() == 599 and neardup.confirmed(path, sets, 90).count() == 0


def test_many_rules(spark, monkeypatch):
    """Beyond the counted size of a broadcast the rules give the same verdicts."""
    rows = [(i, f"http://h{i}.com/en/{i}") for i in range(300)] + [(500, "http://www.example.com/en/x"), (501, None)]
    pages, rules = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(RULES, "host string, path string, verdict string")
    want = sorted(map(tuple, urls.url_filter(pages, rules).collect()))
    monkeypatch.setattr(urls, "RULES", 0)
    assert sorted(map(tuple, urls.url_filter(pages, rules).collect())) == want and len(want) == 302


#: Lines written by hand, with what is personal in them.
LINES = [("card 4111111111111111 4465758382889437 end", ["4111111111111111", "4465758382889437"]), ("pay with 4465758382889437 4465758382889437 today", ["4465758382889437"] * 2),
         ("4111 1111 1111 1111 5500 0000 0000 0004 4465758382889437", ["4111 1111 1111 1111", "5500 0000 0000 0004", "4465758382889437"]),
         ("Bitte auf das Konto DE89 3704 0044 0532 0130 00 einzahlen", ["DE89 3704 0044 0532 0130 00"]), ("iban ES9121000418450200051332", ["ES9121000418450200051332"]), ("con DNI 12345678Z y nada", ["12345678Z"]),
         ("her mobile is 0171 555 8899", ["0171 555 8899"]), ("fax (020) 7946 0958", ["(020) 7946 0958"]), ("maria.gomez [at] correo [dot] org escribe", ["maria.gomez [at] correo [dot] org"]),
         ("order 1234567890123456 came", []), ("from 1999-2005 in Rome", []), ("in 1936 there were 24 000 000 people", []), ("isbn 978-3-16-148410-0", []), ("the score was 3 2 1 4 2 2 7 8 1", []), ("on 2024-01-15 at 12.30", [])]


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


def test_personal_strings_of_other_text(spark, model):
    got = pii.pii_spans(spark.createDataFrame(list(enumerate(t for t, _ in LINES)), "doc_id long, text string"), model)
    for r in got.collect():
        text, want = LINES[r["doc_id"]]
        assert [text[s["start"]:s["end"]] for s in r["found"]] == want, r
    clean = {r["doc_id"]: r["text"] for r in pii.redact(got).collect()}
    assert clean[0] == "card <CARD> <CARD> end" and clean[2] == "<CARD> <CARD> <CARD>"


def test_unions_against_brute_force(spark):
    """Every union of up to six neighbouring groups of digits with 7 to 19 digits, once, with its places."""
    import re
    rng = random.Random(4)
    texts = ["".join(rng.choice(["12", "345", "6", " ", "-", ". ", "x", "(", "+"]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").selectExpr("i", f"transform({pii.candidates('t', 'number')}, z -> concat(z.s, ' ', z.e, ' ', z.v)) as found")
    for r in rows.collect():
        want = []
        for run in re.finditer(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().-]{0,2}+[0-9])*+(?![0-9A-Za-z])", texts[r["i"]]):
            groups = list(re.finditer("[0-9]+", run[0]))
            for i, a in enumerate(groups):
                for b in groups[i:i + 6]:
                    start = a.start() - (run[0][max(0, a.start() - 1):a.start()] in ("(", "+"))
                    if 7 <= sum(c.isdigit() for c in run[0][a.start():b.end()]) <= 19:
                        want.append(f"{run.start() + start} {run.start() + b.end()} {run[0][start:b.end()]}")
        assert sorted(r["found"]) == sorted(want)


def test_exchanges_empty_bins():
    """Inputs on which the exchanges need fewer sequences than best fit."""
    saved = 0
    for seed in range(100):
        rng = random.Random(seed)
        counts = {x: rng.randint(1, 9) for x in rng.sample(range(1, 41), 12)}
        first = packing.greedy(dict(counts), 40)
        saved += sum(m for _, m in first) - sum(m for _, m in packing.improve(first, 40))
    assert saved >= 3


def test_components_with_few_rounds(spark, monkeypatch):
    """Links equal a plain union-find's groups; links that lie together take no round, so plans and tasks stay few."""
    made = []
    monkeypatch.setattr(neardup, "written", lambda df, name: made.append(name) or written(df, name))
    rng = random.Random(3)
    cases = {"path": [(i, i + 1) for i in range(1, 400)], "copies": [(7, i) for i in range(8, 3000)] + [(9, i) for i in range(10, 3000, 7)],
             "random": [(rng.randrange(900), rng.randrange(900)) for _ in range(500)], "none": []}
    for name, links in cases.items():
        low = {i: i for p in links for i in p}
        while any(low[a] != low[b] for a, b in links):
            for a, b in links:
                low[a] = low[b] = min(low[a], low[b])
        for parts in (1, 5):
            made.clear()
            got = neardup.components(spark.createDataFrame(links, "a long, b long").repartition(parts)).collect()
            assert len(got) == len({r["id"] for r in got})
            assert {r["id"]: r["component"] for r in got} | {i: i for i in low if low[i] == i} == low, (name, parts)
            assert parts > 1 or made == ["edges"], (name, made)
