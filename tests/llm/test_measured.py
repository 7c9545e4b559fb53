"""Measured results: planted secrets, templates against brute force, held-out toxicity, and values on odd rows."""
import hashlib
import random
import re
import time
import zlib

import pandas as pd

from quirefold.llm import common, decontaminate, licenses, media, secrets, toxicity, warc
from quirefold.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def planted(rng):
    """(line, secret) of shapes that no base pattern finds, and lines that hold only names."""
    sign = lambda n, signs="ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789": "".join(rng.choice(signs) for _ in range(n))
    key = sign(rng.choice([20, 24, 32, 40]))
    shapes = [f"Authorization: Bearer {key}", f'curl -u admin -H "X-Auth: {key}" https://example.com', f"the private key is {key} for now", f"set_credentials(user, '{key}')", f"auth header {key[:12]}-{key[12:]}", f"client credential -> {key}"]
    names = ["token_provider_2024_settings = load_token_provider_2024_settings()", "auth_middleware_version_2_config applied to auth_middleware_version_2_config", "see section_3_credentials_and_private_keys_overview", "def test_password_reset_email_2_factor_flow(self):"]
    return rng.choice(shapes), key, rng.choice(names)


def test_planted_secrets():
    """At least 95 of 100 secrets that only the compressor can find, and at most 5 of 100 names taken for one."""
    rng = random.Random(6)
    hit = wrong = 0
    for _ in range(100):
        line, key, name = planted(rng)
        text = f"import os\nfrom config import settings\n{line}\nprint(settings)\n"
        base, spans = secrets.scan(text)
        assert not any(text[a:b] in key or key in text[a:b] for a, _, b in base)
        hit += any(key[:12] in text[a:b] for a, k, b in spans if k == 3)
        wrong += any(k == 3 for _, k, _ in secrets.scan(f"import os\n{name}\n{name}\nreturn value\n")[1])
    assert hit >= 95 and wrong <= 5, (hit, wrong)


def test_novel_spans_off_base_ones():
    rng = random.Random(7)
    for _ in range(50):
        text = "\n".join(rng.choice([f'password = "{rng.getrandbits(90):x}Zq"', f"secret {rng.getrandbits(120):x}", planted(rng)[0], "AKIA" + "Q7" * 9]) for _ in range(12))
        base, spans = secrets.scan(text)
        more = [x for x in spans if x[1] == 3]
        assert sorted(base + more) == spans and not any(a < d and c < b for a, _, b in more for c, _, d in base)


def test_secret_scan_is_linear():
    """Four times the candidates in one text cost about four times the time, where all identifiers of the file were sixteen."""
    rng = random.Random(8)
    took = []
    for n in (500, 2000):
        text = "\n".join(planted(rng)[0] + f" name_{i}_of_many" for i in range(n))
        began = time.process_time()
        secrets.scan(text)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5, took


def plain_words(text):
    """(raw, typed) words by the rules of the templates."""
    raw = re.findall(r"[^\W_]+(?:[.,:]\d+)*", text or "")
    units = set(decontaminate.UNITS.split())
    kind = lambda w: "<num>" if w[0].isdigit() else "<name>" if len(w) > 1 and w[0].isupper() and w[1].islower() else "<unit>" if w.lower() in units else w.lower()
    return raw, [kind(w) for w in raw]


def plain_leak(doc, item, width=8, share=0.5, least=6, consistent=0.8, apart=0.5):
    """Whether a text holds an item's template, every window of one against every window of the other."""
    (draw, dwords), (iraw, iwords) = plain_words(doc), plain_words(item)
    n = min(width, len(iwords))
    if n < decontaminate.SHORTEST:
        return False
    if n < width and sum(not w.startswith("<") for w in iwords) < decontaminate.LITERALS and len(dwords) != len(iwords):
        return False
    first = {}
    for p in range(len(iwords) - n + 1):
        first.setdefault(tuple(iwords[p:p + n]), p)
    places = {}
    for q in range(len(dwords) - n + 1):
        p = first.get(tuple(dwords[q:q + n]))
        if p is not None:
            places.setdefault(q - p, set()).add(p)
    enough = lambda k: k >= share * len(first) or k >= least
    if not enough(len(set().union(*places.values())) if places else 0):
        return False
    start = min((min(ps), off + min(ps)) for off, ps in places.items())
    for off, ps in places.items():
        if not (enough(len(ps)) or (min(ps), off + min(ps)) == start):
            continue
        p = min(ps)
        pairs = {(draw[off + j], iraw[j]) for j in range(p, len(iwords)) if off + j < len(dwords) and dwords[off + j].startswith("<") and iwords[j].startswith("<")}
        i, d = len({b for _, b in pairs}), len({a for a, _ in pairs})
        if not pairs or i >= consistent * len(pairs) and min(i, d) / len(pairs) >= apart:
            return True
    return False


def test_templates_against_brute_force(spark):
    """Items and texts from a small vocabulary, so that windows, offsets, repeats and slots meet in many ways."""
    rng = random.Random(9)
    parts = ["a", "train", "leaves", "at", "12", "30", "km", "Anna", "Otto", "the", "7", "hours", "and", "comes"]
    items = [(i, " ".join(rng.choice(parts) for _ in range(rng.choice([2, 3, 4, 6, 9, 14])))) for i in range(25)]
    change = lambda w, new: new.setdefault(w, str(rng.randint(1, 99)) if w.isdigit() else rng.choice(["Rosa", "Emil", "Karl"]) if w[0].isupper() else w)
    docs = []
    for i in range(160):
        new = {}
        body = " ".join(change(w, new) if rng.random() < 0.9 else w for w in rng.choice(items)[1].split())
        docs.append((i, " ".join([*(rng.choice(parts) for _ in range(rng.randint(0, 12))), body, *(rng.choice(parts) for _ in range(rng.randint(0, 12)))]) if i % 4 else body))
    want = sorted((d, i) for d, text in docs for i, item in items if plain_leak(text, item))
    for small in (200_000, 0):
        got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), small=small)
        assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == want and len(want) > 50


def test_decontaminate_query(spark):
    docs, items = (pd.read_parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted((d, i) for d, text in zip(docs.doc_id, docs.text) for i, item in zip(items.item_id, items.text) if plain_leak(text, item))
    assert sorted((r["doc_id"], r["item_id"]) for r in QUERIES["op2_decontaminate"](spark, SMALL).collect()) == want


def test_toxicity_query(spark, tmp_path):
    """held_out follows the checksum, held-out labels are found, and labels never reach a score."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    bad = ["idiot", "moron", "scum"]
    text = lambda toxic: ". ".join(" ".join([word() for _ in range(8)] + ([rng.choice(bad), word()] if toxic and j == 2 else [])) for j in range(5))
    label = {i: int(i % 5 == 0) for i in range(900)}
    texts = {i: text(y) for i, y in label.items()} | {2000: "", 2001: None, 2002: text(1) + " " + text(0) * 400}
    pd.DataFrame({"doc_id": list(texts), "text": list(texts.values()), "lang": "en", "source": "s", "n_chars": 1}).to_parquet(tmp_path / "documents.parquet", index=False)

    def run(labels):
        pd.DataFrame({"doc_id": list(labels), "quality": 1, "toxic": list(labels.values())}).to_parquet(tmp_path / "labels.parquet", index=False)
        return {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, str(tmp_path)).collect()}
    got = run(label)
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in got.items() if r["held_out"]} == held and len(got) == len(texts)
    toxic = [i for i in held if label.get(i)]
    clean = [i for i in held if label.get(i) == 0]
    # Chance beginnings of the random words flag 3 of 138 clean texts here.
    assert sum(got[i]["predicted"] for i in toxic) >= 0.95 * len(toxic) and sum(got[i]["predicted"] for i in clean) <= 0.05 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values()) and got[2000]["score"] == got[2001]["score"] == 0 and got[2002]["predicted"] == 1
    flipped = run({i: y if i not in held else 1 - y for i, y in label.items()})
    assert {i: r["score"] for i, r in flipped.items()} == {i: r["score"] for i, r in got.items()}


def test_odd_rows_by_value(spark):
    """Null, empty, repeated, null-id and very long texts, with a column that clashes."""
    odd = spark.createDataFrame([(1, "", "x"), (1, "", "x"), (2, None, "y"), (None, "the MIT license", "z"), (4, "w " * 20000 + "mit license", None)], "doc_id long, text string, score string")
    rows = lambda df, *names: sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
    assert rows(licenses.license_scan(odd), "doc_id", "n_words", "n_base", "first_word", "last_word", "labels", "score") == sorted(
        [(1, 0, 0, None, None, "", 0.0)] * 2 + [(2, 0, 0, None, None, "", 0.0), (None, 3, 1, 1, 1, "mit", 1.0), (4, 20002, 1, 20000, 20000, "mit", 1.0)], key=str)
    none = hashlib.sha256(b"").hexdigest()
    assert rows(secrets.secret_scan(odd), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == sorted([(i, 0, 0, 0, none, "") for i in (1, 1, 2, None, 4)], key=str)
    got = rows(media.media_columns(odd), "doc_id", "n_bytes", "payload_bytes", "tail_crc32")
    assert got == sorted([(1, 0, 576, zlib.crc32(b"\xff" * 32))] * 2 + [(2, 0, 576, zlib.crc32(b"\xff" * 32)), (None, 15, 576, zlib.crc32(b"\xff" * 32)), (4, 40011, 40320, zlib.crc32(b"\xff" * 32))], key=str)
    scored = toxicity.toxicity_score(odd, ({"mit": 9.0}, -2.0))
    assert rows(scored, "doc_id", "predicted", "worst_sentence") == sorted([(1, 0, None)] * 2 + [(2, 0, None), (None, 1, "the mit license"), (4, 1, ("w " * 20000 + "mit license"))], key=str)
    assert scored.columns.count("score") == 1 and dict(scored.dtypes)["score"] == "double"


def test_archives_are_read_by_ranges(spark):
    """One record of a stored archive is found through the directory and the index, and little else of the file is read."""
    rng = random.Random(11)
    body = lambda i: f"<p>{i}</p>" + "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    pages = spark.createDataFrame([(i, f"http://x/{i}", body(i), "response", 20_000, f"d{i}", None) for i in range(60)], "page_id long, url string, html string, record_type string, payload_bytes long, payload_digest string, refers_to long")
    stored = common.written(warc.write_archives(pages.coalesce(1), limit=150_000), "warc")
    assert stored.count() > 2
    found = warc.read_archives(stored, lambda entry: entry["url"] == "http://x/31").collect()
    assert [(r["page_id"], r["url"]) for r in found] == [(31, "http://x/31")] and warc.read_archives(stored).count() == 60
    path, size = stored.first()
    store, at = warc.fs.FileSystem.from_uri(path)
    read = []
    with store.open_input_file(at) as f:
        def read_at(start, n):
            read.append(n)
            return f.read_at(n, start)
        first = next(warc.read_archive(read_at, size))
    index = sum(len(line) for line in open(at, "rb").read().split(b"\n") if line.startswith(b'{"url"'))
    assert first[0]["WARC-Type"] == "response" and size > 150_000 and sum(read) < 65_557 + 20_000 + 2 * index + 2_000
