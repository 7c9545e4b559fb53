"""The pipeline's stages on a small corpus with planted cases, each against a plain version, and on odd rows."""
import random

import pandas as pd
import pytest

import corpus_pipeline
from quirefold.llm import common
from quirefold.llm.queries import vocabulary
from tests.llm.test_llm import plain_components, plain_pieces

COLUMNS = corpus_pipeline.COLUMNS
ITEM = "the second train leaves the old station at 12 with 30 people and comes home at 15 with 40 people on board"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    texts = {i: f"{line(25)}. {line(25)}." + (f" {word()} you idiot {word()}. {line(5)} idiot {word()}." if i % 4 == 0 else "") for i in range(240)}
    texts |= {300: texts[1], 301: texts[2] + " " + word(), 302: f"{line(20)} {ITEM} {line(20)}", 303: f"{line(20)} {ITEM.replace('12', '17').replace('30', '35')} {line(20)}",
              304: f"write to ana@mail.example or {line(10)}", 305: None, 306: "", 307: line(3000), 308: f"you {line(8)} idiot. idiot {line(4)}"}
    path = tmp_path_factory.mktemp("corpus")
    docs = pd.DataFrame({"doc_id": list(texts), "text": list(texts.values()), "lang": "en", "source": "s0"})
    docs["n_chars"] = docs.text.str.len().fillna(0).astype("int64")
    docs.to_parquet(path / "documents.parquet", index=False)
    pd.DataFrame({"doc_id": range(240), "quality": 1, "toxic": [int(i % 4 == 0) for i in range(240)]}).to_parquet(path / "labels.parquet", index=False)
    pd.DataFrame({"item_id": [1], "text": [ITEM]}).to_parquet(path / "benchmark.parquet", index=False)
    return str(path), texts


def test_stages(spark, corpus):
    from tokenizers import Tokenizer
    path, texts = corpus
    docs, kept = common.table(spark, path, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, path), name)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "packing" else docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS and docs.count() == len(kept[name])
    toxic = {i for i, t in texts.items() if t and "idiot" in t}
    assert kept["toxicity"] == {i: t for i, t in texts.items() if i not in toxic}
    root, _ = plain_components(kept["toxicity"], 5, 80)
    assert set(kept["near_duplicates"]) == {i for i in root if root[i] == i} and not {300, 301} & set(kept["near_duplicates"])
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - {302, 303}
    assert {i: t for i, t in kept["pii"].items() if t != kept["decontamination"][i]} == {304: texts[304].replace("ana@mail.example", "<EMAIL>")}
    model = Tokenizer.from_file(vocabulary())
    want = [p for i, t in kept["pii"].items() for p in plain_pieces(i, [*model.encode(t or "", add_special_tokens=False).ids, 2])]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in kept["packing"]) == sorted(want)


def test_stages_on_odd_rows(spark, corpus):
    """Nulls, empty texts, repeated rows, one doc_id with two texts, clashing columns, and no rows at all."""
    path, texts = corpus
    rows = [(1, "", "en", "s", 0, 0.9, "x"), (1, "", "en", "s", 0, 0.9, "x"), (2, None, None, None, None, None, None), (None, "one two", "en", "s", 7, 0.1, "y"),
            (None, "one two", "en", "s", 7, 0.1, "y"), (3, "a b c d e f", "en", "s", 11, 0.1, "y"), (3, "g h i j k l", "en", "s", 11, 0.1, "y"), (4, "mail a@b.cc", "en", "s", 11, 0.2, "z")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string")
    count = {"toxicity": 8, "near_duplicates": 6, "decontamination": 8, "pii": 8, "packing": 8}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, path)
        assert out.count() == count[name], name
        assert stage(spark, odd.limit(0), path).isEmpty()
        if name != "packing":
            assert out.columns == COLUMNS
        if name == "pii":
            assert {r["text"]: r["n_chars"] for r in out.where("doc_id = 4").collect()} == {"mail <EMAIL>": 12}
