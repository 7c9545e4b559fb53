"""Toxicity by multiple-instance learning: sentences are instances, noisy-or combines them, document labels train them."""
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def units(word: str) -> tuple[str, ...]:
    """The word and its beginnings, which inflected and joined forms share."""
    return (word, f"{word[:4]}~", f"{word[:5]}~") if len(word) > 5 else (word, f"{word[:4]}~") if len(word) > 4 else (word,)


def sentences(text: str, vocabulary: dict) -> list[tuple[str, list[int]]]:
    """Sentences that hold units of the vocabulary, with those units' indices."""
    out = []
    for s in SENTENCE.split(text.lower()):
        if found := sorted({vocabulary[u] for w in WORD.findall(s) for u in units(w) if u in vocabulary}):
            out.append((s, found))
    return out


def combine(sums, bias: float) -> float:
    """Noisy-or of sentence scores: 1 - prod(1 - sigmoid(sum + bias))."""
    return 1.0 - math.exp(-sum(np.logaddexp(0.0, x + bias) for x in sums)) if sums else 0.0


def fit(texts: list[str], labels: list[int], words: int = 300, rounds: int = 200) -> tuple[dict, float]:
    """Weights of units and bias. Units are kept where they mark toxic texts with z above 3.5 and a lift above 2.

    They must also stand between as many different neighbours in toxic texts as a fiftieth of these texts, three at
    least: the words of one text that has many copies always stand between the same.
    """
    n = [Counter(labels)[0], Counter(labels)[1]]
    each = lambda text: {u for w in set(WORD.findall(text.lower())) for u in units(w)}
    hits = Counter(u for text, y in zip(texts, labels) if y for u in each(text))
    hits = {u: k for u, k in hits.items() if k >= 3}
    others = Counter(u for text, y in zip(texts, labels) if not y for u in each(text) if u in hits)
    marks = {}
    for w, k in hits.items():
        a, b = k / max(n[1], 1), others[w] / max(n[0], 1)
        pool = (k + others[w]) / max(sum(n), 1)
        se = math.sqrt(pool * (1 - pool) * (1 / max(n[1], 1) + 1 / max(n[0], 1))) or 1.0
        if (a - b) / se > 3.5 and a > 2 * b:
            marks[w] = (a - b) / se
    places = {w: set() for w in marks}
    for text in (t for t, y in zip(texts, labels) if y):
        found = WORD.findall(text.lower())
        for w, a, b in zip(found, ["", *found], [*found[1:], ""]):
            for u in units(w):
                if u in places:
                    places[u].add((a, b))
    picked = [(z, w) for w, z in marks.items() if len(places[w]) >= max(3, n[1] / 50)]
    vocabulary = {w: i for i, (_, w) in enumerate(sorted(picked, reverse=True)[:words])}
    bags, sents, feats, y = [], [], [], []
    for text, label in zip(texts, labels):
        if found := sentences(text, vocabulary):
            for _, ids in found:
                feats += ids
                sents += [len(bags)] * len(ids)
                bags.append(len(y))
            y.append(label)
    weights, bias = np.full(len(vocabulary), 3.0), -2.0
    if not y:
        return {}, bias
    bags, sents, feats, y = map(np.array, (bags, sents, feats, y))
    m, v = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(sents, weights[feats], len(bags)) + bias)))
        none = np.exp(np.bincount(bags, np.log1p(-np.clip(p, 0, 1 - 1e-9)), len(y)))
        doc = np.clip(1 - none, 1e-6, 1 - 1e-6)
        slope = np.where(y == 1, -none / doc, 1.0)[bags] * p
        grad = np.append(np.bincount(feats, slope[sents], len(weights)) + 0.1 * weights, slope.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    return {w: float(weights[i]) for w, i in vocabulary.items()}, float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, max_chars: int = 20000) -> tuple[dict, float]:
    """Fit on at most ``sample`` labelled texts of at most ``max_chars``, by the hash of doc_id, outside the held-out fifth."""
    rows = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
            .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = (docs.select("doc_id", "text").where(F.length("text") <= max_chars)
             .join(F.broadcast(rows), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(sample).collect())
    return fit([r["text"] for r in texts], [int(r["toxic"] == 1) for r in texts])


def toxicity_score(docs: DataFrame, model: tuple[dict, float]) -> DataFrame:
    """score, predicted and the offending sentence of each whole text; all columns of docs stay.

    Null and empty texts score 0; repeated rows and ties stay and score alike; an empty table gives an empty result.
    Columns of docs named like the new ones are replaced.
    """
    weights, bias = model
    vocabulary = {w: i for i, w in enumerate(weights)}
    values = list(weights.values())

    @F.pandas_udf("struct<score:double,worst:string>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            found = [(sum(values[i] for i in ids), s) for s, ids in sentences(text or "", vocabulary)]
            out.append((combine([x for x, _ in found], bias), max(found)[1].strip() if found else None))
        return pd.DataFrame(out, columns=["score", "worst"])

    judged = small_batches(docs).withColumn("__judged", judge("text"))
    return judged.withColumns({"score": F.col("__judged.score"), "worst_sentence": F.col("__judged.worst"),
                               "predicted": (F.col("__judged.score") >= 0.5).cast("int")}).drop("__judged")
