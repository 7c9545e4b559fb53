"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, PII and packing, each over all rows of the last."""
from pyspark.sql import functions as F

from quirefold.llm import decontaminate, neardup, packing, pii, toxicity
from quirefold.llm.common import restricted, spent, table, written
from quirefold.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def not_toxic(spark, docs, sf_dir):
    """Drops documents that score 0.5 or more; the model learns from documents and labels.

    Null and empty texts score 0 and stay, as do repeated rows; without labelled texts all stay."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.toxicity_score(docs, model).where("predicted = 0").select(COLUMNS)


def deduplicated(spark, docs, sf_dir):
    """Keeps the smallest doc_id of each near-duplicate group (five words, 0.8), one row of it; rows of a null doc_id stay.

    Texts stay where they are, as only ids that go, and those of more than one row, are sent to them."""
    gone = written(neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    twice = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    kept = restricted(docs.select(COLUMNS), gone, "doc_id", "left_anti")
    if twice.isEmpty():
        return kept
    again = restricted(kept, twice, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(COLUMNS), F.xxhash64(*COLUMNS)).alias("row"))
    return restricted(kept, twice, "doc_id", "left_anti").union(again.select("row.*"))


def decontaminated(spark, docs, sf_dir):
    """Drops documents that hold a benchmark item's template; rows with a null doc_id or text hold none and stay."""
    leaks = written(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return restricted(docs.select(COLUMNS), leaks, "doc_id", "left_anti")


def redacted(spark, docs, sf_dir):
    """Replaces personal data in the texts; n_chars follows. Null texts stay null, with a null n_chars; repeated rows stay."""
    clean = pii.redact(pii.pii_spans(docs, pii.train(spark)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark, docs, sf_dir):
    """Sequences of at most 1024 tokens, one row a piece; null and empty texts are one end token."""
    return packing.best_fit_pack(docs, vocabulary())


STAGES = [("toxicity", not_toxic), ("near_duplicates", deduplicated), ("decontamination", decontaminated), ("pii", redacted), ("packing", packed)]
#: The trained, sketching and packing stages have no SQL; tests/llm/test_pipeline.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        # Once a stage is written, nothing reads the one before.
        spent(*done)
        done = [docs]
    return docs
