"""Registered queries over lexical chains, index updates and change sets, with their SQL."""
from pyspark.sql import functions as F

from ..operators import chains, corpus
from ..sources import buckets
from .queries import ARTICLES, AUTHORS, PAIRS, query, t

CHAIN_AUTHORS = ["a3", "a9", "a1", "nobody"]
ASKED = ", ".join(f"('{a}')" for a in ["", *CHAIN_AUTHORS])


def _corpus(spark, d):
    return corpus.with_authors(corpus.articles(spark, d, flags=False))


@query(f"""with {ARTICLES}, {AUTHORS}, p as (select article_id, {PAIRS} as words from articles where language in ('fr', 'en')),
  l as (select '' as a, words from p where len(words) > 0 union all select author, words from p join authors using (article_id) where author in ('a3', 'a9', 'a1') and len(words) > 0),
  b as (select a, x[1] as word, x[2] as next, count(*) as n from (select a, unnest(list_zip(words[1:-2], words[2:])) as x from l where len(words) > 1) group by all),
  f as (select a, sum(len(list_filter(words, lambda w: w = 'the'))) as frequency from l group by a),
  s as (select a, next as token, n, cast(n as double) / frequency as p from b join f using (a) where word = 'the'), e as (select a, -sum(p * log2(p)) as h, count(*) as m from s group by a),
  c as (select token, p as pc from s where a = ''), r as (select *, row_number() over (partition by a order by n desc, token) as r from s left join c using (token)),
  q as (select a, word as token, n, cast(n as double) / frequency as p, row_number() over (partition by a order by n desc, word) as r from b join f using (a) where next = 'the')
  select nullif(a, '') as author, 'successor' as part, cast(r as int) as rank, token, n, round(p, 6) as p, round(coalesce(pc, 0.0), 6) as p_corpus, round(p - coalesce(pc, 0.0), 6) + 0.0 as deviation, null as state, null::bigint as frequency,
    null::double as entropy, null::double as entropy_max, null::double as entropy_norm, null::boolean as reliable, null as label, null::double as entropy_difference from r where r <= 10
  union all select nullif(a, ''), 'predecessor', cast(r as int), token, n, round(p, 6), null, null, null, null, null, null, null, null, null, null from q where r <= 10
  union all select nullif(w.a, ''), 'level', null, null, null, null, null, null, case when w.a <> '' and w.a not in (select author from authors) then 'unknown' when w.a <> '' and f.a is null then 'no texts' when coalesce(frequency, 0) = 0 then 'absent' else 'ok' end,
    coalesce(frequency, 0), round(h, 6), round(log2(m), 6), case when frequency > 0 then round(case when m > 1 then h / log2(m) else 0 end, 6) end, case when frequency > 0 then frequency >= 5 end,
    case when frequency is null then null when frequency < 5 then 'insuficiente' when round(case when m > 1 then h / log2(m) else 0 end, 9) < 0.25 then 'convencional' when round(h / log2(m), 9) < 0.5 then 'moderado' when round(h / log2(m), 9) < 0.75 then 'variado' else 'innovador' end,
    case when w.a <> '' then round(h - (select h from e where a = ''), 6) + 0.0 end from (values {ASKED}) w(a) left join f on f.a = w.a left join e on e.a = w.a""")
def q07_lexical_chains(spark, d):
    counts = chains.pair_counts(_corpus(spark, d), F.col("language").isin("fr", "en"), CHAIN_AUTHORS, "the")
    out = chains.lexical_chains(counts, "the", CHAIN_AUTHORS)
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("p", "p_corpus", "deviation", "entropy", "entropy_max", "entropy_norm", "entropy_difference")})


# A tenth of the articles is edited, some are deleted, and some are new to the index.
EDITED, DELETED, INSERTED = "article_id % 10 = 3", "article_id % 50 = 7", "article_id % 50 = 9"


@query(f"""with {ARTICLES}, now as (select article_id, language, case when {EDITED} then 'the edited text ' || coalesce(body, '') else body end as body from articles where not {DELETED}),
  p as (select {PAIRS} as words from now where language in ('fr', 'en')), b as (select unnest(list_zip(words, list_concat(words[2:], [null]))) as x from p where len(words) > 0) select x[1] as word, x[2] as successor, count(*) as n from b group by all""")
def q27_index_update(spark, d):
    """The written index of the articles before, after the signed counts of the changed ones have been added to it as a batch."""
    scope = F.col("language").isin("fr", "en")
    before = _corpus(spark, d).where(f"not {INSERTED}")
    path = buckets.scratch(spark, "pairs")
    chains.add_batch(path, "first", before, scope=scope)
    after = _corpus(spark, d).where(f"not {DELETED}").withColumn("body", F.when(F.expr(EDITED), F.concat(F.lit("the edited text "), F.coalesce("body", F.lit("")))).otherwise(F.col("body")))
    chains.add_batch(path, "edits", after.where(f"{EDITED} or {INSERTED}"), before.where(f"{EDITED} or {DELETED}"), scope)
    return chains.indexed_counts(spark, path).where(F.col("kind") == chains.PAIR).select("word", "successor", "n")


# Orders with returned lines get the sum of their lines as price and a new status; some keys are new, some go.
CHANGES = """(select l_orderkey as o_orderkey, 'R' as o_orderstatus, sum(l_extendedprice) as o_totalprice, false as _delete from lineitem where l_returnflag = 'R' and l_orderkey % 10 <> 0 group by l_orderkey
  union all select o_orderkey, null, null, true from orders where o_orderkey % 10 = 0 and o_custkey % 2 = 0 union all select -o_orderkey, 'N', null, false from orders where o_orderkey % 97 = 1)"""


def _changes(spark, d):
    orders, lines = t(spark, d, "orders"), t(spark, d, "lineitem")
    none = F.lit(None).cast("double").alias("o_totalprice")
    returned = lines.where("l_returnflag = 'R' and l_orderkey % 10 != 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("o_totalprice"))
    returned = returned.select("o_orderkey", F.lit("R").alias("o_orderstatus"), "o_totalprice", F.lit(False).alias("_delete"))
    gone = orders.where("o_orderkey % 10 = 0 and o_custkey % 2 = 0").select("o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"), none, F.lit(True).alias("_delete"))
    new = orders.where("o_orderkey % 97 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), none, F.lit(False).alias("_delete"))
    return returned.union(gone).union(new)


def _orders(spark, d):
    path = buckets.scratch(spark, "orders")
    buckets.create(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path, ["o_orderkey"], 16)
    return path


@query(f"with c as {CHANGES} select coalesce(c.o_orderkey, o.o_orderkey) as o_orderkey, o_custkey, coalesce(c.o_orderstatus, o.o_orderstatus) as o_orderstatus, round(case when c.o_orderkey is null then o.o_totalprice else c.o_totalprice end, 2) as o_totalprice from orders o full join c using (o_orderkey) where not coalesce(_delete, false)")
def sk05_apply_changes(spark, d):
    """Orders after a change set of updated, new and deleted rows; a repeat of the batch and its dry run change nothing."""
    path, changes = _orders(spark, d), _changes(spark, d)
    buckets.dry_run(path, changes)
    buckets.apply(path, changes, "first")
    buckets.apply(path, changes, "first")
    return buckets.read(spark, path).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(f"with c as {CHANGES}, a as (select case when _delete and o.o_orderkey is not null then 'deleted' when o.o_orderkey is null then 'created' when c.o_orderstatus is not distinct from o.o_orderstatus and c.o_totalprice is not distinct from o.o_totalprice then 'skipped' else 'updated' end as action from c left join orders o using (o_orderkey)) select action, count(*) as dry, count(*) as applied from a group by action")
def sk14_dry_run(spark, d):
    """Counts by action of the dry run and of the run, each from the pass itself."""
    path, changes = _orders(spark, d), _changes(spark, d)
    dry, done = buckets.dry_run(path, changes), buckets.apply(path, changes, "first")
    return spark.createDataFrame([(k, dry[k], done[k]) for k in dry if dry[k] or done[k]], "action string, dry long, applied long")


@query(f"with {ARTICLES}, c as (select doc_id as article_id, max(quality) = 1 as is_poem, bool_or(coalesce(toxic, 0) = 1) as is_artwork from labels where doc_id % 3 <> 0 group by doc_id) select article_id, case when c.article_id is null then a.is_poem else coalesce(c.is_poem, false) end as is_poem, case when c.article_id is null then false else c.is_artwork end as is_artwork from (select distinct article_id, is_poem from articles) a left join c using (article_id)")
def q19_validator_save(spark, d):
    """Flags of articles after those that a reviewer marked are saved; a flag that is not given counts as false, unknown articles are left out."""
    flags = corpus.articles(spark, d).select("article_id", "is_poem", F.lit(False).alias("is_artwork")).distinct()
    path = buckets.scratch(spark, "flags")
    buckets.create(flags, path, ["article_id"], 16)
    said = t(spark, d, "labels").where("doc_id % 3 != 0").groupBy(F.col("doc_id").alias("article_id")).agg((F.max("quality") == 1).alias("is_poem"), F.max(F.coalesce("toxic", F.lit(0)) == 1).alias("is_artwork"))
    known = said.join(buckets.read(spark, path).select("article_id"), "article_id", "left_semi")
    buckets.apply(path, known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_poem", "is_artwork")}), "review")
    return buckets.read(spark, path)
