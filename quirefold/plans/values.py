"""Registered queries over values, files and small updates, with their SQL."""
from pyspark.sql import functions as F

from ..functions import article, fragments
from ..functions import text as T
from ..functions import values as V
from ..operators import corpus, loading
from ..operators.corpus import Scope
from ..sources import buckets, readers
from .archive import DECODE
from .composed import SQUASH, _place
from .queries import ARTICLES, AUTHORS, query, t


@query(f"with c as (select doc_id, {SQUASH.format(DECODE.format('text'))} as c from documents) select doc_id, case when length(c) > 300 then left(c, 300) || '…' else c end as snippet from c")
def fn16_snippet(spark, d):
    return t(spark, d, "documents").select("doc_id", article.snippet("text").alias("snippet"))


@query("select doc_id, 'a' || chr(cast(doc_id % 1000 + 33 as int)) || 'b' || chr(241) || coalesce(lang, '') as decoded from documents")
def fn17_decimal_entities(spark, d):
    raw = F.concat(F.lit("a&#"), F.col("doc_id") % 1000 + 33, F.lit(";b&#"), F.col("doc_id") * 65536 + 241, F.lit(";"), F.coalesce("lang", F.lit("")))
    return t(spark, d, "documents").select("doc_id", article.decimal_entities(raw).alias("decoded"))


PAIR = "substring(body, {0}, 3)"


@query(f"""with {ARTICLES}, p as (select article_id, body, {_place('body', 'que')} as a, {_place('body', 'con')} as b from articles), q as (select article_id, body, least(a, b) as f, greatest(a, b) as s from p where a > 0 and b > 0)
  select article_id, trim({SQUASH.format('substring(body, greatest(1, f - 50), f - greatest(1, f - 50))')} || ' **' || {PAIR.format('f')} || '** ' || {SQUASH.format('substring(body, f + 3, greatest(0, s - f - 3))')} || ' **' || {PAIR.format('s')} || '** ' || {SQUASH.format('substring(body, s + 3, 50)')}, ' ') as fragment from q""")
def fn25_pair_fragment(spark, d):
    place = lambda w: F.instr(T.fold(F.coalesce("body", F.lit(""))), w)
    a = corpus.articles(spark, d, flags=False).withColumns({"a": place("que"), "b": place("con")}).where("a > 0 and b > 0")
    return a.select("article_id", fragments.pair("body", F.col("a"), F.lit(3), F.col("b"), F.lit(3)).alias("fragment"))


@query("select p_partkey, trim(regexp_replace(regexp_replace(lower(strip_accents(p_name || ' (' || p_brand || ')  Á' || p_type)), '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) as title_key from part")
def fn36_title_key(spark, d):
    return t(spark, d, "part").select("p_partkey", V.title_key(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")  Á"), "p_type")).alias("title_key"))


RAW_CELL = "case p_partkey % 5 when 0 then '  ' || p_size || 'x' when 1 then 'n' || p_size when 2 then ' TRUE ' when 3 then ' ' else '-' || p_size end"


@query(f"with r as (select p_partkey, {RAW_CELL} as cell from part) select p_partkey, try_cast(nullif(regexp_extract(cell, '^\\s*([+-]?[0-9]+)', 1), '') as int) as number, nullif(trim(cell), '') as text, lower(trim(cell)) in ('true', '1') as flag from r")
def fn38_coercions(spark, d):
    r = t(spark, d, "part").select("p_partkey", F.expr(RAW_CELL).alias("cell"))
    return r.select("p_partkey", T.leading_int("cell").alias("number"), V.blank_null(F.col("cell")).alias("text"), V.is_true(F.col("cell")).alias("flag"))


@query("select doc_id, case lang when 'es' then 'es' when 'fr' then 'fr' when 'de' then 'de' else 'es' end as code from documents")
def fn39_language_code(spark, d):
    name = F.expr("case lang when 'es' then ' Español ' when 'fr' then 'FRANCÉS' when 'de' then 'alemán' when 'en' then 'unknown' end")
    return t(spark, d, "documents").select("doc_id", V.language_code(name).alias("code"))


@query("with p as (select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\n+'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') as p from documents) select doc_id, len(p) as paragraphs, array_to_string(p, '|') as joined from p")
def fn40_paragraphs(spark, d):
    p = t(spark, d, "documents").select("doc_id", V.paragraphs(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("paragraphs"), F.array_join(F.transform("p", lambda x: x["text"]), "|").alias("joined"))


@query("select event_id, array_to_string(json_keys(props), ', ') as keys, trim(props) as unfenced from events where json_valid(props)")
def fn42_json_keys(spark, d):
    e = t(spark, d, "events").where(F.json_object_keys("props").isNotNull())
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n``` "))
    return e.select("event_id", V.json_keys(F.col("props")).alias("keys"), V.unfenced(fenced).alias("unfenced"))


@query("select vec_id, case when vec_id % 100 < 20 then 'muy similar' when vec_id % 100 < 40 then 'similar' when vec_id % 100 < 60 then 'moderado' when vec_id % 100 < 80 then 'distinto' else 'muy distinto' end as label from embeddings")
def fn52_distance_label(spark, d):
    return t(spark, d, "embeddings").select("vec_id", T.distance_label((F.col("vec_id") % 100) / 100).alias("label"))


@query("select o_orderkey, case when o_orderkey % 15 between 1 and 12 then o_orderkey % 15 end as month, nullif(o_custkey % 4, 0) as year, case when o_custkey % 3 > 0 then o_orderpriority end as place from orders")
def fn58_known_values(spark, d):
    """Months out of range, year nought and places marked as wrong are null."""
    place = F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority")).otherwise(F.concat("o_orderpriority", F.lit(" *ERR")))
    return t(spark, d, "orders").select("o_orderkey", V.month(F.col("o_orderkey") % 15).alias("month"), V.known_year(F.col("o_custkey") % 4).alias("year"), V.known_place(place).alias("place"))


@query("with p as (select s_suppkey, case when s_suppkey % 3 > 0 then s_acctbal end as lat, case when s_suppkey % 5 > 0 then s_acctbal / 2 end as lng, case when s_suppkey % 4 > 0 then s_nationkey end as f from supplier) select s_suppkey, case when (lat is null or lng is null) and f is not null then f else lat end as lat, case when (lat is null or lng is null) and f is not null then -f else lng end as lng from p")
def fn61_filled_places(spark, d):
    when = lambda no, c: F.when(F.col("s_suppkey") % no > 0, c)
    found = when(4, F.col("s_nationkey")).cast("double")
    lat, lng = V.filled_place(when(3, F.col("s_acctbal")), when(5, F.col("s_acctbal") / 2), found, -found)
    return t(spark, d, "supplier").select("s_suppkey", lat.alias("lat"), lng.alias("lng"))


@query("select vec_id, len(embedding) as n, round(list_sum(list_transform(embedding, lambda x: x::double * 3)), 4) as total from embeddings where embedding is not null")
def fn71_vector_text(spark, d):
    """Vectors written as text and read back."""
    v = t(spark, d, "embeddings").where("embedding is not null").select("vec_id", V.vector(V.vector_text(F.transform("embedding", lambda x: x.cast("double")))).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * 3), 4).alias("total"))


@query("select s_suppkey, coalesce(['#2563eb', '#dc2626', '#059669', '#d97706'][s_suppkey % 6 + 1], '#6b7280') as colour from supplier")
def wn08_colours(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", V.colour((F.col("s_suppkey") % 6 + 1).cast("int")).alias("colour"))


LINKED = "(select distinct l_orderkey as a, l_suppkey as b from lineitem where l_linenumber > 1)"
NEW_LINKS = "(select distinct l_orderkey as a, l_partkey % 10 as b from lineitem where l_orderkey % 3 = 0)"


@query(f"with e as {LINKED}, n as {NEW_LINKS} select 'add' as how, a, b from (select * from e union select * from n) union all select 'replace', a, b from e where a not in (select a from n) union all select 'replace', a, b from n union all select 'without', a, b from n where a not in (select a from e)")
def sk07_links(spark, d):
    """Links after a union, after a replacement, and those of owners without any."""
    lines = t(spark, d, "lineitem")
    held = lines.where("l_linenumber > 1").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    new = lines.where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") % 10).alias("b")).distinct()
    told = lambda how, df: df.select(F.lit(how).alias("how"), "a", "b")
    return told("add", loading.new_links(new, held, ["a", "b"])).union(told("replace", loading.new_links(new, held, ["a", "b"], True))).union(told("without", loading.links_without_owner(new, held, "a")))


@query("select c_custkey, ' ' || upper(c_name) as nombre from customer where lower(c_name) not in (select lower(c_name) from customer where c_custkey % 2 = 0)")
def sk09_insert_names(spark, d):
    """Names that are not there yet, whatever their case and edges."""
    c = t(spark, d, "customer")
    names = c.select("c_custkey", F.concat(F.lit(" "), F.upper("c_name")).alias("nombre"))
    return loading.insert_names(names, c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("nombre")))


@query("select s_suppkey as id, (s_nationkey % 2 = 0) <> (s_suppkey = 7) as activa from supplier")
def sk10_toggle(spark, d):
    return loading.toggled(t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 2 == 0).alias("activa")), 7)


@query("select 'orders' as kind, count(*) as n, sum(o_orderkey)::bigint as keys from orders where o_custkey % 7 <> 0 union all select 'lines', count(*), sum(l_orderkey)::bigint from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey % 7 = 0)")
def sk15_cascade(spark, d):
    """Orders that go take their lines along."""
    orders, lines = t(spark, d, "orders"), t(spark, d, "lineitem")
    left, kept = loading.cascade(orders, orders.where("o_custkey % 7 = 0"), lines, "o_orderkey", "l_orderkey")
    told = lambda kind, df, key: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(key).cast("long").alias("keys"))
    return told("orders", left, "o_orderkey").union(told("lines", kept, "l_orderkey"))


@query("select 'valid' as kind, count(*) as n from customer where c_custkey % 3 > 0 and c_nationkey % 4 > 0 union all select 'rest', count(*) from customer where not (c_custkey % 3 > 0 and c_nationkey % 4 > 0)")
def pf23_valid_rows(spark, d):
    """Rows with a name that isn't blank and a segment, and the rest."""
    c = t(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).otherwise("  ").alias("name"), F.when(F.col("c_nationkey") % 4 > 0, F.col("c_mktsegment")).alias("segment"))
    ok, rest = loading.valid(c, ["name", "segment"])
    told = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return told("valid", ok).union(told("rest", rest))


@query("select distinct source as name, doc_id as article_id from documents where doc_id % 2 = 0 and source is not null")
def jn16_mentioned(spark, d):
    """People and the articles that mention them, by slug; slugs of no article are dropped."""
    docs = t(spark, d, "documents").where("source is not null")
    people = docs.select(F.concat(F.lit(" "), "source").alias("canon"), F.array(F.struct(F.concat(F.lit("d"), "doc_id").alias("slug")), F.struct(F.lit("gone").alias("slug"))).alias("articulos"))
    return loading.mentioned(people, docs.where("doc_id % 2 = 0").select(F.concat(F.lit("d"), "doc_id").alias("slug"), F.col("doc_id").alias("article_id")))


@query(f"with {ARTICLES} select 'issue' as scope, article_id from articles where magazine = 'src1' and issue_order = 3 union all select 'published', article_id from articles where article_id % 3 > 0 union all select 'poems', article_id from articles where coalesce(is_poem, false) union all select 'prose', article_id from articles where not coalesce(is_poem, false) union all select 'year', article_id from articles where year = 1907")
def pf11_scopes(spark, d):
    """Articles of one issue, published ones, poems, prose and those of one year."""
    a = corpus.articles(spark, d).withColumn("published_at", F.when(F.col("article_id") % 3 > 0, F.lit("2020-01-01")))
    scopes = {"issue": Scope(magazine="src1", issue=3), "published": Scope(published=True), "poems": Scope(poems=True), "prose": Scope(poems=False), "year": Scope(year=1907)}
    out = [s.apply(a).select(F.lit(n).alias("scope"), "article_id") for n, s in scopes.items()]
    for x in out[1:]:
        out[0] = out[0].union(x)
    return out[0]


@query("with b as (select c_custkey, case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then 1800 + c_custkey % 100 end as birth_year, case when c_custkey % 5 > 0 then upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) end as birth_place from customer where c_custkey % 2 = 0 or c_custkey % 4 = 1) select * from b where c_custkey % 3 = 0")
def q30_biographic(spark, d):
    """Years and places of first-rank matches; unknown ones are null, places begin with a capital."""
    c = t(spark, d, "customer").where("c_custkey % 2 = 0 or c_custkey % 4 = 1").select("c_custkey", (F.col("c_custkey") % 3 + 1).cast("int").alias("rank"),
        F.when(F.col("c_custkey") % 4 == 0, "0").when(F.col("c_custkey") % 4 == 1, (F.lit(1800) + F.col("c_custkey") % 100).cast("string")).otherwise("x").alias("birth_year"), F.lit(None).cast("string").alias("death_year"),
        F.when(F.col("c_custkey") % 5 > 0, F.lower("c_mktsegment")).otherwise("Lugo *ERR").alias("birth_place"), F.lit(" ").alias("death_place"))
    return loading.biographic(c).select("c_custkey", "birth_year", "birth_place")


@query("select action, count(*) as n from (select case when s_suppkey is null then 'create' else 'update' end as action from part left join supplier on s_suppkey = p_partkey) group by action")
def ag33_report(spark, d):
    """How many rows of an import are created and updated."""
    new = t(spark, d, "part").select(F.col("p_partkey").alias("legacy"))
    old = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("legacy"))
    return loading.report(loading.classify(new, old, [["legacy"]]))


@query("select cast(doc_id as varchar) as doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang from documents")
def sk12_csv_round_trip(spark, d):
    """Documents written as quoted CSV and read back, line breaks and quotes in cells included."""
    path = buckets.scratch(spark, "csv")
    readers.write_csv(t(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return readers.read_csv(spark, path, trim=False)


@query("select conv_id, turn, role, text from conversations")
def sk13_json_round_trip(spark, d):
    path = buckets.scratch(spark, "json")
    readers.write_json(t(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    return spark.read.schema("conv_id long, turn long, role string, text string").json(path)


@query("with f as (select distinct lower(c_mktsegment) as lemma, lower(c_name) as form from customer) select form, lemma from f union select lemma, lemma from f where lemma not in (select form from f)")
def sc12_lemma_file(spark, d):
    """A dictionary of segments and customers, written by tabs and read; each lemma is its own form."""
    path = buckets.scratch(spark, "lemmas")
    t(spark, d, "customer").select(F.concat_ws("\t", F.upper("c_mktsegment"), "c_name").alias("value")).write.text(path)
    return readers.read_lemmas(spark, path)
