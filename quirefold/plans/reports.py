"""Registered queries over root proximity, parameterised statements, nested responses and relation updates, with their SQL."""
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import corpus, lexis, loading, responses, roots
from ..operators.corpus import Scope
from ..sources import readers
from .queries import ARTICLES, AUTHORS, HITS, _prose, query, t


@query()
def q08_root_proximity(spark, d):
    """Spanish and French articles in which the roots of two words stand at most four words apart, with the passage."""
    a = corpus.with_authors(Scope(languages=("es", "fr"), adverts=False).apply(corpus.articles(spark, d)))
    return roots.root_hits(a, "que", "los", 4)


@query()
def q08_root_hits(spark, d):
    """Articles whose text, title or authors hold a root, with the first passage or the title."""
    a = corpus.with_authors(Scope(languages=("es",), adverts=False).apply(corpus.articles(spark, d)))
    return roots.root_hits(a, "cione")


MARKED = "select doc_id, lang, n_chars from docs where lang = $1 and n_chars >= $2 and source <> $3 and text not like '%$1%' -- as $1\n"


@query("select doc_id, lang, n_chars from documents where lang = 'es' and n_chars >= 500 and source <> 'src1'' or ''1''=''1' and text not like '%$1%'")
def sc02_parameterised(spark, d):
    """A statement with numbered markers; the last value holds quotes."""
    return readers.sql(spark, MARKED, ["es", 500, "src1' or '1'='1"], docs=t(spark, d, "documents"))


@query(f"""with {HITS}, {AUTHORS}, m as (select magazine as k, cast(sum(n) as bigint) as n, count(distinct article_id) as a from hits where n > 0 and magazine is not null group by magazine),
  w as (select author as k, cast(sum(n) as bigint) as n, count(distinct article_id) as a from hits join authors using (article_id) where n > 0 group by author),
  y as (select year as k, cast(sum(n) as bigint) as n, floor(cast(sum(n) as double) / sum(n_words) * 10000 * 100.0 + 0.5) / 100.0 as a from hits where year is not null group by year having sum(n) > 0)
  select cast(to_json({{'palabra': 'que', 'por_revista': (select list({{'revista': k, 'apariciones': n, 'articulos': a}} order by n desc, k) from m), 'por_autor': (select list({{'autor': k, 'apariciones': n, 'articulos': a}} order by n desc, k) from w),
    'por_anio': (select list({{'anio': k, 'apariciones': n, 'densidad': a}} order by k) from y), 'siguiente': null::varchar}}) as varchar) as response""")
def q01_response(spark, d):
    """The whole concordance of a word as one JSON text."""
    a, who = _prose(spark, d), corpus.authors(spark, d)
    fields = {"apariciones": "occurrences", "articulos": "articles"}
    magazines = responses.listed(lexis.concordance_by(a, "que", "magazine"), [("occurrences", True), ("magazine", False)], {"revista": "magazine"} | fields, "por_revista")
    authors = responses.listed(lexis.concordance_by_author(a, who, "que"), [("occurrences", True), ("author", False)], {"autor": "author"} | fields, "por_autor")
    years = responses.listed(lexis.yearly_density(a, "que"), [("year", False)], {"anio": "year", "apariciones": "occurrences", "densidad": "density"}, "por_anio")
    return responses.response(("palabra", F.lit("que")), magazines, authors, years, ("siguiente", F.lit(None).cast("string")))


@query(f"""with {ARTICLES}, h as (select magazine, issue_order, count(*) as n, min(year) as first from articles group by all), g as (select magazine, list({{'orden': issue_order, 'articulos': n, 'primero': first}} order by issue_order) as issues, sum(n) as total from h group by magazine)
  select cast(to_json({{'revistas': (select list({{'revista': magazine, 'total': cast(total as bigint), 'numeros': issues}} order by total desc, magazine nulls first) from g)}}) as varchar) as response""")
def fn74_nested_response(spark, d):
    """Magazines with their issues, two levels of one JSON text, nulls written."""
    issues = corpus.articles(spark, d, flags=False).groupBy("magazine", "issue_order").agg(F.count("*").alias("n"), F.min("year").alias("first"))
    inner = responses.grouped(issues, ["magazine"], [("issue_order", False)], {"orden": "issue_order", "articulos": "n", "primero": "first"}, "numeros")
    total = issues.groupBy("magazine").agg(F.sum("n").cast("long").alias("total"))
    both = inner.join(total, inner["magazine"].eqNullSafe(total["magazine"])).select(inner["magazine"].alias("revista"), "total", "numeros")
    return responses.response(responses.listed(both, [("total", True), ("revista", False)], name="revistas"))


SHEET = "select doc_id as article_id, ['T' || (doc_id % 7), ' t8 ', 'x' || (doc_id % 5)] as themes, case when doc_id % 4 = 0 then [] when doc_id % 4 = 1 then ['A' || (doc_id % 23), 'a2'] end as authors from documents where doc_id % 3 = 0"
LINKS = "select doc_id as article_id, doc_id % 9 as id from documents union select doc_id, doc_id % 5 from documents where doc_id % 4 = 0"


def _side(name, links, known):
    return f"""select article_id, '{name}' as relation, list_sort(list_filter(w, lambda x: not list_contains(coalesce(h, []), x))) as connect, list_sort(list_filter(coalesce(h, []), lambda x: not list_contains(w, x))) as disconnect, u as unresolved from
  (select article_id, list_distinct(list_filter(list_transform({name}, lambda x: {known}), lambda x: x is not null)) as w, list_sort(list_distinct(list_filter({name}, lambda x: {known} is null))) as u from s where {name} is not null) left join (select article_id, list(distinct id) as h from ({links}) group by 1) using (article_id)"""


KNOWN_THEME = "case when regexp_full_match(lower(trim(x)), 't[0-8]') then cast(substr(lower(trim(x)), 2) as bigint) end"
KNOWN_AUTHOR = "case when regexp_full_match(lower(trim(x)), 'a([0-9]|1[0-9]|2[0-2])') then cast(substr(lower(trim(x)), 2) as bigint) end"


@query(f"with {AUTHORS}, s as ({SHEET}), r as ({_side('themes', LINKS, KNOWN_THEME)} union all {_side('authors', 'select article_id, cast(substr(author, 2) as bigint) as id from authors', KNOWN_AUTHOR)}) select article_id, relation, array_to_string(connect, ',') as connect, array_to_string(disconnect, ',') as disconnect, array_to_string(unresolved, ',') as unresolved from r where len(connect) + len(disconnect) + len(unresolved) > 0")
def q34_sheet_update(spark, d):
    """What a sheet of articles connects to and disconnects from their themes and authors, and the names that nothing has."""
    docs = t(spark, d, "documents").where("doc_id % 3 = 0")
    none = F.lit(None).cast("array<string>")
    sheet = docs.select(F.col("doc_id").alias("article_id"), F.expr("array(concat('T', doc_id % 7), ' t8 ', concat('x', doc_id % 5))").alias("themes"),
                        F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 4 == 1, F.expr("array(concat('A', doc_id % 23), 'a2')")).otherwise(none).alias("authors"))
    number = lambda c: F.substring(F.col(c), 2, 9).cast("long").alias("id")
    links = {"themes": corpus.themes(spark, d).select("article_id", number("theme")), "authors": corpus.authors(spark, d).select("article_id", number("author"))}
    known = {"themes": spark.range(9).select("id", F.concat(F.lit("t"), "id").alias("name")), "authors": spark.range(23).select("id", F.concat(F.lit("a"), "id").alias("name"))}
    out = loading.relation_changes(sheet, links, known, "article_id")
    return out.select("article_id", "relation", *(F.array_join(c, ",").alias(c) for c in ("connect", "disconnect", "unresolved")))


SLUGGED = "left(regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9\\s-]', '', 'g')), '\\s+', '-', 'g'), '-+', '-', 'g'), 80)"


@query(f"""with s as (select p_partkey, p_name, p_size, {SLUGGED} as slug, row_number() over (partition by {SLUGGED} order by p_partkey) as n from part), o as (select distinct {SLUGGED} as slug from part where p_partkey % 40 = 1),
  f as (select lower(replace(p_name, ' ', '_')) as k, max('/covers/' || replace(p_name, ' ', '_') || '.jpg') as path from part where p_partkey % 3 = 0 group by 1)
  select p_name as title, s.slug, case when p_size % 4 <> 0 then 1900 + p_size end as first_year, case when p_size % 3 <> 0 then 1910 + p_size end as last_year, case when p_size % 5 <> 0 then 'City' end as place, path as cover, case when o.slug is null and n = 1 then 'create' else 'skip' end as action from s left join o using (slug) left join f on k = lower(replace(p_name, ' ', '_'))""")
def q35_new_publications(spark, d):
    """A sheet of magazines, made of part names, with covers by file name; slugs that are there, or come before, are skipped."""
    part = t(spark, d, "part")
    text = lambda c, no: F.when(F.col("p_size") % no != 0, c)
    sheet = part.select("p_partkey", F.col("p_name").alias("title"), F.coalesce(text((F.lit(1900) + F.col("p_size")).cast("string"), 4), F.lit("s. a.")).alias("first"), F.coalesce(text((F.lit(1910) + F.col("p_size")).cast("string"), 3), F.lit("0")).alias("last"),
                        F.coalesce(text(F.lit(" City "), 5), F.lit(" ")).alias("place"))
    there = part.where("p_partkey % 40 = 1").select(V.slug_words("p_name", 80).alias("slug"))
    files = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("/covers/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".jpg")).alias("path"))
    return loading.new_publications(sheet, there, files, ["p_partkey"])


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 43.5 else null end as lat2, case when s_suppkey % 2 = 0 then s_acctbal else -3.5 end as lng2 from supplier where s_suppkey % 3 = 0 or s_suppkey % 2 = 1")
def q39_second_place(spark, d):
    """Coordinates of a second place that a list gives, over those that are there."""
    now = t(spark, d, "supplier").select("s_suppkey", F.lit(None).cast("double").alias("lat2"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("lng2"))
    new = now.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.lit(43.5)).alias("lat2"), F.when(F.col("s_suppkey") % 2 == 1, F.lit(-3.5)).alias("lng2"))
    return loading.merge_filled(now, new, "s_suppkey", ["lat2", "lng2"], force=True)


@query("select distinct label as id, 'c' || label as nombre, label % 2 = 0 as activa from embeddings where label is not null order by id")
def q11_categories(spark, d):
    seed = t(spark, d, "embeddings").where("label is not null").select(F.col("label").alias("id"), F.concat(F.lit("c"), "label").alias("nombre"), (F.col("label") % 2 == 0).alias("activa")).distinct()
    return loading.categories(seed.limit(0), seed)


@query(f"with {ARTICLES} select year, count(*) as n, count(*) filter (is_advert) as adverts from articles where year is not null group by year order by year")
def st02_by_year(spark, d):
    """Articles and adverts of each year, years upwards."""
    a = corpus.articles(spark, d).where("year is not null")
    return a.groupBy("year").agg(F.count("*").alias("n"), F.count_if("is_advert").alias("adverts")).orderBy("year")
