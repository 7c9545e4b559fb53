"""Registered queries over article HTML, imports, word roots and advert analyses, with their SQL."""
from pyspark.sql import functions as F

from ..functions import article, html
from ..functions import text as T
from ..functions import values as V
from ..operators import corpus, lexis, loading, roots, search, vectors
from ..operators.corpus import Scope
from .queries import ARTICLES, AUTHORS, CHAIN, FOLD, KEY, WORDS, _pairs, query, t

# Article HTML made from documents alike in both engines.
PARTS = [("'<div class=\"Titulo\">t<b>x</b></div><div class=\"Normal\">'", "'</div><div class=\"NormalN\">b</div><a class=\"page\" href=\"#\">3</a>'"),
         ("'<div class=\"Estrofa\">'", "'</div><div class=\"EstrofaT\">c &lt;</div><div class=\"Normal\"> </div>'"),
         ("'<div class=\"imgbox\"><div class=\"TituloI\">'", "'&amp;&nbsp;D</div></div><a class=\"page\">4</a><div class=\"Normal\"></div>'"),
         ("'<div class=\"imgbox\"><div class=\"NormalI\">'", "'</div><div class=\"DescrI\">an ad</div></div>'")]
HTML = "case doc_id % 4 " + " ".join(f"when {i} then concat({a}, coalesce({{0}}, ''), {b})" for i, (a, b) in enumerate(PARTS)) + " end"
RAW = f"raw as (select doc_id as article_id, {HTML.format('text')} as html from documents), cut as (select article_id, regexp_replace(regexp_replace(html, '(?s)<div class=\"(?:Título|Titulo|Autor|Autortexto|DescrI)\">.*?</div>', '', 'g'), '(?s)<a class=\"page\".*?</a>', '', 'g') as html from raw)"
DECODE = "replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')"
UNTAG = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
SQUASH = "trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ')"
CAPTIONS = "array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?s)<div class=\"(?:TituloI|NormalI)\">(.*?)</div>', 1), lambda x: " + SQUASH.format(DECODE.format("regexp_replace(x, '<[^>]+>', '', 'g')")) + "), lambda x: x <> ''), chr(10))"
LEFT = "regexp_replace(regexp_replace(html, '(?s)<a class=\"page\".*?</a>', '', 'g'), '<div class=\"Normal\">\\s*</div>', '', 'g')"


def _html(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.expr(HTML.format("text")).alias("html"))


@query(f"with {RAW}, b as (select article_id, html, {LEFT} as rest from cut) select article_id, {SQUASH.format(DECODE.format(UNTAG))} as body, {CAPTIONS} as captions, len(regexp_extract_all(rest, '<div class=\"Estrofa[^\"]*\"')) + len(regexp_extract_all(rest, '<div class=\"Normal[^\"]*\"')) > 0 and len(regexp_extract_all(rest, '<div class=\"Estrofa[^\"]*\"')) >= len(regexp_extract_all(rest, '<div class=\"Normal[^\"]*\"')) as is_poem, contains(rest, '<div class=\"imgbox\">') and not contains(rest, '<div class=\"DescrI\">') and not regexp_matches(rest, '<div class=\"(?:Normal|Estrofa|Cita)') as is_artwork from b")
def q25_article_columns(spark, d):
    return html.processed(_html(spark, d)).drop("html")


@query(f"with {RAW}, c as (select article_id, {CAPTIONS} as captions from raw) select article_id, captions from c where captions <> '' and contains({FOLD.format('captions')}, 'que') order by article_id limit 20")
def q23_caption_search(spark, d):
    c = _html(spark, d).select("article_id", article.captions("html").alias("captions")).where("captions != ''")
    return search.page(c.where(F.contains(T.fold("captions"), F.lit("que"))))


@query(f"with {RAW} select article_id, len(regexp_extract_all(html, '<div class=\"Estrofa[^\"]*\"')) > 0 as has_verse from raw")
def fn20_has_verse(spark, d):
    return _html(spark, d).select("article_id", (F.regexp_count("html", F.lit('<div class="Estrofa[^"]*"')) > 0).alias("has_verse"))


ADS = f"""{ARTICLES}, tok as (select 1 as side, unnest({WORDS}) as token from articles where is_advert union all select 2, unnest({WORDS}) from articles where not coalesce(is_advert, false)),
  c as (select side, token, count(*) as n from tok group by all), l as (select side, sum(n) as len from c group by side), f as (select token, count(*) as df from c group by token),
  w as (select side, token, cast(n as double) / len * (ln((1 + (select count(*) from l)) / (1.0 + df)) + 1) as weight from c join l using (side) join f using (token)),
  s as (select token, sum(case when side = 1 then weight else 0.0 end) as w1, sum(case when side = 2 then weight else 0.0 end) as w2 from w group by token)"""


@query(f"with {ADS} select round(sum(w1 * w2) / (sqrt(sum(w1 * w1)) * sqrt(sum(w2 * w2))), 6) as similarity from s")
def q17_advert_style(spark, d):
    a = corpus.articles(spark, d)
    return vectors.style_distance(vectors.stylometry(Scope(adverts=True).apply(a), Scope(adverts=False).apply(a))).select(F.round("similarity", 6).alias("similarity"))


@query(f"with {ARTICLES} select article_id, title, coalesce(is_advert, false) as is_advert, coalesce(is_poem, false) as is_poem from articles where magazine = 'src1'")
def q18_article_flags(spark, d):
    no = F.lit(False)
    return Scope(magazine="src1").apply(corpus.articles(spark, d)).select("article_id", "title", F.coalesce("is_advert", no).alias("is_advert"), F.coalesce("is_poem", no).alias("is_poem"))


@query(f"with {ARTICLES} select distinct title from articles where is_advert order by title limit 250")
def ag04_advert_titles(spark, d):
    return Scope(adverts=True).apply(corpus.articles(spark, d)).select("title").distinct().orderBy("title").limit(250)


@query(f"with {CHAIN}, {AUTHORS} select author, word, count(*) as n from (select author, unnest(words) as word from p join authors using (article_id)) group by all")
def ag22_author_words(spark, d):
    rows = _pairs(spark, d).join(corpus.authors(spark, d), "article_id")
    return rows.select("author", F.explode("words").alias("word")).groupBy("author", "word").agg(F.count("*").alias("n"))


@query(f"with {CHAIN} select count(*) as articles, cast(sum(len(words)) as bigint) as tokens from p where len(words) > 0")
def ag24_corpus_totals(spark, d):
    return _pairs(spark, d).where("size(words) > 0").agg(F.count("*").alias("articles"), F.sum(F.size("words")).cast("long").alias("tokens"))


@query(f"""with {CHAIN}, {AUTHORS}, mine as (select words from p join authors using (article_id) where author = 'a3'), mb as (select x[2] as successor, count(*) as n from (select unnest(list_zip(words[1:-2], words[2:])) as x from mine where len(words) > 1) where x[1] = 'the' group by all),
  mt as (select count(*) as total from (select unnest(words) as word from mine) where word = 'the') select mb.successor, round(cast(mb.n as double) / mt.total, 6) as p_author, round(coalesce(cast(bi.n as double) / un.total, 0), 6) as p_corpus from mb cross join mt left join (bi join un using (word)) on word = 'the' and bi.successor = mb.successor""")
def ag28_author_deviation(spark, d):
    p = _pairs(spark, d)
    out = roots.author_deviation(p, p.join(corpus.authors(spark, d), "article_id"), "a3", "the")
    return out.select("successor", F.round("p_author", 6).alias("p_author"), F.round("p_corpus", 6).alias("p_corpus"))


@query()
def q08_root_search(spark, d):
    return roots.root_search(Scope(languages=("es",)).apply(corpus.articles(spark, d, flags=False)), "con")


@query(f"""with n as (select p_partkey as id_legacy, p_name as name, {KEY.format('p_name')} as k from part), o as (select k, min(id_legacy) as m from n where id_legacy % 3 <> 0 group by k)
  select id_legacy, name, case when m is null then 'create' when m % 3 = 1 and m = id_legacy then 'skip' else 'update' end as action from n left join o using (k)""")
def q36_author_sync(spark, d):
    new = t(spark, d, "part").select(F.col("p_partkey").alias("id_legacy"), F.col("p_name").alias("name"))
    old = new.where("id_legacy % 3 != 0").select(F.col("id_legacy").alias("id"), "name", F.when(F.col("id_legacy") % 3 == 1, F.col("id_legacy")).alias("id_legacy"))
    return loading.sync_by_name(new, old).drop("match_id")


@query("select p_partkey, case when coalesce(a.s_suppkey, b.m) is null then 'create' else 'update' end as action, coalesce(a.s_suppkey, b.m) as match_id from part left join supplier a on a.s_suppkey = p_partkey left join (select s_name, min(s_suppkey) as m from supplier group by 1) b on b.s_name = (select min(s_name) from supplier s where s.s_suppkey = p_partkey - 50)")
def q32_import_actions(spark, d):
    """Parts by their number, else by the name of the supplier fifty numbers before."""
    names = t(spark, d, "supplier").groupBy((F.col("s_suppkey") + 50).alias("p_partkey")).agg(F.min("s_name").alias("slug"))
    new = t(spark, d, "part").join(names, "p_partkey", "left").select("p_partkey", F.col("p_partkey").alias("legacy"), "slug")
    old = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("legacy"), F.col("s_name").alias("slug"))
    return loading.classify(new, old, [["legacy"], ["slug"]]).select("p_partkey", "action", "match_id")


@query(f"with s as (select page_id, url, regexp_replace(regexp_replace({FOLD.format('url')}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from pages), r as (select page_id, slug, row_number() over (partition by slug order by page_id) - 1 as n from s), k as (select regexp_extract(slug, '^(?s)(.*)-[0-9]+$', 1) as slug, list_sort(list(cast(regexp_extract(slug, '([0-9]+)$', 1) as bigint))) as ks from (select distinct slug from s where regexp_matches(slug, '-[1-9][0-9]{{0,8}}$')) group by 1) select page_id, case when n > 0 then r.slug || '-' || list_reduce(list_concat([n], coalesce(ks, [])), lambda a, x: case when x <= a then a + 1 else a end) else r.slug end as slug from r left join k using (slug)")
def fn31_unique_slugs(spark, d):
    pages = t(spark, d, "pages").select("page_id", T.slug(F.coalesce("url", F.lit(""))).alias("slug"))
    return loading.unique_slugs(pages, "slug", spark.createDataFrame([], "slug string"), ["page_id"])


@query("select l.doc_id, l.quality from (select doc_id, max(quality) as quality from labels group by doc_id) l join documents using (doc_id) where lang = 'es' and l.quality is not null")
def sk06_fill_nulls(spark, d):
    now = t(spark, d, "documents").where("lang = 'es'").select("doc_id", F.lit(None).cast("long").alias("quality"))
    new = t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return loading.merge_filled(now, new, "doc_id", ["quality"])


@query("select doc_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda x: try_cast(x as bigint)), lambda x: x is not null))) as n from documents")
def fn35_id_list(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(V.id_list(F.col("text"))).cast("long").alias("n"))


@query("select c_custkey, c_name, regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents(c_name)), '[^a-z0-9\\s-]', '', 'g')), '\\s+', '-', 'g'), '-+', '-', 'g') as slug from customer")
def fn29_slug_words(spark, d):
    return t(spark, d, "customer").select("c_custkey", "c_name", V.slug_words("c_name").alias("slug"))


@query(f"with {CHAIN}, e as (select word, max(total) as frequency, case when count(*) > 1 then -sum(cast(n as double) / total * log2(cast(n as double) / total)) / log2(count(*)) else 0 end as h from bi join un using (word) group by word) select word, case when frequency < 5 then 'insuficiente' when round(h, 9) < 0.25 then 'convencional' when round(h, 9) < 0.5 then 'moderado' when round(h, 9) < 0.75 then 'variado' else 'innovador' end as level from e")
def fn53_entropy_level(spark, d):
    return lexis.entropy(_pairs(spark, d)).select("word", V.entropy_label(F.col("h_norm"), F.col("reliable")).alias("level"))


@query(f"with {ARTICLES} select issue_order, count(*) as pages_known, cast(min(make_date(year, 1, 1)) as varchar) as first_year from articles where year is not null group by issue_order")
def fn57_first_dates(spark, d):
    return corpus.articles(spark, d, flags=False).where("year is not null").groupBy("issue_order").agg(F.count("*").alias("pages_known"), F.min(V.year_date(F.col("year"))).cast("string").alias("first_year"))
