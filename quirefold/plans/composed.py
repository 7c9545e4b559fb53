"""Registered queries over fragments, predecessors, trends, themes and HTML texts, with their SQL."""
from pyspark.sql import functions as F

from ..functions import fragments, html
from ..functions import text as T
from ..functions import values as V
from ..operators import corpus, lexis, loading, search, vectors
from ..operators.corpus import Scope
from .queries import ARTICLES, AUTHORS, CHAIN, FOLD, SPACE, SQL, TFIDF2, WORDS, _has, _pairs, _style, query, t

SQUASH = "trim(regexp_replace({}, '" + SPACE.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g'), ' ')"


def _fragment(column, at, width, around):
    """SQL of a single-hit fragment."""
    before = SQUASH.format(f"substring({column}, greatest(1, {at} - {around}), {at} - greatest(1, {at} - {around}))")
    after = SQUASH.format(f"substring({column}, {at} + {width}, {around})")
    return f"trim({before} || ' **' || substring({column}, {at}, {width}) || '** ' || {after}, ' ')"


def _place(column, word):
    return f"instr({FOLD.format(column)}, '{word}')"


@query(f"with {ARTICLES}, h as (select article_id, body, {_place('body', 'que')} as spot from articles) select article_id, {_fragment('body', 'spot', 3, 50)} as fragment from h where spot > 0")
def fn24_fragment(spark, d):
    h = corpus.articles(spark, d, flags=False).withColumn("at", F.instr(T.fold(F.coalesce("body", F.lit(""))), "que")).where("at > 0")
    return h.select("article_id", fragments.single("body", F.col("at"), F.lit(3)).alias("fragment"))


@query(f"""with {ARTICLES} select article_id, case when {_place('body', 'que')} > 0 then {_fragment('body', _place('body', 'que'), 3, 80)} when {_place('body', 'con')} > 0 then {_fragment('body', _place('body', 'con'), 3, 80)} else title end as fragment
  from articles where not coalesce(is_advert, false) and ({_has('que')} or {_has('con')}) and year >= 1905 and year <= 1930""")
def q22_search_fragments(spark, d):
    a = Scope(adverts=False, year_from=1905, year_to=1930).apply(corpus.articles(spark, d))
    return search.boolean(a, "que", [("OR", "con")]).select("article_id", fragments.search("body", "title", ["que", "con"]).alias("fragment"))


@query(f"with {CHAIN} select bi.word as predecessor, n, round(cast(n as double) / un.total, 6) as p from bi join un on un.word = bi.successor where bi.successor = 'the' order by n desc, predecessor limit 10")
def q07_chain_predecessors(spark, d):
    return lexis.predecessors(_pairs(spark, d), "the").withColumn("p", F.round("p", 6))


@query(f"""with {TFIDF2}, r as (select token, round(w1, 6) as w1, round(w2, 6) as w2, row_number() over (order by round(w1 - w2, 9) desc, token) as r1, row_number() over (order by round(w1 - w2, 9), token) as r2 from s)
  select 1 as side, token, w1 as weight from r where r1 <= 10 union all select 2, token, w2 from r where r2 <= 10""")
def q02_style_words(spark, d):
    return vectors.style_words(_style(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"""with d as ({SQL['q05_drift']}), e as (select author, count(*) as points, arg_max(z, year) - arg_min(z, year) as difference from d group by author)
  select author, points, case when points < 2 then 'Sin datos suficientes' when difference > 0.5 then 'Innovador (z-score creciente: el autor se aleja de la norma)' when difference < -0.3 then 'Convergente (z-score decreciente: el autor se acerca a la norma)' else 'Estable (variación inferior a 0,3σ)' end as trend from e""")
def q05_trend(spark, d):
    a = Scope(languages=("es", "fr")).apply(corpus.articles(spark, d, flags=False))
    points = vectors.drift(a, corpus.authors(spark, d)).select("author", "year", F.round("z", 4).alias("z"))
    return vectors.trend(points)


@query(f"""with {ARTICLES}, {AUTHORS}, a as (select author, year, {WORDS} as words from articles join authors using (article_id) where language in ('es', 'fr')), n as (select author, count(*) as articles from a group by author),
  r as (select count(distinct author) as reference from a where year is not null and len(words) > 0)
  select author, articles, reference, case when articles < 3 then 'Este autor tiene solo ' || articles || ' prosas publicado(s); los resultados pueden ser poco fiables.' end as warning from n, r""")
def ag20_author_counts(spark, d):
    a = Scope(languages=("es", "fr")).apply(corpus.articles(spark, d, flags=False)).join(corpus.authors(spark, d), "article_id")
    told = a.where(F.col("year").isNotNull() & (F.size(T.tokens(F.col("body"))) > 0)).agg(F.countDistinct("author").alias("reference"))
    counts = a.groupBy("author").agg(F.count("*").alias("articles"))
    return counts.crossJoin(F.broadcast(told)).select("author", "articles", "reference", V.author_warning(F.col("articles"), "prosas").alias("warning"))


@query("with c as (select vec_id as category, embedding as c from embeddings where vec_id < 10) select category, 1900 + vec_id % 37 as year, count(*) as n from embeddings, c where list_dot_product(embedding::double[], c::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(c::double[], c::double[]))) >= 0.28 group by all")
def ag31_trends_by_year(spark, d):
    e = t(spark, d, "embeddings")
    return vectors.trends(e.withColumn("year", F.lit(1900) + F.col("vec_id") % 37), e.where("vec_id < 10"), by="year")


@query(f"with {ARTICLES}, themes as (select doc_id as article_id, 't' || (doc_id % 9) as theme from documents union select doc_id, 't' || (doc_id % 5) from documents where doc_id % 4 = 0) select magazine, count(*) as n from articles where article_id in (select article_id from themes where theme in ('t1', 't4')) group by magazine")
def jn05_themes(spark, d):
    a = Scope(themes=("t1", "t4")).apply(corpus.articles(spark, d, flags=False), themes=corpus.themes(spark, d))
    return a.groupBy("magazine").agg(F.count("*").alias("n"))


@query(f"with {ARTICLES} select article_id, title from articles where article_id in (3, 5, 8) union all select article_id, title from articles where false")
def pf13_id_lists(spark, d):
    a = corpus.articles(spark, d, flags=False)
    return Scope(ids=(3, 5, 8)).apply(a).union(Scope(ids=()).apply(a)).select("article_id", "title")


ANCHORS = "regexp_replace(coalesce(html, ''), '(?i)<a[^>]*href=\"javascript:[^\"]*\"[^>]*>.*?</a>', '{}', 'g')"
OPENED = "regexp_replace(regexp_replace(regexp_replace({}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?i)<br\\s*/?>|</p>', chr(10), 'g')"
NAMED = "replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')"


@query("select page_id, " + SQUASH.format("replace(replace(" + NAMED.format("regexp_replace(" + OPENED.format(ANCHORS.format(" ")) + ", '<[^>]+>', ' ', 'g')") + ", '&#39;', ''''), '&apos;', '''')") + " as body from pages")
def fn12_index_text(spark, d):
    return t(spark, d, "pages").select("page_id", html.index_text("html").alias("body"))


@query("select page_id, regexp_replace(replace(" + ANCHORS.format("") + ", '&nbsp;', ' '), '^" + SPACE + "+|" + SPACE + "+$', '', 'g') as html from pages")
def fn18_sanitised(spark, d):
    return t(spark, d, "pages").select("page_id", html.sanitised("html").alias("html"))


def _units(html, pattern, code):
    """SQL of a text in which numeric entities are the signs of their units."""
    return f"array_to_string(list_transform(list_zip(string_split_regex({html}, '{pattern}'), list_concat(list_transform(regexp_extract_all({html}, '{pattern}', 1), lambda n: {code}), [''])), lambda z: z[1] || z[2]), '')"


TYPOGRAPHIC = "replace(replace(replace(replace(replace(replace(replace({}, '&apos;', ''''), '&mdash;', '—'), '&ndash;', '–'), '&ldquo;', '“'), '&rdquo;', '”'), '&lsquo;', '‘'), '&rsquo;', '’')"
STRIPPED = "regexp_replace(" + OPENED.format("coalesce(html, '')") + ", '<[^>]+>', '', 'g')"


@query(f"with a as (select page_id, {STRIPPED} as x from pages), b as (select page_id, {_units('x', '&#([0-9]{1,38});', 'chr(cast(cast(n as hugeint) % 65536 as int))')} as x from a), c as (select page_id, {_units('x', '&#x([0-9a-fA-F]{1,32});', 'chr(cast((chr(48) || chr(120) || right(n, 4)) as int))')} as x from b) select page_id, {TYPOGRAPHIC.format(NAMED.format('x'))} as body from c")
def fn11_search_text(spark, d):
    return t(spark, d, "pages").select("page_id", html.search_text("html").alias("body"))


@query()
def fn19_balanced(spark, d):
    return html.balanced(t(spark, d, "pages").select("page_id", "html"), "html")


@query("select r_regionkey, theme, id as theme_id from (select r_regionkey, '  ' || lower(r_name) as theme from region) r join (select min(n_regionkey) as id, lower(r_name) as k from nation join region on n_regionkey = r_regionkey group by 2) on trim(theme) = k")
def jn17_theme_links(spark, d):
    region = t(spark, d, "region")
    named = t(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_regionkey").alias("id"), F.col("r_name").alias("name"))
    return loading.theme_links(region.select("r_regionkey", F.concat(F.lit("  "), F.lower("r_name")).alias("theme")), named)


@query("select doc_id, cast(coalesce(quality, 0) + coalesce(toxic, 0) as bigint) as activity, printf('%.2f', case when n_chars % 125 = 0 and n_chars // 125 % 2 = 1 then (n_chars // 10 + 1) / 100.0 else n_chars / 1000.0 end) as thousands from documents left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) using (doc_id)")
def ag35_activity(spark, d):
    labels = t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    out = t(spark, d, "documents").join(labels, "doc_id", "left")
    return out.select("doc_id", V.activity("quality", "toxic").cast("long").alias("activity"), V.two_decimals(F.col("n_chars") / 1000).alias("thousands"))
