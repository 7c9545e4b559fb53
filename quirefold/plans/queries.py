"""Registered queries over the supplied tables, with their SQL."""
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, entities, lexis, search, vectors
from ..operators.corpus import Scope

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
CITIES = [(1, "france", 46.0, 2.0), (2, "germany", 51.0, 10.0), (3, "china", 35.0, 105.0), (4, "united", 54.0, -2.0), (5, "united states", 38.0, -97.0), (6, "japan", 36.0, 138.0)]
PAIR_WORDS = ("que", "los")

ARTICLES = """articles as (select d.doc_id as article_id, left(text, 60) as title, text as body, lang as language, source as magazine,
  case when d.doc_id % 41 <> 0 then cast(1900 + d.doc_id % 37 as int) end as year, cast(d.doc_id % 12 + 1 as int) as issue_order,
  toxic = 1 as is_advert, quality = 0 as is_poem from documents d left join labels using (doc_id))"""
AUTHORS = """authors as (select doc_id as article_id, 'a' || (doc_id % 23) as author, 1 as place from documents union all
  select doc_id, 'a' || (doc_id % 7), 2 from documents where doc_id % 5 = 0 and doc_id % 23 <> doc_id % 7)"""
FOLD = "lower(strip_accents(coalesce({}, '')))"
WORDS = "list_filter(string_split_regex(regexp_replace(lower(coalesce(body, '')), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' and w not in (" + STOP + "))"
PAIRS = "list_filter(list_transform(string_split_regex(regexp_replace(lower(strip_accents(coalesce(body, ''))), '[^\\p{L}\\p{N}\\s-]', ' ', 'g'), '\\s+'), lambda w: regexp_replace(w, '^-+|-+$', '', 'g')), lambda w: length(w) >= 3 and w not in (" + STOP + "))"
COUNT = "len(regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '\\b{w}\\b'))"
SPACE = "[\\t-\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
NWORDS = f"len(list_filter(string_split_regex(coalesce(body, ''), '{SPACE}+'), lambda w: w <> ''))"

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(f"with {ARTICLES} select token, count(*) as n from (select unnest({WORDS}) as token from articles where language in ('es', 'fr') and not coalesce(is_advert, false) and magazine = 'src1') where not regexp_full_match(token, '\\p{{N}}+') group by token order by n desc, token limit 150")
def q04_word_cloud_magazine(spark, d):
    return lexis.word_cloud(Scope(languages=("es", "fr"), adverts=False, magazine="src1").apply(corpus.articles(spark, d)))


@query(f"with {ARTICLES}, {AUTHORS} select token, count(*) as n from (select unnest({WORDS}) as token from articles where language in ('es', 'fr') and article_id in (select article_id from authors where author = 'a3')) where not regexp_full_match(token, '\\p{{N}}+') group by token order by n desc, token limit 150")
def q03_word_cloud_author(spark, d):
    return lexis.word_cloud(Scope(languages=("es", "fr"), author="a3").apply(corpus.articles(spark, d, flags=False), corpus.authors(spark, d)))


HITS = f"{ARTICLES}, hits as (select *, {COUNT.format(c='body', w='que')} + {COUNT.format(c='title', w='que')} as n, {NWORDS} as n_words from articles where language in ('es', 'fr') and not coalesce(is_advert, false))"


def _prose(spark, d):
    return Scope(languages=("es", "fr"), adverts=False).apply(corpus.articles(spark, d))


@query(f"with {HITS} select magazine, cast(sum(n) as bigint) as occurrences, count(distinct article_id) as articles from hits where n > 0 and magazine is not null group by magazine")
def q01_concordance_magazine(spark, d):
    return lexis.concordance_by(_prose(spark, d), "que", "magazine")


@query(f"with {HITS}, {AUTHORS} select author, cast(sum(n) as bigint) as occurrences, count(distinct article_id) as articles from hits join authors using (article_id) where n > 0 group by author")
def q01_concordance_author(spark, d):
    return lexis.concordance_by_author(_prose(spark, d), corpus.authors(spark, d), "que")


@query(f"with {HITS} select year, cast(sum(n) as bigint) as occurrences, cast(sum(n_words) as bigint) as words, case when sum(n_words) > 0 then floor(cast(sum(n) as double) / sum(n_words) * 10000 * 100.0 + 0.5) / 100.0 else 0.0 end as density from hits where year is not null group by year having sum(n) > 0")
def q01_concordance_year(spark, d):
    return lexis.yearly_density(_prose(spark, d), "que")


@query(f"""with {ARTICLES}, p as (select article_id, magazine, year, body, string_split_regex({FOLD.format('body')}, '\\bque\\b') as pieces from articles where language in ('es', 'fr') and not coalesce(is_advert, false)),
  h as (select article_id, magazine, year, body, unnest(range(len(pieces) - 1)) as hit, pieces from p where len(pieces) > 1), l as (select article_id, magazine, year, body, hit, 1 + 3 * hit + length(array_to_string(pieces[1:hit + 1], '')) as place from h)
  select article_id, magazine, year, hit, place, trim(regexp_replace(substring(body, greatest(1, place - 50), place - greatest(1, place - 50) + 53), '{SPACE}+', ' ', 'g'), ' ') as line from l""")
def q01_keyword_lines(spark, d):
    return lexis.keyword_lines(_prose(spark, d), "que")


TFIDF2 = f"""{ARTICLES}, {AUTHORS}, tok as (select 1 as side, unnest({WORDS}) as token from articles where article_id in (select article_id from authors where author = 'a1')
  union all select 2, unnest({WORDS}) from articles where article_id in (select article_id from authors where author = 'a2')),
  c as (select side, token, count(*) as n from tok group by all), l as (select side, sum(n) as len from c group by side), f as (select token, count(*) as df from c group by token),
  w as (select side, token, cast(n as double) / len * (ln((1 + (select count(*) from l)) / (1.0 + df)) + 1) as weight from c join l using (side) join f using (token)),
  s as (select token, sum(case when side = 1 then weight else 0.0 end) as w1, sum(case when side = 2 then weight else 0.0 end) as w2 from w group by token)"""


def _style(spark, d):
    a, who = corpus.articles(spark, d, flags=False), corpus.authors(spark, d)
    return vectors.stylometry(Scope(author="a1").apply(a, who), Scope(author="a2").apply(a, who))


@query(f"with {TFIDF2} select round(sum(w1 * w2) / (sqrt(sum(w1 * w1)) * sqrt(sum(w2 * w2))), 6) as similarity, round(1 - sum(w1 * w2) / (sqrt(sum(w1 * w1)) * sqrt(sum(w2 * w2))), 6) as distance from s")
def q02_style_distance(spark, d):
    return vectors.style_distance(_style(spark, d)).select(F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"))


@query(f"with {TFIDF2} select token, round(w1, 6) as w1, round(w2, 6) as w2 from s")
def ag14_tfidf(spark, d):
    return _style(spark, d).select("token", F.round("w1", 6).alias("w1"), F.round("w2", 6).alias("w2"))


@query(f"""with {ARTICLES}, {AUTHORS}, tok as (select author, year, unnest({WORDS}) as token from articles join authors using (article_id) where year is not null and language in ('es', 'fr')),
  c as (select author, year, token, count(*) as n from tok group by all), l as (select author, year, sum(n) as len from c group by all), f as (select token, count(*) as df from c group by token),
  t as (select count(*) as total from l), w as (select author, year, token, cast(n as double) / len * (ln((1 + total) / (1.0 + df)) + 1) as weight from c join l using (author, year) join f using (token), t),
  m as (select token, sum(weight) / (select total from t) as c from w group by token), x as (select sqrt(sum(c * c)) as cn from m),
  e as (select author, year, 1 - sum(weight * c) / (sqrt(sum(weight * weight)) * max(cn)) as distance from w join m using (token), x group by author, year), st as (select avg(distance) as mean, stddev_pop(distance) as std from e)
  select author, year, round(distance, 6) as distance, round((distance - mean) / std, 4) as z from e, st""")
def q05_drift(spark, d):
    a = Scope(languages=("es", "fr")).apply(corpus.articles(spark, d, flags=False))
    return vectors.drift(a, corpus.authors(spark, d)).select("author", "year", F.round("distance", 6).alias("distance"), F.round("z", 4).alias("z"))


CHAIN = f"{ARTICLES}, p as (select article_id, {PAIRS} as words from articles where language in ('fr', 'en')), b as (select unnest(list_zip(words[1:-2], words[2:])) as x from p where len(words) > 1), bi as (select x[1] as word, x[2] as successor, count(*) as n from b group by all), un as (select word, count(*) as total from (select unnest(words) as word from p) group by word)"


def _pairs(spark, d):
    return lexis.pair_words(Scope(languages=("fr", "en")).apply(corpus.articles(spark, d, flags=False)))


@query(f"with {CHAIN} select word, successor, n from bi")
def q27_bigrams(spark, d):
    return lexis.bigrams(_pairs(spark, d))


@query(f"with {CHAIN} select successor, n, round(cast(n as double) / total, 6) as p from bi join un using (word) where word = 'the' order by n desc, successor limit 10")
def q07_chain_successors(spark, d):
    return lexis.successors(_pairs(spark, d), "the").withColumn("p", F.round("p", 6))


@query(f"with {CHAIN}, e as (select word, max(total) as frequency, count(*) as followers, -sum(cast(n as double) / total * log2(cast(n as double) / total)) as h from bi join un using (word) group by word) select word, frequency, followers, round(h, 5) + 0.0 as h, round(log2(followers), 5) as h_max, round(case when followers > 1 then h / log2(followers) else 0 end, 5) as h_norm, frequency >= 5 as reliable from e")
def ag26_entropy(spark, d):
    return lexis.entropy(_pairs(spark, d)).withColumns({c: F.round(c, 5) + 0.0 for c in ("h", "h_max", "h_norm")})


@query(f"with {CHAIN} select word, total as n from un where starts_with(word, 'con') order by total desc, word limit 1")
def st12_resolve_token(spark, d):
    return lexis.resolve(lexis.unigrams(_pairs(spark, d)), "con")


@query(f"with {ARTICLES} select magazine, count(*) as n from (select magazine, unnest({PAIRS}) as word from articles where is_advert) where starts_with(word, 'th') group by magazine")
def q16_advert_prefix(spark, d):
    return lexis.prefix_counts(Scope(adverts=True).apply(corpus.articles(spark, d)), "th")


@query(f"with {ARTICLES} select magazine, year, count(*) as n from articles where is_advert group by all")
def q09_advert_frequency(spark, d):
    return Scope(adverts=True).apply(corpus.articles(spark, d)).groupBy("magazine", "year").agg(F.count("*").alias("n"))


@query("with c as (select vec_id as category, embedding as c from embeddings where vec_id < 10) select category, label, count(*) as n from embeddings, c where list_dot_product(embedding::double[], c::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(c::double[], c::double[]))) >= 0.28 group by all")
def q10_advert_trends(spark, d):
    e = t(spark, d, "embeddings")
    return vectors.trends(e, e.where("vec_id < 10"))


@query(f"with {ARTICLES} select magazine, count(distinct article_id) as n from articles where is_advert group by magazine")
def q15_adverts_by_publication(spark, d):
    return Scope(adverts=True).apply(corpus.articles(spark, d)).groupBy("magazine").agg(F.countDistinct("article_id").alias("n"))


@query(f"with {ARTICLES}, {AUTHORS} select article_id, count(*) as authors from authors group by article_id having count(*) > 1")
def q20_several_authors(spark, d):
    return corpus.authors(spark, d).groupBy("article_id").agg(F.count("*").alias("authors")).where("authors > 1")


def _has(w):
    return f"(contains({FOLD.format('title')}, '{w}') or contains({FOLD.format('body')}, '{w}'))"


@query(f"with {ARTICLES} select article_id, magazine, year from articles where not coalesce(is_advert, false) and (({_has('que')} or {_has('con')}) and not {_has('the')}) and year >= 1905 and year <= 1930 order by article_id limit 20")
def q22_boolean_search(spark, d):
    a = Scope(adverts=False, year_from=1905, year_to=1930).apply(corpus.articles(spark, d))
    return search.page(search.boolean(a, "que", [("OR", "con"), ("NOT", "the")]).select("article_id", "magazine", "year"))


@query("with q as (select embedding::double[] as q from embeddings where vec_id = 0), s as (select vec_id, list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))) as s from embeddings, q order by s desc nulls last, vec_id limit 200) select vec_id, floor(s * 1000 + 0.5) / 1000 as similarity from s where s >= 0.35")
def q24_semantic(spark, d):
    e = t(spark, d, "embeddings")
    return vectors.nearest(e, e.where("vec_id = 0")).select("vec_id", T.half_up(F.col("similarity"), 3).alias("similarity"))


@query(f"""with {ARTICLES}, w as (select article_id, regexp_extract_all(lower(strip_accents(body)), '[\\p{{L}}\\p{{N}}]+') as ws from articles), a as (select article_id, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1] = '{PAIR_WORDS[0]}')) as a from w),
  b as (select article_id, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1] = '{PAIR_WORDS[1]}')) as b from w), m as (select article_id, min({{'separation': abs(a - b), 'a': a, 'b': b}}) as m from a join b using (article_id) where abs(a - b) <= 5 group by article_id)
  select article_id, m.separation, m.a, m.b from m""")
def q08_nearest_pair(spark, d):
    return lexis.nearest_pair(corpus.articles(spark, d, flags=False), *PAIR_WORDS, 5)


@query("select page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?i)<br\\s*/?>|</p>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', '''') as body from pages")
def fn10_html_text(spark, d):
    return t(spark, d, "pages").select("page_id", T.html_text("html").alias("body"))


@query("select doc_id, lower(strip_accents(text)) as folded from documents")
def fn02_fold(spark, d):
    return t(spark, d, "documents").select("doc_id", T.fold("text").alias("folded"))


@query("select doc_id, regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from documents")
def fn28_slug(spark, d):
    return t(spark, d, "documents").select("doc_id", T.slug("text").alias("slug"))


KEY = "array_to_string(list_sort(list_filter(string_split_regex(lower(strip_accents({})), '[^a-z]+'), lambda w: w <> '')), ' ')"


@query(f"select p_partkey, {KEY.format('p_name')} as name_key from part")
def fn32_name_key(spark, d):
    return t(spark, d, "part").select("p_partkey", T.name_key("p_name").alias("name_key"))


@query(f"with b as (select {KEY.format('p_name')} as k, p_partkey as match_id, p_size as activity from part where p_partkey % 3 <> 0), m as (select k, arg_min(match_id, (-activity, match_id)) as match_id, max(activity) as activity from b group by k), l as (select p_partkey as id, array_to_string(list_reverse(string_split(upper(p_name), ' ')), ', ') as name from part) select id, name, match_id, activity from l left join m on k = {KEY.format('name')}")
def q28_exact_match(spark, d):
    """Part names written backwards, to the largest part of the same words among two thirds of the parts."""
    part = t(spark, d, "part")
    left = part.select(F.col("p_partkey").alias("id"), F.array_join(F.reverse(F.split(F.upper("p_name"), " ")), ", ").alias("name"))
    right = part.where("p_partkey % 3 != 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("activity"))
    return entities.exact_match(left, right)


SIG = "list_distinct(list_filter(string_split_regex(lower(strip_accents({})), '[^a-z]+'), lambda w: length(w) >= 3))"


@query(f"""with a as (select p_partkey as id, {SIG.format("p_name")} as w from part), b as (select p_partkey as match_id, {SIG.format("p_name")} as o from part),
  p as (select id, match_id, len(list_intersect(w, o)) as s, len(w) as nw, len(o) as n_o from a, b where len(list_intersect(w, o)) > 0),
  q as (select id, match_id, cast(s as double) / least(nw, n_o) as overlap, cast(s as double) / (nw + n_o - s) as jaccard from p), r as (select *, row_number() over (partition by id order by overlap desc, jaccard desc, match_id) as rank from q where overlap >= 0.5)
  select id, match_id, round(overlap, 6) as overlap, round(jaccard, 6) as jaccard, cast(rank as int) as rank from r where rank <= 3""")
def q29_fuzzy_match(spark, d):
    part = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(0).alias("activity"))
    return entities.fuzzy_match(part, part).withColumns({c: F.round(c, 6) for c in ("overlap", "jaccard")})


VALUES = ", ".join(f"({p}, '{c}', {a}, {b})" for p, c, a, b in CITIES)


@query(f"""with g(priority, city, lat, lng) as (values {VALUES}), m as (select n_nationkey, lower(n_name) <> city as part, priority, lat, lng from nation join g on contains(lower(n_name), city)),
  b as (select n_nationkey, cast(lat as double) as lat, cast(lng as double) as lng, row_number() over (partition by n_nationkey order by part, priority) as r from m) select n.n_nationkey, b.lat, b.lng from nation n left join b on n.n_nationkey = b.n_nationkey and r = 1""")
def q26_geocode(spark, d):
    gazetteer = spark.createDataFrame(CITIES, "priority int, city string, lat double, lng double")
    return entities.geocode(t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("place")), gazetteer).select("n_nationkey", "lat", "lng")


@query("select r_name, n_name, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def jn01_join_chain(spark, d):
    dims = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    buyers = t(spark, d, "customer").select("c_custkey", "c_nationkey").join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_extendedprice").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("select o_custkey * 3 as c_custkey from orders where o_custkey * 3 not in (select c_custkey from customer)")
def sk03_insert_absent(spark, d):
    return entities.insert_absent(t(spark, d, "orders").select((F.col("o_custkey") * 3).alias("c_custkey")), t(spark, d, "customer").select("c_custkey"), ["c_custkey"])


@query("select user_id, event_id, value, cast(r as int) as rank from (select user_id, event_id, value, row_number() over (partition by user_id order by value desc nulls last, event_id) as r from events) where r <= 3")
def wn03_top_per_group(spark, d):
    return search.top_per_group(t(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc_nulls_last("value"), F.col("event_id")], 3)


@query("select l_orderkey, unnest([false, true]) as published from (select distinct l_orderkey from lineitem)")
def sk02_drafts(spark, d):
    return entities.with_drafts(t(spark, d, "lineitem").select("l_orderkey").distinct())
