"""Registered queries over the trigram index, filter trees and keyset pages, with their SQL."""
from pyspark.sql import functions as F

from ..functions import article, fragments
from ..functions import text as T
from ..operators import corpus, filters, search, trigrams
from ..sources import buckets
from .archive import CAPTIONS, HTML, RAW
from .composed import _fragment, _place
from .queries import ARTICLES, AUTHORS, FOLD, query, t

SCOPES = ["title", "authors", "body", "captions"]


def _articles(spark, d):
    """Articles with their authors' names, one a line, and captions."""
    a = corpus.with_authors(corpus.articles(spark, d, flags=False))
    captions = article.captions(F.expr(HTML.replace("doc_id", "article_id").format("body")))
    return a.withColumns({"authors": F.array_join("authors", "\n"), "captions": captions})


def _hit(term, scopes=SCOPES):
    return "(" + " or ".join(f"contains({FOLD.format(c)}, '{term}')" for c in scopes) + ")"


CAPTIONED = f"""{ARTICLES}, {AUTHORS}, {RAW}, w as (select article_id, string_agg(author, chr(10) order by place) as authors from authors group by article_id), c as (select article_id, {CAPTIONS} as captions from raw),
  v as (select distinct on (article_id) * from articles join w using (article_id) join c using (article_id))"""


def _told(terms):
    """SQL of the fragment of the first term that the body, else the captions, hold."""
    cases = " ".join(f"when {_place(c, x)} > 0 then {_fragment(c, _place(c, x), len(x), 80)}" for x in terms for c in ("body", "captions"))
    return f"case {cases} else title end"


def _indexed(spark, d):
    articles, path = _articles(spark, d), buckets.scratch(spark, "trigrams")
    trigrams.write(articles, path, SCOPES)
    return articles, path


TERMS = ["ciónes", "a13", "est"]


def _total(found, page):
    """The page with the number of all that was found."""
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))


@query(f"with {CAPTIONED}, f as (select * from v where ({_hit('ciones')} or {_hit('a13')}) and not {_hit('est')}) select article_id, magazine, authors, {_told(['ciones', 'a13', 'est'])} as fragment, (select count(*) from f) as total from f order by article_id limit 20")
def q22_indexed_search(spark, d):
    """First page of a search in titles, authors, texts and captions by the index, with fragments and the number of all hits."""
    articles, path = _indexed(spark, d)
    found = trigrams.search(articles, path, TERMS[0], [("OR", TERMS[1]), ("NOT", TERMS[2])], SCOPES)
    page = search.page(found).select("article_id", "magazine", "authors", fragments.search("body", "title", ["ciones", "a13", "est"], "captions").alias("fragment"))
    return _total(found, page)


@query(f"with {CAPTIONED} select article_id from v where {_hit('que')} and {_hit('ent')}")
def pf16_indexed_terms(spark, d):
    """Every article that holds two frequent terms, by the index."""
    articles, path = _indexed(spark, d)
    return trigrams.search(articles, path, "que", [("AND", "ent")], SCOPES).select("article_id")


@query(f"""with {CAPTIONED}, f as (select article_id, captions from v where captions <> '' and {_hit('que', ['captions'])}), l as (select article_id, coalesce(list_filter(string_split(captions, chr(10)), lambda x: contains(lower(strip_accents(x)), 'que'))[1], '') as line from f),
  n as (select article_id, line, instr(lower(strip_accents(line)), 'que') as spot from l) select article_id, left(line, spot - 1) || '**' || substring(line, spot, 3) || '**' || substring(line, spot + 3) as line, (select count(*) from f) as total from n order by article_id limit 20""")
def q23_caption_lines(spark, d):
    """First page of the captions that hold a term, each with its first line that does, by the index."""
    articles, path = _indexed(spark, d)
    found = trigrams.search(articles.where("captions != ''"), path, "que", [], ["captions"])
    return _total(found, search.page(found).select("article_id", article.caption_line("captions", "que").alias("line")))


# Filter trees, with the same conditions in SQL.
TREES = [
    ({"language": {"$in": ["es", "fr"]}, "year": {"$gte": 1910, "$lt": 1920}}, "language in ('es', 'fr') and year >= 1910 and year < 1920"),
    ({"$or": [{"magazine": "src1"}, {"$and": [{"year": None}, {"is_poem": True}]}]}, "coalesce(magazine = 'src1', false) or (year is null and coalesce(is_poem, false))"),
    ({"$not": {"issue_order": {"$between": [3, 10]}}, "title": {"$notContainsi": "que"}}, "not coalesce(issue_order between 3 and 10, false) and coalesce(not contains(lower(title), 'que'), true)"),
    ({"links": {"author": {"$in": ["a3", "a5"]}, "place": 1}, "is_advert": {"$ne": True}}, "article_id in (select article_id from authors where author in ('a3', 'a5') and place = 1) and is_advert is distinct from true"),
    ({"$or": [{"links": {"author": "a4"}}, {"$not": {"links": {"place": 2}}, "language": {"$notIn": ["en", "de"]}}], "magazine": {"$startsWith": "src", "$not": {"$endsWith": "1"}}},
     "(article_id in (select article_id from authors where author = 'a4') or (article_id not in (select article_id from authors where place = 2) and (language is null or language not in ('en', 'de')))) and coalesce(starts_with(magazine, 'src'), false) and not coalesce(ends_with(magazine, '1'), false)")]


@query(f"with {ARTICLES}, {AUTHORS} " + " union all ".join(f"select {i} as tree, article_id from articles where {sql}" for i, (_, sql) in enumerate(TREES)))
def pf27_filter_trees(spark, d):
    """Articles that each of five filter trees keeps, relations to authors included."""
    a = corpus.articles(spark, d)
    links = {"links": filters.Relation(corpus.authors(spark, d), "article_id", "article_id")}
    out = [filters.filtered(a, tree, links).select(F.lit(i).alias("tree"), "article_id") for i, (tree, _) in enumerate(TREES)]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


ORDER = ["year:desc", "magazine", "article_id"]
SORTED = "year desc nulls last, magazine nulls first, article_id"


@query(f"with {ARTICLES}, o as (select year, magazine, article_id, row_number() over (order by {SORTED}) as n, count(*) over () as total from articles) select cast(ceil(n / 40.0) as int) as page, total, year, magazine, article_id from o where n % 40 = 0 or n = total")
def sc16_page_bounds(spark, d):
    """Where each page of all articles ends, by year, magazine and id, and how many articles there are."""
    return filters.page_bounds(corpus.articles(spark, d, flags=False), ORDER, 40).select("page", "total", "bound.*")


@query(f"with {ARTICLES} select article_id, year, magazine from articles order by {SORTED} limit 40 offset 80")
def sc16_keyset_page(spark, d):
    """The third page, from the bound of the second on."""
    a = corpus.articles(spark, d, flags=False).select("article_id", "year", "magazine")
    bound = filters.page_bounds(a, ORDER, 40).where("page = 2").first()
    return filters.page_after(a, ORDER, 40, tuple(bound["bound"]) if bound else None)


@query(f"""with {ARTICLES}, {AUTHORS}, k as (select article_id, year, magazine from articles where language in ('es', 'fr') and article_id in (select article_id from authors where place = 2) order by year desc nulls last, article_id limit 30)
  select article_id, year, magazine, (select string_agg(place || ' ' || author, ',' order by place, author) from authors a where a.article_id = k.article_id) as links from k""")
def sc04_document_page(spark, d):
    """A page of articles that have a second author, with all their authors in order."""
    links = {"links": filters.Relation(corpus.authors(spark, d), "article_id", "article_id")}
    tree = {"language": ["es", "fr"], "links": {"place": 2}}
    page = filters.found(corpus.articles(spark, d, flags=False), tree, ["article_id", "year", "magazine"], {"links": ["place", "author"]}, links, ["year:desc", "article_id"], 30)
    return page.withColumn("links", F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x["place"], x["author"])), ","))
