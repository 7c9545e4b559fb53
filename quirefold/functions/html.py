"""HTML of adverts, imports and articles: plain text, sanitising and balancing of divs; all inside the JVM."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import article
from . import text as T

# Entities in order of decoding.
INDEX_ENTITIES = (*article.ENTITIES, ("&#39;", "'"), ("&apos;", "'"))
SEARCH_ENTITIES = (*article.ENTITIES, ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&lsquo;", "‘"), ("&rsquo;", "’"))
# Classes of blocks that don't stand inside an image box.
TEXT_BLOCKS = ("Normal NormalN NormalT NormalTX NormalNX Cita CitaX EstrofaCita EstrofaCitaX Estrofa EstrofaI EstrofaT EstrofaTX Fuente FuenteX "
               "Título Titulo TítuloP TítuloS Subtítulo SubtítuloP PersonajeT AcotaciónT AcotaciónTX Autor AutorP Numeración Anatomía")
# Patterns of script links and div tags, and imgbox, the class of image boxes.
SCRIPT_LINK = r'(?i)<a[^>]*href="javascript:[^"]*"[^>]*>.*?</a>'
TAG = r'<div\s[^>]*class="[^"]*"[^>]*>|</div>'


def _opened(c) -> Column:
    """Script and style out, breaks and paragraph ends to line feeds; null gives ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.regexp_replace(c, r"(?i)<br\s*/?>|</p>", "\n")


def index_text(c) -> Column:
    """Text of adverts and of the word-pair index: script links out with their text, tags to spaces, white space collapsed."""
    c = _opened(F.regexp_replace(F.coalesce(c, F.lit("")), SCRIPT_LINK, " "))
    return T.collapse(article.decode(F.regexp_replace(c, "<[^>]+>", " "), INDEX_ENTITIES))


def hex_entities(c) -> Column:
    """&#xH; to the UTF-16 unit of its last four digits."""
    unit = lambda h: F.decode(F.unhex(F.right(F.lpad(h, 32, "0"), F.lit(4))), "UTF-16BE")
    signs = F.transform(F.regexp_extract_all(c, F.lit("&#x([0-9a-fA-F]{1,32});"), 1), unit)
    return F.array_join(F.zip_with(F.split(c, "&#x[0-9a-fA-F]{1,32};", -1), signs, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")


def search_text(c) -> Column:
    """Text for the search: as the plain text, with numeric and typographic entities."""
    return article.decode(hex_entities(article.decimal_entities(F.regexp_replace(_opened(c), "<[^>]+>", ""))), SEARCH_ENTITIES)


def sanitised(c) -> Column:
    """Imported HTML: script links and hard spaces out, edges trimmed; null gives ''."""
    return T.trim(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), SCRIPT_LINK, ""), F.lit("&nbsp;"), F.lit(" ")))


def surplus(c) -> Column:
    """Opened less closed divs."""
    return F.regexp_count(c, F.lit("<div")) - F.regexp_count(c, F.lit("</div>"))


def _steps(name: str) -> str:
    """SQL array of (g, t): the text before each div tag with a class, or closing one, and the tag; null at the end."""
    return f"zip_with(split({name}, r'{TAG}', -1), regexp_extract_all({name}, r'{TAG}', 0), (g, t) -> named_struct('g', g, 't', t))"


def _without_surplus(name: str) -> Column:
    """Closing tags that no open div precedes are taken out."""
    return F.expr(f"aggregate({_steps(name)}, named_struct('open', 0, 'out', ''), (a, x) -> case when x.t is null then named_struct('open', a.open, 'out', concat(a.out, x.g)) "
                  "when x.t != '</div>' then named_struct('open', a.open + 1, 'out', concat(a.out, x.g, x.t)) "
                  "when a.open > 0 then named_struct('open', a.open - 1, 'out', concat(a.out, x.g, x.t)) else named_struct('open', 0, 'out', concat(a.out, x.g)) end, a -> a.out)")


def _boxes_closed(name: str) -> Column:
    """An open image box ends before the first text block in it."""
    blocks = "array(" + ", ".join(f"'{b}'" for b in TEXT_BLOCKS.split()) + ")"
    kind = "regexp_extract(x.t, 'class=\"([^\"]*)\"', 1)"
    last = "(size(a.held) - array_position(reverse(a.held), 'imgbox'))"
    empty = "cast(array() as array<string>)"
    return F.expr(f"aggregate({_steps(name)}, named_struct('held', {empty}, 'out', ''), (a, x) -> case when x.t is null then named_struct('held', a.held, 'out', concat(a.out, x.g)) "
                  f"when x.t = '</div>' then named_struct('held', case when size(a.held) > 0 then slice(a.held, 1, size(a.held) - 1) else {empty} end, 'out', concat(a.out, x.g, x.t)) "
                  f"when array_contains({blocks}, {kind}) and array_contains(a.held, 'imgbox') then named_struct('held', concat(filter(a.held, (h, i) -> i != {last}), array({kind})), 'out', concat(a.out, x.g, '</div>\n', x.t)) "
                  f"else named_struct('held', concat(a.held, array({kind})), 'out', concat(a.out, x.g, x.t)) end, a -> a.out)")


def balanced(df, column: str):
    """df with the divs of column balanced: surplus closing tags out, image boxes closed, missing ends appended. Null stays."""
    work = f"__{column}"
    df = df.withColumn(work, F.col(column))
    df = df.withColumn(work, F.when(surplus(work) < 0, _without_surplus(work)).otherwise(F.col(work)))
    df = df.withColumn(work, F.when(surplus(work) > 0, _boxes_closed(work)).otherwise(F.col(work)))
    left = surplus(work)
    ended = F.concat(F.regexp_replace(work, f"{T.WS}+$", ""), F.expr(f"repeat('\n</div>', (regexp_count({work}, '<div') - regexp_count({work}, '</div>')))"), F.lit("\n"))
    return df.withColumn(column, F.when(left > 0, ended).otherwise(F.col(work))).drop(work)


def processed(df, column: str = "html"):
    """df with the derived columns of its articles: head blocks and page links out, divs balanced, then text, captions and flags of that."""
    clean = balanced(df.withColumn(column, article.without_head(F.col(column))), column)
    return clean.withColumns({name: c for name, c in article.processed(column, cleaned=True).items() if name != "html"})
