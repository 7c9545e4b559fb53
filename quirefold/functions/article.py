"""Article HTML: cleaning, plain text, captions, verse and artwork flags; all inside the JVM."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Class names of blocks that repeat the article's head, and entities in order of decoding.
HEAD_BLOCKS = ("Título", "Titulo", "Autor", "Autortexto", "DescrI")
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
PAGE_LINK = r'(?s)<a class="page".*?</a>'


def decode(c, entities=ENTITIES) -> Column:
    for a, b in entities:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decimal_entities(c) -> Column:
    """&#N; to the UTF-16 unit N mod 65536; the text is rebuilt from the pieces between entities."""
    unit = lambda n: F.decode(F.unhex(F.lpad(F.hex((n.cast("decimal(38,0)") % 65536).cast("long")), 4, "0")), "UTF-16BE")
    signs = F.transform(F.regexp_extract_all(c, F.lit("&#([0-9]{1,38});"), 1), unit)
    return F.array_join(F.zip_with(F.split(c, "&#[0-9]{1,38};", -1), signs, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")


def without_head(html) -> Column:
    """Head blocks, up to their first closing tag, and page links taken out."""
    return F.regexp_replace(F.regexp_replace(html, f'(?s)<div class="(?:{"|".join(HEAD_BLOCKS)})">.*?</div>', ""), PAGE_LINK, "")


def plain(html) -> Column:
    """Tags to spaces, entities decoded, white space collapsed."""
    return T.collapse(decimal_entities(decode(F.regexp_replace(html, "<[^>]+>", " "))))


def captions(html) -> Column:
    """Captions of images, one a line, tags out and blank ones dropped."""
    found = F.regexp_extract_all(html, F.lit(r'(?s)<div class="(?:TituloI|NormalI)">(.*?)</div>'), 1)
    return F.array_join(F.filter(F.transform(found, lambda x: T.collapse(decode(F.regexp_replace(x, "<[^>]+>", "")))), lambda x: x != ""), "\n")


def _blocks(html) -> Column:
    return F.regexp_replace(F.regexp_replace(html, PAGE_LINK, ""), r'<div class="Normal">\s*</div>', "")


def is_poem(html) -> Column:
    """At least half of the verse and prose blocks are verse."""
    verse, prose = (F.regexp_count(_blocks(html), F.lit(f'<div class="{x}[^"]*"')) for x in ("Estrofa", "Normal"))
    return (verse + prose > 0) & (verse >= prose)


def is_artwork(html) -> Column:
    """Image boxes without a description and without any text block."""
    left = _blocks(html)
    return F.contains(left, F.lit('<div class="imgbox">')) & ~F.contains(left, F.lit('<div class="DescrI">')) & ~left.rlike('<div class="(?:Normal|Estrofa|Cita)')


def processed(html, cleaned: bool = False) -> dict[str, Column]:
    """Derived columns of an article; captions and flags are read from the cleaned HTML. html.processed() also balances its divs."""
    clean = F.col(html) if cleaned else without_head(html)
    return {"html": clean, "body": plain(clean), "captions": captions(clean), "is_poem": is_poem(clean), "is_artwork": is_artwork(clean)}


def snippet(c, width: int = 300) -> Column:
    c = T.collapse(decode(c))
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("…"))).otherwise(c)


def caption_line(c, term: str) -> Column:
    """First line that holds the folded term, with its first hit marked; else the first line."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    line = F.coalesce(F.get(F.filter(lines, lambda x: F.contains(T.fold(x), F.lit(term))), F.lit(0)), F.get(lines, F.lit(0)))
    at = F.instr(T.fold(line), term)
    n = len(term)
    return F.when(at > 0, F.concat(F.substring(line, F.lit(1), at - 1), F.lit("**"), F.substring(line, at, F.lit(n)), F.lit("**"), F.substring(line, at + n, F.length(line)))).otherwise(line)


def poem_default_theme(is_poem_, themes, default) -> Column:
    """Poems without themes get the default one."""
    return F.when(F.coalesce(is_poem_, F.lit(False)) & (F.coalesce(F.size(themes), F.lit(0)) == 0), F.array(F.lit(default))).otherwise(themes)
