"""Text functions, Column to Column, all inside the JVM."""
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words left out by default; callers may pass a list of their own.
STOPWORDS = ("a al ante como con de del desde donde e el ella en entre era es esta este ha la las le lo los mas me mi muy ni no o para pero por "
             "que se si sin sobre su sus un una y ya").split()
# White space as JavaScript has it.
WS = "[\\t-\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
# Name particles that do not count in fuzzy matching.
PARTICLES = "de del la las los el y e da van von".split()


@cache
def _fold_table() -> tuple[str, str]:
    """Characters that decompose to one base character, and combining marks (deleted), below the Hangul block."""
    source, target, gone = [], [], []
    for cp in range(0x80, 0xAC00):
        c = chr(cp)
        if 0x300 <= cp <= 0x36F:
            gone.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)
        if base != c and len(base) == 1 and ord(base) <= 0xFFFF:
            source.append(c)
            target.append(base)
    return "".join(source + gone), "".join(target)


def strip_marks(c) -> Column:
    return F.translate(c, *_fold_table())


def fold(c) -> Column:
    return F.lower(strip_marks(c))


def collapse(c) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"{WS}+", " "), "^ | $", "")


def trim(c) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def tokens(c, stopwords=STOPWORDS) -> Column:
    """Lower-case words of letters and digits, accents kept; pass an empty list to keep function words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    drop = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(drop, w))


def pair_tokens(c, stopwords=STOPWORDS) -> Column:
    """Folded tokens for word pairs: inner hyphens stay, three letters at least; stopwords are compared after folding."""
    words = F.split(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\s-]", " "), r"\s+")
    words = F.transform(words, lambda w: F.regexp_replace(w, "^-+|-+$", ""))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stopwords) if stopwords else F.length(w) >= 3)


def word_count(c) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), f"{WS}+"), lambda w: w != "")).cast("long")


def whole_word(word: str) -> str:
    """Pattern of a word between ASCII word edges."""
    quoted = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in word)
    return f"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])"


def html_text(c: Column | str) -> Column:
    """Script and style out, breaks and paragraph ends to line feeds, other tags out, entities decoded in a fixed order; null gives ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</p>", "\n")
    c = F.regexp_replace(c, "<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def slug(c, width: int | None = None) -> Column:
    out = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.left(out, F.lit(width)) if width else out


def name_key(c) -> Column:
    """Folded words in order, so that 'Surname, Name' and 'Name Surname' agree."""
    words = F.filter(F.split(F.regexp_replace(fold(c), "[^a-z]+", " "), " "), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def significant(c) -> Column:
    return F.array_distinct(F.filter(F.split(name_key(c), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*PARTICLES)))


def half_up(c, digits: int) -> Column:
    k = 10.0**digits
    return F.floor(c * k + 0.5) / k


def fragment(c, at: Column, width: Column | int, around: int = 50) -> Column:
    """Text around a 1-based place, collapsed."""
    start = F.greatest(F.lit(1), at - around)
    return collapse(F.substring(c, start, at - start + width + around))


# The texts of the labels.
def distance_label(c) -> Column:
    return F.when(c < 0.2, "muy similar").when(c < 0.4, "similar").when(c < 0.6, "moderado").when(c < 0.8, "distinto").otherwise("muy distinto")


def leading_int(c) -> Column:
    return F.expr(f"try_cast(regexp_extract({c}, '^\\\\s*([+-]?[0-9]+)', 1) as int)") if isinstance(c, str) else F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def running(array: str) -> str:
    """SQL of the sums before each number of an array column, by blocks of about the root of its size, so that the work is no square of it."""
    none = "cast(array() as array<int>)"
    step = f"cast(ceil(sqrt(size({array}))) as int)"
    blocks = f"transform(sequence(0, (size({array}) - 1) div {step}), i -> slice({array}, i * {step} + 1, {step}))"
    each = f"(b, at) -> aggregate(b, named_struct('at', at, 'out', {none}), (a, x) -> named_struct('at', a.at + x, 'out', concat(a.out, array(a.at))), a -> a.out)"
    firsts = f"aggregate(bs, named_struct('at', 0, 'out', {none}), (a, b) -> named_struct('at', a.at + aggregate(b, 0, (n, x) -> n + x), 'out', concat(a.out, array(a.at))), a -> a.out)"
    return f"case when size({array}) > 0 then transform(array({blocks}), bs -> flatten(zip_with(bs, {firsts}, {each})))[0] else {none} end"
