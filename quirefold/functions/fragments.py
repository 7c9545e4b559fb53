"""Text around hits, with the hits between asterisks; places are 1-based."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def _before(c, at, around: int) -> Column:
    start = F.greatest(F.lit(1), at - around)
    return T.collapse(F.substring(c, start, at - start))


def _mark(c, at, width) -> Column:
    return F.concat(F.lit("**"), F.substring(c, at, width), F.lit("**"))


def _after(c, at, around: int) -> Column:
    return T.collapse(F.substring(c, at, F.lit(around)))


def single(c, at: Column, width: Column, around: int = 50) -> Column:
    """before **hit** after."""
    return T.trim(F.concat_ws(" ", _before(c, at, around), _mark(c, at, width), _after(c, at + width, around)))


def pair(c, a: Column, a_width: Column, b: Column, b_width: Column, around: int = 50) -> Column:
    """before **hit** between **hit** after, in order of the text."""
    first, second = F.least(a, b), F.greatest(a, b)
    w1, w2 = F.when(a <= b, a_width).otherwise(b_width), F.when(a <= b, b_width).otherwise(a_width)
    between = T.collapse(F.substring(c, first + w1, F.greatest(F.lit(0), second - first - w1)))
    return T.trim(F.concat_ws(" ", _before(c, first, around), _mark(c, first, w1), between, _mark(c, second, w2), _after(c, second + w2, around)))


def search(body: str, title: str, terms: list[str], captions: str | None = None, around: int = 80) -> Column:
    """Fragment of the first term, in order of priority, found in the body, else in the captions; without any, the title."""
    cases = []
    for term in terms:
        for column in [body, *([captions] if captions else [])]:
            at = F.instr(T.fold(F.coalesce(F.col(column), F.lit(""))), term)
            cases.append(F.when(at > 0, single(F.col(column), at, F.lit(len(term)), around)))
    return F.coalesce(*cases, F.col(title))
