"""Spanish word roots by the published Snowball rules, for a vocabulary of distinct words."""
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Worker code travels with the job, so executors need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOWELS = "aeiouáéíóúü"
ACUTE = str.maketrans("áéíóú", "aeiou")
# The suffix groups of the published algorithm.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
BEFORE = "iéndo ándo ár ér ír ando iendo ar er ir".split()
PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
AGENT = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
SWAP = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
ABSTRACT, ACTIVE = "idad idades".split(), "iva ivo ivas ivos".split()
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
G_VERBS = "en es éis emos".split()
VERBS = ("arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
         "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran "
         "asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis "
         "asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos").split()
ENDINGS = [*PLAIN, *AGENT, *SWAP, "amente", "mente", *ABSTRACT, *ACTIVE]
FOLLOW = {**dict.fromkeys(AGENT, ("ic",)), "mente": ("ante", "able", "ible"), **dict.fromkeys(ABSTRACT, ("abil", "ic", "iv")), **dict.fromkeys(ACTIVE, ("at",))}


def regions(word: str) -> tuple[int, int, int]:
    """Starts of RV, R1 and R2."""
    after = lambda start: m.end() if (m := re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, start)) else len(word)
    r1 = after(0)
    if len(word) < 3:
        return len(word), r1, after(r1)
    first, second = word[0] in VOWELS, word[1] in VOWELS
    wanted = f"[{VOWELS}]" if not second else f"[^{VOWELS}]" if first else None
    if wanted is None:
        return 3, r1, after(r1)
    m = re.compile(wanted).search(word, 2)
    return m.end() if m else len(word), r1, after(r1)


def longest(word: str, endings, start: int = 0) -> str | None:
    return max((x for x in endings if word.endswith(x) and len(word) - len(x) >= start), key=len, default=None)


def stem(word: str) -> str:
    word = word.lower()
    rv, r1, r2 = regions(word)
    if (p := longest(word, PRONOUNS, rv)) is not None:
        rest = word[:-len(p)]
        form = longest(rest, BEFORE, rv)
        if form is not None:
            word = rest[:-len(form)] + form.translate(ACUTE)
        elif rest.endswith("uyendo") and len(rest) - 5 >= rv:
            word = rest
    before = word
    if (x := longest(word, ENDINGS)) is not None:
        base = word[:-len(x)]
        if x == "amente":
            if len(base) >= r1:
                word = base
                if (y := longest(word, ("iv", "os", "ic", "ad"), r2)) is not None:
                    word = word[:-2]
                    if y == "iv" and longest(word, ("at",), r2):
                        word = word[:-2]
        elif len(base) >= r2:
            word = base + SWAP.get(x, "")
            if x not in SWAP and (y := longest(word, FOLLOW.get(x, ()), r2)) is not None:
                word = word[:-len(y)]
    if word == before:
        y = longest(word, Y_VERBS, rv)
        if y is not None and word[:-len(y)].endswith("u"):
            word = word[:-len(y)]
        elif (x := longest(word, [*G_VERBS, *VERBS], rv)) is not None:
            word = word[:-len(x)]
            if x in G_VERBS and word.endswith("gu"):
                word = word[:-1]
    if (x := longest(word, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)) is not None:
        word = word[:-len(x)]
        if x in "eé" and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(ACUTE)


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def roots(words: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """word, root of each distinct word: its lemma where lemmas(form, lemma) lists it, else its stem."""
    known = words.select(F.lower("word").alias("word")).distinct()
    root: Column = stemmed("word")
    if lemmas is None:
        return known.select("word", root.alias("root"))
    return known.join(lemmas.withColumnRenamed("form", "word"), "word", "left").select("word", F.coalesce("lemma", root).alias("root"))
