"""Benchmark decontamination by templates (built-in functions only): typed placeholders, window join, slot consistency."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, restricted, written

# Unit words of four languages.
UNITS = ("mm cm m km mg g kg lb oz ml l s sec min h hour hours minute minutes second seconds day days week weeks month months year years percent usd eur dollar dollars euro euros "
         "hora horas minuto minutos segundo segundos día días semana semanas mes meses año años metro metros kilo kilos litro litros "
         "heure heures seconde secondes jour jours semaine semaines mois an ans mètre mètres litre litres kilomètre kilomètres "
         "stunde stunden sekunde sekunden tag tage woche wochen monat monate jahr jahre meter liter prozent")
WORD = r"[\\p{L}\\p{N}]+(?:[.,:][\\p{N}]+)*"
SHORTEST = 3
#: Literal words that an item shorter than a window needs to be looked for inside longer texts.
LITERALS = 4


def words(df: DataFrame, key: str) -> DataFrame:
    """key, raw words, and words with numbers, units and capitalised words (names, also at the start of sentences) as placeholders.

    Words begin with a letter or number, so those below ':' begin with a plain digit."""
    units = ", ".join(f"'{u}'" for u in dict.fromkeys(UNITS.split()))
    typed = (r"transform(raw, w -> case when w < ':' or w >= '\u0080' and rlike(w, '^\\p{N}') then '<num>' when lower(w) != w and rlike(w, '^\\p{Lu}\\p{Ll}') then '<name>' "
             f"when lower(w) in ({units}) then '<unit>' else lower(w) end)")
    return df.select(key, F.expr(f"regexp_extract_all(coalesce(text, ''), '{WORD}', 0)").alias("raw")).select(key, "raw", F.expr(typed).alias("words"))


def windows(typed: DataFrame, key: str, widths: list[int]) -> DataFrame:
    """key, size of the text, position and hash of each window of each width."""
    one = lambda n: f"case when size(h) >= {n} then transform(sequence(0, size(h) - {n}), i -> named_struct('pos', i, 'window', xxhash64({', '.join(f'h[i + {j}]' for j in range(n))}))) else array() end"
    df = typed.select(key, F.expr("transform(words, w -> xxhash64(w))").alias("h"))
    return df.select(key, F.size("h").alias("size"), F.inline(F.expr(f"concat({', '.join(map(one, widths))})")))


def slots(typed: DataFrame, key: str, name: str) -> DataFrame:
    """key and, place by place, the raw word of a placeholder, else null."""
    return typed.select(key, F.expr("transform(arrays_zip(raw, words), z -> case when startswith(z.words, '<') then z.raw end)").alias(name))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 8, share: float = 0.5, least: int = 6, consistent: float = 0.8, apart: float = 0.5, small: int = 200_000) -> DataFrame:
    """(doc_id, item_id) pairs where a document holds an item's template.

    Columns: windows (distinct item windows found), item_windows, slots, consistency. A pair counts when at least
    ``share`` of the item's distinct windows, or ``least`` of them, are found, and the slots map one to one at one place of
    the item: its first, or any that holds so many windows by itself. To map one to one, the different values of the item
    are at least ``consistent`` of the different value pairs (a value goes to one value), and those of the document at
    least ``apart`` of them (different values rarely go to the same). slots and consistency (the smaller share) are those
    of the most consistent place. Items of SHORTEST to ``width`` - 1 words are one window of their own width; with fewer
    than LITERALS literal words they match only a document that is nothing else. Shorter items and texts hold nothing,
    as do null and empty texts; repeated rows of a doc_id or item_id count as one text's places together and give one
    pair; rows with a null id are left out; empty tables give an empty result; other columns are ignored. The
    benchmark's windows are broadcast only when counted to be at most ``small``; beyond that frequent windows are dealt
    over shares.
    """
    docs, items = docs.where("doc_id is not null").select("doc_id", "text"), benchmark.where("item_id is not null").select("item_id", "text")
    typed = words(items, "item_id").where(F.size("words") >= SHORTEST)
    own = [n for n in range(SHORTEST, width) if not typed.where(F.size("words") == n).isEmpty()]
    literal = F.size(F.filter("words", lambda w: ~F.startswith(w, F.lit("<"))))
    inside = typed.select("item_id", ((F.size("words") >= width) | (literal >= LITERALS)).alias("inside"), F.least(F.size("words"), F.lit(width)).alias("own"))
    made = [windows(typed.where(F.size("words") == n if n < width else F.size("words") >= n), "item_id", [n]) for n in [*own, width]]
    found = reduce(DataFrame.unionByName, made).drop("size").join(inside, "item_id")
    found = written(found.groupBy("item_id", "window").agg(F.min("pos").alias("ipos"), F.max("inside").alias("inside"), F.max("own").alias("own")), "item_windows")
    total = found.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    n = found.count()
    lines = windows(words(docs, "doc_id"), "doc_id", [*own, width])
    hits = lines.join(F.broadcast(found), "window") if n <= small else meet(lines, found, "window")
    hits = hits.where("inside or size = own")
    # One place for each offset between document and item: its first item position, and all of them.
    placed = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("offset")).agg(F.min("ipos").alias("ipos"), F.collect_set("ipos").alias("held"))
    placed = placed.select("doc_id", "item_id", "held", F.struct("ipos", (F.col("offset") + F.col("ipos")).alias("pos"), F.size("held").alias("n")).alias("place"))
    pairs = placed.groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("windows"), F.collect_list("place").alias("places"))
    pairs = pairs.join(total, "item_id").where((F.col("windows") >= F.lit(share) * F.col("item_windows")) | (F.col("windows") >= least))
    # The first place, and every other that holds enough of the item by itself.
    enough = F.expr(f"filter(places, p -> p.n >= {share} * item_windows or p.n >= {least} or p = array_min(places))")
    pairs = written(pairs.withColumn("places", enough), "pairs")
    ids = written(pairs.select("doc_id").distinct(), "ids")
    both = pairs.join(slots(words(restricted(docs, ids, "doc_id"), "doc_id"), "doc_id", "dslots"), "doc_id").join(slots(typed, "item_id", "islots"), "item_id")
    lined = ("array_distinct(filter(zip_with(slice(dslots, p.pos + 1, size(islots)), slice(islots, p.ipos + 1, size(islots)), (d, i) -> named_struct('d', d, 'i', i)),"
             " z -> z.d is not null and z.i is not null))")
    both = both.select("doc_id", "item_id", "windows", "item_windows", F.expr(f"transform(places, p -> {lined})").alias("lined"))
    tested = ("filter(transform(transform(lined, x -> named_struct('pairs', size(x), 'i', size(array_distinct(transform(x, z -> z.i))), 'd', size(array_distinct(transform(x, z -> z.d))))),"
              " y -> named_struct('consistency', case when y.pairs = 0 then 1.0d else least(y.i, y.d) / double(y.pairs) end, 'slots', y.i, 'pairs', y.pairs)),"
              f" y -> y.slots >= {consistent} * y.pairs and y.consistency >= {apart})")
    both = both.withColumn("best", F.array_max(F.expr(tested))).where("best is not null").select("doc_id", "item_id", "windows", "item_windows", "best.slots", "best.consistency")
    return both.groupBy("doc_id", "item_id").agg(
        F.max("windows").alias("windows"), F.max("item_windows").alias("item_windows"), F.max("slots").alias("slots"), F.max("consistency").alias("consistency"))
