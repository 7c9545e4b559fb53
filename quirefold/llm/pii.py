"""PII spans (built-in functions only): generators propose spans, boosted trees over format and context select more."""
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The base kinds. Possessive loops and look-behinds keep the same matches without backtracking.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text needs to hold at all for a kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "phone": r"\+[0-9]"}
NAMES = [*KINDS, "other"]
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
DIGITS = "regexp_replace(z.v, '[^0-9]', '')"
VALID = {"email": "true", "ip": f"rlike(z.v, r'^{PART}(?:\\.{PART}){{3}}$')", "card": f"length({DIGITS}) between 12 and 19 and luhn_check({DIGITS})", "phone": f"length({DIGITS}) between 9 and 15"}
# High-recall generators for the trees; their spans may overlap.
WIDE = {
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}+[0-9])*+(?![0-9A-Za-z])",
    "grouped": r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])",
    "account": r"(?<![0-9A-Za-z])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+|[XYZ]?[0-9]{7,8}-?[A-Z])(?![0-9A-Za-z])",
    "address": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
}
NEEDS |= {"address": r"@|[(\[]at[)\]]", "number": "[0-9]", "grouped": "[0-9]", "card": "[0-9]", "group": "[0-9]", "account": "[0-9]"}
#: Neighbouring groups of digits that a number may consist of.
GROUPED = 6
FEATURES = {
    "digits": f"least(20, length({DIGITS}))",
    "separators": "least(12, length(regexp_replace(z.v, '[^ ().-]', '')))",
    "groups": "least(8, size(split(z.v, '[^0-9]+')))",
    "plus": "int(startswith(z.v, '+'))",
    "at": "int(rlike(z.v, r'@|[(\\[]at[)\\]]'))",
    "domain": "int(rlike(z.v, r'(?:\\.|\\)|\\])\\x20?[A-Za-z]{2,}$'))",
    "dots": "least(6, length(regexp_replace(z.v, '[^.]', '')))",
    "letters": "least(12, length(regexp_replace(z.v, '[^A-Za-z]', '')))",
    "luhn": f"int(luhn_check({DIGITS}) and length({DIGITS}) between 12 and 19)",
    "fours": "int(rlike(z.v, r'^[0-9]{4}(?:[\\x20-][0-9]{4}){3}$'))",
    "date": "int(rlike(z.v, r'(?:19|20)[0-9]{2}[ .-]{1,2}(?:[0-9]{1,2}|(?:19|20)[0-9]{2})(?![0-9])|(?<![0-9])[0-9]{1,2}[ .-][0-9]{1,2}[ .-](?:19|20)[0-9]{2}'))",
    "calls": "int(rlike(z.c, 'phone|tel|call|mobile|móvil|fax|handy|whatsapp|ring|contact'))",
    "pays": "int(rlike(z.c, 'card|visa|master|credit|tarjeta|carte|karte|pay'))",
    "papers": "int(rlike(z.c, 'ssn|passport|social|dni|nie|ausweis|licen'))",
    "banks": "int(rlike(z.c, 'iban|account|konto|cuenta|compte|bank|transfer'))",
    "country": "int(rlike(z.v, '^[A-Z]{2}[0-9]{2}'))",
    "letter": "int(rlike(z.v, '^[XYZ]?[0-9]{7,8}-?[A-Z]$'))",
    "follows": "int(rlike(z.c, '[0-9][ ().-]{0,2}$'))",
    "leads": "int(z.a)",
    "counts": "int(rlike(z.c, 'order|item|isbn|version|page|invoice|part|serial|no[.]|ref|code|total|number of'))",
}
SPAN = "struct<s:int,e:int,v:string,c:string>"
#: The same with a: whether digits follow at once.
CANDIDATE = "struct<s:int,e:int,v:string,c:string,a:boolean>"


def matches(text: str, pattern: str) -> str:
    """SQL array of (g, v): the text before each match, and the match; null at the end."""
    return f"zip_with(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0), (g, v) -> named_struct('g', g, 'v', v))"


def located(text: str, kind: str, pattern: str) -> str:
    """SQL array of (s, e, v, c): leftmost matches with code-point offsets, and what stands before, 24 signs at most.

    Offsets are summed up by blocks of about the root of the number of matches, so the work is no square of it."""
    step = ("aggregate(b, named_struct('at', at, 'out', cast(array() as array<" + SPAN + ">)), (a, x) -> named_struct('at', a.at + length(x.g) + length(x.v), 'out', "
            "concat(a.out, array(named_struct('s', a.at + length(x.g), 'e', a.at + length(x.g) + length(x.v), 'v', x.v, 'c', lower(right(x.g, 24)))))), a -> a.out)")
    firsts = ("aggregate(blocks, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, b) -> named_struct('at', a.at + aggregate(b, 0, (n, x) -> n + length(x.g) + length(x.v)), "
              "'out', concat(a.out, array(a.at))), a -> a.out)")
    blocks = "transform(sequence(0, (size(z) - 1) div int(ceil(sqrt(size(z))))), i -> slice(z, i * int(ceil(sqrt(size(z)))) + 1, int(ceil(sqrt(size(z))))))"
    made = (f"transform(array(filter({matches(text, pattern)}, x -> x.v is not null)), z -> case when size(z) = 0 then cast(array() as array<{SPAN}>) else "
            f"transform(array({blocks}), blocks -> flatten(zip_with(blocks, {firsts}, (b, at) -> {step})))[0] end)[0]")
    return f"case when rlike({text}, r'{NEEDS[kind]}') then {made} else cast(array() as array<{SPAN}>) end"


def unions(runs: str) -> str:
    """SQL array of candidates: in each run every group of digits, and every union of up to GROUPED neighbours, of 7 to 19 digits.

    A sign or bracket right before the first group belongs to it. Work goes with the number of groups."""
    said = "concat(x.c, x.v)"
    digits = "aggregate(slice(g, i + 1, j - i + 1), 0, (n, x) -> n + length(x.v))"
    sign = "case when right(g[i].c, 1) in ('+', '(') then right(g[i].c, 1) else '' end"
    value = f"concat({sign}, g[i].v, array_join(transform(slice(g, i + 2, j - i), x -> {said}), ''))"
    before = f"lower(right(concat(r.c, array_join(transform(slice(g, greatest(1, i - {GROUPED - 1}), least(i, {GROUPED})), x -> {said}), '')), 24))"
    one = f"named_struct('s', r.s + g[i].s - length({sign}), 'e', r.s + g[j].e, 'v', {value}, 'c', {before}, 'a', j + 1 < size(g))"
    each = f"flatten(transform(sequence(0, size(g) - 1), i -> transform(filter(sequence(i, least(size(g) - 1, i + {GROUPED - 1})), j -> {digits} between 7 and 19), j -> {one})))"
    return f"flatten(transform(filter({runs}, r -> length(r.v) >= 7), r -> transform(array({located('r.v', 'group', '[0-9]+')}), g -> {each})[0]))"


def candidates(text: str, kind: str) -> str:
    """SQL array of the candidates of a generator."""
    found = located(text, kind, WIDE[kind])
    return unions(found) if kind == "number" else f"transform({found}, x -> named_struct('s', x.s, 'e', x.e, 'v', x.v, 'c', x.c, 'a', false))"


def masked(text: str, kind: str) -> str:
    """SQL for the text with the valid matches of a base kind blotted out."""
    return f"array_join(transform({matches(text, KINDS[kind])}, z -> concat(z.g, case when z.v is null then '' when {VALID[kind]} then repeat('\\u0001', length(z.v)) else z.v end)), '')"


def spans(docs: DataFrame) -> DataFrame:
    """Adds __text, by kind the base spans, and the wide candidates outside of them."""
    out = docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumns({f"__{k}": F.expr(f"filter({located('__text', k, p)}, z -> {VALID[k]})") for k, p in KINDS.items()})
    blot = "__text"
    for i, k in enumerate(KINDS):
        out = out.withColumn(f"__m{i}", F.expr(f"case when size(__{k}) > 0 then {masked(blot, k)} else {blot} end"))
        blot = f"__m{i}"
    out = out.withColumns({f"__{k}": F.expr(candidates(blot, k)) for k in WIDE})
    return out.drop(*(f"__m{i}" for i in range(len(KINDS))))


def featured(df: DataFrame) -> DataFrame:
    fields = ", ".join(f"'{k}', {v}" for k, v in FEATURES.items())
    return df.withColumn("__found", F.expr(f"transform(concat({', '.join(f'__{k}' for k in WIDE)}), z -> named_struct('s', z.s, 'e', z.e, {fields}))"))


def examples(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """text, y, personal, half: generated lines with a personal string or two of them (y = 1), or one that looks like it (y = 0), by a rule of the row's number.

    personal has the places (s, e) of the personal strings."""
    number = lambda k, m: f"pmod(xxhash64(id, {k}), {m})"
    digits = lambda k, n: f"lpad(cast({number(k, 10**n)} as string), {n}, '0')"
    one = lambda k, *xs: f"element_at(array({', '.join(xs)}), cast({number(k, len(xs))} + 1 as int))"
    said = lambda k, xs: one(k, *(f"'{x} '" for x in xs.split("|")))
    base = f"concat('4', {digits(1, 14)})"
    valid = f"concat({base}, filter(transform(sequence(0, 9), i -> string(i)), i -> luhn_check(concat({base}, i)))[0])"
    wrong = f"concat({base}, filter(transform(sequence(0, 9), i -> string(i)), i -> not luhn_check(concat({base}, i)))[cast({number(2, 9)} as int)])"
    fours = lambda x: one(3, f"regexp_replace({x}, '(....)(?!$)', '$1 ')", f"regexp_replace({x}, '(....)(?!$)', '$1-')", x)
    calls, pays, papers = said(4, "call me on|tel:|phone|mobile|fax|contact"), said(4, "card|visa|pay with|credit card"), said(4, "ssn|passport|social security")
    counts, plain = said(4, "order|item|isbn|version|page|invoice|serial|no.|code|total"), said(4, "and|the|with|in|near|saw|about|then")
    who, where = one(5, "'ana'", "'j.smith'", "'info'", "'max'", f"concat('user', {digits(6, 2)})"), one(7, "'mail'", "'example'", "'web-de'", "'uni'")
    phone = one(8, f"concat('6', {digits(9, 2)}, ' ', {digits(10, 3)}, ' ', {digits(11, 3)})", f"concat('(0', {digits(9, 2)}, ') ', {digits(10, 4)}, ' ', {digits(11, 4)})", f"concat({digits(9, 3)}, '-', {digits(10, 3)}, '-', {digits(11, 4)})", f"concat('0', {digits(9, 3)}, '.', {digits(10, 6)})")
    date = one(8, f"concat('20', {digits(9, 2)}, '-0', {number(10, 9)} + 1, '-1', {number(11, 9)})", f"concat('19', {digits(9, 2)}, '-20', {digits(10, 2)})", f"concat('1', {number(10, 9)}, '.0', {number(11, 9)} + 1, '.20', {digits(9, 2)})", f"concat('20', {digits(9, 2)}, '-0', {number(10, 9)} + 1, '-1', {number(11, 9)}, ' 1', {number(12, 9)})")
    second = f"concat('5', {digits(21, 14)})"
    beside = fours(f"concat({second}, filter(transform(sequence(0, 9), i -> string(i)), i -> luhn_check(concat({second}, i)))[0])")
    banks, groups = said(4, "iban|account|konto|cuenta|bank|transfer to"), [digits(k, 4) for k in range(30, 36)]
    spaced = lambda *xs: one(8, f"concat_ws(' ', {', '.join(xs)})", f"concat({', '.join(xs)})")
    iban = one(37, spaced(f"concat('ES', {digits(36, 2)})", *groups[:5]), spaced(f"concat('DE', {digits(36, 2)})", *groups[:4], digits(38, 2)), spaced(f"concat('GB', {digits(36, 2)})", "'WEST'", *groups[:3], digits(38, 2)))
    letter = f"substring('TRWAGMYFPDXBNJZSQVHLCKE', cast({number(39, 23)} as int) + 1, 1)"
    person = one(8, f"concat({digits(9, 8)}, {letter})", f"concat({digits(9, 8)}, '-', {letter})", f"concat('X', {digits(9, 7)}, {letter})")
    kinds = [
        (1, calls, phone, "''"), (1, one(13, pays, plain), fours(valid), "''"), (1, one(13, pays, plain), fours(valid), beside), (1, papers, one(8, f"concat({digits(9, 3)}, '-', {digits(10, 2)}, '-', {digits(11, 4)})", digits(9, 9)), "''"),
        (1, one(13, plain, "'mail '", "'contact '"), one(8, f"concat({who}, ' (at) ', {where}, ' (dot) com')", f"concat({who}, ' @ ', {where}, '.org')", f"concat({who}, '[at]', {where}, '[dot]net')", f"concat({who}, '@', {where}, '.de')"), "''"),
        (1, one(13, banks, plain), iban, "''"), (1, one(13, papers, plain), person, "''"), (0, counts, one(8, f"concat('AB', {digits(9, 10)})", f"concat('X', {digits(9, 7)}, '-B')", f"concat('QR', {digits(9, 2)}, ' ', {digits(10, 4)}, ' ', {digits(11, 4)})"), "''"),
        (0, one(13, counts, plain), date, "''"), (0, one(13, counts, plain, plain), fours(wrong), "''"), (0, one(13, counts, plain), one(8, digits(9, 8), digits(9, 10), digits(9, 12), digits(9, 16)), "''"),
        (0, counts, one(8, phone, f"concat('978-', {number(10, 9)}, '-', {digits(11, 2)}, '-', {digits(12, 6)}, '-', {number(14, 9)})"), "''"), (0, plain, one(8, f"concat('1.', {digits(9, 3)}, '.', {digits(10, 3)}, '.', {digits(11, 3)})", f"concat({number(9, 9)}, '.', {digits(10, 10)})", f"concat('1 ', {digits(9, 3)}, ' ', {digits(10, 3)})"), "''"),
        (0, plain, f"concat(element_at(array('apples', 'bread', 'pens'), cast({number(5, 3)} + 1 as int)), ' @ ', {number(9, 9)}, '.', {digits(10, 2)})", "''"),
    ]
    which = f"cast(id % {len(kinds)} as int)"
    part = lambda k: F.expr(f"case {' '.join(f'when {which} = {i} then {x[k]}' for i, x in enumerate(kinds))} end")
    made = spark.range(rows).select(part(0).alias("y"), part(1).alias("before"), part(2).alias("one"), part(3).alias("two"), F.expr(f"cast(id div {len(kinds)} % 2 as int)").alias("half"))
    start = F.length("before") + 12
    first = F.struct(start.alias("s"), (start + F.length("one")).alias("e"))
    other = F.struct((start + F.length("one") + 1).alias("s"), (start + F.length("one") + 1 + F.length("two")).alias("e"))
    spans = F.when(F.col("y") == 0, F.array().cast("array<struct<s:int,e:int>>")).when(F.col("two") == "", F.array(first)).otherwise(F.array(first, other))
    line = F.concat(F.lit("some words, "), "before", "one", F.when(F.col("two") != "", F.concat(F.lit(" "), "two")).otherwise(F.lit("")), F.lit(" and more"))
    return made.select(line.alias("text"), "y", spans.alias("personal"), "half")


def grow(rows: list[tuple], depth: int, rate: float):
    """A tree over rows of (features, gradient, curvature): a leaf's value, or (feature, cut, below, from it on)."""
    best = None
    for f in range(len(FEATURES)) if depth else ():
        for cut in sorted({x[f] for x, _, _ in rows})[1:]:
            sums = [[0.0, 0.0], [0.0, 0.0]]
            for x, g, h in rows:
                side = sums[x[f] >= cut]
                side[0] += g
                side[1] += h
            gain = sum(g * g / (h + 1) for g, h in sums)
            if best is None or gain > best[0] + 1e-9:
                best = gain, f, cut
    if best is None:
        return round(rate * sum(g for _, g, _ in rows) / (sum(h for _, _, h in rows) + 1), 6)
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[0][f] < cut], depth - 1, rate), grow([r for r in rows if r[0][f] >= cut], depth - 1, rate)


def valued(tree, x: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[3] if x[tree[0]] >= tree[1] else tree[2]
    return tree


def told(tree) -> str:
    """SQL for a tree's value of candidate f."""
    if not isinstance(tree, tuple):
        return f"{tree}d"
    return f"case when f.{list(FEATURES)[tree[0]]} >= {tree[1]} then {told(tree[3])} else {told(tree[2])} end"


def boost(fitted: list[tuple], calibrated: list[tuple], rounds: int = 20, rate: float = 0.4, depth: int = 3, precision: float = 0.995) -> dict:
    """Trees of ``depth`` by logistic loss over (features, positives, rows).

    The threshold is the smallest score from which the share of positives in ``calibrated``, rows that the trees haven't
    seen, is at least ``precision``."""
    trees, scores = [], [0.0] * len(fitted)
    for _ in range(rounds if fitted else 0):
        q = [1 / (1 + math.exp(-s)) for s in scores]
        tree = grow([(x, p - n * c, n * c * (1 - c)) for (x, p, n), c in zip(fitted, q)], depth, rate)
        trees.append(tree)
        scores = [s + valued(tree, x) for (x, _, _), s in zip(fitted, scores)]
    threshold, good, rows = None, 0, 0
    ranked = sorted(((sum(valued(t, x) for t in trees), p, n) for x, p, n in calibrated), reverse=True)
    for i, (s, p, n) in enumerate(ranked):
        good, rows = good + p, rows + n
        if good >= precision * rows and (i + 1 == len(ranked) or ranked[i + 1][0] < s):
            threshold = s - 1e-6
    return {"trees": trees, "threshold": threshold}


def train(spark: SparkSession, rows: int = 6000) -> dict:
    """Fit on the candidates of one half of the generated lines and calibrate on the other; no text of the corpus is used.

    Only counts of binned features reach the driver."""
    made = examples(spark, rows).withColumn("__text", F.col("text"))
    made = featured(made.withColumns({f"__{k}": F.expr(candidates("__text", k)) for k in WIDE}))
    # A candidate is personal if it is the personal string itself; parts and unions of it with others are not.
    right = F.exists("personal", lambda p: (p["s"] == F.col("f.s")) & (p["e"] == F.col("f.e"))).cast("int")
    found = made.select("personal", "half", F.explode_outer("__found").alias("f")).where("f is not null").withColumn("y", right)
    counted = found.groupBy("half", *(F.col(f"f.{k}").alias(k) for k in FEATURES)).agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    table = lambda half: sorted((tuple(r[k] for k in FEATURES), r["p"], r["n"]) for r in counted if r["half"] == half)
    return boost(table(0), table(1))


def pii_spans(docs: DataFrame, model: dict) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_sha256, spans (text form) and found (array of start, end, kind).

    The trees select candidates that overlap no base span; of overlapping ones the best score stays, then the earliest,
    then the longest. Those with an at sign are emails, valid card numbers cards, other numbers of 7 to 15 digits
    phones, the rest 'other'. Null and empty texts have no spans; ties at one start go by kind; repeated rows stay; an
    empty table gives an empty result; columns of docs named like the new ones are replaced.
    """
    score = " + ".join(map(told, model["trees"])) or "0d"
    pick = f"f.score >= {model['threshold']}d" if model["threshold"] is not None else "false"
    out = featured(spans(docs))
    out = out.withColumn("__base", F.array_sort(F.concat(*(F.expr(f"transform(__{k}, z -> named_struct('s', z.s, 'k', {i}, 'e', z.e))") for i, k in enumerate(KINDS)))))
    kind = f"case when f.at = 1 then {NAMES.index('email')} when f.country = 1 or f.letter = 1 then {NAMES.index('other')} when f.luhn = 1 then {NAMES.index('card')} when f.digits between 7 and 15 then {NAMES.index('phone')} else {NAMES.index('other')} end"
    out = out.withColumn("__scored", F.expr(f"transform(__found, f -> named_struct('score', {score}, 's', f.s, 'k', {kind}, 'e', f.e))"))
    out = out.withColumn("__more", F.expr(f"array_distinct(filter(__scored, f -> {pick} and not exists(__base, b -> b.s < f.e and f.s < b.e)))"))
    better = "o.s < f.e and f.s < o.e and (o.score > f.score or o.score = f.score and (o.s < f.s or o.s = f.s and o.e > f.e))"
    out = out.withColumn("__more", F.expr(f"transform(filter(__more, f -> not exists(__more, o -> {better})), f -> named_struct('s', f.s, 'k', f.k, 'e', f.e))"))
    out = out.withColumn("__all", F.array_sort(F.concat("__base", "__more")))
    names = "array(" + ", ".join(f"'{k}'" for k in NAMES) + ")"
    said = lambda c: F.expr(f"array_join(transform({c}, z -> concat({names}[z.k], ':', z.s, ':', z.e)), ',')")
    out = out.withColumns({f"n_{k}": F.size(f"__{k}").cast("long") for k in KINDS} | {
        "base_sha256": F.sha2(said("__base"), 256), "spans": said("__all"),
        "found": F.expr(f"transform(__all, z -> named_struct('start', z.s, 'end', z.e, 'kind', {names}[z.k]))")})
    return out.drop("__text", "__base", "__more", "__all", "__found", "__scored", *(f"__{k}" for k in [*KINDS, *WIDE]))


def redact(found: DataFrame) -> DataFrame:
    """Replace the spans of pii_spans() in text by their kind; a span inside an earlier one is left out."""
    parts = ("aggregate(found, named_struct('at', 0, 'out', ''), (acc, z) -> case when z.start < acc.at then acc else "
             "named_struct('at', z.end, 'out', concat(acc.out, substring(text, acc.at + 1, z.start - acc.at), '<', upper(z.kind), '>')) end, "
             "acc -> concat(acc.out, substring(text, acc.at + 1)))")
    return found.withColumn("text", F.expr(f"case when size(found) = 0 then text else {parts} end"))
