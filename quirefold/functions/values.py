"""Coercions, labels and small parsers of the import files; all inside the JVM."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Language names with their codes.
LANGUAGES = {"español": "es", "inglés": "en", "francés": "fr", "alemán": "de", "italiano": "it", "portugués": "pt", "catalán": "ca"}


def slug_words(c, width: int | None = None) -> Column:
    """Other signs are deleted, spaces become hyphens; cut to width without trimming the edge again."""
    out = F.regexp_replace(F.regexp_replace(T.trim(F.regexp_replace(T.fold(c), r"[^a-z0-9\s-]", "")), r"\s+", "-"), "-+", "-")
    return F.left(out, F.lit(width)) if width else F.regexp_replace(out, "^-|-$", "")


def title_key(c) -> Column:
    """Folded title without parenthesised text."""
    return T.collapse(F.regexp_replace(T.fold(c), r"\([^)]*\)", " "))


def capitalised(c) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))


def comma_list(c) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), T.trim), lambda x: x != "")


def id_list(c) -> Column:
    """Distinct runs of digits as numbers, as they come; runs too long for one are left out."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+"), 0), lambda x: x.try_cast("long")), lambda x: x.isNotNull()))


def blank_null(c) -> Column:
    return F.nullif(T.trim(c), F.lit(""))


def is_true(c) -> Column:
    return F.coalesce(F.lower(T.trim(c.cast("string"))).isin("true", "1"), F.lit(False))


def language_code(c, default: str = "es") -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for p in LANGUAGES.items() for x in p))[F.lower(T.trim(c))], F.lit(default))


def paragraphs(c) -> Column:
    """Non-blank paragraphs as (type, text)."""
    return F.transform(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n+"), T.trim), lambda x: x != ""), lambda x: F.struct(F.lit("paragraph").alias("type"), x.alias("text")))


def document_id(*keys) -> Column:
    """24 characters drawn from the keys, so that a re-run gives the same id."""
    return F.left(F.sha2(F.concat_ws("\u0001", *keys), 256), F.lit(24))


def json_keys(c) -> Column:
    return F.array_join(F.json_object_keys(c), ", ")


def unfenced(c) -> Column:
    """JSON text without a Markdown fence around it."""
    return T.trim(F.regexp_replace(c, r"```(?:json)?", ""))


def truncated(c, width: int = 8000) -> Column:
    return F.left(T.trim(F.replace(c, F.lit("\r\n"), F.lit("\n"))), F.lit(width))


def year_date(c) -> Column:
    return F.make_date(c, F.lit(1), F.lit(1))


def month(c) -> Column:
    return F.when(c.between(1, 12), c)


def known_year(c) -> Column:
    return F.when(c != 0, c)


def known_place(c) -> Column:
    return F.when(~F.contains(c, F.lit("*ERR")), c)


# The texts of the labels.
def entropy_label(h_norm, reliable) -> Column:
    """Band of the normalised entropy; sums that miss an edge by rounding only count as on it."""
    h_norm = F.round(h_norm, 9)
    return (F.when(~reliable, "insuficiente").when(h_norm < 0.25, "convencional").when(h_norm < 0.5, "moderado")
            .when(h_norm < 0.75, "variado").otherwise("innovador"))


# The texts of the labels.
def few_authors(n, least: int = 5) -> Column:
    return F.when(n < least, F.format_string("%d autores de referencia", n))


# The texts of the labels.
def author_warning(n, label: str, least: int = 3) -> Column:
    """Too few texts of an author for a reliable trajectory."""
    return F.when(n == 0, F.lit(f"Este autor no tiene {label} en español.")).when(n < least, F.format_string(f"Este autor tiene solo %d {label} publicado(s); los resultados pueden ser poco fiables.", n))


# The texts of the labels.
def trend_label(points, difference) -> Column:
    """From the number of points of a trajectory and its last less its first z-score."""
    return (F.when(points < 2, "Sin datos suficientes").when(difference > 0.5, "Innovador (z-score creciente: el autor se aleja de la norma)")
            .when(difference < -0.3, "Convergente (z-score decreciente: el autor se acerca a la norma)").otherwise("Estable (variación inferior a 0,3σ)"))


def two_decimals(c) -> Column:
    """Two decimals by the exact binary value; an exact half goes up."""
    x = c.cast("double")
    half = (x * 8 == F.floor(x * 8)) & (F.floor(x * 8) % 2 != 0)
    return F.replace(F.format_number(F.when(half, (F.floor(x * 100) + 1) / 100).otherwise(x), 2), F.lit(","), F.lit(""))


def activity(*counts) -> Column:
    """Sum of counts, null ones as none."""
    return sum((F.coalesce(c, F.lit(0)) for c in counts), F.lit(0))


def vector(c) -> Column:
    """JSON text of a vector to its numbers."""
    return F.from_json(c, "array<double>")


def vector_text(c) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))


def file_key(c) -> Column:
    """Name of a file or title for matching: without extension, underscores as spaces, folded and collapsed."""
    name = F.regexp_replace(F.regexp_replace(c, "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return T.collapse(T.fold(F.replace(name, F.lit("_"), F.lit(" "))))


def title_name(c) -> Column:
    """Key of a title that file_key() of its image file equals."""
    return T.collapse(T.fold(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" "))))


def filled_place(lat, lng, found_lat, found_lng) -> tuple[Column, Column]:
    """Coordinates of a known city where either is missing."""
    missing = (lat.isNull() | lng.isNull()) & found_lat.isNotNull()
    return F.when(missing, found_lat).otherwise(lat), F.when(missing, found_lng).otherwise(lng)


def colour(place, colours=("#2563eb", "#dc2626", "#059669", "#d97706"), other: str = "#6b7280") -> Column:
    """Colour by the place of an author in the request, from 1 on."""
    return F.coalesce(F.get(F.array(*(F.lit(x) for x in colours)), place - 1), F.lit(other))


def iso_now() -> Column:
    """The time of the query, to milliseconds, in UTC as ISO text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
