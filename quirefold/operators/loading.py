"""Idempotent imports and updates: each gives the change set as a DataFrame, so a dry run is a count of it."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .ranks import numbered


def resolved(rows: DataFrame, key: str, table: DataFrame, table_key: str, into: str) -> DataFrame:
    """Legacy keys to ids; unresolved rows stay with a null id, for a report."""
    return rows.join(table.select(F.col(table_key).alias(key), F.col("id").alias(into)).groupBy(key).agg(F.min(into).alias(into)), key, "left")


def classify(new: DataFrame, existing: DataFrame, keys: list[list[str]]) -> DataFrame:
    """new with match_id and action: matched by the first key list that finds a row of existing(id, ...), else created.

    A null in a key list matches nothing; the smallest id wins."""
    out, found = new, []
    for i, key in enumerate(keys):
        side = existing.groupBy(*key).agg(F.min("id").alias(f"__m{i}"))
        out = out.join(side, key, "left")
        found.append(F.col(f"__m{i}"))
    match = F.coalesce(*found)
    return out.withColumns({"match_id": match, "action": F.when(match.isNull(), "create").otherwise("update")}).drop(*(f"__m{i}" for i in range(len(keys))))


def unique_slugs(rows: DataFrame, slug: str, existing: DataFrame, order: list[str]) -> DataFrame:
    """Each row its own slug: a slug not in existing stays with its first row, the others get the free counters in order.

    A counter is free unless existing, or a row that keeps its slug, has the slug with that counter. Two different slugs
    never give the same one, as the last hyphen and number part it. A null slug counts as empty."""
    rows = rows.withColumn(slug, F.coalesce(slug, F.lit("")))
    there = existing.select(slug).where(F.col(slug).isNotNull()).distinct().withColumn("__there", F.lit(1))
    # Very many rows may have one slug, as the empty one of nulls.
    ranked = numbered(rows, slug, order, "__n").join(there, slug, "left").withColumn("__n", (F.col("__n") - 1 + F.coalesce("__there", F.lit(0))).cast("int"))
    held = rows.select(slug).union(existing.select(slug)).where(F.col(slug).rlike("-[1-9][0-9]{0,8}$")).distinct()
    taken = held.select(F.regexp_extract(slug, "^(?s)(.*)-[0-9]+$", 1).alias(slug), F.regexp_extract(slug, "([0-9]+)$", 1).cast("int").alias("k"))
    taken = taken.groupBy(slug).agg(F.array_sort(F.collect_set("k")).alias("__taken"))
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__n"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    out = ranked.join(taken, slug, "left").withColumn(slug, F.when(F.col("__n") > 0, F.concat_ws("-", slug, free)).otherwise(F.col(slug)))
    return out.drop("__there", "__taken", "__n")


def theme_links(rows: DataFrame, themes: DataFrame, column: str = "theme") -> DataFrame:
    """rows with theme_id of themes(id, name), by name without regard to case and edges; unknown names are dropped."""
    key = lambda c: F.lower(T.trim(F.col(c)))
    known = themes.groupBy(key("name").alias("__k")).agg(F.min("id").alias("theme_id"))
    return rows.withColumn("__k", key(column)).join(known, "__k").drop("__k")


def image_files(titles: DataFrame, files: DataFrame) -> DataFrame:
    """titles(title) with the path of the image file of that name, null without one; the last of several files counts."""
    named = files.groupBy(V.file_key(F.col("path")).alias("__k")).agg(F.max("path").alias("path"))
    return titles.withColumn("__k", V.title_name(F.col("title"))).join(named, "__k", "left").drop("__k")


def seeded(table: DataFrame, seed: DataFrame) -> DataFrame:
    """The table, or the seed rows where it is empty."""
    return seed if table.isEmpty() else table


def cascade(owners: DataFrame, gone: DataFrame, owned: DataFrame, key: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """(owners, owned) without those whose key is in gone."""
    gone = gone.select(key).distinct()
    return owners.join(gone, key, "left_anti"), owned.join(gone.withColumnRenamed(key, owner), owner, "left_anti")


def by_id(pages: DataFrame, key: str = "id") -> DataFrame:
    """One row an id of landed pages."""
    return pages.dropDuplicates([key])


def missing_keys(wanted: list[str], table: DataFrame, key: str) -> list[str]:
    """Requested keys that the table lacks, in order of the request, each once."""
    wanted = list(dict.fromkeys(wanted))
    found = {r[0] for r in table.where(F.col(key).isin(*wanted)).select(key).distinct().collect()} if wanted else set()
    return [w for w in wanted if w not in found]


def valid(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with every required cell, the rest)."""
    ok: Column = F.lit(True)
    for c in required:
        ok = ok & (F.coalesce(T.trim(F.col(c).cast("string")), F.lit("")) != "")
    return rows.where(ok), rows.where(~ok)


def report(rows: DataFrame, column: str = "action") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def merge_filled(current: DataFrame, new: DataFrame, key: str, columns: list[str], force: bool = False) -> DataFrame:
    """Rows of current that new changes: nulls are filled, or with force all known values taken.

    Of several new rows for a key the smallest known value of each column counts."""
    n = new.groupBy(key).agg(*(F.min(c).alias(f"__{c}") for c in columns))
    out = current.join(n, key)
    value = {c: F.coalesce(f"__{c}", c) if force else F.coalesce(c, f"__{c}") for c in columns}
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(value[c])
    return out.where(changed).select(key, *(v.alias(c) for c, v in value.items()))


def new_links(links: DataFrame, existing: DataFrame, keys: list[str], replace: bool = False) -> DataFrame:
    """Links to hold: add-only union, or with replace the new ones for every owner (the first key) that has any."""
    if replace:
        return existing.join(links.select(keys[0]).distinct(), keys[0], "left_anti").select(*keys).unionByName(links.select(*keys).distinct())
    return existing.select(*keys).unionByName(links.select(*keys)).distinct()


def links_without_owner(links: DataFrame, existing: DataFrame, owner: str) -> DataFrame:
    """Links of owners that have none yet."""
    return links.join(existing.select(owner).distinct(), owner, "left_anti").distinct()


def mentioned(people: DataFrame, articles: DataFrame) -> DataFrame:
    """people(canon, articulos: array of structs with slug) to (name, article_id) links; unknown slugs are dropped."""
    named = people.select(T.trim("canon").alias("name"), F.explode("articulos").alias("a")).select("name", F.col("a.slug").alias("slug"))
    return named.join(articles.select("slug", "article_id"), "slug").select("name", "article_id").distinct()


def insert_names(names: DataFrame, existing: DataFrame, column: str = "nombre") -> DataFrame:
    """Names not there yet, without regard to case and edges; new rows are not merged with each other."""
    key = F.lower(T.trim(F.col(column)))
    return names.withColumn("__k", key).join(existing.select(key.alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def toggled(df: DataFrame, id_, column: str = "activa") -> DataFrame:
    return df.withColumn(column, F.when(F.col("id") == id_, ~F.col(column)).otherwise(F.col(column)))


def biographic(rows: DataFrame) -> DataFrame:
    """First-rank rows with unknown years and places as null and places capitalised."""
    years = {c: V.known_year(T.leading_int(c)) for c in ("birth_year", "death_year")}
    places = {c: V.capitalised(V.known_place(V.blank_null(F.col(c)))) for c in ("birth_place", "death_place")}
    return rows.where("rank = 1").withColumns(years | places)


def sync_by_name(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new(id_legacy, name) against existing(id, name, id_legacy) by name key: update, skip (same legacy id) or create.

    Of existing rows with one key the smallest id counts."""
    side = existing.groupBy(T.name_key("name").alias("key")).agg(F.min(F.struct("id", "id_legacy")).alias("m")).select("key", F.col("m.id").alias("match_id"), F.col("m.id_legacy").alias("old"))
    out = new.withColumn("key", T.name_key("name")).join(side, "key", "left")
    action = F.when(F.col("match_id").isNull(), "create").when(F.col("old").eqNullSafe(F.col("id_legacy")), "skip").otherwise("update")
    return out.select("id_legacy", "name", "match_id", action.alias("action"))


def relation_changes(sheet: DataFrame, existing: dict[str, DataFrame], known: dict[str, DataFrame], owner: str) -> DataFrame:
    """owner, relation, connect, disconnect, unresolved: what makes each owner's relations those of its sheet row.

    sheet(owner, <relation>: array of names, ...) has a column for each relation; null leaves that relation alone, an
    empty array empties it. existing[relation](owner, id) and known[relation](id, name) hold links and names, compared
    without regard to case and edges, of several ids of a name the smallest. Names that nothing has are unresolved.
    Arrays are sorted; an owner without a difference gives no row unless a name is unresolved."""
    out = None
    for relation, links in existing.items():
        key = lambda c: F.lower(T.trim(c))
        asked = sheet.where(F.col(relation).isNotNull()).select(owner, F.explode_outer(relation).alias("__name")).distinct()
        ids = known[relation].groupBy(key(F.col("name")).alias("__k")).agg(F.min("id").alias("__id")).where("__k is not null")
        wanted = asked.withColumn("__k", key(F.col("__name"))).join(ids, "__k", "left").groupBy(owner).agg(
            F.collect_set("__id").alias("wanted"), F.array_sort(F.collect_set(F.when(F.col("__id").isNull() & (F.col("__k") != ""), F.col("__name")))).alias("unresolved"))
        held = links.groupBy(owner).agg(F.collect_set("id").alias("held"))
        both = wanted.join(held, owner, "left").withColumn("held", F.coalesce("held", F.array().cast(held.schema["held"].dataType)))
        part = both.select(owner, F.lit(relation).alias("relation"), F.array_sort(F.array_except("wanted", "held")).alias("connect"), F.array_sort(F.array_except("held", "wanted")).alias("disconnect"), "unresolved")
        part = part.where((F.size("connect") > 0) | (F.size("disconnect") > 0) | (F.size("unresolved") > 0))
        out = part if out is None else out.unionByName(part)
    return out


def related(links: DataFrame, changes: DataFrame, relation: str, owner: str) -> DataFrame:
    """links(owner, id) of a relation after changes of relation_changes()."""
    own = changes.where(F.col("relation") == relation)
    gone = own.select(owner, F.explode("disconnect").alias("id"))
    return links.select(owner, "id").join(gone, [owner, "id"], "left_anti").unionByName(own.select(owner, F.explode("connect").alias("id"))).distinct()


def new_publications(sheet: DataFrame, existing: DataFrame, files: DataFrame, order: list[str]) -> DataFrame:
    """title, slug, first_year, last_year, place, cover, action of sheet(title, first, last, place) rows.

    A row is created unless existing(slug), or a row before it in ``order``, has its slug. Years that are no numbers, or
    nought, and blank places are null; the cover is the image file of the title's name, null without one."""
    rows = image_files(sheet.withColumn("title", T.trim(F.coalesce("title", F.lit("")))), files).withColumnRenamed("path", "cover")
    rows = rows.withColumns({"slug": V.slug_words("title", 80), "first_year": V.known_year(F.expr("try_cast(first as int)")), "last_year": V.known_year(F.expr("try_cast(last as int)")), "place": V.blank_null(F.col("place"))})
    ranked = numbered(rows, "slug", order, "__n").join(existing.select("slug").distinct().withColumn("__there", F.lit(True)), "slug", "left")
    create = F.col("__there").isNull() & (F.col("__n") == 1)
    return ranked.select("title", "slug", "first_year", "last_year", "place", "cover", F.when(create, "create").otherwise("skip").alias("action"))


def categories(table: DataFrame, seed: DataFrame) -> DataFrame:
    """The categories in order of their ids, the seed ones where there are none yet."""
    return seeded(table, seed).orderBy("id")
