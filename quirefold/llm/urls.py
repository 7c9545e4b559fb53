"""URL filter: host-suffix and path-prefix expressions joined to a rule list by hash prefix (built-in functions only)."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, written


#: Judged urls, and rules, up to which their counted list is broadcast.
HITS = 100_000
RULES = 100_000


def url_parts(url):
    """(host, path) columns; null urls and urls without '://' give two empty strings."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge pages.url by rules(host, path, verdict); a rule path must end in '/'.

    A rule fits its host and all subdomains where the url's path starts with the rule's path. The longest rule
    (host plus path, then host, then block before allow) wins; urls without a rule get ``default``.
    Adds host, path, rule, verdict to page_id. Null urls have empty host and path and no rule; repeated rows stay;
    an empty table gives an empty result; other columns are ignored.
    Each distinct url is expanded once, so hot urls cost one expansion, and only rule-depth prefixes are made.
    """
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rules = rules.select(F.concat("host", "path").alias("rule"), F.col("verdict"), F.length("host").alias("host_len")).distinct()
    rules = rules.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, 8))
    deep = rules.agg(F.max(F.size(F.split(F.split("rule", "/")[0], r"\."))).alias("labels"), F.max(F.size(F.split("rule", "/"))).alias("slashes")).first()
    labels, slashes = deep["labels"] or 0, deep["slashes"] or 0
    urls = parsed.where("path != ''").select("host", "path").distinct()
    expand = urls.withColumn("dots", F.split("host", r"\.")).withColumn("segments", F.split("path", "/"))
    expand = expand.withColumns({
        "suffixes": F.expr(f"transform(sequence(1, least({labels}, size(dots))), k -> array_join(slice(dots, -k, k), '.'))") if labels else F.array().cast("array<string>"),
        "prefixes": F.expr(f"filter(transform(sequence(1, least({slashes}, size(segments))), k -> concat(array_join(slice(segments, 1, k), '/'), '/')), p -> startswith(path, p))") if slashes else F.array().cast("array<string>"),
    })
    expand = expand.select("host", "path", F.explode(F.flatten(F.expr("transform(suffixes, s -> transform(prefixes, p -> concat(s, p)))"))).alias("expression"))
    expand = expand.withColumn("full", F.sha2("expression", 256)).withColumn("short", F.substring("full", 1, 8))
    # A rule as wide as a top-level domain meets very many urls: beyond a counted size of the list, hot prefixes are dealt over shares.
    rules = written(rules, "rules")
    met = expand.join(F.broadcast(rules), "short") if rules.count() <= RULES else meet(expand, rules, "short")
    hit = met.where("full = digest").groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "host_len", F.col("verdict").alias("verdict"), "rule")).alias("best"))
    # Nulls and hot urls are many rows of one key: few hits are broadcast once counted, otherwise hot keys are dealt over shares.
    key = F.concat_ws("\u0000", "host", "path").alias("key")
    hit = written(hit.select(key, "best"), "hits")
    keyed = parsed.select("*", key)
    judged = keyed.join(F.broadcast(hit), "key", "left") if hit.count() <= HITS else meet(keyed, hit, "key", how="left")
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
