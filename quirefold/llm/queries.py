"""The queries of this subpackage and their SQL."""
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, hardneg, licenses, media, merkle, neardup, packing, pii, secrets, toxicity, urls, warc
from .common import table

# The rules of the URL query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def vocabulary() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_warc(spark, sf_dir):
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licenses(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_urls(spark, sf_dir):
    return urls.url_filter(table(spark, sf_dir, "pages"), spark.sql("select * from values " + ", ".join(map(str, RULES)) + " as r(host, path, verdict)"))


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_score(docs, model).select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted", "worst_sentence")


def op6_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pii_spans(docs, pii.train(spark)).drop("text", "found")


def op7_secrets(spark, sf_dir):
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op8_media(spark, sf_dir):
    return media.media_columns(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_packing(spark, sf_dir):
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), vocabulary())


def op11_hard_negatives(spark, sf_dir):
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark, sf_dir):
    return fingerprints.edited_documents(table(spark, sf_dir, "documents"))


def op13_merkle(spark, sf_dir):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})


QUERIES = {f.__name__: f for f in (op1_warc, op2_decontaminate, op3_licenses, op4_urls, op5_toxicity, op6_pii, op7_secrets, op8_media, op9_near_duplicates, op10_packing,
                                   op11_hard_negatives, op12_fingerprints, op13_merkle)}

ORACLE_SQL = {
    "op4_urls": """
        with r(rh, rp, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        p as (select page_id, row_number() over () as n, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        q as (select page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
        m as (select n, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(v, length(rh || rp)) as v from q join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by n)
        select page_id, host, path, rule, coalesce(v, 'allow') as verdict from q left join m using (n)""",
    "op11_hard_negatives": """
        with p as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
          where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score from p a join p b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
        o as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select o.anchor_id, o.vec_id as positive_id, cast(row_number() over w as int) as rank, s.vec_id as negative_id, o.score as positive_score, s.score as negative_score
        from o join s on s.anchor_id = o.anchor_id and not s.same and 80 * o.score <= 100 * s.score and 100 * s.score <= 100 * o.score
        window w as (partition by o.anchor_id, o.vec_id order by s.score desc, s.vec_id) qualify row_number() over w <= 5""",
    "op13_merkle": """
        with recursive b as (select *, case when doc_id is not null then xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda d: cast(ascii(d) as bigint))),
          lambda c, d: list_reduce(list_concat([xor(c, d)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end))) end as crc from documents),
        t as (select doc_id, source, coalesce('=' || source, '-') as tree, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
          || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head, text, case when crc % 2 = 0 then replace(text, chr(10), '') else text end as cut from b),
        l as (select doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) as other from t),
        n as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf, other) - 1 as place, count(*) over (partition by tree) as size from l),
        v as (select 0 as level, tree, place, size, leaf as hash from n union all
          select level + 1, tree, place // 3, (size + 2) // 3, sha256(string_agg(hash, '' order by place)) from v where size > 1 group by level, tree, place // 3, size),
        g as (select tree, hash as subroot, row_number() over (order by tree) - 1 as place, count(*) over () as size from v where size = 1),
        u as (select 0 as level, place, size, subroot as hash from g union all select level + 1, place // 3, (size + 2) // 3, sha256(string_agg(hash, '' order by place)) from u where size > 1 group by level, place // 3, size),
        vs as (select level, tree, place // 3 as run, list(hash order by place) as kids from v where size > 1 group by all), us as (select level, place // 3 as run, list(hash order by place) as kids from u where size > 1 group by all),
        vp as (select n.tree, n.place as leaf_place, vs.level, vs.kids, (n.place // cast(pow(3, vs.level) as bigint)) % 3 as slot from n join vs on vs.tree = n.tree and vs.run = n.place // cast(pow(3, vs.level + 1) as bigint)),
        up as (select g.tree, us.level + 1000 as level, us.kids, (g.place // cast(pow(3, us.level) as bigint)) % 3 as slot from g join us on us.run = g.place // cast(pow(3, us.level + 1) as bigint)),
        q as (select tree, leaf_place, level, array_to_string(kids[1:slot], '') as a, array_to_string(kids[slot + 2:], '') as z from vp
          union all select up.tree, n.place, level, array_to_string(kids[1:slot], ''), array_to_string(kids[slot + 2:], '') from up join n on n.tree = up.tree),
        f as (select tree, leaf_place, list({'a': a, 'z': z} order by level) as proof from q group by all),
        d as (select n.*, coalesce(proof, []) as proof, g.subroot, (select hash from u where size = 1) as root from n join g using (tree) left join f on f.tree = n.tree and f.leaf_place = n.place),
        r as (select *, list_reduce(list_concat([{'a': other, 'z': ''}], proof), lambda h, p: {'a': sha256(p.a || h.a || p.z), 'z': ''}).a as folded_root from d)
        select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda p: p.a || p.z), '')) as proof_sha256, folded_root, folded_root = root as verified from r""",
}
