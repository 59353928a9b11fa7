"""The queries of the dealt operators over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_sharding,
    collocations,
    conversation_repair,
    fair_mixing,
    itq_dedup,
    nb_toxicity,
    partenum_join,
    pii_feistel,
    pu_quality,
    sentencepiece_bpe,
    topk_search,
    url_rules,
    warc_merkle,
)
from .common import discard, table
from .labelled import held_out

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
QUALITY_AT, TOXIC_AT = 0.3, 0.5
PII_KEY = "tidewatch"
WEIGHTS, SHARE = (5, 2, 1), 1.5


def model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a decayed replica of the archive of all pages: the damaged records, with the roots compared."""
    records = warc_merkle.laid_out(table(spark, sf_dir, "pages"), held=warc_merkle.decayed())
    keep = ("page_id", "url")
    good = warc_merkle.tree(records, keep=keep)
    other = warc_merkle.tree(records.filter("held is not null").drop("sha256").withColumnRenamed("held", "sha256"), keep=keep)
    discard(records)
    return warc_merkle.audit(good, other, keep).select("page_id", "url", "offset", "length", "expected", "found", "state")


OP1_SQL = """
with t as (
  select page_id, url, coalesce(url, '') as u, coalesce(html, '') as h from pages
), r as (
  select page_id, url, u, h, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u
    || chr(13) || chr(10) || 'Content-Length: ' as a, chr(13) || chr(10) || chr(13) || chr(10) as e, substr(md5(u), 1, 2) as mark from t
), d as (
  select page_id, url, mark, a || strlen(h) || e || h || e as whole,
    case mark when '00' then a || strlen('~' || substr(h, 2)) || e || '~' || substr(h, 2) || e when '01' then null else a || strlen(h) || e || h || e end as held
  from r
), o as (
  select page_id, url, strlen(whole)::bigint as length, sha256(whole) as expected, sha256(held) as found, held is null as lost from d
), p as (
  select *, (sum(length) over (order by page_id nulls first, url nulls first, expected rows unbounded preceding) - length)::bigint as "offset" from o
)
select page_id, url, "offset", length, expected, found, case when lost then 'missing' else 'altered' end as state
from p where found is distinct from expected
"""


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])))
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
with u as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
), p as (
  select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u
), r(h, s, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f as (
  select host, path, arg_max(h || s, length(h || s)) as rule, arg_max(v, length(h || s)) as verdict
  from (select distinct host, path from p) join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by host, path
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join f using (host, path)
"""


def op3_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs, as a check on small tables: what the query finds is among these links.
OP3_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), p as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95
), r(vec_id, c) as (
  select vec_id, vec_id from embeddings union select r.vec_id, p.b from r join p on r.c = p.a
), n as (select a, count(*) as n from p group by 1)
select vec_id, coalesce(any_value(n), 0)::bigint as n_links, min(c) as component_id, vec_id = min(c) as kept from r left join n on n.a = vec_id group by vec_id
"""


def op4_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii_feistel.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", "text", F.coalesce(F.size("pii"), F.lit(0)).cast("long").alias("n_values"), F.transform("pii", lambda x: x["kind"]).alias("kinds"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q::double[], b.q::double[])::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, n::integer as rank, vec_id, score from r where n <= 5
"""


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = pu_quality.fit(docs, table(spark, sf_dir, "labels"))
    return pu_quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= QUALITY_AT).cast("int").alias("predicted")
    )


def op7_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = nb_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return nb_toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted")
    )


def op8_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum_join.jaccard_components(table(spark, sf_dir, "documents"))


#: Pairs by their common shingles, then reachability: for small tables.
OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, sh from (select doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w)
), n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
p as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, m) as (select doc_id, doc_id from documents union select r.doc_id, p.b from r join p on r.m = p.a)
select r.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(m) as component_id from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""


def op9_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = fair_mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, SHARE)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), model_path())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"), least=10, share=0.5, top=2000)


OP11_SQL = r"""
with t as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from t),
f as (
  select lang, k, phrase, count(*) as f from (
    select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase from w, range(1, 4) r(k)
  ) group by all
), n as (select lang, sum(f) as n from f where k = 1 group by 1),
c as (select *, string_split(phrase, ' ') as s, f as a from f where k > 1 and f >= 10),
x as (
  select c.lang, c.k, c.phrase, a, cut, l.f as l, r.f as r, (1000000 * a::hugeint * a) // (l.f::hugeint * r.f) as score
  from (select *, unnest(range(1, k)) as cut from c) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(s[1:cut], ' ') and l.k = cut join f r on r.lang = c.lang and r.phrase = array_to_string(s[cut + 1:], ' ') and r.k = c.k - cut
), b as (select * from x qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
d as (select distinct lang, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) as phrase, a as longer from c where k = 3),
kept as (select * from b where not exists (select 1 from d where d.lang = b.lang and d.phrase = b.phrase and b.k = 2 and 100 * longer >= 50 * a))
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join n using (lang) where rank <= 2000
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damaged(rows), rows)


#: CRC-32 of a list of bytes b, by the usual table of 256 steps in the one-row table `crc`.
CRC = "crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t)"
CRC_OF = "xor(list_reduce({b}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295)"
BYTES = "list_transform(regexp_extract_all(hex(encode({s})), '..'), lambda h: ('0x' || h)::bigint)"

#: The edits as a shortest path: one step for each row, insertions before it and at the end.
OP12_SQL = f"""
with recursive {CRC}, o as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {BYTES.format(s="coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} as b from conversations
), d as (select *, {CRC_OF.format(b="b")} % 20 as k from o, crc),
r as (
  select conv_id, turn, case k when 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(case k when 0 then [] when 3 then [1, 2] else [1] end) from d)
), n as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as i from r
), w as (
  select *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as z, row_number() over (partition by conv_id, role, text order by i) > 1 as again, lag(role) over (partition by conv_id order by i) as prev from n
), f as (
  select *, z = '' as blank, z <> '' and again as duplicate, z <> '' and not again and z not in ('.', '!', '?') as truncated from w
), s(p, l, q) as (values ('0', 's', 'S'), ('0', 'u', 'U'), ('S', 'u', 'U'), ('A', 'u', 'U'), ('U', 'a', 'A')),
-- up to three insertions in a row lead anywhere that they can
ins(p, q, cost, audit, said) as (
  values ('0', '0', 0, '', []::varchar[]), ('S', 'S', 0, '', []), ('U', 'U', 0, '', []), ('A', 'A', 0, '', []), ('0', 'U', 2, 'I', ['user:']), ('0', 'A', 4, 'II', ['user:', 'assistant:']),
    ('S', 'U', 2, 'I', ['user:']), ('S', 'A', 4, 'II', ['user:', 'assistant:']), ('U', 'A', 2, 'I', ['assistant:']), ('A', 'U', 2, 'I', ['user:'])
), step as (
  select conv_id, i, p, p as q, 3 as cost, 'D' as audit, []::varchar[] as said from f, (values ('0'), ('S'), ('U'), ('A')) v(p)
  union all
  select conv_id, i, p, q, case when role[1] = l then 0 else 2 end + truncated::int, case when role[1] = l then 'K' else 'R' end, [case when role[1] = l then role when l = 'u' then 'user' else 'assistant' end || ':' || text]
  from f, s where not blank and not duplicate and (role[1] = l or l in ('u', 'a'))
), path(conv_id, i, q, cost, audit, said) as (
  select conv_id, 0::bigint, ins.q, ins.cost, ins.audit, ins.said from (select distinct conv_id from conversations), ins where ins.p = '0'
  union all
  select conv_id, i, q, b.cost, b.audit, b.said from (
    select path.conv_id, step.i, ins.q, min({{'cost': path.cost + step.cost + ins.cost, 'audit': path.audit || step.audit || ins.audit, 'said': path.said || step.said || ins.said}}) as b
    from path join step on path.conv_id is not distinct from step.conv_id and step.i = path.i + 1 and step.p = path.q join ins on ins.p = step.q group by 1, 2, 3
  )
), best as (
  select path.conv_id, min({{'cost': cost, 'audit': audit, 'said': said}}) as b
  from path join (select conv_id, max(i) as n from f group by 1 union all select conv_id, 0 from conversations group by 1 having conv_id not in (select conv_id from f)) e on path.conv_id is not distinct from e.conv_id and i = n
  where q in ('0', 'A') group by 1
), g as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (prev is not null and coalesce(prev[1], '') || coalesce(role[1], '') not in ('su', 'ua', 'au')) as illegal from f group by 1
)
select best.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  b.cost::bigint as cost, b.audit as audit, sha256(array_to_string(b.said, chr(10))) as repaired_sha256 from best left join g on g.conv_id is not distinct from best.conv_id
"""


def op13_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = byte_sharding.shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP13_SQL = f"""
with {CRC}, s as (
  select doc_id, strlen(coalesce(text, ''))::bigint + 8 as size, {CRC_OF.format(b="b")}::bigint as text_crc32 from (select *, {BYTES.format(s="coalesce(text, '')")} as b from documents), crc
), p as (select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding) as upto, sum(size) over () as whole from s),
h as (select *, least(23, (24 * (2 * upto - size)) // (2 * whole))::integer as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot, null::integer as grown_shard from h
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc_merkle, op2_url_rules, op3_itq_dedup, op4_pii_feistel, op5_topk_search, op6_pu_quality, op7_nb_toxicity, op8_partenum_join, op9_fair_mixing, op10_sentencepiece, op11_collocations, op12_conversation_repair, op13_byte_sharding)
}
SQL: dict[str, str] = {"op1_warc_merkle": OP1_SQL, "op2_url_rules": OP2_SQL, "op3_itq_dedup": OP3_SQL, "op8_partenum_join": OP8_SQL, "op5_topk_search": OP5_SQL, "op11_collocations": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_byte_sharding": OP13_SQL}
