"""The queries of this subpackage, over the whole tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, credential_links, decontamination, html_text, jaccard_join, posting_lists, quality, repeats, url_rules, warc, whitening, wordpiece
from .common import fresh_path

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("key")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), outputs=("kept_sha256", "text", "n_in_passages", "without_passages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), fresh_path(spark, "archive"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(_table(spark, sf_dir, "pages"), rules)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.search(_table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(_table(spark, sf_dir, "documents")).drop("key")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("ids_sha256", "decoded_sha256"))


def op11_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_links.digest(credential_links.scan(_table(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", found["deviation"].cast("long"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1_SQL = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item, least(13, len(w)) k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') t
       from b, unnest(range(1, len(w) - least(13, len(w)) + 2)) r(i) where len(w) > 0),
ks as (select distinct k from bw),
dw as (select doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') t from d, ks, unnest(range(1, len(w) - k + 2)) r(i)),
h as (select distinct doc_id, dw.k, i, item from dw join bw on dw.k = bw.k and dw.t = bw.t),
n as (select doc_id, count(distinct p) n_hit from (select distinct doc_id, k, i from h) x, unnest(range(i, i + k)) r(p) group by doc_id),
m as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) l from (select distinct doc_id, item from h) x group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join n on d.doc_id = n.doc_id left join m on d.doc_id = m.doc_id
"""

OP4_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha1(encode(coalesce(html, ''))) h from pages),
q as (select *, max(page_id) over (partition by h, n) m from p)
select page_id, cast(n as bigint) payload_bytes, h payload_digest,
  case when n >= 1000 and page_id <> m then 'revisit' else 'response' end record_type,
  case when n >= 1000 and page_id <> m then m end refers_to
from q
"""

OP7_SQL = f"""
with r(rh, rp, rv) as (values {", ".join(str(x) for x in URL_RULES)}),
u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
p as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), {_UPPER}) host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path from u),
f as (select *, row_number() over (partition by page_id order by length(rh) + length(rp) desc, length(rh) desc) k
      from p left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rh || rp as rule, coalesce(rv, 'allow') verdict from f where k = 1
"""

OP9_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') t from d, unnest(range(1, greatest(len(w) - 3, 2))) r(i) where len(w) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.t = b.t and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 80 * (a.n + b.n - k)),
g as (select doc_id o, doc_id t from d union select g.o, l.y from g join l on g.t = l.x)
select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, min(g.t) component_id from d join g on g.o = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n
"""

#: Matches with their places: the text before each match and the match itself, added up.  Group 2 is the match; group `v` its value.
_MATCHES = r"""
{kind}_m as (select id, unnest(regexp_extract_all(t, '(?s)(.*?)({pattern})', 1)) gap, unnest(regexp_extract_all(t, '(?s)(.*?)({pattern})', 2)) hit,
             unnest(regexp_extract_all(t, '(?s)(.*?)({pattern})', {value})) val, unnest(range(len(regexp_extract_all(t, '(?s)(.*?)({pattern})', 2)))) i from d),
{kind}_x as (select id, hit, val, cast(sum(length(gap) + length(hit)) over (partition by id order by i) as bigint) e from {kind}_m),
{kind}_p as (select id, {number} k, e - length(hit) s, e, hit from {kind}_x where {test})"""


def _letters(*words: str) -> str:
    """Words in either case of ASCII letters."""
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)


_QUOTED = r"""["'']?\x20*[:=]\x20*["'']?"""
_PATTERNS = [
    ("a", "0", f"({_letters('password', 'passwd', 'secret', 'token', 'api_?key')}){_QUOTED}([A-Za-z0-9+/_.=-]+)", 4, "length(val) >= 6"),
    ("b", "1", "AKIA[A-Z0-9]+", 2, "length(hit) >= 20"),
    ("c", "2", "[0-9a-f]+", 2, "length(hit) >= 24"),
    ("u", "3", f"({_letters('username', 'userid', 'user_id', 'user', 'login', 'account', 'client_?id')}){_QUOTED}([A-Za-z0-9_.@+-]+)", 4, "length(val) >= 3"),
    ("o", "4", "[A-Za-z0-9+/_=-]{20,}", 2, "regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[A-Z]') and regexp_matches(hit, '[a-z]')"),
    ("h", "5", r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20"''<>]+""", 2, "true"),
    ("k", "9", r"\n[\x09\x0D\x20]*\n", 2, "true"),
]
OP11_SQL = f"""
with d as (select row_number() over () id, doc_id, coalesce(text, '') t from documents),
{",".join(_MATCHES.format(kind=k, number=n, pattern=p, value=v, test=t) for k, n, p, v, t in _PATTERNS)},
f as (select * from a_p union all select * from b_p union all select * from c_p union all select * from u_p union all select * from h_p),
g as (select * from f union all select * from o_p where not exists (select 1 from f where f.id = o_p.id and f.s < o_p.e and f.e > o_p.s)),
q as (select g.*, (select count(*) from k_p where k_p.id = g.id and k_p.e <= g.s) scope, case when k in (1, 3) then 'i' when k = 5 then 'e' else 's' end role from g),
near as (select distinct x.id, x.k, x.s, y.role from q x join q y on x.id = y.id and x.scope = y.scope and x.k >= 3 and (x.k <> y.k or x.s <> y.s) and x.s - y.e <= 200 and y.s - x.e <= 200),
hasi as (select * from near where role = 'i'), hass as (select * from near where role = 's'),
keep as (select q.id, q.k, q.s, q.e from q left join hasi on q.id = hasi.id and q.k = hasi.k and q.s = hasi.s left join hass on q.id = hass.id and q.k = hass.k and q.s = hass.s
         where q.k < 3 or (q.k = 3 and hass.id is not null) or (q.k = 4 and hasi.id is not null) or (q.k = 5 and hasi.id is not null and hass.id is not null)),
t as (select id, count(*) filter (k = 0) n0, count(*) filter (k = 1) n1, count(*) filter (k = 2) n2, count(*) filter (k >= 3) n3,
        string_agg(['assign', 'access', 'hex', 'ident', 'opaque', 'endpoint'][k + 1] || ':' || s || ':' || e, ',' order by s, k) l,
        string_agg(['assign', 'access', 'hex'][k + 1] || ':' || s || ':' || e, ',' order by s, k) filter (k < 3) b from keep group by id)
select doc_id, coalesce(n0, 0) n_assign, coalesce(n1, 0) n_access, coalesce(n2, 0) n_hex, sha256(coalesce(b, '')) base_sha256, coalesce(l, '') spans, coalesce(n3, 0) n_linked
from d left join t on d.id = t.id
"""

OP13_SQL = rf"""
with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_UPPER}), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from p),
n as materialized (select lang, cast(sum(len(w)) as bigint) n from w group by lang),
h as (select lang, w, unnest([1, 2, 3, 4]) m from w),
i as (select lang, w, m, unnest(range(1, len(w) - m + 2)) i from h),
g as materialized (select lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') phrase, count(*) f from i group by all having count(*) >= 30),
c as materialized (select lang, m, phrase, f a, string_split(phrase, ' ') x from g where m > 1),
k as (select *, unnest([1, 2, 3]) k from c),
x as (select *, array_to_string(x[1:k], ' ') y, array_to_string(x[k + 1:m], ' ') z from k where k < m),
cut as (select x.lang, x.phrase, a, k, b.f l, e.f r, cast(cast(2000000 as hugeint) * a // (b.f + e.f) as bigint) score
        from x join g b on b.lang = x.lang and b.phrase = y join g e on e.lang = x.lang and e.phrase = z),
best as materialized (select * from (select *, row_number() over (partition by lang, phrase order by score, k) o from cut) where o = 1),
held as materialized (select lang, array_to_string(x[i:i + v - 1], ' ') phrase, max(a) longer from (select *, unnest([2, 3]) v from c), unnest(range(1, 4)) z(i) where v < m and i + v - 1 <= m group by all),
kept as (select best.* from best left join held on best.lang = held.lang and best.phrase = held.phrase where coalesce(cast(longer as hugeint) * 100 < cast(a as hugeint) * 80, true)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as "rank" from kept)
select ranked.lang, "rank", phrase, a, l, r, n, score from ranked join n on ranked.lang = n.lang where "rank" <= 2000
"""


def queries() -> dict:
    own = [op1_decontamination, op2_quality, op3_repeats, op4_warc, op5_html_text, op6_token_counts, op7_url_rules, op8_nearest, op9_jaccard_join, op10_bpe, op11_credential_links, op12_whitening, op13_collocations, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op4_warc": OP4_SQL, "op7_url_rules": OP7_SQL, "op9_jaccard_join": OP9_SQL, "op11_credential_links": OP11_SQL, "op13_collocations": OP13_SQL}
