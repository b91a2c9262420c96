"""Registered queries of the text operators and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.llm import bitslice, bpe, clusters, decontaminate, hmm, jaccard, language, licenses, lines, pii, quality, resample, suffixes


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op5_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the multilingual byte-level vocabulary and the bytes they decode to, as digests."""
    return bpe.digests(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                       public_tokenizers.PATTERN)


def op1_bit_sliced_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The ten rows of largest inner product for every hundredth vector."""
    return bitslice.top_k(_table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


OP1 = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.n, q.vec_id as query_id, r.vec_id, cast(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v r on q.vec_id % 100 = 0 and q.n <> r.n and len(q.v) = len(r.v)
)
select query_id, cast(row_number() over (partition by n order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify rank <= 10
"""


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """License rules that match each document."""
    return licenses.scan(_table(spark, sf, "documents"))


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the runs of 50 words or more that occurred earlier."""
    return lines.deduplicate(_table(spark, sf, "documents"))


OP3 = """
with line as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents
), own as (
  select doc_id, i, trim(line, ' ' || chr(9) || chr(13)) as line, len(regexp_extract_all(line, '[^ \t\r\n\f\v]+')) as words
  from line where regexp_matches(line, '[^ \t\r\n\f\v]')
), summed as (
  select *, row_number() over w as r, sum(words) over w as till, sum(words) over w - words as before
  from own window w as (partition by doc_id order by i)
), pair as (
  select a.doc_id, a.r as lo, b.r as hi from summed a asof join summed b on a.doc_id = b.doc_id and a.before + 50 <= b.till
  union
  select a.doc_id, b.r, a.r from summed a asof join summed b on a.doc_id = b.doc_id and a.till - 50 >= b.before
), doc as (
  select doc_id, list(line order by i) as lines, list(i order by i) as place from own group by doc_id
), win as (
  select doc_id, lo, place[lo] as first, place[hi] as last, array_to_string(lines[lo:hi], chr(10)) as content from pair join doc using (doc_id)
), origin as (
  select content, min({'d': doc_id, 'i': first}) as o from win group by content having count(*) > 1
), run as (
  select doc_id, first, last from win join origin using (content) where o <> {'d': doc_id, 'i': first}
), gone as (
  select distinct own.doc_id, own.i from own join run on own.doc_id = run.doc_id and own.i between run.first and run.last
), kept as (
  select line.doc_id, string_agg(line.line, chr(10) order by line.i) as text from line left join gone on line.doc_id = gone.doc_id and line.i = gone.i
  where gone.i is null group by line.doc_id
)
select d.doc_id, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines,
  case when d.text is null then null else coalesce(k.text, '') end as text,
  coalesce(g.n, 0) as n_deleted
from documents d left join kept k using (doc_id) left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id)
"""


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark items that each document holds, within a fifth of the item's length in edits."""
    return decontaminate.matches(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op6_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its class of five-word Jaccard similarity 0.8 or more and its number of links."""
    return jaccard.classes(_table(spark, sf, "documents"))


OP6 = r"""
with recursive word as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), gram as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as g from word
), size as (
  select doc_id, count(*) as n from gram group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from gram a join gram b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), link as (
  select a, b from common join size x on x.doc_id = a join size y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c) - 1e-9
), reach(a, b) as (
  select doc_id, doc_id from documents union select reach.a, link.b from reach join link on reach.b = link.a
)
select d.doc_id, (select min(b) from reach where a = d.doc_id) as class_id, (select count(*) from link where a = d.doc_id) as n_links from documents d
"""


def op7_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document: base spans counted and digested, all spans listed."""
    return pii.digest(_table(spark, sf, "documents"))


def op8_hmm_score(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's log10 probability by a smoothed unigram base and by the hidden Markov model."""
    return hmm.score(_table(spark, sf, "documents"))


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document by hyperdimensional profiles."""
    return language.identify(_table(spark, sf, "documents"))


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrated quality of every document."""
    return quality.score(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op11_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, its noisy score and its place in the draw of a quarter."""
    return resample.resample(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")).drop("n_words")


OP11 = r"""
with recursive bits as (
  select b::bigint as b, b::bigint as x, 0 as k from range(256) r(b)
  union all
  select b, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, k + 1 from bits where k < 8
), crc as (
  select list(x order by b) as t from bits where k = 8
), text as (
  select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark
), word as (
  select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from text
), feature as (
  select kind, id, unnest(w) as f from word
  union all
  select kind, id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) from word
), bucketed as (
  select f, xor(list_reduce(list_transform(generate_series(1, strlen(f)), lambda i: ('0x' || hex(encode(f))[2 * i - 1:2 * i])::bigint),
    lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8), 4294967295), 4294967295) % 10000 as bucket
  from (select distinct f from feature), crc
), hit as (
  select kind, id, bucket, count(*) as n from feature join bucketed using (f) group by all
), total as (
  select coalesce(sum(n) filter (kind = 'd'), 0)::double as s, coalesce(sum(n) filter (kind = 'b'), 0)::double as t from hit
), gain as (
  select bucket, cast(floor(1000 * ln((coalesce(sum(n) filter (kind = 'b'), 0) + 1)::double * (any_value(total.s) + 10000)
    / ((coalesce(sum(n) filter (kind = 'd'), 0) + 1)::double * (any_value(total.t) + 10000)))) as bigint) as g
  from hit, total group by bucket
), own as (
  select id, sum(n)::bigint as n, sum(n * g)::bigint as g from hit join gain using (bucket) where kind = 'd' group by id
), scored as (
  select w.id as doc_id, len(w.w) as words, coalesce(n, 0) as n_features, case when n is null then 0 else (g - ((g % n) + n) % n) // n end as weight,
    cast(floor(-1000 * ln(-ln((('0x' || sha256('7:' || w.id)[1:8])::bigint + 0.5) / 4294967296.0::double))) as bigint) as noise
  from word w left join own on own.id = w.id where w.kind = 'd'
), ranked as (
  select *, row_number() over (partition by words >= 20 order by weight + noise desc, doc_id) as r, count(*) filter (words >= 20) over () as n from scored
)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, (weight + noise)::bigint as score,
  case when words >= 20 and r <= 25 * n // 100 then r end as rank
from ranked
"""


def op12_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's cluster after three rounds from 16 hashed starts."""
    return clusters.cluster(_table(spark, sf, "embeddings"))


def _op12_sql() -> str:
    """Three rounds and the last assignment, written out."""
    nearest = """dist{r} as (
  select v.vec_id, v.n, v.v, c.c, c.m, cast(list_sum(list_transform(list_zip(v.v, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d
  from v cross join cent{r} c
), near{r} as (
  select * from dist{r} qualify row_number() over (partition by n order by d, c) = 1
)"""
    mean = """mean{r} as (
  select c, i, (s - ((s % k) + k) % k) // k as x from (
    select c, i, sum(x)::bigint as s, count(*) as k from (select c, unnest(v) as x, unnest(range(64)) as i from near{r}) group by c, i)
), cent{s} as (
  select p.c, coalesce(q.m, p.m) as m from cent{r} p left join (select c, list(x order by i) as m from mean{r} group by c) q on p.c = q.c
)"""
    parts = [nearest.format(r=r) + (",\n" + mean.format(r=r, s=r + 1) if r < 3 else "") for r in range(4)]
    return """with v as (
  select vec_id, row_number() over () as n, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), cent0 as (
  select row_number() over (order by sha256('1:' || vec_id), v) - 1 as c, v as m from v qualify c < 16
),
""" + ",\n".join(parts) + """
select vec_id, cast(c as integer) as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from near3
"""


def op13_repeated_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that start more than once, as a digest."""
    return suffixes.digest(_table(spark, sf, "documents"))


OP13 = """
with d as (
  select doc_id, row_number() over () as n, hex(encode(coalesce(text, ''))) as h from documents
), string as (
  select n, i, md5(substr(h, 2 * i + 1, 400)) as s from (select n, h, unnest(range(strlen(h) // 2 - 199)) as i from d)
), twice as (
  select n, i from string qualify count(*) over (partition by s) > 1
), islands as (
  select n, i, sum(new) over (partition by n order by i) as k from (select n, i, case when i - lag(i) over (partition by n order by i) <= 200 then 0 else 1 end as new from twice)
), gone as (
  select n, min(i) as a, max(i) + 200 as b from islands group by n, k
), piece as (
  select n, lag(b, 1, 0) over w as a, a as b from gone window w as (partition by n order by a)
  union all select n, max(b), null from gone group by n
), kept as (
  select n, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, strlen(h) // 2) - a)), '' order by a) as h from piece join d using (n) group by n
), sums as (
  select n, sum(b - a)::bigint as removed, count(*) as spans from gone group by n
)
select doc_id, (strlen(d.h) // 2)::bigint as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join kept using (n) left join sums using (n)
"""


QUERIES = {
    "op1_bit_sliced_top_k": op1_bit_sliced_top_k,
    "op5_byte_bpe": op5_byte_bpe,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_personal_data": op7_personal_data,
    "op8_hmm_score": op8_hmm_score,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_repeated_strings": op13_repeated_strings,
}

ORACLES: dict[str, str] = {
    "op1_bit_sliced_top_k": OP1,
    "op2_license_scan": licenses.oracle(),
    "op3_line_dedup": OP3,
    "op6_ngram_jaccard": OP6,
    "op11_importance_resampling": OP11,
    "op12_centroid_clustering": _op12_sql(),
    "op13_repeated_strings": OP13,
}
