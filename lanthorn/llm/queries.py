"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, centroids, chat, collocations, ctw, decontam, dedup, languages, license_scan, quality, token_counts, toxicity
from ._licenses import SHORT


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    return license_scan.license_matches(_table(spark, sf_dir, "documents"))


def op1_short_notices(spark, sf_dir):
    """Notices of fewer than five words, which op1_license_scan's SQL has no shingle for."""
    return license_scan.license_matches(_table(spark, sf_dir, "documents"), license_scan.notices(spark, SHORT))


def op2_bpe(spark, sf_dir):
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), vocabulary_path())


def op3_nearest(spark, sf_dir):
    found = ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_ctw(spark, sf_dir):
    return ctw.text_scores(_table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op6_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op7_near_dedup(spark, sf_dir):
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"), p=dedup.MinHash(shingle=3, percent=85))


def op8_decontamination(spark, sf_dir):
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_chat(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.chat_digests(rows.unionByName(more), vocabulary_path()).drop("n_tokens")


def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary_path())


def op11_collocations(spark, sf_dir):
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_centroids(spark, sf_dir):
    return centroids.clusters(_table(spark, sf_dir, "embeddings"))


def op13_languages(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return languages.predictions(docs, languages.learn(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op1_short_notices, op2_bpe, op3_nearest, op4_ctw, op5_quality, op6_toxicity, op7_near_dedup, op8_decontamination, op9_chat, op10_token_counts, op11_collocations, op12_centroids, op13_languages)
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    bare = "regexp_replace({}, '[!-/:-@\\[-`{{-~]+', '', 'g')"
    plain = lambda c: _WORDS.format(_LOWER.format(bare.format(c)))
    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in license_scan.NOTICES.items())
    cut = "select distinct {0}, array_to_string(list_slice(w, i, i + 4), ' ') as s from (select {0}, w, unnest(range(1, len(w) - 3)) as i from {1})"
    return f"""
with t as (select template_id, {plain('body')} as w from (values {values}) as v(template_id, body)),
ts as ({cut.format('template_id', 't')}),
d as (select doc_id, {plain("coalesce(text, '')")} as w from documents),
ds as ({cut.format('doc_id', 'd')}),
n as (select template_id, count(*) as template_shingles from ts group by 1),
m as (select doc_id, template_id, count(*) as matched_shingles from ds join ts using (s) group by 1, 2)
select doc_id, template_id, template_shingles, matched_shingles, matched_shingles / template_shingles as containment
from m join n using (template_id) where matched_shingles >= 0.8 * template_shingles"""


def _short_sql() -> str:
    bare = "regexp_replace({}, '[!-/:-@\\[-`{{-~]+', '', 'g')"
    plain = lambda c: f"' ' || array_to_string({_WORDS.format(_LOWER.format(bare.format(c)))}, ' ') || ' '"
    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in SHORT.items())
    return f"""
with t as (select template_id, {plain('body')} as w from (values {values}) as v(template_id, body)),
d as (select doc_id, {plain("coalesce(text, '')")} as x from documents)
select distinct doc_id, template_id, 1::bigint as template_shingles, 1::bigint as matched_shingles, 1.0::double as containment
from d join t on contains(x, w)"""


def _dedup_sql() -> str:
    return f"""
with recursive d as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from documents),
s0 as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')))) end as s from d),
s as materialized (select doc_id, s, len(s) as n, md5(array_to_string(s, chr(10))) as k from s0),
h as materialized (select k, min(doc_id) as rep, any_value(s) as s, any_value(n) as n from s where n > 0 group by k),
e as materialized (select rep, n, unnest(s) as g from h),
p as (select a.rep as u, b.rep as v, a.n as na, b.n as nb, count(*) as c from e a join e b on a.g = b.g and a.rep < b.rep group by 1, 2, 3, 4),
l as materialized (select u, v from p where 100 * c >= 85 * (na + nb - c)),
both_ways as materialized (select u, v from l union all select v, u from l),
r(x, y) as (select rep, rep from h union select r.x, b.v from r join both_ways b on r.y = b.u),
c as (select x, min(y) as component from r group by 1)
select s.doc_id, s.n as n_shingles, coalesce(c.component, s.doc_id) as component_id, s.doc_id = coalesce(c.component, s.doc_id) as kept
from s left join h on s.k = h.k and s.n > 0 left join c on c.x = h.rep"""


def _chat_sql() -> str:
    escaped = "replace({0}, '␛', '␛␛')"
    for c in chat.CONTROLS:
        escaped = f"replace({escaped}, {_quoted(c)}, {_quoted(c[0] + chat.MARK + c[1:])})"
    around = sum(map(len, (chat.BEGIN, chat.HEAD, chat.BODY, chat.END)))
    said = _quoted("</s>[INST] ok [/INST]")
    return f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said}))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length({escaped.format('role')}) + length({escaped.format('text')}) + {around})::bigint as formatted_chars
from c group by conv_id"""


def _collocation_sql(p: collocations.Phrases = collocations.Phrases()) -> str:
    lower = _LOWER.format("coalesce(text, '')")
    grams = " union all ".join(f"select lang, {n} as size, array_to_string(list_slice(w, i, i + {n - 1}), ' ') as phrase from (select lang, w, unnest(range(1, len(w) - {n - 2})) as i from w)" for n in range(1, p.longest + 1))
    return f"""
with d as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as materialized (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from d),
t as (select lang, sum(len(w))::bigint as n from w group by 1),
f as materialized (select lang, size, phrase, count(*) as a from ({grams}) group by all having count(*) >= {p.least}),
c as materialized (select lang, size, phrase, a, string_split(phrase, ' ') as w from f where size >= 2),
k as (select *, unnest(range(1, size)) as k from c),
s as (select k.lang, k.phrase, k.a, k.k, l.a as l, r.a as r, (1000000::hugeint * k.a * k.a) // (l.a::hugeint * r.a) as score
  from k join f l on l.lang = k.lang and l.phrase = array_to_string(list_slice(k.w, 1, k.k), ' ')
  join f r on r.lang = k.lang and r.phrase = array_to_string(list_slice(k.w, k.k + 1, k.size), ' ')),
b as (select lang, phrase, a, l, r, score from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
x as (select b.* from b where not exists (select 1 from c where c.lang = b.lang and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') and c.phrase <> b.phrase and 100 * c.a >= {p.covered} * b.a)),
o as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score from x)
select o.lang, rank, phrase, a, l, r, n, score::bigint as score from o join t on t.lang = o.lang where rank <= {p.top}"""


def _centroid_sql(p: centroids.Clustering = centroids.Clustering()) -> str:
    gap = lambda v, c: f"list_sum(list_transform(range(1, {p.dimension + 1}), lambda i: ({v}[i] - {c}[i]) * ({v}[i] - {c}[i])))"
    put = lambda r: f"a{r} as materialized (select row, arg_min(k, (d, k)) as k, min(d) as d from (select v.row, c.k, {gap('v.x', 'c.x')} as d from v, c{r} c) group by row)"
    # Floors: what the remainder leaves is divided without one.
    moved = "(s - ((s % n) + n) % n) // n"
    move = lambda r: (
        f"m{r} as materialized (select k, list({moved} order by i) as x from (select k, i, sum(x[i])::hugeint as s, count(*) as n from (select a.k, v.x, unnest(range(1, {p.dimension + 1})) as i from a{r - 1} a join v using (row)) group by k, i) group by k), "
        f"c{r} as materialized (select k, coalesce(m.x, c.x) as x from c{r - 1} c left join m{r} m using (k))"
    )
    steps = ", ".join(f"{put(r)}, {move(r + 1)}" for r in range(p.rounds))
    return f"""
with e as (select vec_id, embedding::double[] as y from embeddings),
v as materialized (select row_number() over () as row, vec_id, list_transform(y, lambda t: floor({p.scale} * t)::bigint) as x from e
  where len(y) = {p.dimension} and len(list_filter(y, lambda t: t is not null and isfinite(t))) = {p.dimension}),
c0 as materialized (select row_number() over (order by h, x) - 1 as k, list_transform(x, lambda t: t::hugeint) as x from (select sha256('{p.salt}' || vec_id) as h, x from v where vec_id is not null order by h, x limit {p.k})),
{steps}, {put(p.rounds)},
i as (select k, sum(d)::bigint as own from a{p.rounds} group by k)
select v.vec_id, a.k::int as cluster, a.d::bigint as distance, i.own as cluster_inertia, (select sum(d)::bigint from a{p.rounds}) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from v join a{p.rounds} a using (row) join i on i.k = a.k join c{p.rounds} c on c.k = a.k"""


ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": _license_sql(), "op1_short_notices": _short_sql(), "op7_near_dedup": _dedup_sql(), "op9_chat": _chat_sql(), "op11_collocations": _collocation_sql(), "op12_centroids": _centroid_sql(),
}
