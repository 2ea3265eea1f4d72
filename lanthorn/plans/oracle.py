"""The queries in DuckDB's SQL, written from what they mean, not from their Spark form."""

from __future__ import annotations

from ..functions.categories import sql_values
from ..functions.classes import CLASSES, ROADMAP_ROW
from ..functions.vocab import INFRASTRUCTURE, NOT_PROJECTS
from ..operators.improve import DOMAINS, INTENTS
from ..operators.rules import RULES
from .cases import CASES_FROM, expected_sql
from .corpora import PAPERS_FROM, CORPUS_SQL, NOTES_SQL, PAPERS_SQL
from .queries import CORE


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str, ignore_case: bool = False) -> str:
    return q(("(?i)" if ignore_case else "") + pattern)


def luhn(d: str) -> str:
    """Whether a string of 12 digits or more passes the Luhn check."""
    digit = f"cast(substr(reverse({d}), i::bigint, 1) as integer)"
    doubled = f"case when i % 2 = 0 then (case when {digit} > 4 then {digit} * 2 - 9 else {digit} * 2 end) else {digit} end"
    return f"(length({d}) >= 12 and list_sum(list_transform(range(1, length({d}) + 1), lambda i: {doubled})) % 10 = 0)"


BARE = "regexp_replace(value, '[^0-9]', '', 'g')"
_BEFORE = "case when pos > 0 then substr(text, pos, 1) else ' ' end"
_AFTER = "substr(text, pos + length(value) + 1, 1)"
# Checks of values, over the columns value, text and pos (where the match starts).
CHECKS = {
    "card": f"length({BARE}) between 13 and 19 and {luhn(BARE)}",
    "iban": "length(regexp_replace(value, '\\s', '', 'g')) >= 15",
    "id13": luhn("value"),
    "phone": f"""length({BARE}) between 9 and 15 and not regexp_matches(value, '\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}') and not regexp_matches(trim(value), '^\\d+(?:\\.\\d+){{2,}}$')
      and not regexp_matches({_BEFORE}, '[A-Za-z0-9._/@:$£€¥-]') and not regexp_matches(coalesce(nullif({_AFTER}, ''), ' '), '[A-Za-z/@:-]')
      and not regexp_matches(substr(text, pos + length(value) + 1, 2), '^\\.\\d') and (value like '+%' or regexp_matches(value, '[\\s().-]') or length({BARE}) >= 10)""",
    "ipv4": """list_bool_and(list_transform(string_split(value, '.'), lambda o: cast(o as integer) <= 255))
      and not regexp_matches(substr(text, greatest(pos - 13, 1), least(pos, 14)), '(?i)\\b(?:version|v|rel|release|build|patch)\\.?\\s*$')""",
    "host": f"list_has_any(list_transform(regexp_split_to_array(value, '[-_.]'), lambda p: upper(regexp_replace(p, '\\d+$', ''))), [{', '.join(map(q, sorted(INFRASTRUCTURE)))}])",
    "licence_key": "regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Z]')",
    "project": f"lower(value) not in ({', '.join(map(q, sorted(NOT_PROJECTS)))})",
}


def rule_sql(name: str, source: str = CORPUS_SQL) -> str:
    """``doc_id, text, value, start, "end", pos`` of a rule's matches."""
    layer, rule = RULES[name]
    p = re2(rule.pattern, rule.ignore_case)
    group = lambda k: f"regexp_extract_all(text, {p}, {k})"
    value = "m" if not rule.groups else "coalesce(" + ", ".join(f"nullif(g{k}[i], '')" for k in rule.groups) + ", m)"
    groups = "".join(f", {group(k)} as g{k}" for k in rule.groups)
    names = "".join(f", g{k}" for k in rule.groups)
    start = "pos + length(m) - (instr(reverse(m), reverse(v)) - 1) - length(v)" if rule.groups else "pos"
    shown = "coalesce(nullif(regexp_replace(v, '[.,;:!?]+$', ''), ''), v)" if rule.trim else "v"
    return f"""select doc_id, text, value, start, start + length(value) as "end", pos from (
  select doc_id, text, pos, {shown} as value, {start} as start from (
    select *, {value} as v from (
      select doc_id, text{names}, i, ms[i] as m, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::bigint as pos from (
        select *, unnest(range(1, len(ms) + 1)) as i from (
          select doc_id, text, {group(0)} as ms, regexp_split_to_array(text, {p}) as ps{groups} from ({source}) where regexp_matches(text, {p}))))))
where {CHECKS.get(name, 'true')}"""


def _rule_oracle(name: str) -> str:
    return f'select doc_id, value, start::bigint as start, "end"::bigint as "end" from ({rule_sql(name)})'


def _candidates() -> str:
    parts = []
    for k, name in enumerate(CORE):
        layer, rule = RULES[name]
        parts.append(f"""select doc_id, text, value, start, "end", {q(rule.category)} as category, {q(layer)} as layer, {q(rule.name)} as rule, {rule.base} as base, {k} as rule_no from ({rule_sql(name)})""")
    return " union all ".join(parts)


def _with_findings(select: str, more: str = "") -> str:
    """CTEs down to ``f``: the findings, with category attributes and their place."""
    return f"""with recursive corpus as materialized ({CORPUS_SQL}), cat as (select * from (values {sql_values()}) as v(category, label, "group", severity, priority, token, prefix)),
cand as materialized ({_candidates()}),
ranked as materialized (select c.*, row_number() over (partition by doc_id order by priority desc, "end" - start desc, base desc, rule_no, start) as rn from cand c join cat using (category) where not regexp_matches(value, '[\\r\\n]') and base >= 0.55),
kept(doc_id, n, spans) as (select distinct doc_id, 0::bigint, []::struct(s bigint, e bigint, r bigint)[] from ranked
  union all select k.doc_id, k.n + 1, case when len(list_filter(k.spans, lambda x: x.s < r."end" and r.start < x.e)) > 0 then k.spans
    else list_append(k.spans, {{'s': r.start::bigint, 'e': r."end"::bigint, 'r': r.rn}}) end from kept k join ranked r on r.doc_id = k.doc_id and r.rn = k.n + 1),
chosen as (select doc_id, unnest(list_transform(arg_max(spans, n), lambda x: x.r)) as rn from kept group by doc_id),
f as materialized (select r.doc_id, r.text, r.category, r.value, r.start, r."end", r.base as confidence, case when r.base >= 0.8 then 'high' else 'medium' end as tier, r.layer, r.rule, cat.label, cat."group", cat.severity, cat.token, cat.prefix,
  row_number() over (partition by r.doc_id order by r.start) - 1 as i from chosen join ranked r using (doc_id, rn) join cat using (category)){more}
{select}"""


_RISK = """, r as (select corpus.doc_id, coalesce(cast(floor(100 * (1 - exp(-sum(case severity when 'critical' then 45 when 'high' then 18 when 'medium' then 8 else 2 end * confidence) / 60)) + 0.5) as integer), 0) as score,
  coalesce(bool_or(severity = 'critical'), false) as critical, count(*) filter ("group" = 'personal') as personal, count(*) filter ("group" = 'internal') as internal, count(*) filter ("group" = 'confidential') as confidential,
  count(*) filter ("group" = 'secret') as secret, count(category) as total from corpus left join f using (doc_id) group by corpus.doc_id),
risk as (select *, case when score >= 60 or critical then 'high' when score >= 25 then 'moderate' when score > 0 then 'low' else 'safe' end as level from r)"""
_POLICY = """, d as (select *, case when "group" = 'secret' and tier = 'high' then 2 else 1 end as rank, case severity when 'critical' then 3 when 'high' then 2 when 'medium' then 1 else 0 end as grave from f),
o as (select *, row_number() over (partition by doc_id order by grave desc, confidence desc, i) as place from d),
l as (select doc_id, lower(label) as label, count(*) as n, min(place) as place from o group by 1, 2),
top as (select *, row_number() over (partition by doc_id order by n desc, place) as k from l),
s as (select doc_id, string_agg(n || ' ' || label || case when n = 1 then '' else 's' end, ', ' order by k) as summary from top where k <= 4 group by 1),
p as (select doc_id, max(rank) as rank, count(*) as n from d group by 1)"""
_OUT = """, w as (select *, token as repl, coalesce(sum(length(token) - ("end" - start)) over (partition by doc_id order by start rows between unbounded preceding and 1 preceding), 0) as moved from f),
parts as (select doc_id, i, substr(text, (coalesce(lag("end") over (partition by doc_id order by start), 0) + 1)::bigint, (start - coalesce(lag("end") over (partition by doc_id order by start), 0))::bigint) || repl as part, "end", text from w),
clean as (select doc_id, string_agg(part, '' order by i) || substr(any_value(text), max("end")::bigint + 1) as text from parts group by doc_id)"""
_PSEUDO = """, keyed as (select *, category || '::' || regexp_replace(lower(value), '\\s+', ' ', 'g') as key from f),
seen as (select doc_id, category, key, min(start) as first from keyed group by 1, 2, 3),
numbered as (select *, row_number() over (partition by doc_id, category order by first) as n from seen)"""


def _held(terms: tuple[str, ...]) -> str:
    return f"len(list_filter([{', '.join(map(q, terms))}], lambda t: contains(lower, t)))"


def _class_sql(read: str) -> str:
    """Classes by what is read of a text."""
    rows = []
    for k, c in enumerate(CLASSES):
        pattern = lambda p: f"regexp_matches(sample, {re2(p[1:]) if p.startswith('=') else re2(p, True)})::int"
        raw = " + ".join(f"0.5::double * {pattern(p)}" for p in c.patterns) + f" + 0.3::double * least({_held(c.strong)}, 3) + 0.08::double * least({_held(c.terms)}, 6)"
        if c.against:
            raw += f" - 0.35::double * {_held(c.against)}"
        rows.append(f"select doc_id, {q(c.dimension)} as dimension, {q(c.id)} as id, {k} as k, {raw} as raw from t")
    return f"""with t as materialized (select doc_id, {read} as sample, lower({read}) as lower from ({PAPERS_SQL})), c as ({' union all '.join(rows)}),
x as (select *, case when raw <= 0 then 0.0::double else 1 - exp(-raw / 0.8) end as confidence from c) select doc_id, dimension, id, round(confidence, 6) as confidence from x where confidence >= 0.45"""


def _accuracy_sql() -> str:
    known = ", ".join(f"({k}, {q(c.dimension)}, {q(c.id)})" for k, c in enumerate(CLASSES))
    return f"""with c as ({_class_sql("substr(text, 1, 20000)")}), v as (select * from (values {known}) as v(k, dimension, id)),
p as (select c_custkey + {PAPERS_FROM} as doc_id, v.dimension, v.id as truth from customer join v on v.k = c_custkey % {len(CLASSES)}),
r as (select p.*, c.id, row_number() over (partition by p.doc_id order by c.confidence desc, v.k) as place from p left join c on c.doc_id = p.doc_id and c.dimension = p.dimension left join v on v.id = c.id and v.dimension = c.dimension),
d as (select doc_id, dimension, max((place = 1 and id = truth)::int) as first, max((place <= 3 and id = truth)::int) as near from r group by 1, 2)
select dimension, count(*) as n, round(avg(coalesce(first, 0)), 6) as exact, round(avg(coalesce(near, 0)), 6) as within from d group by 1"""


def _strongest(table: dict[str, tuple[str, ...]]) -> str:
    rows = ", ".join(f"{{'n': {_held(t)}, 'i': {-i}, 'k': {q(k)}}}" for i, (k, t) in enumerate(table.items()))
    return f"list_max([{rows}])"


def _intent_sql() -> str:
    return f"""with t as (select conv_id, turn, text, lower(text) as lower from conversations where role = 'user'), x as (select *, {_strongest(INTENTS)} as a, {_strongest(DOMAINS)} as b from t)
select conv_id, turn, case when a.n > 0 then a.k else 'general' end as intent, case when b.n > 0 then b.k end as domain,
  len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) > 2 or length(text) > 220 as has_context from x"""


_TITLE = "^(?:[A-Z][\\w''&/-]*)(?:\\s+(?:[A-Z][\\w''&/-]*|of|and|for|the|to|in))*$"
_HEADINGS = f"""with l as (select doc_id, unnest(range(1, least(len(string_split(text, chr(10))), 400) + 1)) as n, string_split(text, chr(10)) as ls from ({PAPERS_SQL})),
t as (select doc_id, n, ls[n] as line, trim(regexp_replace(trim(ls[n], E' \\t\\r\\n'), '^-{{2,}}\\s*|\\s*-{{2,}}$', '', 'g'), E' \\t\\r\\n') as t from l),
h as (select * from t where t <> '' and length(t) <= 80 and not regexp_matches(t, '[.!?,;]$') and (regexp_matches(line, '^#{{1,6}}\\s') or (t = upper(t) and regexp_matches(t, '[A-Z]{{3}}')) or regexp_matches(t, '{_TITLE}')))
select doc_id, row_number() over (partition by doc_id order by n) - 1 as place, regexp_replace(t, '^#{{1,6}}\\s*', '') as heading from h"""

_TIER = "case when confidence >= 0.8 then 'high' when confidence >= 0.55 then 'medium' else 'low' end"
_CASE_RISK = f"""with f as ({expected_sql('confidence >= 0.55')}),
cat as (select * from (values {sql_values()}) as v(category, label, "group", severity, priority, token, prefix)),
w as (select doc_id, category, confidence, case severity when 'critical' then 45 when 'high' then 18 when 'medium' then 8 else 2 end as weight from f join cat using (category)),
r as (select c_custkey + {CASES_FROM} as doc_id, count(category) as n_findings, coalesce(cast(floor(100 * (1 - exp(-sum(weight * confidence) / 60)) + 0.5) as integer), 0) as score from customer left join w on doc_id = c_custkey + {CASES_FROM} group by 1)
select doc_id, score, case when score >= 60 then 'high' when score >= 25 then 'moderate' when score > 0 then 'low' else 'safe' end as level, case when n_findings > 0 then 'warn' else 'allow' end as decision, n_findings from r"""

ORACLE_SQL: dict[str, str] = {
    "entity_cases": expected_sql(),
    "case_findings": f"""select doc_id, 'findings' as kind, category, value, {_TIER} as tier, confidence from ({expected_sql('confidence >= 0.55')})
union all select doc_id, 'recoverable', category, value, {_TIER}, confidence from ({expected_sql('unresolved and confidence >= 0.15 and confidence < 0.55')})
where not (category = 'PERSON' and value in ('Baker Street', 'Pty', 'Ltd'))""",
    "case_risk": _CASE_RISK,
    "banner_counts": _with_findings("select corpus.doc_id, coalesce(string_agg(f.label, ', ' order by i) filter (i < 12), '') as shown, greatest(count(f.label) - 12, 0)::integer as more from corpus left join f using (doc_id) group by corpus.doc_id"),
    "latency_summary": "select event_type, round(median(value), 6) as median, min(value) as fastest, round(avg(value), 6) as mean from events group by 1",
    "label_accuracy": """with c as (select source, lang, count(*) as n from documents group by 1, 2), u as (select source, lang as usual from (select *, row_number() over (partition by source order by n desc, lang desc) as k from c) where k = 1)
select source, count(*) as n, round(avg((lang = usual)::integer), 6) as exact, 1.0::double as within from documents join u using (source) group by 1""",
} | {f"rule_{name}": _rule_oracle(name) for name in RULES} | {
    "candidate_counts": f"select layer, rule, category, count(*) as n, count(distinct doc_id) as n_docs from ({_candidates()}) group by 1, 2, 3",
    "tier_assignment": f"select category, case when base >= 0.8 then 'high' when base >= 0.55 then 'medium' else 'low' end as tier, count(*) as n, round(avg(base::double), 6) as mean_confidence from ({_candidates()}) group by 1, 2",
    "overlap_resolved": _with_findings("select doc_id, 'f' || i as id, category, value, start::bigint as start, \"end\"::bigint as \"end\", round(confidence::double, 6) as confidence from f"),
    "risk_per_document": _with_findings("select doc_id, score, level, personal, internal, confidential, secret, total from risk", _RISK),
    "risk_level_histogram": _with_findings("select level, count(*) as n, max(score) as max_score from risk group by 1", _RISK),
    "findings_by_value": _with_findings("select doc_id, category, lower(value) as value, count(*) as mentions, min(start)::bigint as first_start, round(max(confidence)::double, 6) as confidence from f group by 1, 2, 3"),
    "findings_by_group": _with_findings("select doc_id, \"group\", count(*) as n, round(max(confidence)::double, 6) as confidence from f group by 1, 2"),
    "category_join": _with_findings('select "group", severity, label, count(*) as n from f group by 1, 2, 3'),
    "policy_decision": _with_findings(
        """select corpus.doc_id, case coalesce(rank, 0) when 2 then 'block' when 1 then 'warn' else 'allow' end as decision,
  case coalesce(rank, 0) when 2 then 'Sensitive information detected' when 1 then 'Check this before sending' else 'Nothing sensitive found' end as headline, coalesce(p.n, 0) as n_drivers, coalesce(summary, '') as summary
from corpus left join p using (doc_id) left join s using (doc_id)""", _POLICY),
    "strongest_mention": _with_findings("select doc_id, lower(value) as value, category, round(confidence::double, 6) as confidence, start::bigint as start from (select *, row_number() over (partition by doc_id, lower(value) order by confidence desc, start) as n from f) where n = 1"),
    "redacted_text": _with_findings("select corpus.doc_id, coalesce(clean.text, corpus.text) as text from corpus left join clean using (doc_id)", _OUT),
    "output_offsets": _with_findings("select doc_id, 'f' || i as id, repl as replacement, (start + moved)::bigint as out_start, (start + moved + length(repl))::bigint as out_end from w", _OUT),
    "pseudonym_map": _with_findings("select distinct k.doc_id, k.category, lower(k.value) as value, case when k.\"group\" = 'secret' then k.token else k.prefix || '_' || lpad(n.n::varchar, greatest(3, length(n.n::varchar))::integer, '0') end as replacement from keyed k join numbered n using (doc_id, category, key)", _PSEUDO),
    "scan_delta": _with_findings("select doc_id, count(*) filter (category = 'PHONE') as withdrawn, count(*) filter (category = 'EMAIL') as added from f where category in ('PHONE', 'EMAIL') group by 1"),
    "highlights": _with_findings("""select doc_id, row_number() over (partition by doc_id order by pos, k) - 1 as part, part as text, finding from pieces where part <> ''""", """, g as (select *, coalesce(lag("end") over (partition by doc_id order by start), 0) as before from f),
pieces as (select doc_id, before as pos, 0 as k, substr(text, before::bigint + 1, (start - before)::bigint) as part, null as finding from g union all select doc_id, start, 1, substr(text, start::bigint + 1, ("end" - start)::bigint), 'f' || i from g
  union all select c.doc_id, coalesce(max(f."end"), 0), 2, substr(any_value(c.text), coalesce(max(f."end"), 0)::bigint + 1), null from corpus c left join f using (doc_id) group by c.doc_id)"""),
    "quality_confusion": _with_findings("""select a as true_positives, b as false_positives, c as false_negatives, a / greatest(a + b, 1) as precision, a / greatest(a + c, 1) as recall, 2 * a / greatest(2 * a + b + c, 1) as f1
from (select count(*) filter (toxic = 1 and score > 0) as a, count(*) filter (toxic <> 1 and score > 0) as b, count(*) filter (toxic = 1 and score <= 0) as c from labels join risk using (doc_id))""", _RISK),
    "url_signals": """with p as (select page_id, url, string_split(url, '/') as s from pages), x as (select page_id, contains(url, '?') or contains(url, '#') or len(list_filter(s[4:], lambda v: length(v) >= 20 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]'))) > 0 as carries from p)
select page_id, case when carries then 'link-carries-data' else 'public-link' end as signal, case when carries then 0.05::double else -0.45::double end as weight from x""",
    "class_confidence": _class_sql("text"),
    "class_accuracy": _accuracy_sql(),
    "heading_lines": _HEADINGS,
    "roadmap_rows": f"select * from (select doc_id, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {re2(ROADMAP_ROW, True)}))) as n from ({CORPUS_SQL} union all {PAPERS_SQL})) where n > 0",
    "prompt_intent": _intent_sql(),
    "latency_percentiles": "with n as (select event_type, list_sort(list(value)) as v, count(value) as n from events group by 1) select event_type, "
    + ", ".join(f"v[1 + least(n - 1, floor({p}::double / 100 * n)::bigint)] as p{p}" for p in (50, 95, 99)) + " from n",
    "latency_state": """
with e as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as back from events),
c as (select event_type as key, count(*) as checked, count(*) filter (value < 100) as allow, count(*) filter (value >= 100 and value < 200) as warn, count(*) filter (value >= 200) as block from e group by 1),
v as (select event_type as key, list_sort(list(value)) as v, count(*) as n from e where back <= 200 group by 1)
select key, checked, allow, warn, block, block as escalations, 0::bigint as sanitized, n::int as samples, v[least(n, floor(0.5 * n)::int + 1)] as p50, v[least(n, floor(0.95 * n)::int + 1)] as p95, v[least(n, floor(0.99 * n)::int + 1)] as p99
from c join v using (key)""",
    "cleared_turns": """
with t as (select conv_id, turn, trim(coalesce(text, ''), ' ') as said, not regexp_matches(coalesce(text, ''), '[0-9]') as fine from conversations where role = 'user')
select conv_id, turn, case when length(said) < 12 then 'short'
  when exists (select 1 from t b where b.conv_id = t.conv_id and b.turn < t.turn and b.said = t.said and b.fine) then 'cleared before'
  when fine then 'allowed' else 'held' end as outcome from t""",
    "rolling_latency": "select event_id, event_type, round(avg(value) over w + 1e-7, 4) as rolling_mean, count(value) over w as rolling_n from events window w as (partition by event_type order by event_id rows between 199 preceding and current row)",
    "newest_events": "select event_id, event_type from (select *, row_number() over (partition by event_type order by event_id desc) as n from events) where n <= 200",
    "table_rows_as_text": "select c_custkey as doc_id, coalesce(c_name, '') || ' | ' || coalesce(c_mktsegment, '') || ' | ' || coalesce(c_acctbal::varchar, '') as text from customer",
    "token_islands": f"""with d as ({NOTES_SQL}), r as (select doc_id, text, regexp_extract_all(text, '\\p{{Lu}}[\\p{{L}}''’-]*') as ms, regexp_split_to_array(text, '\\p{{Lu}}[\\p{{L}}''’-]*') as ps from d),
e as (select doc_id, text, ms, ps, unnest(range(1, len(ms) + 1)) as i from r),
t as (select doc_id, text, i, ms[i] as v, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as s from e),
k as (select *, case when substr(text, (lag(s + length(v)) over w + 1)::bigint, greatest((s - lag(s + length(v)) over w)::bigint, 0)) = ' ' then 0 else 1 end as new from t where length(v) > 1 window w as (partition by doc_id order by i)),
g as (select doc_id, s, sum(new) over (partition by doc_id order by i) as island from k) select doc_id, island::bigint as island, count(*) as n, min(s)::bigint as start from g group by 1, 2""",
    "feedback_records": _with_findings("select 'a' || corpus.doc_id as id, length(any_value(corpus.text)) as chars, count(*) filter (\"group\" = 'personal') as personal, count(*) filter (\"group\" = 'secret') as secret, 'general' as system_state, 'unreviewed' as user_decision from corpus left join f using (doc_id) group by corpus.doc_id"),
}
