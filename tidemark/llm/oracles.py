r"""DuckDB SQL for the queries whose results SQL can express.

The SQL says what is wanted in the plainest way (every pair that shares a shingle, every
window of every text), with no thought for cost.
"""

from __future__ import annotations

from tidemark.llm import line_dedup, near_dup, quality_rules, secrets

_WS = r"[ \t\n\x0B\f\r]"
_WORDS = rf"list_filter(regexp_split_to_array({{0}}, '{_WS}+'), lambda x: x <> '')"
_LINE = rf"trim(regexp_replace(lower(l), '{_WS}{{{{2,}}}}|[\t\n\x0B\f\r]', ' ', 'g'))".replace("{{", "{").replace("}}", "}")

QUALITY = rf"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t, text from documents),
w as (select rid, t, {_WORDS.format('t')} as ws from d),
g as (select rid, i, array_to_string(ws[i:i + {quality_rules.WINDOW - 1}], ' ') as win from (select rid, ws, unnest(range(1, len(ws) - {quality_rules.WINDOW - 2})) as i from w)),
rep as (select rid, i from g qualify count(*) over (partition by rid, win) > 1),
cov as (select rid, count(distinct i + k) as n from rep, range({quality_rules.WINDOW}) r(k) group by rid),
ln as (select rid, count(*) - count(distinct l) as n from (select rid, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '[^ \t\n\x0B\f\r]') group by rid),
nl as (select rid, source, text, {_LINE} as l from (select rid, source, text, unnest(string_split(text, chr(10))) as l from d)),
nw as (select *, len(string_split(l, ' ')) as n from nl where l <> ''),
freq as (select source, l from nw group by source, l having count(distinct text) > {quality_rules.MAX_TEXTS}),
gone as (select rid, sum(n) as n from nw join freq on nw.l = freq.l and nw.source is not distinct from freq.source group by rid),
base as (select d.rid, doc_id, len(ws) as n_words, len(array_to_string(ws, '')) as word_chars, len(w.t) - len(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(ln.n, 0) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words, least(coalesce(gone.n, 0), len(ws)) as removed_words
    from d join w using (rid) left join ln using (rid) left join cov using (rid) left join gone using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words as base_failed,
    cast(removed_words as bigint) as removed_words,
    not (n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words) and 100 * (n_words - removed_words) >= {quality_rules.MIN_LEFT_PERCENT} * n_words as kept
from base"""


def _shingled(source: str, key: str, words: str, size: int, whole: bool) -> str:
    """CTE `s` of the distinct shingles (key, x) of `words`; with `whole`, a short sequence is one shingle."""
    short = f"union select {key}, array_to_string({words}, chr(1)) from {source} where len({words}) between 1 and {size - 1}" if whole else ""
    return f"s as (select distinct {key}, array_to_string({words}[i:i + {size - 1}], chr(1)) as x from (select {key}, {words}, unnest(range(1, len({words}) - {size - 2})) as i from {source}) {short})"


LINES = rf"""
with raw as (select doc_id, l, pos from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)),
ln as (select doc_id, pos, l from (select doc_id, pos, {_LINE} as l from raw) where len(string_split(l, ' ')) >= {line_dedup.MIN_WORDS} and l <> ''),
first as (select l, min({{'d': doc_id, 'p': pos}}) as f from ln group by l),
u as (select f, string_split(l, ' ') as ws from first),
{_shingled('u', 'f', 'ws', line_dedup.SHINGLE, False)},
n as (select f, count(*) as n from s group by f),
p as (select a.f as a, b.f as b, count(*) as c from s a join s b on a.x = b.x and a.f < b.f group by all),
sim as (select distinct b as f from p join n x on x.f = p.a join n y on y.f = p.b where 100 * c >= {line_dedup.PERCENT} * (x.n + y.n - c)),
gone as (select doc_id, pos, {{'d': doc_id, 'p': pos}} <> first.f as exact from ln join first using (l) left join sim on sim.f = first.f where sim.f is not null or {{'d': doc_id, 'p': pos}} <> first.f),
per as (select doc_id, count(*) as n, count(*) filter (exact) as e, list(cast(pos as integer) order by pos) as removed from gone group by doc_id)
select doc_id, coalesce(len(string_split(text, chr(10))), 0) as n_lines, coalesce(n, 0) as n_removed, coalesce(e, 0) as n_exact, coalesce(n - e, 0) as n_similar, coalesce(removed, cast([] as integer[])) as removed
from documents left join per using (doc_id)"""

NEAR = rf"""
with recursive d as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
{_shingled('d', 'doc_id', 'ws', near_dup.SHINGLE, True)},
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {near_dup.PERCENT} * (x.n + y.n - c)),
r(doc_id, m) as (select doc_id, doc_id from d union select e.b, r.m from r join e on e.a = r.doc_id where r.m < e.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.m) as component_id, min(r.m) = d.doc_id as kept from d left join n using (doc_id) join r on r.doc_id = d.doc_id group by d.doc_id, n.n"""


def _secret_sql() -> str:
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        group = f"len(regexp_extract(x, '{pattern}', {rule.group}))" if rule.group else "len(x)"
        parts.append(
            f"""select rid, '{rule.kind}' as kind, {rank} as rank, start, start + len(x) as stop from (
            select rid, k, x, coalesce(sum(len(x)) over (partition by rid order by k rows between unbounded preceding and 1 preceding), 0) as start from (
            select rid, unnest(string_split(m, chr(57344))) as x, generate_subscripts(string_split(m, chr(57344)), 1) as k from (
            select rid, regexp_replace(replace(t, chr(57344), chr(57345)), '{pattern}', chr(57344) || '\\0' || chr(57344), 'g') as m from d)))
            where k % 2 = 0 and {group} >= {rule.least}"""
        )
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    span = "kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint)"
    return f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
    s as ({' union all '.join(parts)}),
    a as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
        string_agg({span}, ',' order by start, rank) filter (kind in ({base})) as b, string_agg({span}, ',' order by start, rank) as spans from s group by rid)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (rid)"""


SECRETS = _secret_sql().replace("\\\\0", "\\0")
