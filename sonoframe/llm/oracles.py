"""DuckDB SQL for the corpus operators whose results SQL can express. Column names are those of the queries."""

from __future__ import annotations

from sonoframe.llm.quality import LONE, RULES
from sonoframe.llm.url_filter import FOLDS, ORDER, SMOOTH
from sonoframe.llm.url_filter import RULES as URL_RULES

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

# Hex digits stand for bytes, two to each. Pieces of 1000 bytes keep substr short.
OP3 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
c as (select doc_id, base, n, substr(x, 2 * base + 1, 2398) as piece from (select doc_id, x, n, unnest(range(0, n - 199, 1000)) as base from d where n >= 200)),
p as (select doc_id, base + j as i, md5(substr(piece, 2 * j + 1, 400)) as h from (select doc_id, base, piece, unnest(range(0, least(1000, n - 199 - base))) as j from c)),
r as (select doc_id, i from p join (select h from p group by h having count(*) > 1) using (h)),
b as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as new from r),
g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from b),
s as (select doc_id, run, min(i) as a, max(i) + 200 as e from g group by all),
k as (select doc_id, a, coalesce(lead(a) over (partition by doc_id order by a), -1) as nxt, e, row_number() over (partition by doc_id order by a) as o from s),
t as (select doc_id, sum(e - a) as n_removed, count(*) as n_spans, string_agg(case when o = 1 then substr(x, 1, 2 * a) else '' end || case when nxt >= 0 then substr(x, 2 * e + 1, 2 * (nxt - e)) else substr(x, 2 * e + 1) end, '' order by o) as kept from k join d using (doc_id) group by doc_id)
select d.doc_id, d.n as n_bytes, cast(coalesce(t.n_removed, 0) as bigint) as n_removed, coalesce(t.n_spans, 0) as n_spans, sha256(unhex(coalesce(t.kept, d.x))) as kept_sha256 from d left join t using (doc_id)
"""


def quality(rounds: int = 25) -> str:
    """Features, votes, and the rounds of expectation-maximisation one after the other, each a table of its own."""
    m = len(RULES)
    votes = ", ".join(f"case when n_words = 0 then 0 when ({x}) < {good} then 1 when ({x}) > {bad} then -1 else 0 end" for _, x, good, bad in RULES).replace(" / ", " / 1.0e0 / ")
    lone = ", ".join("'" + x.replace("'", "''") + "'" for x in LONE)
    lacking = lambda of, chars: f"length(translate({of}, '{chars}', ''))"
    out = [
        f"w as (select doc_id, coalesce(text, '') as t, {WORDS} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) as l from documents)",
        "g as (select doc_id, i, [w[i], w[i + 1], w[i + 2]] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2))",
        "rp as (select doc_id, i from g join (select doc_id, g from g group by all having count(*) > 1) using (doc_id, g))",
        "rw as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from rp) group by doc_id)",
        f"f as (select w.doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(t) - {lacking('t', '#*$%&|<>')} as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(rw.n, 0) as n_repeat_words, len(l) as n_lines,"
        f" len(list_filter(l, lambda x: right(rtrim(x), 1) in ('.', '!', '?', '…'))) as n_ends, len(list_filter(w, lambda x: x in ({lone}))) as n_lone, length(t) - {lacking('t', '!')} as n_shouts,"
        r" length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) as n_upper, length(t) - length(regexp_replace(t, '\p{Ll}', '', 'g')) as n_lower from w left join rw using (doc_id))",
        f"v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, [{votes}] as v from f)",
        "p as (select v, count(*) as n from v where not base_failed group by v)",
        "q0 as (select v, n, 1 / (1 + exp(3.0e0 * len(list_filter(v, lambda x: x < 0)) - len(list_filter(v, lambda x: x > 0)) / 2.0e0)) as q from p)",
    ]
    for i in range(rounds + 1):
        out.append(f"m{i} as (select j, k, ln((1 + sum(case when v[j] = k then n * q else 0 end)) / (3 + sum(n * q))) as g, ln((1 + sum(case when v[j] = k then n * (1 - q) else 0 end)) / (3 + sum(n * (1 - q)))) as b from q{i}, (select unnest(range(1, {m + 1})) as j), (select unnest([-1, 0, 1]) as k) group by j, k)")
        out.append(f"o{i} as (select (1 + sum(n * q)) / (2 + sum(n)) as prior from q{i})")
        if i < rounds:
            out.append(f"q{i + 1} as materialized (select p.v, p.n, 1 / (1 + exp(ln((1 - any_value(prior)) / any_value(prior)) + sum(b - g))) as q from p, o{i}, m{i} where m{i}.k = p.v[m{i}.j] group by p.v, p.n)")
    out.append(f"z as (select vv.v, 1 / (1 + exp(ln((1 - any_value(prior)) / any_value(prior)) + sum(b - g))) as q from (select distinct v from v) vv, o{rounds}, m{rounds} where m{rounds}.k = vv.v[m{rounds}.j] group by vv.v)")
    return "with " + ",\n".join(out) + "\nselect doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and q >= 0.5 as kept, round(q, 6) as p_good from v join z using (v)"


def urls() -> str:
    verdicts = " union all ".join(f"select '{r}' as rule, '{v}' as verdict" for r, v in URL_RULES)
    part = "split_part(rule, '/', 1)"
    chance = lambda n, of: f"list_reduce(list_transform(f, lambda x: [x.{n}, x.{of}]), lambda a, x: [(x[1] + {SMOOTH} * a[1]) / (x[2] + {SMOOTH}), 0.0e0], [1 / 64.0e0, 0.0e0])[1]"
    fold = f"hash_of % {FOLDS}"
    return f"""
with u0 as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
u1 as (select page_id, rest, regexp_extract(rest, '(?s)^[^/?#]*') as h from u0),
u2 as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(h) + 1), '(?s)^[^?#]*') as path from u1),
rules as ({verdicts}),
best as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as ruled from u2 join rules on (host = {part} or ends_with(host, '.' || {part})) and starts_with(path, substr(rule, length({part}) + 1)) group by page_id),
u as (select u2.*, rule, ruled, '^' || translate(lower(host || path), '123456789', '000000000') || '$' as text from u2 left join best using (page_id)),
x as (select text, ruled, count(*) as n, cast('0x' || substr(md5(text), 1, 8) as bigint) as hash_of from u group by text, ruled),
t as (select text, ruled, n, {fold} as fold from x),
known as (select distinct text, ruled = 'allow' as good from t where ruled is not null and fold > 0),
kg as (select good, substr(text, greatest(i - {ORDER}, 1), least(i - 1, {ORDER})) as c, substr(text, i, 1) as s from (select good, text, unnest(range(2, length(text) + 1)) as i from known)),
kc as (select good, right(c, k) as c, s from (select good, c, s, unnest(range(0, least({ORDER}, length(c)) + 1)) as k from kg)),
m as (select c, s, count(*) filter (good) as g, count(*) filter (not good) as b from kc group by c, s),
mt as (select c, sum(g) as ag, sum(b) as ab from m group by c),
a as (select distinct text from t where ruled is null or fold = 0),
ag as (select text, substr(text, greatest(i - {ORDER}, 1), least(i - 1, {ORDER})) as c, substr(text, i, 1) as s from (select text, unnest(range(2, length(text) + 1)) as i from a)),
w as (select distinct c, s from ag),
ws as (select c, s, right(c, k) as cc, k from (select c, s, unnest(range(0, least({ORDER}, length(c)) + 1)) as k from w)),
l as (select ws.c, ws.s, list({{'g': coalesce(m.g, 0)::double, 'ag': coalesce(mt.ag, 0)::double, 'b': coalesce(m.b, 0)::double, 'ab': coalesce(mt.ab, 0)::double}} order by k) as f from ws left join m on m.c = ws.cc and m.s = ws.s left join mt on mt.c = ws.cc group by ws.c, ws.s),
sc as (select c, s, ln({chance('g', 'ag')}) - ln({chance('b', 'ab')}) as score from l),
ts as (select text, avg(score) as score from ag join sc using (c, s) group by text),
held as (select round(least(greatest(score, -9), 9), 2) as score, count(*) filter (ruled = 'allow') as good, count(*) filter (ruled = 'block') as bad from t join ts using (text) where ruled is not null and fold = 0 group by 1),
cum as (select score, coalesce(lag(score) over (order by score), score) as before, coalesce(sum(good) over (order by score rows between unbounded preceding and 1 preceding), 0) / sum(good) over () + (sum(bad) over () - coalesce(sum(bad) over (order by score rows between unbounded preceding and 1 preceding), 0)) / sum(bad) over () as error, sum(good) over () as g, sum(bad) over () as b from held),
lim as (select case when (select count(distinct good) from known) < 2 then -1e308 else coalesce((select (before + score) / 2 from cum where g > 0 and b > 0 and error < 1 order by error, score limit 1), 0) end as lim)
select page_id, host, path, rule, coalesce(ruled, case when ts.score < lim then 'block' else 'allow' end) as verdict, round(case when ruled is null then ts.score end, 6) as score from u left join ts using (text), lim
"""


OP7 = r"""
with c as (select conv_id, turn, role, text from conversations union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as n, coalesce(role, '') as role, coalesce(text, '') as text from c),
e as (select *, length(role || text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) as own from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256, cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(own + length('<turn:') + 2 + length('</turn>') + 2) as bigint) as formatted_chars from e group by conv_id
"""

OP9 = f"""
with recursive w as (select doc_id, {WORDS} as w from documents),
s as (select distinct doc_id, list_slice(w, i, i + 4) as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5) union all select doc_id, w as g from w where len(w) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
j as (select a, b, shared, x.n as na, y.n as nb from p join n x on x.doc_id = a join n y on y.doc_id = b where 10 * shared >= 8 * (x.n + y.n - shared)),
r as (select a, b from j union select r.a, j.b from r join j on j.a = r.b)
select d.doc_id, least(d.doc_id, coalesce((select min(b) from j where j.a = d.doc_id and shared = na and na = nb), d.doc_id)) as copy_of, least(d.doc_id, coalesce((select min(b) from r where r.a = d.doc_id), d.doc_id)) as class_id,
 (select count(*) from j where j.a = d.doc_id) as n_links, coalesce(n.n, 0) as n_shingles from documents d left join n using (doc_id)
"""
