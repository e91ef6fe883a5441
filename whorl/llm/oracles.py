"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import filter_audit, licenses, quality, sharding


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_quote(licenses.COPYRIGHT_LINE)}, '', 'g')"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, {_quote(old)}, {_quote(new)})"
    return f"trim(regexp_replace({out}, {_quote(licenses.OTHER)}, ' ', 'g'))"


def license_sql() -> str:
    known = ", ".join(f"({_quote(k)}, {_quote(t)})" for k, t in licenses.known_texts())
    return f"""
with known as (select sha256({_canonical("t")}) as d, min(k) as license from (values {known}) v(k, t) group by 1),
docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
whole as (select r, doc_id, sha256({_canonical("t")}) as digest from docs),
lines as (select r, unnest(string_split(t, chr(10))) as line from docs),
notes as (select r, string_agg(distinct license, ',' order by license) as notices from lines join known on d = sha256({_canonical("line")}) where regexp_matches(line, '(?i)licen[cs]e') group by r)
select doc_id, digest, license as text_license, coalesce(notices, '') as notices from whole left join known on d = digest left join notes using (r)"""


def quality_sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    a, n = alpha / len(quality.RULES), len(quality.RULES)
    percent = lambda r: "case when {1} > 0 then least(100, (100 * {0}) // {1}) else 0 end".format(*quality.RULES[r])
    stacked = " union all ".join(f"select rid, doc_id, stratum, '{r}' as rule, {i} as place, {percent(r)} as bin from m" for i, r in enumerate(quality.RULES))
    leads = " || ' ' || ".join(f"lead(w, {i}) over p" for i in range(1, quality.WINDOW))
    count = lambda p: f"length(t) - length(regexp_replace(t, {_quote(p)}, '', 'g'))"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
words as (select rid, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from w),
windows as (select rid, i, w || ' ' || {leads} as k from words window p as (partition by rid order by i)),
twice as (select rid, i, count(*) over (partition by rid, k) as c from windows where k is not null),
covered as (select distinct rid, i + o as j from twice, range({quality.WINDOW}) t(o) where c > 1),
reps as (select rid, count(*) as n from covered group by rid),
m as (select rid, doc_id, stratum, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, ({count(quality.SYMBOLS)})::bigint as n_symbols, ({count(quality.MARKS)})::bigint as n_marks, ({count("[A-Z]")})::bigint as n_capitals, len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words from w left join reps using (rid)),
b as ({stacked}),
l as (select doc_id, max(quality) as good from labels where doc_id is not null and quality is not null group by 1),
h as (select stratum, rule, bin, count(*) filter (where good > 0) as good, count(*) filter (where good <= 0) as bad from b join l using (doc_id) group by all),
c as (select *, sum(good) over (partition by stratum, rule) as n, sum(good) over f as k, sum(bad) over f as caught from h window f as (partition by stratum, rule order by bin desc)),
p as (select *, case when k >= n * {a!r} then 1.0 else list_sum(list_transform(range(0, k::bigint + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({a!r}) + (n - j) * ln(1 - {a!r})))) end as p from c where bin > 0),
q as (select *, max(p) over (partition by stratum, rule order by bin desc) as worst from p),
best as (select stratum, rule, bin as cutoff from q where worst <= {delta / n!r} / (select count(distinct stratum) from h) and caught > 0 qualify row_number() over (partition by stratum, rule order by caught desc, bin desc) = 1),
failed as (select rid, string_agg(rule, ',' order by place) as rules from b join best using (stratum, rule) where bin >= cutoff group by rid),
v as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, coalesce(rules, '') as rules_failed from m left join failed using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rules_failed, not base_failed and rules_failed = '' as kept from v"""


def url_sql() -> str:
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*://"
    day = lambda key: f"cast('0x' || substr(md5({key}), 1, 4) as integer) % 300"
    return f"""
with p as (select row_number() over () as r, page_id, url, (page_id * 7919) % 365 as fetched, lower(regexp_extract(coalesce(url, ''), '{scheme}(?:[^/?#@]*@)?([^/?#:]+)', 1)) as host, list_filter(string_split(regexp_extract(coalesce(url, ''), '{scheme}[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts from pages),
hosts as (select distinct host from p where host <> ''),
domains as (select distinct regexp_extract(host, '([^.]+\\.[^.]+)$', 1) as domain from hosts),
entries as (select 'abuse' as list, 'block' as action, 'host' as kind, host as key, {day("host")} as valid_from, {day("host")} + 90 as valid_to from hosts
 union all select 'trusted', 'allow', 'domain', domain, {day("domain")}, {day("domain")} + 60 from domains where domain <> ''
 union all select 'paths', 'block', 'prefix', host || '/en', {day("host || '/en'")}, null from hosts),
asked as (select r, fetched, 'host' as kind, host as key from p where host <> ''
 union all select r, fetched, 'domain', array_to_string(string_split(host, '.')[i:], '.') from (select *, unnest(range(1, 1 + greatest(len(string_split(host, '.')) - 1, 1))) as i from p) where host <> ''
 union all select r, fetched, 'prefix', host || '/' || array_to_string(parts[:i], '/') from (select *, unnest(range(1, 1 + len(parts))) as i from p) where host <> ''),
hits as (select r, list, action, kind, key, valid_from from asked join entries using (kind, key) where valid_from <= fetched and (valid_to is null or valid_to > fetched)
 qualify row_number() over (partition by r order by length(key) desc, action, case kind when 'prefix' then 2 when 'host' then 1 else 0 end desc, list desc) = 1)
select page_id, url, cast(fetched as bigint) as fetched, coalesce(action, 'none') as verdict, list, kind, key, cast(valid_from as bigint) as valid_from from p left join hits using (r)"""


def audit_sql() -> str:
    """Counts by the combination of flags, then every order step by step on those counts."""
    word = "'[\\x20\\x09-\\x0D]+'"
    steps = ", ".join(f"('{order}', {step}, '{letter}', {mask})" for order, step, letter, mask in filter_audit.order_steps())
    bits = " + ".join(f"{k}::int * {1 << i}" for i, k in enumerate(filter_audit.FILTERS))
    return f"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, {word}), lambda x: x <> '') as ws, min(doc_id) over (partition by t) as first from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by 1),
f as (select part, len(ws) < 200 as A, 100 * len(list_distinct(ws)) < 50 * len(ws) as B, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) as C, regexp_matches(t, '[#$%&*|]') as D, coalesce(doc_id > first, false) as E, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from w left join l using (doc_id)),
c as (select part, {bits} as fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2),
s as (select * from (values {steps}) v(filter_order, step, letter, before)),
x as (select part, filter_order, step, letter, 1 << (instr('ABCDE', letter) - 1) as bit, before, fails, n, good, toxic from c, s),
y as (select part, filter_order, step, letter,
 sum(n) filter (where fails & (before | bit) = 0) as kept, sum(n) filter (where fails & before = 0 and fails & bit > 0) as removed, sum(n) filter (where fails & before > 0 and fails & bit > 0) as redundant, sum(n) filter (where fails = bit) as unique_fails,
 sum(good) filter (where fails & before = 0 and fails & bit > 0) as good_lost, sum(toxic) filter (where fails & before = 0 and fails & bit > 0) as toxic_lost from x group by all)
select part, filter_order, cast(step as integer) as step, {", ".join(f"cast(coalesce({c}, 0) as bigint) as {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, cast(coalesce(sum(removed) over (partition by part, letter), 0) as bigint) as shapley from y"""


ORACLES = {"op11_filter_audit": audit_sql(), "op2_url_lists": url_sql(), "op3_license_scan": license_sql(), "op6_extendible_shards": sharding.SQL, "op7_quality_rules": quality_sql()}
