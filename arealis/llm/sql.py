"""The rows of the text queries as DuckDB SQL, where SQL can state them."""

from . import quality, secret_scan, sharding, spelling

_F1, _F2 = sharding.FACTORS


def _round(k: int, key: int, inner: str) -> str:
    mixed = f"((xor(r, {key}) * {_F1}) + {key})"
    mixed = f"(((xor({mixed}, {mixed} >> 15) & 2147483647) * {_F2} >> 13) & ((1 << b) - 1))"
    return f"select id, n, b, r as l, xor(l, {mixed}) as r from ({inner})"


def _walk(source: str) -> str:
    inner = f"select id, n, b, v >> b as l, v & ((1 << b) - 1) as r from {source}"
    for k, key in enumerate(sharding.round_keys(0)):
        inner = _round(k, key, inner)
    return f"select id, n, b, (l << b) | r as v from ({inner})"


_CRC_STEP = "list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"

SHARDING = f"""
with recursive lookup as (select list({_CRC_STEP} order by i) as tab from range(256) t(i)),
numbered as (
  select doc_id as id, row_number() over (order by doc_id) - 1 as v, count(*) over () as n,
         cast(greatest(1, (length(bin(greatest(count(*) over () - 1, 1))) + 1) // 2) as int) as b from documents),
walk as (
  {_walk("numbered")}
  union all
  {_walk("(select * from walk where v >= n)")}),
bytes as (
  select doc_id, coalesce(octet_length(encode(text)), 0) as size,
         list_transform(range(coalesce(octet_length(encode(text)), 0)), lambda i:
           ('0x' || substr(hex(encode(text)), cast(2 * i + 1 as int), 2))::bigint) as x from documents)
select d.doc_id, d.size + 1 as size,
       xor(list_reduce(list_prepend(4294967295::bigint, d.x),
           lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1])), 4294967295) as text_crc32,
       'rows' as law, cast(w.v % 8 as int) as shard, w.v // 8 as slot, cast(null as int) as grown_shard
from bytes d join walk w on w.id = d.doc_id and w.v < w.n cross join lookup"""

CHAT = r"""
with rows as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(role) + 24 + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) as bigint) as formatted_chars
from rows group by conv_id"""


def _fence(level: str, group: str) -> str:
    return f"""{level} as (
  select {group}, metric, min(low) filter (4 * upto >= total) as q1, min(low) filter (4 * upto >= 3 * total) as q3
  from (select *, sum(n) over (partition by {group}, metric order by bucket) as upto,
               sum(n) over (partition by {group}, metric) as total
        from (select {group}, metric, bucket, sum(n) as n, min(low) as low from fine group by all))
  {"where total >= " + str(quality.MIN_ROWS) if level != "whole" else ""} group by all)"""


_LEAST = "case metric " + " ".join(f"when '{m}' then {r[2]}" for m, r in quality.RATIOS.items()) + " end"
_BELOW = " or ".join(f"metric = '{m}'" for m, r in quality.RATIOS.items() if r[3])

QUALITY = rf"""
with texts as (select doc_id, coalesce(lang, '') as g_lang, coalesce(source, '') as g_source, coalesce(text, '') as text
               from documents),
words as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from texts),
places as (select doc_id, unnest(range(1, len(w) - 1)) as p, w from words where len(w) > 2),
windows as (select doc_id, p, count(*) over (partition by doc_id, w[p], w[p + 1], w[p + 2]) as times from places),
repeats as (select doc_id, count(distinct q) as n_repeat_words
            from (select doc_id, unnest([p, p + 1, p + 2]) as q from windows where times > 1) group by 1),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
          from (select doc_id, unnest(string_split(text, chr(10))) as line from texts)
          where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
counts as (
  select t.doc_id, g_lang, g_source, len(w) as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         coalesce(n_lines, 0) as n_lines
  from texts t join words using (doc_id) left join repeats using (doc_id) left join lines using (doc_id)),
based as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts),
ratios as (
  {" union all ".join(f"select doc_id, g_lang, g_source, '{m}' as metric, {a} * 1000 // {b} as value from based where not base_failed" for m, (a, b, _, _) in quality.RATIOS.items())}),
fine as (
  select g_lang, g_source, metric,
         case when value < 64 then value else (length(bin(value)) - 6) * 32 + (value >> (length(bin(value)) - 6)) end as bucket,
         1 as one, count(*) as n, min(value) as low from ratios group by all),
{_fence("near", "g_lang, g_source")},
{_fence("wide", "g_lang")},
{_fence("whole", "one")},
verdicts as (
  select r.doc_id, bool_or(value > q3 + {quality.REACH} * greatest(q3 - q1, {_LEAST})
           or (({_BELOW}) and value < q1 - {quality.REACH} * greatest(q3 - q1, {_LEAST}))) as beyond
  from (select r.doc_id, r.metric, r.value, coalesce(a.q1, b.q1, c.q1) as q1, coalesce(a.q3, b.q3, c.q3) as q3
        from ratios r left join near a using (g_lang, g_source, metric) left join wide b using (g_lang, metric)
        join whole c using (metric)) r group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce(beyond, false) as kept
from based left join verdicts using (doc_id)"""


def _value(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::varchar)) || ':' || {column}::varchar, '-')"


def _levels(name: str, first: str) -> str:
    """Nodes of all levels of the trees in ``first`` (tree, level, idx, n, h), with what is left and right in the run."""
    run = "partition by tree, level, idx // 8 order by idx rows between"
    return f"""{name} as (
  {first}
  union all
  select tree, level + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' order by idx))
  from {name} where n > 1 group by tree, level, idx // 8),
{name}_runs as (select *, coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as lh,
    coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as rh from {name})"""


def _paths(name: str, nodes: str, first: str) -> str:
    """From ``first`` (doc_id, tree, level, idx, now, proof) up to the top of the tree."""
    return f"""{name} as (
  {first}
  union all
  select p.doc_id, p.tree, p.level + 1, p.idx // 8, sha256(lh || now || rh), proof || lh || rh
  from {name} p join {nodes}_runs r using (tree, level, idx) where r.n > 1),
{name}_ends as (select * from {name} qualify row_number() over (partition by doc_id order by level desc) = 1)"""


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_value, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, {bytes}),
           lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1])), 4294967295)"""
_DIGITS = "list_transform(range(length({0}::varchar)), lambda i: ascii(substr({0}::varchar, cast(i + 1 as int), 1))::bigint)"

MANIFEST = f"""
with recursive lookup as (select list({_CRC_STEP} order by i) as tab from range(256) t(i)),
leaves as (
  select doc_id, lang, {_leaf('text')} as h,
         {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as altered,
         {_CRC.format(bytes=_DIGITS.format('doc_id'))} % 3 = 0 as tampered,
         dense_rank() over (order by lang nulls first) - 1 as tree,
         row_number() over (partition by lang order by doc_id) - 1 as idx,
         count(*) over (partition by lang) as n from documents cross join lookup),
{_levels("nodes", "select tree, 0 as level, idx, n, h from leaves")},
groups as (select tree as idx, h, count(*) over () as n from nodes where n = 1),
{_levels("tops", "select 0 as tree, 0 as level, idx, n, h from groups")},
{_paths("low", "nodes", "select doc_id, tree, 0 as level, idx, case when tampered then altered else h end as now, '' as proof from leaves")},
{_paths("high", "tops", "select doc_id, 0 as tree, 0 as level, tree as idx, now, proof from low_ends")}
select l.doc_id, l.h as leaf, g.h as subroot, t.h as root, sha256(p.proof) as proof_sha256, p.now as folded_root,
       p.now = t.h as verified
from leaves l join groups g on g.idx = l.tree join high_ends p on p.doc_id = l.doc_id
join tops t on t.n = 1"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(kind: int) -> str:
    pattern = _literal(secret_scan.PATTERNS[secret_scan.KINDS[kind]])
    return f"""select doc_id, owner, {kind} as kind, unnest(range(1, len(hits) + 1)) as k, unnest(hits) as hit,
       unnest(list_transform(gaps[:len(hits)], lambda g: length(g))) as gap
from (select doc_id, source as owner, regexp_extract_all(coalesce(text, ''), {pattern}) as hits,
             string_split_regex(coalesce(text, ''), {pattern}) as gaps from documents)"""


SECRETS = f"""
with found as ({" union all ".join(map(_matches, range(4)))}),
placed as (
  select *, finish - length(hit) as start,
         case when kind = 0 then regexp_extract(hit, {_literal(secret_scan.ASSIGN)}, 2) else hit end as value
  from (select *, sum(gap + length(hit)) over (partition by doc_id, kind order by k) as finish from found)),
valid as (select * from placed where kind <> 0 or length(value) >= {secret_scan.LEAST_VALUE}),
alone as (
  select * from valid v where kind < 3 or not exists (
    select 1 from valid b where b.doc_id = v.doc_id and b.kind < 3 and b.start < v.finish and b.finish > v.start)),
owned as (select sha256(value) as h, count(distinct doc_id) as repositories,
                 count(distinct coalesce('=' || owner, '')) as owners from alone group by 1),
judged as (
  select doc_id, kind, start, finish,
         case when owners > {secret_scan.MAX_OWNERS} or repositories > {secret_scan.MAX_REPOSITORIES} then 'copied'
              when regexp_matches(value, '[A-Za-z]') and regexp_matches(value, '[0-9]')
                   and not regexp_matches(value, {_literal(secret_scan.PLACEHOLDERS)})
                   and len(list_distinct(string_split(value, ''))) >= {secret_scan.LEAST_LETTERS} then 'live'
              else 'plain' end as verdict
  from alone join owned on h = sha256(value)),
told as (
  select *, (['assign', 'access', 'hex', 'owned'])[kind + 1] || ':' || cast(start as bigint) || ':' || cast(finish as bigint) as span
  from judged where kind < 3 or verdict = 'live')
select d.doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access,
       count(*) filter (kind = 2) as n_hex, count(*) filter (kind = 3) as n_owned,
       count(*) filter (verdict = 'live') as n_live, count(*) filter (verdict = 'copied') as n_copied,
       sha256(coalesce(string_agg(span, ',' order by start, kind) filter (kind < 3), '')) as base_sha256,
       coalesce(string_agg(span, ',' order by start, kind), '') as spans
from documents d left join told t using (doc_id) group by d.doc_id"""

_UTF8 = """list_transform(range(octet_length(encode({0}))), lambda i:
           ('0x' || substr(hex(encode({0})), cast(2 * i + 1 as int), 2))::bigint)"""

SPELLING = f"""
with recursive lookup as (select list({_CRC_STEP} order by i) as tab from range(256) t(i)),
runs as (
  select doc_id, run, count(*) as n
  from (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents)
  where length(run) >= {spelling.LEAST_LENGTH} group by all),
summed as (select run, n, {_CRC.format(bytes=_UTF8.format("(doc_id || ':' || run)"))} as h from runs cross join lookup),
words as (
  select word, cast(sum(n) as bigint) as n
  from (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
               else run end as word, n from summed)
  where length(word) >= {spelling.LEAST_LENGTH} group by 1 having sum(n) >= {spelling.LEAST_COUNT}),
shorter as (
  select word, length(word) as len, i, substr(word, 1, i) || substr(word, i + 2) as rest
  from (select word, unnest(range(length(word))) as i from words)),
pairs as (
  select a.word as u, b.word as v from shorter a join shorter b using (len, i, rest) where a.word <> b.word
  union select s.word, w.word from shorter s join words w on s.rest = w.word
  union select w.word, s.word from shorter s join words w on s.rest = w.word),
near as (
  select u as word, count(*) as n_near, arg_min(v, (-w.n, v)) as near, max(w.n) as near_n
  from pairs join words w on w.word = v group by 1),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near,
         case when near_n >= {spelling.DOMINANCE} * w.n then near end as form,
         case when near_n >= {spelling.DOMINANCE} * w.n then near_n end as form_n
  from words w left join near using (word)),
chain as (
  select word, word as upto, 0 as steps from forms
  union all select c.word, f.form, steps + 1 from chain c join forms f on f.word = c.upto where f.form is not null)
select word, form, (select arg_max(upto, steps) from chain c where c.word = f.word) as root, n, n_near, form_n
from forms f"""
