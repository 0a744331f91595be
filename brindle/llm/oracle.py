"""DuckDB SQL for the queries that SQL can express, over the same whole tables."""

from __future__ import annotations

import html.entities
import re

#: The base of the secret scan, written out on its own: kind, pattern, group of the value, least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]+)", 1, 24),
)

WORDS = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Written for this engine on its own, not from the operator's constants: dropped elements, line ends, other tags.
_GONE = r"<!--.*?(-->|\z)|<(script)\b.*?(</script\s*>|\z)|<(style)\b.*?(</style\s*>|\z)"
#: Elements whose start says that a head is over.
_CONTENT = (
    "a abbr address article aside audio b bdi bdo blockquote body br button canvas center cite code data datalist dd del details dfn dialog dir div dl dt em embed fieldset figure font footer form "
    "frame frameset h1 h2 h3 h4 h5 h6 header hgroup hr html i iframe img input ins kbd label li main map mark marquee menu meter nav nobr object ol output p param picture pre progress q rp rt ruby s "
    "samp search section select slot small source span strike strong sub summary sup svg table tbody td textarea tfoot th thead time tr track tt u ul var video wbr math"
)
_HEAD = rf"<head\b.*?(?:</head\s*>|(<(?:{_CONTENT.replace(' ', '|')})\b)|\z)"
_INSIDE = r"""(?:(?:[^<>=]*=[ \t\r\n\f]*(?:"[^"<]*"|'[^'<]*')?){0,64}[^<>]*>|[^<>]*>)"""
_BLOCKS = "p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer title main aside pre blockquote hr"
_NAMED = {name: chr(code) for name, code in html.entities.name2codepoint.items()} | {"apos": "'"}


def _plain_text(page: str) -> str:
    out = f"regexp_replace({page}, {_text(_GONE)}, '', 'gis')"
    out = rf"regexp_replace({out}, {_text(_HEAD)}, '\1', 'gis')"
    out = f"regexp_replace({out}, {_text(rf'</?({_BLOCKS.replace(' ', '|')})' + chr(92) + 'b' + _INSIDE)}, chr(10), 'gi')"
    out = f"regexp_replace({out}, {_text('<[a-z/!?]' + _INSIDE)}, '', 'gi')"
    named = "map {" + ", ".join(f"{_text(n)}: {_text(c)}" for n, c in _NAMED.items()) + "}"
    name = "split_part(p, ';', 1)"
    point = f"case when regexp_full_match({name}, '#[0-9]{{1,7}}') then {name}[2:]::int when regexp_full_match({name}, '#[xX][0-9A-Fa-f]{{1,6}}') then ('0x' || {name}[3:])::int end"
    char = f"coalesce(case when {point} between 1 and 55295 or {point} between 57344 and 1114111 then chr({point}) end, {named}[{name}])"
    part = f"case when contains(p, ';') and {char} is not null then {char} || p[length({name}) + 2:] else '&' || p end"
    out = f"list_transform([string_split({out}, '&')], lambda s: s[1] || array_to_string(list_transform(s[2:], lambda p: {part}), ''))[1]"
    out = rf"regexp_replace(regexp_replace({out}, '[ \x{{a0}}\t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')"
    return rf"regexp_replace({out}, '^[ \n]+|[ \n]+$', '', 'g')"


def _uuid(*parts: str) -> str:
    h = f"sha256(concat_ws(chr(10), {', '.join(parts)}))"
    return f"list_transform([{h}], lambda h: '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] || '>')[1]"


OP2 = rf"""
with pages_read as (select page_id, url, coalesce(html, '') as body from pages),
digested as (
  select *, 'sha256:' || sha256(body) as source_digest, {_plain_text("body")} as plain,
    trim(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '[ \t\r\n\f]+', ' ', 'g')) as title
  from pages_read),
named as (select *, {_uuid("'response'", "coalesce(page_id::varchar, '')", "coalesce(url, '')", "'1970-01-01T00:00:00Z'", "source_digest")} as refers_to from digested),
records as (
  select *, 'metadata' as warc_type, 'application/warc-fields' as content_type,
    concat('sourceDigest: ', source_digest, chr(13), chr(10), 'sourceLength: ', strlen(body), chr(13), chr(10),
      'textLength: ', strlen(plain), chr(13), chr(10), 'title: ', title, chr(13), chr(10)) as block from named
  union all
  select *, 'conversion', 'text/plain; charset=UTF-8', plain from named)
select page_id, warc_type, {_uuid("warc_type", "refers_to")} as record_id, refers_to, url as target_uri, '1970-01-01T00:00:00Z' as warc_date, '1970-01-01T00:00:00Z' as refers_to_date,
  source_digest, '' as source_headers, content_type,
  'sha256:' || sha256(block) as block_digest, strlen(block)::bigint as content_length, block
from records
"""


def _either_case(pattern: str) -> str:
    """The pattern with (?i:...) spelt out for ASCII, as this engine would fold further letters."""
    inner = lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")"
    return re.sub(r"\(\?i:([^)]*)\)", inner, pattern)


def _matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = _text(_either_case(pattern))
    return f"""select rid, {rank} as rank, '{kind}' as kind, {least} as least, generate_subscripts(regexp_extract_all(text, {p}), 1) as nth, unnest(regexp_extract_all(text, {p})) as whole,
    unnest(regexp_extract_all(text, {p}, {group})) as value, unnest(list_slice(string_split_regex(text, {p}), 1, len(regexp_extract_all(text, {p})))) as gap from docs"""


OP3 = f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, coalesce(source, '') as owner, coalesce(doc_id::varchar, '') as repo from documents),
matches as ({" union all ".join(_matches(i, *b) for i, b in enumerate(BASE))}),
ended as (select *, sum(length(gap) + length(whole)) over (partition by rid, rank order by nth) as stop from matches),
spans as (select rid, rank, kind, (stop - length(whole))::bigint as start, stop::bigint as stop, value, (stop - length(value))::bigint as value_start from ended where length(value) >= least),
held as (
  select value, count(distinct owner) <= 2 as few,
    regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')
    and (len(list_distinct(string_split(value, ''))) >= 8 or 3 * len(list_distinct(string_split(value, ''))) >= 2 * length(value))
    and not regexp_matches(value, '(?i)example|changeme|placeholder|dummy|xxxx|12345678') as generated
  from spans join docs using (rid) group by value),
live as (select distinct rid, {len(BASE)} as rank, 'live' as kind, value_start as start, stop from spans join held using (value) where few and generated),
every as (select rid, rank, kind, start, stop from spans union all select * from live),
shared as (select rid, count(*) as n from spans join held using (value) where not few group by rid),
summed as (
  select rid, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
    count(*) filter (where kind = 'live') as n_live, string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank) filter (where kind <> 'live') as base,
    string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank, stop) as spans
  from every group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0)::bigint as n_live, coalesce(n, 0)::bigint as n_shared
from docs left join summed using (rid) left join shared using (rid)
"""

OP5 = """
with recursive vectors as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
counted as (select a, count(*) as n from links group by a),
lowest as (select a, min(b) as b from reach group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(b, vec_id)) as component_id, vec_id <= coalesce(b, vec_id) as kept
from embeddings left join counted on counted.a = vec_id left join lowest on lowest.a = vec_id
"""

OP7 = """
with hashed as (select row_number() over () as rid, doc_id, strlen(coalesce(text, ''))::bigint as n_bytes, ('0x' || md5(coalesce(doc_id::varchar, ''))[1:15])::bigint as h from documents),
levels as (select *, unnest(range(61)) as depth from hashed),
prefixes as (select *, h >> (60 - depth) as q from levels),
summed as (select *, sum(n_bytes) over (partition by depth, q)::bigint as shard_bytes from prefixes)
select doc_id, n_bytes, 's' || case when depth = 0 then '' else lpad(bin(q), depth::integer, '0') end as shard, depth::integer as depth, shard_bytes, shard_bytes > 1048576 as oversized
from summed where shard_bytes <= 1048576 or depth = 60 qualify row_number() over (partition by rid order by depth) = 1
"""

OP8 = f"""
with docs as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) as w from documents),
words as (select rid, doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from docs),
w2 as (select *, word || ' ' || lead(word) over (partition by rid order by pos) as x2 from words),
w4 as (select *, x2 || ' ' || lead(x2, 2) over (partition by rid order by pos) as x4 from w2),
w8 as (select *, x4 || ' ' || lead(x4, 4) over (partition by rid order by pos) as x8 from w4),
w16 as (select rid, doc_id, pos, x2, x8 || ' ' || lead(x8, 8) over (partition by rid order by pos) as x16 from w8),
w32 as (select *, x16 || ' ' || lead(x16, 16) over (partition by rid order by pos) as x32 from w16),
w50 as (select rid, doc_id, pos, x32 || ' ' || lead(x16, 32) over (partition by rid order by pos) || ' ' || lead(x2, 48) over (partition by rid order by pos) as run from w32),
windows as (select rid, doc_id, pos, min(doc_id) over (partition by run) as first_id from w50 where run is not null),
gone as (select distinct rid, pos + unnest(range(50)) as pos from windows where doc_id > first_id),
kept as (select rid, count(*) as n, string_agg(word, ' ' order by pos) as text from words anti join gone using (rid, pos) group by rid)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256 from docs left join kept using (rid)
"""

OP10 = f"""
with docs as (select row_number() over () as rid, doc_id, source as host, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {WORDS}) as w from documents),
words as (select rid, unnest(w) as word, generate_subscripts(w, 1) as pos from docs),
windows as (select rid, pos, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o as run from words window o as (partition by rid order by pos)),
twice as (select rid, pos from windows where run is not null qualify count(*) over (partition by rid, run) > 1),
repeated as (select rid, count(distinct p) as n_repeat_words from (select rid, pos + unnest([0, 1, 2]) as p from twice) group by rid),
split as (select rid, host, text, unnest(string_split(text, chr(10))) as line from docs),
lines as (
  select *, regexp_extract_all(line, {WORDS}) as lw, translate(array_to_string(regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), {WORDS}), ' '), '123456789', '000000000') as plain
  from split where regexp_matches(line, {WORDS})),
dups as (select rid, count(*) - count(distinct line) as n_dup_lines from lines group by rid),
hosts as (select host, count(distinct text) as n_docs from docs group by host),
often as (
  select l.host, plain from (select host, plain, count(distinct text) as n from lines group by host, plain) l join hosts h on l.host is not distinct from h.host
  where n > 20 and n > 0.05 * n_docs),
cut as (select l.rid, sum(len(lw)) as n_removed from lines l join often o on l.host is not distinct from o.host and l.plain = o.plain group by l.rid),
facts as (
  select doc_id, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_removed, 0)::bigint as n_removed
  from docs left join repeated using (rid) left join dups using (rid) left join cut using (rid)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from facts)
select *, not base_failed and n_words - n_removed >= 0.5 * n_words as kept from judged
"""

#: CRC-32 of ASCII text, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split({0}, ''), lambda x: ascii(x)::bigint), lambda c, b: list_reduce(range(8), lambda v, i: xor(v >> 1, (v & 1) * 3988292384), xor(c, b)), 4294967295::bigint), 4294967295::bigint)"""
#: What inserts may come before a row: from state (0 start, 1 after s, 2 after u, 3 after ua), labels, lines, to state.
_MOVES = ", ".join(
    f"({state}, '{'I' * n}', [{', '.join(repr(x) for x in (['user:', 'assistant:', 'user:', 'assistant:'] if state != 2 else ['assistant:', 'user:', 'assistant:'])[:n])}]::varchar[], {state if n == 0 else (2, 3)[(n + (state == 2) + 1) % 2]})"
    for state in range(4)
    for n in range(4)
)

OP12 = rf"""
with recursive numbered as (
  select row_number() over () as mid, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_CRC.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as draw from conversations),
damaged as (
  select mid, conv_id, turn, case when draw = 4 then 'user' else role end as role, case draw when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(case draw when 0 then [] when 3 then [0, 1] else [0] end) as copy from numbered),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text[:256], md5(text), mid, copy) as n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from damaged),
faulty as (
  select conv_id, n, turn, role, text, role[:1] as initial, lag(role[:1]) over (partition by conv_id order by n) as before,
    case when bare = '' then 'b' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'd' when bare[-1] not in ('.', '!', '?') then 't' else '-' end as fault from placed),
ids as (select row_number() over () as cid, conv_id from (select distinct conv_id from conversations)),
coded as (select cid, f.* from faulty f join ids on f.conv_id is not distinct from ids.conv_id),
moves(state, inserts, said, then_state) as (values {_MOVES}),
paths as (
  select cid, 0::bigint as n, 0 as state, 0::bigint as cost, '' as audit, []::varchar[] as said from ids
  union all
  select cid, n, state, best.cost, best.audit, best.said from (
    select c.cid, c.n, e.state, min({{'cost': p.cost + 2 * length(m.inserts) + e.cost, 'audit': p.audit || m.inserts || e.label, 'said': p.said || m.said || e.said}}) as best
    from paths p join coded c on c.cid = p.cid and c.n = p.n + 1 join moves m on m.state = p.state,
      lateral (select case when m.then_state = 2 then 3 else 2 end as forward) f,
      lateral (
        select 'D' as label, 3 as cost, m.then_state as state, []::varchar[] as said
        union all
        select 'K', (c.fault = 't')::int, case c.initial when 's' then 1 else f.forward end, [c.role || ':' || c.text]
        where c.fault in ('t', '-') and ((c.initial = 's' and m.then_state = 0) or (c.initial = 'u' and f.forward = 2) or (c.initial = 'a' and f.forward = 3))
        union all
        select 'R', 2 + (c.fault = 't')::int, f.forward, [case f.forward when 2 then 'user:' else 'assistant:' end || c.text] where c.fault in ('t', '-')) e
    group by c.cid, c.n, e.state)),
ends as (
  select cid, min({{'cost': p.cost + 2 * length(m.inserts), 'audit': p.audit || m.inserts, 'said': p.said || m.said}}) as best
  from paths p join moves m on m.state = p.state and m.then_state in (0, 3) where p.n = (select count(*) from coded c where c.cid = p.cid) group by cid),
facts as (
  select cid, count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated,
    count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from coded group by cid)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  best.cost::bigint as cost, best.audit as audit, sha256(array_to_string(best.said, chr(10))) as repaired_sha256
from ids join ends using (cid) left join facts using (cid)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_warc_derivatives": OP2,
    "op3_secret_scan": OP3,
    "op5_embedding_dedup": OP5,
    "op7_extendible_sharding": OP7,
    "op8_substring_dedup": OP8,
    "op10_quality_rules": OP10,
    "op12_conversation_repair": OP12,
}
