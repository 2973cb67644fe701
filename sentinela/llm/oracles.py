"""SQL twins of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from sentinela.llm.quality import BOILERPLATE, NAVIGATION, RULES, SYMBOLS, TERMINAL
from sentinela.llm.secrets import BASE62

ORACLES: dict[str, str] = {}

# Base 32 of a SHA-1: five hexadecimal digits are four digits of 32.
ORACLES["op1_warc"] = """
with own as (
    select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hexed from pages
), coded as (
    select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes,
        list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
            cast((cast('0x' || substr(hexed, cast(k // 4 * 5 + 1 as int), 5) as bigint)
                  >> (15 - 5 * (k % 4))) & 31 as int), 1)), 'string_agg', '') as payload_digest
    from own
), firsts as (
    select *, min(page_id) over (partition by payload_digest, payload_bytes) as first from coded
)
select page_id, payload_bytes, payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type,
    case when page_id = first then null else first end as refers_to
from firsts
"""

# Windows as byte strings; the first of equal ones has the smallest id (null last) and start. A run
# ends where no repeated window begins inside it or right behind it.
ORACLES["op2_suffix_array"] = """
with docs as (
    select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as d, encode(coalesce(text, '')) as b
    from documents
), windows as (
    select r, d, s, b[s:s + 99] as w from (
        select r, d, b, unnest(range(1, octet_length(b) - 98)) as s from docs where octet_length(b) >= 100)
), again as (
    select r, s from (select r, s, (d, s) != min((d, s)) over (partition by w) as later from windows) where later
), edges as (
    select r, s, s > lag(s) over (partition by r order by s) + 100 as is_new from again
), runs as (
    select r, min(s) as a, max(s) + 100 as e from (
        select r, s, sum(coalesce(is_new, true)::int) over (partition by r order by s) as k from edges)
    group by r, k
), sums as (
    select r, cast(count(*) as bigint) as n_spans, cast(sum(e - a) as bigint) as n_removed from runs group by r
), pieces as (
    select r, e as p, lead(a, 1, 9223372036854775807) over (partition by r order by e) as q
    from (select r, a, e from runs union all select r, 0, 1 from docs)
), kept as (
    select r, string_agg(hex(b[p:least(q, octet_length(b) + 1) - 1]), '' order by p) as h
    from pieces join docs using (r) where p < least(q, octet_length(b) + 1) group by r
)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed,
    coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(h, ''))) as kept_sha256
from docs left join sums using (r) left join kept using (r)
"""

ORACLES["op3_flat_graph"] = """
with recursive units as (
    select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
    where embedding is not null and len(embedding) > 0
), links as (
    select a.vec_id as a, b.vec_id as b from units a join units b on a.vec_id != b.vec_id
    where len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95
), reach(id, other) as (
    select a, b from links union select r.id, l.b from reach r join links l on r.other = l.a
), least as (select id, least(id, min(other)) as component_id from reach group by id)
select e.vec_id, (select count(*) from links where a = e.vec_id) as n_links,
    coalesce(l.component_id, e.vec_id) as component_id,
    e.vec_id = coalesce(l.component_id, e.vec_id) as kept,
    case when exists (select 1 from links) then cast(1.0 as double) end as audited_recall
from embeddings e left join least l on l.id = e.vec_id
"""

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op6_hamming"] = f"""
with recursive own as (
    select doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
        as w from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else
        list_distinct(list_transform(range(1, len(w) - 3),
            lambda i: array_to_string(w[i:i + 4], ' '))) end as s from own
), items as (select doc_id, len(s) as n, unnest(s) as g from sets
), links as (
    select a.doc_id as a, b.doc_id as b from items a join items b on a.g = b.g and a.doc_id != b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(id, other) as (
    select a, b from links union select r.id, l.b from reach r join links l on r.other = l.a
), least as (select id, least(id, min(other)) as component_id from reach group by id)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles,
    coalesce(l.component_id, s.doc_id) as component_id,
    s.doc_id = coalesce(l.component_id, s.doc_id) as kept
from sets s left join least l on l.id = s.doc_id
"""


def _listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COUNT = "(length({0}) - length(replace({0}, '{1}', ''))) // {2}"
_SYMBOLS = " + ".join(_COUNT.format("{0}", s, 1) for s in SYMBOLS)

# A match starts behind the pieces between matches and the matches before it. The last two kinds carry
# CRC-32 of their body in base 62.
_SECRETS = (
    ("assign", "(?:" + "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in (
        "password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
     r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(value) >= 6"),
    ("access", "(AKIA[A-Z0-9]+)", "length(value) >= 20"),
    ("hex", "([0-9a-f]{24,})", "true"),
    ("github", "gh[opusr]_([A-Za-z0-9]+)", "length(value) = 36 and alone and holds"),
    ("npm", "npm_([A-Za-z0-9]+)", "length(value) = 36 and alone and holds"))
_CRC = """xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(
        string_split({0}, ''), lambda c: cast(ascii(c) as bigint))), lambda a, b: list_reduce(
        list_prepend(xor(a, b), range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384)
            else x >> 1 end)), 4294967295)"""
_MATCHES = " union all ".join(
    f"""select r, '{kind}' as kind, {k} as k, regexp_extract_all(text, '{pattern}') as m,
        regexp_extract_all(text, '{pattern}', 1) as v, string_split_regex(text, '{pattern}') as s from docs"""
    for k, (kind, pattern, _) in enumerate(_SECRETS))

ORACLES["op9_secrets"] = f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), found as ({_MATCHES}
), placed as (
    select r, kind, k, m[i] as whole, v[i] as value, cast(list_sum(list_transform(s[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) as start
    from (select *, unnest(range(1, len(m) + 1)) as i from found)
), tested as (
    select p.*, start + length(whole) as stop,
        start = 0 or not regexp_matches(substr(text, start, 1), '[A-Za-z0-9]') as alone,
        case when k >= 3 and length(value) = 36 then array_to_string(list_transform(
            [916132832, 14776336, 238328, 3844, 62, 1], lambda d: substr(
                '{BASE62}', cast(1 + {_CRC.format("value[1:30]")} // d % 62 as int), 1)), '')
            = value[31:36] end as holds
    from placed p join docs using (r)
), spans as (
    select r, kind, k, start, kind || ':' || start || ':' || stop as span from tested
    where case k {" ".join(f"when {k} then {rule}" for k, (_, _, rule) in enumerate(_SECRETS))} end
), lists as (
    select r, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access,
        count(*) filter (k = 2) as n_hex, string_agg(span, ',' order by start, k) as spans,
        string_agg(span, ',' order by start, k) filter (k < 3) as base
    from spans group by r
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
    coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join lists using (r)
"""

ORACLES["op10_quality"] = f"""
with docs as (select doc_id, coalesce(text, '') as text from documents
), parts as (
    select doc_id, unnest(string_split(text, chr(10))) as line,
        generate_subscripts(string_split(text, chr(10)), 1) as pos from docs
), lines as (
    select *, {_WORDS.format("line")} as w from parts
), worded as (
    select *, len(w) as n, row_number() over (partition by doc_id, line order by pos) > 1 as again,
        {_COUNT.format("line", "|", 1)} as pipes, {_SYMBOLS.format("line")} as symbols,
        {_COUNT.format("line", "!!", 2)} as shouts,
        regexp_extract_all({_LOWERED.format("line")}, {_listed(["|".join(BOILERPLATE)])}) as phrases from lines where len(w) > 0
), judged as (
    select *, case when again then 'boilerplate'
        when 5 * pipes > {RULES.symbols_per_5_words} * n then 'navigation'
        when 5 * symbols > {RULES.symbols_per_5_words} * n
            or 2 * shouts > {RULES.shouts_per_2_words} * n then 'punctuation'
        when n < {RULES.short_line_words} and len(list_filter(w, lambda x:
            {_LOWERED.format("x")} not in ({_listed(NAVIGATION)}))) = 0 then 'navigation'
        when n < {RULES.short_line_words} and right(w[n], 1) not in ({_listed(TERMINAL)}) then 'punctuation'
        when len(phrases) > 0 and 100 * length(array_to_string(phrases, ''))
            >= {RULES.least_boilerplate_percent} * length(line) then 'boilerplate' end as fault from worded
), by_line as (
    select doc_id, sum(again::int) as n_dup_lines, count(fault) as n_removed_lines,
        sum(case when fault is not null then length(line) else 0 end) as removed_chars,
        sum(length(line)) as line_chars,
        count(*) filter (fault = 'punctuation') as failed_punctuation,
        count(*) filter (fault = 'navigation') as failed_navigation,
        count(*) filter (fault = 'boilerplate') as failed_boilerplate from judged group by doc_id
), words as (select doc_id, text, {_WORDS.format("text")} as w from docs
), windows as (
    select doc_id, unnest(range(1, len(w) - 1)) as pos,
        unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) as g
    from words where len(w) >= 3
), often as (select doc_id, pos, count(*) over (partition by doc_id, g) as c from windows
), covered as (
    select doc_id, count(distinct pos + k) as n_repeat_words
    from often cross join range(3) t(k) where c > 1 group by doc_id
), counts as (
    select w.doc_id, cast(len(w) as bigint) as n_words,
        cast(coalesce(length(array_to_string(w, '')), 0) as bigint) as word_chars,
        cast({_SYMBOLS.format("text")} as bigint) as n_symbols,
        cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, l.* exclude (doc_id)
    from words w left join covered c using (doc_id) left join by_line l using (doc_id)
), base as (
    select *, n_words < {RULES.least_words}
        or 100 * n_repeat_words > {RULES.most_repeated_percent} * n_words as base_failed from counts
)
select doc_id, n_words, word_chars, n_symbols, n_repeat_words, base_failed,
    {", ".join(f"cast(coalesce({c}, 0) as bigint) as {c}" for c in (
        "n_dup_lines", "n_removed_lines", "removed_chars", "line_chars", "failed_punctuation",
        "failed_navigation", "failed_boilerplate"))},
    not base_failed and 100 * coalesce(removed_chars, 0)
        <= {RULES.most_removed_percent} * coalesce(line_chars, 0) as kept
from base
"""

# The checksum of an id is CRC-32 of its decimal digits, bit by bit.
ORACLES["op12_trie"] = """
with turns as (
    select conv_id as c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as t, row_number() over (
        partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
    from conversations where conv_id is not null
), own as (
    select c, list(t order by pos) as l, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(
        string_split(cast(c as varchar), ''), lambda s: cast(ascii(s) as bigint))), lambda a, b: list_reduce(
        list_prepend(xor(a, b), range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384)
            else x >> 1 end)), 4294967295) % 6 as h from turns group by c
), rebuilt as (
    select o.c, list_concat(coalesce(b.l[1:o.h], []), o.l[o.h + 1:]) as l
    from own o left join own b on b.c = o.c - o.c % 100
), steps as (select c, l, unnest(range(0, len(l) + 1)) as depth from rebuilt
), nodes as (
    select depth, l[1:depth] as path, min(c) as conv_id, count(*) as n_convs,
        sha256(coalesce(array_to_string(list(c order by c) filter (len(l) = depth), ','), '')) as ends_sha256
    from steps group by all
), valued as (
    select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes k
        where k.depth = n.depth + 1 and k.path[1:n.depth] = n.path) as n_children
    from nodes n left join nodes p on p.depth = n.depth - 1 and p.path = n.path[1:n.depth - 1]
), above as (
    select unnest(range(0, depth + 1)) as d, path, n_children,
        case when depth = 0 then 0 else (n_convs - 1) * length(path[depth].text) end as saved from valued
), sums as (
    select d as depth, path[1:d] as path, cast(count(*) filter (n_children = 0) as bigint) as n_leaves,
        cast(sum(saved) as bigint) as saved_tokens from above group by all
)
select v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
from valued v join sums s on s.depth = v.depth and s.path = v.path
"""

ORACLES["op13_hard_negatives"] = """
with units as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
    select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_sum(
        list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score
    from units a join units b on a.vec_id != b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0
), positives as (
    select anchor_id, id as positive_id, score as positive_score from pairs where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id, cast(row_number() over best as int) as rank, id as negative_id,
    positive_score, score as negative_score
from positives join pairs using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window best as (partition by anchor_id, positive_id order by score desc, id)
qualify row_number() over best <= 5
"""
