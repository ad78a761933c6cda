"""SQL of the corpus queries that SQL can express, for an independent engine."""

from __future__ import annotations

from .chat import PART_TURNS
from .decontam import NEAR_SPAN, NEAR_TERMS
from .quality import LIMITS, LINE_LIMIT, SYMBOL_LIMIT

_WORDS = r"docs as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents)"

OP1 = f"""
with rows as (select conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') as role, replace(coalesce(text, ''), '<|', '< |') as text from conversations),
people as (select distinct conv_id, role as perspective from rows where role <> 'system'),
lines as (select p.conv_id, perspective, turn, role, text, role = perspective as mine,
  '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then 'system' else 'user name=' || role end || chr(10) as head,
  row_number() over (partition by p.conv_id, perspective order by turn nulls first, role, text) - 1 as k
  from rows join people p on p.conv_id is not distinct from rows.conv_id),
placed as (select *, (k // {PART_TURNS})::bigint as part, coalesce(sum(length(head) + length(text) + 11) over (partition by conv_id, perspective order by k rows between unbounded preceding and 1 preceding), 0)::bigint as pos from lines)
select conv_id, part, perspective, min(pos) as start, count(*)::bigint as n_turns, count(*) filter (where mine)::bigint as n_target_turns,
  coalesce(sum(length(text)) filter (where mine), 0)::bigint as n_target_chars,
  string_agg(head || text || '<|im_end|>' || chr(10), '' order by k) as text,
  coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(text)), ',' order by k) filter (where mine), '') as spans
from placed group by conv_id, part, perspective
"""

OP2 = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
sized as (select doc_id, h, length(h) // 2 as n from docs),
wins as (select doc_id, i, substring(h, (2 * i + 1)::bigint, 400) as g from sized, unnest(range(0, greatest(n - 199, 0))) as u(i)),
rep as (select g from wins group by g having count(*) > 1),
starts as (select doc_id, i from wins semi join rep using (g)),
marked as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as new from starts),
island as (select *, sum(new) over (partition by doc_id order by i) as k from marked),
spans as (select doc_id, min(i) as a, max(i) + 200 as b from island group by doc_id, k),
gaps as (select doc_id, lag(b, 1, 0) over (partition by doc_id order by a) as a, a as b from spans union all select doc_id, max(b), null from spans group by doc_id),
kept as (select g.doc_id, string_agg(substring(h, (2 * g.a + 1)::bigint, (2 * (coalesce(g.b, n) - g.a))::bigint), '' order by g.a) as left_over from gaps g join sized s on s.doc_id = g.doc_id group by g.doc_id),
sums as (select doc_id, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans from spans group by doc_id)
select s.doc_id, s.n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(left_over, h))) as kept_sha256
from sized s left join sums using (doc_id) left join kept using (doc_id)
"""

OP5 = f"""
with {_WORDS},
wins as (select doc_id, i, list_slice(w, i, i + 19) as g from docs, unnest(range(1, greatest(len(w) - 18, 1))) as u(i)),
ranked as (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from wins),
gone as (select distinct doc_id, (i + o)::bigint as p from ranked, unnest(range(0, 20)) as v(o) where k > 1),
words as (select doc_id, p, w[p] as word from docs, unnest(range(1, len(w) + 1)) as u(p)),
kept as (select doc_id, string_agg(word, ' ' order by p) as text from words anti join gone using (doc_id, p) group by doc_id),
removed as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(r.n, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from docs d left join removed r using (doc_id) left join kept k using (doc_id)
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
with docs as (select doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from documents),
items as (select item_id::varchar as item, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from benchmark),
wanted as (select distinct item, least(len(w), 10) as n, list_slice(w, i, i + 9) as g from items, unnest(range(1, greatest(len(w) - 8, 2))) as u(i) where len(w) > 0),
lengths as (select distinct n from wanted),
wins as (select doc_id, i, n, list_slice(w, i, i + n - 1) as g from docs, lengths, unnest(range(1, greatest(len(w) - n + 2, 1))) as u(i)),
hits as (select doc_id, i, wins.n, item from wins join wanted using (n, g)),
covered as (select doc_id, count(distinct i + o)::bigint as n_hit from hits, unnest(range(0, 10)) as v(o) where o < n group by doc_id),
found as (select doc_id, count(*)::bigint as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hits) group by doc_id),
numbered as (select row_number() over () as k, item, w from items),
terms as (select k, item, word, min(p) as first from (select k, item, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from numbered) group by all),
places as (select doc_id, word, p from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from docs) semi join terms using (word)),
counts as (select word, count(*) as n from places group by word),
needed as (select k, least({NEAR_TERMS}, count(*)) as m from terms group by k),
ranked as (select k, item, word, m, row_number() over (partition by k order by n, first) as j from terms join counts using (word) join needed using (k)),
keyed as (select *, count(*) over (partition by k) as held from ranked where j <= m),
stands as (select k, item, m, word, doc_id, p from keyed join places using (word) where held = m),
near as (select distinct a.doc_id, a.item from stands a join stands b on a.k = b.k and a.doc_id = b.doc_id and b.p between a.p and a.p + {NEAR_SPAN - 1} group by a.k, a.item, a.doc_id, a.p, a.m having count(distinct b.word) = a.m),
nearby as (select doc_id, count(*)::bigint as n_near_items from near group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near_items, 0)::bigint as n_near_items
from docs d left join covered using (doc_id) left join found using (doc_id) left join nearby using (doc_id)
"""

OP7 = rf"""
with recursive docs as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
grams as (select distinct doc_id, list_slice(w, i, i + 4) as g from docs, unnest(range(1, greatest(len(w) - 3, 2))) as u(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
reach as (select doc_id as a, doc_id as b from docs union select r.a, l.b from reach r join links l on l.a = r.b),
roots as (select a as doc_id, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from docs d left join sizes using (doc_id) join roots using (doc_id)
"""


def _covered(n: int) -> str:
    return f"""win{n} as (select doc_id, i, list_slice(w, i, i + {n - 1}) as g from docs, unnest(range(1, greatest(len(w) - {n - 2}, 1))) as u(i)),
rep{n} as (select distinct doc_id, i + o as p from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win{n}), unnest(range(0, {n})) as v(o) where c > 1),
cov{n} as (select r.doc_id, count(*)::bigint as words, sum(length(w[p]))::bigint as chars from rep{n} r join docs d on d.doc_id = r.doc_id group by r.doc_id)"""


OP9 = f"""
with {_WORDS}, {", ".join(_covered(n) for n in LIMITS)},
lines as (select doc_id, l, row_number() over (partition by doc_id, l) as k from docs, unnest(string_split(text, chr(10))) as u(l) where regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
again as (select doc_id, count(*)::bigint as n, sum(length(l))::bigint as chars from lines where k > 1 group by doc_id),
base as (select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  coalesce(a.n, 0)::bigint as n_dup_lines, coalesce(cov5.words, 0)::bigint as n_repeat_words, coalesce(a.chars, 0)::bigint as dup_line_chars, {", ".join(f"coalesce(cov{n}.chars, 0)::bigint as dup_chars_{n}" for n in LIMITS)}
  from docs d left join again a using (doc_id) {" ".join(f"left join cov{n} using (doc_id)" for n in LIMITS)}),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base)
select *, not base_failed and dup_line_chars <= {LINE_LIMIT}::double * word_chars and n_symbols <= {SYMBOL_LIMIT}::double * n_words and {" and ".join(f"dup_chars_{n} <= {limit}::double * word_chars" for n, limit in LIMITS.items())} as kept from judged
"""

OP10 = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
first as (select payload_digest, min(page_id) as page_id from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, payload_bytes, p.payload_digest, case when f.page_id <> p.page_id then 'revisit' else 'response' end as record_type, case when f.page_id <> p.page_id then f.page_id end as refers_to, true as complete
from p left join first f on f.payload_digest = p.payload_digest and payload_bytes >= 100
"""
