"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

OP5 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) d from pages),
     m as (select d, max(page_id) last from p where n >= 1000 group by d)
select p.page_id, cast(p.n as bigint) payload_bytes, p.d payload_digest,
       case when p.n < 1000 or p.page_id = m.last then 'response' else 'revisit' end record_type,
       case when p.n < 1000 or p.page_id = m.last then null else m.last end refers_to
from p left join m on p.d = m.d
"""

OP6 = r"""
with recursive
rules(host, start, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p as (select page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) path from pages),
fit as (select p.page_id, r.host || r.start rule, r.verdict, row_number() over (partition by p.page_id order by length(r.host || r.start) desc) k
        from p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.start)),
ruled as (select p.page_id, p.host, p.path, f.rule, f.verdict ruled from p left join fit f on f.page_id = p.page_id and f.k = 1),
links as (select src, dst, count(*) n from (
            select host src, translate(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?[a-z][a-z0-9+.-]*://([^/?#"''\s>]*)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') dst from p)
          where src <> dst and src <> '' and dst <> '' group by src, dst),
ahead as (select src, dst, n / sum(n) over (partition by src) w from links),
back as (select dst src, src dst, n / sum(n) over (partition by dst) w from links),
seeds as (select host, count(case when ruled = 'allow' then 1 end) good, count(case when ruled = 'block' then 1 end) bad from ruled group by host),
trust0 as (select host, good / cast(sum(good) over () as double) * (1 - 0.85) s from seeds),
distrust0 as (select host, bad / cast(sum(bad) over () as double) * (1 - 0.85) s from seeds),
trust(r, host, s) as (select 0, host, s from trust0 where s > 0
    union all select r + 1, dst, sum(0.85 * s * w) from trust join ahead on src = host where r < 160 group by r, dst),
distrust(r, host, s) as (select 0, host, s from distrust0 where s > 0
    union all select r + 1, dst, sum(0.85 * s * w) from distrust join back on src = host where r < 160 group by r, dst),
t as (select host, sum(s) s from trust group by host),
d as (select host, sum(s) s from distrust group by host)
select ruled.page_id, ruled.host, ruled.path, ruled.rule,
       coalesce(ruled.ruled, case when coalesce(d.s, 0) > coalesce(t.s, 0) then 'block' else 'allow' end) verdict
from ruled left join t on t.host = ruled.host left join d on d.host = ruled.host
"""

_WORDS = r"w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents)"

OP7 = f"""
with {_WORDS},
win as (select doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) h from (select doc_id, ws, unnest(range(1, len(ws) - 48)) i from w)),
least as (select h, min(doc_id) lo from win group by h),
bad as (select win.doc_id, win.i, win.i + 49 j from win join least using (h) where least.lo < win.doc_id),
word as (select doc_id, ws[p] word, p from (select doc_id, ws, unnest(range(1, len(ws) + 1)) p from w)),
gone as (select word.doc_id, word.p, word.word, max(b.i) over (partition by word.doc_id order by word.p rows between 49 preceding and current row) last
         from word left join bad b on b.doc_id = word.doc_id and b.i = word.p),
kept as (select doc_id, count(*) n, count(last) r, array_to_string(list(word order by p) filter (where last is null), ' ') k from gone group by doc_id)
select w.doc_id, cast(coalesce(n, 0) as bigint) n_words, cast(coalesce(r, 0) as bigint) n_removed, sha256(coalesce(k, '')) kept_sha256
from w left join kept using (doc_id)
"""

OP8 = f"""
with recursive {_WORDS},
same as (select doc_id, ws, min(doc_id) over (partition by ws) same_as from w where len(ws) > 0),
one as (select doc_id, ws from same where doc_id = same_as),
sh as (select doc_id, s, count(*) c from (select doc_id, array_to_string(ws[i:i + 4], ' ') s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) i from one)) group by doc_id, s),
size as (select doc_id, sum(c) n from sh group by doc_id),
pair as (select x.doc_id a, y.doc_id b, sum(least(x.c, y.c)) o from sh x join sh y on x.s = y.s and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
link as (select a, b from pair join size p on p.doc_id = a join size q on q.doc_id = b where o >= 0.8 * (p.n + q.n - o)),
both_ as (select a, b from link union all select b, a from link),
reach(id, low) as (select doc_id, doc_id from one union select both_.b, reach.low from reach join both_ on both_.a = reach.id),
class as (select id, min(low) class_id from reach group by id)
select w.doc_id, coalesce(class.class_id, w.doc_id) class_id, coalesce(same.same_as, w.doc_id) same_as
from w left join same using (doc_id) left join class on class.id = same.same_as
"""

#: Of operator 9. Tokens, of which name words that follow one another are joined; templates; windows; hits by diagonal; words at odds.
OP9 = r"""
with cutw as (select src, id, string_split(array_to_string(list_transform(string_split(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '),
                     lambda x: regexp_replace(x, '^(.*[0-9])((?i:UNITS)[.,;:!?"'')]*)$', '\1 \2')), ' '), ' ') r
              from (select 'd' src, doc_id id, text from documents union all select 'b', item_id, text from benchmark) where id is not null),
tok as (select src, id, i, r[i] w, coalesce(r[i - 1], '') before from (select src, id, r, unnest(range(1, len(r) + 1)) i from cutw)),
nam as (select *, regexp_matches(w, '^["''(]{0,3}\p{Lu}') and lower(regexp_extract(w, '^["''(]{0,3}([\p{L}\p{N}]+)', 1)) not in (COMMON)
                  and not regexp_full_match(lower(regexp_extract(w, '^["''(]{0,3}([\p{L}\p{N}]+)', 1)), 'SPELLED')
                  and not (regexp_matches(before, '[0-9]$') and regexp_matches(w, '^(?i:UNITS)[.,;:!?"'')]*$')) is_name from tok),
tie as (select *, is_name and coalesce(lag(is_name) over o, false) and not regexp_matches(before, '[ .,;:!?"'')]$') tied from nam window o as (partition by src, id order by i)),
grp as (select *, sum(case when tied then 0 else 1 end) over (partition by src, id order by i) g from tie),
joined as (select src, id, g, string_agg(w, ' ' order by i) w, bool_or(is_name) is_name from grp group by src, id, g),
num as (select *, case when is_name then '<name>' else regexp_replace(regexp_replace(w, '^(["''(]{0,3})(?i:SPELLED(?:-SPELLED)*)([.,;:!?"'')]*)$', '\1<num>\2'), '^(["''(+$€£-]{0,3})[0-9](?:[^ ]*[^ .,;:!?"'')])?', '\1<num>') end t from joined),
uni as (select *, case when not is_name and ends_with(coalesce(lag(t) over o, ''), '<num>') then regexp_replace(t, '^(?i:UNITS)([.,;:!?"'')]*)$', '<unit>\1') else t end u from num window o as (partition by src, id order by g)),
word as (select src, id, cast(g as bigint) k, lower(regexp_replace(w, '^["''(]+|[.,;:!?"'')]+$', '', 'g')) v, regexp_replace(regexp_replace(lower(u), '[.,;:!?"'')]+$', ''), '^["''(+$€£-]+', '') c from uni),
canon as (select src, id, list(c order by k) c, list(case when c in ('<num>', '<unit>', '<name>') then c || v end order by k) f from word group by src, id),
alike as (select id, c, f, list_transform(f, lambda x: case when x is null then 0 else list_position(f, x) end) e from canon where src = 'b'),
of_one as (select min(id) variant, c from alike group by c, e),
variant as (select variant, min(variant) over (partition by c) item_id, c from of_one),
bw as (select variant, item_id, p, array_to_string(c[p:p + 7], ' ') h, len(list_filter(c[p:p + 7], lambda x: x in ('<num>', '<unit>', '<name>'))) <= 6 counted from (select *, unnest(range(1, len(c) - 6)) p from variant)),
need as (select variant, least(6, max(n)) need from (select variant, count(*) n from (select variant, p - row_number() over (partition by variant order by p) g from bw where counted) group by variant, g) group by variant),
dw as (select id doc_id, p, array_to_string(c[p:p + 7], ' ') h from (select *, unnest(range(1, len(c) - 6)) p from canon where src = 'd')),
touch as (select dw.doc_id, bw.item_id, bw.variant, bw.p, dw.p - bw.p dg, bw.counted from dw join bw using (h)),
slot as (select id variant, k, c || v "of", v was from word where src = 'b' and c in ('<num>', '<unit>', '<name>')),
val as (select id doc_id, k, v from word where src = 'd'),
cell as (select t.*, s.k, s."of", s.was, v.v is_ from touch t join slot s on s.variant = t.variant and s.k between t.p and t.p + 7 join val v on v.doc_id = t.doc_id and v.k = s.k + t.dg),
wrong as (select distinct doc_id, variant, p, dg from cell where is_ <> was and not counted),
hit as (select t.*, min(p) over (partition by doc_id, variant, dg, g) s from (select *, p - row_number() over (partition by doc_id, variant, dg order by p) g from touch anti join wrong using (doc_id, variant, p, dg)) t),
placed as (select distinct c.doc_id, c.variant, c.dg, c.k, c."of", c.was, c.is_ from cell c anti join wrong w using (doc_id, variant, p, dg)),
odds as (select a.doc_id, a.variant, a.dg, a.k p, b.k q from placed a join placed b on a.doc_id = b.doc_id and a.variant = b.variant and a.dg = b.dg and a."of" = b."of" and a.is_ <> b.is_ and a.k < b.k),
len as (select h.doc_id, h.item_id, h.variant, h.dg, h.p, h.s, greatest(h.s, coalesce(max(o.p) + 1, h.s)) first from hit h left join odds o on o.doc_id = h.doc_id and o.variant = h.variant and o.dg = h.dg and o.q <= h.p + 7 group by h.doc_id, h.item_id, h.variant, h.dg, h.p, h.s),
same as (select h.doc_id, h.variant, h.dg, h.p, greatest(h.s, coalesce(max(x.k) + 1, h.s)) first from hit h left join placed x on x.doc_id = h.doc_id and x.variant = h.variant and x.dg = h.dg and x.is_ <> x.was and x.k <= h.p + 7 group by h.doc_id, h.variant, h.dg, h.p, h.s),
diag as (select l.doc_id, l.item_id, l.variant, l.dg, max(l.p - l.s + 1) run, max(l.p - l.first + 1) most, max(s.p - s.first + 1) exact from len l join same s using (doc_id, variant, dg, p) group by l.doc_id, l.item_id, l.variant, l.dg),
state as (select d.*, n.need, exists (select 1 from odds o where o.doc_id = d.doc_id and o.variant = d.variant and o.dg = d.dg) odd, exists (select 1 from placed x where x.doc_id = d.doc_id and x.variant = d.variant and x.dg = d.dg and x.is_ <> x.was) other from diag d join need n using (variant)),
leak as (select doc_id, item_id, max(most + 7) words, bool_and(case when odd then exact < need else other end) changed from state where run >= need and most >= need group by 1, 2),
lit as (select src, id, list(regexp_replace(regexp_replace(lower(w), '[.,;:!?"'')]+$', ''), '^["''(]+', '') order by i) l from tok group by src, id),
litem as (select l, min(item) item_id, least(len(l), 8) size, least(6, len(l) - least(len(l), 8) + 1) need from (
            select lit.l, min(lit.id) over (partition by c.c) item from lit join canon c on c.src = 'b' and c.id = lit.id where lit.src = 'b' and regexp_matches(array_to_string(lit.l, ' '), '[\p{L}\p{N}]')) group by l),
lw as (select l, item_id, size, need, p, array_to_string(l[p:p + size - 1], ' ') h from (select *, unnest(range(1, len(l) - size + 2)) p from litem)),
dl as (select id doc_id, size, p, array_to_string(l[p:p + size - 1], ' ') h from (select *, unnest(range(1, len(l) - size + 2)) p from lit cross join (select distinct size from litem) where src = 'd')),
exact as (select doc_id, item_id, max(n + size - 1) words from (select doc_id, item_id, l, size, need, dg, count(*) n from (
            select *, p - row_number() over (partition by doc_id, l, dg order by p) g from (select distinct dl.doc_id, lw.item_id, lw.l, lw.size, lw.need, lw.p, dl.p - lw.p dg from dl join lw using (size, h))) group by doc_id, item_id, l, size, need, dg, g)
          where n >= need group by 1, 2)
select doc_id, item_id, cast(coalesce(leak.words, exact.words) as integer) words, coalesce(leak.changed, false) changed from leak full join exact using (doc_id, item_id)
"""


def op9() -> str:
    from .decontam import COMMON, SPELLED, UNITS

    return OP9.replace("SPELLED", SPELLED).replace("UNITS", UNITS).replace("COMMON", ", ".join(f"'{w}'" for w in COMMON))

#: CRC-32 by its table, words by wildcards: each word without one of its letters, and with one of them masked.
OP13 = r"""
with recursive
steps(i, c, k) as (select range, range, 0 from range(256) union all select i, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, k + 1 from steps where k < 8),
tab as (select list(c order by i) t from steps where k = 8),
runs as (select id, run, length(run) size, count(*) n from (
           select coalesce(cast(doc_id as varchar), '') id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) run from documents) group by all),
bytes as (select *, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)] else [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] end)) b from runs),
crcs as (select run, size, n, xor(list_reduce([4294967295::bigint] || b::bigint[], lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) h from bytes cross join tab),
words as (select word, cast(sum(n) as bigint) n from (select case when h % 97 = 0 then left(run, h % size) || substr(run, h % size + 2) else run end word, n from crcs) where length(word) >= 5 group by word having sum(n) >= 3),
spots as (select word, n, unnest(range(1, length(word) + 1)) i from words),
masked as (select word, n, left(word, i - 1) || '*' || substr(word, i + 1) p from spots),
less as (select distinct word, n, left(word, i - 1) || substr(word, i + 1) p from spots),
near as (select a.word, a.n own, b.word other, b.n from masked a join masked b on a.p = b.p and a.word <> b.word
         union all select l.word, l.n, w.word, w.n from less l join words w on l.p = w.word
         union all select w.word, w.n, l.word, l.n from less l join words w on l.p = w.word),
best as (select word, count(*) n_near, first(other order by n desc, other) form, max(n) form_n from near group by word),
forms as (select w.word, w.n, coalesce(b.n_near, 0) n_near, case when b.form_n >= 2 * w.n then b.form end form, case when b.form_n >= 2 * w.n then b.form_n end form_n from words w left join best b using (word)),
up(word, stop) as (select word, word from forms union all select up.word, f.form from up join forms f on f.word = up.stop where f.form is not null)
select f.word, f.form, up.stop root, f.n, f.n_near, f.form_n from forms f join up using (word) join forms e on e.word = up.stop and e.form is null
"""


def op12(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """All distances to all entries, once for each round and once more."""
    ctes = [f"""
v as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) z from embeddings
      where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
x as materialized (select vec_id, i // (len(z) // {parts}) part, i % (len(z) // {parts}) pos, z[i + 1] x from (select vec_id, z, unnest(range(len(z))) i from v)),
first as (select vec_id, row_number() over (order by vec_id) - 1 entry from v qualify entry < {entries}),
c0 as materialized (select part, entry, pos, x c from x join first using (vec_id))"""]
    for r in range(rounds + 1):
        ctes.append(f"d{r} as (select vec_id, part, entry, cast(sum((x - c) * (x - c)) as bigint) d from x join c{r} using (part, pos) group by all)")
        ctes.append(f"n{r} as materialized (select vec_id, part, entry, d from d{r} qualify row_number() over (partition by vec_id, part order by d, entry) = 1)")
        if r < rounds:
            ctes.append(f"s{r} as (select part, entry, pos, cast(sum(x) as bigint) s, count(*) n from x join n{r} using (vec_id, part) group by all)")
            ctes.append(f"c{r + 1} as materialized (select c.part, c.entry, c.pos, coalesce((s - ((s % n) + n) % n) // n, c) c from c{r} c left join s{r} using (part, entry, pos))")
    return f"""with {", ".join(ctes)},
own as (select vec_id, string_agg(printf('%02x', entry), '' order by part) code, cast(sum(d) as bigint) error from n{rounds} group by vec_id),
sha as (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, pos)) s from c{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, s codebooks_sha256 from own join v using (vec_id) cross join sha"""


def _template_expression(parts) -> str:
    """A template as an expression over words that end in a space each."""
    out = []
    for p in parts:
        if p.word:
            out.append(p.word + " ")
        elif p.ways:
            out.append(f"(?:{'|'.join(map(_template_expression, p.ways))})")
        else:
            out.append(f"(?:[^ ]+ ){{{p.least},{p.most}}}")
    return "".join(out)


def op11() -> str:
    """Templates as expressions over the words of a text, joined by spaces; phrases by the places of their words."""
    from .licenses import PHRASES, TEMPLATES, parse

    q = lambda s: "'" + s.replace("'", "''") + "'"
    own = " union all ".join(f"select doc_id, {q(label)} label from j where regexp_matches(j, {q(' ' + _template_expression(parse(t)))})" for label, t in TEMPLATES)
    places = " union all ".join(f"select doc_id, {q(label)} label, i - 1 start from at1 where ws[i:i + {len(t.split()) - 1}] = {t.split()!r}" for label, t in PHRASES)
    return rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
j as (select doc_id, ' ' || array_to_string(ws, ' ') || ' ' j from w),
at1 as (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from w),
base as ({places}),
own as ({own}),
b as (select doc_id, count(*) n, min(start) lo, max(start) hi, string_agg(distinct label, ',' order by label) labels from base group by doc_id),
l as (select doc_id, string_agg(distinct label, ',' order by label) labels from (select doc_id, label from base union all select * from own) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) n_words, coalesce(b.n, 0) n_base, b.lo first_word, b.hi last_word, coalesce(b.labels, '') base_labels, coalesce(l.labels, '') labels,
       case when w.doc_id in (select doc_id from own) then 1.0::double when b.n > 0 then 0.5 else 0 end score
from w left join b using (doc_id) left join l using (doc_id)
"""
