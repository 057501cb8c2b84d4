"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, huffman, jaccard, licenses, lines, packing, periodic, quality, secrets, sharding, spelling, substrings, warc
from .common import materialize, read

QUERIES = {
    "op1_packing": lambda spark, d: packing.packed(read(spark, d, "documents")),
    "op2_decontamination": lambda spark, d: decontaminate.report(read(spark, d, "documents"), read(spark, d, "benchmark")).drop("spans"),
    "op3_warc": lambda spark, d: warc.round_trip(read(spark, d, "pages")).drop("url"),
    "op4_licenses": lambda spark, d: licenses.report(read(spark, d, "documents")),
    "op5_substring_dedup": lambda spark, d: substrings.report(read(spark, d, "documents")),
    "op6_line_dedup": lambda spark, d: lines.report(read(spark, d, "documents")),
    "op7_sharding": lambda spark, d: sharding.shards(read(spark, d, "documents")),
    "op8_secrets": lambda spark, d: secrets.report(read(spark, d, "documents")).drop("blob"),
    "op9_jaccard": lambda spark, d: jaccard.report(read(spark, d, "documents")),
    "op10_quality_rules": lambda spark, d: quality.verdicts(read(spark, d, "documents")).drop("fail_bits"),
    "op11_spelling": lambda spark, d: spelling.report(read(spark, d, "documents")),
    "op12_token_ids": lambda spark, d: huffman.round_trip(read(spark, d, "documents")),
    "op13_periodic_runs": lambda spark, d: periodic.report(read(spark, d, "documents")),
    "quality_ablations": lambda spark, d: quality.ablations(materialize(quality.ledger(read(spark, d, "documents")), "ledger")),
}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"

_OP2 = rf"""
with dw as (select doc_id, regexp_extract_all({_LOW}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') w from documents),
iw as (select coalesce(item_id::varchar, 'null') item, regexp_extract_all({_LOW}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') w from benchmark),
win as (select distinct item, least(13, len(w)) k, w[p:p + least(13, len(w)) - 1] x from iw, unnest(generate_series(1, greatest(1, len(w) - 12))) u(p) where len(w) > 0),
sizes as (select distinct k from win),
dwin as (select doc_id, k, p, w[p:p + k - 1] x from dw, sizes, unnest(generate_series(1, len(w) - k + 1)) u(p) where len(w) >= k),
m as (select doc_id, p, d.k, item from dwin d join win using (k, x)),
hit as (select doc_id, count(distinct q) n_hit from m, unnest(generate_series(p, p + k - 1)) v(q) group by 1),
its as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) s from m group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from dw left join hit using (doc_id) left join its using (doc_id)"""

_OP3 = """
with p as (select page_id, coalesce(html, '') h, max(page_id) over (partition by coalesce(html, '')) top, sha1(coalesce(html, '')) x from pages)
select page_id, strlen(h)::bigint payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (i // 4) * 5 + 1, 5))::int >> (15 - 5 * (i % 4))) & 31) + 1)::int, 1)), '') payload_digest,
  case when page_id = top then 'response' else 'revisit' end record_type, case when page_id <> top then top end refers_to
from p"""

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^0-9a-z]+'), lambda x: x <> '')"

_TEXTS = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate((n, t) for n, texts in sorted(licenses.TEMPLATES.items()) for t in texts))

#: The templates' texts are values that both sides share; the rule is written out. Every run, paragraph and license file is scored here.
_OP4 = rf"""
with t(i, name, txt) as (values {_TEXTS}),
voc as (select i, v, count(*) n from (select i, unnest({_TOKENS.format("txt")}) v from t) group by all),
idf as (select v, ln((1 + (select count(*) from documents)) / (1 + coalesce(df, 0))) + 1.0 idf from (select distinct v from voc)
  left join (select v, count(*) df from (select distinct doc_id, unnest({_TOKENS.format("text")}) v from documents) group by v) using (v)),
w as (select i, v, n * idf w from voc join idf using (v)),
len as (select i, sqrt(sum(w * w)) tot from w group by i),
f0 as (select doc_id, lower(coalesce(text, '')) low, concat_ws('/', source, lang, case when doc_id % 50 <> 0 then 'd' || (doc_id // 100) end) dir, case when doc_id % 25 = 0 then 'LICENSE' else 'f' || doc_id end nm from documents),
l as (select doc_id, j, x from (select doc_id, list_filter(string_split(low, E'\n'), lambda x: regexp_matches(x, '[0-9a-z]')) ls from f0), unnest(ls) with ordinality u(x, j)),
u as (select doc_id, x from l union select doc_id, x || ' ' || lead(x) over (partition by doc_id order by j) from l union select doc_id, x || ' ' || lead(x) over (partition by doc_id order by j) || ' ' || lead(x, 2) over (partition by doc_id order by j) from l
  union select doc_id, unnest(regexp_split_to_array(low, '\n[^0-9a-z]*\n')) from f0 union select doc_id, low from f0 where nm = 'LICENSE'),
c as (select doc_id, x, v, count(*) n from (select doc_id, x, unnest({_TOKENS.format("x")}) v from u where x is not null) group by all),
cw as (select doc_id, x, v, n * coalesce(idf, (select max(idf) from idf)) y from c left join idf using (v)),
nr as (select doc_id, x, sum(y * y) nn from cw group by all),
sc as (select doc_id, i, round(max(dot / (sqrt(nn) * tot)), 6) s from (select doc_id, x, i, sum(y * w) dot from cw join w using (v) group by all) join nr using (doc_id, x) join len using (i) group by all),
best as (select doc_id, s, name from (select *, row_number() over (partition by doc_id order by s desc, i) rn from sc) join t using (i) where rn = 1 and s >= 0.8),
f as (select doc_id, dir, nm, name own, s from f0 left join best using (doc_id)),
li as (select dir above, arg_max(own, (s, own)) lic from f where nm = 'LICENSE' and own is not null group by dir),
near as (select dir, arg_max(lic, length(above)) lic, arg_max(above, length(above)) above from (select distinct dir from f) join li on dir = above or starts_with(dir, above || '/') group by dir)
select doc_id, dir || '/' || nm path, own own_license, s own_score, coalesce(own, lic) license, case when own is not null then 'own' else above end license_from from f left join near using (dir)"""

_OP6 = r"""
with l as (select doc_id, text, i - 1 i, x, trim(x, E' \t\n\x0b\x0c\r') t from (select doc_id, text, string_split(text, E'\n') ls from documents), unnest(ls) with ordinality u(x, i)),
s as (select doc_id, i, t, row_number() over (partition by doc_id order by i) - 1 j from l where t <> ''),
w as (select doc_id, j, t, lead(t, 1) over o t1, lead(t, 2) over o t2 from s window o as (partition by doc_id order by j)),
r as (select doc_id, j, row_number() over (partition by t, t1, t2 order by doc_id, j) rn from w where t2 is not null),
c as (select distinct doc_id, j + k j from r, unnest([0, 1, 2]) u(k) where rn > 1),
e as (select c.doc_id, s.i, n.i nxt from c join s using (doc_id, j) left join c c2 on c2.doc_id = c.doc_id and c2.j = c.j + 1 left join s n on n.doc_id = c2.doc_id and n.j = c2.j),
g as (select distinct doc_id, q i from e, unnest(generate_series(i, coalesce(nxt - 1, i))) u(q))
select l.doc_id, coalesce(string_agg(x, E'\n' order by l.i) filter (where g.i is null), '') as "text", count(*) n_lines, count(g.i) n_removed
from l left join g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id"""

_OP9 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOW}, '{_SPACED}') w from documents),
sh as (select distinct doc_id, w[p:p + 4] x from w, unnest(generate_series(1, greatest(1, len(w) - 4))) u(p) where len(w) > 0),
n as (select doc_id, count(*) n from sh group by 1),
shared as (select a.doc_id a, b.doc_id b, count(*) k from sh a join sh b on a.x = b.x and a.doc_id < b.doc_id group by all),
link as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
sym as (select a, b from link union select b, a from link),
reach(d, c) as (select a, a from sym union select d, b from reach join sym on a = c)
select w.doc_id, coalesce(n.n, 0) n_shingles, coalesce(least(w.doc_id, min(c)), w.doc_id) component_id from w left join n using (doc_id) left join reach on d = w.doc_id group by w.doc_id, n.n"""

_MEASURED = rf"""
with t as (select doc_id, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') w, list_filter(string_split(coalesce(text, ''), E'\n'), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls from documents),
g as (select doc_id, p, w[p:p + 4] x from t, unnest(generate_series(1, len(w) - 4)) u(p) where len(w) >= 5),
r as (select doc_id, count(distinct q) n from (select doc_id, p, count(*) over (partition by doc_id, x) c from g), unnest(generate_series(p, p + 4)) u(q) where c > 1 group by 1),
m as (select doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, len(ls) n_lines,
  coalesce(n, 0) n_repeat_words, len(regexp_extract_all(text, '!')) ex, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) up,
  len(regexp_extract_all(text, '[\x{{0E00}}-\x{{0EFF}}\x{{1000}}-\x{{109F}}\x{{1780}}-\x{{17FF}}\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{20000}}-\x{{3FFFF}}]')) unspaced from t left join r using (doc_id))"""

_OP10 = _MEASURED + """,
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > 3 * n_words or 2 * ex > n_words or (up > 20 and 2 * up > word_chars) or word_chars - unspaced > 40 * n_words) kept from b"""

_ABLATIONS = _MEASURED + """,
f as (select [n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > 3 * n_words, 2 * ex > n_words, up > 20 and 2 * up > word_chars, word_chars - unspaced > 40 * n_words, 2 * n_dup_lines > n_lines]::int[] v from m),
p(policy, rules, tolerated) as (values ('base', [1, 2], 0), ('standard', [1, 2, 3, 4, 5, 6], 0), ('lenient', [1, 2, 3, 4, 5, 6, 7], 1)),
e as (select policy, r, tolerated, list_sum(list_transform(rules, lambda k: v[k])) fails, v[r] own from f, p, unnest(rules) u(r))
select policy, ['few_words', 'repeat_words', 'symbol_heavy', 'shouting', 'capitals', 'long_words', 'repeat_lines'][r] "rule",
  count(*) filter (where fails <= tolerated) kept_with, count(*) filter (where fails - own <= tolerated) kept_without from e group by all"""

#: ``tab`` is the table of the checksum, from its rule; near words share what is left without one character.
_OP11 = r"""
with recursive t as materialized (select list(c order by i) tab from (select i, list_reduce(list_prepend(i::bigint, [1, 2, 3, 4, 5, 6, 7, 8]::bigint[]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from generate_series(0, 255) g(i))),
r as (select coalesce(doc_id::varchar, 'null') id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run from documents),
d as (select id, run, count(*) k, hex(encode(id || ':' || run)) x from r group by id, run),
h as (select run, k, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(generate_series(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) h from d, t),
w as materialized (select word, sum(k)::bigint n from (select k, case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word from h) where length(word) >= 5 group by word having sum(k) >= 3),
cut as materialized (select word, n, length(word) size, i, left(word, i::int - 1) || substr(word, i::int + 1) part from w, unnest(generate_series(1, length(word))) u(i)),
near as materialized (select distinct a.word, b.word near, b.n m from cut a join cut b on a.part = b.part and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from cut a join w b on a.part = b.word union select b.word, a.word, a.n from cut a join w b on a.part = b.word),
best as materialized (select w.word, w.n, count(near) n_near, arg_min(near, (-m, near)) b, max(m) m from w left join near using (word) group by w.word, w.n),
f as materialized (select word, n, n_near, case when m >= 2 * n then b end form, case when m >= 2 * n then m end form_n from best),
up(word, root) as (select word, form from f where form is not null union all select up.word, form from up join f on f.word = up.root where form is not null),
ends as (select up.word, up.root from up join f on f.word = up.root where f.form is null)
select f.word, form, coalesce(root, f.word) root, n, n_near, form_n from f left join ends using (word)"""

ORACLE: dict[str, str] = {"op2_decontamination": _OP2, "op3_warc": _OP3, "op4_licenses": _OP4, "op6_line_dedup": _OP6, "op9_jaccard": _OP9, "op10_quality_rules": _OP10, "op11_spelling": _OP11, "quality_ablations": _ABLATIONS}
