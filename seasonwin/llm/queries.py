"""One query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonwin.llm import (
    exact_dedup, html_text, line_dedup, merkle, mixing, near_dedup, neighbours, packing, pii, prefix_trie, quality, token_files, toxicity,
)
from seasonwin.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


@query()
def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), capacity=2048, end=0)


@query(rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w from documents),
s as (
  select distinct doc_id, sh from (select doc_id, unnest(case
    when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) sh from d)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (
  select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * k >= 85 * (nx.n + ny.n - k)),
e as (select x a, y b from l union all select y, x from l),
r as (select doc_id as node, doc_id as c from documents union select e.b, r.c from r join e on e.a = r.node),
c as (select node, min(c) c from r group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id, doc_id = c as kept
from documents left join n using (doc_id) join c on c.node = doc_id
""")
def op2_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query()
def op4_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(f"""
with d as (select doc_id, sha256({_LOWER}) h from documents),
g as (select h, max(doc_id) keep_id, count(*) group_size from d group by h)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256 from d join g using (h)
""")
def op6_exact_dedup(spark, sf_dir):
    index = exact_dedup.DigestIndex.new(spark)
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"), index)


@query()
def op7_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder = token_files.new_folder(docs)
    return token_files.read_shards(token_files.write_shards(docs, folder, tokenizer(), end=2), folder)


@query(r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
    md5(coalesce(doc_id::varchar, '') || ':9') h from documents),
s as (
  select source, sum(size)::bigint source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1.0::double w from d group by source),
c as (
  select *, source_size * 3 cap, sum(source_size) over () total,
    coalesce(sum(source_size * 3) over (order by source_size * 3 / w, source nulls last rows between unbounded preceding and 1 preceding), 0) capped,
    sum(w) over () - coalesce(sum(w) over (order by source_size * 3 / w, source nulls last rows between unbounded preceding and 1 preceding), 0) weights
  from s),
l as (select *, (total::double - capped::double) / weights as lvl from c),
t as (
  select source, source_size,
    least(case when (select min(capped) from l where lvl * w <= cap) is null or lvl * w > cap then cap::double
      else (select lvl from l where lvl * w <= cap order by capped, lvl limit 1) * w end, cap::double) target from l),
g as (
  select *, floor(target)::bigint + case when row_number() over (order by target - floor(target) desc, source nulls last)
    <= round(sum(target) over ())::bigint - (sum(floor(target)) over ())::bigint then 1 else 0 end as goal from t),
q as (
  select doc_id, size, t.source_size, t.target, t.goal,
    sum(size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and current row) - size as a
  from d join g t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, sum(greatest(0, least(size, goal - (a + p * source_size))))::bigint as taken
from q, (values (0), (1), (2)) passes(p) group by doc_id, size, source_size, target, goal, a
""")
def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most_passes=3, share=1.0)


@query(r"""
with l as (
  select doc_id, (i - 1)::bigint as line_no, list_distinct(list_filter(regexp_split_to_array(ls[i], '[\x20\x09\x0B-\x0D]+'), lambda x: x <> '')) ws
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) i from (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents))),
s as (select *, len(ws) n from l where len(ws) > 0),
w as (select doc_id, line_no, n, unnest(ws) w from s),
f as (select w, count(*) df from w group by w),
p as (
  select doc_id, line_no, n, w from w join f using (w)
  qualify row_number() over (partition by doc_id, line_no order by df, w) <= n - ceil(n * 4 / 5.0) + 1),
c as (
  select distinct a.doc_id ad, a.line_no al, b.doc_id bd, b.line_no bl from p a join p b using (w)
  where (a.doc_id, a.line_no) < (b.doc_id, b.line_no) and least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4),
v as (
  select bd, bl, len(list_intersect(x.ws, y.ws)) k, x.n + y.n t from c
  join s x on x.doc_id = ad and x.line_no = al join s y on y.doc_id = bd and y.line_no = bl)
select distinct bd as doc_id, bl as line_no, n::bigint as n_words from v join s on s.doc_id = bd and s.line_no = bl where k * 9 >= t * 4
""")
def op5_line_dedup(spark, sf_dir):
    found = line_dedup.repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("line").cast("long").alias("line_no"), "n_words")


@query()
def op3_quality_classifier(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query()
def op8_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


@query()
def op10_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def _crc32(digits: str) -> str:
    """SQL of the crc32 of a text of ASCII signs."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    signs = f"list_transform(string_split({digits}, ''), lambda s: ascii(s)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {signs}), lambda c, b: {step}), 4294967295)"


def _field(name: str, value: str | None = None) -> str:
    text = value or f"{name}::varchar"
    return f"case when {name} is null then '-' else strlen({text}) || ':' || {text} end"


_LEAF = f"{_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || "


@query(f"""
with recursive d as (
  select row_number() over () r, doc_id, lang, coalesce('=' || lang, '') g, sha256({_LEAF}{_field('text')}) leaf,
    case when {_crc32('doc_id::varchar')} % 3 = 0 then sha256({_LEAF}{_field('text', _LOWER)}) else sha256({_LEAF}{_field('text')}) end seen from documents),
p as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos from d),
t as (
  select g, 0 as level, pos, leaf h, count(*) over (partition by g) n from p
  union all
  select g, level + 1, pos // 8, sha256(string_agg(h, '' order by pos)), (max(n) + 7) // 8 from t where n > 1 group by g, level, pos // 8),
s as (select g, h, level, row_number() over (order by g) - 1 as pos, count(*) over () n from t where n = 1),
u as (
  select 0 as level, pos, h, n from s
  union all
  select level + 1, pos // 8, sha256(string_agg(h, '' order by pos)), (max(n) + 7) // 8 from u where n > 1 group by level, pos // 8),
sib as (
  select r, t.level, coalesce(string_agg(h, '' order by t.pos) filter (t.pos < p.pos // (8 ** t.level)::bigint), '') a,
    coalesce(string_agg(h, '' order by t.pos) filter (t.pos > p.pos // (8 ** t.level)::bigint), '') b
  from p join t on t.g = p.g and t.n > 1 and t.pos // 8 = p.pos // (8 ** (t.level + 1))::bigint group by r, t.level
  union all
  select r, s.level + u.level, coalesce(string_agg(u.h, '' order by u.pos) filter (u.pos < s.pos // (8 ** u.level)::bigint), ''),
    coalesce(string_agg(u.h, '' order by u.pos) filter (u.pos > s.pos // (8 ** u.level)::bigint), '')
  from p join s using (g) join u on u.n > 1 and u.pos // 8 = s.pos // (8 ** (u.level + 1))::bigint group by r, s.level, u.level),
f as (
  select r, 0 as level, seen h from p
  union all
  select f.r, f.level + 1, sha256(a || h || b) from f join sib on sib.r = f.r and sib.level = f.level),
e as (select r, sha256(coalesce(string_agg(a || b, '' order by level), '')) proof from p left join sib using (r) group by r),
o as (select r, arg_max(h, level) h from f group by r),
w as (select h root from u where n = 1)
select doc_id, leaf, s.h as subroot, root, proof as proof_sha256, o.h as folded_root, o.h = root as verified
from p join s using (g) join e using (r) join o using (r), w
""")
def op11_merkle_manifest(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"))


@query()
def op12_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query(rf"""
with recursive t as (
  select conv_id c, coalesce(role, '') || chr(31) || coalesce(text, '') || chr(31) || (len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')))::varchar m, turn,
    coalesce(role, '') role, sha256(coalesce(text, '')) d from conversations where conv_id is not null),
o as (select c, list(m order by turn nulls first, role, d) l from t group by c),
r as (
  select o.c, list_concat(coalesce(list_slice(b.l, 1, h), []), list_slice(o.l, h + 1, len(o.l))) l
  from (select *, ({_crc32('c::varchar')} % 4)::bigint h from o) o left join o b on b.c = o.c - o.c % 20),
p as (select c, l, unnest(range(0, len(l) + 1)) depth from r),
n as (
  select list_slice(l, 1, depth) k, depth, min(c) c, count(*) n, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (len(l) = depth), '')) e
  from p group by 1, 2),
x as (select n.*, (select count(*) from n m where m.depth = n.depth + 1 and list_slice(m.k, 1, n.depth) = n.k) ch from n),
v as (select k, depth, (ch = 0)::bigint leaf, case when depth = 0 then 0 else (n - 1) * string_split(k[depth], chr(31))[-1]::bigint end saved from x),
a as (select list_slice(k, 1, i) k, sum(leaf) leaves, sum(saved) saved from (select *, unnest(range(0, depth + 1)) i from v) group by 1)
select x.c as conv_id, x.depth::bigint as depth, y.c as parent_conv_id, x.n as n_convs, x.ch as n_children, leaves::bigint as n_leaves,
  saved::bigint as saved_tokens, x.e as ends_sha256
from x join a on a.k = x.k left join x y on y.depth = x.depth - 1 and y.k = list_slice(x.k, 1, x.depth - 1)
""")
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
