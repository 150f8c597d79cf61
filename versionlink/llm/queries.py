"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlink.llm import chat, decontamination, language, lines, minhash, personal, repeats, resampling, sampling, secrets
from versionlink.llm import sharding, spelling, topk
from versionlink.llm.common import table
from versionlink.llm.registry import QUERIES, SQL, query  # noqa: F401

OP1_SQL = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    (('0x' || left(md5(coalesce(doc_id::varchar, 'null')), 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents
), d as (select *, length(bin(size)) as m from sized),
s0 as (select source, sum(size)::bigint as source_size from d group by 1),
s1 as (
  select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight,
    (sum(source_size) over ())::bigint * 1.5::double as total, source_size * 2.0::double as cap from s0
), s2 as (select *, cap / weight as ratio from s1),
s3 as (
  select *, (total - coalesce(sum(cap) over (order by ratio, source nulls last
      rows between unbounded preceding and 1 preceding), 0.0)) /
    sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) >= ratio as "full"
  from s2
), s4 as (
  select source, source_size, case when "full" then cap else
    (total - sum(case when "full" then cap else 0.0 end) over ()) /
    sum(case when "full" then 0.0 else weight end) over () * weight end as target from s3
), c0 as (
  select d.source, d.m, sum(d.size)::bigint as size, any_value(s4.source_size) as source_size, any_value(target) as target
  from d join s4 on d.source is not distinct from s4.source group by 1, 2
), c1 as (
  select *, m::double * size as weighed,
    coalesce(sum(size) over (partition by source order by m desc rows between unbounded preceding and 1 preceding), 0) as before,
    sum(m::double * size) over (partition by source order by m desc rows between current row and unbounded following) as onward
  from c0
), c2 as (
  select *, case when onward > 0 then (target - 2 * before) * m / onward >= 2.0 else false end as "full" from c1
), c3 as (
  select *, sum(case when "full" then size else 0 end) over (partition by source) as taken,
    sum(case when "full" then 0.0 else weighed end) over (partition by source) as rest from c2
), c4 as (
  select *, least(greatest(case when "full" then 2.0 when rest > 0 then (target - 2 * taken) / rest * m else 0.0 end, 0.0), 2.0)
    as expected from c3
), c5 as (select source, m, source_size, target, size, floor(expected)::bigint as whole, expected - floor(expected) as fraction from c4),
l as (select source, round(any_value(target) - sum(whole * size))::bigint as words_left from c5 group by 1),
r as (
  select d.doc_id, d.source, d.size, c5.source_size, c5.target, c5.whole, l.words_left, c5.fraction,
    case when fraction > 0 and d.size > 0 then u * (1 - fraction) / ((1 - u) * fraction) end as q
  from d join c5 on d.source is not distinct from c5.source and d.m = c5.m
  join l on d.source is not distinct from l.source
), t as (
  select *, sum(case when q is null then 0 else size end) over (partition by source order by q nulls last, doc_id nulls last, size
    rows between unbounded preceding and current row) as upto from r
)
select doc_id, size, source_size, target, source,
  whole + case when q is not null and upto - size < words_left and upto - words_left <= words_left - (upto - size)
    then 1 else 0 end as copies, copies * size as taken
from t
"""

OP3_SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), win as (
  select doc_id, i, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)
), twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as n from win) where n > 1),
rep as (select doc_id, count(distinct i + j) as n_repeat_words from twice, (select unnest(range(5)) as j) group by 1),
l0 as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line from d
), l1 as (
  select *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') as w from l0
), l2 as (
  select doc_id, line, len(w) as n, row_number() over (partition by doc_id, line order by pos) > 1 as again,
    len(w) < 10 and not regexp_matches(w[-1], '[.!?:;,"'')\\]}…”’»。！？]$') as short,
    100 * len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]|[!?]{2}$'))) > 30 * len(w) as odd,
    len(list_filter(w, lambda x: regexp_full_match(x, '[|»›>•·/–-]+') and strlen(x) < 4)) as separators,
    regexp_matches(lower(line), 'all rights reserved|terms of use|terms of service|privacy policy|cookie policy|use of cookies|enable javascript|licensed under|lorem ipsum|click here|sign up|log in to|subscribe to') as phrase
  from l1 where len(w) > 0
), l3 as (
  select doc_id, count(*) filter (again) as n_dup_lines,
    coalesce(sum(n) filter (short or odd or (separators >= 2 and 5 * separators >= n) or phrase), 0) as lost
  from l2 group by 1
), a as (
  select d.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(lost, 0) as lost
  from d left join l3 using (doc_id) left join rep using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * lost <= 40 * n_words as kept
from a
"""

OP10_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), s as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as s from w
), n as (select doc_id, count(*) as n from s group by 1),
p as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2
), e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), r(a, b) as (
  select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a
), m as (select a, min(b) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from documents d left join n using (doc_id) join m on m.a = d.doc_id
"""


@query("op10_signature_join", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op3_line_first", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge(table(spark, sf_dir, "documents"))


@query("op1_pareto_mix", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.counted(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return rows.select(
        "row.doc_id", "size", "source_size", "target", "row.source", "copies", (F.col("copies") * F.col("size")).alias("taken"))


@query("op8_gram_lemma")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_differencing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


OP9_SQL = """
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), s as (
  select doc_id, i, array_to_string(w[i:i + 19], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)
), later as (
  select doc_id, i from (select *, row_number() over (partition by s order by doc_id, i) as n from s) where n > 1
), gone as (select distinct doc_id, i + j as i from later, (select unnest(range(20)) as j)),
w as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
k as (
  select w.doc_id, count(*) as n_words, count(gone.i) as n_removed,
    string_agg(word, ' ' order by w.i) filter (gone.i is null) as kept
  from w left join gone on gone.doc_id = w.doc_id and gone.i = w.i group by 1
)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)
"""


@query("op9_cover_anchors", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


@query("op6_hyperdimensional")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


_ESCAPED = "replace(x, '\\', '\\\\')"
for _c in sorted(chat.CONTROLS, key=len, reverse=True):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
OP5_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, len(list_transform([role], lambda x: {_ESCAPED})[1]) + len(list_transform([text], lambda x: {_ESCAPED})[1]) + 13 as chars
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from e group by 1
"""


@query("op5_prefix_tree", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.packs(rows.unionByName(chat.probe(spark))))


@query("op2_random_field")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query("op7_context_bootstrap")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(table(spark, sf_dir, "documents"))


# The checksum of a text's UTF-8 bytes, from its table of 256 entries.
_CRC_TABLE = """crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(256)) as i)
  )
)"""


def _crc(text: str) -> str:
    byte = f"('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::bigint"
    numbers = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: {byte})"
    return (f"xor(list_reduce(list_prepend(4294967295, {numbers}), "
            "lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
with {_CRC_TABLE}, w as (
  select 0 as kind, doc_id, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from documents
  union all
  select 1, null, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) from benchmark
), b as (select word, {_crc("word")} % 10000 as bucket from (select distinct word from w), crc_table),
c as (
  select bucket, count(*) filter (kind = 0) as s, count(*) filter (kind = 1) as t from w join b using (word) group by 1
), g as (
  select bucket, floor(1000 * ln((t + 1)::double * ((sum(s) over ())::double + 10000) /
    ((s + 1)::double * ((sum(t) over ())::double + 10000)))) as gain from c
), m as (
  select doc_id, count(*) as n_features, floor(sum(gain) / count(*))::bigint as weight
  from w join b using (word) join g using (bucket) where kind = 0 group by 1
), d as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::varchar, 'null')), 8))::bigint + 0.5)
      / 4294967296)))::bigint as score
  from documents left join m using (doc_id)
), r as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () * 10 // 100 as drawn
  from d where n_features >= 20
)
select doc_id, n_features, weight, score, case when rank <= drawn then rank end as rank from d left join r using (doc_id)
"""


@query("op11_resample", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return rows.select("row.doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p
) where rank <= 5
"""


@query("op12_sorted_lists", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


# Near words share what is left after taking out one letter; the distance counts code points once
# U+00C0 to U+00FF are written as the 64 characters from ! to `, which no word holds.
_BEYOND = "".join(map(chr, range(0xC0, 0x100)))
_ASCII = "".join(map(chr, range(0x21, 0x61))).replace("'", "''")
OP13_SQL = f"""
with recursive {_CRC_TABLE}, runs as (
  select doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]+')) as run from documents
), hashed as (
  select run, n, {_crc("(coalesce(doc_id::varchar, 'null') || ':' || run)")} as h
  from (select doc_id, run, count(*) as n from runs group by 1, 2), crc_table
), v as (
  select word, sum(n)::bigint as n from (
    select n, case when h % 31 = 0 then left(run, (h % len(run))::int) || substr(run, (h % len(run))::int + 2) else run end as word
    from hashed
  ) where len(word) >= 7 group by 1 having sum(n) >= 2
), s as (
  select word, n, unnest(list_distinct(list_prepend(word,
    list_transform(range(1, len(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1))))) as part from v
), pairs as (select distinct x.word, y.word as near, x.n, y.n as near_n from s x join s y on x.part = y.part and x.word <> y.word),
near as (
  select * from pairs
  where levenshtein(translate(word, '{_BEYOND}', '{_ASCII}'), translate(near, '{_BEYOND}', '{_ASCII}')) = 1
), best as (
  select word, n, count(*) as n_near, arg_min(near, (-near_n, near)) as form, max(near_n) as form_n from near group by 1, 2
), links as (select word, form from best where form_n >= 10 * n),
walk(word, last) as (select word, word from v union all select walk.word, form from walk join links on links.word = walk.last),
ends as (select word, last as root from walk where last not in (select word from links))
select v.word, links.form, root, v.n, coalesce(n_near, 0) as n_near, case when links.form is not null then form_n end as form_n
from v left join best on best.word = v.word left join links on links.word = v.word join ends on ends.word = v.word
"""


@query("op13_spelling_variants", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
