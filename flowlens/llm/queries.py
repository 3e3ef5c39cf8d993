"""One query per operator, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.sources.bindings import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


@query("op6_suffix_array_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.suffix_dedup import remove_repeats

    found = remove_repeats(documents(spark, sf_dir, "doc_id", "text"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op7_ngram_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.jaccard_join import join_components

    return join_components(documents(spark, sf_dir, "doc_id", "text"))


WORD = r"[^\x20\x09-\x0D]+"

OP4_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(regexp_extract_all(text, '{WORD}'), []) as ws from documents),
base as (
  select doc_id, len(ws) as n_words, coalesce(list_sum([length(x) for x in ws]), 0)::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols
  from d),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
dup_lines as (
  select doc_id, sum(n - 1)::bigint as n_dup_lines
  from (select doc_id, line, count(*) as n from lines where regexp_matches(line, '{WORD}') group by 1, 2) group by 1),
places as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from d),
grams as (
  select doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') as g
  from places cross join (values (5), (10), (101)) as v(n) where i + n - 1 <= len(ws)),
twice as (select doc_id, n, i from grams qualify count(*) over (partition by doc_id, n, g) > 1),
cover as (
  select doc_id, n, count(distinct i + k) as words
  from twice, lateral (select unnest(range(0, n)) as k) group by 1, 2)
select b.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
  coalesce(c5.words, 0) as n_repeat_words,
  n_words < 10 or 100 * coalesce(c5.words, 0) > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * coalesce(c5.words, 0) > 20 * n_words)
    and 100 * coalesce(c10.words, 0) <= 15 * n_words and c101.words is null as kept
from base b left join dup_lines using (doc_id)
  left join cover c5 on c5.doc_id = b.doc_id and c5.n = 5
  left join cover c10 on c10.doc_id = b.doc_id and c10.n = 10
  left join cover c101 on c101.doc_id = b.doc_id and c101.n = 101
"""


@query("op4_quality_rules", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.quality import score

    return score(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir, "doc_id", "text"), tokenizer_file())


OP9_SQL = rf"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
named as (
  select *, [1, 2, 3][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight,
    source_size * 3 as lim, sum(source_size) over () as total from per),
levels as (
  select *, total - coalesce(sum(lim) over (o rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over (o rows between current row and unbounded following) as against
  from named window o as (order by lim / weight::double, source nulls last)),
targets as (
  select *, case when rest * weight >= lim * against then lim::double
      else weight * (max(rest) filter (rest * weight < lim * against) over ())::double
        / (max(against) filter (rest * weight < lim * against) over ())::double end as target
  from levels),
rates as (
  select source, source_size, target, floor(case when source_size > 0 then target / source_size else 0 end) as whole,
    case when source_size > 0 then target / source_size else 0 end as rate from targets),
ranked as (
  select s.doc_id, s.size, r.*, rate - whole as chance, target - whole * source_size as wanted,
    (('0x' || substr(md5(s.doc_id::varchar), 1, 13))::bigint::double + 0.5) / 4503599627370496 as u
  from sized s join rates r on s.source is not distinct from r.source),
placed as (
  select *, case when chance > 0 then (u / (1 - u)) / (chance / (1 - chance)) end as rank from ranked),
summed as (
  select *, sum(size) over (partition by source order by rank, doc_id rows between unbounded preceding and current row) as so_far
  from placed)
select doc_id, size, source_size, target,
  (size * (whole + case when rank is not null and so_far - size / 2.0 <= wanted then 1 else 0 end))::bigint as taken
from summed
"""


@query("op9_mixing_sources", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.mixing import mix

    return mix(documents(spark, sf_dir, "doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import toxicity

    docs = documents(spark, sf_dir, "doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


OP1_SQL = """
with v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
n as (select a, count(*) as n_links from links group by a),
reach as (
  with recursive r(a, b) as (select a, b from links union select r.a, l.b from r join links l on r.b = l.a)
  select a, min(b) as low from r group by a)
select e.vec_id, coalesce(n_links, 0) as n_links, least(e.vec_id, coalesce(low, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) as kept
from embeddings e left join n on n.a = e.vec_id left join reach on reach.a = e.vec_id
"""


@query("op1_embedding_near_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.ann_links import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir, "doc_id", "text"), tokenizer_file("byte_bpe_50k.tiktoken")).select(
        "doc_id", "n_words", "n_tokens")


OP8_SQL = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls last, coalesce(role, ''), coalesce(text, '')) as place
  from conversations),
lines as (
  select conv_id, place, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as line from t),
prefixes as (
  select conv_id, place, string_agg(line, '') over (partition by conv_id order by place) as so_far,
    count(*) over (partition by conv_id) as n from lines),
ends as (select * from prefixes where place = n)
select min(conv_id) as conv_id, n as n_turns, count(*) as n_equal, so_far as text
from ends e where not exists (select 1 from prefixes p where p.place < p.n and p.place = e.n and p.so_far = e.so_far)
group by n, so_far
"""


@query("op8_chat_formatting", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.chat import render

    return render(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, bit by bit."""
    return f"""xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(8 * octet_length(encode({text}))),
  lambda k: get_bit(encode({text})::bit, (8 * (k // 8) + 7 - k % 8)::int)::bigint)),
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""


OP11_SQL = rf"""
with t as (
  select 0 as kind, doc_id as id, text from documents
  union all select 1, row_number() over (), text from benchmark),
w as (
  select kind, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from t),
f as (
  select kind, id, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i : i + n - 1], ' '))) as g
  from w, (values (1), (2), (3)) as v(n)),
grams as (select kind, id, g, count(*) as n from f group by 1, 2, 3),
hashed as (select g, {crc32_sql("g")} % 10000 as bucket from (select distinct g from grams)),
counted as (
  select bucket, coalesce(sum(n) filter (kind = 0), 0)::double as s, coalesce(sum(n) filter (kind = 1), 0)::double as t
  from grams join hashed using (g) group by 1),
totals as (select sum(s) as all_s, sum(t) as all_t from counted),
gains as (
  select bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::bigint as gain from counted, totals),
summed as (
  select id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight
  from grams join hashed using (g) join gains using (bucket) where kind = 0 group by 1),
scored as (
  select id as doc_id, len(ws) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id::varchar), 1, 8))::bigint::double + 0.5)
      / 4294967296.0)))::bigint as score
  from w left join summed using (id) where kind = 0),
ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as total from scored where n_words >= 20)
select s.doc_id, n_features, weight, score, case when place <= 5 * total // 100 then place end as rank
from scored s left join ranked using (doc_id)
"""


@query("op11_target_resampling", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.target_resampling import rank

    return rank(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")).select(
        "doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n_chars from documents),
e as (
  select *, coalesce(lead(doc_id) over o, min(doc_id) over ()) as next_id,
    coalesce(lead(text) over o, first_value(text) over (order by doc_id)) as next_text
  from d window o as (order by doc_id)),
x as (select *, left(text, n_chars - n_chars // 2) || left(next_text, n_chars // 2) as edited from e),
w as (
  select doc_id, kind, coalesce(regexp_extract_all(t, '{WORD}'), []) as ws
  from (select doc_id, 0 as kind, text as t from x union all select doc_id, 1, edited from x)),
s as (
  select doc_id, kind, md5(array_to_string(ws[i : i + 4], ' ')) as h
  from (select *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)),
own as (select doc_id, kind, ('0x' || substr(h, 1, 2))::int as bin, min(h) as h from s group by 1, 2, 3),
bins as (
  select j, ('0x' || substr(md5('a' || j), 1, 4))::int + 1 as a, ('0x' || substr(md5('b' || j), 1, 4))::int as b from range(256) r(j)),
every as (select doc_id, kind, j, a, b from (select distinct doc_id, kind from own), bins),
holes as (select e.* from every e left join own o on o.doc_id = e.doc_id and o.kind = e.kind and o.bin = e.j where o.h is null),
lent as (
  select l.doc_id, l.kind, l.j as bin, arg_min(o.h, (l.a * o.bin + l.b) % 65537) as h
  from holes l join own o on o.doc_id = l.doc_id and o.kind = l.kind group by 1, 2, 3),
prints as (
  select doc_id, kind, string_agg(right(h, 1), '' order by bin) as print
  from (select * from own union all select * from lent) group by 1, 2),
joined as (
  select x.doc_id, x.n_chars, sha256(x.edited) as edited_sha256, coalesce(p.print, '') as fingerprint,
    coalesce(q.print, '') as edited_fingerprint, coalesce(r.print, '') as next_fingerprint
  from x left join prints p on p.doc_id = x.doc_id and p.kind = 0 left join prints q on q.doc_id = x.doc_id and q.kind = 1
    left join prints r on r.doc_id = x.next_id and r.kind = 0),
alike as (
  select *, len(list_filter(range(1, 257), lambda k: fingerprint[k] = edited_fingerprint[k])) as m_edited,
    len(list_filter(range(1, 257), lambda k: fingerprint[k] = next_fingerprint[k])) as m_next from joined)
select doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  case when fingerprint = edited_fingerprint then 1 when '' in (fingerprint, edited_fingerprint) then 0
    else greatest((m_edited / 16.0::double - 1) / 15, 0) end::double as near_edited,
  case when fingerprint = next_fingerprint then 1 when '' in (fingerprint, next_fingerprint) then 0
    else greatest((m_next / 16.0::double - 1) / 15, 0) end::double as near_next
from alike
"""


@query("op12_document_fingerprints", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.fingerprints import with_edits

    return with_edits(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


# A run's words q apart are equal for at least 24 - q or 2 q places on end, so equal 8-word windows q apart find all of it.
OP13_SQL = rf"""
with d as (
  select doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) as ws, {crc32_sql("doc_id::varchar")} as h from documents),
g as (select *, len(ws) as n, (h // 10) % len(ws) as a, 3 + (h // 10) % 8 as k from d),
w as (
  select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i:
      ws[(case when i < a then i else a + (i - a) % (1 + (n - a) // k) end + 1)::bigint]) else ws end as ws from g),
places as (select doc_id, n, ws, unnest(range(0, n - 7)) as i from w where n >= 24),
grams as (select doc_id, n, i, md5(array_to_string(ws[i + 1 : i + 8], ' ')) as gram from places),
pairs as (
  select x.doc_id, x.i, y.i - x.i as q from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram and y.i > x.i
  where 3 * (y.i - x.i) <= x.n),
islands as (select *, i - row_number() over (partition by doc_id, q order by i) as island from pairs),
found as (
  select doc_id, q, min(i) as start, max(i) + 8 + q as stop from islands group by doc_id, q, island
  having max(i) + 8 + q - min(i) >= greatest(24, 3 * q)),
runs as (select doc_id, start, stop - start as length, min(q) as period from found group by doc_id, start, stop),
listed as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines
  from runs group by 1),
best as (
  select * from runs r where not exists (
    select 1 from runs o where o.doc_id = r.doc_id and (o.length * r.period > r.length * o.period
      or (o.length * r.period = r.length * o.period and (o.start, o.period) < (r.start, r.period))))),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
dropped as (select doc_id, list(i) as words_at from gone group by 1)
select w.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256,
  sha256(array_to_string(case when words_at is null then ws
    else list_transform(list_filter(range(w.n), lambda i: not list_contains(words_at, i)), lambda i: ws[(i + 1)::bigint]) end, ' ')) as collapsed_sha256
from w left join listed using (doc_id) left join best using (doc_id) left join dropped using (doc_id)
"""


@query("op13_periodic_runs", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.periodic_runs import find_runs

    return find_runs(documents(spark, sf_dir, "doc_id", "text"), edit=True).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
