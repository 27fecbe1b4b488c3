"""The registered queries of the operators: production parameters over whole tables.

Each derives the digest columns of its contract from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm import bpe, chat, decontaminate, fill_middle, line_chunks, mixing, pii, repetition, runs, simhash, token_counts, url_rules, warc
from textpulse.session import scratch_path
from textpulse.sources.tables import read_table

TOKEN_LIMIT = 512
#: Weights of the sources by code point, repeating, and the most passes over one source.
SOURCE_WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Explicit URL rules (fixed values of the contract).
ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: explicit rules, else rules mined from the labelled pages.

    ``labels`` has one row per document and no page ids: a page is labelled by the row whose
    ``doc_id`` is its ``page_id``, the only key that the two tables share.
    """
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    labels = read_table(spark, sf_dir, "labels")
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    labelled = pages.join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id").select("url", "bad")
    return url_rules.judge_urls(pages, url_rules.mine_rules(labelled), ALLOW, BLOCK)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark's 13-word windows."""
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        decontaminate.n_hit().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after the removal of repeated passages of lines."""
    done = line_chunks.dedup_lines(read_table(spark, sf_dir, "documents"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return repetition.repetition_report(read_table(spark, sf_dir, "documents")).drop("longest_repeat")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans and those the trained classifier adds."""
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived by content address, then read back."""
    back = warc.archive_round_trip(read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path(), TOKEN_LIMIT)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rebuilt from its event log, rendered, and read back from the output.

    Conversation -1 holds the template's control strings as text.
    """
    rows = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], rows.schema)
    return chat.conversation_digests(chat.format_conversations(chat.conversation_events(rows.unionByName(extra))))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that a mix of all sources by weight takes every document, in words."""
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, MAX_EPOCHS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, chosen by the checksum of their id, repeat a
    stretch of their words from some word on (the contract of ``op12``)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))
    n = F.size("words")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
    rows = rows.withColumn("a", F.when(n > 0, F.pmod("g", n)).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.pmod("g", F.lit(8))))).cast("int"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
    repeated = F.array_join(F.transform("words", lambda _, i: F.get(F.col("words"), at(i))), " ")
    return rows.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, after the planting of periods."""
    found = runs.periodic_runs(with_planted_period(read_table(spark, sf_dir, "documents", ["doc_id", "text"])))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    best = found.withColumn("best", runs.longest_run(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle output of every document, and the text restored from it."""
    out = fill_middle.fill_in_middle(read_table(spark, sf_dir, "documents"))
    back = fill_middle.restore(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_rules": op1_url_rules,
    "op2_decontamination": op2_decontamination,
    "op3_line_chunks": op3_line_chunks,
    "op4_repetition": op4_repetition,
    "op5_personal_data": op5_personal_data,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_chat": op9_chat,
    "op10_bpe": op10_bpe,
    "op11_source_mix": op11_source_mix,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op2_decontamination": f"""
with items as (select distinct cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
sized as (select item, w, least(len(w), 13) as k from items where len(w) > 0),
windows as (select item, k, array_to_string(w[i:i + k - 1], ' ') as win from sized, unnest(range(1, len(w) - k + 2)) as t(i)),
docs as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
widths as (select distinct k from sized),
starts as (select r, doc_id, w, k, i from docs, widths, unnest(range(1, len(w) - k + 2)) as t(i)),
hits as (select s.r, s.i, s.k, win.item from starts s join windows win on win.k = s.k and win.win = array_to_string(s.w[s.i:s.i + s.k - 1], ' ')),
inside as (select r, count(distinct p) as n_hit from hits, unnest(range(i, i + k)) as t(p) group by r),
found as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join inside using (r) left join found using (r)""",
    "op4_repetition": r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t,
                  regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') as w from documents),
w3 as (select r, i, array_to_string(w[i:i + 2], ' ') as g from d, unnest(range(1, len(w) - 1)) as x(i)),
n3 as (select r, count(distinct p) as n from (select r, i, count(*) over (partition by r, g) as c from w3), unnest(range(i, i + 3)) as x(p) where c > 1 group by r),
w20 as (select r, i, array_to_string(w[i:i + 19], ' ') as g from d, unnest(range(1, len(w) - 18)) as x(i)),
r20 as (select r, i, g from (select *, count(*) over (partition by r, g) as c from w20) where c > 1),
n20 as (select r, count(distinct p) as n from r20, unnest(range(i, i + 20)) as x(p) group by r),
lines as (select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(t, chr(10))) as line from d)
          where regexp_matches(line, '[^ \t\n\x0B\f\r]') group by r),
base as (
  select r, doc_id, cast(len(w) as bigint) as n_words,
         cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(lines.n, 0) as bigint) as n_dup_lines, cast(coalesce(n3.n, 0) as bigint) as n_repeat_words,
         cast(coalesce(n20.n, 0) as bigint) as n_covered,
         len(w) < 50 or 100 * coalesce(n3.n, 0) > 50 * len(w) as base_failed
  from d left join lines using (r) left join n3 using (r) left join n20 using (r)),
pairs as (select a.r, b.i - a.i as gap, a.i from r20 a join r20 b on a.r = b.r and a.g = b.g and a.i < b.i join base on base.r = a.r and not base_failed),
runs as (select r, count(*) + 19 as size from (select r, gap, i - row_number() over (partition by r, gap order by i) as island from pairs) group by r, gap, island),
longest as (select r, max(size) as size from runs group by r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, base_failed,
       not base_failed and 100 * n_covered <= 30 * n_words
         and coalesce(size, 0) <= 100 as kept
from base left join longest using (r)""",
    "op6_warc": """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body) as n, sha1(body) as h, min(page_id) over (partition by body) as first_id from p)
select page_id, cast(n as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + cast((cast('0x' || substr(h, 1 + 10 * (k // 8), 10) as bigint) >> cast(35 - 5 * (k % 8) as bigint)) & 31 as integer), 1)), '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to
from d""",
    "op9_chat": r"""
with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m as (select *, length(role) + length(text) + 24
        + (length(text) - length(replace(text, '\', '')))
        + (select sum((length(text) - length(replace(text, s, ''))) // length(s))
           from unnest(['<|im_start|>', '<|im_end|>', '<|endoftext|>', '<s>', '</s>', '[INST]', '[/INST]']) as t(s)) as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars
from m group by conv_id""",
    "op11_source_mix": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) as size,
                  md5('42:' || coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))) as key from documents),
s as (select source, cast(sum(size) as hugeint) as n from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from s),
o as (select *, row_number() over (order by n / w, source nulls last) as k, sum(n) over () as total from w),
level as (select *, total - coalesce(sum(3 * n) over (order by k rows between unbounded preceding and 1 preceding), 0) as rest_words,
                 sum(w) over (order by k rows between current row and unbounded following) as rest_weight from o),
c as (select *, 3 * n * rest_weight < rest_words * w as clamped from level),
f as (select *, total - coalesce(sum(3 * n) filter (clamped) over (), 0) as r, sum(w) filter (not clamped) over () as rw from c),
t as (select source, n, case when clamped then cast(3 * n as double) else cast(r as double) * w / cast(rw as double) end as target from f),
plan as (select *, case when n > 0 then floor(target / n) else 0 end as whole, target - (case when n > 0 then floor(target / n) else 0 end) * n as rest from t),
units as (select source, key, sum(size) as unit from d group by source, key),
placed as (select source, key, sum(unit) over (partition by source order by key) - unit / 2 as middle from units)
select doc_id, cast(size as bigint) as size, cast(plan.n as bigint) as source_size, target,
       cast(size * (whole + case when middle <= rest then 1 else 0 end) as bigint) as taken
from d join plan on d.source is not distinct from plan.source
       join placed on d.source is not distinct from placed.source and d.key = placed.key""",
    "op12_periodic_runs": r"""
with c as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') as w,
       xor(list_reduce(list_concat([cast(4294967295 as bigint)],
             list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: cast(ascii(ch) as bigint))),
           lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], cast(range(0, 8) as bigint[])),
             lambda x, step: case when x & 1 = 1 then xor(x >> 1, cast(3988292384 as bigint)) else x >> 1 end)),
         cast(4294967295 as bigint)) as h from documents),
q as (select *, h // 10 as g, len(w) as n from c),
z as (select *, case when n > 0 then g % n end as a from q),
y as (select *, case when h % 10 = 0 and n > 0 then 1 + (n - a) // (3 + g % 8) end as p from z),
d as (select r, doc_id, n, case when p is null then w else list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) end as w from y),
g as (select r, i, array_to_string(w[i + 1:i + 6], ' ') as gram from d, unnest(range(0, n - 5)) as t(i)),
pairs as (select x.r, x.i, z.i - x.i as gap from g x join g z on x.r = z.r and x.gram = z.gram and x.i < z.i),
isle as (select r, gap, i - row_number() over (partition by r, gap order by i) as k, i from pairs),
stretch as (select r, gap as period, min(i) as start, count(*) + 5 + gap as length from isle group by r, gap, k),
good as (select * from stretch where length >= 2 * period and length >= 12),
found as (select s.r, s.start, s.length, s.period from good s where not exists (
  select 1 from stretch o where o.r = s.r and o.period < s.period and o.start <= s.start and o.start + o.length >= s.start + s.length)),
listed as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
             arg_min(struct_pack(start := start, length := length, period := period), (-length, start, period)) as best from found group by r),
gone as (select distinct r, i from found, unnest(range(start + period, start + length)) as t(i)),
kept as (select d.r, string_agg(d.w[i + 1], ' ' order by i) as text from d, unnest(range(0, n)) as t(i)
         where not exists (select 1 from gone where gone.r = d.r and gone.i = t.i) group by d.r)
select doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.period as period,
       cast(1000 * best.length // best.period as bigint) as exponent_milli,
       sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from d left join listed using (r) left join kept using (r)""",
    "op13_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') as u,
                  sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
x as (select *, len(u) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
             cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
                  when h4 % 100 < 20 then 'spm' else 'psm' end as form from x),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from p""",
}
