"""Payload jobs: page triage/fields on ``pages``, reply trees, bullet XML and nested records
built from ``conversations``, user validation and id seeding from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse import schemas
from textpulse.operators.payloads import (
    assemble_records,
    assemble_video_records,
    nest_bullets,
    page_list,
    stat_fields,
    tag_names,
    flatten_replies,
    last_text_wins,
    malformed_bullets,
    malformed_payloads,
    page_fields,
    page_triage,
    parse_bullets,
    record_json,
    seed_ids,
    valid_users,
    video_page_fields,
)
from textpulse.operators.shape import explode_messages
from textpulse.sources.adapters import (
    bullet_xml_from_conversations,
    messages_from_conversations,
    pagelist_payloads_from_conversations,
    reply_payloads_from_conversations,
    stat_payloads_from_conversations,
    tag_payloads_from_conversations,
    user_payloads_from_events,
    video_pages_from_conversations,
)
from textpulse.sources.records import parse_records
from textpulse.sources.tables import read_table
from textpulse.sources.variant import variant_fields, variant_messages, variant_records

# Triage markers that split the driver's pages (the crawler's own markers are the defaults of
# page_triage): pages with an escaped ampersand count as deleted, English pages as videos.
PAGE_DELETED_MARKER = "&amp;"
PAGE_VIDEO_MARKER = 'lang="en"'
SEED_URL_PREFIX = "https://video.example/av"


def q_page_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return page_triage(pages, PAGE_DELETED_MARKER, PAGE_VIDEO_MARKER).select("page_id", "url", "kind")


def q_page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", ["page_id", "html"])
    fields = page_fields(pages)
    return fields.select(
        "page_id", "title", "heading", "author",
        F.array_join("types", "|").alias("types"), F.size("types").alias("n_types"), "upload_time",
    )


def q_reply_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return flatten_replies(reply_payloads_from_conversations(conv), "json", keep=("av",))


def q_bullet_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    bullets = parse_bullets(bullet_xml_from_conversations(conv), "xml", keep=("cid",))
    return last_text_wins(bullets).select("cid", "sender", "sec", "text")


def q_nested_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages -> nested records -> JSON text -> parsed records -> flattened messages."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    msgs = messages_from_conversations(conv).select("av", "p", "origin", "sender", "sec", "text", "seq")
    payloads = record_json(assemble_records(msgs))
    good, _bad = parse_records(payloads, schemas.VIDEO_RECORD, value_col="value", key_field="av")
    return explode_messages(good).select("av", "origin", "sender", "sec", "text")


def q_variant_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the nested records, parsed without a schema, with a field of each record
    that the schema lacks and whose type changes from record to record (text, number, list)."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    msgs = messages_from_conversations(conv).select("av", "p", "origin", "sender", "sec", "text", "seq")
    payloads = record_json(assemble_records(msgs))
    number = F.substring(F.get_json_object("value", "$.av"), 3, 20).cast("bigint")
    changing = F.when(number % 3 == 0, F.concat(F.lit('"n'), number, F.lit('"'))).when(number % 3 == 1, number.cast("string")).otherwise(F.concat(F.lit("["), number, F.lit("]")))
    payloads = payloads.withColumn("value", F.concat(F.lit('{"origin_tag":'), changing, F.lit(","), F.substring(F.col("value"), 2, 1 << 30)))
    good, _bad = variant_records(payloads)
    unknown = variant_fields(good, [f.name for f in schemas.VIDEO_RECORD.fields], ["av"]).select("av", "kind", "json").distinct()
    return variant_messages(good, drop_special=False).join(unknown, "av").select("av", "origin", "sender", "sec", "text", "kind", "json")


def q_record_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stat, tag, page-list, bullet, reply and page payloads joined into one record per item,
    rendered as JSON and parsed back; reports the fields of every record and, per page of its
    sorted array, the number, file, name and bullets."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    bullets = nest_bullets(last_text_wins(parse_bullets(bullet_xml_from_conversations(conv))))
    replies = flatten_replies(reply_payloads_from_conversations(conv), keep=("av", "p"))
    records = assemble_video_records(
        stat_fields(stat_payloads_from_conversations(conv)),
        tag_names(tag_payloads_from_conversations(conv)),
        page_list(pagelist_payloads_from_conversations(conv)),
        bullets,
        replies,
        video_page_fields(video_pages_from_conversations(conv)),
    )
    back = records.select(F.to_json(F.struct(*records.columns)).alias("value"))
    back = back.select(F.from_json("value", schemas.VIDEO_RECORD).alias("r")).select("r.*")

    def page_line(page):
        bullets_in = F.aggregate(F.map_values(page["bullet"]), F.lit(0), lambda acc, m: acc + F.size(m))
        return F.concat_ws(":", page["p"], page["cid"], page["part"], bullets_in)

    return back.select(
        "av", "title", "author", "view", "replies_number", "favorite", "coin", "share",
        F.array_join("type", ",").alias("types"), F.array_join("tag", ",").alias("tags"), "time", "url", "count",
        F.array_join(F.transform("bullet_screen", page_line), "|").alias("pages"), F.size("replies").alias("n_replies"),
    )


def q_payload_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply payloads, bullet elements and records with broken ones among them (every turn number
    divisible by 7 breaks its page): what is parsed and what goes to the quarantine."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    broken = conv.groupBy("conv_id").agg((F.max("turn") % 7 == 0).alias("broken"))
    av = broken.select(F.concat(F.lit("av"), F.col("conv_id").cast("string")).alias("av"), "broken")
    payloads = reply_payloads_from_conversations(conv).join(av, "av")
    payloads = payloads.withColumn("json", F.when(F.col("broken"), F.concat(F.lit("{"), "json")).otherwise(F.col("json")))
    xml = bullet_xml_from_conversations(conv).withColumn("xml", F.regexp_replace("xml", r',25,16777215,(\d*)1,[^"]*"', r',25"'))
    typed = payloads.select("av", F.when(F.col("broken"), '{"av":"x","view":"many"}').otherwise(F.concat(F.lit('{"view":1,"av":"'), "av", F.lit('"}'))).alias("value"))
    good, bad = parse_records(typed, schemas.VIDEO_RECORD, value_col="value", key_field="av")
    counts = [
        ("replies_good", flatten_replies(payloads, keep=("av",))), ("replies_bad", malformed_payloads(payloads)),
        ("bullets_good", parse_bullets(xml)), ("bullets_bad", malformed_bullets(xml)),
        ("records_good", good), ("records_bad", bad),
    ]
    out = None
    for name, rows in counts:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def q_user_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid users with the CRC32 of their id, as it stands in the published record."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type"])
    users = valid_users(user_payloads_from_events(ev), "value", "uid")
    return users.select("event_id", "uid", F.get_json_object("value", "$.crc32").cast("bigint").alias("crc32"))


def q_seed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id space 1..max(user_id) of the events table, as seed keys and URLs."""
    last = read_table(spark, sf_dir, "events", ["user_id"]).agg(F.max("user_id")).first()[0] or 0
    return seed_ids(spark, 1, int(last), url_prefix=SEED_URL_PREFIX).select("id", "key", "url")


QUERIES = {
    "page_triage": q_page_triage,
    "page_fields": q_page_fields,
    "reply_flatten": q_reply_flatten,
    "bullet_xml": q_bullet_xml,
    "nested_roundtrip": q_nested_roundtrip,
    "variant_flatten": q_variant_flatten,
    "record_assembly": q_record_assembly,
    "payload_quarantine": q_payload_quarantine,
    "user_crc32": q_user_crc32,
    "seed_ids": q_seed_ids,
}

_CONV_SQL = """
c AS (
  SELECT 'av' || CAST(conv_id AS VARCHAR) AS av, conv_id, turn, role, text,
         CAST(1704067200 + conv_id * 61 + turn * 45 AS BIGINT) AS sec, turn - turn % 20 AS page
  FROM conversations
)
"""

ORACLE = {
    "page_triage": """
SELECT page_id, url, CASE WHEN contains(html, 'lang="en"') THEN 'video' ELSE 'bangumi' END AS kind
FROM pages
WHERE NOT contains(regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>', '', 'g'), '&amp;')""",
    "page_fields": """
WITH f AS (
  SELECT page_id,
         regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
         regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading,
         regexp_extract(html, '&copy; ([^ <]+)', 1) AS author,
         regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS t,
         regexp_extract_all(html, '(?s)<span[^>]*>(.*?)</span>', 1) AS s
  FROM pages
)
SELECT page_id, title, heading, author, array_to_string(t, '|') AS types, CAST(len(t) AS INTEGER) AS n_types,
       CASE WHEN len(s) >= 2 THEN s[2] WHEN len(s) = 1 THEN s[1] ELSE '' END AS upload_time
FROM f""",
    "reply_flatten": f"""
WITH {_CONV_SQL},
tops AS (SELECT conv_id, page, min(turn) AS top_turn FROM c GROUP BY 1, 2),
j AS (
  SELECT c.*, t.top_turn, tr.role AS top_role
  FROM c JOIN tops t USING (conv_id, page) JOIN c tr ON tr.conv_id = t.conv_id AND tr.turn = t.top_turn
),
r AS (
  SELECT *, CASE WHEN turn = top_turn THEN -1
                 ELSE CAST(row_number() OVER (PARTITION BY conv_id, page, turn = top_turn ORDER BY turn) - 1 AS INTEGER)
            END AS child_pos
  FROM j WHERE top_role <> 'system'
)
SELECT av, l.list_name, 0 AS node_pos, child_pos, sec AS "time", role AS name, 'unknown' AS sex,
       CAST(length(text) AS BIGINT) AS "like", CAST(turn AS INTEGER) AS level, text AS message
FROM r CROSS JOIN (VALUES ('replies'), ('hots')) AS l(list_name)""",
    "bullet_xml": f"""
WITH {_CONV_SQL}
SELECT conv_id * 4294967296 + page // 20 AS cid, role AS sender, sec, text FROM c""",
    "variant_flatten": """
SELECT 'av' || CAST(conv_id AS VARCHAR) AS av,
       CASE WHEN role = 'user' THEN 'bullet' ELSE 'reply' END AS origin,
       role AS sender, CAST(1704067200 + conv_id * 61 + turn * 45 AS BIGINT) AS sec, text,
       CASE conv_id % 3 WHEN 0 THEN 'STRING' WHEN 1 THEN 'BIGINT' ELSE 'ARRAY<BIGINT>' END AS kind,
       CASE conv_id % 3 WHEN 0 THEN '"n' || conv_id || '"' WHEN 1 THEN CAST(conv_id AS VARCHAR) ELSE '[' || conv_id || ']' END AS json
FROM conversations""",
    "nested_roundtrip": """
SELECT 'av' || CAST(conv_id AS VARCHAR) AS av,
       CASE WHEN role = 'user' THEN 'bullet' ELSE 'reply' END AS origin,
       role AS sender, CAST(1704067200 + conv_id * 61 + turn * 45 AS BIGINT) AS sec, text
FROM conversations
WHERE NOT (role = 'user' AND left(text, 1) = '[' AND right(text, 1) = ']' AND length(text) >= 2)""",
    "record_assembly": f"""
WITH {_CONV_SQL},
stat AS (
  SELECT av, CAST(sum(length(text)) AS BIGINT) AS "view",
         count(*) FILTER (WHERE role <> 'user') AS replies_number,
         count(*) FILTER (WHERE role = 'user') AS favorite,
         max(turn) AS coin, count(*) FILTER (WHERE role = 'system') AS share,
         CAST(count(DISTINCT page) + 1 AS INTEGER) AS "count"
  FROM c GROUP BY av
),
tags AS (SELECT av, string_agg(role, ',' ORDER BY role) AS tags FROM (SELECT DISTINCT av, role FROM c) GROUP BY av),
pg AS (
  SELECT av, page, CAST(page // 20 + 1 AS INTEGER) AS p, conv_id * 4294967296 + page // 20 AS cid,
         count(*) AS n_turns, arg_min(role, turn) AS top_role
  FROM c GROUP BY av, conv_id, page
)
SELECT stat.av, any_value(f.title) AS title, any_value(f.author) AS author, any_value(stat."view") AS "view",
       any_value(stat.replies_number) AS replies_number, any_value(stat.favorite) AS favorite,
       any_value(stat.coin) AS coin, any_value(stat.share) AS share, any_value(tags.tags) AS types,
       any_value(tags.tags) AS tags, any_value(f.time) AS "time", 'https://video.example/' || stat.av AS url,
       any_value(stat."count") AS "count",
       string_agg(p || ':' || cid || ':part ' || p || ':' || n_turns, '|' ORDER BY p) AS pages,
       CAST(sum(CASE WHEN pg.top_role = 'system' THEN 0 ELSE 2 * pg.n_turns END) AS INTEGER) AS n_replies
FROM pg JOIN stat USING (av) JOIN tags USING (av)
JOIN (SELECT av, left(regexp_replace(arg_min(text, turn), '[<>&\\s]+', ' ', 'g'), 80) AS title, arg_min(role, turn) AS author,
             CAST(arg_min(sec, turn) AS VARCHAR) AS "time" FROM c GROUP BY av) f USING (av)
GROUP BY stat.av""",
    "payload_quarantine": f"""
WITH {_CONV_SQL},
b AS (SELECT conv_id, max(turn) % 7 = 0 AS broken FROM c GROUP BY 1),
pg AS (SELECT conv_id, page, broken, count(*) AS n_turns, arg_min(role, turn) AS top_role FROM c JOIN b USING (conv_id) GROUP BY ALL)
SELECT 'replies_good' AS what, CAST(sum(CASE WHEN broken OR top_role = 'system' THEN 0 ELSE 2 * n_turns END) AS BIGINT) AS n FROM pg
UNION ALL SELECT 'replies_bad', count(*) FILTER (broken) FROM pg
UNION ALL SELECT 'bullets_good', count(*) FILTER (sec % 10 <> 1) FROM c
UNION ALL SELECT 'bullets_bad', count(*) FILTER (sec % 10 = 1) FROM c
UNION ALL SELECT 'records_good', count(*) FILTER (NOT broken) FROM pg
UNION ALL SELECT 'records_bad', count(*) FILTER (broken) FROM pg""",
    "user_crc32": """
SELECT event_id, CAST(user_id AS VARCHAR) AS uid,
       xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
             list_transform(string_split(CAST(user_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
           lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], CAST(range(0, 8) AS BIGINT[])),
             lambda x, step: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)),
         CAST(4294967295 AS BIGINT)) AS crc32
FROM events WHERE event_type <> 'error'""",
    "seed_ids": """
SELECT id, 'av' || CAST(id AS VARCHAR) AS key, 'https://video.example/av' || CAST(id AS VARCHAR) AS url
FROM (SELECT unnest(generate_series(1, (SELECT max(user_id) FROM events))) AS id)""",
}
