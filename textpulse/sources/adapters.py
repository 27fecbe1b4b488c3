"""Adapters from the driver tables to the row shapes the jobs consume.

Adapters only rename and derive input columns (content time, arrival time, source offset);
they do none of the jobs' work. Every job downstream is correct on any data of this shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.functions.time import epoch_seconds

# Content times start at 2024-01-01T00:00:00Z.
BASE_SECOND = 1_704_067_200
# Numbers of one conversation's turns or pages: no two conversations share a number below 2^32 turns.
KEY_STEP = 1 << 32


def messages_from_conversations(conv: DataFrame) -> DataFrame:
    """conversations -> messages (av, origin, sender, sec, arrival_sec, seq, text).

    User turns are bullets, other turns replies. ``sec`` is the content time, ``arrival_sec``
    the time the message reached the stream, ``seq`` the source offset (arrival order key).
    """
    conv_id = F.col("conv_id").cast("bigint")
    turn = F.col("turn").cast("bigint")
    sec = F.lit(BASE_SECOND) + conv_id * 61 + turn * 45
    return conv.select(
        F.concat(F.lit("av"), conv_id.cast("string")).alias("av"),
        F.when(F.col("role") == "user", F.lit("bullet")).otherwise(F.lit("reply")).alias("origin"),
        F.col("role").alias("sender"),
        sec.cast("bigint").alias("sec"),
        (sec + turn * 150).cast("bigint").alias("arrival_sec"),
        (conv_id * KEY_STEP + turn).alias("seq"),
        # pages of 20 turns, like a bullet file's page
        ((turn - turn % 20) / 20 + 1).cast("int").alias("p"),
        F.col("text"),
    )


def event_seconds(events: DataFrame) -> DataFrame:
    """events with ``sec`` = whole epoch seconds of ``ts`` (zone independent)."""
    return events.withColumn("sec", epoch_seconds("ts"))


def _conv_columns(conv: DataFrame) -> DataFrame:
    conv_id = F.col("conv_id").cast("bigint")
    turn = F.col("turn").cast("bigint")
    return conv.select(
        conv_id.alias("conv_id"),
        turn.alias("turn"),
        "role",
        "text",
        (F.lit(BASE_SECOND) + conv_id * 61 + turn * 45).cast("bigint").alias("sec"),
        # payload pages of 20 turns, like the reply API's and bullet file's page size
        (turn - turn % 20).alias("page"),
        # one bullet file (cid) per page
        (conv_id * KEY_STEP + ((turn - turn % 20) / 20).cast("bigint")).alias("cid"),
    )


def reply_payloads_from_conversations(conv: DataFrame) -> DataFrame:
    """conversations -> reply API payloads (av, json), one per 20-turn page: the page's first
    turn is the top-level reply, the rest its child replies; it is listed under ``replies``
    and again under ``hots``. Pages opened by a system turn carry the closed code."""
    c = _conv_columns(conv)
    node = F.struct(
        F.col("sec").alias("ctime"),
        F.length("text").cast("bigint").alias("like"),
        F.struct(
            F.col("role").alias("uname"),
            F.lit("unknown").alias("sex"),
            F.struct(F.col("turn").cast("string").alias("current_level")).alias("level_info"),
        ).alias("member"),
        F.struct(F.col("text").alias("message")).alias("content"),
    )
    pages = c.groupBy("conv_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("turn", node.alias("node"), F.col("role")))).alias("_t")
    )
    top = F.col("_t")[0]
    children = F.transform(F.slice(F.col("_t"), F.lit(2), F.greatest(F.size("_t") - 1, F.lit(0))), lambda x: x["node"])
    top_node = top["node"].withField("replies", children)
    payload = F.struct(
        F.when(top["role"] == "system", F.lit(12002)).otherwise(F.lit(0)).alias("code"),
        F.struct(F.array(top_node).alias("replies"), F.array(top_node).alias("hots")).alias("data"),
    )
    return pages.select(
        F.concat(F.lit("av"), F.col("conv_id").cast("string")).alias("av"),
        (F.col("page") / 20 + 1).cast("int").alias("p"),
        F.to_json(payload).alias("json"),
    )


def _xml_escape(col):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def bullet_xml_from_conversations(conv: DataFrame) -> DataFrame:
    """conversations -> bullet XML documents (cid, xml), one per 20-turn page; each turn is a
    ``<d p="...">text</d>`` element whose p field 5 is the second and field 7 the sender."""
    c = _conv_columns(conv)
    elem = F.concat(
        F.lit('<d p="'),
        F.concat_ws(",", F.col("turn").cast("string"), F.lit("1"), F.lit("25"), F.lit("16777215"),
                    F.col("sec").cast("string"), F.lit("0"), F.col("role"),
                    (F.col("conv_id") * KEY_STEP + F.col("turn")).cast("string")),
        F.lit('">'),
        _xml_escape(F.col("text")),
        F.lit("</d>"),
    )
    docs = c.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("turn", elem.alias("e")))).alias("_e"))
    return docs.select(
        "cid",
        F.concat(F.lit("<i>"), F.array_join(F.transform("_e", lambda x: x["e"]), ""), F.lit("</i>")).alias("xml"),
    )


def user_payloads_from_events(events: DataFrame) -> DataFrame:
    """events -> user API responses (event_id, uid, value): error events answer a non-zero code."""
    code = F.when(F.col("event_type") == "error", F.lit(-404)).otherwise(F.lit(0))
    uid = F.col("user_id").cast("string")
    value = F.to_json(F.struct(code.alias("code"), F.struct(F.struct(uid.alias("mid")).alias("card")).alias("data")))
    return events.select("event_id", uid.alias("uid"), value.alias("value"))


def stat_payloads_from_conversations(conv: DataFrame) -> DataFrame:
    """conversations -> stat API payloads (av, json) with view/reply/favorite/coin/share."""
    c = _conv_columns(conv)
    stats = c.groupBy("conv_id").agg(
        F.sum(F.length("text")).cast("bigint").alias("view"),
        F.count(F.when(F.col("role") != "user", 1)).alias("reply"),
        F.count(F.when(F.col("role") == "user", 1)).alias("favorite"),
        F.max("turn").alias("coin"),
        F.count(F.when(F.col("role") == "system", 1)).alias("share"),
    )
    payload = F.struct(F.lit(0).alias("code"), F.struct("view", "reply", "favorite", "coin", "share").alias("data"))
    return stats.select(F.concat(F.lit("av"), F.col("conv_id").cast("string")).alias("av"),
                        F.to_json(payload).alias("json"))


def tag_payloads_from_conversations(conv: DataFrame) -> DataFrame:
    """conversations -> tag API payloads (av, json): one tag per distinct role."""
    c = _conv_columns(conv)
    tags = c.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    payload = F.struct(F.lit(0).alias("code"),
                       F.transform("roles", lambda r: F.struct(r.alias("tag_name"))).alias("data"))
    return tags.select(F.concat(F.lit("av"), F.col("conv_id").cast("string")).alias("av"),
                       F.to_json(payload).alias("json"))


def pagelist_payloads_from_conversations(conv: DataFrame) -> DataFrame:
    """conversations -> page-list API payloads (av, json): one page (cid, page, part) per 20 turns."""
    c = _conv_columns(conv).select("conv_id", "cid", "page").distinct()
    pages = c.groupBy("conv_id").agg(
        F.collect_list(F.struct(
            F.col("cid"),
            (F.col("page") / 20 + 1).cast("int").alias("page"),
            F.concat(F.lit("part "), (F.col("page") / 20 + 1).cast("int").cast("string")).alias("part"),
        )).alias("data")
    )
    payload = F.struct(F.lit(0).alias("code"), F.col("data"))
    return pages.select(F.concat(F.lit("av"), F.col("conv_id").cast("string")).alias("av"),
                        F.to_json(payload).alias("json"))


def video_pages_from_conversations(conv: DataFrame) -> DataFrame:
    """conversations -> video pages (av, url, html): the first turn's text is the title, its role
    the author's name, the roles are the types, and the second names the upload time."""
    c = _conv_columns(conv)
    first = F.min_by(F.struct("text", "role", "sec"), "turn")
    items = c.groupBy("conv_id").agg(first.alias("f"), F.array_sort(F.collect_set("role")).alias("roles"))
    links = F.array_join(F.transform("roles", lambda r: F.concat(F.lit("<a href=\"#\">"), r, F.lit("</a>"))), "")
    title = F.substring(F.regexp_replace("f.text", "[<>&\\s]+", " "), 1, 80)
    html = F.concat(
        F.lit('<div class="x r-con"><a report-id="name" href="#">'), F.col("f.role"), F.lit('</a></div>'),
        F.lit('<div id="viewbox_report" class="video-info"><h1><span>'), title, F.lit("</span></h1><div>"), links,
        F.lit("<span>views</span><span>"), F.col("f.sec").cast("string"), F.lit("</span></div></div>"),
    )
    av = F.concat(F.lit("av"), F.col("conv_id").cast("string"))
    return items.select(av.alias("av"), F.concat(F.lit("https://video.example/"), av).alias("url"), html.alias("html"))
