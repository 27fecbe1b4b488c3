"""Spark jobs over stored crawl payloads: page triage and field extraction, reply trees,
bullet XML, nesting messages into records, record assembly, user validation, seed ids.

Fetching is not part of the library; these jobs read tables of raw payloads.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse import fixed, schemas
from textpulse.functions.json import set_json_field
from textpulse.functions.text import crc32_of
from textpulse.operators.html import PageField, Step, with_html_fields

# Default extraction rules for page fields: name -> (regex, group). `(?s)` lets `.` span lines.
PAGE_RULES: dict[str, tuple[str, int]] = {
    "title": (r"(?s)<title>(.*?)</title>", 1),
    "heading": (r"(?s)<h1>(.*?)</h1>", 1),
    "author": (r"&copy; ([^ <]+)", 1),
}
# Type list: the link texts of the navigation list.
TYPE_LINK_PATTERN = r'<li><a href="[^"]*">([^<]*)</a></li>'
# Upload time: second <span> if there are at least two, else the first, else "".
SPAN_PATTERN = r"(?s)<span[^>]*>(.*?)</span>"


#: A div of the class that marks a video page.
VIDEO_DIV_PATTERN = r'(?s)<div\b[^>]*\bclass="(?:[^"]*\s)?r-con(?:\s[^"]*)?"'
# An opening without an end takes the rest of the page, so a broken page is not read again from
# each of them; a "<" before anything but a name is text.
_TAG = r"(?si)<(script|style)\b(?:.*?</\1\s*>|.*)|<!--(?:.*?-->|.*)|<(?=[a-z/!?])[^>]*(?:>|\z)"


def page_text(html: Column) -> Column:
    """The text of a page: without tags, comments, scripts and styles."""
    return F.regexp_replace(html, _TAG, "")


def page_triage(pages: DataFrame, deleted_marker: str = fixed.DELETED_MARKER,
                video_marker: str | None = None, html_col: str = "html") -> DataFrame:
    """Drop pages whose text has the deleted marker; label the rest ``video`` (they have a div of
    the video class or, if given, the ``video_marker`` in their html) or ``bangumi``."""
    html = F.col(html_col)
    is_video = html.contains(video_marker) if video_marker else html.rlike(VIDEO_DIV_PATTERN)
    return pages.where(~F.coalesce(page_text(html).contains(deleted_marker), F.lit(False))).withColumn(
        "kind", F.when(is_video, F.lit("video")).otherwise(F.lit("bangumi"))
    )


_HEAD = (Step("div", id="viewbox_report"),)
VIDEO_FIELDS: dict[str, PageField] = {
    "author": PageField((Step("div", cls="r-con"), Step("a", attributes=(("report-id", "name"),)))),
    "title": PageField((*_HEAD, Step(child=0))),
    "time": PageField((*_HEAD, Step(child=1), Step("span")), places=(1, 0)),
    "type": PageField((*_HEAD, Step(child=1), Step("a")), all=True),
}


def video_page_fields(pages: DataFrame, html_col: str = "html", unescape: bool = False) -> DataFrame:
    """Fields of a video page: ``author`` from the link named ``report-id="name"`` inside the video
    div; ``title`` from the first child of the head block (``id="viewbox_report"``), ``type`` from
    the links and ``time`` from the second, else the first, span of its second child. A field
    that is not found is empty. The page's tags are walked, so elements may be nested.
    ``unescape`` resolves character references (as a browser's text does)."""
    return with_html_fields(pages, VIDEO_FIELDS, html_col, unescape=unescape)


def page_fields(pages: DataFrame, rules: Mapping[str, tuple[str, int]] | None = None,
                html_col: str = "html") -> DataFrame:
    """Extract fields with regex rules; a failed extraction gives "" (the original's default).
    Adds ``types`` (navigation link texts) and ``upload_time``."""
    html = F.col(html_col)
    cols = {name: F.regexp_extract(html, pat, grp) for name, (pat, grp) in (rules or PAGE_RULES).items()}
    spans = F.regexp_extract_all(html, F.lit(SPAN_PATTERN), 1)
    cols["types"] = F.regexp_extract_all(html, F.lit(TYPE_LINK_PATTERN), 1)
    cols["upload_time"] = (
        F.when(F.size(spans) >= 2, F.element_at(spans, 2))
        .when(F.size(spans) == 1, F.element_at(spans, 1))
        .otherwise(F.lit(""))
    )
    return pages.withColumns(cols)


def _reply_struct(node: Column, list_name: str, node_pos: Column, child_pos: Column) -> Column:
    return F.struct(
        F.lit(list_name).alias("list_name"),
        node_pos.alias("node_pos"),
        child_pos.alias("child_pos"),
        node["ctime"].alias("time"),
        node["member"]["uname"].alias("name"),
        node["member"]["sex"].alias("sex"),
        node["like"].alias("like"),
        node["member"]["level_info"]["current_level"].try_cast("int").alias("level"),
        node["content"]["message"].alias("message"),
    )


def flatten_replies(raw: DataFrame, payload_col: str = "json", keep: tuple[str, ...] = ("av",)) -> DataFrame:
    """Reply API payloads -> one row per reply: for ``replies`` then ``hots``, each top-level
    reply followed by its child replies. Payloads with the closed code yield nothing;
    replies present in both lists are kept twice. Payloads that are no JSON go to
    :func:`malformed_payloads`.

    The reply tree of a payload is turned into one array with higher-order functions and
    exploded once (a single pass over the payloads).
    Output: keep..., list_name, node_pos, child_pos (-1 for a top-level reply), reply fields.
    """
    keep = list(keep)
    parsed = raw.select(*keep, F.from_json(F.col(payload_col), schemas.REPLY_PAYLOAD).alias("_p")).where(
        F.col("_p").isNotNull() & (F.coalesce(F.col("_p.code"), F.lit(0)) != fixed.REPLIES_CLOSED_CODE)
    )

    def rows_of(list_name: str):
        def node_rows(node, i):
            top = F.array(_reply_struct(node, list_name, i, F.lit(-1)))
            children = F.transform(F.coalesce(node["replies"], F.array()),
                                   lambda c, j: _reply_struct(c, list_name, i, j))
            return F.concat(top, children)

        return F.flatten(F.transform(F.coalesce(F.col(f"_p.data.{list_name}"), F.array()), node_rows))

    return parsed.select(*keep, F.explode(F.concat(rows_of("replies"), rows_of("hots"))).alias("_r")).select(
        *keep, "_r.*"
    )


BULLET_XML_SCHEMA = "d ARRAY<STRUCT<_p: STRING, _VALUE: STRING>>"


def parse_bullets(raw: DataFrame, xml_col: str = "xml", keep: tuple[str, ...] = ("cid",)) -> DataFrame:
    """Bullet XML documents -> one row per ``<d>``: sender = 7th and second = 5th comma field
    of its ``p`` attribute; ``pos`` is the element's position in the document. Elements without
    a sender or a whole second are left to :func:`malformed_bullets`."""
    return _bullet_elements(raw, xml_col, keep).where(_BULLET_OK).select(*keep, "pos", "sender", "sec", "text")


def malformed_bullets(raw: DataFrame, xml_col: str = "xml", keep: tuple[str, ...] = ("cid",)) -> DataFrame:
    """The elements that :func:`parse_bullets` leaves out: keep..., pos, p (the raw attribute)."""
    return _bullet_elements(raw, xml_col, keep).where(f"not ({_BULLET_OK})").select(*keep, "pos", "p")


_BULLET_OK = "sender is not null and sec is not null"


def _bullet_elements(raw: DataFrame, xml_col: str, keep: tuple[str, ...]) -> DataFrame:
    keep = list(keep)
    parsed = raw.select(
        *keep,
        F.from_xml(F.col(xml_col), BULLET_XML_SCHEMA, {"ignoreSurroundingSpaces": "false"}).alias("_x"),
    )
    elems = parsed.select(*keep, F.posexplode("_x.d").alias("pos", "_d"))
    fields = F.split(F.col("_d._p"), ",")
    return elems.select(
        *keep,
        "pos",
        F.col("_d._p").alias("p"),
        F.get(fields, F.lit(fixed.BULLET_SENDER_FIELD)).alias("sender"),
        F.get(fields, F.lit(fixed.BULLET_SECOND_FIELD)).try_cast("bigint").alias("sec"),
        F.coalesce(F.col("_d._VALUE"), F.lit("")).alias("text"),
    )


def malformed_payloads(raw: DataFrame, payload_col: str = "json") -> DataFrame:
    """Payload rows that are not a JSON object (null included), for the quarantine."""
    return raw.where(F.json_object_keys(F.col(payload_col)).isNull())


def last_text_wins(bullets: DataFrame, keys: tuple[str, ...] = ("cid", "sender", "sec"),
                   order_col: str = "pos") -> DataFrame:
    """One text per (cid, sender, second): the last one in document order (dict overwrite)."""
    return bullets.groupBy(*keys).agg(F.max_by("text", order_col).alias("text"))


def assemble_records(msgs: DataFrame, part_name: str = "conversation", order_col: str | None = "seq",
                     page_col: str = "p") -> DataFrame:
    """Nest messages (av, p, origin, sender, sec, text[, seq]) into one record per item and page,
    of the record schema.

    A page holds one bullet file and one page of replies, so a record is bounded by its source's
    page, however many an item has; flattening the records gives back the same bag of
    messages. Bullets repeating (sender, second) keep the last text in ``order_col`` order, as a
    dict overwrite would; bullets without a sender are put under the empty one.
    Columns: av, part_no (the page), bullet_screen, replies.
    """
    parted = msgs.withColumn("part_no", F.col(page_col)).withColumn("sender", F.coalesce("sender", F.lit("")))
    bullets = parted.where(F.col("origin") == "bullet")
    last = F.max_by("text", order_col) if order_col else F.max("text")
    bullets = bullets.groupBy("av", "part_no", "sender", "sec").agg(last.alias("text"))
    by_sender = bullets.groupBy("av", "part_no", "sender").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("sec").cast("string"), F.col("text")))).alias("_m")
    )
    pages = by_sender.groupBy("av", "part_no").agg(
        F.map_from_entries(F.collect_list(F.struct("sender", "_m"))).alias("bullet")
    ).select(
        "av",
        "part_no",
        F.array(
            F.struct(
                F.col("part_no").cast("int").alias("p"),
                F.regexp_extract("av", r"(\d+)", 1).try_cast("bigint").alias("cid"),
                F.lit(part_name).alias("part"),
                F.col("bullet"),
            )
        ).alias("bullet_screen"),
    )
    replies = parted.where(F.col("origin") == "reply").groupBy("av", "part_no").agg(
        F.collect_list(
            F.struct(
                F.col("sec").alias("time"),
                F.col("sender").alias("name"),
                F.lit("").alias("sex"),
                F.lit(0).cast("bigint").alias("like"),
                F.lit(0).alias("level"),
                F.col("text").alias("message"),
            )
        ).alias("replies")
    )
    both = pages.join(replies, ["av", "part_no"], "full_outer")
    empty_pages = F.array().cast(schemas.VIDEO_RECORD["bullet_screen"].dataType)
    empty_replies = F.array().cast(schemas.VIDEO_RECORD["replies"].dataType)
    return both.select(
        "av",
        "part_no",
        F.coalesce("bullet_screen", empty_pages).alias("bullet_screen"),
        F.coalesce("replies", empty_replies).alias("replies"),
    )


def record_json(records: DataFrame, key_col: str = "av") -> DataFrame:
    """Records -> (key, value) with the record rendered as JSON text (publishing payload)."""
    body = [c for c in records.columns if c != "part_no"]
    return records.select(F.col(key_col).alias("key"), F.to_json(F.struct(*body)).alias("value"))


def valid_users(raw: DataFrame, payload_col: str = "value", uid_col: str = "uid") -> DataFrame:
    """User API payloads with ``code == 0``, with the unsigned CRC32 of the uid string, as a column
    and inside the payload (the published record). Others, malformed ones included, are left
    out; :func:`malformed_payloads` finds the latter."""
    parsed = raw.withColumn("_u", F.from_json(F.col(payload_col), schemas.USER_RECORD))
    return parsed.where(F.col("_u.code") == 0).select(
        *[F.col(c) for c in raw.columns if c != payload_col], crc32_of(F.col(uid_col)).alias("crc32"), payload_col
    ).withColumn(payload_col, set_json_field(payload_col, "crc32", F.col("crc32")))


def seed_ids(spark: SparkSession, first: int, last: int, prefix: str = fixed.VIDEO_ID_PREFIX,
             url_prefix: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Ids first..last (inclusive) as a distributed range, with the prefixed id and its URL."""
    df = spark.range(first, last + 1, numPartitions=num_partitions).select(
        F.col("id"), F.concat(F.lit(prefix), F.col("id").cast("string")).alias("key")
    )
    if url_prefix is not None:
        df = df.withColumn("url", F.concat(F.lit(url_prefix), F.col("id").cast("string")))
    return df


STAT_SCHEMA = "code INT, data STRUCT<view: BIGINT, reply: BIGINT, favorite: BIGINT, coin: BIGINT, share: BIGINT>"
TAG_SCHEMA = "code INT, data ARRAY<STRUCT<tag_name: STRING>>"
PAGELIST_SCHEMA = "code INT, data ARRAY<STRUCT<cid: BIGINT, page: INT, part: STRING>>"


def stat_fields(raw: DataFrame, payload_col: str = "json") -> DataFrame:
    """Stat payloads -> (av, view, replies_number, favorite, coin, share)."""
    d = F.from_json(F.col(payload_col), STAT_SCHEMA)["data"]
    return raw.select("av", d["view"].alias("view"), d["reply"].alias("replies_number"),
                      d["favorite"].alias("favorite"), d["coin"].alias("coin"), d["share"].alias("share"))


def tag_names(raw: DataFrame, payload_col: str = "json") -> DataFrame:
    """Tag payloads -> (av, tag): the list of tag names in payload order."""
    d = F.from_json(F.col(payload_col), TAG_SCHEMA)["data"]
    return raw.select("av", F.transform(d, lambda x: x["tag_name"]).alias("tag"))


def page_list(raw: DataFrame, payload_col: str = "json") -> DataFrame:
    """Page-list payloads -> one row per page (av, p, cid, part) and the record's ``count``
    (pages + 1, as the crawler's page counter ends one past the last page)."""
    d = F.from_json(F.col(payload_col), PAGELIST_SCHEMA)["data"]
    return raw.select("av", (F.size(d) + 1).alias("count"), F.explode(d).alias("_pg")).select(
        "av", F.col("_pg.page").alias("p"), F.col("_pg.cid").alias("cid"), F.col("_pg.part").alias("part"), "count"
    )


def nest_bullets(bullets: DataFrame) -> DataFrame:
    """(cid, sender, sec, text) -> (cid, bullet): map sender -> (second -> text).

    One map per bullet file: the group is exactly the content of one input document."""
    named = bullets.withColumn("sender", F.coalesce("sender", F.lit("")))
    per_sender = named.groupBy("cid", "sender").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("sec").cast("string"), F.col("text")))).alias("_m")
    )
    return per_sender.groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("sender", "_m"))).alias("bullet"))


def assemble_video_records(stats: DataFrame, tags: DataFrame, pages: DataFrame, bullets: DataFrame,
                           replies: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Join the parts of an item into one record of the record schema per item.

    ``pages``: (av, p, cid, part, count); ``bullets``: (cid, bullet); ``replies``: flattened
    reply rows (av, list_name, node_pos, child_pos, ...); ``info``: (av, title, author, type,
    time, url) of the item's page (a bangumi item has none). ``bullet_screen`` holds all pages
    of the item, sorted by number, ``replies`` all its replies in their order. All joins are
    equi-joins on av / cid (shuffle joins; no side is assumed small). A record is one message
    to publish, so the item's own size bounds it."""
    place = [c for c in ("p", "list_name", "node_pos", "child_pos") if c in replies.columns]
    hots_last = [F.when(F.col(c) == "replies", 0).otherwise(1).alias(c) if c == "list_name" else F.col(c) for c in place]
    fields = ["time", "name", "sex", "like", "level", "message"]
    reply_lists = replies.groupBy("av").agg(F.array_sort(F.collect_list(F.struct(*hots_last, F.struct(*fields).alias("r")))).alias("l"))
    reply_lists = reply_lists.select("av", F.transform("l", lambda x: x["r"]).alias("replies"))
    page_struct = F.struct(
        F.col("p"), F.col("cid"), F.col("part"),
        F.coalesce("bullet", F.create_map().cast(schemas.BULLET_PAGE["bullet"].dataType)).alias("bullet"),
    )
    by_page = F.struct("p", "cid").alias("k")
    screens = pages.join(bullets, "cid", "left").groupBy("av").agg(
        F.max("count").alias("count"), F.collect_list(F.struct(by_page, page_struct.alias("page"))).alias("l"))
    # maps cannot be compared, so pages are sorted by their number and file alone
    ordered = F.array_sort("l", lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    screens = screens.select("av", "count", F.transform(ordered, lambda x: x["page"]).alias("bullet_screen"))
    names = ["title", "author", "type", "time", "url"]
    if info is None:
        info = stats.select("av", *[F.lit(None).cast("array<string>" if n == "type" else "string").alias(n) for n in names])
    empty_replies = F.array().cast(schemas.VIDEO_RECORD["replies"].dataType)
    joined = screens.join(reply_lists, "av", "left").join(stats, "av", "left").join(tags, "av", "left")
    joined = joined.join(info.select("av", *names), "av", "left")
    return joined.select(
        "av", "title", "author", "view", "replies_number", "favorite", "coin", "share", "type", "tag", "time", "url",
        "count", "bullet_screen", F.coalesce("replies", empty_replies).alias("replies"),
    )
