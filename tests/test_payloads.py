import json

from pyspark.sql import functions as F

from textpulse.operators.payloads import (
    assemble_records,
    assemble_video_records,
    flatten_replies,
    last_text_wins,
    malformed_bullets,
    malformed_payloads,
    nest_bullets,
    page_fields,
    page_triage,
    parse_bullets,
    record_json,
    seed_ids,
    valid_users,
    video_page_fields,
)
from textpulse import schemas
from textpulse.operators.shape import explode_messages
from textpulse.sources.records import parse_records


def _node(t, name, msg, children=None):
    n = {"ctime": t, "like": 1, "member": {"uname": name, "sex": "x", "level_info": {"current_level": "3"}},
         "content": {"message": msg}}
    if children is not None:
        n["replies"] = children
    return n


def test_reply_tree_order_closed_code_and_hot_duplicates(spark):
    child = _node(2, "c", "child")
    top = _node(1, "p", "parent", [child])
    ok = {"code": 0, "data": {"replies": [top, _node(3, "q", "solo", None)], "hots": [top]}}
    closed = {"code": 12002, "data": {"replies": [top], "hots": []}}
    raw = spark.createDataFrame([("av1", json.dumps(ok)), ("av2", json.dumps(closed))], "av STRING, json STRING")
    rows = flatten_replies(raw).orderBy("list_name", "node_pos", "child_pos").collect()
    got = [(r.av, r.list_name, r.node_pos, r.child_pos, r.message, r.level) for r in rows]
    assert got == [
        ("av1", "hots", 0, -1, "parent", 3),
        ("av1", "hots", 0, 0, "child", 3),
        ("av1", "replies", 0, -1, "parent", 3),
        ("av1", "replies", 0, 0, "child", 3),
        ("av1", "replies", 1, -1, "solo", 3),
    ]


def test_bullet_xml_fields_and_last_wins(spark):
    xml = ('<i><d p="1.0,1,25,0,1577836999,0,abcd,77">hello</d>'
           '<d p="2.0,1,25,0,1577836999,0,abcd,78">again &amp; &lt;b&gt;</d>'
           '<d p="3.0,1,25,0,1577837000,0,efgh,79"> spaced </d></i>')
    raw = spark.createDataFrame([(5, xml)], "cid BIGINT, xml STRING")
    parsed = parse_bullets(raw)
    assert [(r.pos, r.sender, r.sec, r.text) for r in parsed.orderBy("pos").collect()] == [
        (0, "abcd", 1577836999, "hello"), (1, "abcd", 1577836999, "again & <b>"), (2, "efgh", 1577837000, " spaced "),
    ]
    nested = {(r.sender, r.sec): r.text for r in last_text_wins(parsed).collect()}
    assert nested == {("abcd", 1577836999): "again & <b>", ("efgh", 1577837000): " spaced "}


def test_page_triage_and_fields(spark):
    pages = spark.createDataFrame(
        [
            (1, '<div class="r-con"><title>T1</title><span>a</span><span>2020-01-01</span></div>'),
            (2, "<title>T2</title><span>only</span>"),
            (3, "<p>视频去哪了呢</p>"),
            (4, "<h1>x</h1>"),
        ],
        "page_id BIGINT, html STRING",
    )
    kinds = {r.page_id: r.kind for r in page_triage(pages).collect()}
    assert kinds == {1: "video", 2: "bangumi", 4: "bangumi"}
    f = {r.page_id: (r.title, r.upload_time) for r in page_fields(pages).collect()}
    assert f == {1: ("T1", "2020-01-01"), 2: ("T2", "only"), 3: ("", ""), 4: ("", "")}


def test_assembled_records_round_trip_one_record_per_page(spark):
    rows = [("av1", k // 1000 + 1, "bullet", f"s{k % 7}", 1000 + k, f"t{k}", k) for k in range(20_000)]
    rows += [("av1", 1, "reply", "r", 50000 + k, f"r{k}", 100_000 + k) for k in range(30)]
    rows += [("av2", 1, "bullet", "s", 1, "only", 2000), ("av2", 1, "bullet", "s", 1, "later", 2001), ("av3", 1, "bullet", None, 2, "x", 1)]
    msgs = spark.createDataFrame(rows, "av STRING, p INT, origin STRING, sender STRING, sec BIGINT, text STRING, seq BIGINT")
    records = assemble_records(msgs)
    assert records.where("av = 'av1'").count() == 20 and records.select("av", "part_no").distinct().count() == records.count()
    good, bad = parse_records(record_json(records), schemas.VIDEO_RECORD)
    assert bad.count() == 0
    back = explode_messages(good, drop_special=None).select("av", "origin", "sender", "sec", "text")
    expected = [(r[0], r[2], r[3] or "", *r[4:6]) for r in rows if r[5] != "only"]  # same (sender, second): last text wins
    assert sorted(tuple(r) for r in back.collect()) == sorted(expected)


GOLDEN_PAGE = """<html><body><!-- 视频去哪了呢 --><div class="wide r-con"><p>x</p>
<a class="n" report-id="name" href="/u/1">The <b>Author</b></a></div>
<div id="viewbox_report" class="video-info report-wrap-module report-scroll-module">
<h1 title="t"><span>A title &amp; more</span></h1><div class="tm-info"><a href="/1">Games</a>&gt;<a href="/2">Solo</a>
<span class="a">100 views</span><span>2020-01-02 03:04</span></div></div><span>outside</span></body></html>"""


def test_golden_video_page(spark):
    one = GOLDEN_PAGE.replace('<span class="a">100 views</span>', "")
    pages = spark.createDataFrame([(1, GOLDEN_PAGE), (2, one), (3, "<p>nothing</p>"), (4, None), (5, '<div class="r-cons">视频去哪了呢</div>')], "page_id BIGINT, html STRING")
    got = {r.page_id: (r.author, r.title, r.type, r.time) for r in video_page_fields(pages).collect()}
    assert got[1] == ("The Author", "A title &amp; more", ["Games", "Solo"], "2020-01-02 03:04") == got[2]
    assert got[3] == got[4] == ("", "", [], "")
    # the deleted text only counts in the page's text, and the class only as a class of a div
    assert {r.page_id: r.kind for r in page_triage(pages).collect()} == {1: "video", 2: "video", 3: "bangumi", 4: "bangumi"}


def test_an_item_is_one_record_with_its_pages_in_order(spark):
    pages = spark.createDataFrame([("av1", 10, 7, "ten", 4), ("av1", 2, 9, "two", 4), ("av1", 1, 8, "one", 4)], "av STRING, p INT, cid BIGINT, part STRING, count INT")
    stats = spark.createDataFrame([("av1", 5, 1, 1, 1, 1)], "av STRING, view BIGINT, replies_number BIGINT, favorite BIGINT, coin BIGINT, share BIGINT")
    tags = spark.createDataFrame([("av1", ["t"])], "av STRING, tag ARRAY<STRING>")
    bullets = nest_bullets(spark.createDataFrame([(9, "s", 1, "x"), (9, None, 1, "y")], "cid BIGINT, sender STRING, sec BIGINT, text STRING"))
    info = spark.createDataFrame([("av1", "title", "author", ["a"], "time", "url")], "av STRING, title STRING, author STRING, type ARRAY<STRING>, time STRING, url STRING")
    replies = spark.createDataFrame([("av1", 2, "b"), ("av1", 1, "a")], "av STRING, p INT, message STRING").selectExpr(
        "av", "p", "1L as time", "'n' as name", "'' as sex", "0L as like", "0 as level", "message")
    r = assemble_video_records(stats, tags, pages, bullets, replies, info).collect()
    assert len(r) == 1 and [p.part for p in r[0].bullet_screen] == ["one", "two", "ten"]
    assert r[0].bullet_screen[1].bullet == {"s": {"1": "x"}, "": {"1": "y"}} and [x.message for x in r[0].replies] == ["a", "b"]
    assert (r[0].title, r[0].author, r[0].type, r[0].time, r[0].url) == ("title", "author", ["a"], "time", "url")


def test_malformed_payloads_are_set_aside(spark):
    xml = spark.createDataFrame([(1, '<i><d p="1,1,25,0,77,0,s,9">ok</d><d p="1">short</d><d>none</d><d p="1,1,1,1,x,0,s">no second</d></i>')], "cid BIGINT, xml STRING")
    assert [(r.sender, r.sec, r.text) for r in parse_bullets(xml).collect()] == [("s", 77, "ok")]
    assert sorted(r.pos for r in malformed_bullets(xml).collect()) == [1, 2, 3]
    raw = spark.createDataFrame([("a", "{bad"), ("b", None), ("c", '{"data":{"replies":[{"content":{"message":"m"}}]}}'), ("d", '{"code":12002}')], "av STRING, json STRING")
    assert sorted(r.av for r in malformed_payloads(raw).collect()) == ["a", "b"]
    assert [(r.av, r.message) for r in flatten_replies(raw).collect()] == [("c", "m")]
    good, bad = parse_records(spark.createDataFrame([('{"av":"a","view":"abc"}',), ('{"av":"a","view":3}',), ("{}",), ("[1]",), (None,)], "value STRING"), schemas.VIDEO_RECORD)
    assert [r.view for r in good.collect()] == [3]
    assert sorted(r.reason for r in bad.collect()) == ["empty", "malformed", "malformed", "malformed"]


def test_valid_users_and_seed_ids(spark):
    raw = spark.createDataFrame(
        [("12345", '{"code":0,"data":{"card":{"mid":"12345"}}}'), ("7", '{"code":-404}')], "uid STRING, value STRING"
    )
    assert [(r.uid, r.crc32) for r in valid_users(raw).collect()] == [("12345", 3421846044)]
    assert '"crc32":3421846044' in valid_users(raw).first().value
    ids = seed_ids(spark, 1, 10, url_prefix="u/av", num_partitions=3)
    assert ids.count() == 10 and ids.agg(F.max("id")).first()[0] == 10
    assert ids.where("id = 10").first().key == "av10"
