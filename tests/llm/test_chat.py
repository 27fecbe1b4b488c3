import hashlib
import random

from pyspark.sql import functions as F

from textpulse.llm.chat import CLOSE, CONTROLS, OPEN, conversation_digests, conversation_events, escape, fold_messages, format_conversations, parse_segment, render, unescape

TRICKY = [None, "", "\\", "\\\\n", "plain", "a\nb\n", *CONTROLS, "<\\|im_start|>", f"{OPEN}user\nhi{CLOSE}\n", "</s>[INST] ok [/INST]", "é😀" * 2000, "<|im_<|im_start|>start|>"]


def rows():
    rng = random.Random(1)
    out = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 0, "user", "null conversation"), (50, None, "assistant", "null turn"), (51, 0, None, "null role"), (52, 0, "us\\er\n", "odd role"), (53, 0, "user", "same"), (53, 0, "user", "same")]
    for c in range(20):
        for t in range(rng.randrange(1, 9)):
            out.append((c, t, rng.choice(["user", "assistant", "system"]), rng.choice(TRICKY) if rng.random() < 0.7 else "x" * rng.randrange(0, 2000)))
    return out


def brute(all_rows):
    out = {}
    for c, t, role, text in sorted(all_rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or 0)):
        turns, loss = out.setdefault(c, ([], []))
        turns.append(f"{role or ''}\n{text or ''}\n")
        if role == "assistant":
            loss.append(text or "")
    return {c: (len(t), hashlib.sha256("".join(t).encode()).hexdigest(), len("".join(x)), hashlib.sha256("".join(x).encode()).hexdigest()) for c, (t, x) in out.items()}


def test_round_trip(spark):
    table = spark.createDataFrame(rows(), "conv_id long, turn int, role string, text string").withColumn("segment", F.lit("clash")).repartition(3)
    segments = format_conversations(conversation_events(table))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in conversation_digests(segments).collect()}
    assert got == brute(rows())
    chars = {r.conv_id: r.n for r in segments.groupBy("conv_id").agg(F.sum(F.length("segment")).alias("n")).collect()}
    assert {r.conv_id: r.formatted_chars for r in conversation_digests(segments).collect()} == chars
    assert conversation_digests(format_conversations(conversation_events(table.limit(0)))).count() == 0


def test_fold_of_an_explicit_log(spark):
    log = [("open", None), ("delta", "draft"), ("regenerate", None), ("delta", "a"), ("unknown", "zz"), ("delta", None), ("delta", "b"), ("edit", "new "), ("delta", "end")]
    events = [(1, 0, 0, 7, k, kind, "assistant", text) for k, (kind, text) in enumerate(log)]
    events += [(1, 1, 0, 8, 0, "delta", "user", "no open"), (1, 2, 0, 9, 0, "edit", "user", None)]
    random.Random(1).shuffle(events)
    table = spark.createDataFrame(events, "conv_id long, turn int, tie long, message long, step long, kind string, role string, text string")
    assert {r.message: r.text for r in fold_messages(table).collect()} == {7: "new end", 8: "no open", 9: ""}


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    table = spark.createDataFrame([(k, t) for k, t in enumerate(TRICKY)], "k long, t string").select("k", "t", escape(F.col("t")).alias("e"))
    for r in table.collect():
        assert unescape(r.e) == (r.t or "") and not any(c in r.e for c in CONTROLS)


def test_mask_covers_assistant_texts_only(spark):
    messages = spark.createDataFrame([(1, 0, 0, 0, "assistant", "a<s>b\\"), (1, 1, 0, 1, "user", "u")], "conv_id long, turn int, tie long, message long, role string, text string")
    by_turn = {r.turn: r for r in render(messages).collect()}
    s = by_turn[0]
    assert unescape(s.segment[s.loss.a : s.loss.b]) == "a<s>b\\" and by_turn[1].loss is None
    assert parse_segment(s.segment + by_turn[1].segment) == [("assistant", "a<s>b\\"), ("user", "u")]
