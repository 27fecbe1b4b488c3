"""Explicit schemas of the nested records and of the result tables."""

from pyspark.sql import types as T

BULLET_PAGE = T.StructType(
    [
        T.StructField("p", T.IntegerType()),
        T.StructField("cid", T.LongType()),
        T.StructField("part", T.StringType()),
        # sender -> (epoch second as string -> message text)
        T.StructField("bullet", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))),
    ]
)

REPLY = T.StructType(
    [
        T.StructField("time", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("sex", T.StringType()),
        T.StructField("like", T.LongType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("message", T.StringType()),
    ]
)

VIDEO_RECORD = T.StructType(
    [
        T.StructField("av", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("view", T.LongType()),
        T.StructField("replies_number", T.LongType()),
        T.StructField("favorite", T.LongType()),
        T.StructField("coin", T.LongType()),
        T.StructField("share", T.LongType()),
        T.StructField("type", T.ArrayType(T.StringType())),
        T.StructField("tag", T.ArrayType(T.StringType())),
        T.StructField("time", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("count", T.IntegerType()),
        T.StructField("bullet_screen", T.ArrayType(BULLET_PAGE)),
        T.StructField("replies", T.ArrayType(REPLY)),
    ]
)

USER_RECORD = T.StructType(
    [
        T.StructField("code", T.IntegerType()),
        T.StructField("crc32", T.LongType()),
        T.StructField(
            "data",
            T.StructType([T.StructField("card", T.StructType([T.StructField("mid", T.StringType())]))]),
        ),
    ]
)

# Reply API payload: code, data{replies[], hots[]}; each node may carry child replies.
_REPLY_NODE_FIELDS = [
    T.StructField("ctime", T.LongType()),
    T.StructField("like", T.LongType()),
    T.StructField(
        "member",
        T.StructType(
            [
                T.StructField("uname", T.StringType()),
                T.StructField("sex", T.StringType()),
                T.StructField("level_info", T.StructType([T.StructField("current_level", T.StringType())])),
            ]
        ),
    ),
    T.StructField("content", T.StructType([T.StructField("message", T.StringType())])),
]
REPLY_CHILD = T.StructType(list(_REPLY_NODE_FIELDS))
REPLY_NODE = T.StructType(list(_REPLY_NODE_FIELDS) + [T.StructField("replies", T.ArrayType(REPLY_CHILD))])
REPLY_PAYLOAD = T.StructType(
    [
        T.StructField("code", T.IntegerType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("replies", T.ArrayType(REPLY_NODE)),
                    T.StructField("hots", T.ArrayType(REPLY_NODE)),
                ]
            ),
        ),
    ]
)

# Result tables (partitioned by `day`).
HOT_WORD = "times_stamp BIGINT, word STRING, count BIGINT, day STRING"
EMOTIONAL_WORD = "times_stamp BIGINT, av STRING, emotional STRING, count BIGINT, day STRING"
INCREMENT = "time_stamp BIGINT, metric STRING, count BIGINT, day STRING"
RAW_DOCUMENT = "id STRING, data STRING, seq BIGINT"

# Message stream produced by flattening records: one row per bullet or reply.
MESSAGE = "av STRING, origin STRING, sec BIGINT, text STRING"
