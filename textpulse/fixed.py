"""Fixed values that must equal the original application's for identical results.

Everything here is data, not logic: window length, threshold, word lists, the character
classes removed from message text, metric names and the date format of day partitions.
"""

# --- fixed values (must match the original application) -------------------------------

# Tumbling window / content bucket length in seconds (5 minutes); buckets are stored in ms.
BUCKET_SECONDS = 300

# Hot-word threshold: a (bucket, word) pair is reported when its count is >= 10.
HOT_WORD_THRESHOLD = 10

# Tokens of length <= 1 are dropped on the hot-word paths.
MIN_TOKEN_LENGTH = 2

# Characters removed before segmentation: Unicode punctuation, symbols and separators.
STRIP_PATTERN = r"[\pP\pS\pZ]"

# Characters additionally removed on the windowed sentiment path: ASCII letters.
LATIN_PATTERN = r"[a-zA-Z]"

# Blacklist shipped with the application, one word per line, in file order.
BLACKLIST_WORDS = ["amp", "av", "nav", "nn", "AV", "这个", "回复"]

# Polarity labels; a word in both lists is negative (negative is tested first).
NEGATIVE = "negative"
POSITIVE = "positive"
UNKNOWN = "unknown"

# The four metrics of one snapshot.
SNAPSHOT_METRICS = ["hotword", "positive", "negative", "unknown"]

# Snapshot period (5 minutes) and look-back of the latest-snapshot query (30 minutes).
SNAPSHOT_PERIOD_SECONDS = 300
LOOKBACK_MINUTES = 30

# Day partitions are named by the calendar day in this format.
DAY_FORMAT = "yyyyMMdd"

# Page triage markers of the crawler: the deleted-video text, and the class that marks a
# regular video page (pages without it are treated as bangumi pages).
DELETED_MARKER = "视频去哪了呢"
VIDEO_MARKER = 'class="r-con"'

# Reply API code meaning "replies closed": such payloads yield no rows.
REPLIES_CLOSED_CODE = 12002

# Bullet XML attribute `p` fields: epoch second is field 5 and sender is field 7 (1-based).
BULLET_SECOND_FIELD = 4
BULLET_SENDER_FIELD = 6

# Crawled id spaces: videos 1..10,000,000 inclusive, users 1..9,999,999.
VIDEO_ID_MAX = 10_000_000
USER_ID_MAX = 9_999_999

# Records and pages carry these prefixes.
VIDEO_ID_PREFIX = "av"
