"""Column expressions for message text. All are JVM-side built-ins (whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textpulse import fixed

# Runs of letters or digits: the word boundary of the spaced-script tokeniser.
WORD_PATTERN = r"[\p{L}\p{N}]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(text: Column | str, strip_latin: bool = False, replacement: str = "") -> Column:
    """Remove punctuation, symbols and separators; optionally ASCII letters as well."""
    out = F.regexp_replace(_c(text), fixed.STRIP_PATTERN, replacement)
    if strip_latin:
        out = F.regexp_replace(out, fixed.LATIN_PATTERN, replacement)
    return out


def is_special(text: Column | str) -> Column:
    """True for bracketed special messages such as ``[1,2]``: first char '[' and last ']'.

    The original tests the inner characters of the JSON-quoted text, which is the same as
    testing the raw text's first and last character when it has at least two characters.
    """
    t = _c(text)
    return t.startswith("[") & t.endswith("]") & (F.length(t) >= 2)


def escaped_form(text: Column | str) -> Column:
    """The JSON-escaped body of a string (quotes removed), as the original saw message text.

    ``a"b`` + newline becomes ``a\\"b\\n``; used by the parity mode where escape artefacts
    (a newline turning into the letter ``n`` once the backslash is stripped) are kept.
    """
    quoted = F.to_json(F.array(_c(text)))  # ["..."]
    return quoted.substr(F.lit(3), F.length(quoted) - F.lit(4))


def words(text: Column | str) -> Column:
    """Array of letter/digit runs of the text, in order."""
    return F.regexp_extract_all(_c(text), F.lit(WORD_PATTERN), 0)


def token_length(word: Column | str, utf16: bool = False) -> Column:
    """Length in code points, or in UTF-16 code units when ``utf16`` (Java String.length)."""
    w = _c(word)
    if utf16:
        return (F.length(F.encode(w, "UTF-16BE")) / 2).cast("int")
    return F.length(w)


def crc32_of(value: Column | str) -> Column:
    """Unsigned CRC32 of the UTF-8 bytes of the value's string form."""
    return F.crc32(F.encode(_c(value).cast("string"), "UTF-8"))
