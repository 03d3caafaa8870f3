"""Credential redaction and safe text, as native column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key names, the mark, the limits and the URI alphabets.
SECRET_NAMES = (
    "password",
    "token",
    "api_key",
    "client_secret",
    "access_token",
    "secret_key",
    "aws_secret_access_key",
)
MARK = "[REDACTED]"
TEXT_LIMIT = 2_000
REASON_LIMIT = 1_000
SCHEME_CHARACTERS = "a-z0-9+.-"
USERINFO_CHARACTERS = "a-z0-9._~!$&'()*+,;=%-"
HOST_CHARACTERS = "a-z0-9.-"
DEFAULT_REASON = "see the task log for the cause"

# Every character that counts as white space or as part of a word in Unicode text.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(c) for c in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
SPACE = r"\s\x{1c}-\x{1f}"
WORD = r"\p{L}\p{N}_"
_FLAGS = "(?iU)"

# What may follow a word such as a key's value: everything up to white space, comma, semicolon.
_VALUE = rf"[^,;{SPACE}]+"
_IS = rf"[{SPACE}]*[=:][{SPACE}]*"
_NAME = f"(?:{'|'.join(SECRET_NAMES)})"
_BARE_KEY = rf"(?<![a-z0-9]){_NAME}"
_NAMED = rf"{_FLAGS}({_BARE_KEY}{_IS}){_VALUE}"
_BEARER = rf"{_FLAGS}(?<![{WORD}])(bearer[{SPACE}]+){_VALUE}"


def _quoted_pattern() -> str:
    """A key, bare or quoted, and a value in either quote sign; the sign is group 2 or 3.

    A quoted key may carry more words before the name, each ending in an underscore. In
    the value a backslash takes the next character with it, and lines do not continue.
    """
    keys, values = [_BARE_KEY], []
    for sign in "\"'":
        keys.append(f"{sign}(?:[a-z0-9_]*_)?{_NAME}{sign}")
        values.append(rf"({sign})(?:[^{sign}\\\r\n]|\\[^\r\n])*+{sign}")
    return f"{_FLAGS}((?:{'|'.join(keys)}){_IS})(?:{'|'.join(values)})"


_QUOTED = _quoted_pattern()

# Letters outside ASCII that case-insensitive matching takes for s, k and i.
_FOLD = ("\u017f\u212a\u0130\u0131", "skii")


def _replaced(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return text


def _without_userinfo(text: Column) -> Column:
    """Hide what stands before the @ of an authority.

    The text is cut behind each ``://``, so every authority starts a piece, and whether
    the piece before ends in a scheme is read backwards from its end. Of ``user:password``
    the password goes. Anything else goes as a whole, if it is made of the characters
    allowed there and a host follows up to the end of the authority.
    """
    scheme_backwards = rf"{_FLAGS}\A//:[{SCHEME_CHARACTERS}]*[a-z](?![{WORD}])"
    password = rf"\A([^/@:{SPACE}]+:)[^@/?#{SPACE}]+@"
    host = rf"(?:[{HOST_CHARACTERS}]+|\[[0-9a-f:.]+\])"
    token = rf"{_FLAGS}\A[{USERINFO_CHARACTERS}]++@(?={host}(?::\d+)?(?:[/?#{SPACE}]|\z))"
    pieces = F.split(text, "(?<=://)", -1)

    def clean(piece: Column, at: Column) -> Column:
        before = F.when(at > 0, F.get(pieces, at - 1)).otherwise(F.lit(""))
        is_authority = F.contains(piece, F.lit("@")) & F.regexp_like(
            F.reverse(before), F.lit(scheme_backwards)
        )
        hidden = _replaced(piece, (password, f"$1{MARK}@"), (token, f"{MARK}@"))
        return F.when(is_authority, hidden).otherwise(piece)

    return F.array_join(F.transform(pieces, clean), "")


def redact(text: Column, max_length: int | None = TEXT_LIMIT) -> Column:
    """Hide known credential forms in the whole text, then cut to ``max_length``.

    Order matters: an authority is cleaned before a named value can swallow it. Plain
    substring tests keep the patterns away from texts that cannot match them.
    """
    folded = F.lower(F.translate(text, *_FOLD))
    has_name = reduce(or_, [F.contains(folded, F.lit(n)) for n in SECRET_NAMES])
    has_authority = F.contains(text, F.lit("://")) & F.contains(text, F.lit("@"))
    clean = F.when(has_authority, _without_userinfo(text)).otherwise(text)
    for possible, steps in (
        (has_name, ((_QUOTED, f"$1$2$3{MARK}$2$3"), (_NAMED, f"$1{MARK}"))),
        (F.contains(folded, F.lit("bearer")), ((_BEARER, f"$1{MARK}"),)),
    ):
        clean = F.when(possible, _replaced(clean, *steps)).otherwise(clean)
    return clean if max_length is None else F.left(clean, F.lit(max_length))


def escape(text: Column) -> Column:
    """Replace the three markup characters by entities."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def collapse_space(text: Column) -> Column:
    one_space = F.regexp_replace(text, F.lit(rf"(?U)[{SPACE}]+"), F.lit(" "))
    return F.trim(one_space)


def strip(text: Column) -> Column:
    """Text without white space of any kind at either end."""
    return F.trim(text, F.lit(WHITE))


def is_blank(text: Column) -> Column:
    """NULL, empty or white space only."""
    return text.isNull() | (strip(text) == "")


def safe_url(url: Column) -> Column:
    """A redacted http(s) URL without user information, else NULL."""
    # URL parsers drop tabs and line ends and any leading control characters
    cleaned = F.regexp_replace(
        F.regexp_replace(url, F.lit(r"[\t\r\n]"), F.lit("")), F.lit(r"^[\x{00}- ]+"), F.lit("")
    )
    authority = F.regexp_extract(cleaned, r"^[^:/?#]+://([^/?#]*)", 1)
    brackets_match = F.contains(authority, F.lit("[")) == F.contains(authority, F.lit("]"))
    accepted = (
        F.regexp_like(cleaned, F.lit(r"^(?i)https?:"))
        & ~F.contains(authority, F.lit("@"))
        & brackets_match
    )
    return F.when(accepted, redact(url))


def normalize_reason(reason: Column, exception: Column) -> Column:
    """Reason, else exception, else a default; redacted, escaped and on one line."""

    def line(text: Column) -> Column:
        return F.left(collapse_space(escape(redact(text))), F.lit(REASON_LIMIT))

    return (
        F.when(~is_blank(reason), line(reason))
        .when(exception.isNotNull(), line(exception))
        .otherwise(F.lit(DEFAULT_REASON))
    )


def reason_label(reason: Column, exception: Column) -> Column:
    """Which of the three sources the normalized reason came from."""
    return (
        F.when(~is_blank(reason), F.lit("reason"))
        .when(exception.isNotNull(), F.lit("exception"))
        .otherwise(F.lit("default"))
    )
