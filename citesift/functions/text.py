"""String expressions with the rules of browser strings: wide white space, ASCII word edges, UTF-16 lengths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of browser strings as members of a character class; the plain \s of Java and RE2 is ASCII only.
WIDE_SPACE = r"\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{WIDE_SPACE}]"
#: The same characters, for Python's strip.
SPACE_CHARS = "\t\n\x0b\x0c\r \xa0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Edges of ASCII words.
EDGE_BEFORE, EDGE_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
ELLIPSIS = "…"


def js_trim(c: Column) -> Column:
    """Without white space at both ends, no-break spaces and byte-order marks included."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def utf16_left(c: Column, n: int) -> Column:
    """The first n UTF-16 units; a character cut in half is dropped."""
    units = F.encode(c, "UTF-16BE")
    last = F.hex(F.substring(units, 2 * n - 1, 2))
    whole = F.when(last.between("D800", "DBFF"), 2 * n - 2).otherwise(2 * n)
    # Most texts hold no such character, and characters are then units.
    plain = F.octet_length(units) == 2 * F.length(c)
    return F.when(plain, F.substring(c, 1, n)).otherwise(F.decode(F.substring(units, F.lit(1), whole), "UTF-16BE"))


def normalise(c: Column) -> Column:
    """Line ends to LF, runs of spaces, tabs and no-break spaces to one space, no spaces around LF, two LF in a row at most, trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\x{A0}]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return js_trim(c)


def shorten(c: Column, limit: int) -> Column:
    """At most limit characters and an ellipsis; cut at the last space if that keeps over 60 % of the limit."""
    head = F.substring(c, 1, limit)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    at_space = (F.instr(head, " ") > 0) & (space > 0.6 * limit)
    cut = F.when(at_space, F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(cut, rf"{SPACE}+\z", ""), F.lit(ELLIPSIS)))


def masked_key(c: Column) -> Column:
    return F.concat(F.left(c, F.lit(4)), F.lit(ELLIPSIS), F.right(c, F.lit(4)))


def file_name(c: Column) -> Column:
    """The last part of a path, 120 characters at most."""
    return F.substring(F.regexp_replace(c, r"^.*[\\/]", ""), 1, 120)


def uri_component(c: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are."""
    c = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def megabytes(size: Column) -> Column:
    return F.format_number(size / F.lit(1024 * 1024), 1)


def lakh_grouping(c: Column) -> Column:
    """Digits grouped the Indian way: the last three, then by two."""
    digits = c.cast("string")
    return F.regexp_replace(digits, r"(?<=\d)(?=(\d{2})*\d{3}\z)", ",")


def escaped(s: str) -> str:
    """A literal as a pattern whose spaces match any run of white space."""
    return re.sub(r"(?:\\ )+", lambda _: f"{SPACE}+", re.escape(s))
