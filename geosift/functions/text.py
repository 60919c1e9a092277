"""Scalar functions: numbers, escapes, entities, names, encodings, occurrence arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """A number in text, integer or float, as double; null where it is none."""
    return F.trim(text).try_cast("double")


def number_text(value: Column) -> Column:
    """A double in plain decimal notation, without trailing zeros; null stays null."""
    plain = value.cast("decimal(38,12)").cast("string")
    return F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def any_to_text(value: Column) -> Column:
    """Canonical text of any scalar; null stays null."""
    return value.cast("string")


def row_digest(*values: Column) -> Column:
    """A digest that is equal for rows of equal values; nulls are told from empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def escape_attribute(text: Column) -> Column:
    """& < > and the double quote, & first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_text(text: Column) -> Column:
    """& \" and < ; > stays."""
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def decode_entities(text: Column) -> Column:
    """The five predefined entities and character references; others stay as they are.

    The text is cut at the references, each piece is decoded on its own, and nothing is decoded twice.
    """
    named = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
    parts = F.regexp_extract_all(text, F.lit(r"(&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});|&|[^&]+)"), 1)

    def code(n: Column) -> Column:
        """A code point as text, by way of big-endian UTF-32; null where it is not a character."""
        ok = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(F.when(ok, n).otherwise(63)), 8, "0")), "UTF-32"))

    def one(p: Column) -> Column:
        body = F.substring(p, 2, F.length(p) - 2)
        out = F.when(body.startswith("#x"), code(F.conv(F.substring(body, 3, 6), 16, 10).cast("long")))
        out = out.when(body.startswith("#"), code(F.substring(body, 2, 7).cast("long")))
        for k, v in named.items():
            out = out.when(body == k, F.lit(v))
        return F.when(p.endswith(";") & p.startswith("&"), F.coalesce(out, p)).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def local_name(name: Column) -> Column:
    """'prefix:local' -> 'local'."""
    return F.substring_index(name, ":", -1)


def name_prefix(name: Column) -> Column:
    """'prefix:local' -> 'prefix'; '' without one."""
    return F.when(F.instr(name, ":") > 0, F.substring_index(name, ":", 1)).otherwise("")


def expanded_name(uri: Column, local: Column) -> Column:
    """'{uri}local', or the local name where there is no namespace."""
    return F.when(F.coalesce(uri, F.lit("")) == "", local).otherwise(F.concat(F.lit("{"), uri, F.lit("}"), local))


def detect_encoding(content: Column) -> Column:
    """The encoding of an XML file's bytes: byte order mark, then the first bytes, then the prolog, else UTF-8."""
    head = F.hex(F.substring(content, 1, 4))
    prolog = F.lower(F.regexp_extract(F.decode(F.substring(content, 1, 200), "ISO-8859-1"), r"""^<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""", 1))
    return (F.when(head.startswith("EFBBBF"), "utf-8").when(head.startswith("FEFF"), "utf-16be").when(head.startswith("FFFE"), "utf-16le")
            .when(head == "003C003F", "utf-16be").when(head == "3C003F00", "utf-16le")
            .when(prolog != "", prolog).otherwise("utf-8"))


def is_ascii(text: Column) -> Column:
    return text.rlike(r"\A[\x00-\x7F]*\z")


def is_latin1(text: Column) -> Column:
    return text.rlike(r"\A[\x00-\xFF]*\z")


def min_occurs(a: Column, b: Column) -> Column:
    """The smaller bound; null is unbounded."""
    return F.least(a, b)


def multiply_occurs(a: Column, b: Column) -> Column:
    """The product of bounds: 0 dominates, then null (unbounded) absorbs."""
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(a * b)
