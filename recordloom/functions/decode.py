"""Decoding as Column expressions: Catalyst prunes the fields that a query doesn't use, and no byte leaves the JVM."""

from __future__ import annotations

import re
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.plans.copybook import Condition, Field, Layout

ASCII, CP500 = "ascii", "cp500"
UNSUPPORTED = "(unsupported PIC/usage)"
SHORT = "(record too short for field)"
EDITED_FAILED = "(edited decode failed)"
EDITED_EBCDIC = "(edited picture under EBCDIC: deferred)"
#: Everything that Unicode calls white space, at a text's end.
_TRAILING = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _cp500_tables() -> tuple[str, str]:
    """From the 8-bit character of each EBCDIC byte to its character; those beyond ASCII aren't valid UTF-8 alone."""
    pairs = [(chr(b), bytes([b]).decode("cp500")) for b in range(1, 256)]
    return "".join(a for a, _ in pairs), "".join(c if ord(c) < 128 else "�" for _, c in pairs)


CP500_FROM, CP500_TO = _cp500_tables()


def right_trim(c: Column) -> Column:
    return F.rtrim(c, F.lit(_TRAILING))


def raw_bytes(f: Field, record: str = "record") -> Column:
    """The field's bytes; null where the record ends before them."""
    return F.when(F.length(record) >= f.offset + f.size, F.substring(record, f.offset + 1, f.size))


def raw_hex(f: Field, record: str = "record") -> Column:
    return F.lower(F.hex(raw_bytes(f, record)))


def text_of(raw: Column, encoding: str) -> Column:
    """Text of raw bytes, not trimmed."""
    if encoding == CP500:
        return F.translate(F.decode(raw, "ISO-8859-1"), CP500_FROM, CP500_TO)
    return F.make_valid_utf8(raw.cast("string"))


def _spread(digits: Column, n: int, scale: int, negative: Column, kind: str) -> Column:
    """A decimal of type ``kind`` from a run of n digits; null where they are none."""
    whole = digits
    if scale:
        head = F.substring(digits, 1, n - scale) if n > scale else F.lit("0")
        whole = F.concat(head, F.lit("."), F.substring(digits, n - scale + 1, scale) if n >= scale else F.lpad(digits, scale, "0"))
    signed = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), whole)
    return signed.try_cast("long").cast(kind) if not scale and n <= 18 else signed.try_cast(kind)


def _sign_and_digits(f: Field, encoding: str, record: str) -> tuple[Column, Column, Column]:
    """Digits, whether negative, and whether every byte is what the storage allows."""
    raw, h = raw_bytes(f, record), F.hex(raw_bytes(f, record))
    n = f.size
    if f.usage == "COMP-3":
        digits, sign = F.substring(h, 1, 2 * n - 1), F.substring(h, 2 * n, 1)
        return digits, sign.isin("B", "D"), h.rlike("^[0-9]+[A-F]$")
    if f.usage == "COMP-6":
        return h, F.lit(False), h.rlike("^[0-9]+$")
    plus_minus = ("4E", "60") if encoding == CP500 else ("2B", "2D")
    if f.separate:
        sign = F.substring(h, 1, 2) if f.leading else F.substring(h, 2 * n - 1, 2)
        body = F.substring(h, 3, 2 * n - 2) if f.leading else F.substring(h, 1, 2 * n - 2)
        zone = "F" if encoding == CP500 else "3"
        return F.regexp_replace(body, ".(.)", "$1"), sign == plus_minus[1], body.rlike(f"^({zone}[0-9])+$") & sign.isin(*plus_minus)
    signed = F.lit(f.pic.signed)
    if encoding == CP500:
        at = 1 if f.leading else 2 * n - 1
        zone = F.substring(h, at, 1)
        low = F.regexp_replace(h, ".(.)", "$1")
        return low, signed & zone.isin("B", "D"), low.rlike("^[0-9]+$") & h.rlike("^[A-F].(F.)*$" if f.leading else "^(F.)*[A-F].$")
    # bytes beyond ASCII are no text here, and match no digit
    s = raw.cast("string")
    point = F.substring(s, 1, 1) if f.leading else F.substring(s, n, 1)
    rest = F.substring(s, 2, n - 1) if f.leading else F.substring(s, 1, n - 1)
    digit = F.translate(point, "pqrstuvwxy{}", "012345678900")
    digits = F.concat(digit, rest) if f.leading else F.concat(rest, digit)
    others = f"[0-9]{{{n - 1}}}"
    return digits, signed & point.rlike("[p-y}]"), s.rlike(f"^[0-9p-y{{}}]{others}\\z" if f.leading else f"^{others}[0-9p-y{{}}]\\z")


def _binary(f: Field, record: str) -> Column:
    raw = raw_bytes(f, record)
    if f.usage == "COMP-5":
        raw = F.concat(*(F.substring(raw, i, 1) for i in range(f.size, 0, -1)))
    unsigned = F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")
    value = unsigned - F.when(F.hex(raw) >= "8", F.lit(Decimal(2 ** (8 * f.size)))).otherwise(F.lit(Decimal(0))) if f.pic.signed else unsigned
    return (value.cast("decimal(21,0)") * F.lit(Decimal(1).scaleb(-f.pic.scale)) if f.pic.scale else value).cast(f"decimal(38,{f.pic.scale})")


def edited_pattern(pic: str) -> str:
    """What a presentation under this picture may look like."""
    body = re.sub("(CR|DB)$", "", pic)
    each = {"9": "[0-9]", "Z": "[0-9 ]", ",": "[, ]", ".": "\\.", "+": "[+-]", "-": "[- ]"}
    tail = f"(?:{pic[-2:]}|  )" if body != pic else ""
    return "^" + "".join(each[c] for c in body) + tail + "$"


def valid(f: Field, encoding: str = ASCII, record: str = "record") -> Column:
    """Whether the bytes are a value of the declared storage; never null for a field that fits the record."""
    here = F.length(record) >= f.offset + f.size
    if f.category == "alphanumeric":
        return here
    if f.category == "numeric":
        ok = F.lit(True) if f.usage in ("COMP", "COMP-5", "COMP-X") else _sign_and_digits(f, encoding, record)[2]
        return here & F.coalesce(ok, F.lit(False))
    if f.category == "edited" and encoding == ASCII:
        return here & F.coalesce(F.decode(raw_bytes(f, record), "ISO-8859-1").rlike(edited_pattern(f.pic.text)), F.lit(False))
    return F.lit(False)


def number(f: Field, encoding: str = ASCII, record: str = "record") -> Column:
    """The exact decimal of a numeric or edited field; null where its bytes are not valid."""
    if f.category == "edited":
        s = F.decode(raw_bytes(f, record), "ISO-8859-1")
        digits = F.translate(s, " ,+-CRDB", "")  # all that a valid presentation has beside digits and point
        if marks := [s.contains(m) for m, where in (("-", "[+-]"), ("CR", "CR"), ("DB", "DB")) if re.search(where, f.pic.text)]:
            digits = F.concat(F.when(reduce(Column.__or__, marks), F.lit("-")).otherwise(F.lit("")), digits)
        return F.when(valid(f, encoding, record), digits.try_cast(f"decimal({max(f.pic.digits, 1)},{f.pic.scale})"))
    if f.category != "numeric":
        raise ValueError(f"{f.name} is not numeric")
    if f.usage in ("COMP", "COMP-5", "COMP-X"):
        # storage holds any pattern of its bytes, which can be more digits than the picture's
        return _binary(f, record).cast(f"decimal({max(20, f.pic.digits + 1) + f.pic.scale},{f.pic.scale})" if f.pic.scale else "decimal(21,0)")
    digits, negative, ok = _sign_and_digits(f, encoding, record)
    held = {"COMP-3": 2 * f.size - 1, "COMP-6": 2 * f.size}.get(f.usage, f.pic.digits)
    told = 2 * f.size - 1 if f.usage == "COMP-3" else 2 * f.size if f.usage == "COMP-6" else f.size - f.separate
    return F.when(ok, _spread(digits, told, f.pic.scale, negative, f"decimal({min(38, held)},{f.pic.scale})"))


def value(f: Field, encoding: str = ASCII, record: str = "record") -> Column:
    """The field as text: canonical decimal, right-trimmed text, or a marker that says why there is none.

    Bytes that aren't valid give null, never a guess.
    """
    here = F.length(record) >= f.offset + f.size
    if f.category == "group":
        return F.lit("(group)")
    if f.category == "alphanumeric":
        out = right_trim(text_of(raw_bytes(f, record), encoding))
    elif f.category == "numeric":
        out = number(f, encoding, record).cast("string")
    elif f.category == "edited" and encoding == ASCII:
        out = F.when(valid(f, encoding, record), right_trim(F.decode(raw_bytes(f, record), "ISO-8859-1"))).otherwise(F.lit(EDITED_FAILED))
    else:
        out = F.lit(EDITED_EBCDIC if f.category == "edited" else UNSUPPORTED)
    return F.when(here, out).otherwise(F.lit(SHORT))


def typed(f: Field, encoding: str = ASCII, record: str = "record") -> Column:
    """Decimal for numeric and edited fields, else right-trimmed text; null where there is no value."""
    if f.category == "numeric" or (f.category == "edited" and encoding == ASCII):
        return number(f, encoding, record)
    if f.category == "alphanumeric":
        return right_trim(text_of(raw_bytes(f, record), encoding))
    return F.lit(None).cast("string")


def condition(c: Condition, layout: Layout, encoding: str = ASCII, record: str = "record") -> Column:
    """True, false, or null where the parent has no value. Text compares as if padded with spaces."""
    return holds(c, layout.field(c.parent), encoding, record)


def holds(c: Condition, f: Field, encoding: str = ASCII, record: str | Column = "record") -> Column:
    """The condition on a field at its place in ``record``."""
    if f.category == "numeric":
        v = number(f, encoding, record)
        lit = lambda x: F.lit(Decimal(x))
    elif f.category == "alphanumeric":
        v = F.rpad(text_of(raw_bytes(f, record), encoding), f.size, " ")
        lit = lambda x: F.lit(x.ljust(f.size)[: f.size])
    else:
        return F.lit(None).cast("boolean")
    out = F.lit(False)
    for low, high in c.values:
        out = out | (v == lit(low) if high is None else (v >= lit(low)) & (v <= lit(high)))
    return F.when(v.isNotNull(), out)


def row_each(df: DataFrame, keys: tuple[str, ...], items: list[Column], name: str) -> DataFrame:
    """keys and name, a row for each item of each row.

    The items are made in a projection of their own: an explode of expressions would compute them one node at a time. An outer
    explode of an array with items gives the same rows, without the filter on its size that Spark infers for a plain one.
    """
    explode = F.explode_outer if items else F.explode
    return df.select(*keys, F.array(*items).alias("__items")).select(*keys, explode("__items").alias(name))


#: Bytes of a method up to which the JVM compiles it.
COMPILED_BYTES = 8000


def split_long_methods(spark: SparkSession) -> SparkSession:
    """spark, set to split the generated code of wide layouts: Spark's own limit lets methods grow that the JVM then only interprets."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > COMPILED_BYTES:
        spark.conf.set(key, COMPILED_BYTES)
    return spark


def decode(df: DataFrame, layout: Layout, encoding: str = ASCII, record: str = "record", conditions: bool = True) -> DataFrame:
    """Adds a typed column for each elementary field and a boolean for each condition."""
    layout.check_keys()
    made = {f.name: typed(f, encoding, record) for f in layout.elementary()}
    if conditions:
        made |= {c.name: condition(c, layout, encoding, record) for c in layout.conditions}
    return df.select("*", *(c.alias(k) for k, c in made.items()))


def decode_long(df: DataFrame, layout: Layout, encoding: str = ASCII, record: str = "record", keys: tuple[str, ...] = ("record_index",), groups: bool = False) -> DataFrame:
    """A row for each record and field: keys, name, level, offset, size, category, value, raw_hex, valid, edited_numeric."""
    fields = layout.fields if groups else layout.elementary()
    items = [
        F.struct(
            F.lit(f.name).alias("name"), F.lit(f.level).alias("level"), F.lit(f.offset).alias("offset"), F.lit(f.size).alias("size"), F.lit(f.category).alias("category"),
            value(f, encoding, record).alias("value"), raw_hex(f, record).alias("raw_hex"), valid(f, encoding, record).alias("valid"),
            (number(f, encoding, record).cast("string") if f.category == "edited" and encoding == ASCII else F.lit(None).cast("string")).alias("edited_numeric"),
        )
        for f in fields
    ]
    return row_each(df, keys, items, "__f").select(*keys, "__f.*")
