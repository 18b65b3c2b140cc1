"""Encoding as Column expressions: the inverse of decoding, for transforms and for making records from tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.decode import ASCII, CP500
from recordloom.plans.copybook import Field, Layout


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,10)")


#: Digits up to which a number fits a long, and the scale up to which Spark shows every decimal without an exponent.
LONG_DIGITS, PLAIN_SCALE = 18, 6


def _by_type(c: Column, f: Field, whole: Callable[[Column], Column], same: Callable[[Column], Column], other: Column) -> Column:
    """whole of a column of integers as a long, same of a decimal of the picture's own scale as decimal(18, scale), other of the rest.

    The types are known when the plan is made, so one of the three is left of it. Longs and decimals of up to 18 digits are compared and
    shown many times faster than those of 38.
    """
    kind = F.typeof(c)
    out = F
    if f.pic.scale == 0:
        out = out.when(kind.isin("tinyint", "smallint", "int", "bigint"), whole(c.try_cast("long")))
    if f.pic.scale <= PLAIN_SCALE:
        out = out.when(kind.rlike(f"^decimal[(]([0-9]|1[0-8]),{f.pic.scale}[)]$"), same(c.try_cast(f"decimal({LONG_DIGITS},{f.pic.scale})")))
    return other if out is F else out.otherwise(other)


def _digits(c: Column, f: Field) -> Column:
    """The value's digits at the field's scale, truncated toward zero, without sign; null where they don't fit.

    Whether they fit is told by the value, so that the digits are made once: what an expression names twice Spark computes twice.
    """
    n, scale = f.pic.digits, f.pic.scale
    size = F.abs(_exact(c))
    text = F.floor(size * F.lit(Decimal(10) ** scale) if scale else size).cast("decimal(38,0)").cast("string")
    any_type = F.when(size < F.lit(Decimal(10) ** (n - scale)), F.lpad(text, n, "0"))
    if n > LONG_DIGITS or n == scale:
        return any_type

    def whole(v: Column) -> Column:
        return F.when((v < F.lit(10**n)) & (v > F.lit(-(10**n))), F.lpad(F.abs(v).cast("string"), n, "0"))

    def same(v: Column) -> Column:
        shown = F.abs(v).cast("string")
        out = F.lpad(F.replace(shown, F.lit("."), F.lit("")) if scale else shown, n, "0")
        most = F.lit(Decimal(10) ** (n - scale)).cast(f"decimal({LONG_DIGITS},{scale})") if n < LONG_DIGITS else None
        return F.when(v.isNotNull() if most is None else (v < most) & (v > -most), out)

    return _by_type(c, f, whole, same, any_type)


def _negative(c: Column, f: Field) -> Column:
    """A value that truncates to zero has no sign."""
    if not f.pic.signed:
        return F.lit(False)
    below = lambda v: v < F.lit(0)
    return _by_type(c, f, below, lambda v: v < F.lit(Decimal(0)).cast(f"decimal({LONG_DIGITS},{f.pic.scale})"), _exact(c) <= F.lit(-Decimal(1).scaleb(-f.pic.scale)))


def encode_number(c: Column, f: Field, encoding: str = ASCII) -> Column:
    """Storage bytes of a decimal; null where the value is null or has too many digits."""
    digits, negative = _digits(c, f), _negative(c, f)
    n = f.size
    if f.usage == "COMP-3":
        sign = F.when(negative, F.lit("D")).otherwise(F.lit("C")) if f.pic.signed else F.lit("C")
        return F.unhex(F.lpad(F.concat(digits, sign), 2 * n, "0"))
    if f.usage == "COMP-6":
        return F.unhex(F.lpad(digits, 2 * n, "0"))
    if f.usage in ("COMP", "COMP-5", "COMP-X"):
        if f.pic.digits <= 18:
            whole = digits.cast("long")
            stored = F.hex(F.when(negative, -whole).otherwise(whole) if f.pic.signed else whole)  # two's complement
            raw = F.unhex(F.substring(F.lpad(stored, 16, "0"), 17 - 2 * n, 2 * n) if n <= 8 else F.lpad(stored, 2 * n, "0"))
        else:
            whole = digits.cast("decimal(38,0)")
            stored = F.when(negative, F.lit(Decimal(2 ** (8 * n))) - whole).otherwise(whole)
            raw = F.unhex(F.lpad(F.conv(stored.cast("decimal(20,0)").cast("string"), 10, 16), 2 * n, "0"))
        return F.concat(*(F.substring(raw, i, 1) for i in range(n, 0, -1))) if f.usage == "COMP-5" else raw
    if f.separate:
        sign = F.when(negative, F.lit("-")).otherwise(F.lit("+"))
        text = F.concat(sign, digits) if f.leading else F.concat(digits, sign)
        return encode_text(text, n, encoding)
    zone = 0xF0 if encoding == CP500 else 0x30
    plus, minus = (0xC0 if f.pic.signed else 0xF0, 0xD0) if encoding == CP500 else (0x30, 0x70)
    zoned = lambda c, z: c if z == 0x30 else F.translate(c, "0123456789", "".join(chr(z + i) for i in range(10)))
    raw = (lambda c: F.encode(c, "ISO-8859-1")) if encoding == CP500 else (lambda c: c.cast("binary"))  # the zoned characters of ASCII are its own
    if not f.pic.signed:
        return raw(zoned(digits, zone))
    body, last = (F.substring(digits, 2, n - 1), F.substring(digits, 1, 1)) if f.leading else (F.substring(digits, 1, n - 1), F.substring(digits, n, 1))
    over, rest = F.when(negative, zoned(last, minus)).otherwise(zoned(last, plus)), zoned(body, zone)
    return raw(F.concat(over, rest) if f.leading else F.concat(rest, over))


def _to_cp500() -> tuple[str, str]:
    chars = [chr(i) for i in range(1, 128)]
    return "".join(chars), "".join(chr(c.encode("cp500")[0]) for c in chars)


CP500_CHARS, CP500_BYTES = _to_cp500()


def encode_text(c: Column, size: int, encoding: str = ASCII) -> Column:
    """The text's bytes cut or padded with spaces to the size."""
    if encoding == CP500:
        return F.encode(F.translate(F.rpad(c, size, " "), CP500_CHARS, CP500_BYTES), "ISO-8859-1")
    return F.rpad(c.cast("binary"), size, F.lit(b" "))


#: Stands for no character of a presentation.
MARK = "|"


def encode_edited(c: Column, f: Field) -> Column:
    """Presentation under the picture: Z suppresses leading zeros and the commas among them.

    The digits are named once: points and commas are put in among them, and a mark where the picture has its first 9 or its point. Up
    to the mark zeros and commas give way to spaces from the left.
    """
    pic, negative = f.pic.text, _negative(c, f)
    body = pic[:-2] if pic[-2:] in ("CR", "DB") else pic
    lead = body[0] if body[0] in "+-" else ""
    body = body[len(lead) :]
    first = next((i for i, ch in enumerate(body) if ch in "9."), len(body))
    put: dict[int, str] = {}
    at = 1
    for i, ch in enumerate(body):
        put[at] = put.get(at, "") + (MARK if i == first > 0 else "") + (ch if ch in ".," else "")
        at += ch not in ".,"
    out = _digits(c, f)
    for at in sorted((k for k, v in put.items() if v), reverse=True):
        out = F.overlay(out, F.lit(put[at]), at, 0)
    if first:
        out = F.lpad(F.replace(F.ltrim(out, F.lit("0,")), F.lit(MARK), F.lit("")), len(body), " ")
    parts = [out]
    if lead:
        parts.insert(0, F.when(negative, F.lit("-")).otherwise(F.lit("+" if lead == "+" else " ")))
    if pic[-2:] in ("CR", "DB"):
        parts.append(F.when(negative, F.lit(pic[-2:])).otherwise(F.lit("  ")))
    return F.concat(*parts).cast("binary")


def encode_field(c: Column, f: Field, encoding: str = ASCII) -> Column:
    if f.category == "numeric":
        return encode_number(c, f, encoding)
    if f.category == "edited":
        return encode_edited(c, f)
    if f.category == "alphanumeric":
        return encode_text(c, f.size, encoding)
    raise ValueError(f"{f.name} can't be encoded")


def encode_record(layout: Layout, values: dict[str, Column], encoding: str = ASCII) -> Column:
    """The record's bytes from a column for each elementary field; fields of a redefinition are left to what they redefine."""
    parts, at = [], 0
    for f in sorted(layout.elementary(), key=lambda f: f.offset):
        if f.offset < at:
            continue
        parts.append(encode_field(values[f.name], f, encoding))
        at = f.offset + f.size
    return F.concat(*parts)
