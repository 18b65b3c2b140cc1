"""Pictures: what a PIC clause and a usage say about digits, scale, sign, category and bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Spark decimals end here; wider numeric pictures are unsupported rather than rounded.
MOST_DIGITS = 38
USAGES = {
    "DISPLAY": "DISPLAY", "COMP-3": "COMP-3", "PACKED-DECIMAL": "COMP-3", "COMPUTATIONAL-3": "COMP-3", "COMP": "COMP", "BINARY": "COMP", "COMPUTATIONAL": "COMP",
    "COMP-5": "COMP-5", "COMPUTATIONAL-5": "COMP-5", "COMP-X": "COMP-X", "COMPUTATIONAL-X": "COMP-X", "COMP-6": "COMP-6", "COMPUTATIONAL-6": "COMP-6",
}


@dataclass(frozen=True)
class Picture:
    """category is numeric, alphanumeric, edited or unsupported; width counts presentation characters."""

    text: str
    category: str
    digits: int
    scale: int
    signed: bool
    width: int


def expand(pic: str) -> str:
    """Repeats written out: S9(3)V99 is S999V99."""
    return re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), pic.upper())


def parse(pic: str) -> Picture:
    s = expand(pic)
    if re.fullmatch(r"S?9*V?9*", s) and "9" in s:
        digits, scale = s.count("9"), s.partition("V")[2].count("9")
        return Picture(s, "numeric" if digits <= MOST_DIGITS else "unsupported", digits, scale, s[0] == "S", digits)
    if re.fullmatch(r"[XA9]+", s) and re.search("[XA]", s):
        return Picture(s, "alphanumeric", 0, 0, False, len(s))
    if re.fullmatch(r"[+-]?[Z9,]+(\.[Z9]+)?(CR|DB)?", s) and re.search("[Z9]", s):
        body = re.sub("CR$|DB$", "", s)
        digits, scale = len(re.findall("[Z9]", body)), len(re.findall("[Z9]", body.partition(".")[2]))
        return Picture(s, "edited" if digits <= MOST_DIGITS else "unsupported", digits, scale, bool(re.search("[+-]|CR|DB", s)), len(s))
    return Picture(s, "unsupported", 0, 0, False, len(s.replace("V", "").replace("S", "")))


def storage_bytes(p: Picture, usage: str | None, separate: bool = False) -> int:
    """Bytes of storage; usages that are not known have no numeric meaning here and take the picture's width."""
    if p.category != "numeric" or usage in (None, "DISPLAY"):
        return p.width + (1 if separate and p.category == "numeric" else 0)
    if usage == "COMP-3":
        return p.digits // 2 + 1
    if usage == "COMP-6":
        return (p.digits + 1) // 2
    if usage in ("COMP", "COMP-5"):
        return next(n for most, n in ((2, 1), (4, 2), (9, 4), (38, 8)) if p.digits <= most)
    if usage == "COMP-X":
        top, n = 10**p.digits - 1, 1
        while top >= 2 ** (8 * n - p.signed):
            n += 1
        return n
    return p.width
