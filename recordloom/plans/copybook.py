"""Copybooks: COPY expansion, items, conditions and byte layout. Runs once, on the driver, before any plan is built."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from hashlib import sha256

from recordloom.functions.pic import USAGES, Picture, parse, storage_bytes

Resolver = Callable[[str], str | None]


class CopybookError(ValueError):
    """A copybook that can't be read without guessing."""


def no_copy(name: str) -> str | None:
    return None


#: The suffixes under which a member may be stored, in the order in which they are tried.
SUFFIXES = ("", ".cpy", ".CPY", ".cbl", ".cob")


def from_directory(folder: str) -> Resolver:
    """Finds members by name as given or in lower case, bare or with a usual suffix."""

    def find(name: str) -> str | None:
        for stem in (name, name.lower()):
            for suffix in SUFFIXES:
                if os.path.isfile(at := os.path.join(folder, stem + suffix)):
                    with open(at, encoding="utf-8") as f:
                        return f.read()
        return None

    return find


def expand(text: str, resolver: Resolver | dict[str, str] = no_copy, source: str = "(main)", seen: tuple[str, ...] = ()) -> list[tuple[str, str, int]]:
    """(line, source, line number): COPY lines are replaced by their member's lines, with REPLACING applied."""
    find = resolver.get if isinstance(resolver, dict) else resolver
    out = []
    for number, line in enumerate(text.splitlines(), 1):
        m = re.match(r"\s*COPY\s+([\w-]+)(?:\s+REPLACING\s+(.*?))?\s*\.\s*$", line, re.I)
        if not m:
            out.append((line, source, number))
            continue
        name = m[1]
        if name in seen:
            raise CopybookError(f"COPY {name} includes itself")
        if (member := find(name)) is None:
            raise CopybookError(f"COPY {name} is not found")
        inside = expand(member, resolver, name, (*seen, name))
        for old, new in re.findall(r"==(.*?)==\s+BY\s+==(.*?)==", m[2] or "", re.I):
            inside = [(x.replace(old.strip(), new.strip()), s, n) for x, s, n in inside]
        out += inside
    return out


def expanded_text(lines: list[tuple[str, str, int]]) -> str:
    return "\n".join(x for x, _, _ in lines)


@dataclass(frozen=True)
class Condition:
    """A level-88 name: its parent's value is one of the literals, or within one of the ranges."""

    name: str
    parent: str
    values: tuple[tuple[str, str | None], ...]
    quoted: bool


@dataclass(frozen=True)
class Field:
    """One laid-out item. category is numeric, alphanumeric, edited, group or unsupported."""

    name: str
    level: int
    offset: int
    size: int
    category: str
    pic: Picture | None = None
    usage: str = "DISPLAY"
    separate: bool = False
    leading: bool = False
    group: str = ""
    redefines: str | None = None
    occurs: int = 1
    depending: str | None = None
    source: str = ""
    line: int = 0
    least: int = 1


@dataclass(frozen=True)
class Item:
    """An item of the schema tree: its field, at an offset from its parent's first byte; the bytes of one occurrence; its children."""

    field: Field
    stride: int
    children: tuple[Item, ...] = ()
    conditions: tuple[Condition, ...] = ()


@dataclass
class _Node:
    item: Field
    children: list[_Node] = field(default_factory=list)
    conditions: list[tuple[str, tuple, bool]] = field(default_factory=list)


@dataclass(frozen=True)
class Layout:
    """Fields in output order (a group after its children), conditions, record length and the texts they come from."""

    fields: tuple[Field, ...]
    conditions: tuple[Condition, ...]
    record_len: int
    text: str
    expanded: str
    used_copy: bool
    roots: tuple[Item, ...] = ()

    def elementary(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.category != "group")

    def field(self, name: str) -> Field:
        """By bare name, or qualified as GROUP.NAME."""
        hits = [f for f in self.fields if name in (f.name, f"{f.group}.{f.name}")]
        if not hits:
            raise KeyError(f"no field {name}")
        return hits[0]

    def has(self, name: str) -> bool:
        return any(name in (f.name, f"{f.group}.{f.name}") for f in self.fields)

    def conditions_of(self, name: str) -> tuple[Condition, ...]:
        return tuple(c for c in self.conditions if c.parent == name)

    @property
    def layout_hash(self) -> str:
        return sha256("".join(f"{f.name}:{f.offset}:{f.size};" for f in self.fields).encode()).hexdigest()

    def check_keys(self) -> None:
        """Refuses names that two elementary fields share: keyed output would lose one of them."""
        names = [f.name for f in self.elementary()]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise CopybookError(f"field names are not unique: {', '.join(twice)}")


def _statements(lines: list[tuple[str, str, int]]):
    """Token lists with the place where each begins. A statement ends with a period that ends a token."""
    tokens: list[str] = []
    at = ("", 0)
    for line, source, number in lines:
        if re.match(r"\s*\*", line) or (len(line) > 6 and line[6:7] == "*" and not line[:6].strip(" 0123456789")):
            continue
        for t in re.findall(r'"[^"]*"|\'[^\']*\'|[^\s"\']+', line):
            if not tokens:
                at = (source, number)
            last = t.endswith(".") and t[0] not in "\"'"
            if t := t.rstrip(".") if last else t:
                tokens.append(t)
            if last and tokens:
                yield tokens, *at
                tokens = []
    if tokens:
        yield tokens, *at


def _literals(tokens: list[str]) -> tuple[tuple[tuple[str, str | None], ...], bool]:
    out: list[tuple[str, str | None]] = []
    quoted = False
    plain = [t for t in tokens if t.upper() not in ("IS", "ARE")]
    i = 0
    while i < len(plain):
        t = plain[i].rstrip(",")
        quoted |= t[:1] in "\"'"
        value = t[1:-1] if t[:1] in "\"'" else t
        if i + 2 < len(plain) and plain[i + 1].upper() in ("THRU", "THROUGH"):
            high = plain[i + 2].rstrip(",")
            out.append((value, high[1:-1] if high[:1] in "\"'" else high))
            i += 3
        else:
            out.append((value, None))
            i += 1
    return tuple(out), quoted


def _item(tokens: list[str], source: str, line: int) -> Field:
    level, rest = int(tokens[0]), tokens[1:]
    name = "FILLER"
    clauses = {"PIC", "PICTURE", "REDEFINES", "OCCURS", "USAGE", "SIGN", "VALUE", "VALUES", *USAGES}
    if rest and rest[0].upper() not in clauses:
        name, rest = rest[0].upper(), rest[1:]
    pic = usage = redefines = depending = None
    unknown = separate = leading = False
    least, occurs, i = 1, 1, 0
    upper = [t.upper() for t in rest]
    while i < len(rest):
        t = upper[i]
        skip = 1 if i + 1 < len(rest) and upper[i + 1] == "IS" else 0
        if t in ("PIC", "PICTURE"):
            pic, i = rest[i + 1 + skip], i + 2 + skip
        elif t == "USAGE":
            i += 1 + skip
        elif t in USAGES:
            usage, i = USAGES[t], i + 1
        elif re.match(r"COMP|POINTER|INDEX$", t):
            unknown, i = True, i + 1
        elif t == "REDEFINES":
            redefines, i = upper[i + 1], i + 2
        elif t == "OCCURS":
            least = occurs = int(rest[i + 1])
            i += 2
            if i + 1 < len(rest) and upper[i] == "TO":
                occurs, i = int(rest[i + 1]), i + 2
        elif t == "DEPENDING":
            depending, i = upper[i + 2 if upper[i + 1] == "ON" else i + 1], i + (3 if upper[i + 1] == "ON" else 2)
        elif t == "LEADING":
            leading, i = True, i + 1
        elif t == "SEPARATE":
            separate, i = True, i + 1
        elif t in ("VALUE", "VALUES"):
            break
        else:
            i += 1
    if pic is None:
        return Field(name, level, 0, 0, "unsupported" if unknown else "group", redefines=redefines, occurs=occurs, depending=depending, source=source, line=line, least=least)
    p = parse(pic)
    category = "unsupported" if unknown or (p.category == "numeric" and usage == "COMP-6" and p.signed) else p.category
    if category == "numeric" and usage in ("COMP", "COMP-5", "COMP-X") and storage_bytes(p, usage) > 8:
        category = "unsupported"
    size = storage_bytes(p, usage, separate)
    return Field(name, level, 0, size, category, p, usage or "DISPLAY", separate, leading, redefines=redefines, occurs=occurs, depending=depending, source=source, line=line, least=least)


def _names(item: Item) -> set[str]:
    return {item.field.name} | {n for c in item.children for n in _names(c)}


def compile_layout(text: str, resolver: Resolver | dict[str, str] = no_copy) -> Layout:
    """Reads a copybook into a layout. Conditions belong to the elementary item before them."""
    lines = expand(text, resolver)
    roots: list[_Node] = []
    stack: list[_Node] = []
    last: _Node | None = None
    for tokens, source, number in _statements(lines):
        if not tokens[0].isdigit():
            continue
        if int(tokens[0]) == 88:
            if last is None:
                raise CopybookError(f"condition {tokens[1]} has no item before it")
            at = next((i for i, t in enumerate(tokens) if t.upper() in ("VALUE", "VALUES")), None)
            if at is None or at + 1 >= len(tokens):
                raise CopybookError(f"condition {tokens[1]} has no value")
            last.conditions.append((tokens[1].upper(), *_literals(tokens[at + 1 :])))
            continue
        node = _Node(_item(tokens, source, number))
        while stack and stack[-1].item.level >= node.item.level:
            stack.pop()
        (stack[-1].children if stack else roots).append(node)
        if node.item.category == "group":
            stack.append(node)
        else:
            last = node
    fields: list[Field] = []
    conditions: list[Condition] = []

    def place(node: _Node, offset: int, group: str, index: tuple[int, ...]) -> int:
        name = node.item.name + (f"({','.join(map(str, index))})" if index else "")
        if node.item.category != "group":
            fields.append(replace(node.item, name=name, offset=offset, group=group))
            conditions.extend(Condition(c + name[len(node.item.name) :], name, v, q) for c, v, q in node.conditions)
            return node.item.size
        size = lay(node.children, offset, node.item.name, index) - offset
        fields.append(replace(node.item, name=name, offset=offset, size=size, group=group))
        return size

    def lay(nodes: list[_Node], offset: int, group: str, index: tuple[int, ...]) -> int:
        start: dict[str, int] = {}
        end = offset
        for node in nodes:
            if node.item.redefines is not None and node.item.redefines not in start:
                raise CopybookError(f"{node.item.name} redefines {node.item.redefines}, which is not beside it")
            at = start[node.item.redefines] if node.item.redefines else end
            start[node.item.name] = at
            here = at
            for i in range(node.item.occurs):
                here += place(node, here, group, (*index, i + 1) if node.item.occurs > 1 or node.item.depending else index)
            end = max(end, here)
        return end

    def shape(nodes: list[_Node], seen: frozenset[str]) -> tuple[tuple[Item, ...], int]:
        """The schema tree of some siblings, and their bytes. seen: names that stand before, which an ODO may depend on."""
        out: list[Item] = []
        start: dict[str, int] = {}
        end = 0
        for node in nodes:
            item = node.item
            if item.depending is not None and (item.depending not in seen or not 0 <= item.least <= item.occurs):
                raise CopybookError(f"{item.name} depends on {item.depending}, which is not before it, or its bounds are no range")
            children, inside = shape(node.children, seen)
            stride = inside if item.category == "group" else item.size
            at = start[item.redefines] if item.redefines else end
            start[item.name] = at
            out.append(Item(replace(item, offset=at, size=stride), stride, children, tuple(Condition(c, item.name, v, q) for c, v, q in node.conditions)))
            end = max(end, at + stride * item.occurs)
            seen = seen | {item.name} | {n for c in children for n in _names(c)}
        return tuple(out), end

    length = 0
    for root in roots:
        length = max(length, lay([root], 0, "", ()))
    if not fields:
        raise CopybookError("the copybook has no item")
    return Layout(tuple(fields), tuple(conditions), length, text, expanded_text(lines), any(s != "(main)" for _, s, _ in lines), tuple(shape([root], frozenset())[0][0] for root in roots))
