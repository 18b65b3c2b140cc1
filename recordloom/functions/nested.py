"""Records as nested columns: a group is a struct, OCCURS an array, and OCCURS DEPENDING ON an array of the declared length.

An element's bytes are one slice of its parent's, so an item at any depth is decoded by the same expressions as a flat one, at its
offset in the slice. All of it is Catalyst expressions on the record: arrays that a query doesn't use are never made.

An ODO's storage has its largest number of elements. Its count may stand anywhere before it, also within the same occurrence of an
outer array. A count that is no valid number or outside the declared bounds gives a null array and a finding, never a guess.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.decode import ASCII, holds, number, typed
from recordloom.operators.findings import FINDING, finding
from recordloom.plans.copybook import CopybookError, Field, Item, Layout

#: Count fields by name: the declared count, null where its bytes are no valid number.
Counts = dict[str, Column]


def _count(f: Field, base: Column, encoding: str) -> Column:
    return number(f, encoding, base).cast("long")


def _visible(item: Item) -> list[Item]:
    """The item itself; for a FILLER group its children, which can be named without it; nothing for other FILLER."""
    if item.field.name != "FILLER" or item.field.occurs > 1 or item.field.depending:
        return [item] if item.field.name != "FILLER" or item.children else []
    return [x for c in item.children for x in _visible(replace(c, field=replace(c.field, offset=item.field.offset + c.field.offset)))]


def _children(items: tuple[Item, ...], base: Column, at: int, counts: Counts, encoding: str) -> tuple[list[Item], Counts]:
    """The children that have a name of their own, and the count fields that they and what is before them offer."""
    named = [x for c in items for x in _visible(c)]
    names = [n for c in named for n in (c.field.name, *(x.name for x in c.conditions))]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise CopybookError(f"names are not unique in a group: {', '.join(twice)}")
    counts = dict(counts)

    def offer(item: Item, at: int) -> None:
        f = replace(item.field, offset=at)
        if f.occurs > 1 or f.depending:
            return
        if f.category == "numeric" and f.pic.scale == 0:
            counts[f.name] = _count(f, base, encoding)
        for c in item.children:
            offer(c, at + c.field.offset)

    for c in named:
        offer(c, at + c.field.offset)
    return named, counts


def _counted(f: Field, counts: Counts) -> Column | None:
    """The declared count of an array; None where its length is fixed."""
    if not f.depending:
        return None
    if f.depending not in counts:
        raise CopybookError(f"{f.name} depends on {f.depending}, which is no whole number outside of other arrays")
    return counts[f.depending]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once and not wherever it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _each(item: Item, base: Column, at: int, counts: Counts, make: Callable[[Column, Column], Column]) -> Column:
    """make(bytes, number) of each element; null where the declared count is none. An element's bytes are cut once."""
    f, declared = item.field, _counted(item.field, counts)
    cut = lambda k: F.transform(F.sequence(F.lit(1), k), lambda i: F.substring(base, (i - 1) * item.stride + (at + 1), F.lit(item.stride)))
    if declared is None:
        slices = cut(F.lit(f.occurs))
    else:
        some = lambda n: F.when((n >= max(1, f.least)) & (n <= f.occurs), cut(n.cast("int")))
        slices = _let(declared, some if f.least else lambda n: some(n).when(n == 0, F.array().cast("array<binary>")))
    return F.transform(slices, lambda b, i: make(b, i))


def _value(item: Item, base: Column, at: int, counts: Counts, encoding: str) -> Column:
    if item.field.category != "group":
        return typed(replace(item.field, offset=at), encoding, base)
    return F.struct(*_columns(item.children, base, at, counts, encoding))


def _columns(items: tuple[Item, ...], base: Column, at: int, counts: Counts, encoding: str) -> list[Column]:
    named, counts = _children(items, base, at, counts, encoding)
    out = []
    for c in named:
        f, here = c.field, at + c.field.offset
        if f.occurs == 1 and not f.depending:
            out.append(_value(c, base, here, counts, encoding).alias(f.name))
            out += [holds(x, replace(f, offset=here), encoding, base).alias(x.name) for x in c.conditions]
            continue
        out.append(_each(c, base, here, counts, lambda b, i, c=c: _value(c, b, 0, counts, encoding)).alias(f.name))
        # an elementary item's conditions hold element by element
        out += [_each(c, base, here, counts, lambda b, i, c=c, x=x: holds(x, replace(c.field, offset=0), encoding, b)).alias(x.name) for x in c.conditions]
    return out


def _top(layout: Layout) -> tuple[Item, ...]:
    """The columns' items: the children of a single group, else the level-01 items themselves."""
    roots = layout.roots
    return roots[0].children if len(roots) == 1 and roots[0].children and roots[0].field.occurs == 1 else roots


def decode_nested(df: DataFrame, layout: Layout, encoding: str = ASCII, record: str = "record") -> DataFrame:
    """df with a column for each item below level 01: a value, a struct for a group, an array for OCCURS; conditions as booleans.

    Names must be unique within their group only. FILLER has no column; a FILLER group's items stand beside it. Elements beyond the end of a short record are null. A
    layout of several level-01 items has a column for each.
    """
    return df.select("*", *_columns(_top(layout), F.col(record), 0, {}, encoding))


def nested_schema(df: DataFrame, layout: Layout, encoding: str = ASCII, record: str = "record"):
    """The schema that ``decode_nested`` adds."""
    return decode_nested(df.select(record), layout, encoding, record).drop(record).schema


def _found(items: tuple[Item, ...], base: Column, at: int, counts: Counts, encoding: str, path: Column) -> list[Column]:
    """Arrays of findings on counts, of some siblings and all below them."""
    named, counts = _children(items, base, at, counts, encoding)
    out = []
    for c in named:
        f, here, name = c.field, at + c.field.offset, F.concat(path, F.lit(c.field.name))
        below = lambda b, start, path, c=c: F.flatten(F.array(*parts)) if (parts := _found(c.children, b, start, counts, encoding, path)) else None
        if f.depending:
            n = counts.get(f.depending)
            _counted(f, counts)
            said = F.concat(name, F.lit(f": {f.depending} is "), F.coalesce(n.cast("string"), F.lit("no valid number")), F.lit(f", not {f.least} to {f.occurs}"))
            rule = F.when(n.isNull(), "ODO-COUNT-DIRTY").otherwise("ODO-COUNT-OUT-OF-RANGE")
            out.append(F.when(n.isNull() | (n < f.least) | (n > f.occurs), F.array(F.struct(rule.alias("rule_id"), said.alias("message")))).otherwise(_none()))
        if f.occurs > 1 or f.depending:
            if below(base, here, path) is not None:
                each = _each(c, base, here, counts, lambda b, i, name=name, below=below: below(b, 0, F.concat(name, F.lit("("), (i + 1).cast("string"), F.lit(")."))))
                out.append(F.coalesce(F.flatten(each), _none()))
        elif (inside := below(base, here, F.concat(name, F.lit(".")))) is not None:
            out.append(inside)
    return out


def _none() -> Column:
    return F.array().cast("array<struct<rule_id:string,message:string>>")


def count_findings(df: DataFrame, layout: Layout, encoding: str = ASCII, record: str = "record", index: str = "record_index") -> DataFrame:
    """A finding for each ODO count that is no valid number (ODO-COUNT-DIRTY) or out of its bounds, at any depth; index tells the record."""
    parts = _found(_top(layout), F.col(record), 0, {}, encoding, F.lit(""))
    if not parts:
        return df.sparkSession.createDataFrame([], FINDING)
    rows = df.select(F.col(index).alias("__at"), F.explode(F.flatten(F.array(*parts))).alias("__f"))
    return rows.select(finding(F.col("__f.rule_id"), F.col("__f.message"), "__at").alias("f")).select("f.*")
