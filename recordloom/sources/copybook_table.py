"""Tables whose columns come from a copybook, for plain SQL.

    CREATE TEMPORARY VIEW orders USING copybook OPTIONS (path '/in/orders', copybook_path '/in/ORDERS.cpy', fields 'O-KEY,O-TOTAL')

``copybook`` reads ranges of whole records and cuts the fields out of a matrix of bytes, a record a row: a field is a slice of its
columns, decoded for all records of a block at once. Spark tells a Python source no list of columns and, as ``fixedrec`` says, keeps
pushed filters too long, so options take their place: ``fields`` names a view's columns, ``first`` and ``last`` its records.

``copybook_view`` makes a view of the column expressions instead. There Catalyst prunes: a query cuts out the fields that it names,
its filters are evaluated on their bytes before anything else, and nothing more is decoded for records that don't pass.

Both give the types and values of ``decode``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import BooleanType, DecimalType, LongType, StringType, StructField, StructType

from recordloom.functions.decode import ASCII, CP500, CP500_FROM, CP500_TO, condition, edited_pattern, typed
from recordloom.plans.copybook import Condition, CopybookError, Field, Layout, compile_layout, from_directory
from recordloom.sources import fixedrec
from recordloom.sources.fixedrec import Policy, Range

#: White space at a text's end, as in ``right_trim``.
_TRAILING = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+\\Z")
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True
_CP500 = np.arange(256, dtype=np.uint32)
_CP500[[ord(c) for c in CP500_FROM]] = [ord(c) for c in CP500_TO]
#: The digit that a byte of a signed ASCII number stands for, 255 for none; those from p on are negative, { and } are zeros.
_POINT = np.full(256, 255, np.uint8)
_POINT[48:58] = _POINT[112:122] = np.arange(10)
_POINT[[123, 125]] = 0


def column_name(name: str) -> str:
    """A copybook's name as SQL takes it without quotes: U(1) becomes U_1, O-KEY becomes O_KEY."""
    return re.sub(r"[-(,]", "_", name).replace(")", "")


def _kind(f: Field, encoding: str):
    """The type that ``typed`` gives."""
    if f.category == "edited" and encoding == ASCII:
        return DecimalType(max(f.pic.digits, 1), f.pic.scale)
    if f.category != "numeric":
        return StringType()
    if f.usage in ("COMP", "COMP-5", "COMP-X"):
        return DecimalType(max(20, f.pic.digits + 1) + f.pic.scale, f.pic.scale) if f.pic.scale else DecimalType(21, 0)
    held = {"COMP-3": 2 * f.size - 1, "COMP-6": 2 * f.size}.get(f.usage, f.pic.digits)
    return DecimalType(min(38, held), f.pic.scale)


def _decimals(low: np.ndarray, high: np.ndarray, ok: np.ndarray, kind: DecimalType) -> pa.Array:
    """Unscaled 128-bit values as decimals."""
    words = np.stack([low.view(np.int64), high.view(np.int64)], axis=1)
    return pa.Array.from_buffers(pa.decimal128(kind.precision, kind.scale), len(ok), [pa.py_buffer(np.packbits(ok, bitorder="little").tobytes()), pa.py_buffer(np.ascontiguousarray(words).tobytes())])


def _digits(f: Field, raw: np.ndarray, encoding: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digits, whether negative, and whether every byte is what the storage allows, of each record."""
    n = len(raw)
    if f.usage in ("COMP-3", "COMP-6"):
        nibbles = np.stack([raw >> 4, raw & 15], axis=2).reshape(n, -1)
        if f.usage == "COMP-6":
            return nibbles, np.zeros(n, bool), (nibbles <= 9).all(axis=1)
        return nibbles[:, :-1], np.isin(nibbles[:, -1], (11, 13)), (nibbles[:, :-1] <= 9).all(axis=1) & (nibbles[:, -1] >= 10)
    first = 0 if f.leading else raw.shape[1] - 1
    rest = np.delete(raw, first, axis=1)
    zone = 0xF0 if encoding == CP500 else 0x30
    plain = ((rest & 0xF0) == zone).all(axis=1) & ((rest & 15) <= 9).all(axis=1)
    point = raw[:, first]
    if f.separate:
        plus, minus = (0x4E, 0x60) if encoding == CP500 else (0x2B, 0x2D)
        return rest & 15, point == minus, plain & np.isin(point, (plus, minus))
    if encoding == CP500:
        return raw & 15, f.pic.signed & np.isin(point >> 4, (11, 13)), plain & (point >> 4 >= 10) & ((point & 15) <= 9)
    negative = f.pic.signed & ((point >= 112) & (point < 122) | (point == 125))
    return np.insert(rest & 15, first, _POINT[point], axis=1), negative, plain & (_POINT[point] < 255)


def _number(f: Field, raw: np.ndarray, here: np.ndarray, encoding: str) -> pa.Array:
    kind = _kind(f, encoding)
    if f.usage in ("COMP", "COMP-5", "COMP-X"):
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, 8 - f.size :] = raw[:, ::-1] if f.usage == "COMP-5" else raw
        low = wide.view(">u8").ravel().astype(np.uint64)
        negative = (wide[:, 8 - f.size] >= 128) & f.pic.signed
        if f.size < 8:
            low = np.where(negative, low - np.uint64(1 << (8 * f.size)), low)
        return _decimals(low, np.where(negative, np.int64(-1), np.int64(0)), here, kind)
    digits, negative, ok = _digits(f, raw, encoding)
    ok = ok & here
    if (k := digits.shape[1]) <= 18:
        value = digits.astype(np.int64) @ (10 ** np.arange(k - 1, -1, -1, dtype=np.int64))
        value = np.where(negative, -value, value)
        return _decimals(value, value >> 63, ok, kind)
    text = (digits + 48).astype(np.uint8)
    return pa.array([Decimal(("-" if m else "") + bytes(t).decode()).scaleb(-f.pic.scale) if good else None for t, m, good in zip(text, negative.tolist(), ok.tolist(), strict=True)], pa.decimal128(kind.precision, kind.scale))


def _text(raw: np.ndarray, here: np.ndarray, encoding: str, trim: bool = True) -> pa.Array:
    chars = _CP500[raw] if encoding == CP500 else raw
    if chars.size and chars.max() > 127:
        one = (lambda row: "".join(map(chr, row))) if encoding == CP500 else (lambda row: bytes(row).decode("utf-8", "replace"))
        texts = [one(row) if good else None for row, good in zip(chars, here.tolist(), strict=True)]
        return pa.array([t if t is None or not trim else _TRAILING.sub("", t) for t in texts], pa.string())
    width = chars.shape[1]
    full = ~_BLANK[chars]
    length = np.where(full.any(axis=1), width - np.argmax(full[:, ::-1], axis=1), 0) if trim else np.full(len(chars), width)
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    data = chars[np.arange(width)[None, :] < length[:, None]].astype(np.uint8)
    return pa.Array.from_buffers(pa.string(), len(chars), [pa.py_buffer(np.packbits(here, bitorder="little").tobytes()), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def _edited(f: Field, raw: np.ndarray, here: np.ndarray) -> pa.Array:
    fits, kind, out = re.compile(edited_pattern(f.pic.text)[:-1] + "\\Z"), _kind(f, ASCII), []
    for row, good in zip(raw, here.tolist(), strict=True):
        text = bytes(row).decode("latin-1")
        digits = re.sub("[^0-9.]", "", text)
        sign = "-" if re.search("-|CR|DB", text) else ""
        value = Decimal(sign + digits) if good and fits.match(text) and re.search("[0-9]", digits) else None
        out.append(value if value is None or value.adjusted() < kind.precision - kind.scale else None)
    return pa.array(out, pa.decimal128(kind.precision, kind.scale))


def _field(f: Field, block: np.ndarray, lengths: np.ndarray, encoding: str) -> pa.Array:
    """The values of a field in all records of a block."""
    raw, here = block[:, f.offset : f.offset + f.size], lengths >= f.offset + f.size
    if f.category == "numeric":
        return _number(f, raw, here, encoding)
    if f.category == "alphanumeric":
        return _text(raw, here, encoding)
    return _edited(f, raw, here) if f.category == "edited" and encoding == ASCII else pa.nulls(len(block), pa.string())


def _truth(c: Condition, f: Field, block: np.ndarray, lengths: np.ndarray, encoding: str) -> pa.Array:
    if f.category == "numeric":
        v, lit = _field(f, block, lengths, encoding), lambda x: pa.scalar(Decimal(x))
    elif f.category == "alphanumeric":
        raw, here = block[:, f.offset : f.offset + f.size], lengths >= f.offset + f.size
        v, lit = _text(raw, here, encoding, trim=False), lambda x: pa.scalar(x.ljust(f.size)[: f.size])
        v = pc.utf8_rpad(v, f.size) if len(v) else v
    else:
        return pa.nulls(len(block), pa.bool_())
    out = pa.array(np.zeros(len(block), bool))
    for low, high in c.values:
        out = pc.or_(out, pc.equal(v, lit(low)) if high is None else pc.and_(pc.greater_equal(v, lit(low)), pc.less_equal(v, lit(high))))
    return out


class _Columns:
    """What a table shows of a layout: fields and conditions by their SQL name."""

    def __init__(self, options: dict):
        if ("copybook" in options) == ("copybook_path" in options):
            raise CopybookError("give copybook, its text, or copybook_path")
        text = options.get("copybook")
        if text is None:
            with fixedrec.open_file(options["copybook_path"]) as f:
                text = f.read().decode()
        self.layout: Layout = compile_layout(text, from_directory(options["copydir"])) if "copydir" in options else compile_layout(text)
        self.encoding = options.get("encoding", ASCII)
        if self.encoding not in (ASCII, CP500):
            raise CopybookError(f"encoding is {self.encoding}, not {ASCII} or {CP500}")
        every = {column_name(f.name): f for f in self.layout.elementary() if f.name != "FILLER"}
        every |= {column_name(c.name): c for c in self.layout.conditions}
        if len(every) < sum(f.name != "FILLER" for f in self.layout.elementary()) + len(self.layout.conditions) or "record_index" in every:
            raise CopybookError("columns would share a name")
        wanted = [column_name(x.strip().upper()) for x in options["fields"].split(",")] if "fields" in options else list(every)
        if unknown := [x for x in wanted if x not in every]:
            raise CopybookError(f"no field or condition {', '.join(unknown)}")
        self.items = {k: every[k] for k in wanted}
        self.policy = Policy(self.layout.record_len, options.get("newline", "reject"), options.get("partial", "reject"))

    def schema(self) -> StructType:
        return StructType([StructField("record_index", LongType()), *(StructField(k, BooleanType() if isinstance(x, Condition) else _kind(x, self.encoding)) for k, x in self.items.items())])

    def values(self, name: str, block: np.ndarray, lengths: np.ndarray) -> pa.Array:
        x = self.items[name]
        return _truth(x, self.layout.field(x.parent), block, lengths, self.encoding) if isinstance(x, Condition) else _field(x, block, lengths, self.encoding)


class _Reader(fixedrec._Reader):
    def __init__(self, options: dict):
        self.columns = _Columns(options)
        super().__init__({**options, "record_len": self.columns.policy.record_len})

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        n, names = self.policy.record_len, ["record_index", *self.columns.items]
        step = max(1, (1 << 20) // n)
        with fixedrec.open_file(part.path) as file:
            file.seek(part.first * n)
            for a in range(part.first, part.first + part.count, step):
                k = min(step, part.first + part.count - a)
                data = file.read(k * n if a + k < part.first + part.count or not part.tail else (k - 1) * n + part.tail)
                lengths = np.full(k, n)
                lengths[-1] = len(data) - (k - 1) * n
                block = np.frombuffer(data.ljust(k * n, b"\0"), np.uint8).reshape(k, n)
                index = np.arange(part.before + a, part.before + a + k)
                yield pa.RecordBatch.from_arrays([pa.array(index), *(self.columns.values(c, block, lengths) for c in self.columns.items)], names)


class CopybookSource(DataSource):
    """Options: path, copybook or copybook_path, copydir, encoding, newline, partial, split_bytes, fields (names, comma between them), first, last."""

    @classmethod
    def name(cls) -> str:
        return "copybook"

    def schema(self) -> StructType:
        return _Columns(self.options).schema()

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``USING copybook`` known to a session."""
    spark.dataSource.register(CopybookSource)


def copybook_frame(records: DataFrame, layout: Layout, encoding: str = ASCII) -> DataFrame:
    """The same columns as expressions over records (record_index, record)."""
    fields = [typed(f, encoding).alias(column_name(f.name)) for f in layout.elementary() if f.name != "FILLER"]
    return records.select("record_index", *fields, *(condition(c, layout, encoding).alias(column_name(c.name)) for c in layout.conditions))


def copybook_view(spark: SparkSession, name: str, path: str, layout: Layout, policy: Policy | None = None, encoding: str = ASCII) -> DataFrame:
    """A temporary view of a file or folder whose unused columns Catalyst leaves out."""
    made = copybook_frame(fixedrec.read_records(spark, path, policy or Policy(layout.record_len)), layout, encoding)
    made.createOrReplaceTempView(name)
    return made
