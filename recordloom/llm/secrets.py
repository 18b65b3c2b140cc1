"""Secrets in texts: three fixed patterns, and runs of one character class whose sliding-window entropy is high.

Everything is Spark's own functions, evaluated inside the scan: no shuffle, no Python. A match's place comes from the lengths
of the matches and of the text between them. Window entropy is kept as the whole number sum(f(count)), f(c) = c*log2(c)
scaled, over counts of which each step changes two: the character that enters and the one that leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, text_or_empty

# The patterns of the base kinds, in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: AKIA and 14 more; runs are maximal, so asking for the length within the pattern drops the same matches as dropping later.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Character classes: kind, alphabet, the same as a pattern's class, bits a character from which a window is hot.
CLASSES = (
    ("entropy_hex", "0123456789abcdefABCDEF", "0-9a-fA-F", 2.9),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "A-Za-z0-9+/_-", 3.55),
)
WINDOW = 20
SCALE = 10**9
#: Candidates that hold one of these are known not to be secrets.
ALLOW = (r"(?i)example|sample|dummy|placeholder|changeme", r"(.)\1{5,}", r"0123456789|12345678", r"^d41d8cd98f00b204e9800998ecf8427e$", r"^e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855$")
_CHUNK = 500
_SPAN = "array<struct<start:bigint,ord:int,kind:string,end:bigint,text:string>>"


def scaled_terms(window: int = WINDOW) -> list[int]:
    """f(c) = c*log2(c) for counts up to the window, as whole numbers."""
    return [round(c * math.log2(c) * SCALE) if c else 0 for c in range(window + 1)]


def most_allowed(bits: float, window: int = WINDOW) -> int:
    """A window's entropy is at least ``bits`` when its sum of f is at most this."""
    return math.floor(window * (math.log2(window) - bits) * SCALE)


def _sizes(matches: str, gaps: str) -> Column:
    """Chunks of (length of the text before, length of the match, match)."""
    sizes = F.zip_with(F.slice(gaps, 1, F.size(matches)), F.col(matches), lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("m"), m.alias("t")))
    return F.when(F.size(matches) > 0, sizes).otherwise(F.array().cast("array<struct<g:bigint,m:bigint,t:string>>"))


def _placed(sizes: str, ordinal: int, kind: str) -> Column:
    """start, end and text of each match: running sums, over chunks and within them, so that many matches stay cheap."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / F.lit(_CHUNK)).cast("int")), lambda c: F.slice(sizes, c * _CHUNK + 1, F.lit(_CHUNK)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at:bigint,x:array<struct<g:bigint,m:bigint,t:string>>>>").alias("out"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["g"] + x["m"])
    based = F.aggregate(chunks, start, lambda a, xs: F.struct((a["at"] + total(xs)).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), xs.alias("x")))).alias("out")), lambda a: a["out"])

    def within(chunk: Column) -> Column:
        first = F.struct(chunk["at"].alias("at"), F.array().cast(_SPAN).alias("out"))
        span = lambda a, x: F.struct((a["at"] + x["g"]).alias("start"), F.lit(ordinal).alias("ord"), F.lit(kind).alias("kind"), (a["at"] + x["g"] + x["m"]).alias("end"), x["t"].alias("text"))
        return F.aggregate(chunk["x"], first, lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.concat(a["out"], F.array(span(a, x))).alias("out")), lambda a: a["out"])

    return F.when(F.size(sizes) > 0, F.flatten(F.transform(based, within))).otherwise(F.array().cast(_SPAN))


def _hot(text: Column, alphabet: str, bits: float) -> Column:
    """First start and last end, within the candidate, of windows whose entropy is at least ``bits``; else first is -1."""
    terms = F.array(*(F.lit(x).cast("long") for x in scaled_terms()))
    most = F.lit(most_allowed(bits)).cast("long")
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    zero = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("ring")
    )
    f = lambda n: F.get(terms, n)

    def step(a: Column, came: Column) -> Column:
        full = a["i"] >= WINDOW
        left = F.when(full, F.get(a["ring"], F.lit(0))).otherwise(F.lit(-1))
        n_in, n_out = F.get(a["counts"], came), F.get(a["counts"], left)
        change = f(n_in + 1) - f(n_in) + F.when(full, f(n_out - 1) - f(n_out)).otherwise(F.lit(0).cast("long"))
        total = a["sum"] + F.when(came == left, F.lit(0).cast("long")).otherwise(change)
        counts = F.when(came == left, a["counts"]).otherwise(F.transform(a["counts"], lambda c, k: c + (k == came).cast("int") - (k == left).cast("int")))
        hot = (a["i"] + 1 >= WINDOW) & (total <= most)
        return F.struct(
            counts.alias("counts"), total.alias("sum"),
            F.when(hot & (a["first"] < 0), a["i"] + 1 - WINDOW).otherwise(a["first"]).alias("first"), F.when(hot, a["i"] + 1).otherwise(a["last"]).alias("last"),
            (a["i"] + 1).alias("i"), F.concat(F.when(full, F.slice(a["ring"], 2, WINDOW - 1)).otherwise(a["ring"]), F.array(came)).alias("ring"),
        )

    return F.aggregate(codes, zero, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _hot_spans(kind: str, alphabet: str, bits: float, allow: tuple[str, ...]) -> Column:
    """The candidates of a kind cut to their hot windows; those that the allow-list names are dropped."""

    def fit(s: Column) -> Column:
        known = F.lit(False)
        for a in allow:
            known = known | s["text"].rlike(a)
        return s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]") & ~known

    def cut(s: Column) -> Column:
        return F.transform(
            F.array(_hot(s["text"], alphabet, bits)),
            lambda h: F.struct((s["start"] + h["first"]).alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), F.when(h["first"] >= 0, s["start"] + h["last"]).otherwise(F.lit(-1).cast("long")).alias("end"), s["text"].alias("text")),
        )

    return F.filter(F.flatten(F.transform(F.filter(kind, fit), cut)), lambda s: s["end"] >= 0)


def find_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, for every row of ``docs`` (doc_id, text; more columns are ignored).

    A null text is empty: no spans. A repeated row gives its result each time, null doc_ids pass through, an empty table
    gives no rows. A text of any length is searched whole.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    found = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)] + [(k, f"[{c}]{{{WINDOW},}}") for k, _, c, _ in CLASSES]
    rows = held(rows, **{f"m_{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in found})
    gaps = {f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(F.array().cast("array<string>")) for k, p in found}
    rows = held(held(rows, **gaps).drop("text"), **{f"s_{k}": _sizes(f"m_{k}", f"g_{k}") for k, _ in found})
    rows = held(rows.select("doc_id", *(f"s_{k}" for k, _ in found)), **{f"p_{k}": _placed(f"s_{k}", i, k) for i, (k, _) in enumerate(found)})
    made = {"assign": F.filter("p_assign", lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 12), "access": F.col("p_access"), "hex": F.col("p_hex")}
    made |= {kind: _hot_spans(f"p_{kind}", alphabet, bits, allow) for kind, alphabet, _, bits in CLASSES}
    rows = held(rows.drop(*(f"s_{k}" for k, _ in found)), **made)
    told = lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.concat("assign", "access", "hex")
    size = lambda c: F.size(c).cast("long")
    return rows.select(
        "doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
        F.sha2(told(base), 256).alias("base_sha256"), told(F.concat(base, *(k for k, *_ in CLASSES))).alias("spans"),
    )


def oracle() -> str:
    """The same in DuckDB, with every window's entropy counted anew."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    terms = f"[{', '.join(map(str, scaled_terms()))}]"

    def spans(kind: str, ordinal: int, pattern: str) -> str:
        return (
            f"SELECT doc_id, row, {ordinal} AS ord, {q(kind)} AS kind, m[i] AS text, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start "
            f"FROM (SELECT doc_id, row, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, row, regexp_extract_all(text, {q(pattern)}) AS m, string_split_regex(text, {q(pattern)}) AS g FROM d))"
        )

    allowed = " AND ".join(f"NOT regexp_matches(text, {q(a)})" for a in ALLOW if "\\1" not in a) + " AND NOT (" + " OR ".join(f"contains(text, repeat({q(c)}, 6))" for c in CLASSES[1][1]) + ")"
    parts = []
    for i, (kind, _, cls, bits) in enumerate(CLASSES):
        sums = f"list_filter(range(0, length(text) - {WINDOW} + 1), lambda p: list_sum(list_transform(list_distinct(string_split(text[p+1:p+{WINDOW}], '')), lambda c: {terms}[length(text[p+1:p+{WINDOW}]) - length(replace(text[p+1:p+{WINDOW}], c, '')) + 1])) <= {most_allowed(bits)})"
        parts.append(f"SELECT doc_id, row, ord, kind, start + list_min(h) AS start, start + list_max(h) + {WINDOW} AS stop FROM (SELECT *, {sums} AS h FROM ({spans(kind, 3 + i, f'[{cls}]{{{WINDOW},}}')}) WHERE regexp_matches(text, '[0-9]') AND regexp_matches(text, '[A-Za-z]') AND {allowed}) WHERE len(h) > 0")
    told = lambda c: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER ({c}), '')"
    count = lambda k: f"count(*) FILTER (kind = '{k}') AS n_{k}"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT doc_id, row, ord, kind, start, start + length(text) AS stop FROM ({spans("assign", 0, ASSIGN)}) WHERE length(regexp_extract(text, {q(ASSIGN)}, 2)) >= 12
  UNION ALL SELECT doc_id, row, ord, kind, start, start + length(text) FROM ({spans("access", 1, ACCESS)})
  UNION ALL SELECT doc_id, row, ord, kind, start, start + length(text) FROM ({spans("hex", 2, HEX)})
  UNION ALL {" UNION ALL ".join(parts)}
)
SELECT d.doc_id, {count("assign")}, {count("access")}, {count("hex")}, sha256({told("ord < 3")}) AS base_sha256, {told("true")} AS spans
FROM d LEFT JOIN s USING (row) GROUP BY d.row, d.doc_id"""
