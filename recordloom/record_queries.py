"""Queries on nested records, record types, arriving files, key ranges, tables in SQL, rule tables and saved records, with their SQL. Bytes are made by hand where it says so."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom import queries as q
from recordloom.functions.decode import decode_long, number, typed
from recordloom.functions.nested import count_findings, decode_nested
from recordloom.operators import custody, recon, route, rule_tables, views
from recordloom.plans.copybook import compile_layout
from recordloom.sources import copybook_table, fixedrec
from recordloom.streaming.arrivals import record_stream

TREE = compile_layout("""
    01 ORDER-TREE.
       05 T-KEY       PIC 9(10).
       05 T-LINES     PIC 9(2).
       05 T-LINE      OCCURS 1 TO 20 TIMES DEPENDING ON T-LINES.
          10 T-NO     PIC 9(2).
          10 T-PRICE  PIC S9(9)V99 COMP-3.
          10 T-MARKS  PIC 9.
          10 T-MARK   OCCURS 0 TO 3 TIMES DEPENDING ON T-MARKS.
             15 T-FLAG  PIC X.
                88 T-BACK  VALUE "R".
             15 T-CODE  PIC 9(5).
          10 T-PAIR   PIC 9(2) OCCURS 2.
       05 T-END       PIC X(3).
""")


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order and its lines in one record, bytes made by hand; storage that no element uses is 0xFF.

    Line n has n modulo 4 marks. Orders divisible by 31 declare no line, which is out of bounds; of the others those divisible by
    37 have letters for a count.
    """
    key, no = F.col("l_orderkey"), F.col("no")
    t = q._table(spark, sf_dir, "lineitem")
    t = t.withColumn("no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_returnflag")))
    text = lambda c: F.encode(c, "US-ASCII")
    price = F.unhex(F.concat(F.lpad((q._money("l_extendedprice") * 100).cast("long").cast("string"), 11, "0"), F.lit("C")))
    marks = F.concat(*(F.when(F.lit(j) <= no % 4, text(F.concat(F.col("l_returnflag"), F.lpad((key % 1000 * 10 + j).cast("string"), 5, "0")))).otherwise(F.lit(b"\xff" * 6)) for j in (1, 2, 3)))
    line = F.concat(text(F.lpad(no.cast("string"), 2, "0")), price, text((no % 4).cast("string")), marks, text(F.concat(F.lpad(no.cast("string"), 2, "0"), F.lpad((no + 50).cast("string"), 2, "0"))))
    lines = t.groupBy(key.alias("k")).agg(F.array_sort(F.collect_list(F.struct("no", line.alias("bytes")))).alias("lines"))
    body = F.rpad(F.aggregate("lines", F.lit(b""), lambda all, x: F.concat(all, x["bytes"])), 20 * 31, F.lit(b"\xff"))
    count = F.when(F.col("k") % 31 == 0, "00").when(F.col("k") % 37 == 0, "XX").otherwise(F.lpad(F.size("lines").cast("string"), 2, "0"))
    return q._once(lines.select(F.col("k").alias("record_index"), F.concat(text(F.lpad(F.col("k").cast("string"), 10, "0")), text(count), body, F.lit(b"END")).alias("record")))


def nested_occurs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each mark of each line, out of arrays of structs two levels deep whose lengths the records declare."""
    rows = decode_nested(_trees(spark, sf_dir), TREE)
    lines = rows.select(F.col("T-KEY").cast("long").alias("order_key"), F.col("T-END").alias("end"), F.explode_outer("T-LINE").alias("x")).where("x is not null")  # a plain explode would filter by the array's size and make it twice
    marks = lines.select("order_key", "end", F.col("x.T-NO").cast("int").alias("line_no"), F.col("x.T-PRICE").cast("decimal(18,2)").alias("price"), F.element_at("x.T-PAIR", 2).cast("int").alias("pair"), F.posexplode_outer("x.T-MARK").alias("mark", "m"))
    return marks.select("order_key", "end", "line_no", "price", "pair", "mark", F.col("m.T-FLAG").alias("flag"), F.col("m.T-BACK").alias("back"), F.col("m.T-CODE").cast("int").alias("code"))


def odo_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_findings(_trees(spark, sf_dir), TREE).select("record_index", "rule_id", "message")


def variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details, a trailer and unknown records, each with its own type's fields, out of one pass."""
    rows = route.decode_variants(q._headers(spark, sf_dir).union(q._with_trailer(spark, sf_dir)), q._variants())
    detail, trailer = (lambda n: F.col(f"fields.detail.{n}")), (lambda n: F.col(f"fields.trailer.{n}"))
    return rows.select("record_index", F.coalesce("variant", F.lit("(unknown)")).alias("variant"), F.coalesce(detail("L-KEY"), trailer("T-KEY")).cast("long").alias("key"), detail("L-NO").cast("int").alias("line_no"), F.coalesce(detail("L-PRICE"), trailer("T-DEBIT")).cast("decimal(18,2)").alias("amount"), trailer("T-COUNT").cast("long").alias("declared"))


def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that arrive in eight files, streamed in two runs: the second goes on where the first has stopped.

    Half of the files are there at first. Each batch is split into ranges of records, and all rows have the batch read's numbers.
    """
    folder, out, at = (fixedrec.new_folder(spark, x) for x in ("arrivals", "arrived", "arrivals-state"))
    records = q.orders(spark, sf_dir)
    half = records.agg(F.expr("percentile_approx(record_index, 0.5)").alias("m")).first()["m"] or 0
    for i, part in enumerate((records.where(F.col("record_index") <= half), records.where(F.col("record_index") > half))):
        fixedrec.write_records(part, folder, 4, prefix=f"run{i}")
        rows = record_stream(spark, folder, fixedrec.Policy(q.ORDER.record_len), growing="none", split_bytes=100 * q.ORDER.record_len)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(fixedrec.SCHEMA).parquet(out)
    return rows.select("record_index", typed(q.ORDER.field("O-KEY")).cast("long").alias("order_key"), typed(q.ORDER.field("O-TOTAL")).cast("decimal(18,2)").alias("total"), typed(q.ORDER.field("O-STATUS")).alias("status"))


def diff_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against a copy in which each 250th has another segment and each 400th is missing; ranges of 16 keys that are equal aren't joined."""
    c, f = q.customers(spark, sf_dir), q.CUSTOMER.field("C-SEGMENT")
    other = F.concat(F.substring("record", 1, f.offset), F.lit(b"ELSEWHERE   "), F.expr(f"substring(record, {f.offset + f.size + 1})"))
    b = q._once(c.where("record_index % 400 <> 0").withColumn("record", F.when(F.col("record_index") % 250 == 0, other).otherwise(F.col("record"))))
    return views.diff_ranges(decode_long(c, q.CUSTOMER), decode_long(b, q.CUSTOMER), width=16)


def sql_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL over a table that a copybook declares: four of its columns, over files that the copybook splits into records."""
    folder = q._in_file(q.orders(spark, sf_dir), "sql-orders", 4)
    copybook_table.register(spark)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY VIEW order_file USING copybook OPTIONS (path '{folder}', copybook '{q.ORDER.text}', fields 'O-STATUS,O-TOTAL,O-DATE,IS-SETTLED', split_bytes '{1000 * q.ORDER.record_len}')""")
    return spark.sql("""
        SELECT O_STATUS AS status, cast(O_DATE / 10000 AS int) AS year, count(*) AS orders, cast(sum(O_TOTAL) AS decimal(18,2)) AS total, count_if(IS_SETTLED) AS settled
        FROM order_file WHERE O_DATE BETWEEN 19940301 AND 19970615 AND O_STATUS IN ('F', 'P') AND O_TOTAL > 1000 GROUP BY ALL""")


def sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL over a view of column expressions, joined with a table; what the query doesn't name isn't decoded."""
    copybook_table.copybook_view(spark, "order_view", q._in_file(q.orders(spark, sf_dir), "view-orders", 4), q.ORDER)
    q._table(spark, sf_dir, "customer").createOrReplaceTempView("customer_view")
    return spark.sql("""
        SELECT c_mktsegment AS segment, O_PRIORITY AS priority, count(*) AS orders, cast(sum(O_TOTAL) AS decimal(18,2)) AS total
        FROM order_view JOIN customer_view ON O_CUST = c_custkey WHERE IS_OPEN GROUP BY ALL""")


def sentinel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by the thousand: every third order's key by value, and each day on which a customer divisible by 50 has ordered by its bytes."""
    o = q._table(spark, sf_dir, "orders")
    keys = o.where("o_orderkey % 3 = 0").select(F.lit("O-KEY").alias("field"), F.lit("third").alias("meaning"), F.col("o_orderkey").cast("string").alias("value"), F.lit(None).cast("string").alias("raw_hex"))
    days = o.where("o_custkey % 50 = 0").select(F.lit("O-DATE"), F.lit("day"), F.lit(None).cast("string"), F.hex(F.encode(F.date_format("o_orderdate", "yyyyMMdd"), "US-ASCII")))
    gone = spark.createDataFrame([("O-GONE", "none", "1", None)], "field string, meaning string, value string, raw_hex string")
    rules = keys.union(days).union(gone)
    found = rule_tables.sentinels_by_table(q.orders(spark, sf_dir), q.ORDER, rules).select("record_index", "field", "meaning", "value")
    told = rule_tables.fieldless(rules, q.ORDER).select(F.lit(None).cast("long"), "rule_id", "message", F.lit(None).cast("string"))
    return found.union(told)


def date_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates by a table of rules and sentinels: each day of the events' first month is declared to be none, as is 00000000."""
    key = F.col("o_orderkey")
    text = F.when(key % 17 == 0, F.lit("00000000")).when(key % 13 == 0, F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lit("32"))).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    rows = q._once(q._table(spark, sf_dir, "orders").select(key.alias("record_index"), F.encode(text, "US-ASCII").alias("record")))
    layout = compile_layout("01 D.\n 05 D-DATE PIC 9(8).\n")
    rules = spark.createDataFrame([("D-DATE", "YYYYMMDD", True), ("D-DATE", "YYDDD", None), ("D-NONE", "YYYYMMDD", None)], "field string, format string, require_sentinel boolean")
    days = q._table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.lit("D-DATE").alias("field"), F.date_format("o_orderdate", "yyyyMMdd").alias("text"))
    sentinels = days.union(spark.createDataFrame([("D-DATE", "00000000")], "field string, text string"))
    found = rule_tables.dates_by_table(rows, layout, rules, sentinels)
    return found.select("record_index", "format", "text", "status", F.array_join("rule_ids", ",").alias("rule_ids"))


#: Lines that a task sorts, of some 400 bytes each.
MOST_LINES = 250_000


def pass_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control totals, gathered in the one job that writes the lines, and whether the output's digest is that of the lines ordered anew.

    Each digest is one task's work, as its state passes from line to line; both run in one stage.
    """
    rows = q.lines(spark, sf_dir, MOST_LINES).withColumns({"raw_offset": F.col("record_index"), "raw_len": F.length("record")})
    made = recon.reconcile_pass(rows, q.LINE.text, fixedrec.new_folder(spark, "lines"), placed=True)
    totals = made.totals.where("kind in ('records', 'sum', 'condition')")
    both = recon.ordered_digest(made.lines, "record_index", "line").union(made.output).agg(F.count_distinct("hash", "records").alias("n"), F.max("records").alias("count"))
    return totals.union(both.select(F.lit("digest"), (F.col("n") == 1).cast("string"), F.lit(None).cast("string"), "count"))


def transformed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an amount added, saved as a folder of records that its job commits, and read again."""
    out, _ = recon.transform(q.orders(spark, sf_dir), q.ORDER, recon.Transform("add", "O-TOTAL", "12.34"))
    folder = fixedrec.new_folder(spark, "transformed")
    fixedrec.save_records(out.select("record_index", F.col("after").alias("record")), folder, 5)
    rows = fixedrec.read_records(spark, folder, fixedrec.Policy(q.ORDER.record_len))
    return rows.select("record_index", typed(q.ORDER.field("O-KEY")).cast("long").alias("order_key"), number(q.ORDER.field("O-TOTAL")).cast("decimal(18,2)").alias("total"))


def line_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record chain over all lines and the digest of all lines, a line feed after each, in order.

    Both are made twice, from other partitions and ranges of 20,000 lines: one that differs has a row of its own.
    """
    rows = q.lines(spark, sf_dir)
    ranges = -(-q._table(spark, sf_dir, "lineitem").count() // 20_000) or 1  # from the footers: a record makes no line more or less
    orders = [custody.ordered_records(rows, "record_index", "record"), custody.ordered_records(rows.repartition(11), "record_index", "record", ranges)]
    made = [df.select(F.lit(kind).alias("kind"), "records", "hash") for files in orders for kind, df in (("chain", custody.file_chain(spark, files)), ("digest", custody.file_digest(spark, files, "r")))]
    return reduce(DataFrame.union, made).distinct()


SIGNED = compile_layout("""
    01 SIGNED-REC.
       05 N-KEY   PIC 9(9).
       05 N-TAIL  PIC S9(7)V99.
       05 N-HEAD  PIC S9(7)V99 SIGN IS LEADING.
       05 N-LAST  PIC S9(7)V99 SIGN IS TRAILING SEPARATE.
       05 N-FIRST PIC S9(7)V99 SIGN IS LEADING SEPARATE.
""")


def decode_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display numbers with their sign over the last digit, over the first, after all and before all; bytes made by hand."""
    cents = (q._money("c_acctbal") * 100).cast("long")
    digits, negative = F.lpad(F.abs(cents).cast("string"), 9, "0"), cents < 0
    over = lambda c: F.when(negative, F.translate(c, "0123456789", "pqrstuvwxy")).otherwise(c)
    sign = F.when(negative, "-").otherwise("+")
    text = F.concat(F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.substring(digits, 1, 8), over(F.substring(digits, 9, 1)), over(F.substring(digits, 1, 1)), F.substring(digits, 2, 8), digits, sign, sign, digits)
    rows = q._once(q._table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_index"), F.encode(text, "US-ASCII").alias("record")))
    return rows.select("record_index", *(typed(SIGNED.field(n)).cast("decimal(18,2)").alias(n[2:].lower()) for n in ("N-TAIL", "N-HEAD", "N-LAST", "N-FIRST")))


def decode_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose last record is cut, decoded: the fields that are there have their values, the others say why they have none."""
    rows = fixedrec.read_records(spark, q._nation_file(spark, sf_dir, b"0099CUT"), fixedrec.Policy(q.NATION.record_len, partial="evidence"))
    return decode_long(rows, q.NATION, keys=("record_index", "partial")).select("record_index", "partial", "name", "value", "valid")


def strict_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strict decoding stops with: the first record that has a bad field, and its name."""
    try:
        recon.strict_decode(q._dirty(spark, sf_dir), q.LINE).write.format("noop").mode("overwrite").save()
        said = "nothing is invalid"
    except PySparkException as e:
        said = re.search(r"record \d+: invalid .*?(?= SQLSTATE|\n|$)", str(e))[0]
    return spark.createDataFrame([(said,)], "message string")


def line_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of records with a condition and an edited field, whose block of evidence stands in the audit."""
    rows = q.lines(spark, sf_dir).withColumns({"raw_offset": F.col("record_index") * q.LINE.record_len, "raw_len": F.length("record")})
    return recon.record_json(rows, q.LINE).select("record_index", "line")


def bank_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals, found = route.reconcile_banking(q._with_trailer(spark, sf_dir, "0.01"), q._variants(), q.CONTROL)
    return spark.createDataFrame([(views.reconcile_report(totals, found, {})["sarif"],)], "sarif string")


QUERIES = {f.__name__: f for f in (nested_occurs, odo_findings, variant_fields, stream_arrivals, diff_by_ranges, sql_using, sql_view, sentinel_table, date_table, pass_totals, transformed_file, line_chain, decode_signed, decode_tail, strict_failure, line_json, bank_sarif)}

_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_returnflag) AS no FROM lineitem"
ORACLE_SQL = {
    "nested_occurs": f"""WITH t AS ({_NUMBERED}), u AS (SELECT *, unnest(CASE WHEN no % 4 = 0 THEN [NULL] ELSE range(no % 4) END) AS mark FROM t WHERE l_orderkey % 31 <> 0 AND l_orderkey % 37 <> 0)
        SELECT l_orderkey AS order_key, 'END' AS "end", no::INT AS line_no, {q._PRICE} AS price, (no + 50)::INT AS pair, mark::INT AS mark, CASE WHEN mark IS NOT NULL THEN l_returnflag END AS flag, CASE WHEN mark IS NOT NULL THEN l_returnflag = 'R' END AS back,
            (l_orderkey % 1000 * 10 + mark + 1)::INT AS code FROM u""",
    "odo_findings": """SELECT DISTINCT l_orderkey AS record_index, CASE WHEN l_orderkey % 31 = 0 THEN 'ODO-COUNT-OUT-OF-RANGE' ELSE 'ODO-COUNT-DIRTY' END AS rule_id,
        'T-LINE: T-LINES is ' || CASE WHEN l_orderkey % 31 = 0 THEN '0' ELSE 'no valid number' END || ', not 1 to 20' AS message FROM lineitem WHERE l_orderkey % 31 = 0 OR l_orderkey % 37 = 0""",
    "variant_fields": f"""SELECT o_orderkey * 10 AS record_index, '(unknown)' AS variant, NULL::BIGINT AS key, NULL::INT AS line_no, NULL::DECIMAL(18,2) AS amount, NULL::BIGINT AS declared FROM orders
        UNION ALL SELECT {q._INDEX}, 'detail', l_orderkey, l_linenumber::INT, {q._PRICE}, NULL FROM lineitem
        UNION ALL SELECT 1152921504606846976, 'trailer', 0, NULL, CAST(sum({q._PRICE}) FILTER ({q._PAID}) AS DECIMAL(18,2)), count(*) FROM lineitem""",
    "stream_arrivals": q.ORACLE_SQL["ingest_records"],
    "sql_using": f"""SELECT o_orderstatus AS status, {q._DATE}[1:4]::INT AS year, count(*) AS orders, CAST(sum({q._TOTAL}) AS DECIMAL(18,2)) AS total, count(*) AS settled FROM orders
        WHERE {q._DATE} BETWEEN '19940301' AND '19970615' AND o_orderstatus IN ('F', 'P') AND {q._TOTAL} > 1000 GROUP BY ALL""",
    "sql_view": f"""SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS orders, CAST(sum({q._TOTAL}) AS DECIMAL(18,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY ALL""",
    "sentinel_table": f"""SELECT o_orderkey AS record_index, 'O-KEY' AS field, 'third' AS meaning, o_orderkey::VARCHAR AS value FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT o_orderkey, 'O-DATE', 'day', {q._DATE} FROM orders WHERE {q._DATE} IN (SELECT {q._DATE} FROM orders WHERE o_custkey % 50 = 0) UNION ALL SELECT NULL, 'SENTINEL-NO-FIELD', 'no field O-GONE', NULL""",
    "date_table": f"""WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN '00000000' WHEN o_orderkey % 13 = 0 THEN {q._DATE}[1:6] || '32' ELSE {q._DATE} END AS x FROM orders), s AS (SELECT DISTINCT {q._DATE} AS x FROM orders WHERE o_orderkey % 7 = 0 UNION SELECT '00000000'),
        j AS (SELECT k, t.x, s.x IS NOT NULL AS known FROM t LEFT JOIN s ON t.x = s.x)
        SELECT k AS record_index, 'YYYYMMDD' AS format, x AS text, CASE WHEN known THEN 'declared_sentinel' WHEN x[7:8] = '32' THEN 'invalid_calendar' ELSE 'valid' END AS status, CASE WHEN NOT known AND x[7:8] = '32' THEN 'DATE-INVALID-CALENDAR-DATE,DATE-SENTINEL-UNDECLARED' ELSE '' END AS rule_ids FROM j
        UNION ALL SELECT k, 'YYDDD', x, CASE WHEN known THEN 'declared_sentinel' ELSE 'invalid_format' END, CASE WHEN known THEN '' ELSE 'DATE-INVALID-FORMAT' END FROM j""",
    "pass_totals": q.ORACLE_SQL["control_totals"] + " UNION ALL SELECT 'digest', 'true', NULL, count(*) FROM lineitem",
    "transformed_file": f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS record_index, o_orderkey AS order_key, CAST({q._TOTAL} + 12.34 AS DECIMAL(18,2)) AS total FROM orders",
    "line_chain": f"""WITH t AS (SELECT {q._INDEX} AS i, 'D' || lpad(l_orderkey::VARCHAR, 10, '0') || lpad(l_linenumber::VARCHAR, 3, '0') AS head, (CAST(l_quantity AS DECIMAL(18,2)) * 100)::BIGINT AS qty, ({q._PRICE} * 100)::BIGINT AS price, lpad(format('{{:,.2f}}', l_extendedprice), 10, ' ') AS shown, l_returnflag AS f FROM lineitem),
        b AS (SELECT i, unhex(hex(encode(head)) || lpad(qty::VARCHAR, 7, '0') || 'C' || lpad(price::VARCHAR, 11, '0') || 'C' || hex(encode(shown || '  ' || f))) AS r FROM t)
        SELECT 'chain' AS kind, count(*) AS records, coalesce(decode(list_reduce(list(r ORDER BY i, r), lambda h, x: encode(sha256(h || x)), ''::BLOB)), '') AS hash FROM b
        UNION ALL SELECT 'digest', count(*), sha256(unhex(coalesce(string_agg(hex(r) || '0A', '' ORDER BY i, r), ''))) FROM b""",
    "decode_signed": f"SELECT c_custkey AS record_index, {q._BAL} AS tail, {q._BAL} AS head, {q._BAL} AS last, {q._BAL} AS first FROM customer",
    "decode_tail": """SELECT n_nationkey::BIGINT AS record_index, false AS partial, unnest(['N-KEY', 'N-NAME', 'N-REGION']) AS name, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS value, true AS valid FROM nation
        UNION ALL SELECT * FROM (VALUES (25, true, 'N-KEY', '99', true), (25, true, 'N-NAME', '(record too short for field)', false), (25, true, 'N-REGION', '(record too short for field)', false)) AS t""",
    "strict_failure": f"SELECT 'record ' || min({q._INDEX}) || ': invalid L-PRICE' AS message FROM lineitem WHERE l_orderkey % 97 = 0",
    "line_json": f"""WITH t AS (SELECT {q._INDEX} AS i, l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS DECIMAL(18,2)) AS qty, {q._PRICE} AS price, lpad(format('{{:,.2f}}', l_extendedprice), 10, ' ') AS shown, l_returnflag AS f FROM lineitem),
        b AS (SELECT *, lower(hex(encode('D' || lpad(k::VARCHAR, 10, '0') || lpad(n::VARCHAR, 3, '0'))) || lpad((qty * 100)::BIGINT::VARCHAR, 7, '0') || 'c' || lpad((price * 100)::BIGINT::VARCHAR, 11, '0') || 'c' || hex(encode(shown || '  ' || f))) AS x FROM t)
        SELECT i AS record_index, '{{"record_index":' || i || ',"fields":{{"L-TYPE":"D","L-KEY":"' || k || '","L-NO":"' || n || '","L-QTY":"' || qty || '","L-PRICE":"' || price || '","L-SHOWN":"' || shown || '","L-FLAG":"' || f || '"}},"conditions":{{"RETURNED":' || (f = 'R') || '}},"audit":{{"raw_offset":' || i * 37 || ',"raw_len":37,"record_sha256":"' || sha256(unhex(x))
            || '","edited":{{"L-SHOWN":{{"raw_text":"' || shown || '","numeric_value":"' || price || '","claim":"edited-picture","domain":"edited-display-decode"}}}}}}}}' AS line FROM b""",
    "bank_sarif": f"""SELECT '{{"runs": [{{"results": [{{"level": "warning", "message": {{"text": "debit_total: declared ' || (s + 0.01)::DECIMAL(38,2) || ' != observed ' || s || '"}}, "occurrenceCount": 1, "ruleId": "BANK-CONTROL-MISMATCH"}}], "tool": {{"driver": {{"name": "recordloom", "rules": [{{"id": "BANK-CONTROL-MISMATCH"}}]}}}}}}], "version": "2.1.0"}}' AS sarif
        FROM (SELECT CAST(sum({q._PRICE}) FILTER ({q._PAID}) AS DECIMAL(38,2)) AS s FROM lineitem)""",
    "diff_by_ranges": """SELECT c_custkey AS record_index, 'C-SEGMENT' AS name, 'DIFF-FIELD-MISMATCH' AS rule_id, c_mktsegment AS "left", 'ELSEWHERE' AS "right" FROM customer WHERE c_custkey % 250 = 0 AND c_custkey % 400 <> 0 AND c_mktsegment <> 'ELSEWHERE'
        UNION ALL SELECT c_custkey, name, 'DIFF-MISSING-FIELD', v, NULL FROM (
            SELECT c_custkey, unnest(['C-KEY', 'C-NAME', 'C-SEGMENT', 'C-BALANCE', 'C-OWED', 'C-OWED-IND']) AS name, unnest([c_custkey::VARCHAR, c_name, c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2))::VARCHAR, CAST(c_acctbal AS DECIMAL(18,2))::VARCHAR, """ + q._OWED_IND + """]) AS v FROM customer WHERE c_custkey % 400 = 0)""",
}
