"""Headline timings: prints one JSON line. Records are encoded and written once, outside the timings; each query then reads them."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from recordloom import queries as q
from recordloom.functions.decode import decode
from recordloom.operators import custody, recon, route
from recordloom.sources import copybook_table, fixedrec


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{folder}/checkpoints").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    try:
        for name, df in (("lines", q._with_trailer(spark, sf_dir)), ("orders", q.orders(spark, sf_dir)), ("mixed", q._headers(spark, sf_dir).union(q.lines(spark, sf_dir)))):
            df.repartition(int(cpus)).write.parquet(f"{folder}/{name}")
        lines, orders, mixed = (spark.read.parquet(f"{folder}/{n}") for n in ("lines", "orders", "mixed"))
        copybook_table.register(spark)
        ordered = orders.select("record_index", "record")
        fixedrec.save_records(ordered, f"{folder}/files", int(cpus))
        details = lines.where(F.substring("record", 1, 1) == F.lit(b"D"))
        run = {
            "decode": lambda: decode(details, q.LINE),
            "control_totals": lambda: recon.control_totals(details, q.LINE),
            "banking_reconcile": lambda: route.reconcile_banking(lines, q._variants(), q.CONTROL)[0],
            "variant_counts": lambda: route.variant_counts(mixed, q._variants()),
            "dirty_fields": lambda: recon.dirty_fields(details, q.LINE),
            "record_json": lambda: recon.record_json(orders.withColumns({"raw_offset": F.col("record_index"), "raw_len": F.length("record")}), q.ORDER),
            "record_chain": lambda: custody.record_chain(details),
            "file_source": lambda: decode(fixedrec.read_records(spark, f"{folder}/files", fixedrec.Policy(q.ORDER.record_len), split_bytes=1 << 20), q.ORDER),
            "copybook_source": lambda: spark.read.format("copybook").options(path=f"{folder}/files", copybook=q.ORDER.text, split_bytes=1 << 20).load(),
            "sequence_gaps": lambda: custody.sequence_gaps(orders, "record_index"),
            "transform_add": lambda: recon.transform(orders, q.ORDER, recon.Transform("add", "O-TOTAL", "1.00"))[0],
        }
        seconds = {}
        for name, make in run.items():
            took = []
            for _ in range(3):
                began = time.perf_counter()
                make().write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - began)
            seconds[name] = round(min(took), 3)
        print(json.dumps({"metric": "recordloom_headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
