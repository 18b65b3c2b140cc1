"""python -m recordloom.cli dump | reconcile | explain | totals | decode | ingest | pilot"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from recordloom.functions.decode import ASCII, CP500, decode_long
from recordloom.operators.recon import control_totals, dirty_fields, explain_field, reconcile, record_json, strict_decode
from recordloom.plans.copybook import CopybookError, compile_layout, from_directory
from recordloom.plans.pilot import LeakError, run_pilot, sample_pilot, sample_unit, write_evidence
from recordloom.sources.fixedrec import ExitCode, IngestError, Policy, file_manifest, nth_record, read_records


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recordloom")
    p.add_argument("command", choices=["dump", "reconcile", "explain", "totals", "decode", "ingest", "pilot"])
    p.add_argument("--data", help="a file of records, or a folder of such files; pilot without it takes the declared sample unit")
    p.add_argument("--copybook")
    p.add_argument("--copydir")
    p.add_argument("--record-len", type=int)
    p.add_argument("--encoding", choices=[ASCII, CP500], default=ASCII)
    p.add_argument("--newline", choices=["reject", "allow", "strip"], default="reject")
    p.add_argument("--partial", choices=["reject", "evidence"], default="reject")
    p.add_argument("--dirty-mode", choices=["evidence", "strict"], default="evidence")
    p.add_argument("--record", type=int, default=0)
    p.add_argument("--field")
    p.add_argument("--out")
    p.add_argument("--pilot-id", default="PILOT-DECLARED-SYNTHETIC-001")
    p.add_argument("--notes", default="")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    show = lambda df: [print(x) for x in df.toJSON().collect()]  # noqa: E731  one record or one summary
    try:
        layout = None
        if a.copybook:
            with open(a.copybook, encoding="utf-8") as f:
                layout = compile_layout(f.read(), from_directory(a.copydir) if a.copydir else (lambda _: None))
        if a.command == "pilot":
            pilot = sample_pilot(a.pilot_id, a.notes)
            unit = read_records(spark, a.data, Policy(pilot.variants.variants[0].layout.record_len, a.newline, a.partial)) if a.data else sample_unit(spark)
            made = run_pilot(unit, pilot, a.encoding)
            if a.out:
                write_evidence(made, a.out)
            print(made.texts["packet"])
            return ExitCode.SUCCESS if json.loads(made.texts["casefile"])["balanced"] else ExitCode.EVIDENCE_WARNINGS
        if not a.data:
            print("--data is needed", file=sys.stderr)
            return ExitCode.STRICT_FAILURE
        n = a.record_len if a.record_len is not None else layout.record_len if layout else 0
        policy = Policy(n, a.newline, a.partial)
        if a.command == "ingest":
            manifests = [r.asDict() for r in file_manifest(spark, a.data, policy).orderBy("path").collect()]  # a row for each file
            for manifest in manifests:
                print(json.dumps(manifest))
            return max((m["exit_code"] for m in manifests), default=ExitCode.SUCCESS)
        if layout is None:
            print("--copybook is needed", file=sys.stderr)
            return ExitCode.BAD_LAYOUT
        rows = read_records(spark, a.data, policy)
        if a.command == "dump":
            show(decode_long(nth_record(spark, a.data, policy, a.record), layout, a.encoding, groups=True))
        elif a.command == "explain":
            show(explain_field(nth_record(spark, a.data, policy, a.record), layout, a.field, a.record, a.encoding))
        elif a.command == "totals":
            show(control_totals(rows, layout, a.encoding))
        elif a.command == "decode":
            rows = strict_decode(rows, layout, a.encoding) if a.dirty_mode == "strict" else rows
            bad = dirty_fields(rows, layout, a.encoding)
            lines = record_json(rows, layout, a.encoding).select("record_index", "line").join(bad, "record_index")
            if a.out:
                lines.write.mode("overwrite").json(a.out)
            return ExitCode.EVIDENCE_WARNINGS if bad.where(F.size("invalid") > 0).limit(1).count() else ExitCode.SUCCESS
        else:
            made = reconcile(rows, layout, a.data, a.encoding)
            show(made.receipt)
            if a.out:
                made.lines.select("line").write.mode("overwrite").text(f"{a.out}/lines")
                made.summary.write.mode("overwrite").json(f"{a.out}/unsupported")
            return ExitCode.EVIDENCE_WARNINGS if made.ledger.limit(1).count() else ExitCode.SUCCESS
        return ExitCode.SUCCESS
    except IngestError as e:
        print(e, file=sys.stderr)
        return e.code
    except OSError as e:
        print(e, file=sys.stderr)
        return ExitCode.UNREADABLE
    except LeakError as e:
        print(e, file=sys.stderr)
        return ExitCode.STRICT_FAILURE
    except (CopybookError, KeyError) as e:
        print(e, file=sys.stderr)
        return ExitCode.BAD_LAYOUT
    except PySparkException as e:
        if a.command == "decode" and a.dirty_mode == "strict":
            print(str(e).splitlines()[0], file=sys.stderr)
            return ExitCode.STRICT_FAILURE
        raise


if __name__ == "__main__":
    sys.exit(int(main()))
