"""Converts files on the command line: prints a JSON summary; exit code 0 if none failed, 1 if some did, 2 if nothing was begun."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pageloom.model import TARGETS
from pageloom.sources.engines import PROFILES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pageloom", description=__doc__)
    p.add_argument("inputs", nargs="+", help="files to convert")
    p.add_argument("--to", required=True, choices=list(TARGETS), dest="target", help="the format of the results")
    p.add_argument("--output", default=os.path.join(os.getcwd(), "converted"), help="the folder of the results, below the home folder")
    p.add_argument("--ocr-profile", choices=list(PROFILES), default="standard", help="how pages are recognised")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from pageloom.operators import admission, report
    from pageloom.plans.convert import convert
    from pageloom.sources import files, writers

    try:
        folder = admission.output_folder(args.output)
        missing = [x for x in args.inputs if not os.path.isfile(x)]
        if missing:
            raise FileNotFoundError(", ".join(missing))
        own = spark or SparkSession.builder.getOrCreate()
        out = convert(files.files(own, [os.path.abspath(x) for x in args.inputs]), args.target).persist()
        writers.write_files(out, folder)
        rows = [json.loads(r.json) for r in report.report_json(out.drop("output")).collect()]  # one for each file named
        out.unpersist()
    except (ValueError, OSError, PySparkException) as e:
        print(f"错误：{e}", file=sys.stderr)
        return 2
    failed = sum(not r["success"] and not r["skipped"] for r in rows)
    print(json.dumps({"success": sum(r["success"] for r in rows), "failed": failed, "reports": rows}, ensure_ascii=False, indent=2))
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
