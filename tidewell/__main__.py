"""The five analyses over two CSV files: ``python -m tidewell --transactions T --accounts A --output FOLDER``.

``--parameters`` names a JSON file with any of the fields of ``QueryParams``. The transactions are read once. Rows that cannot be
read go to ``FOLDER.bad`` with their reason; ``--strict`` fails on the first of them instead. The five results appear together.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tidewell.params import QueryParams
from tidewell.plans import five
from tidewell.sources import files, sinks, staging, tables


def run(spark: SparkSession, transactions: str, accounts: str, output: str, p: QueryParams = QueryParams(), strict: bool = False) -> dict[str, int]:
    """Read both inputs and write ``query1.csv`` to ``query5.csv``; numbers of rows that came, were set aside, and were written."""
    output = output.rstrip("/")
    staged = staging.stage(spark, transactions, files.scratch(spark, "staged"), p.usd)
    try:
        bad = staged.counts["read"] - staged.counts["good"]
        if strict and bad:
            raise ValueError(f"{bad} rows cannot be read: {staged.counts}")
        results = five.run_staged(staged, tables.read_accounts(spark, accounts), tables.rates(spark), p)
        written = sinks.write_together(results, output)
        if bad:
            sinks.write_csv(staged.set_aside(), f"{output}.bad")
        return staged.counts | written
    finally:
        files.remove(spark, staged.folder)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidewell", description=__doc__)
    for name in ("transactions", "accounts", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--parameters")
    parser.add_argument("--strict", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tidewell").getOrCreate()
    p = QueryParams()
    if args.parameters:  # through Spark, so that it may lie where the inputs do
        p = QueryParams.from_mapping(json.loads("\n".join(r.value for r in spark.read.text(args.parameters, wholetext=True).collect())))
    print(json.dumps(run(spark, args.transactions, args.accounts, args.output, p, args.strict)))


if __name__ == "__main__":
    main()
