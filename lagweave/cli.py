"""All-to-all tool: optimal dimension, cross-map skill, correlation and their difference for every pair of series.

    spark-submit -m lagweave.cli INPUT OUTPUT [--rho] [--rho-diff] [-e 20] [-t 1]

INPUT is a panel in Parquet, or a CSV file whose columns are series. The sid column carries the names through.
"""

from __future__ import annotations

import argparse

from lagweave.functions.stats import corr_matrix
from lagweave.operators.crossmap import rho_diff, xmap
from lagweave.operators.dimension import optimal_e
from lagweave.plans.config import session
from lagweave.sources import panel as P


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="lagweave", description=__doc__)
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("-e", "--max-embedding-dim", "--embedding-dim", dest="e_max", type=int, default=20)
    a.add_argument("-t", "--tau", type=int, default=1)
    a.add_argument("--order-col", help="column of a CSV that orders its rows")
    a.add_argument("--rho", action="store_true", help="write the correlation of every pair")
    a.add_argument("--rho-diff", action="store_true", help="write skill less absolute correlation; implies --rho")
    args = a.parse_args(argv)
    spark = session()
    panel = P.load_csv(spark, args.input, args.order_col) if args.input.endswith(".csv") else P.load_parquet(spark, args.input)
    P.check_panel(panel)
    optimal_e(panel, args.e_max, args.tau, 1).write.mode("overwrite").parquet(f"{args.output}/e")
    dims = spark.read.parquet(f"{args.output}/e")
    P.write_matrix(xmap(panel, dims, args.tau, 0), f"{args.output}/ccm")
    if args.rho or args.rho_diff:
        P.write_matrix(corr_matrix(panel), f"{args.output}/rho")
    if args.rho_diff:
        P.write_matrix(rho_diff(spark.read.parquet(f"{args.output}/ccm"), spark.read.parquet(f"{args.output}/rho")), f"{args.output}/rhodiff")


if __name__ == "__main__":
    main()
