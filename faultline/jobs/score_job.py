"""spark-submit faultline/jobs/score_job.py --model models/routing --input new.parquet --output scored"""

from __future__ import annotations

import argparse

from faultline.operators.confidence import GATE
from faultline.operators.scoring import predict_and_route
from faultline.session import build_session
from faultline.sources.bundle import load_bundle


def parse_args(argv=None):
    p = argparse.ArgumentParser(description="Score a table of reports and mark which can be routed automatically.")
    p.add_argument("--model", required=True)
    p.add_argument("--input", required=True, help="Parquet table of new reports; missing columns are allowed")
    p.add_argument("--output", required=True)
    p.add_argument("--threshold", type=float, default=GATE)
    return p.parse_args(argv)


def run(spark, args):
    bundle = load_bundle(args.model, spark)
    predict_and_route(spark.read.parquet(args.input), bundle, args.threshold).write.mode("overwrite").parquet(args.output)


if __name__ == "__main__":
    run(build_session("faultline-score"), parse_args())
