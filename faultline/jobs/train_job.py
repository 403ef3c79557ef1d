"""Trains the routing models and stores the best one with its comparison table.

    spark-submit faultline/jobs/train_job.py reports.csv models/routing --set mode=balanced --set min_samples=50

Every field of RunConfig can be set. REPORTS is a CSV export or a Parquet table with an ingest_pos column."""

from __future__ import annotations

import argparse
import dataclasses

from faultline.config import RunConfig
from faultline.operators.evaluation import round_numbers
from faultline.plans.training import train
from faultline.session import build_session, checkpoint
from faultline.sources.csv_reports import read_reports_csv

_CASTS = {"str": str, "int": int, "float": float, "bool": lambda v: v.lower() == "true", "tuple": lambda v: tuple(v.split(","))}


def config_from(settings: list[str]) -> RunConfig:
    """RunConfig with the given name=value settings; an unknown name is an error."""
    kinds = {f.name: f.type.split(" |")[0] for f in dataclasses.fields(RunConfig)}
    pairs = [s.partition("=")[::2] for s in settings]
    unknown = [name for name, _ in pairs if name not in kinds]
    if unknown:
        raise ValueError(f"unknown settings {unknown}; there are {sorted(kinds)}")
    return RunConfig(**{name: _CASTS[kinds[name]](value) for name, value in pairs})


def load_reports(spark, path: str, config: RunConfig):
    is_csv = path.removesuffix(".gz").lower().endswith(".csv")
    return checkpoint(read_reports_csv(spark, path, config)) if is_csv else spark.read.parquet(path)


def run(spark, reports: str, model: str, settings: list[str] = ()):
    config = config_from(list(settings))
    result = train(load_reports(spark, reports, config), config, model)
    compared = result.result_frame()
    compared.coalesce(1).write.mode("overwrite").parquet(f"{model}/results")
    round_numbers(compared, 4).show(truncate=False)
    return result


if __name__ == "__main__":
    options = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    options.add_argument("reports")
    options.add_argument("model")
    options.add_argument("--set", dest="settings", action="append", default=[], metavar="NAME=VALUE")
    run(build_session("faultline-train"), **vars(options.parse_args()))
