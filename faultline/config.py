"""Run configuration: budgets per run mode, split shares and column names."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

# Budgets of the three run modes.
RUN_MODES = {
    "fast": {
        "max_features": 3000, "ngram_max": 1, "cv_folds": 2, "learning_sizes": 4,
        "grid_c": [0.1, 1.0], "grid_balanced": [False, True], "grid_loss": ["squared_hinge"],
        "slow_models": False,
    },
    "balanced": {
        "max_features": 5000, "ngram_max": 2, "cv_folds": 2, "learning_sizes": 5,
        "grid_c": [0.1, 1.0, 5.0], "grid_balanced": [False, True], "grid_loss": ["hinge", "squared_hinge"],
        "slow_models": False,
    },
    "full": {
        "max_features": 20000, "ngram_max": 2, "cv_folds": 3, "learning_sizes": 8,
        "grid_c": [0.01, 0.1, 0.5, 1.0, 5.0], "grid_balanced": [False, True], "grid_loss": ["hinge", "squared_hinge"],
        "slow_models": True,
    },
}

# Column headers of the raw export -> names used in this package. Headers not listed
# keep their own name.
RAW_COLUMNS = {
    "General.Eriref": "report_id",
    "Faulty product.Design Responsible MHO": "team",
    "General.Heading": "heading",
    "Observation.Observation": "observation",
    "Answer.Answer": "answer",
    "Registered": "registered",
    "General.Submitter priority": "priority",
    "General.Superior MHO": "superior_unit",
    "Observation.Fault type": "fault_type",
    "routing_time": "routing_time",
    "routing_waiting_time": "routing_waiting_time",
    "total_routing_time": "total_routing_time",
    "total_time": "total_time",
    "routed": "routed",
    "General.Is duplicate TR": "is_duplicate_report",
    "General.Duplicate TRs": "duplicate_reports",
    "Faulty product.Product no & R-State": "product_rstate",
    "Faulty product.Product no": "product_no",
    "Node level.Product no": "node_product_no",
    "General.Primary TR": "primary_report",
    "Analysis.Fault type": "analysis_fault_type",
    "Improvement.Type explanation": "improvement_type",
    "TR History Register.Register date": "register_date",
}

# Share of the vocabulary budget given to each text section (fixed values), with a floor per section.
SECTION_SHARES = {"heading": 0.20, "effect": 0.45, "config": 0.15, "cause": 0.20}
SECTION_FLOOR = 100

SPLIT_MODES = ("random_stratified", "temporal")


def run_mode(name: str) -> dict:
    if name not in RUN_MODES:
        raise ValueError(f"unknown run mode {name!r}; use one of {sorted(RUN_MODES)}")
    return dict(RUN_MODES[name])


@dataclass(frozen=True)
class RunConfig:
    mode: str = "fast"
    seed: int = 42
    split_mode: str = "random_stratified"
    train_share: float = 0.60
    validation_share: float = 0.20
    min_samples: int = 100
    drop_rare: bool = False
    categorical_columns: tuple = ("superior_unit", "fault_type")
    logistic_max_iter: int = 1000
    svm_max_iter: int = 3000
    svm_tolerance: float = 1e-4          # a fit stops when its gradient norm fell to this share of the first one
    forest_depth: int = 30               # the deepest that Spark grows a tree
    c: float = 1.0
    max_features: int | None = None      # None: taken from the run mode
    slow_models: bool | None = None      # None: taken from the run mode
    calibrate: bool = False              # True: a best model without probabilities is calibrated, so that scoring has a confidence
    strict_dates: bool = False           # True: date features do not accept the ' - ' date form
    csv_encoding: str = "ISO-8859-1"

    def __post_init__(self):
        run_mode(self.mode)
        if self.split_mode not in SPLIT_MODES:
            raise ValueError(f"unknown split mode {self.split_mode!r}; use one of {SPLIT_MODES}")

    @property
    def budgets(self) -> dict:
        out = run_mode(self.mode)
        if self.max_features is not None:
            out["max_features"] = self.max_features
        if self.slow_models is not None:
            out["slow_models"] = self.slow_models
        return out

    def section_budgets(self) -> dict[str, int]:
        total = self.budgets["max_features"]
        return {name: max(int(total * share), SECTION_FLOOR) for name, share in SECTION_SHARES.items()}

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "RunConfig":
        """Settings of a saved run; keys this version does not know are ignored."""
        known = {f.name for f in fields(cls)}
        kept = {k: v for k, v in json.loads(text).items() if k in known}
        if "categorical_columns" in kept:
            kept["categorical_columns"] = tuple(kept["categorical_columns"])
        return cls(**kept)
