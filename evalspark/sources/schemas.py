"""Schemas of the tables at rest."""

from __future__ import annotations

CORRUPT = "_corrupt"

EXAMPLE = "id bigint, input string, label string, ground_truth string, domain string"

LOG_ROW = (
    "run_id string, iter bigint, batch bigint, ts string, artifact_hash string, parent bigint, plan_id string, "
    "rationale string, artifact string, metrics_train map<string,double>, metrics_dev map<string,double>, "
    "metrics_test map<string,double>, stage_a_summary string"
)

PREDICTION = "artifact_hash string, split string, id bigint, prediction string, run_id string"

LEDGER = "artifact_hash string, split string, bucket bigint, bits binary, run_id string"
