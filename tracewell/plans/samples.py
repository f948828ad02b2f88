"""A made-up result bundle that every rule allows, and ways to break it."""

from __future__ import annotations

import json

_LAPS = {"segment_ends_m": [200, 400], "values_s": [12.5, None]}
_CORNER = {
    "checkpoint": "1C",
    "groups": [
        {"members": [1, 2], "inner_to_outer": [2, 1], "marked_leader": 2, "gap_from_previous": None},
        {"members": [3], "inner_to_outer": None, "marked_leader": None, "gap_from_previous": "unknown"},
    ],
    "unobserved_gate_numbers": [4],
    "unknown_reason": "fog",
}
SOUND = json.dumps(
    {
        "schema_version": "viewer/v1",
        "bundle_type": "race_simulation_result",
        "run_id": "run",
        "race_id": "race",
        "as_of": "2024-01-01T00:00:00Z",
        "generated_at": "2024-01-01T01:00:00Z",
        "producer_code_commit": "0" * 40,
        "dataset_id": "d",
        "model_id": None,
        "origin": "synthetic",
        "mode": "prospective",
        "race": {"name": "n", "course": "c", "surface": "turf", "distance_m": 400, "start_at": "2024-01-02T00:00:00+09:00", "runners": [{"horse_id": f"h{i}", "gate_no": i, "name": "x"} for i in (1, 2, 3, 4)]},
        "simulation": {"total_trials": 3, "completed_trials": 2, "representative_trials": [{"trial_id": "t", "laps": _LAPS, "corners": [_CORNER]}], "lap_quantiles": []},
        "observations": {"laps": None, "corners": [_CORNER]},
        "quality": {"missing_fields": [], "notes": ["made up"]},
    }
)
#: (text of SOUND, what takes its place, violations that follow)
BROKEN = (
    ('{"schema_version"', '{"extra": 1, "schema_version"', "$: unknown key"),
    ('"viewer/v1"', '"viewer/v2"', "$.schema_version: not among the values"),
    ('"prospective"', '"weird"', "$.mode: not among the values"),
    ('"run_id": "run"', '"run_id": ""', "$.run_id: length,$.run_id: pattern"),
    ('"model_id": null, ', "", "$: missing key"),
    ('"total_trials": 3', '"total_trials": 1000000000', "$.simulation.total_trials: range"),
    ('"horse_id": "h2"', '"horse_id": "h1"', "horse_id unique"),
    ('"total_trials": 3', '"total_trials": 1', "completed within total"),
    ('"distance_m": 400', '"distance_m": "400"', "$.race.distance_m: kind"),
    ('"marked_leader": 2', '"marked_leader": 100', "$.simulation.representative_trials[].corners[].groups[].marked_leader: range,$.observations.corners[].groups[].marked_leader: range"),
    ('"missing_fields": []', '"missing_fields": [""]', "$.quality.missing_fields[]: length,$.quality.missing_fields[]: pattern"),
)
