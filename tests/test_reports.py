"""A refusal for each rule of training reports, and reports of all versions in one folder."""

import json

import numpy as np
from pyspark.sql import functions as F

from tabularium.operators import profile, reports

PLAN = {"kind": "kfold", "k": 2, "repeats": 1, "seed": 0}
SOURCE = {"kind": "cv", "k": 2, "repeats": 1}
PROFILE = {"version": 1, "l1": 0.001, "prune": 0.05, "finetune_epochs": 20, "compact": True}
STEP = {"cancelled": False, "profile": PROFILE}
GOOD = {
    "version": 4, "dataset": "d", "model": "m", "columns": "a,y", "n_outputs": 1, "stamp": {"dataset": "d", "plan": PLAN, "config": "c", "profile": PROFILE, "final_seed": 7},
    "selection": {"kind": "search", "objective": "aggregate_r2", "seeds": [0, 1]}, "check": {"source": SOURCE, "r2": 0.9, "r2_std_repeats": 0.0, "histories": [SOURCE, SOURCE], "interpret": [STEP, STEP], "outputs": 1},
    "final": {"plan": PLAN, "final_seed": 7, "source": SOURCE, "has_validation": False, "interpret": [STEP], "outputs": 1, "r2": 0.8},
}
#: (place, value) and the rules that it breaks
FAULTS = [
    (("version",), 9, ["version is known"]), (("model",), "x", ["model is the one described"]), (("model",), None, ["fingerprint belongs to version 2 and later"]), (("version",), 1, ["fingerprint belongs to version 2 and later"]),
    (("dataset",), "e", ["data are those of the run"]), (("columns",), "b,y", ["columns are the model's"]), (("stamp", "config"), "x", ["settings are the model's"]),
    (("stamp", "profile", "l1"), 0.5, ["profile is the model's", "check's steps are of the profile", "final steps are of the profile"]),
    (("selection", "seeds"), [], ["a search has seeds"]), (("selection", "seeds"), [3, 3], ["seeds of a search are unlike"]),
    (("check", "source"), {"kind": "cv", "k": 3, "repeats": 1}, ["check is scored as the plan says", "histories are scored as their check"]), (("check", "histories"), [SOURCE], ["check has a history for each run"]),
    (("check", "r2_std_repeats"), 0.1, ["no spread over repeats without repeats"]), (("check", "interpret"), [], ["check has a profile's steps for each run"]),
    (("check", "histories"), [SOURCE, {"kind": "validation"}], ["histories are scored as their check"]), (("check", "outputs"), 2, ["check has scores for each output"]),
    (("check", "interpret", 0, "cancelled"), True, ["check's steps were ended"]), (("check", "interpret", 1, "profile", "prune"), 0.5, ["check's steps are of the profile"]), (("check",), None, ["a final run follows a check"]),
    (("final", "plan", "seed"), 3, ["final test is of the run's plan"]), (("final", "final_seed"), 1, ["final seed is the run's"]), (("final", "source", "k"), 5, ["final history is scored as the plan says"]),
    (("final", "interpret"), None, ["final run has steps if there is a profile"]), (("final", "has_validation"), True, ["final history has no validation"]), (("final", "outputs"), 3, ["final run has scores for each output"]),
    (("final", "interpret", 0, "cancelled"), True, ["final steps were ended"]), (("final", "interpret", 0, "profile", "compact"), False, ["final steps are of the profile"]),
]


def changed(place, value):
    out = json.loads(json.dumps(GOOD))
    at = out
    for p in place[:-1]:
        at = at[p]
    at[place[-1]] = value
    return out


def test_each_rule_refuses_its_fault_and_nothing_else(spark, tmp_path):
    held = {"good": GOOD, "plain": {**changed(("final",), None), "check": None}, **{f"f{i:02d}": changed(p, v) for i, (p, v, _) in enumerate(FAULTS)}}
    held["plan"] = changed(("stamp", "plan"), {**PLAN, "k": 1})
    first = {k: v for k, v in changed(("model",), None).items() if k != "model"}
    held["first"] = {**first, "version": 1, "check": {k: v for k, v in GOOD["check"].items() if k != "r2_std_repeats"}}
    for name, report in held.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(report) + "\n")
    found = reports.read_reports(spark, str(tmp_path))
    own = F.from_json(F.lit(json.dumps(PROFILE)), reports._PROFILE)
    models = found.select("file", F.lit("m").alias("model"), F.lit("a,y").alias("columns"), F.lit("c").alias("config"), own.alias("profile"))
    got = {}
    for r in reports.problems(found, models).collect():
        got.setdefault(r.file.removesuffix(".json"), []).append(r.rule)
    want = {f"f{i:02d}": sorted(rules) for i, (*_, rules) in enumerate(FAULTS)}
    assert {k: sorted(v) for k, v in got.items() if k != "plan"} == want and "plan is valid" in got["plan"]
    judged = {rule for *_, rules in FAULTS for rule in rules} | {"plan is valid"}
    assert judged == set(reports.rules(F.lit(""), F.lit(""), F.lit(""), own))
    said = {r.file: (r.chosen, r.evaluation, r.weights_verified, r.test_disclosed) for r in reports.describe(found).collect()}
    assert said["good.json"] == ("search by aggregate_r2", "test, R2 0.80000", True, True) and said["plain.json"][1:] == ("no scores", True, False) and said["first.json"][2] is False


def test_ties_and_their_notes(spark):
    rows = [(1.0 + i, 3.0 + i % 7, 100.0 - (1 + i) - (3 + i % 7), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "x0 double, x1 double, x2 double, y double")
    one = profile.affine_dependencies(df, ["x0", "x1", "x2"]).collect()
    assert len(one) == 1 and abs(one[0].intercept - 100) < 1e-6 and one[0].is_exact and all(abs(t.coefficient + 1) < 1e-6 for t in one[0].terms)
    assert [r.message for r in profile.dependency_notes(profile.affine_dependencies(df, ["x0", "x1", "x2"])).collect()] == ["tied exactly to other inputs: x0 ≈ 100 - 1·x1 - 1·x2 (R2 = 1.000000)"]
    assert profile.affine_dependencies(spark.createDataFrame([(i % 5 * 1.7 + 0.3, float(i * 7 % 11)) for i in range(40)], "a double, b double"), ["a", "b"]).count() == 0
    assert profile.affine_dependencies(spark.createDataFrame([(i * 1e-20, i * 2e-20) for i in range(40)], "a double, b double"), ["a", "b"]).first().is_exact
    r = np.random.default_rng(1)
    x = r.normal(0, 1, 500)
    near = spark.createDataFrame([(float(1e6 + v + e), float(v)) for v, e in zip(x, r.normal(0, 0.02, 500))], "a double, b double")
    got = profile.affine_dependencies(near, ["a", "b"]).first()
    residual = np.array([a.a - got.intercept - got.terms[0].coefficient * a.b for a in near.collect()])
    values = np.array([a.a for a in near.collect()])
    assert abs(got.r2 - (1 - (residual**2).sum() / ((values - values.mean()) ** 2).sum())) < 1e-9 and not got.is_exact
