"""Training reports of all versions in one folder: read by one schema, judged by rules that are Columns, problems as a relation.

A report says on which data a model was trained, how its settings were chosen, what a check and a final test gave. Version 1 has no fingerprint
of the model, version 2 none of the scaled errors, version 3 no spread over repeats; what a version doesn't have is null and isn't judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The versions that can be read.
VERSIONS = (1, 2, 3, 4)
_SOURCE = "struct<kind:string,k:int,repeats:int>"
_PROFILE = "struct<version:int,l1:double,prune:double,finetune_epochs:int,compact:boolean>"
_STEPS = f"array<struct<cancelled:boolean,profile:{_PROFILE}>>"
_PLAN = "struct<kind:string,k:int,repeats:int,seed:bigint>"
SCHEMA = (
    f"version int, dataset string, model string, columns string, n_outputs int, "
    f"stamp struct<dataset:string,plan:{_PLAN},config:string,profile:{_PROFILE},final_seed:bigint>, "
    f"selection struct<kind:string,objective:string,seeds:array<bigint>>, "
    f"check struct<source:{_SOURCE},r2:double,r2_std_repeats:double,histories:array<{_SOURCE}>,interpret:{_STEPS},outputs:int>, "
    f"final struct<plan:{_PLAN},final_seed:bigint,source:{_SOURCE},has_validation:boolean,interpret:{_STEPS},outputs:int,r2:double>"
)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """file (its name) and the fields of ``SCHEMA`` of each report in a folder of JSON files, whatever its version."""
    return spark.read.schema(SCHEMA).json(folder, multiLine=False).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "*")


def eval_source(plan: Column) -> Column:
    """What a plan's runs are scored on: validation of a holdout, or its folds and repeats."""
    folds = plan["kind"] == "kfold"
    return F.struct(F.when(folds, "cv").otherwise("validation").alias("kind"), F.when(folds, plan["k"]).alias("k"), F.when(folds, plan["repeats"]).alias("repeats"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def rules(model: Column, columns: Column, config: Column, profile: Column) -> dict[str, Column]:
    """rule -> whether the report breaks it; the arguments describe the model that lies beside the report."""
    c = F.col
    plan, check, final, own = c("stamp.plan"), c("check"), c("final"), c("stamp.profile")
    source, checked, done = eval_source(c("stamp.plan")), c("check").isNotNull(), c("final").isNotNull()
    runs = F.when(plan["kind"] == "kfold", plan["k"] * plan["repeats"]).otherwise(1)
    steps = lambda s: F.coalesce(s, F.array().cast(_STEPS))
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    cancelled = lambda s: F.exists(steps(s), lambda r: r["cancelled"])
    foreign = lambda s: F.exists(steps(s), lambda r: ~_same(r["profile"], own))
    bad_plan = ~plan["kind"].isin("holdout", "kfold") | ((plan["kind"] == "kfold") & ((plan["k"] < 2) | (plan["repeats"] < 1)))
    found = {
        "version is known": ~c("version").isin(*VERSIONS),
        "model is the one described": c("model").isNotNull() & (c("model") != model),
        "fingerprint belongs to version 2 and later": (c("version") == 1) != c("model").isNull(),
        "data are those of the run": ~_same(c("dataset"), c("stamp.dataset")),
        "plan is valid": bad_plan,
        "columns are the model's": ~_same(c("columns"), columns),
        "settings are the model's": ~_same(c("stamp.config"), config),
        "profile is the model's": ~_same(own, profile),
        "a search has seeds": (c("selection.kind") == "search") & (size(c("selection.seeds")) == 0),
        "seeds of a search are unlike": (c("selection.kind") == "search") & (size(F.array_distinct("selection.seeds")) < size(c("selection.seeds"))),
        "check is scored as the plan says": checked & ~_same(check["source"], source),
        "check has a history for each run": checked & (size(check["histories"]) != runs),
        "no spread over repeats without repeats": checked & (F.coalesce(check["source"]["repeats"], F.lit(1)) < 2) & (F.coalesce(check["r2_std_repeats"], F.lit(0.0)) != 0),
        "check has a profile's steps for each run": checked & (size(check["interpret"]) != F.when(own.isNotNull(), runs).otherwise(0)),
        "histories are scored as their check": checked & F.exists(F.coalesce(check["histories"], F.array().cast(f"array<{_SOURCE}>")), lambda h: ~_same(h, check["source"])),
        "check has scores for each output": checked & ~_same(check["outputs"], c("n_outputs")),
        "check's steps were ended": checked & cancelled(check["interpret"]),
        "check's steps are of the profile": checked & foreign(check["interpret"]),
        "a final run follows a check": done & ~checked,
        "final test is of the run's plan": done & ~_same(final["plan"], plan),
        "final seed is the run's": done & ~_same(final["final_seed"], c("stamp.final_seed")),
        "final history is scored as the plan says": done & ~_same(final["source"], source),
        "final run has steps if there is a profile": done & ((size(final["interpret"]) > 0) != own.isNotNull()),
        "final history has no validation": done & F.coalesce(final["has_validation"], F.lit(False)),
        "final run has scores for each output": done & ~_same(final["outputs"], c("n_outputs")),
        "final steps were ended": done & cancelled(final["interpret"]),
        "final steps are of the profile": done & foreign(final["interpret"]),
    }
    return {name: F.coalesce(broken, F.lit(False)) for name, broken in found.items()}


def problems(reports: DataFrame, models: DataFrame) -> DataFrame:
    """file, version, rule of every rule that a report breaks. ``models``: file, model, columns, config, profile of the model beside each report.

    A report without a model breaks the rules on it; all rules of all reports are judged in one pass.
    """
    beside = models.select("file", *[F.col(c).alias(f"_{c}") for c in ("model", "columns", "config", "profile")])
    of = rules(F.coalesce("_model", F.lit("")), F.col("_columns"), F.col("_config"), F.col("_profile"))
    broken = F.array_compact(F.array(*[F.when(b, F.lit(name)) for name, b in of.items()]))
    return reports.join(beside, "file", "left").select("file", "version", F.explode(broken).alias("rule"))


def describe(reports: DataFrame) -> DataFrame:
    """file, chosen, evaluation, weights_verified, test_disclosed: what a reader should see of each report."""
    chosen = F.when(F.col("selection.kind") == "search", F.concat(F.lit("search by "), F.col("selection.objective"))).otherwise("by hand")
    score = F.when(F.col("final").isNotNull(), F.concat(F.lit("test, R2 "), F.format_string("%.5f", "final.r2"))).when(F.col("check").isNotNull(), F.concat(F.col("check.source.kind"), F.lit(", R2 "), F.format_string("%.5f", "check.r2"))).otherwise("no scores")
    return reports.select("file", chosen.alias("chosen"), score.alias("evaluation"), F.col("model").isNotNull().alias("weights_verified"), F.col("final").isNotNull().alias("test_disclosed"))
