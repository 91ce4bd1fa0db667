"""Small exact cases of the table, evaluation, model and delivery operators."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.functions import numeric
from tabularium.operators import curves, diagnostics, metrics, models, profile, provenance, scaling, schema, scoring, search, split, symbolic
from tabularium.plans import catalogue
from tabularium.sources import generators, open_table, text_table, workbook
from tabularium.streaming import scorer


def write(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


# ---- sources


def test_cells_comments_and_blank_lines(spark, tmp_path):
    t = text_table.read_table(spark, write(tmp_path, "a,b\n# note\n1,2\n\n3,4  # tail\n"))
    assert t.header == ["a", "b"] and [tuple(r) for r in t.rows.orderBy("row_no").collect()] == [(3, ["1", "2"]), (5, ["3", "4"])]


def test_empty_cells_stay_and_tabs_are_found(spark, tmp_path):
    t = text_table.read_table(spark, write(tmp_path, "a\tb\tc\n\t2\t\n"))
    assert t.delimiter == "\t" and t.rows.first()["cells"] == ["", "2", ""]


@pytest.mark.parametrize("text", ["", "# only\n", "a,b\n"])
def test_tables_without_rows_are_refused(spark, tmp_path, text):
    with pytest.raises(ValueError):
        text_table.read_table(spark, write(tmp_path, text))


def test_ragged_rows_by_file_row(spark, tmp_path):
    t = text_table.read_table(spark, write(tmp_path, "a,b\n1,2\n3\n4,5\n"))
    assert [r["row_no"] for r in text_table.ragged_rows(t).collect()] == [3]


def test_dataset_and_its_errors(spark, tmp_path):
    t = text_table.read_table(spark, write(tmp_path, "x,m,y\n0.5,sand,3\n1.5,clay,5\n"))
    of = lambda *levels: schema.Schema((schema.Field("x"), schema.Field("m", schema.INPUT, levels), schema.Field("y", schema.OUTPUT)))
    rows = open_table.dataset(t, of("sand", "clay")).orderBy("row_id").collect()
    assert [(r.x, r.m, r.y) for r in rows] == [(0.5, 0, 3.0), (1.5, 1, 5.0)]
    with pytest.raises(ValueError, match="row 3.*m"):
        open_table.dataset(t, of("sand"))
    bad = text_table.read_table(spark, write(tmp_path, "a,b\n# c\n1,2\n\nnot-a-number,4\n"))
    with pytest.raises(ValueError, match="row 5"):
        open_table.dataset(bad, schema.Schema((schema.Field("a"), schema.Field("b", schema.OUTPUT))))


def test_header_names_say_outputs_and_categories():
    assert text_table.output_start(["x0", "x1", "Y0", "more"]) == 2
    assert text_table.output_start(["a", "output"]) == 1 and text_table.output_start(["y", "x"]) is None
    assert text_table.categorical_by_name("material_id") and not text_table.categorical_by_name("width")


def book(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, cells in enumerate(sheets.values()):
            body = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in zip("ABC", row)) + "</row>" for r, row in cells.items())
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    path = tmp_path / "b.xlsx"
    path.write_bytes(book({"one": {1: ["a", "b"], 3: ["1", "2"]}, "two": {1: ["c"], 2: ["9"]}}))
    with pytest.raises(ValueError, match="one, two"):
        workbook.read_workbook(spark, str(path))
    t = workbook.read_workbook(spark, str(path), "one")
    assert t.header == ["a", "b"] and tuple(t.rows.first()) == (3, ["1", "2"])
    with pytest.raises(ValueError, match="no sheet"):
        workbook.read_workbook(spark, str(path), "three")


# ---- parsing, profiles


def test_numbers_are_parsed_strictly(spark):
    cells = ["1", " 2.5 ", "1f", "1_0", "NaN", "inf", "1e39", "", None, "-.5", "3."]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(numeric.parse_number(F.col("c")).alias("v")).collect()
    assert [r.v for r in rows] == [1.0, 2.5, None, None, None, None, None, None, None, -0.5, 3.0]


def test_codes(spark):
    rows = spark.createDataFrame([("1.0",), ("0.5",), ("7",), ("b",)], "c string")
    got = rows.select(numeric.parse_code(F.col("c"), ["a", "b", "c"], True).alias("v"), numeric.parse_code(F.col("c"), ["a", "b", "c"], False).alias("w")).collect()
    assert [(r.v, r.w) for r in got] == [(1, None), (None, None), (None, None), (1, 1)]


def test_profile_of_missing_text_and_duplicates(spark):
    df = spark.createDataFrame([("1", "x", "5"), ("", "y", "5"), ("1", "x", "5"), ("2", "", "5")], "a string, b string, c string")
    rows = {r["column"]: r for r in profile.profile_columns(df, ["a", "b", "c"]).collect()}
    assert (rows["a"].missing, rows["a"].non_numeric) == (1, 0) and (rows["b"].missing, rows["b"].non_numeric) == (1, 3) and rows["c"].is_constant
    assert profile.duplicate_rows(df, ["a", "b", "c"]).first()["duplicate_rows"] == 1
    many = spark.range(300).selectExpr("cast(id as string) as v")
    assert profile.profile_columns(many, ["v"]).first()["distinct_values"] is None


def test_affine_dependencies(spark):
    b1 = spark.createDataFrame([(float(1 + i), float(3 + i % 7), float(100 - (1 + i) - (3 + i % 7))) for i in range(40)], "a double, b double, c double")
    found = profile.affine_dependencies(b1, ["a", "b", "c"]).collect()
    assert len(found) == 1 and found[0].is_exact and abs(found[0].intercept - 100) < 1e-6 and all(abs(t.coefficient + 1) < 1e-6 for t in found[0].terms)
    none = spark.createDataFrame([((i % 5) * 1.7 + 0.3, float((i * 7) % 11)) for i in range(40)], "a double, b double")
    assert profile.affine_dependencies(none, ["a", "b"]).count() == 0
    two = spark.createDataFrame([(float(i), 2.0 * i, float(i * i % 17), 3.0 * (i * i % 17)) for i in range(40)], "a double, b double, c double, d double")
    assert profile.affine_dependencies(two, ["a", "b", "c", "d"]).count() == 2
    assert [r.target for r in profile.affine_dependencies(two, ["a", "b"]).collect()] == ["a"]


def test_numbers_and_blanks_as_the_text_source_sees_them(spark):
    df = spark.createDataFrame([("1e39", "\u00a0", "3.4028235e38"), ("2", " \u2003 5 ", "-1")], "big string, blank string, edge string")
    rows = {r["column"]: r for r in profile.profile_columns(df, ["big", "blank", "edge"]).collect()}
    assert (rows["big"].non_numeric, rows["big"].is_numeric) == (1, False)
    assert (rows["blank"].missing, rows["blank"].non_numeric) == (1, 0) and rows["edge"].is_numeric


def test_more_levels_than_a_category_has(spark):
    df = spark.range(400).selectExpr("cast(id as string) as v")
    assert profile.category_levels(df.where("id < 256"), "v").count() == 256
    with pytest.raises(Exception, match="more than 256 levels"):
        profile.category_levels(df, "v").collect()


# ---- evaluation


def preds(spark, rows, sigma):
    df = spark.createDataFrame([("y", float(p), float(t)) for p, t in rows], "output string, pred double, target double")
    return metrics.per_output(df, spark.createDataFrame([("y", sigma)], "output string, sigma double")).first()


def test_metrics_by_hand(spark):
    m = preds(spark, [(2, 1), (2, 3)], 2.0)
    assert (m.rmse, m.mae, m.nmae) == (1.0, 1.0, 0.5)
    m = preds(spark, [(1, 1), (2, 2), (3, 3)], 1.0)
    assert (m.rmse, m.r2, m.nmae, m.rel_error) == (0.0, 1.0, 0.0, 0.0)
    m = preds(spark, [(5, 5), (6, 5)], 0.0)
    assert m.nmae is None and m.nrmse is None and m.r2 == 0.0 and m.rel_error is not None
    assert preds(spark, [(1, 0), (1, 5)], 1.0).rel_error is None and preds(spark, [(1, 1)], None).nmae is None


def test_three_spreads(spark):
    rows = [(0, 0, 0, .6), (0, 0, 1, 1.0), (0, 1, 0, .5), (0, 1, 1, .7)]
    r = metrics.over_runs(spark.createDataFrame([("c", *x) for x in rows], "k string, seed int, repeat int, fold int, r2 double"), ["k"]).first()
    assert abs(r.r2_mean - .7) < 1e-12 and abs(r.r2_std_folds - .15) < 1e-12 and abs(r.r2_std_repeats - .1) < 1e-12 and r.r2_std_seeds == 0 and r.is_complete


def test_ranking_puts_finite_scores_first(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", 0.2), ("c", 0.9), ("d", None), ("e", 0.9)], "candidate string, s double")
    assert [r.candidate for r in df.orderBy(*metrics.best_first("s", "candidate")).collect()] == ["c", "e", "b", "a", "d"]


def test_splits(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    parts = {r.part: r["count"] for r in split.holdout(df, "k").groupBy("part").count().collect()}
    assert parts == {"train": 71, "val": 15, "test": 15}
    plan = split.kfold(df, "k", 4).cache()
    sizes = sorted(r["count"] for r in plan.where("part='pool'").groupBy("fold").count().collect())
    assert plan.count() == 101 and max(sizes) - min(sizes) <= 1
    again = split.repeated_kfold(df, "k", 4, 2)
    plain = {(r.row_id, r.fold) for r in plan.where("part='pool'").collect()}
    assert {(r.row_id, r.fold) for r in again.where("repeat=0").collect()} == plain != {(r.row_id, r.fold) for r in again.where("repeat=1").collect()}
    with pytest.raises(ValueError):
        split.holdout(df, "k", train=0.9, val=0.2)
    pool, test = split.prepare(df, "k", plan)
    assert pool.rows.count() + test.open().count() == 101
    with pytest.raises(RuntimeError):
        test.open()


def test_normalizer_and_ranges(spark):
    df = spark.createDataFrame([(i, float(i), 10.0 * i) for i in range(1, 5)], "id int, a double, b double")
    stats = scaling.literals(scaling.fit(df, ["a", "b"]))
    back = df.select(scaling.inverse(scaling.transform("a", stats), "a", stats).alias("a")).collect()
    assert all(abs(r.a - i) < 1e-9 for i, r in enumerate(back, 1)) and stats["b"]["high"] == 40
    probe = spark.createDataFrame([(0, 0.0, 10.0), (1, 9.0, 50.0)], "id int, a double, b double")
    assert sorted((r.row_id, r.feature) for r in scaling.out_of_range(probe, "id", ["a", "b"], stats).collect()) == [(0, "a"), (1, "a"), (1, "b")]
    assert scaling.range_report(probe, ["a", "b"], stats).first()["rows_out"] == 2


# ---- diagnostics and curves


def test_residual_structure(spark):
    df = spark.createDataFrame([(i, float(i), 1.0 if i % 2 else -1.0) for i in range(20)], "id long, x double, e double")
    assert diagnostics.sign_changes(df, "x", "id", "e").first().sign_change_rate == 1.0
    assert diagnostics.sign_changes(df.withColumn("e", F.lit(0.0)), "x", "id", "e").first().sign_change_rate == 0.0
    assert diagnostics.tail_ratio(df, "x", "id", "e").first().tail_ratio == 1.0


def test_interleaved_starts(spark):
    got = diagnostics.interleaved(spark.range(10).withColumnRenamed("id", "k"), "k", 3).orderBy("turn").collect()
    assert [r.row_id for r in got] == [0, 3, 6]
    order = diagnostics.interleaved_order(spark.range(10).withColumnRenamed("id", "k"), "k", 3).orderBy("offset", "bucket").collect()
    want = [i for offset in range(4) for b in range(3) if (i := b * 10 // 3 + offset) < (b + 1) * 10 // 3]
    assert [r.row_id for r in order] == want and sorted(want) == list(range(10))
    few = diagnostics.interleaved(spark.range(4).withColumnRenamed("id", "k"), "k", 300).orderBy("turn").collect()
    assert [(r.row_id, r.turn) for r in few] == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_a_base_without_a_neighbour_is_replaced(spark):
    rows = [(i, "alone" if i < 3 else "many", 0.0 if i < 3 else float(i)) for i in range(9)]
    got = diagnostics.nearest_rows(spark.createDataFrame(rows, "k long, c string, x double"), "k", "c", ["x"], 3).collect()
    assert sorted(r.base_id for r in got) == [3, 4, 6] and all(r.distance == 1.0 for r in got)


def test_nearest_rows_tie_by_nine_digits_and_nothing_is_sorted_by_pair(spark):
    # both neighbours are 0.3 away but for the last bit: the least id is taken
    df = spark.createDataFrame([(1, "a", 0.1 + 0.2), (2, "a", -0.3), (3, "a", 0.0)], "k long, c string, x double")
    near = diagnostics.nearest_rows(df, "k", "c", ["x"], 3)
    got = {r.base_id: (r.other_id, r.distance) for r in near.collect()}
    assert got[3] == (1, 0.3) and got[2] == (3, 0.3) and got[1][0] == 3
    assert "SortAggregate" not in near._jdf.queryExecution().executedPlan().toString()


def test_sensitivity_is_in_units_of_the_outputs(spark):
    pairs = spark.createDataFrame([(0.0, 1.0), (2.0, 4.0)], "a_x double, b_x double")
    got = diagnostics.sensitivity(pairs, ["x"], lambda v: [v[0] * 6, v[0] * 4], 1.0, [2.0, 1.0]).first()
    assert (got.pairs, got.mean_ratio, got.max_ratio) == (2, 5.0, 5.0)
    with pytest.raises(Exception, match="not finite"):
        diagnostics.sensitivity(pairs, ["x"], lambda v: F.log(v[0] - 5.0) + F.lit(float("nan"))).collect()


@pytest.mark.parametrize("points, delta, want", [
    ([.50, .51, .52, .53, .54], .015, (5, .54, None)),  # each second point is a gain over the last one that was
    ([.50, .505, .51, .90], .015, (3, .51, 3)),
    ([.5, .5, .5], .0, (1, .5, 3)),
    ([.2, .6, .6, .59], .0, (2, .6, 4)),
    ([.3], .0, (1, .3, None)),
])
def test_early_stopping_follows_the_last_accepted_point(spark, points, delta, want):
    df = spark.createDataFrame([("r", e, v) for e, v in enumerate(points, 1)], "run string, epoch int, r2 double")
    got = curves.early_stop(df, ["run"], 2, delta).first()
    assert (got.best_epoch, got.best_r2, got.stop_epoch) == want


def test_spark_line_takes_the_nearest_glyph(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.07, 0.08, 0.5, 0.92, 0.93, 1.0)], "v double")
    line = [r.g for r in df.select(curves.spark_line(F.col("v"), F.lit(0.0), F.lit(1.0)).alias("g")).collect()]
    assert line == [curves.GLYPHS[i] for i in (0, 0, 1, 4, 6, 7, 7)]
    assert df.select(curves.spark_line(F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("g")).first().g == "▁"


def test_a_constant_feature_is_many_tasks(spark):
    from tabularium.functions import ordering

    df = spark.range(5000).select(F.col("id").alias("k"), F.lit(1.0).alias("x"), (F.col("id") % 3).cast("double").alias("code"))
    for x in ("x", "code"):
        held = ordering.bucketed(df, x, tie="k").groupBy("_bucket").count()
        assert held.count() > 100 and held.agg(F.max("count")).first()[0] < 100
        got = ordering.with_rank(df, x, "k").orderBy(x, "k").collect()
        assert [r["rank"] for r in got] == list(range(1, 5001))
        pairs = ordering.with_previous(df, x, "k", "k").orderBy(x, "k").collect()
        assert [r.previous for r in pairs] == [None, *(r.k for r in pairs[:-1])]


@pytest.mark.parametrize("n", [1, 2, 20, 1001])
def test_nearest_rank_by_sorting(spark, n):
    r = np.random.default_rng(n)
    rows = [("g" if i % 3 else "h", float(v)) for i, v in enumerate(r.integers(0, 300, n))] + [("flat", 7.0)] * 50
    got = {x.g: x.importance for x in diagnostics.nearest_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in {g for g, _ in rows}:
        own = sorted(v for x, v in rows if x == g)
        assert got[g] == own[int(np.floor((len(own) - 1) * 0.95 + 0.5))]


@pytest.mark.parametrize("points, target, epoch", [([(1, .5), (2, .96), (5, .99)], .95, 2), ([(1, .5), (2, .82), (5, .83), (10, .835)], .99, 2), ([(1, .2), (2, .5)], .99, 2), ([(1, .50), (5, .82), (10, .83), (20, .96)], .99, 5)])
def test_recommended_epochs(spark, points, target, epoch):
    df = spark.createDataFrame([("r", e, v) for e, v in points], "run string, epoch int, r2 double")
    assert curves.recommended_epoch(df, ["run"], target).first().epoch == epoch


# ---- models


def basis_by_recursion(x, grid, degree=3):
    t = numeric.knots(grid)
    b = [1.0 if t[i] <= x < t[i + 1] else 0.0 for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        b = [(x - t[i]) / (t[i + d] - t[i]) * b[i] + (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * b[i + 1] for i in range(len(b) - 1)]
    return b


def test_spline_basis(spark):
    xs = [-2.9, -1.0, 0.0, 0.5, 2.99, 10.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", F.array(*numeric.bspline(F.col("x"), 8)).alias("b")).collect()
    for r in rows:
        assert np.allclose(r.b, basis_by_recursion(r.x, 8), atol=1e-9) and abs(sum(r.b) - (0 if r.x == 10 else 1)) < 1e-9


def test_compaction_keeps_predictions(spark):
    rng = np.random.default_rng(1)
    one = {"kind": "spline", "base": rng.normal(size=(2, 4)), "spline": rng.normal(size=(2, 4, 8)), "bias": rng.normal(size=4) / 5, "grid": 5}
    two = {"kind": "spline", "base": rng.normal(size=(4, 1)), "spline": rng.normal(size=(4, 1, 8)), "bias": [0.1], "grid": 5}
    one["base"][:, 1] = 0
    one["spline"][:, 1] = 0
    two["base"][2], two["spline"][2] = 0, 0
    small = models.compact([one, two])
    assert small[0]["base"].shape == (2, 2)
    df = spark.createDataFrame([(i, *rng.uniform(-1, 1, 2).tolist()) for i in range(12)], "id int, a double, b double")
    x, y = (sorted(map(tuple, models.score(df, ["a", "b"], net, ["id"]).collect())) for net in ([one, two], small))
    assert np.allclose([r[1] for r in x], [r[1] for r in y], atol=1e-9)


def test_spline_search_finds_a_curve(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(np.sin(2 * a)), i % 4) for i, a in enumerate(rng.uniform(-2.5, 2.5, 400))], "a double, y double, fold int")
    rows = models.search(df, ["a"], "y", "fold", [8], [1e-9])
    assert len(rows) == 4 and min(r["r2"] for r in rows) > 0.999


@pytest.mark.parametrize("f, name", [(lambda x: 2 * np.sin(1.5 * x - 0.5) + 0.3, "sin"), (lambda x: 1.7 * np.log(x + 3) - 0.4, "log")])
def test_symbolic_fits(spark, f, name):
    xs = np.linspace(-2, 2, 60)
    got = symbolic.fit_edges(spark.createDataFrame([("e", float(x), float(f(x))) for x in xs], "edge string, x double, y double"), ["edge"], 2).first()
    assert got.r2 > 0.999
    edge = symbolic.Edge("x", got.name, got.a, got.b, got.c, got.d)
    out = spark.createDataFrame([(float(x),) for x in xs], "x double").select(symbolic.formula_column([edge], 0.0).alias("y")).collect()
    assert max(abs(r.y - f(x)) for r, x in zip(out, xs)) < 0.12


def test_symbolic_query_runs_all_rounds(spark, sf_dir):
    """Settings of b after all rounds lie on the last round's steps around the best of the round before."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    samples = line.groupBy("l_returnflag", "l_quantity").agg((F.avg("l_extendedprice") / 10000.0).alias("y")).select(F.col("l_returnflag").alias("edge"), ((F.col("l_quantity") - 25.0) / 15.0).alias("x"), "y")
    want = {r.edge: r for r in symbolic.fit_edges(samples, ["edge"], symbolic.ZOOMS).collect()}
    got = {r.edge: r for r in catalogue.QUERIES["symbolic_fit"](spark, sf_dir).collect()}
    assert set(got) == set(want)
    for edge, r in got.items():
        assert r.name == want[edge].name and np.allclose([r.a, r.b, r.c, r.d, r.r2], [round(want[edge][k], 4) for k in ("a", "b", "c", "d", "r2")], atol=1e-4)
    weak = catalogue.QUERIES["weak_best_edges"](spark, sf_dir).first()
    assert weak.weak == sum(r.r2 < 0.99 for r in want.values()) and abs(weak.worst - min(r.r2 for r in want.values())) < 1e-4


def test_settings_outside_of_a_domain_are_no_fits(spark):
    """log(b x + c) can't be fitted where a sample lies outside of its domain; what is left must fit all samples."""
    xs = [-2.0, -1.0, 0.0, 1.0, 2.0]
    samples = spark.createDataFrame([("e", x, x * x) for x in xs], "edge string, x double, y double")
    fits = symbolic.fit_round(samples, symbolic.grid(spark), ["edge"]).collect()
    inside = {"log": lambda u: u > 1e-4, "sqrt": lambda u: u >= 0, "1/x": lambda u: abs(u) > 1e-3, "exp": lambda u: u < 15}
    assert all(inside[f.name](f.b * x + f.c) for f in fits if f.name in inside for x in xs)
    assert {f.name for f in fits} >= {"log", "sqrt", "1/x"} and all(f.b != 0 for f in fits)


def test_edges_that_are_constant(spark):
    rows = [("flat", float(x), 4.0) for x in range(5)] + [("line", float(x), 2.0 * x + 1) for x in range(5)]
    got = {r.edge: r for r in symbolic.fit_edges(spark.createDataFrame(rows, "edge string, x double, y double"), ["edge"]).collect()}
    assert tuple(got["flat"])[1:] == ("const", 0.0, 0.0, 0.0, 4.0, 1.0) and got["line"].name == "x"
    out = spark.range(1).select(symbolic.formula_column([symbolic.Edge("id", "const", 0.0, 0.0, 0.0, 4.0)], 1.0).alias("y"))
    assert out.first().y == 5.0


def test_weak_edges_are_judged_by_their_best_primitive(spark):
    """An exponential is no edge of sin, tanh or x^2, but of one of the nine; noise is of none."""
    xs, r = np.linspace(-2, 2, 40), np.random.default_rng(3)
    rows = [("e", float(x), float(np.exp(1.5 * x))) for x in xs] + [("n", float(x), float(y)) for x, y in zip(xs, r.normal(size=40))]
    best = symbolic.fit_edges(spark.createDataFrame(rows, "edge string, x double, y double"), ["edge"])
    got = symbolic.edge_quality(best).first()
    assert got.weak == 1 and got.worst < 0.9 and {x.edge: x.name for x in best.collect()}["e"] == "exp"
    assert symbolic.edge_quality(best.limit(0)).first() == (1.0, 1.0, 0)


def test_formula_text():
    text = symbolic.formula_text([symbolic.Edge("h1_0", "x", 2.0, 3.0, 1.0, 0.5), symbolic.Edge("2temperature", "sin", 1.0, 1.0, 0.0, 0.25)], 1.0)
    assert text == "6*`h1_0` + 1*sin(1*`2temperature` + 0) + 3.75"
    e = symbolic.denormalized(symbolic.Edge("x", "sin", 1.0, 2.0, 0.5, 0.0), 10.0, 4.0)
    assert (e.b, e.c) == (0.5, -4.5)


# ---- delivery


def test_export_binds_by_name(spark):
    df = spark.createDataFrame([(1.0, 5.0)], "`x ` double, y double")
    out = scoring.bind(df, ["x"])
    assert out == {"x": "x "}
    with pytest.raises(ValueError):
        scoring.bind(df, ["w"])


def test_ledger():
    led = provenance.Ledger("A")
    with pytest.raises(provenance.Refused, match="NotChecked"):
        led.finalize({"k": 1})
    led.record_check({"k": 1})
    with pytest.raises(provenance.Refused, match="Stale"):
        led.finalize({"k": 2})
    led.finalize({"k": 1})
    with pytest.raises(provenance.Refused, match="AlreadyFinalized"):
        led.finalize({"k": 1})
    with pytest.raises(provenance.Refused, match="TestDisclosed"):
        led.finalize({"k": 3})
    led.change_dataset("B")
    led.record_check({"k": 3})
    led.finalize({"k": 3})
    led.change_dataset("A")
    led.record_check({"k": 3})
    with pytest.raises(provenance.Refused, match="TestDisclosed"):
        led.finalize({"k": 3})


def test_fingerprint_sees_values_and_order(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(3000)], "id long, v double")
    one = provenance.fingerprint(df, "id", ["v"]).first()
    assert one == provenance.fingerprint(df.orderBy(F.rand(1)).withColumnRenamed("v", "w"), "id", ["w"]).first()
    assert one.digest != provenance.fingerprint(df.withColumn("v", F.when(F.col("id") == 7, -1.0).otherwise(F.col("v"))), "id", ["v"]).first().digest


def test_fingerprint_tells_numbers_kinds_and_noughts_apart(spark):
    def of(values, **kinds):
        return provenance.fingerprint(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double"), "id", ["v"], **kinds).first().digest

    assert of([1.0, 2.0]) != of([1.0000001, 2.0]) and of([0.0]) != of([1e-9]) and of([0.0]) == of([-0.0]) and of([float("nan")]) == of([-float("nan")])
    assert of([1.0, 2.0]) != of([2.0, 1.0]) and of([1.0]) != of([1.0], levels={"v": 3}) != of([1.0], levels={"v": 4})
    both = spark.createDataFrame([(0, 1.0, 2.0)], "id long, a double, b double")
    assert provenance.fingerprint(both, "id", ["a", "b"]).first() != provenance.fingerprint(both, "id", ["a"], ["b"]).first()
    assert of([])


def test_stream_scores_as_batch(spark, sf_dir, tmp_path):
    stats = {"value": {"low": -1e9, "high": 1e9}}
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = scorer.score_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp")), F.col("value") * 2, ["value"], stats)
    run = scorer.windowed_errors(stream, "ts", "value").writeStream.format("memory").queryName("errors").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert spark.sql("select sum(n) from errors").first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


# ---- searches


def test_grid_and_cost(spark):
    rows = search.candidates(spark, {"a": [1, 2], "b": [3, 4, 5]}).orderBy("candidate").collect()
    assert [tuple(r) for r in rows] == [(3 * i + j, float(a), float(b)) for i, a in enumerate([1, 2]) for j, b in enumerate([3, 4, 5])]
    with pytest.raises(ValueError):
        search.candidates(spark, {"a": []})
    one = search.Cost(6, 2, 5, 1, 40)
    assert (one.runs, one.epochs) == (60, 2400) and search.Cost(6, 2, 5, 3, 40).epochs == 7200
    assert search.Cost(1 << 40, 1 << 40, 2, 2, 9).epochs == (1 << 63) - 1


def test_generated_tables_repeat(spark):
    a, b = (generators.generate(spark, "projectile", 50, 3).repartition(n).orderBy("row_id").collect() for n in (1, 7))
    assert a == b and all(1 <= r.x0 <= 10 and abs(r.y - r.x0**2 * np.sin(2 * r.x1) / 9.81) < 1e-9 for r in a)
    assert generators.generate(spark, "sum", 5, 1).collect() != generators.generate(spark, "sum", 5, 2).collect()
    sine = generators.generate(spark, "sine", 200, 1).collect()
    assert all(-np.pi <= r.x0 <= np.pi and abs(r.y0 - np.sin(r.x0)) < 1e-12 and abs(r.y1 - np.cos(r.x0)) < 1e-12 for r in sine) and max(r.x0 for r in sine) > 3
    assert all(abs(r.y - (0.5 * r.x0**2 - r.x0 + 1)) < 1e-12 for r in generators.generate(spark, "polynomial", 50).collect())


def test_network_grids_have_their_sizes():
    assert [len(search.network_configs(b)) for b in ("quick", "balanced", "thorough")] == [6, 24, 54]
    assert [len(search.NETWORKS[b]["seeds"]) for b in ("quick", "balanced", "thorough")] == [1, 1, 2]
