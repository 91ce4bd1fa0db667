"""Schemas, drafts, typed files and the one way into a table: cases of small exact files."""

import pytest
from pyspark.sql import functions as F

from tabularium.operators import curves, metrics, profile, schema, split
from tabularium.operators.schema import IGNORE, INPUT, OUTPUT, Field, Schema
from tabularium.sources import open_table, text_table


def write(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def rows_of(df):
    return [tuple(r) for r in df.orderBy("row_id").drop("row_id").collect()]


# ---- lines


def test_line_numbers_over_many_splits(spark, tmp_path):
    text = "".join(f"{i},{'x' * (i % 37)}\r\n" if i % 3 else f"{i},\n" for i in range(1, 4001))
    path = write(tmp_path, text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = text_table.numbered_lines(spark, path).orderBy("row_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.row_no, r.value) for r in got] == [(i, f"{i},{'x' * (i % 37) if i % 3 else ''}") for i in range(1, 4001)]


# ---- headers, schemas


@pytest.mark.parametrize("cells, want", [(["1", "2.5"], False), (["a", "1"], True), (["1", ""], True), (["1e39", "2"], True), (["-.5", "3."], False), (["nan"], True)])
def test_a_header_has_a_cell_that_is_no_number(cells, want):
    assert open_table.has_header(cells) == want


def test_a_numeric_table_is_read_by_its_header(spark, tmp_path):
    path = write(tmp_path, "x0,x1,x2,material_id,y0,y1\n0.5,-0.2,1.0,2,3.0,4.0\n1.5,0.3,2.0,0,5.0,6.0\n")
    df, s = open_table.read_numeric(spark, path)
    assert (len(s.inputs), len(s.outputs), [f.spec for f in s.inputs]) == (4, 2, ["C", "C", "C", "K:3"])
    assert rows_of(df) == [(0.5, -0.2, 1.0, 2, 3.0, 4.0), (1.5, 0.3, 2.0, 0, 5.0, 6.0)]


@pytest.mark.parametrize("text", ["1,2\n3,4\n", "y0,x0\n1,2\n", "a,b\n1,2\n"])
def test_tables_that_do_not_tell_inputs_from_outputs(spark, tmp_path, text):
    with pytest.raises(ValueError):
        open_table.read_numeric(spark, write(tmp_path, text))


def test_columns_that_are_left_out(spark, tmp_path):
    table = text_table.read_table(spark, write(tmp_path, "temp,note,mat,moisture\n80,ok,clay,12.5\n60,-,sand,18\n"))
    s = Schema((Field("temp"), Field("note", IGNORE), Field("mat", INPUT, ("sand", "clay")), Field("moisture", OUTPUT)))
    assert rows_of(open_table.dataset(table, s)) == [(80.0, 1, 12.5), (60.0, 0, 18.0)]
    with pytest.raises(ValueError, match="row 2, column mat.*'clay'.*levels sand, loam"):
        open_table.dataset(table, Schema((Field("temp"), Field("note", IGNORE), Field("mat", INPUT, ("sand", "loam")), Field("moisture", OUTPUT))))


def test_codes_only_where_they_are_allowed(spark, tmp_path):
    table = text_table.read_table(spark, write(tmp_path, "m,y\n1.0,3\n"))
    s = Schema((Field("m", INPUT, ("0", "1", "2")), Field("y", OUTPUT)))
    assert rows_of(open_table.dataset(table, s, ("m",))) == [(1, 3.0)]
    with pytest.raises(ValueError, match="column m"):
        open_table.dataset(table, s)
    for bad in ("0.5", "7"):
        with pytest.raises(ValueError, match="column m"):
            open_table.dataset(text_table.read_table(spark, write(tmp_path, f"m,y\n{bad},3\n", f"{bad}.csv")), s, ("m",))


@pytest.mark.parametrize("text, row, column", [("a,b,c\n1,,3\n", 2, "b"), ("a,b,c\n# note\n1,2,3\n\n1,word,3\n", 5, "b")])
def test_cells_without_a_value_are_named(spark, tmp_path, text, row, column):
    table = text_table.read_table(spark, write(tmp_path, text))
    with pytest.raises(ValueError, match=f"row {row}, column {column}"):
        open_table.dataset(table, open_table.spec_schema(table, 2, 1))


@pytest.mark.parametrize("fields", [
    [Field("a"), Field("a", OUTPUT)], [Field("a")], [Field("a", OUTPUT)], [Field("a"), Field("b", OUTPUT, ("u", "v"))],
])
def test_schemas_that_are_refused(fields):
    with pytest.raises(ValueError):
        Schema(tuple(fields))


@pytest.mark.parametrize("values", [("", INPUT), ("a", "other"), ("a", INPUT, ()), ("a", INPUT, ("u", " ")), ("a", INPUT, ("u", "u "))])
def test_fields_that_are_refused(values):
    with pytest.raises(ValueError):
        Field(*values)


def test_units_are_labels(spark):
    a = Schema((Field("t", INPUT, None, "C"), Field("m", INPUT, ("u", "v")), Field("y", OUTPUT)))
    assert a.inputs[0].display_name == "t [C]" and a.incompatible(Schema((Field("t"), *a.fields[1:]))) is None
    assert "levels" in a.incompatible(Schema((a.fields[0], Field("m", INPUT, ("v", "u")), a.fields[2])))
    assert "number" in a.incompatible(Schema((a.fields[0], Field("m"), a.fields[2])))
    assert "input 1" in a.incompatible(Schema((Field("s"), *a.fields[1:]))) and "inputs" in a.incompatible(Schema(a.fields[1:]))
    with pytest.raises(ValueError):
        a.check_dims(3, 1)
    a.check_dims(2, 1)
    assert [f.spec for f in schema.numbered(3, 1, {1: 4}).inputs] == ["C", "K:4", "C"] and a.places(INPUT) == [0, 1]


def test_categories_by_place():
    assert schema.parse_cards("2:3, 0:12", 3) == {2: 3, 0: 12} and schema.parse_cards("", 3) == {}
    for bad in ("3:2", "0:0", "a:2", "1", "0:2,0:3"):
        with pytest.raises(ValueError):
            schema.parse_cards(bad, 3)


# ---- drafts


def test_drafts(spark):
    df = spark.createDataFrame([("1", "clay", "5"), ("10", "sand", "6"), ("9", "clay", "7")], "a string, m string, y string")
    d = schema.draft(df, ["a", "m", "y"])
    assert [(f.role, f.is_category) for f in d.fields] == [(INPUT, False), (INPUT, True), (OUTPUT, False)] and d.issues() == []
    s = d.changed(0, is_category=True, unit="mm").finish()
    assert s.fields[0].levels == ("1", "9", "10") and s.fields[1].levels == ("clay", "sand") and s.fields[0].unit == "mm"
    assert d.changed(1, is_category=False).issues() == ["m: not all values are numbers"]
    assert d.changed(1, is_category=False, role=IGNORE).issues() == []
    assert "an output is needed" in d.changed(2, role=INPUT).issues() and "column a is there twice" in d.changed(2, name=" a ").issues()
    assert "y: an output is a number" in d.changed(2, is_category=True).issues() and "column 1 needs a name" in d.changed(0, name=" ").issues()
    assert [f.role for f in d.output_from(1).fields] == [INPUT, OUTPUT, OUTPUT]
    for bad in (0, 3):
        with pytest.raises(ValueError):
            d.output_from(bad)
    with pytest.raises(ValueError):
        d.changed(7, name="x")
    with pytest.raises(ValueError, match="not all values are numbers"):
        d.changed(1, is_category=False).finish()


def test_a_draft_with_too_many_levels(spark):
    df = spark.range(257).selectExpr("cast(id as string) as x", "concat('n', id) as label", "cast(id as string) as y")
    d = schema.draft(df, ["x", "label", "y"])
    assert d.levels[1] is None and d.fields[1].is_category and d.issues() == ["label: more than 256 values"]
    with pytest.raises(ValueError):
        d.changed(0, is_category=True)
    assert d.changed(1, role=IGNORE).finish().fields[1].levels is None


def test_messages_in_order_of_weight(spark, tmp_path):
    t = text_table.read_table(spark, write(tmp_path, "a,b\n1,2\n3\n1,2\n"))
    df = t.rows.select(F.get("cells", F.lit(0)).alias("a"), F.get("cells", F.lit(1)).alias("b"))
    ragged = text_table.ragged_rows(t).agg(F.count(F.lit(1)).alias("n_ragged"))
    got = schema.messages(profile.profile_columns(df, ["a", "b"]), ragged, profile.duplicate_rows(df, ["a", "b"])).collect()
    assert {(r.severity, r.column, r.message) for r in got} == {("Blocking", None, "1 rows of another width"), ("Warning", "b", "1 missing cells"), ("Note", None, "1 repeated rows")}


# ---- typed files


def test_header_words():
    assert open_table.words_of('names "a b" "c#d" "e\\"\\\\f\\n" plain # rest "x"') == ["names", "a b", "c#d", 'e"\\f\n', "plain"]
    for word in ("a b", 'q"\\', "line\nfeed\ttab\r", "", "ü#"):
        assert open_table.words_of("k " + open_table.quote(word)) == ["k", word]
    for bad in ('names "open', 'names "\\x"'):
        with pytest.raises(ValueError):
            open_table.words_of(bad)


def test_numbers_without_exponents(spark):
    values = [2.0, 0.5, -0.2, 1e10, 1e-7, 16777216.0, 0.1, -0.0, 3.4e38, 1.17e-10]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(open_table.plain_number(F.col("v")).alias("v")).collect()]
    assert got[:7] == ["2", "0.5", "-0.2", "10000000000", "0.0000001", "16777216", "0.1"]
    assert all("E" not in g and "e" not in g for g in got) and abs(float(got[8]) / 3.4e38 - 1) < 1e-6


def test_a_table_becomes_a_typed_file(spark, tmp_path):
    path = write(tmp_path, "x0,x1,mat,y\n0.5,-0.2,1,2.0\n# c\n1.5,0.3,2,3.0\n")
    out = str(tmp_path / "out.tnum")
    assert open_table.table_to_typed(spark, path, out, 3, 1, {2: 3}) == 2
    text = [r.value for r in spark.read.text(out).collect()]
    assert "specs C C K:3" in text and "0.5 -0.2 1 2" in text and 'levels 2 "0" "1" "2"' in text and "rows 2" in text
    df, s = open_table.read_numeric(spark, out)
    assert [f.name for f in s.fields] == ["x0", "x1", "mat", "y"] and rows_of(df) == [(0.5, -0.2, 1.0, 2.0), (1.5, 0.3, 2.0, 3.0)]
    with pytest.raises(ValueError, match="overwritten"):
        open_table.table_to_typed(spark, path, path, 3, 1)


def test_names_units_and_levels_come_back(spark, tmp_path):
    s = Schema((Field('t "in"', INPUT, None, "° C"), Field("m #1", INPUT, ("fine sand", "clay\n2")), Field("y", OUTPUT)))
    df = spark.createDataFrame([(i, i / 4, i % 2, -float(i)) for i in range(300)], 'row long, `t "in"` double, `m #1` int, y double')
    out = str(tmp_path / "named")
    assert open_table.write_typed(df.repartition(7), "row", s, out) == 300
    back, t = open_table.read_typed(spark, out)
    assert t == s and rows_of(back) == [(i / 4, float(i % 2), -float(i)) for i in range(300)]
    for bad in (float("nan"), 1e39):
        with pytest.raises(ValueError):
            open_table.write_typed(df.withColumn("y", F.lit(bad)), "row", s, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        open_table.write_typed(df.withColumn("m #1", F.lit(2)), "row", s, str(tmp_path / "bad"))


@pytest.mark.parametrize("text", [
    "TRNUM1\ninputs 1\noutputs 1\nspecs C\nrows 2\ndata\n1 2\n", "TRNUM1\ninputs 1\noutputs 1\nspecs C C\nrows 1\ndata\n1 2\n",
    "TRNUM1\ninputs 1\noutputs 1\nspecs K:2\nrows 1\ndata\n2 2\n", "TRNUM1\ninputs 1\noutputs 1\nspecs C\nrows 1\ndata\n1 nan\n",
    "inputs 1\noutputs 1\nspecs C\nrows 1\ndata\n1 2\n", "TRNUM1\ninputs 1\ninputs 1\noutputs 1\nspecs C\nrows 1\ndata\n1 2\n",
    "TRNUM1\ninputs 1\noutputs 1\nspecs C\nrows 1\nword\ndata\n1 2\n", 'TRNUM2\ninputs 1\noutputs 1\nspecs K:2\nlevels 0 "a"\nrows 1\ndata\n1 2\n',
])
def test_typed_files_that_are_refused(spark, tmp_path, text):
    with pytest.raises(ValueError):
        open_table.read_typed(spark, write(tmp_path, text, "t.tnum"))


# ---- plans


def runs(spark, rows):
    return spark.createDataFrame([("c", *r) for r in rows], "k string, seed int, repeat int, fold int, r2 double")


def test_runs_of_a_whole_plan(spark):
    r = metrics.aggregate_runs(runs(spark, [(0, 0, 0, .8), (0, 0, 1, 1.0), (1, 0, 0, .6), (1, 0, 1, .8)]), ["k"], [0, 1], 2).first()
    assert abs(r.r2_mean - .8) < 1e-12 and abs(r.r2_std_seeds - .1) < 1e-12 and abs(r.r2_std_folds - .1) < 1e-12
    assert metrics.aggregate_runs(runs(spark, [(0, None, None, .7)]), ["k"], [0]).first().r2_mean == .7


@pytest.mark.parametrize("rows, seeds, k, repeats, match", [
    ([(0, 0, 0, .8)], [0], 2, 1, "folds are missing"), ([(0, 0, 0, .8), (0, 0, 0, .7)], [0], 2, 1, "twice"), ([(0, 0, 0, .8), (0, 0, 1, .7), (5, 0, 0, .1)], [0], 2, 1, "not listed"),
    ([(0, 0, 0, .8), (0, 0, 1, .7)], [0, 1], 2, 1, "no runs"), ([(0, 0, 1, .8), (0, 0, 2, .7)], [0], 2, 1, "not of the plan"), ([(0, 0, 0, .8), (0, 0, 1, .7)], [0], 2, 2, "no runs"),
    ([(0, 0, 0, .8), (0, 0, 1, .7), (0, 3, 0, .7), (0, 3, 1, .7)], [0], 2, 1, "repeat is not"), ([(0, 0, 0, .8)], [0, 0], 1, 1, "once"), ([(0, 0, 0, .8)], [0], 1, 2, "no plan"),
])
def test_runs_that_are_refused(spark, rows, seeds, k, repeats, match):
    with pytest.raises(ValueError, match=match):
        metrics.aggregate_runs(runs(spark, rows), ["k"], seeds, k, repeats)


def test_plans_need_rows():
    assert split.check_holdout(100) == (70, 15, 15) and split.check_kfold(100) == (15, 85)
    for bad in (lambda: split.check_holdout(2), lambda: split.check_kfold(4, 5), lambda: split.check_kfold(100, 1), lambda: split.check_fractions(float("nan")), lambda: split.check_kfold(3, 2, 0.1)):
        with pytest.raises(ValueError):
            bad()


def test_schedules_and_labels(spark):
    assert [split.label(), split.label(5), split.label(5, 3), split.label(is_test=True)] == ["validation", "cv-5", "cv-5x3", "test"]
    epochs = spark.range(1, 13).withColumnRenamed("id", "e")
    for schedule, want in ((curves.Schedule(), []), (curves.Schedule(5), [5, 10]), (curves.Schedule(at=(2, 12)), [2, 12])):
        schedule.check(12)
        assert [r.e for r in epochs.where(schedule.wants(F.col("e"))).orderBy("e").collect()] == want
    for bad in (curves.Schedule(0), curves.Schedule(13), curves.Schedule(at=()), curves.Schedule(at=(0,)), curves.Schedule(at=(3, 3)), curves.Schedule(at=(13,))):
        with pytest.raises(ValueError):
            bad.check(12)


def test_scales_previews_and_warnings(spark, tmp_path):
    assert sorted(map(tuple, metrics.scales(spark, {"a": 1.5, "b": None}).collect())) == [("a", 1.5), ("b", None)]
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            metrics.scales(spark, {"a": bad})
    t = text_table.read_table(spark, write(tmp_path, "a,b\n" + "".join(f"{i}\n" if i % 4 == 3 else f"{i},2\n" for i in range(40))))
    assert [r.cells[0] for r in text_table.preview(t).collect()] == [str(i) for i in range(20)] and text_table.ragged_examples(t) == [5, 9, 13, 17, 21]
    s = schema.numbered(2, 1, {1: 3})
    assert "x1" in schema.code_warning("kan", s) and schema.code_warning("attention", s) is None and schema.code_warning("kan", schema.numbered(2, 1, {1: 2})) is None


def test_edges_add_up_to_the_network(spark):
    import numpy as np

    from tabularium.operators import models

    r = np.random.default_rng(4)
    layer = {"kind": "spline", "base": r.normal(size=(2, 2)), "spline": r.normal(size=(2, 2, 8)), "bias": np.array([0.5, -1.0]), "grid": 5}
    df = spark.createDataFrame([(i, *r.uniform(-2, 2, 2).tolist()) for i in range(20)], "id int, a double, b double")
    sums = {(x.id, x.output): x.v for x in models.edge_values(df, ["a", "b"], layer, ["id"]).groupBy("id", "output").agg(F.sum("value").alias("v")).collect()}
    one, two = models.activations(df, ["a", "b"], [layer], ["id"])
    assert one.columns == ["id", "a0", "a1"]
    for x in two.collect():
        assert abs(sums[x.id, 0] + 0.5 - x.a0) < 1e-9 and abs(sums[x.id, 1] - 1.0 - x.a1) < 1e-9
    values = models.edge_values(df, ["a", "b"], layer, ["id"]).groupBy("input", "output").agg(F.avg(F.abs("value")).alias("m")).agg(F.sum("m")).first()[0]
    assert abs(models.edge_l1(df, ["a", "b"], layer).first().l1 - values) < 1e-9


def test_columns_of_names_that_are_used(spark):
    from tabularium.functions import ordering

    df = spark.range(3).withColumn("rank", F.lit(1))
    with pytest.raises(ValueError, match="rank"):
        ordering.with_rank(df, "id", "id")
    assert ordering.with_rank(df, "id", "id", "place").count() == 3


def test_characters(spark):
    from tabularium.operators import characters

    df = spark.createDataFrame([(1, "abca"), (2, ""), (3, None), (4, "é b")], "id int, text string")
    known = characters.vocabulary(df, "text")
    ids = {r.ch: r.id for r in known.collect()}
    assert ids == {c: i for i, c in enumerate(sorted("abc é", key=lambda c: c.encode()))}
    codes = characters.encode(df, "id", "text", known)
    got = {r.row_id: r.codes for r in codes.collect()}
    assert got == {1: [ids[c] for c in "abca"], 2: [], 3: [], 4: [ids[c] for c in "é b"]}
    assert {r.row_id: r.text for r in characters.decode(codes, "codes", known, ["row_id"]).collect()} == {1: "abca", 2: "", 3: "", 4: "é b"}
    assert characters.encode(df.where("id = 1"), "id", "text", known.where("ch <> 'b'")).first().codes == [ids["a"], None, ids["c"], ids["a"]]
    assert sorted(map(tuple, characters.windows(df, "text", 2).collect())) == [("ab", "c"), ("bc", "a"), ("é ", "b")]
    with pytest.raises(ValueError):
        characters.windows(df, "text", 0)


def test_rows_picked_twice_and_small_samples(spark):
    from tabularium.operators import diagnostics

    df = spark.createDataFrame([(i, i * 10) for i in range(5)], "k int, v int")
    picked = spark.createDataFrame([(3, 0), (1, 1), (3, 2)], "row_id int, turn int")
    assert [r.v for r in diagnostics.gather(df, "k", picked).orderBy("turn").collect()] == [30, 10, 30]
    assert diagnostics.calibration_sample(df, "k", 8).count() == 5
    many = spark.range(1000)
    assert [r.row_id for r in diagnostics.calibration_sample(many, "id", 7).orderBy("row_id").collect()] == [int(i * 1000 / 7) for i in range(7)]


def styled(cells, formats, custom=""):
    """A book of one sheet with number formats: cells are (reference, style, value)."""
    import io
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="r0"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r0" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts>{custom}</numFmts><cellXfs>' + "".join(f'<xf numFmtId="{n}"/>' for n in formats) + "</cellXfs></styleSheet>")
        body = "".join(f'<row r="{i + 1}"><c r="{r}" s="{s}"><v>{v}</v></c></row>' for i, (r, s, v) in enumerate(cells))
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_dates_of_workbooks_are_refused(spark, tmp_path):
    from tabularium.sources import workbook

    custom = '<numFmt numFmtId="164" formatCode="yyyy-mm-dd"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/>'
    good = styled([("A1", 0, "1"), ("B2", 2, "2.5"), ("A3", 0, "3")], [0, 14, 165], custom)
    (tmp_path / "good.xlsx").write_bytes(good)
    t = workbook.read_workbook(spark, str(tmp_path / "good.xlsx"), has_header=False)
    assert [tuple(r) for r in t.rows.orderBy("row_no").collect()] == [(1, ["1", ""]), (2, ["", "2.5"]), (3, ["3", ""])] and t.n_columns == 2
    for formats in ([14], [164], [22]):
        with pytest.raises(ValueError, match="A1"):
            list(workbook.sheet_rows(styled([("A1", 0, "45000")], formats, custom), "xl/worksheets/s.xml"))


def test_fingerprints_of_networks():
    from tabularium.operators import provenance

    layer = {"kind": "dense", "weights": [[0.5, 0.0]], "bias": [0.1, 0.2], "activate": True}
    one = provenance.model_fingerprint([layer])
    assert one == provenance.model_fingerprint([{**layer, "weights": [[0.5, -0.0]]}])
    for other in ({"weights": [[0.5, 1e-9]]}, {"activate": False}, {"bias": [0.2, 0.1]}, {"weights": [[0.5], [0.0]]}):
        assert one != provenance.model_fingerprint([{**layer, **other}])


def test_steps_that_are_refused(spark):
    from tabularium.operators import diagnostics

    pairs = spark.createDataFrame([(0.0, 1.0)], "a_x double, b_x double")
    for alpha, sigmas in ((0.0, None), (1.5, None), (float("nan"), None), (1.0, [0.0])):
        with pytest.raises(ValueError):
            diagnostics.sensitivity(pairs, ["x"], lambda v: v[0], alpha, sigmas)
    got = diagnostics.sensitivity_report(pairs, ["x"], lambda v: v[0] * 3, lambda v: v[0]).first()
    assert (got.mean_ratio, got.reference_mean, got.divergence) == (3.0, 1.0, 2.0)


def test_character_transitions_are_counted_windows(spark):
    import random

    from tabularium.operators import characters

    draw = random.Random(3)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    texts = [None, "", "a", "abca", "é b\U0001f600\U0001f600\U0010ffff", "ab\x00c\n", "ab€" * 800_000, *("".join(draw.choices(letters, k=400)) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    for context in (1, 2, 7):
        got = characters.transitions(df, "text", context)
        assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
        want = characters.windows(df, "text", context).groupBy("context", "following").count()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        characters.transitions(df, "text", 0)


def test_the_query_of_transitions_has_no_row_for_each_character(spark, sf_dir):
    from tabularium.plans import catalogue

    assert "Generate" not in catalogue.QUERIES["char_transitions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_lines_are_numbered_once_and_numbers_stay_plain_text(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate([0.0, -2.0, 0.5, 1e10, -1.5e-7, 123456.0])), "k long, x double").withColumn("y0", -F.col("x"))
    out = str(tmp_path / "typed")
    assert open_table.write_typed(df, "k", Schema((Field("x", INPUT), Field("y0", "output"))), out) == 6
    assert "Aggregate" not in text_table.numbered_lines(spark, out)._jdf.queryExecution().executedPlan().toString()
    lines = [r.value for r in text_table.numbered_lines(spark, out).orderBy("row_no").collect()]
    assert lines[-5:] == ["-2 2", "0.5 -0.5", "10000000000 -10000000000", "-0.00000015 0.00000015", "123456 -123456"]
    assert [r.x for r in open_table.read_typed(spark, out)[0].orderBy("row_id").collect()][1:4] == [-2.0, 0.5, 1e10]
