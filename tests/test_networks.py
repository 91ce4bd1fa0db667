"""Networks read as formulas, searches and refits from kept sums, hash trees, the shared ledger, cell errors, token streams."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.operators import cells, interpret, models, network_symbolic, provenance, spline_search
from tabularium.operators.network_symbolic import Fit, Formulas
from tabularium.operators.schema import INPUT, OUTPUT, Field
from tabularium.sources import open_table

RNG = np.random.default_rng(3)


def layer(n_in, n_out, grid=5, scale=0.3):
    return {"kind": "spline", "base": RNG.normal(0, scale, (n_in, n_out)), "spline": RNG.normal(0, scale, (n_in, n_out, grid + 3)), "bias": RNG.normal(0, 0.1, n_out).tolist(), "grid": grid}


def table(spark, n=300):
    x = RNG.uniform(-2, 2, (n, 2))
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double")


# ---- formulas


def test_all_active_edges_are_sampled(spark):
    net = [layer(2, 3), layer(3, 1)]
    net[0]["base"][1, 2], net[0]["spline"][1, 2] = 0, 0
    df = table(spark)
    rows = network_symbolic.edge_samples(df, ["a", "b"], net, "row_id").collect()
    assert len(rows) == 256 * 8 and (0, 1, 2) not in {(r.layer, r.input, r.output) for r in rows}
    # edges add up to the network: hidden nodes are sums of the first layer's edges and the biases
    total = {}
    for r in rows:
        total[(r.layer, r.output)] = total.get((r.layer, r.output), 0) + r.y
    arrives = {}
    for r in rows:
        if r.layer == 1:
            arrives[r.input] = arrives.get(r.input, 0) + r.x
    for j in range(3):
        assert abs(total[(0, j)] + 256 * net[0]["bias"][j] - arrives[j]) < 1e-6
    assert network_symbolic.edge_samples(df.where("row_id < 10"), ["a", "b"], net, "row_id").count() == 80
    dead = [{**net[1], "base": np.zeros((3, 1)), "spline": np.zeros((3, 1, 8))}]
    assert network_symbolic.edge_samples(df.select("row_id", "a", "b", F.lit(0.0).alias("c")), ["a", "b", "c"], dead, "row_id").count() == 0


def test_formulas_stand_for_their_network(spark):
    knots = np.linspace(-3, 3, 200)
    basis = np.stack([models._basis(x, 8) for x in knots])
    curve = lambda f: np.linalg.lstsq(basis, f(knots), rcond=None)[0]
    net = [{"kind": "spline", "base": np.zeros((2, 2)), "spline": np.stack([np.stack([curve(np.sin), curve(lambda x: 0.3 * x * x)]), np.stack([curve(lambda x: 0.5 * x), np.zeros(11)])]), "bias": [0.1, -0.4], "grid": 8},
           {"kind": "spline", "base": np.zeros((2, 1)), "spline": np.stack([[curve(np.tanh)], [curve(lambda x: x)]]), "bias": [0.2], "grid": 8}]
    df = table(spark)
    found = network_symbolic.symbolize(df, ["a", "b"], net, "row_id")
    assert {(f.layer, f.input, f.output): f.name for f in found.fits}[(0, 0, 1)] == "x^2" and len(found.fits) == 5
    assert found.quality()[0] > 0.99 and found.weak(0.5) == []
    scored = models.score(found.predict(df, ["a", "b"], ["row_id", "a", "b"], ["f"]), ["a", "b"], net, ["row_id", "f"], "n").toPandas()
    assert 1 - ((scored.f - scored.n) ** 2).sum() / ((scored.n - scored.n.mean()) ** 2).sum() > 0.99
    assert found.text(["a", "b"], ["y"])[-1].startswith("y = ")


def test_normalisation_is_folded_exactly(spark):
    f = Formulas(2, ((0.1, 0.2), (0.3, -0.1)), (Fit(0, 0, 0, "sin", 2.0, 1.5, 0.3, 0.1), Fit(0, 1, 1, "x^2", 0.5, 1.0, 0.0, 0.0), Fit(1, 0, 0, "tanh", 1.0, 2.0, -0.5, 0.4), Fit(1, 1, 1, "x", 1.0, 1.0, 0.0, 0.0), Fit(1, 0, 1, "const", 0.0, 0.0, 0.0, 0.7)))
    inputs, outputs = [(10.0, 4.0), (-3.0, 0.5)], [(100.0, 20.0), (5.0, 2.0)]
    df = table(spark, 40)
    raw = df.select("row_id", *[(F.col(c) * s + m).alias(c) for c, (m, s) in zip("ab", inputs)])
    one = f.predict(df, ["a", "b"], ["row_id"], ["p", "q"]).orderBy("row_id").toPandas()
    two = f.raw(inputs, outputs).predict(raw, ["a", "b"], ["row_id"], ["p", "q"]).orderBy("row_id").toPandas()
    assert np.allclose(one.p * 20 + 100, two.p) and np.allclose(one.q * 2 + 5, two.q)
    both = raw.select("row_id", *[c.alias(n) for c, n in zip(f.raw(inputs, outputs).columns([F.col("a"), F.col("b")]), "pq")]).orderBy("row_id").toPandas()
    assert np.allclose(both.p, two.p) and np.allclose(both.q, two.q)


def test_text_of_formulas():
    f = Formulas(2, ((0.5, 0.0), (1.0,)), (Fit(0, 0, 0, "x", 2.0, 3.0, 1.0, 0.5), Fit(0, 1, 0, "1/x", -1.0, 1.0, 2.0, 0.25), Fit(0, 1, 1, "x^3", 1e-6, 2.0, -1.0, 0.0), Fit(1, 0, 0, "sqrt", 1.5e7, 1.0, 0.0, 0.0), Fit(1, 1, 0, "const", 0.0, 0.0, 0.0, 2.0)))
    assert f.text(["a", "2t"], ["y z"]) == ["h1_0 = 3.25 + 6·a - 1·1/(`2t` + 2)", "h1_1 = 0 + 1.000000e-6·(2·`2t` - 1)^3", "`y z` = 3 + 1.500000e7·sqrt(h1_0)"]
    assert [network_symbolic.quoted(n) for n in ("h1_0", "h1", "a`b\n\\c\0", "température", "")] == ["`h1_0`", "h1", "`a\\`b\\n\\\\c\\u{0}`", "température", "``"]
    assert f.labels(f.fits[0], ["a", "b"], ["y"]) == ("a", "h1_0") and f.labels(f.fits[3], ["a", "b"], ["y"]) == ("h1_0", "y")
    assert Formulas(1, ((0.0,),), ()).quality() == (1.0, 1.0)
    for bad in (lambda: f.text(["a"], ["y"]), lambda: Formulas(1, ((0.0,),), (Fit(0, 1, 0, "x", 1, 1, 0, 0),)), lambda: Formulas(1, (), ())):
        with pytest.raises(ValueError):
            bad()


# ---- searches and refits


def search_rows(spark, n=2000):
    x = RNG.normal(0, 1.3, (n, 2))
    y = np.sin(x[:, 0]) + 0.1 * x[:, 1] ** 2 + RNG.normal(0, 0.05, n)
    return spark.createDataFrame([(i % 4, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "fold int, a double, b double, y double")


def test_one_job_gives_what_dense_products_give(spark):
    df = search_rows(spark)
    found = {(r.grid, r.strength, r.fold): (r.r2, r.nrmse) for r in spline_search.search(df, ["a", "b"], "y", "fold", [3, 6], [1e-6, 1e-2]).collect()}
    assert len(found) == 16
    for grid in (3, 6):
        by_fold = models.fold_products(df, models.spline_features(["a", "b"], grid), "y", "fold")
        whole = sum(by_fold.values())
        for s in (1e-6, 1e-2):
            for k, held in by_fold.items():
                w = models.ridge(whole - held, s)
                assert abs(found[(grid, s, k)][0] - models.r2_from_products(held, w)) < 1e-7
    assert all(0 < v[1] < 1 for v in found.values())
    ranked = spline_search.rows(spline_search.search(df, ["a", "b"], "y", "fold", [3, 6], [1e-6])).orderBy("candidate").collect()
    assert len(ranked) == 2 and ranked[1].r2_mean > 0.9 and ranked[0].nrmse_mean > 0 and ranked[0].folds == 4


def test_searches_of_odd_rows(spark):
    df = search_rows(spark, 200)
    far = df.limit(20).withColumn("a", F.col("a") * 1000).unionByName(df).unionByName(df.limit(3).withColumn("y", F.lit(None).cast("double")))
    own = models.fold_products(far.dropna(), models.spline_features(["a", "b"], 4), "y", "fold")
    sums = spline_search.moments(far, ["a", "b"], "y", "fold", [4]).toPandas()
    for k, part in sums.groupby("fold"):
        assert np.allclose(spline_search.products(part, 4, 2), own[int(k)], atol=1e-8)
    assert spline_search.search(df.limit(0), ["a"], "y", "fold", [3], [1e-3]).count() == 0
    assert [r.r2 for r in spline_search.search(df.where("fold = 1"), ["a"], "y", "fold", [3], [1e-3]).collect()] == [None]
    for bad in (([], [1.0]), ([0], [1.0]), ([3], [0.0]), ([3], [])):
        with pytest.raises(ValueError):
            spline_search.search(df, ["a"], "y", "fold", *bad)


def test_a_refit_equals_a_fit_from_scratch(spark):
    df = search_rows(spark)
    by_fold = models.fold_products(df, models.spline_features(["a", "b"], 4), "y", "fold")
    rest, n = sum(by_fold.values()), 2 * 6 + 1
    fit = interpret.Kept.of(rest, 1e-3)
    first, second = np.zeros(n, bool), np.zeros(n, bool)
    first[6:9], second[[0, 10]] = True, True
    twice = fit.without(first).without(second)
    left = np.flatnonzero(~(first | second))
    again = models.ridge(rest[np.ix_([*left, n], [*left, n])], 1e-3)
    assert np.allclose(twice.weights[left], again, atol=1e-8) and not twice.weights[first | second].any()
    assert np.allclose(fit.weights, models.ridge(rest, 1e-3)) and fit.without(np.zeros(n, bool)) is fit


def test_interpretation_of_models(spark):
    df = search_rows(spark).withColumn("y", F.sin("a") + F.lit(0.001) * F.col("b"))
    got = interpret.run(df, ["a", "b"], "y", "fold", 5, interpret.resolve(True)).first()
    assert got.kept == [0] and got.active_edges == 1 and got.r2_after_refit > 0.99 and abs(got.r2_after_compact - got.r2_after_refit) < 1e-9
    bare = interpret.run(df, ["a", "b"], "y", "fold", 5, interpret.resolve(False, l1=1e-3)).first()
    assert bare.kept == [0, 1] and bare.r2_after_prune is None and bare.r2_after_compact is None and bare.r2_before > 0.99
    assert interpret.run(df.where("fold = 0"), ["a"], "y", "fold", 5, interpret.resolve(True)).first().r2_before is None


def test_profiles():
    assert interpret.resolve(False) is None and interpret.resolve(True).describe() == "v1: L1 0.001, prune 0.05, refit 20 epochs, compact"
    assert interpret.resolve(True, prune=None).describe() == "v1: L1 0.001, no pruning, compact" and interpret.resolve(False, prune=0.1).finetune_epochs == 10
    for settings in ({"l1": -1.0}, {"l1": float("nan")}, {"prune": 1.0}, {"prune": -0.1}, {"finetune_epochs": 0}, {"prune": None, "finetune_epochs": 5}, {"version": 2}):
        with pytest.raises(ValueError):
            interpret.resolve(True, **settings)


# ---- hash trees, the ledger


def test_groups_of_a_hash_tree_are_bounded_whatever_the_ids(spark):
    n = 5000
    ids = RNG.permutation(np.concatenate([RNG.integers(-(2**60), 2**60, n - 3), [0, 0, 0]]))
    df = spark.createDataFrame([(int(i), float(k % 7)) for k, i in enumerate(ids)], "id long, v double")
    leaves, top = provenance.hash_tree(df, "id", ["v"])
    got = leaves.collect()
    assert sorted(r.node for r in got) == list(range(5)) and max(r.n_rows for r in got) == 1024 and sum(r.n_rows for r in got) == n and top.count() == 1
    one = provenance.fingerprint(df, "id", ["v"]).first()
    assert one == provenance.fingerprint(df.repartition(7), "id", ["v"]).first() and one.n_rows == n
    last = int(np.sort(ids)[3000])
    other = df.withColumn("v", F.when(F.col("id") == last, 99.0).otherwise(F.col("v")))
    assert [tuple(r) for r in provenance.changed_leaves(leaves, provenance.hash_tree(other, "id", ["v"])[0]).collect()] == [(2, 2048, 3071)]
    assert provenance.hash_tree(df.limit(0), "id", ["v"])[-1].count() == 0


def test_trees_of_more_than_two_levels_equal_their_sql(spark, sf_dir, monkeypatch):
    from tabularium.plans import catalogue

    from .test_catalogue import same

    monkeypatch.setattr(provenance, "FAN", 8)  # 1500 orders are four levels then
    for name in ("fingerprint_tree", "sparse_fingerprint", "changed_leaves", "whole_tree", "whole_fingerprint"):
        same(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLES[name].replace("1024", "8"), sf_dir)
    assert catalogue.QUERIES["whole_tree"](spark, sf_dir).agg(F.max("level")).first()[0] == 3


def test_one_of_two_drivers_opens_a_test(spark, tmp_path):
    folder = "file://" + str(tmp_path / "ledger")
    a, b = provenance.SharedLedger(spark, folder), provenance.SharedLedger(spark.newSession(), folder)
    with pytest.raises(provenance.Refused, match="NotChecked"):
        a.finalize("A", {"k": 1})
    a.record_check("A", {"k": 1})
    with pytest.raises(provenance.Refused, match="Stale"):
        b.finalize("A", {"k": 2})
    outcomes = []

    def attempt(ledger):
        try:
            ledger.finalize("A", {"k": 1})
            outcomes.append("opened")
        except provenance.Refused as e:
            outcomes.append(str(e))

    both = [threading.Thread(target=attempt, args=(x,)) for x in (a, b)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert outcomes.count("opened") == 1 and len(outcomes) == 2
    with pytest.raises(provenance.Refused, match="AlreadyFinalized"):
        b.finalize("A", {"k": 1})
    with pytest.raises(provenance.Refused, match="TestDisclosed"):
        b.finalize("A", {"k": 3})
    b.record_check("B", {"k": 3})
    b.finalize("B", {"k": 3})
    with pytest.raises(provenance.Refused, match="AlreadyFinalized"):
        provenance.SharedLedger(spark, folder).finalize("A", {"k": 1})
    assert [(r.kind, r.dataset) for r in a.events().orderBy("seq").collect()] == [("check", "A"), ("test", "A"), ("check", "B"), ("test", "B")] and a.claims().count() == 2


# ---- cells, streams of numbers


def test_every_cell_error_is_kept(spark):
    fields = [Field("x"), Field("m", INPUT, ("sand", "clay")), Field("y", OUTPUT)]
    rows = [(1, ["1.5", "clay", "2"]), (2, [" ", "rock", "abc"]), (3, ["1"]), (4, None), (5, ["inf", None, "-1e39"]), (6, ["1e3", " sand ", ".5"]), (7, ["0x1", "1", "nan"])]
    got = cells.parsed(spark.createDataFrame(rows, "row_no long, cells array<string>"), fields)
    assert sorted(map(tuple, cells.good(got).collect())) == [(1, 1.5, 1.0, 2.0), (6, 1000.0, 0.0, 0.5)]
    assert sorted((r.row_no, r.column or "", r.reason) for r in cells.errors(got).collect()) == [
        (2, "m", cells.LEVEL), (2, "x", cells.EMPTY), (2, "y", cells.TEXT), (3, "", cells.WIDTH), (4, "", cells.WIDTH), (5, "m", cells.EMPTY), (5, "x", cells.INFINITE_), (5, "y", cells.INFINITE_),
        (7, "m", cells.LEVEL), (7, "x", cells.TEXT), (7, "y", cells.INFINITE_)]
    coded = cells.parsed(spark.createDataFrame([(1, ["1", "1", "1"])], "row_no long, cells array<string>"), fields, codes_allowed=True)
    assert cells.good(coded).first().m == 1.0


def test_rows_over_lines_and_splits_equal_their_one_line_form(spark, tmp_path):
    n, wide = 4000, 3
    values = RNG.integers(0, 1000, (n, wide))
    head = f"TRNUM1\ninputs 2\noutputs 1\nspecs C C\nrows {n}\ndata\n"
    plain = tmp_path / "plain.tnum"
    plain.write_text(head + "".join(" ".join(map(str, v)) + "\n" for v in values))
    flat, lines, at = values.ravel().tolist(), [], 0
    while at < len(flat):
        k = int(RNG.integers(1, 9))
        lines.append("  ".join(map(str, flat[at : at + k])) + ("  # note" if k == 5 else ""))
        at += k
    for name, parts in (("wrapped.tnum", 1), ("folder", 4)):
        cuts = [len(lines) * i // parts for i in range(parts + 1)]
        if parts == 1:
            (tmp_path / name).write_text(head + "\n".join(lines) + "\n")
        else:
            (tmp_path / name).mkdir()
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                (tmp_path / name / f"part-{i}").write_text((head if i == 0 else "") + "\n".join(lines[a:b]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        want = sorted(map(tuple, open_table.read_typed(spark, str(plain))[0].collect()))
        for name in ("wrapped.tnum", "folder"):
            assert sorted(map(tuple, open_table.read_typed(spark, str(tmp_path / name))[0].collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "short.tnum").write_text(head + "\n".join(lines[:-1]) + "\n")
    with pytest.raises(ValueError, match="values for"):
        open_table.read_typed(spark, str(tmp_path / "short.tnum"))


def test_points_of_an_edge_and_penalties(spark):
    net = [layer(2, 2), layer(2, 1)]
    got = network_symbolic.edge_points(spark, net[0], 1, 0, 5).orderBy("place").collect()
    assert [round(r.x, 6) for r in got] == [-3, -1.5, 0, 1.5, 3]
    df = table(spark, 50)
    rows = network_symbolic.edge_samples(df, ["a", "b"], net, "row_id").collect()
    want = {k: sum(abs(r.y) for r in rows if r.layer == k) / 50 for k in (0, 1)}
    assert {r.layer: round(r.l1, 9) for r in network_symbolic.activation_l1(df, ["a", "b"], net).collect()} == {k: round(v, 9) for k, v in want.items()}
    assert [r.l1 for r in network_symbolic.activation_l1(df.limit(0), ["a", "b"], net).collect()] == [0.0, 0.0]


def test_one_file_by_several_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y0\n1,2\n")
    (tmp_path / "b.csv").symlink_to(tmp_path / "a.csv")
    (tmp_path / "sub").mkdir()
    a = str(tmp_path / "a.csv")
    for other in (f"file://{a}", f"{tmp_path}/sub/../a.csv", str(tmp_path / "b.csv")):
        assert open_table.same_file(spark, a, other)
        with pytest.raises(ValueError, match="overwritten"):
            open_table.table_to_typed(spark, a, other, 1, 1)
    assert not open_table.same_file(spark, a, str(tmp_path / "c.csv"))


def test_the_query_of_spline_models_is_one_plan_with_the_scores_of_full_products(spark, sf_dir):
    from tabularium.operators import metrics, scaling
    from tabularium.plans import catalogue

    got = catalogue.QUERIES["search_splines"](spark, sf_dir)
    assert "FlatMapGroups" in got._jdf.queryExecution().executedPlan().toString()  # scores weren't brought to the driver
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    names = ["l_quantity", "l_discount"]
    stats = scaling.literals(scaling.fit(line, names))
    z = line.select(*[scaling.transform(c, stats).alias(c) for c in names], F.col("l_extendedprice").alias("y"), F.pmod(F.xxhash64(*line.columns), F.lit(5)).cast("int").alias("fold"))
    runs = spark.createDataFrame(models.search(z, names, "y", "fold", [4, 8], [1e-6, 1e-3])).select(F.format_string("grid=%d ridge=%g", "grid", "strength").alias("candidate"), F.lit(0).alias("seed"), F.lit(0).alias("repeat"), "fold", "r2")
    want = {r.candidate: r for r in metrics.over_runs(runs, ["candidate"]).collect()}
    for r in got.collect():
        assert abs(r.r2_mean - want[r.candidate].r2_mean) < 2e-6 and r.folds == 5
    assert len(want) == 4
