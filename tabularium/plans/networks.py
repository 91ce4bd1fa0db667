"""Queries over whole networks: symbolic reading of every edge, searches of spline models, refits after pruning; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, interpret, network_symbolic, scaling, scoring, spline_search, symbolic
from ..sources import generators
from .catalogue import _CURVE, _FIT, ORACLES, _bspline_sql, _curve, _t, query, rounded

# ---- fits as SQL

_VALUES = {
    "x": ("u", "true"), "x^2": ("u * u", "true"), "x^3": ("u * u * u", "true"), "sqrt": ("sqrt(greatest(u, 0))", "u >= 0"), "exp": ("exp(least(u, 15))", "u < 15"),
    "log": ("ln(greatest(u, 1e-6))", "u > 1e-4"), "1/x": ("1 / case when abs(u) > 1e-3 then u else 1 end", "abs(u) > 1e-3"), "sin": ("sin(u)", "true"), "tanh": ("tanh(u)", "true"),
}
_PRIMITIVE = "case " + " ".join(f"when name = '{n}' then case when {ok} then {value} end" for n, (value, ok) in _VALUES.items()) + " end"
_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(_VALUES))
_STEPS = "(select unnest(range(13)) as i) x, (select unnest(range(13)) as j) y"


def fit_sql(samples: str, keys: str) -> str:
    """CTEs up to ``fits``: the best primitive and its a, b, c, d, r2 of each edge of ``samples`` (keys, x, y), three rounds of 13 by 13 settings."""
    on = " and ".join(f"s.{k} = g.{k}" for k in keys.split(", "))
    parts = [f"g0 as (select turn, name, -3 + 6 * (i / 12.0::double) as b, -4 + 8 * (j / 12.0::double) as c from (values {_NAMES}) p(turn, name), {_STEPS})"]
    wide_b, wide_c = 0.5, 8 / 12
    for k in range(3):
        own = ", ".join(f"s.{c}" for c in keys.split(", "))
        pairs = f"{samples} s, g0 g" if k == 0 else f"{samples} s join g{k} g on {on}"
        parts.append(f"v{k} as (select {own}, g.turn, g.name, g.b, g.c, s.y, g.b * s.x + g.c as u from {pairs})")
        parts.append(f"m{k} as (select {keys}, turn, name, b, c, count(*) as n, count(f) as inside, avg(f) as mf, avg(y) as my, var_pop(f) * count(*) as vf, var_pop(y) * count(*) as vy, covar_pop(f, y) * count(*) as cv from (select *, {_PRIMITIVE} as f from v{k}) group by all)")
        parts.append(f"r{k} as (select {keys}, turn, name, b, c, cv / vf as a, my - cv / vf * mf as d, case when vy > 1e-12 then cv * cv / (vf * vy) else 0 end as r2 from m{k} where inside = n and vf >= 1e-9)")
        if k < 2:
            parts.append(f"t{k} as (select {keys}, turn, name, unnest(arg_min({{'b0': b, 'c0': c}}, (-round(r2, 9), b, c))) from r{k} group by {keys}, turn, name)")
            parts.append(f"g{k + 1} as (select {keys}, turn, name, b0 + {wide_b}::double * (2 * (i / 12.0::double) - 1) as b, c0 + {wide_c}::double * (2 * (j / 12.0::double) - 1) as c from t{k}, {_STEPS})")
            wide_b, wide_c = wide_b / 6, wide_c / 6
    parts.append(f"best as (select {keys}, unnest(arg_min({{'name': name, 'a': a, 'b': b, 'c': c, 'd': d, 'r2': r2}}, (-round(r2, 9), turn, b, c))) from r2 where r2 > 0 group by {keys})")
    parts.append(f"flat as (select {keys}, avg(y) as mean, var_pop(y) * count(*) < 1e-10 as still from {samples} group by {keys})")
    const = "coalesce(still or name is null, true)"
    parts.append(f"fits as (select {keys}, case when {const} then 'const' else name end as name, " + ", ".join(f"case when {const} then 0 else {c} end as {c}" for c in "abc")
                 + f", case when {const} then mean else d end as d, case when still then 1 when name is null then 0 else r2 end as r2 from flat left join best using ({keys}))")
    return ", ".join(parts)


_KNOWN = {"sine": "2 * sin(1.5 * x - 0.5) + 0.3", "log": "1.7 * ln(x + 3) - 0.4", "square": "0.5 * (x + 0.5) * (x + 0.5)", "tanh": "3 * tanh(0.75 * x + 0.5) - 1", "flat": "0 * x + 2.5"}
_CURVES = "curves as (select edge, x, case " + " ".join(f"when edge = '{n}' then {v}" for n, v in _KNOWN.items()) + " end as y from (select distinct (p_size - 25) / 12.5::double as x from part), (values " + ", ".join(f"('{n}')" for n in _KNOWN) + ") k(edge))"


def _known_curves(spark, sf_dir):
    x = F.col("x")
    values = {
        "sine": F.lit(2.0) * F.sin(F.lit(1.5) * x - F.lit(0.5)) + F.lit(0.3), "log": F.lit(1.7) * F.log(x + F.lit(3.0)) - F.lit(0.4),
        "square": F.lit(0.5) * (x + F.lit(0.5)) * (x + F.lit(0.5)), "tanh": F.lit(3.0) * F.tanh(F.lit(0.75) * x + F.lit(0.5)) - F.lit(1.0), "flat": F.lit(0.0) * x + F.lit(2.5),
    }
    sizes = _t(spark, sf_dir, "part").select(((F.col("p_size") - F.lit(25.0)) / F.lit(12.5)).alias("x")).distinct()
    return sizes.select("x", F.inline(F.array(*[F.struct(F.lit(n).alias("edge"), v.alias("y")) for n, v in values.items()])))


@query(f"with {_CURVES}, {fit_sql('curves', 'edge')} select edge, name, round(a, 4) as a, round(b, 4) as b, round(c, 4) as c, round(d, 4) as d, round(r2, 6) as r2 from fits")
def symbolic_recovery(spark, sf_dir):
    """Curves whose primitive is known, over the sizes of parts: the fits find them again."""
    return rounded(symbolic.fit_edges(_known_curves(spark, sf_dir), ["edge"]), 4, r2=6)


# ---- a network of two layers with pinned weights


def _weights(n: int, turn: int) -> list[float]:
    """Pinned weights: a rule, not a table."""
    return [round(((7 * k + 3 * turn) % 11 - 5) / 10, 1) for k in range(n)]


_GRID = 4
_NET = [
    {"kind": "spline", "base": [[0.6, -0.4], [0.3, 0.0]], "spline": [[_weights(7, 1), _weights(7, 2)], [_weights(7, 3), [0.0] * 7]], "bias": [0.1, -0.2], "grid": _GRID},
    {"kind": "spline", "base": [[0.8], [-0.5]], "spline": [[_weights(7, 4)], [_weights(7, 5)]], "bias": [0.05], "grid": _GRID},
]
_IN = {"p_size": (25.0, 14.0), "p_retailprice": (1500.0, 400.0)}
_OUT = {"target": (3.0, 2.0)}


def _edge_sql(layer: int, i: int, j: int, x: str) -> str:
    own = _NET[layer]
    gelu = f"0.5::double * {x} * (1 + tanh(sqrt(2 / pi()) * ({x} + 0.044715::double * {x} * {x} * {x})))"
    return f"({own['base'][i][j]}::double * ({gelu}) + " + " + ".join(f"({w})::double * {b}" for w, b in zip(own["spline"][i][j], _bspline_sql(x, _GRID))) + ")"


_SCALED = "z as (select p_partkey, (p_size - 25) / 14.0::double as z0, (p_retailprice - 1500) / 400.0::double as z1 from part)"
_HIDDEN = f"h as (select *, 0.1::double + {_edge_sql(0, 0, 0, 'z0')} + {_edge_sql(0, 1, 0, 'z1')} as h0, -0.2::double + {_edge_sql(0, 0, 1, 'z0')} as h1 from z)"
_PICKED = "q as (select *, row_number() over (order by p_partkey) - 1 as k, count(*) over () as n from h), w as (select distinct floor(i * (n / 256.0::double))::bigint as k from (select max(n) as n from q), (select unnest(range(256)) as i)), sample as (select q.* from q join w using (k))"
_PLACES = [(0, 0, 0, "z0"), (0, 0, 1, "z0"), (0, 1, 0, "z1"), (1, 0, 0, "h0"), (1, 1, 0, "h1")]
_SAMPLES = "edges as (" + " union all ".join(f"select {a} as layer, {i} as input, {j} as output, {x} as x, {_edge_sql(a, i, j, x)} as y from sample" for a, i, j, x in _PLACES) + ")"
_NETWORK_SQL = f"{_SCALED}, {_HIDDEN}, {_PICKED}, {_SAMPLES}"


def _scaled(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(f"z{i}") for i, (c, (m, s)) in enumerate(_IN.items())])


@query(f"with {_NETWORK_SQL} select layer, input, output, round(x, 6) as x, round(y, 6) as y from edges")
def network_edge_samples(spark, sf_dir):
    """What arrives at each edge of both layers and what it makes of it, for 256 parts; the edge of no weights is left out."""
    return rounded(network_symbolic.edge_samples(_scaled(spark, sf_dir), ["z0", "z1"], _NET, "p_partkey"), 6)


@query(f"with {_NETWORK_SQL}, {fit_sql('edges', 'layer, input, output')} select layer, input, output, name, round(a, 3) as a, round(b, 3) as b, round(c, 3) as c, round(d, 3) as d, round(r2, 5) as r2 from fits")
def network_symbolic_fits(spark, sf_dir):
    """The primitive of every active edge of both layers."""
    samples = network_symbolic.edge_samples(_scaled(spark, sf_dir), ["z0", "z1"], _NET, "p_partkey")
    return rounded(symbolic.fit_edges(samples, network_symbolic.KEYS), 3, r2=5)


_FORMULAS = network_symbolic.Formulas(2, ((0.1, -0.2), (0.05,)), (
    network_symbolic.Fit(0, 0, 0, "sin", 0.8, 1.2, 0.3, 0.1), network_symbolic.Fit(0, 0, 1, "x", 0.5, 1.0, -0.2, 0.0), network_symbolic.Fit(0, 1, 0, "tanh", -0.6, 0.9, 0.0, 0.2),
    network_symbolic.Fit(1, 0, 0, "x^2", 0.7, 1.0, 0.5, -0.1), network_symbolic.Fit(1, 1, 0, "exp", 0.2, 0.5, 0.0, 0.0)))
_FORMULAS_SQL = """h as (select *, 0.1::double + 0.8 * sin(1.2 * z0 + 0.3) + 0.1 + -0.6 * tanh(0.9 * z1) + 0.2 as h0, -0.2::double + 0.5 * (z0 - 0.2) as h1 from z),
f as (select p_partkey, 3 + 2 * (0.05::double + 0.7 * (h0 + 0.5) ** 2 - 0.1 + 0.2 * exp(0.5 * h1)) as pred from h)"""


@query(f"with {_SCALED}, {_FORMULAS_SQL} select p_partkey, round(pred, 6) as by_layers, round(pred, 6) as by_column from f")
def network_formulas(spark, sf_dir):
    """Pinned formulas of two layers on raw parts, with the z-scores folded into the first and the last layer: a select for each layer, and one Column."""
    raw = _FORMULAS.raw(list(_IN.values()), list(_OUT.values()))
    part = _t(spark, sf_dir, "part")
    one = part.withColumn("by_column", raw.columns([F.col(c).cast("double") for c in _IN])[0])
    return rounded(raw.predict(one, list(_IN), ["p_partkey", "by_column"], ["by_layers"]), 6)


@query("""select unnest(['h1_0 = 0.4 + 0.8·sin(0.085714·p_size - 1.842857) - 0.6·tanh(0.00225·p_retailprice - 3.375)', 'h1_1 = -1.192857 + 0.035714·p_size',
'target = 2.9 + 1.4·(h1_0 + 0.5)^2 + 0.4·exp(0.5·h1_1)']) as line, unnest(range(3))::int as place from (select count(*) from part)""")
def network_formula_text(spark, sf_dir):
    """The same formulas as text, with the constants that the table's own columns name."""
    lines = _FORMULAS.raw(list(_IN.values()), list(_OUT.values())).text(list(_IN), list(_OUT))
    named = _t(spark, sf_dir, "part").agg(F.count(F.lit(1)))
    return named.select(F.posexplode(F.array(*map(F.lit, lines))).alias("place", "line"))


_READ = f"""{_NETWORK_SQL}, {fit_sql('edges', 'layer, input, output')},
net as (select p_partkey, 3 + 2 * (0.05::double + {_edge_sql(1, 0, 0, 'h0')} + {_edge_sql(1, 1, 0, 'h1')}) as net from h),
e0 as (select z.p_partkey, f.*, f.b * (case f.input when 0 then z0 else z1 end) + f.c as u from z, fits f where layer = 0),
n0 as (select p_partkey, output, case output when 0 then 0.1 else -0.2 end + sum(case when name = 'const' then d else a * {_PRIMITIVE} + d end) as h from e0 group by p_partkey, output),
e1 as (select n.p_partkey, f.*, f.b * n.h + f.c as u from n0 n join fits f on f.layer = 1 and f.input = n.output),
n1 as (select p_partkey, 3 + 2 * (0.05 + sum(case when name = 'const' then d else a * {_PRIMITIVE} + d end)) as formulas from e1 group by p_partkey),
t as (select p_partkey, (p_size % 7) + p_retailprice / 1000.0::double as target from part)"""


@query(f"""with {_READ} select 'target' as output, round(1 - sum((formulas - target) ** 2) / (var_pop(target) * count(*)), 3) as formulas_r2,
round(1 - sum((net - target) ** 2) / (var_pop(target) * count(*)), 5) as network_r2 from t join net using (p_partkey) join n1 using (p_partkey)""")
def network_fidelity(spark, sf_dir):
    """R2 of the formulas read off a network and of the network itself, on the same raw rows."""
    found = network_symbolic.symbolize(_scaled(spark, sf_dir), ["z0", "z1"], _NET, "p_partkey").raw(list(_IN.values()), list(_OUT.values()))
    rows = _t(spark, sf_dir, "part").withColumn("target", F.col("p_size") % 7 + F.col("p_retailprice") / F.lit(1000.0))
    return rounded(network_symbolic.fidelity(rows, list(_IN), ["target"], _NET, found, {**_IN, **_OUT}, "p_partkey"), 5, formulas_r2=3)


# ---- searches of spline models


def ridge_sql(rows: str, grids: list[int], strengths: list[float]) -> str:
    """CTEs up to ``scores`` (model, grid, strength, fold, r2, nrmse) of ``rows`` (model, fold, y, x0, x1; x1 null where a model has one input): normal equations, eliminated row by row."""
    basis = "case when t < 1 then 2.0::double / 3 - t * t + t * t * t / 2 when t < 2 then (2 - t) * (2 - t) * (2 - t) / 6 else 0 end"
    bases = lambda x: f"list_transform(list_transform(range(grid + 2), lambda i: abs({x} - (-3 + 6.0::double / grid * (i - 1))) / (6.0::double / grid)), lambda t: {basis})"
    return f"""
f as (select model, fold, grid, list_concat({bases('x0')}, case when x1 is null then [] else {bases('coalesce(x1, 0)')} end, [1.0::double, y]) as g from {rows}, (select unnest({grids}) as grid)),
s as (select model, grid, fold, i, j, sum(g[i] * g[j]) as v from (select *, unnest(range(1, len(g) + 1)) as i from f), (select unnest(range(1, 60)) as j) where j <= len(g) group by all),
r as (select *, sum(v) over (partition by model, grid, i, j) - v as rest from s),
l as (select model, grid, fold, i, list(v order by j) as held, list(rest order by j) as rest from r group by all),
q as (select model, grid, fold, list(held order by i) as held, list(rest order by i) as rest, count(*) - 1 as p from l group by all),
e0 as (select *, 0 as k, list_transform(list_slice(rest, 1, p), lambda row, i: list_transform(row, lambda v, j: v + case when i = j then strength * greatest(v, 1e-9) else 0 end)) as m
  from q, (select unnest([{', '.join(f'{x!r}::double' for x in strengths)}]) as strength)),
e as (with recursive w as (select model, grid, fold, strength, p, k, m from e0 union all
  select model, grid, fold, strength, p, k + 1, list_transform(m, lambda row, i: case when i = k + 1 then list_transform(row, lambda v: v / m[k + 1][k + 1]) else list_transform(row, lambda v, j: v - row[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) end) from w where k < p)
  select * from w where k = p),
b as (select e.model, e.grid, e.fold, e.strength, q.held, q.rest, q.p, list_append(list_transform(e.m, lambda row: row[e.p + 1]), -1.0::double) as w from e join q using (model, grid, fold)),
c as (select *, list_sum(list_transform(held, lambda row, i: w[i] * list_sum(list_transform(row, lambda v, j: v * w[j])))) as sse,
  held[p + 1][p + 1] - held[p][p + 1] ** 2 / held[p][p] as sst, held[p][p] as n, sqrt(rest[p + 1][p + 1] / rest[p][p] - (rest[p][p + 1] / rest[p][p]) ** 2) as sigma from b),
scores as (select model, grid, strength, fold, 1 - sse / sst as r2, sqrt(greatest(sse, 0) / n) / sigma as nrmse from c)"""


_LINES = """n as (select avg(l_quantity) as a, stddev_pop(l_quantity) as b, avg(l_discount) as c, stddev_pop(l_discount) as d from lineitem),
lines as (select '' as model, l_orderkey % 5 as fold, l_extendedprice as y, (l_quantity - a) / b as x0, (l_discount - c) / d as x1 from lineitem, n)"""


@query(f"""with {_LINES}, {ridge_sql('lines', [2, 4], [1e-6, 1e-3])}
select format('grid={{}} ridge={{}}', grid, case when strength < 1e-5 then '1.00000e-06' else '0.00100000' end) as candidate, round(avg(r2), 6) as r2_mean, round(stddev_pop(r2), 6) as r2_std_folds, round(avg(nrmse), 6) as nrmse_mean
from scores group by grid, strength""")
def search_spline_grids(spark, sf_dir):
    """Additive spline models of prices by grid and ridge, on five folds: one job; mean and spread of R2 and mean nRMSE over the runs."""
    line = _t(spark, sf_dir, "lineitem")
    stats = scaling.literals(scaling.fit(line, ["l_quantity", "l_discount"]))
    z = line.select(*[scaling.transform(c, stats).alias(c) for c in ("l_quantity", "l_discount")], F.col("l_extendedprice").alias("y"), (F.col("l_orderkey") % 5).alias("fold"))
    found = spline_search.rows(spline_search.search(z, ["l_quantity", "l_discount"], "y", "fold", [2, 4], [1e-6, 1e-3]))
    return rounded(found.select("candidate", "r2_mean", "r2_std_folds", "nrmse_mean"), 6)


_SWEEP = """p as (select p_partkey % 3 as fold, (p_size - 25) / 25.0::double as a, (p_retailprice - 1000) / 1000.0::double as b from part),
sampled as (select 'sum' as model, 'y' as output, fold, a + b as y, a as x0, b as x1 from p union all select 'product', 'y', fold, a * b, a, b from p
union all select 'sine', 'y0', fold, sin(3 * a), a, null from p union all select 'sine', 'y1', fold, cos(3 * a), a, null from p union all select 'polynomial', 'y', fold, 0.5 * a * a - a + 1, a, null from p
union all select 'projectile', 'y', fold, (5.5 + 4.5 * a) * (5.5 + 4.5 * a) * sin(2 * (0.8 + 0.7 * b)) / 9.81, a, b from p),
named as (select model || ':' || output as model, fold, y, x0, x1 from sampled)"""


@query(f"""with {_SWEEP}, {ridge_sql('named', [2, 3], [1e-4, 1e-2])},
o as (select split_part(model, ':', 1) as model, split_part(model, ':', 2) as output, grid, strength, avg(r2) as r2, avg(nrmse) as nrmse from scores group by all),
m as (select model, grid, strength, min(r2) as worst_r2, avg(r2) as mean_r2, avg(nrmse) as nrmse from o group by all)
select model, format('grid={{}} ridge={{}}', grid, case when strength < 1e-3 then '0.000100000' else '0.0100000' end) as candidate, round(worst_r2, 5) as worst_r2, round(mean_r2, 5) as mean_r2, round(nrmse, 4) as nrmse,
row_number() over (partition by model order by round(worst_r2, 9) desc, grid, strength)::int as place from m""")
def blackbox_sweep(spark, sf_dir):
    """All five known functions over inputs that parts give, every grid, ridge and fold in one grouped job, ranked by the worst output."""
    a, b = (F.col("p_size") - F.lit(25.0)) / F.lit(25.0), (F.col("p_retailprice") - F.lit(1000.0)) / F.lit(1000.0)
    at = {"sum": [a, b], "product": [a, b], "sine": [F.lit(3.0) * a], "polynomial": [a], "projectile": [F.lit(5.5) + F.lit(4.5) * a, F.lit(0.8) + F.lit(0.7) * b]}
    each, widths = [], {}
    for name, inputs in at.items():
        outs = generators.truth(name, inputs)
        for j, y in enumerate(outs):
            key = f"{name}:y{j}" if len(outs) > 1 else f"{name}:y"
            widths[key] = len(inputs)
            each.append(F.struct(F.lit(key).alias("key"), y.alias("y"), a.alias("x0"), (b if len(inputs) > 1 else F.lit(None).cast("double")).alias("x1")))
    rows = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 3).alias("fold"), F.inline(F.array(*each)))
    found = spline_search.search(rows, ["x0", "x1"], "y", "fold", [2, 3], [1e-4, 1e-2], "key", widths)
    parts = F.split("model", ":")
    named = found.withColumns({"output": parts[1], "model": parts[0], "r2": F.round("r2", 9)})
    return rounded(spline_search.sweep(named), 5, nrmse=4)


_PRUNED = """n as (select avg(l_quantity) as a, stddev_pop(l_quantity) as b, avg(l_tax) as c, stddev_pop(l_tax) as d from lineitem),
z as (select l_returnflag as flag, l_orderkey % 4 as fold, (l_quantity - a) / b as x0, (l_tax - c) / d as x1 from lineitem, n),
pair as (select flag || ':both' as model, fold, x0 * x0 + case flag when 'A' then 0.01 when 'N' then 0.5 else 0.2 * x0 end * x1 as y, x0, x1 from z),
two as (select * from pair union all select replace(model, 'both', 'one'), fold, y, x0, null from pair)"""


@query(f"""with {_PRUNED}, {ridge_sql('two', [3], [1e-3])},
d as (select *, split_part(model, ':', 1) as flag, p - 1 as k, rest[p][p] as rows_ from c where fold = 0),
v as (select flag, model, list_transform([0, 5], lambda o: sqrt(list_sum(list_transform(range(1, 6), lambda i: list_sum(list_transform(range(1, 6), lambda j: w[i + o] * w[j + o] * (rest[i + o][j + o] / rows_ - rest[i + o][p] * rest[j + o][p] / rows_ ** 2))))))) as size from d where model like '%both'),
u as (select flag, list_transform(w, lambda x, i: case when i between 6 and 10 then 0 else x end) as cut, held, sst from d where model like '%both'),
a as (select flag, 1 - list_sum(list_transform(held, lambda row, i: cut[i] * list_sum(list_transform(row, lambda x, j: x * cut[j])))) / sst as r2 from u)
select v.flag as model, case when size[2] < 0.05 * size[1] then '0' else '0,1' end as kept, round(d.r2, 5) as r2_before, round(case when size[2] < 0.05 * size[1] then a.r2 else d.r2 end, 5) as r2_after_prune,
round(case when size[2] < 0.05 * size[1] then o.r2 else d.r2 end, 5) as r2_after_refit, round(case when size[2] < 0.05 * size[1] then o.r2 else d.r2 end, 5) as r2_after_compact
from v join (select flag, model, 1 - sse / sst as r2 from d) d on d.model = v.model join (select flag, 1 - sse / sst as r2 from d where model like '%one') o on o.flag = v.flag join a on a.flag = v.flag""")
def interpret_steps(spark, sf_dir):
    """Additive models of each return flag: pruned by the profile, refitted from kept sums, R2 on a held-out fold after each step."""
    line = _t(spark, sf_dir, "lineitem")
    stats = scaling.literals(scaling.fit(line, ["l_quantity", "l_tax"]))
    x0, x1 = (scaling.transform(c, stats) for c in ("l_quantity", "l_tax"))
    share = F.when(F.col("l_returnflag") == "A", F.lit(0.01)).when(F.col("l_returnflag") == "N", F.lit(0.5)).otherwise(F.lit(0.2) * x0)
    rows = line.select("l_returnflag", (F.col("l_orderkey") % 4).alias("fold"), x0.alias("x0"), x1.alias("x1"), (x0 * x0 + share * x1).alias("y"))
    found = interpret.run(rows, ["x0", "x1"], "y", "fold", 3, interpret.resolve(True), model="l_returnflag")
    return rounded(found.withColumn("kept", F.concat_ws(",", "kept")).drop("active_edges"), 5)


@query(f"""with {_SCALED}, {_HIDDEN} select unnest([0, 1])::int as layer, round(unnest([avg(abs({_edge_sql(0, 0, 0, 'z0')}) + abs({_edge_sql(0, 0, 1, 'z0')}) + abs({_edge_sql(0, 1, 0, 'z1')})), avg(abs({_edge_sql(1, 0, 0, 'h0')}) + abs({_edge_sql(1, 1, 0, 'h1')}))]), 6) as l1 from h""")
def network_l1(spark, sf_dir):
    """What the activation penalty of each layer of a network is over all parts."""
    return rounded(network_symbolic.activation_l1(_scaled(spark, sf_dir), ["z0", "z1"], _NET), 6)


@query("""with s as (select avg(p_size) as m0, stddev_pop(p_size) as s0, avg(p_retailprice) as m1, stddev_pop(p_retailprice) as s1 from part),
z as (select p_partkey, (p_size - m0) / s0 as a, (p_retailprice - m1) / s1 as b, m1, s1 from part, s),
h as (select *, a * 0.5 + b * 0.2 + 0.1 as u, a * -0.3 + b * 0.8 - 0.2 as v from z),
g as (select *, 0.5::double * u * (1 + tanh(sqrt(2 / pi()) * (u + 0.044715::double * u * u * u))) as x, 0.5::double * v * (1 + tanh(sqrt(2 / pi()) * (v + 0.044715::double * v * v * v))) as y from h)
select p_partkey, round((x * 1.5 - y * 0.7 + 0.3) * s1 + m1, 5) as p_retailprice from g""")
def predict_dataset(spark, sf_dir):
    """Raw parts in, raw prices out: normalise, score, take back."""
    part = _t(spark, sf_dir, "part")
    stats = scaling.literals(scaling.fit(part, ["p_size", "p_retailprice"]))
    layers = [{"kind": "dense", "weights": [[0.5, -0.3], [0.2, 0.8]], "bias": [0.1, -0.2], "activate": True}, {"kind": "dense", "weights": [[1.5], [-0.7]], "bias": [0.3], "activate": False}]
    return rounded(scoring.predict(part, ["p_size", "p_retailprice"], layers, stats, ["p_retailprice"], ["p_partkey"]), 5)


@query(f"with {_CURVE} select run, split, max(epoch) as last_epoch, round(arg_max(r2, epoch), 7) as last_r2 from c where r2 is not null group by run, split")
def last_values(spark, sf_dir):
    return rounded(curves.last_values(_curve(spark, sf_dir), ["run", "split"]), 7)


ORACLES["symbolic_fit"] = f"with {_FIT}, {fit_sql('p', 'edge')} select edge, name, round(a, 4) as a, round(b, 4) as b, round(c, 4) as c, round(d, 4) as d, round(r2, 4) as r2 from fits"
ORACLES["weak_best_edges"] = f"with {_FIT}, {fit_sql('p', 'edge')} select round(min(r2), 4) as worst, round(avg(r2), 4) as mean, count(*) filter (r2 < 0.99) as weak from fits"
