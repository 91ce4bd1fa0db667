"""A whole spline network read as formulas: every active edge of every layer sampled in one relation, fitted, and put together again.

The sample is bounded (256 rows at even strides of the order of ids, as edges are read in the reference), whatever the table. The fits are
a row for each edge. Normalisation is folded into the first and the last layer, so that formulas take raw inputs and give raw outputs;
hidden nodes stay without a unit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import affine_edge
from . import diagnostics, metrics, models, symbolic

SAMPLE = 256
KEYS = ["layer", "input", "output"]


def edge_samples(df: DataFrame, inputs: Sequence[str], layers: Sequence[dict], row_id: str, most: int = SAMPLE) -> DataFrame:
    """layer, input, output, x, y: what arrives at each active edge of all layers, and what the edge makes of it, for ``most`` rows of ``df``."""
    picked = diagnostics.calibration_sample(df, row_id, most).withColumnRenamed("row_id", row_id)
    rows = df.join(F.broadcast(picked), row_id)  # ``most`` ids
    names = [f"a0_{i}" for i in range(len(inputs))]
    rows, held = rows.select(*[F.col(c).cast("double").alias(n) for c, n in zip(inputs, names)]), list(names)
    each = []
    for k, layer in enumerate(layers):
        base, spline = np.asarray(layer["base"]), np.asarray(layer["spline"])
        for i, j in zip(*np.nonzero((base != 0) | (spline != 0).any(2))):
            each.append(F.struct(*(F.lit(int(v)).alias(c) for c, v in zip(KEYS, (k, i, j))), F.col(names[i]).alias("x"), models.edge(layer, i, j, F.col(names[i])).alias("y")))
        if k + 1 < len(layers):
            outs = models.spline_layer([F.col(n) for n in names], base, spline, layer["bias"], layer["grid"])
            names = [f"a{k + 1}_{j}" for j in range(len(outs))]
            rows = rows.select(*held, *[o.alias(n) for o, n in zip(outs, names)])
            held += names
    return rows.select(F.inline(F.array(*each))) if each else rows.sparkSession.createDataFrame([], "layer int, input int, output int, x double, y double")


def activation_l1(df: DataFrame, inputs: Sequence[str], layers: Sequence[dict]) -> DataFrame:
    """layer, l1: for each layer the sum over its edges of the mean size of what they add, over all rows; their sum is the network's."""
    names = [f"a0_{i}" for i in range(len(inputs))]
    rows, sums = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(inputs, names)]), []
    for k, layer in enumerate(layers):
        base = np.asarray(layer["base"])
        size = sum((F.abs(models.edge(layer, i, j, F.col(names[i]))) for i in range(base.shape[0]) for j in range(base.shape[1])), F.lit(0.0))
        outs = models.spline_layer([F.col(n) for n in names], base, np.asarray(layer["spline"]), layer["bias"], layer["grid"])
        rows = rows.select(*[f"s{m}" for m in range(k)], size.alias(f"s{k}"), *[o.alias(f"a{k + 1}_{j}") for j, o in enumerate(outs)])
        names = [f"a{k + 1}_{j}" for j in range(len(outs))]
        sums.append(F.struct(F.lit(k).alias("layer"), F.coalesce(F.avg(f"s{k}"), F.lit(0.0)).alias("l1")))
    return rows.agg(F.array(*sums).alias("l")).select(F.inline("l"))


def edge_points(spark: SparkSession, layer: dict, i: int, j: int, n: int = 200, low: float = -3.0, high: float = 3.0) -> DataFrame:
    """place, x, y: one edge at ``n`` even points from ``low`` to ``high``, both included."""
    if n < 2:
        raise ValueError("a curve has two points at least")
    x = F.lit(low) + F.lit(high - low) * F.col("id") / F.lit(float(n - 1))
    return spark.range(n).select(F.col("id").alias("place"), x.alias("x")).select("place", "x", models.edge(layer, i, j, F.col("x")).alias("y"))


@dataclass(frozen=True)
class Fit:
    """y = a f(b x + c) + d for one edge."""

    layer: int
    input: int
    output: int
    name: str
    a: float
    b: float
    c: float
    d: float
    r2: float = 1.0


def number(v: float) -> str:
    """At most six decimals without closing noughts; scientific below 1e-5 and from 1e6."""
    if v == 0 or 1e-5 <= abs(v) < 1e6:
        return f"{v:.6f}".rstrip("0").rstrip(".") if v else "0"
    digits, _, power = f"{v:.6e}".partition("e")
    return f"{digits}e{int(power)}"


def argument(b: float, variable: str, c: float) -> str:
    """``b·variable + c`` without a factor of one or a summand of nought."""
    scaled = variable if abs(b - 1) < 1e-6 else f"{number(b)}·{variable}"
    return scaled if abs(c) < 1e-6 else f"{scaled} {'+' if c > 0 else '-'} {number(abs(c))}"


def quoted(name: str) -> str:
    """Names that aren't identifiers, or look like a hidden node (h1_0), in backticks with their control characters escaped."""
    layer, _, node = name[1:].partition("_")
    if name.isidentifier() and not (name[0] == "h" and layer.isascii() and layer.isdigit() and node.isascii() and node.isdigit()):
        return name
    shown = {"\\": "\\\\", "`": "\\`", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return "`" + "".join(shown.get(c) or (c if c.isprintable() or ord(c) >= 160 else f"\\u{{{ord(c):x}}}") for c in name) + "`"


#: How a call of each primitive is written; ``{}`` is its argument.
_CALLS = {"x^2": "({})^2", "x^3": "({})^3", "1/x": "1/({})"}


@dataclass(frozen=True)
class Formulas:
    """Biases of each layer's nodes, the number of inputs, and the fits of all active edges."""

    n_inputs: int
    biases: tuple[tuple[float, ...], ...]
    fits: tuple[Fit, ...]

    def __post_init__(self):
        widths = [self.n_inputs, *map(len, self.biases)]
        if not self.biases or any(not (0 <= f.layer < len(self.biases) and 0 <= f.input < widths[f.layer] and 0 <= f.output < widths[f.layer + 1]) for f in self.fits):
            raise ValueError("an edge lies outside of the network")

    def of(self, layer: int, output: int) -> list[Fit]:
        return sorted((f for f in self.fits if (f.layer, f.output) == (layer, output)), key=lambda f: f.input)

    def raw(self, inputs: Sequence[tuple[float, float]], outputs: Sequence[tuple[float, float]]) -> Formulas:
        """The same formulas on raw numbers, from (mean, spread) of inputs and outputs; R2 of the edges stay."""
        last = len(self.biases) - 1
        fits = []
        for f in self.fits:
            if f.layer == 0:
                mean, spread = inputs[f.input]
                f = replace(f, b=f.b / spread, c=f.c - f.b * mean / spread)
            if f.layer == last:
                f = replace(f, a=f.a * outputs[f.output][1], d=f.d * outputs[f.output][1])
            fits.append(f)
        ends = tuple(b * spread + mean for b, (mean, spread) in zip(self.biases[last], outputs))
        return Formulas(self.n_inputs, (*self.biases[:last], ends), tuple(fits))

    def text(self, inputs: Sequence[str], outputs: Sequence[str]) -> list[str]:
        """A line for each node: all constants first, then a term for each edge that isn't constant; linear edges are multiplied out."""
        self._check(inputs, outputs)
        lines, names = [], [quoted(n) for n in inputs]
        for k, biases in enumerate(self.biases):
            heads = [quoted(n) for n in outputs] if k + 1 == len(self.biases) else [f"h{k + 1}_{j}" for j in range(len(biases))]
            for j, constant in enumerate(biases):
                terms = []
                for f in self.of(k, j):
                    constant += f.d + (f.a * f.c if f.name == "x" else 0.0)
                    if f.name == "x" and f.a * f.b:
                        terms.append((f.a * f.b, names[f.input]))
                    elif f.name not in ("x", "const"):
                        terms.append((f.a, _CALLS.get(f.name, f.name + "({})").format(argument(f.b, names[f.input], f.c))))
                lines.append(f"{heads[j]} = {number(constant)}" + "".join(f" {'-' if a < 0 else '+'} {number(abs(a))}·{body}" for a, body in terms))
            names = heads
        return lines

    def labels(self, fit: Fit, inputs: Sequence[str], outputs: Sequence[str]) -> tuple[str, str]:
        """Names of an edge's two ends: columns of the table at the outside, hidden nodes within."""
        self._check(inputs, outputs)
        return inputs[fit.input] if fit.layer == 0 else f"h{fit.layer}_{fit.input}", outputs[fit.output] if fit.layer + 1 == len(self.biases) else f"h{fit.layer + 1}_{fit.output}"

    def _check(self, inputs: Sequence[str], outputs: Sequence[str]) -> None:
        if (len(inputs), len(outputs)) != (self.n_inputs, len(self.biases[-1])):
            raise ValueError(f"{len(inputs)} inputs and {len(outputs)} outputs are named, the formulas have {self.n_inputs} and {len(self.biases[-1])}")

    def _layer(self, k: int, arriving: Sequence[Column]) -> list[Column]:
        return [sum((affine_edge(f.name, arriving[f.input], f.a, f.b, f.c, f.d) for f in self.of(k, j)), F.lit(float(b))) for j, b in enumerate(self.biases[k])]

    def columns(self, inputs: Sequence[Column]) -> list[Column]:
        """One Column for each output. Hidden nodes are written out wherever they are used; of deep networks ``predict`` makes shorter plans."""
        arriving = list(inputs)
        for k in range(len(self.biases)):
            arriving = self._layer(k, arriving)
        return arriving

    def predict(self, df: DataFrame, inputs: Sequence[str], keep: Sequence[str], names: Sequence[str]) -> DataFrame:
        """``keep`` and the outputs under ``names``, by a select for each layer."""
        arriving = [F.col(c).cast("double") for c in inputs]
        for k in range(len(self.biases)):
            last = k + 1 == len(self.biases)
            outs = list(names) if last else [f"_h{k + 1}_{j}" for j in range(len(self.biases[k]))]
            df = df.select(*keep, *[c.alias(n) for c, n in zip(self._layer(k, arriving), outs)])
            arriving = [F.col(n) for n in outs]
        return df

    def quality(self) -> tuple[float, float]:
        """(least, mean) R2 of the edges; without edges 1 and 1."""
        found = [f.r2 for f in self.fits]
        return (min(found), sum(found) / len(found)) if found else (1.0, 1.0)

    def weak(self, least: float = 0.99) -> list[Fit]:
        return [f for f in self.fits if f.r2 < least]


def symbolize(df: DataFrame, inputs: Sequence[str], layers: Sequence[dict], row_id: str, most: int = SAMPLE) -> Formulas:
    """Formulas of a spline network over ``df``, whose inputs are as the network takes them. All edges are fitted in the same jobs."""
    fits = symbolic.fit_edges(edge_samples(df, inputs, layers, row_id, most), KEYS).collect()  # a row for each edge
    order = sorted(fits, key=lambda r: (r["layer"], r["input"], r["output"]))
    return Formulas(len(inputs), tuple(tuple(map(float, layer["bias"])) for layer in layers), tuple(Fit(*(r[c] for c in [*KEYS, "name", "a", "b", "c", "d", "r2"])) for r in order))


def fidelity(df: DataFrame, inputs: Sequence[str], targets: Sequence[str], layers: Sequence[dict], found: Formulas, stats: Mapping[str, tuple[float, float]], row_id: str) -> DataFrame:
    """output, formulas_r2, network_r2: both on the same raw rows, for each target; ``stats`` has (mean, spread) of each column, ``found`` is raw."""
    scaled = df.select(row_id, *targets, *[((F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(f"_z{i}") for i, c in enumerate(inputs)], *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(inputs)])
    raw = [f"_x{i}" for i in range(len(inputs))]
    read = found.predict(scaled, raw, [row_id, *targets, *(f"_z{i}" for i in range(len(inputs)))], [f"_f{j}" for j in range(len(targets))])
    kept = [row_id, *targets, *(f"_f{j}" for j in range(len(targets)))]
    both = models.score(read, [f"_z{i}" for i in range(len(inputs))], list(layers), kept, "_n")
    net = ["_n"] if len(targets) == 1 else [f"_n{j}" for j in range(len(targets))]
    each = [F.struct(F.lit(t).alias("output"), F.col(t).cast("double").alias("target"), F.col(f"_f{j}").alias("formulas"), (F.col(net[j]) * F.lit(stats[t][1]) + F.lit(stats[t][0])).alias("network")) for j, t in enumerate(targets)]
    rows = both.select(F.inline(F.array(*each)))
    names = ["formulas", "network"]
    long = rows.select("output", "target", F.inline(F.array(*[F.struct(F.lit(n).alias("reading"), F.col(n).alias("pred")) for n in names])))
    unknown = metrics.scales(df.sparkSession, dict.fromkeys(targets))
    scores = metrics.per_output(long, _for_each(unknown, names), ["reading"])
    return scores.groupBy("output").agg(*[F.max(F.when(F.col("reading") == n, F.col("r2"))).alias(f"{n}_r2") for n in names])


def _for_each(scales: DataFrame, readings: Sequence[str]) -> DataFrame:
    """The scales, once for each reading."""
    return scales.select("*", F.explode(F.array(*map(F.lit, readings))).alias("reading"))
