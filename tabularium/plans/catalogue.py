"""The registered queries over the given tables, and DuckDB SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.ordering import with_rank
from ..operators import characters, curves, diagnostics, metrics, models, profile, provenance, scaling, schema, scoring, search, spline_search, split, symbolic
from ..sources import generators, text_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 5, **more: int) -> DataFrame:
    """Doubles rounded, so that two engines' sums in unlike order agree."""
    return df.select(*[F.round(c, more.get(c, digits)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _orders(spark, sf_dir):
    """row_id, x0, x1, y, priority of every order."""
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("double").alias("x0"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("x1"),
        F.col("o_totalprice").alias("y"), F.col("o_orderpriority").alias("priority"),
    )


_ORDERS = "o as (select o_orderkey as row_id, o_custkey::double as x0, date_diff('day', date '1992-01-01', o_orderdate::date)::double as x1, o_totalprice as y, o_orderpriority as priority from orders)"
_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# ---- profiles


_PROFILED = ["p_name", "p_brand", "p_type", "p_size"]
_NUM = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_IS_NUM = f"(regexp_matches(cell, '{_NUM}') and abs(try_cast(cell as double)) < 3.4028235677973366e38)"
_PROFILE_SQL = f"""
c as ({' union all '.join(f"select '{c}' as col, trim(coalesce({c}::varchar, '')) as cell from part" for c in _PROFILED)}
  union all select 'event_type', trim(coalesce(event_type, '')) from events union all select 'user_id', trim(coalesce(user_id::varchar, '')) from events),
pr as (select col as "column", count(*) as total, sum(case when cell = '' then 1 else 0 end)::bigint as missing,
  sum(case when cell <> '' and not {_IS_NUM} then 1 else 0 end)::bigint as non_numeric,
  count(distinct case when cell <> '' then cell end) as kinds from c group by col),
p2 as (select "column", total, missing, non_numeric, case when kinds <= 256 then kinds end as distinct_values,
  (non_numeric = 0 and missing < total) as is_numeric, (missing = 0 and kinds = 1) as is_constant from pr)
"""


def _profile(spark, sf_dir):
    return profile.profile_columns(_t(spark, sf_dir, "part"), _PROFILED).unionByName(profile.profile_columns(_t(spark, sf_dir, "events"), ["event_type", "user_id"]))


@query(f"with {_PROFILE_SQL} select * from p2")
def profile_columns(spark, sf_dir):
    return _profile(spark, sf_dir)


@query(f"""with {_PROFILE_SQL} select 'Warning' as severity, "column", missing::varchar || ' missing cells' as message from p2 where missing > 0
union all select 'Warning', "column", non_numeric::varchar || ' non-numeric cells' from p2 where non_numeric > 0
union all select 'Note', "column", 'constant column' from p2 where is_constant""")
def profile_messages(spark, sf_dir):
    return profile.profile_messages(_profile(spark, sf_dir))


@query(f"""with {_PROFILE_SQL} select "column", case when "column" = 'p_size' then 'output' else 'input' end as role, case when is_numeric then 'number' else 'category' end as kind from p2 where "column" like 'p!_%' escape '!'""")
def schema_draft(spark, sf_dir):
    """What a draft makes of the columns of part: the last is the output, what is no number is a category."""
    return schema.draft_fields(_t(spark, sf_dir, "part"), _PROFILED)


@query(f"""with {_PROFILE_SQL}, d as (select count(*) - count(distinct (p_name, p_brand, p_type, p_size)) as n from part)
select 'Warning' as severity, "column", missing::varchar || ' missing cells' as message from p2 where missing > 0 and "column" like 'p!_%' escape '!'
union all select 'Warning', "column", non_numeric::varchar || ' non-numeric cells' from p2 where non_numeric > 0 and "column" like 'p!_%' escape '!'
union all select 'Note', "column", 'constant column' from p2 where is_constant and "column" like 'p!_%' escape '!'
union all select 'Note', null, n::varchar || ' repeated rows' from d where n > 0""")
def table_messages(spark, sf_dir):
    """All that a reader of the table part should know, with repeated rows."""
    part = _t(spark, sf_dir, "part")
    ragged = part.agg(F.count_if(F.lit(False)).alias("n_ragged"))
    return schema.messages(profile.profile_columns(part, _PROFILED), ragged, profile.duplicate_rows(part, _PROFILED))


@query("""select count(*) as total_rows, (select count(*) from (select distinct l_returnflag, l_linestatus, l_linenumber, l_quantity from lineitem)) as distinct_rows,
count(*) - (select count(*) from (select distinct l_returnflag, l_linestatus, l_linenumber, l_quantity from lineitem)) as duplicate_rows from lineitem""")
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"])


@query("select p_brand as level, (row_number() over (order by p_brand) - 1)::int as code from (select distinct p_brand from part where trim(p_brand) <> '')")
def category_levels(spark, sf_dir):
    return profile.category_levels(_t(spark, sf_dir, "part"), "p_brand")


@query("select l_linenumber::varchar as level, (row_number() over (order by l_linenumber) - 1)::int as code from (select distinct l_linenumber from lineitem where l_linenumber is not null)")
def numeric_levels(spark, sf_dir):
    return profile.category_levels(_t(spark, sf_dir, "lineitem"), "l_linenumber")


@query("""with v as (select p_brand as level, (row_number() over (order by p_brand) - 1)::int as code from (select distinct p_brand from part where trim(p_brand) <> ''))
select p_partkey, v.code from part left join v on trim(p_brand) = v.level""")
def label_encode(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    return profile.label_encode(part, "p_brand", profile.category_levels(part, "p_brand"), ["p_partkey"])


@query("""with v as (select p_brand as level, (row_number() over (order by p_brand) - 1)::int as code from (select distinct p_brand from part where trim(p_brand) <> ''))
select code, level, count(*) as n from part join v on trim(p_brand) = v.level group by all""")
def label_decode(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    levels = profile.category_levels(part, "p_brand")
    codes = profile.label_encode(part, "p_brand", levels, ["p_partkey"])
    return codes.join(F.broadcast(levels), "code").groupBy("code", "level").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with c as (select user_id, trim(unnest(regexp_split_to_array(props, '[,:{{}}"]+'))) as cell from events)
select case when cell = '' then 'missing' when {_IS_NUM} then 'number' else 'text' end as kind, count(*) as n,
round(sum(case when {_IS_NUM} then cell::double end), 4) as total from c group by 1""")
def parse_cells(spark, sf_dir):
    cells = _t(spark, sf_dir, "events").select(F.explode(F.split("props", '[,:{}"]+', -1)).alias("c")).select(F.trim("c").alias("cell"))
    kind = F.when(numeric.is_missing(F.col("cell")), "missing").when(numeric.is_number(F.col("cell")), "number").otherwise("text")
    return rounded(cells.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(numeric.parse_number(F.col("cell"))).alias("total")), 4)


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
s as (select doc_id, regexp_replace(split_part(line, '#', 1), '^\\s+|\\s+$', '', 'g') as line from l)
select doc_id, count(*) as n_rows, sum(len(string_split(line, ',')))::bigint as n_cells, max(len(string_split(line, ',')))::int as widest,
sum(len(list_filter(string_split(line, ','), lambda c: trim(c) = '')))::bigint as empty_cells from s where line <> '' group by doc_id""")
def text_table_cells(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    cells = text_table.surviving(lines).select("doc_id", text_table.split_cells(F.col("value"), ",").alias("cells"))
    return cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("cells")).alias("n_cells"), F.max(F.size("cells")).alias("widest"), F.sum(F.size(F.filter("cells", lambda c: c == ""))).alias("empty_cells"))


@query("""with l as (select doc_id, string_split(unnest(string_split(text, chr(10))), ',') as cells, generate_subscripts(string_split(text, chr(10)), 1) as row_no from documents),
f as (select doc_id, arg_min(len(cells), row_no) as wide from l group by doc_id)
select l.doc_id, count(*) as ragged from l join f using (doc_id) where len(cells) <> wide group by l.doc_id""")
def ragged_rows(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    cells = lines.select("doc_id", "row_no", F.size(F.split("line", ",", -1)).alias("n"))
    first = cells.groupBy("doc_id").agg(F.min_by("n", "row_no").alias("wide"))
    return cells.join(first, "doc_id").where("n <> wide").groupBy("doc_id").agg(F.count(F.lit(1)).alias("ragged"))


@query("""select 'p_partkey' as "column", true as is_category, max(p_partkey) + 1 as cardinality from part union all
select 'p_size', true, max(p_size)::bigint + 1 from part union all
select 'p_retailprice', bool_and(abs(p_retailprice - round(p_retailprice)) <= 1e-4 and p_retailprice >= 0),
  case when bool_and(abs(p_retailprice - round(p_retailprice)) <= 1e-4 and p_retailprice >= 0) then round(max(p_retailprice))::bigint + 1 end from part""")
def category_inference(spark, sf_dir):
    return text_table.category_sizes(_t(spark, sf_dir, "part"), ["p_partkey", "p_size", "p_retailprice"])


@query("select o_orderkey as row_id, concat_ws(' ', o_orderkey::varchar, o_custkey::varchar, o_orderstatus) as line from orders")
def typed_lines(spark, sf_dir):
    return text_table.data_lines(_t(spark, sf_dir, "orders"), "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("""select p_partkey as row_id, 'p_size' as "column", p_size::double as value from part where p_size < 0 or p_size >= 40
union all select p_partkey, 'p_retailprice', p_retailprice from part where p_retailprice is null or abs(p_retailprice - round(p_retailprice)) > 1e-4 or round(p_retailprice) < 0 or round(p_retailprice) >= 1000""")
def invalid_codes(spark, sf_dir):
    return text_table.bad_codes(_t(spark, sf_dir, "part"), "p_partkey", {"p_size": 40, "p_retailprice": 1000})


def _pairs_sql():
    cols = sorted(_LINE)
    one = "select '{a}' as x, '{b}' as y, round(regr_slope({b}, {a}), 5) as slope, round(regr_intercept({b}, {a}), 5) as intercept, round(regr_r2({b}, {a}), 7) as r2 from lineitem"
    return " union all ".join(one.format(a=a, b=b) for a in cols for b in cols if a < b)


@query(_pairs_sql())
def affine_pairs(spark, sf_dir):
    return rounded(profile.affine_pairs(_t(spark, sf_dir, "lineitem"), sorted(_LINE)), 5, r2=7)


@query("""select 'l_quantity' as target, 1 as n_terms, regr_r2(l_quantity, 100 - l_quantity) >= 0.999999 as is_exact from lineitem
union all select 'l_extendedprice', 1, regr_r2(l_extendedprice, l_extendedprice * 0.9 + 3) >= 0.999999 from lineitem""")
def affine_dependency(spark, sf_dir):
    """Two columns of lineitem are found as exact functions of the one that was made of each: the first in order is the target."""
    lines = _t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", (F.lit(100.0) - F.col("l_quantity")).alias("rest"), (F.col("l_extendedprice") * F.lit(0.9) + F.lit(3.0)).alias("net"))
    found = profile.affine_dependencies(lines, ["l_quantity", "l_extendedprice", "rest", "net"])
    return found.select("target", F.size(F.filter("terms", lambda t: F.abs(t["coefficient"]) > 0.01)).alias("n_terms"), "is_exact")


# ---- normalizers and ranges


@query(" union all ".join(f"select '{c}' as feature, round(avg({c}), 5) as mean, round(greatest(stddev_pop({c}), 1e-8), 5) as std, min({c}) as low, max({c}) as high from lineitem" for c in _LINE))
def normalizer_fit(spark, sf_dir):
    return rounded(scaling.fit(_t(spark, sf_dir, "lineitem"), _LINE))


@query(f"with {_ORDERS} select row_id, round((x0 - (select avg(x0) from o)) / (select stddev_pop(x0) from o), 6) as z0, round((y - (select avg(y) from o)) / (select stddev_pop(y) from o), 6) as zy from o")
def zscore(spark, sf_dir):
    o = _orders(spark, sf_dir)
    stats = scaling.literals(scaling.fit(o, ["x0", "y"]))
    return rounded(o.select("row_id", scaling.transform("x0", stats).alias("z0"), scaling.transform("y", stats).alias("zy")), 6)


@query(f"with {_ORDERS} select row_id, round(x0, 4) as x0, round(y, 4) as y from o")
def inverse_zscore(spark, sf_dir):
    o = _orders(spark, sf_dir)
    stats = scaling.literals(scaling.fit(o, ["x0", "y"]))
    return rounded(o.select("row_id", *[scaling.inverse(scaling.transform(c, stats), c, stats).alias(c) for c in ("x0", "y")]), 4)


_RANGES = _ORDERS + ", s as (select min(x0) as l0, max(x0) as h0, min(x1) as l1, max(x1) as h1 from o where priority in ('1-URGENT', '2-HIGH') and x1 < 1200)"


def _urgent(o):
    """Ranges of the urgent orders of the first years: later ones are outside."""
    return scaling.literals(scaling.fit(o.where(F.col("priority").isin("1-URGENT", "2-HIGH") & (F.col("x1") < 1200)), ["x0", "x1"]))


@query(f"with {_RANGES} select row_id, 'x0' as feature, x0 as value, l0 as low, h0 as high from o, s where x0 < l0 or x0 > h0 union all select row_id, 'x1', x1, l1, h1 from o, s where x1 < l1 or x1 > h1")
def out_of_range(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return scaling.out_of_range(o, "row_id", ["x0", "x1"], _urgent(o))


@query(f"with {_RANGES} select count(*) as total, count(*) filter (x0 < l0 or x0 > h0 or x1 < l1 or x1 > h1) as rows_out, count(*) filter (x0 < l0 or x0 > h0) as outside_x0, count(*) filter (x1 < l1 or x1 > h1) as outside_x1 from o, s")
def range_report(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return scaling.range_report(o, ["x0", "x1"], _urgent(o))


# ---- splits


def _rank_sql(seed: int, source: str) -> str:
    return f"select row_id, row_number() over (order by md5('{seed}:' || row_id::varchar), row_id) - 1 as place, count(*) over () as n from {source}"


_HOLDOUT = f"{_ORDERS}, h as (select row_id, case when place < round(n * 0.7::double) then 'train' when place < round(n * 0.7::double) + round(n * 0.15::double) then 'val' else 'test' end as part from ({_rank_sql(1, 'o')}))"
_FOLD = "(case when place < (n % 5) * (n // 5 + 1) then place // (n // 5 + 1) else n % 5 + (place - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) end)::int"
_KFOLD = f"{_ORDERS}, d as ({_rank_sql(1, 'o')}), pool as (select row_id from d where place >= round(n * 0.15::double)), k as (select row_id, 'pool' as part, {_FOLD} as fold from ({_rank_sql(2, 'pool')}) union all select row_id, 'test', null from d where place < round(n * 0.15::double))"


@query(f"with {_HOLDOUT} select row_id, part from h")
def holdout_split(spark, sf_dir):
    return split.holdout(_orders(spark, sf_dir), "row_id")


@query(f"with {_KFOLD} select row_id, part, fold from k")
def kfold_split(spark, sf_dir):
    return split.kfold(_orders(spark, sf_dir), "row_id")


@query(f"with {_KFOLD} select part, fold, count(*) as n from k group by all")
def fold_sizes(spark, sf_dir):
    return split.kfold(_orders(spark, sf_dir), "row_id").groupBy("part", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_KFOLD} " + " union all ".join(f"select row_id, {r} as repeat, {_FOLD} as fold from ({_rank_sql(split.repeat_seed(2, r), 'pool')})" for r in range(3)))
def repeated_kfold_split(spark, sf_dir):
    return split.repeated_kfold(_orders(spark, sf_dir), "row_id")


@query(f"with {_HOLDOUT} select row_id from h where part = 'train' union select row_id from h where part = 'val'")
def refit_pool(spark, sf_dir):
    """Train and validation rows together, as a final fit uses them."""
    return split.refit_pool(split.holdout(_orders(spark, sf_dir), "row_id"))


@query(f"with {_KFOLD}, f as (select unnest(range(5))::int as fold) select f.fold, 'x0' as feature, round(avg(x0), 5) as mean, round(greatest(stddev_pop(x0), 1e-8), 5) as std, min(x0) as low, max(x0) as high from f, k join o using (row_id) where k.part = 'pool' and k.fold <> f.fold group by f.fold union all select f.fold, 'y', round(avg(y), 5), round(greatest(stddev_pop(y), 1e-8), 5), min(y), max(y) from f, k join o using (row_id) where k.part = 'pool' and k.fold <> f.fold group by f.fold")
def fold_normalizers(spark, sf_dir):
    """Normalizers of each fold's training rows: what is in every other fold."""
    o = _orders(spark, sf_dir)
    rows = o.join(split.kfold(o, "row_id").where("part = 'pool'").select("row_id", F.col("fold").alias("own")), "row_id")
    return rounded(scaling.fit_without(rows, ["x0", "y"], "own").withColumnRenamed("own", "fold"))


# ---- metrics


_PREDS = """p as (select p_partkey as row_id, 'price' as output, 1000 + 10 * p_size::double as pred, p_retailprice as target from part union all
select p_partkey, 'size', p_retailprice / 40, p_size::double from part),
s as (select output, stddev_pop(target) as sigma from p group by output),
m as (select p.output, sqrt(avg((pred - target) ** 2)) as rmse, avg(abs(pred - target)) as mae,
 case when var_pop(target) * count(*) <= 1e-12 then 0 else 1 - sum((pred - target) ** 2) / (var_pop(target) * count(*)) end as r2,
 case when max(sigma) > 0 then avg(abs(pred - target)) / max(sigma) end as nmae, case when max(sigma) > 0 then sqrt(avg((pred - target) ** 2)) / max(sigma) end as nrmse,
 case when max(case when abs(target) <= 1e-3 * sigma then 1 else 0 end) = 0 then avg(abs(pred - target) / abs(target)) end as rel_error from p join s using (output) group by p.output)"""


def _predictions(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    two = F.array(F.struct(F.lit("price").alias("output"), (F.lit(1000.0) + F.lit(10.0) * size).alias("pred"), price.alias("target")), F.struct(F.lit("size").alias("output"), (price / F.lit(40.0)).alias("pred"), size.alias("target")))
    rows = part.select(F.col("p_partkey").alias("row_id"), F.inline(two))
    return rows, rows.groupBy("output").agg(F.stddev_pop("target").alias("sigma"))


@query(f"with {_PREDS} select output, round(rmse, 6) as rmse, round(mae, 6) as mae, round(r2, 6) as r2, round(nmae, 6) as nmae, round(nrmse, 6) as nrmse, round(rel_error, 6) as rel_error from m")
def metrics_per_output(spark, sf_dir):
    return rounded(metrics.per_output(*_predictions(spark, sf_dir)), 6)


@query(f"with {_PREDS} select round(sqrt(avg((pred - target) ** 2)), 6) as rmse, round(avg(abs(pred - target)), 6) as mae, round(1 - sum((pred - target) ** 2) / (var_pop(target) * count(*)), 6) as r2, (select round(case when count(nmae) = count(*) then avg(nmae) end, 6) from m) as nmae, (select round(case when count(nrmse) = count(*) then avg(nrmse) end, 6) from m) as nrmse, (select round(case when count(rel_error) = count(*) then avg(rel_error) end, 6) from m) as rel_error from p")
def metrics_aggregate(spark, sf_dir):
    rows, scales = _predictions(spark, sf_dir)
    return rounded(metrics.overall(rows, metrics.per_output(rows, scales)), 6)


@query(f"""with {_PREDS}, a as (select 1 - sum((pred - target) ** 2) / (var_pop(target) * count(*)) as r2 from p),
w as (select count(*) as outputs, min(r2) as worst, arg_min(output, (r2, output)) as worst_output, case when count(nmae) = count(*) then avg(nmae) end as nmae, case when count(nrmse) = count(*) then avg(nrmse) end as nrmse, case when count(rel_error) = count(*) then avg(rel_error) end as rel_error from m)
select outputs, null::double as rmse, null::double as mae, round(r2, 6) as r2, round(nmae, 6) as nmae, round(nrmse, 6) as nrmse, round(rel_error, 6) as rel_error, worst_output, round(worst, 6) as worst_r2 from w, a""")
def metrics_report(spark, sf_dir):
    rows, scales = _predictions(spark, sf_dir)
    each = metrics.per_output(rows, scales)
    return rounded(metrics.report(each, metrics.overall(rows, each)), 6)


@query("select 'l_quantity' as output, round(stddev_pop(l_quantity), 6) as sigma from lineitem union all select 'l_tax', round(stddev_pop(l_tax), 6) from lineitem")
def target_scale(spark, sf_dir):
    return rounded(metrics.target_scale(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]), 6)


_RUNS = "r as (select l_returnflag as candidate, l_linenumber % 2 as seed, l_suppkey % 2 as repeat, l_partkey % 3 as fold, 1 - avg(l_discount) - avg(l_tax) as r2 from lineitem group by all)"
_OVER = """a as (select candidate, seed, repeat, avg(r2) as r2, stddev_pop(r2) as sf, count(*) as folds from r group by all),
b as (select candidate, seed, avg(r2) as r2, avg(sf) as sf, stddev_pop(r2) as sr, count(*) as repeats, min(folds) as few, max(folds) as many from a group by all),
c as (select candidate, avg(r2) as r2_mean, avg(sf) as r2_std_folds, avg(sr) as r2_std_repeats, stddev_pop(r2) as r2_std_seeds, count(*) as seeds, max(repeats) as repeats, max(many) as folds, (min(few) = max(many) and min(repeats) = max(repeats)) as is_complete from b group by candidate)"""


def _runs(spark, sf_dir):
    """Runs by seed, repeat and fold, whose score is a mean of lineitem."""
    line = _t(spark, sf_dir, "lineitem")
    keys = [F.col("l_returnflag").alias("candidate"), (F.col("l_linenumber") % 2).alias("seed"), (F.col("l_suppkey") % 2).alias("repeat"), (F.col("l_partkey") % 3).alias("fold")]
    return line.groupBy(*keys).agg((F.lit(1.0) - F.avg("l_discount") - F.avg("l_tax")).alias("r2"))


@query(f"with {_RUNS}, {_OVER} select candidate, round(r2_mean, 7) as r2_mean, round(r2_std_folds, 7) as r2_std_folds, round(r2_std_repeats, 7) as r2_std_repeats, round(r2_std_seeds, 7) as r2_std_seeds, seeds, repeats, folds, is_complete from c")
def cv_aggregate(spark, sf_dir):
    return rounded(metrics.over_runs(_runs(spark, sf_dir), ["candidate"]), 7)


@query(f"""with {_RUNS}, w as (select * from r where not (seed = 1 and repeat = 1 and fold = 2)), s as (select unnest([0, 1, 2])::bigint as seed), p as (select unnest([0, 1])::bigint as repeat),
plan as (select candidate, s.seed, p.repeat from (select distinct candidate from w), s, p), h as (select candidate, seed, repeat, count(*) as n from w group by all)
select plan.candidate, plan.seed, plan.repeat, case when n is null then 'no runs' else 'folds are missing or not of the plan' end as problem from plan left join h on h.candidate = plan.candidate and h.seed = plan.seed and h.repeat = plan.repeat where n is null or n <> 3""")
def incomplete_runs(spark, sf_dir):
    """What a plan of three seeds, two repeats and three folds lacks, if one run is left out."""
    own = _runs(spark, sf_dir).where("not (seed = 1 and repeat = 1 and fold = 2)")
    return metrics.run_problems(own, ["candidate"], [0, 1, 2], 3, 2)


@query(f"with {_RUNS}, {_OVER} select candidate, round(r2_mean, 7) as r2_mean, row_number() over (order by round(r2_mean, 7) desc nulls last, candidate)::int as place from c")
def search_rank(spark, sf_dir):
    from pyspark.sql import Window

    scored = rounded(metrics.over_runs(_runs(spark, sf_dir), ["candidate"]), 7)
    # one row for each candidate of a search
    return scored.select("candidate", "r2_mean", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*metrics.best_first("r2_mean", "candidate"))).alias("place"))


@query(f"""with {_HOLDOUT}, f as (select regr_slope(y, x0) as b, regr_intercept(y, x0) as a, stddev_pop(y) as sigma from o join h using (row_id) where part = 'train'),
v as (select y as target, a + b * x0 as pred, sigma from o join h using (row_id), f where part = 'val')
select 'y' as output, round(sqrt(avg((pred - target) ** 2)), 4) as rmse, round(avg(abs(pred - target)), 4) as mae, round(1 - sum((pred - target) ** 2) / (var_pop(target) * count(*)), 6) as r2,
round(avg(abs(pred - target)) / max(sigma), 6) as nmae, round(sqrt(avg((pred - target) ** 2)) / max(sigma), 6) as nrmse,
round(case when max(case when abs(target) <= 1e-3 * sigma then 1 else 0 end) = 0 then avg(abs(pred - target) / abs(target)) end, 6) as rel_error from v""")
def baseline_metrics(spark, sf_dir):
    """Holdout, an affine baseline from the training part, its scores on the validation part."""
    o = _orders(spark, sf_dir)
    rows = o.join(split.holdout(o, "row_id"), "row_id")
    fit = rows.where("part = 'train'").agg(F.regr_slope("y", "x0").alias("b"), F.regr_intercept("y", "x0").alias("a"), F.stddev_pop("y").alias("sigma"))
    preds = rows.where("part = 'val'").join(F.broadcast(fit)).select(F.lit("y").alias("output"), (F.col("a") + F.col("b") * F.col("x0")).alias("pred"), F.col("y").alias("target"))
    scales = fit.select(F.lit("y").alias("output"), "sigma")
    return rounded(metrics.per_output(preds, scales), 6, rmse=4, mae=4)


# ---- diagnostics


_RES = f"{_ORDERS}, e as (select row_id, x0, x1, y - (select avg(y) from o) as e from o)"


def _residuals(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.join(F.broadcast(o.agg(F.avg("y").alias("m")))).select("row_id", "x0", "x1", (F.col("y") - F.col("m")).alias("e"))


@query(f"with {_RES} " + " union all ".join(f"select '{x}' as feature, round(count(*) filter (e * p < 0) / (count(*) - 1)::double, 8) as sign_change_rate from (select e, lag(e) over (order by {x}, row_id) as p from e)" for x in ("x0", "x1")))
def residual_sign_change(spark, sf_dir):
    rows = _residuals(spark, sf_dir)
    return rounded(diagnostics.sign_changes(rows, "x0", "row_id", "e").unionByName(diagnostics.sign_changes(rows, "x1", "row_id", "e")), 8)


@query(f"with {_RES} " + " union all ".join(f"select '{x}' as feature, round(avg(case when k < n // 10 or k >= n - n // 10 then abs(e) end) / avg(case when k >= n // 5 and k < n - n // 5 then abs(e) end), 6) as tail_ratio from (select e, row_number() over (order by {x}, row_id) - 1 as k, count(*) over () as n from e)" for x in ("x0", "x1")))
def tail_ratio(spark, sf_dir):
    rows = _residuals(spark, sf_dir)
    return rounded(diagnostics.tail_ratio(rows, "x0", "row_id", "e").unionByName(diagnostics.tail_ratio(rows, "x1", "row_id", "e")), 6)


_INTER = """io as (select row_id, k - (b * n // m) as off, b from (select *, ((k + 1) * m + n - 1) // n - 1 as b from (
  select *, least(300, n) as m from (select p_partkey as row_id, row_number() over (order by p_partkey) - 1 as k, count(*) over () as n from part)))),
i as (select row_id, b::bigint as turn from io where off = 0)"""


@query(f"with {_INTER} select row_id, turn from i")
def interleaved_rows(spark, sf_dir):
    return diagnostics.interleaved(_t(spark, sf_dir, "part"), "p_partkey", 300)


_NEAR = f"""{_INTER}, z as (select p_partkey as id, p_brand as cat, (p_size - (select avg(p_size) from part)) / (select stddev_pop(p_size) from part) as s, (p_retailprice - (select avg(p_retailprice) from part)) / (select stddev_pop(p_retailprice) from part) as p from part),
apart as (select cat from z group by cat having max(s) - min(s) > 2e-9 or max(p) - min(p) > 2e-9),
bases as (select row_id from io join z on row_id = id where cat in (select cat from apart) order by off, b limit 300),
q as (select a.id as base_id, b.id as other_id, sqrt((b.s - a.s) ** 2 + (b.p - a.p) ** 2) as distance from z a join bases on a.id = bases.row_id join z b on a.cat = b.cat),
n as (select base_id, arg_min(other_id, (round(distance, 9), other_id)) as other_id, min(distance) as distance from q where distance > 1e-9 group by base_id)"""


def _scaled_parts(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    stats = scaling.literals(scaling.fit(part, ["p_size", "p_retailprice"]))
    return part.select("p_partkey", "p_brand", scaling.transform("p_size", stats).alias("s"), scaling.transform("p_retailprice", stats).alias("p"))


@query(f"with {_NEAR} select base_id, round(distance, 6) as distance from n")
def nearest_pair(spark, sf_dir):
    """For 300 spread-out parts the distance to the nearest other part of the brand (300 is the diagnostic's own sample)."""
    return rounded(diagnostics.nearest_rows(_scaled_parts(spark, sf_dir), "p_partkey", "p_brand", ["s", "p"]), 6).select("base_id", "distance")


@query(f"""with {_NEAR}, r as (select abs(2 * (b.s - a.s) + 0.5 * (b.p * b.p - a.p * a.p)) / sqrt((b.s - a.s) ** 2 + (b.p - a.p) ** 2) as ratio from n join z a on a.id = base_id join z b on b.id = other_id)
select count(*) as pairs, round(avg(ratio), 5) as mean_ratio, round(max(ratio), 5) as max_ratio from r""")
def sensitivity(spark, sf_dir):
    z = _scaled_parts(spark, sf_dir)
    near = diagnostics.nearest_rows(z, "p_partkey", "p_brand", ["s", "p"])
    a = z.select(F.col("p_partkey").alias("base_id"), F.col("s").alias("a_s"), F.col("p").alias("a_p"))
    b = z.select(F.col("p_partkey").alias("other_id"), F.col("s").alias("b_s"), F.col("p").alias("b_p"))
    pairs = near.join(a, "base_id").join(b, "other_id")
    return rounded(diagnostics.sensitivity(pairs, ["s", "p"], lambda v: F.lit(2.0) * v[0] + F.lit(0.5) * v[1] * v[1]), 5)


@query(f"""with {_NEAR}, r as (select sqrt((abs(2 * (b.s - a.s) + 0.5 * (b.p * b.p - a.p * a.p)) / 4) ** 2 + (((b.s - a.s) - (b.p - a.p)) / 0.5) ** 2) / sqrt((b.s - a.s) ** 2 + (b.p - a.p) ** 2) as ratio from n join z a on a.id = base_id join z b on b.id = other_id)
select count(*) as pairs, round(avg(ratio), 5) as mean_ratio, round(max(ratio), 5) as max_ratio from r""")
def sensitivity_of_outputs(spark, sf_dir):
    """Two outputs, each in units of its own spread."""
    z = _scaled_parts(spark, sf_dir)
    near = diagnostics.nearest_rows(z, "p_partkey", "p_brand", ["s", "p"])
    a = z.select(F.col("p_partkey").alias("base_id"), F.col("s").alias("a_s"), F.col("p").alias("a_p"))
    b = z.select(F.col("p_partkey").alias("other_id"), F.col("s").alias("b_s"), F.col("p").alias("b_p"))
    pairs = near.join(a, "base_id").join(b, "other_id")
    return rounded(diagnostics.sensitivity(pairs, ["s", "p"], lambda v: [F.lit(2.0) * v[0] + F.lit(0.5) * v[1] * v[1], v[0] - v[1]], 1.0, [4.0, 0.5]), 5)


@query(f"""with {_NEAR}, r as (select abs(2 * (b.s - a.s) + 0.5 * (b.p * b.p - a.p * a.p)) / sqrt((b.s - a.s) ** 2 + (b.p - a.p) ** 2) as m, abs((b.s - a.s) + (b.p - a.p)) / sqrt((b.s - a.s) ** 2 + (b.p - a.p) ** 2) as t from n join z a on a.id = base_id join z b on b.id = other_id)
select count(*) as pairs, round(avg(m), 5) as mean_ratio, round(max(m), 5) as max_ratio, round(avg(t), 5) as reference_mean, round(max(t), 5) as reference_max, round(abs(avg(m) - avg(t)), 5) as divergence from r""")
def sensitivity_of_both(spark, sf_dir):
    """A model and the process it stands for, on the same pairs."""
    z = _scaled_parts(spark, sf_dir)
    near = diagnostics.nearest_rows(z, "p_partkey", "p_brand", ["s", "p"])
    a = z.select(F.col("p_partkey").alias("base_id"), F.col("s").alias("a_s"), F.col("p").alias("a_p"))
    b = z.select(F.col("p_partkey").alias("other_id"), F.col("s").alias("b_s"), F.col("p").alias("b_p"))
    pairs = near.join(a, "base_id").join(b, "other_id")
    return rounded(diagnostics.sensitivity_report(pairs, ["s", "p"], lambda v: F.lit(2.0) * v[0] + F.lit(0.5) * v[1] * v[1], lambda v: v[0] + v[1]), 5)


_EDGES = "g as (select l_returnflag as layer, l_linestatus || l_linenumber::varchar as edge, arg_min(v, k) as importance from (select l_returnflag, l_linestatus, l_linenumber, l_extendedprice as v, row_number() over w as k, round((count(*) over (partition by l_returnflag, l_linestatus, l_linenumber) - 1) * 0.95::double) + 1 as want from lineitem window w as (partition by l_returnflag, l_linestatus, l_linenumber order by l_extendedprice)) where k >= want group by all)"


def _edges(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("layer"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("edge"), F.col("l_extendedprice").alias("v"))
    return diagnostics.nearest_rank(rows, ["layer", "edge"], "v")


@query(f"with {_EDGES} select layer, edge, importance from g")
def edge_p95(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"with {_EDGES} select layer, edge, importance, importance >= 0.98 * max(importance) over (partition by layer) as is_active from g")
def prune_edges(spark, sf_dir):
    return diagnostics.prune(_edges(spark, sf_dir), ["layer"], 0.98)


# ---- curves


_CURVE = "c as (select user_id % 50 as run, user_id % 3 as split, (extract(hour from ts) * 1)::int as epoch, 1 - 1 / (1 + avg(abs(value)) * (1 + extract(hour from ts)) / 40.0::double) as r2 from events group by 1, 2, 3, extract(hour from ts))"


def _curve(spark, sf_dir):
    """Curves by run and split whose epochs are hours of events."""
    e = _t(spark, sf_dir, "events")
    hour = F.hour("ts")
    return e.groupBy((F.col("user_id") % 50).alias("run"), (F.col("user_id") % 3).alias("split"), hour.alias("epoch")).agg(
        (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.avg(F.abs("value")) * (F.lit(1.0) + F.col("epoch")) / F.lit(40.0))).alias("r2"))


@query(f"""with {_CURVE}, r as (select run, split, epoch, round(r2, 9) as r2, lead(round(r2, 9)) over (partition by run, split order by epoch) as nx from c)
select run, split, coalesce(min(case when r2 >= 0.95 then epoch end), min(case when r2 >= 0.8 and nx - r2 < 0.02 then epoch end), max(epoch)) as epoch from r group by run, split""")
def recommended_epoch(spark, sf_dir):
    return curves.recommended_epoch(rounded(_curve(spark, sf_dir), 9), ["run", "split"])


@query(f"with {_CURVE} select run, split, epoch, round(r2, 7) as r2 from c where epoch % 5 = 0")
def scheduled_epochs(spark, sf_dir):
    """Points of a schedule of every fifth epoch."""
    schedule = curves.Schedule(every=5)
    schedule.check(24)
    return rounded(_curve(spark, sf_dir).where(schedule.wants(F.col("epoch"))), 7)


@query(f"""with {_CURVE}, n as (select run, count(distinct split) as k from c group by run)
select run, epoch, round(avg(r2), 7) as r2, count(distinct split) as splits from c join n using (run) group by run, epoch, k having count(distinct split) = k""")
def mean_curve(spark, sf_dir):
    return rounded(curves.mean_curve(_curve(spark, sf_dir), ["run"], "split"), 7)


@query(f"""with {_CURVE}, b as (select run, split, epoch, round(r2, 9) as r2, max(round(r2, 9)) over (partition by run, split order by epoch rows between unbounded preceding and 1 preceding) as best, row_number() over (partition by run, split order by epoch) as place from c),
s as (select *, place - max(case when best is null or r2 > best then place end) over (partition by run, split order by epoch) as since from b),
t as (select *, min(case when since >= 3 then epoch end) over (partition by run, split) as stop from s)
select run, split, arg_max(epoch, (r2, -epoch)) as best_epoch, max(r2) as best_r2, max(stop) as stop_epoch from t where stop is null or epoch <= stop group by run, split""")
def early_stop(spark, sf_dir):
    return curves.early_stop(rounded(_curve(spark, sf_dir), 9), ["run", "split"], 3)


@query(f"""with recursive {_CURVE}, b as (select run, split, epoch, round(r2, 9) as r2, row_number() over (partition by run, split order by epoch) as place from c),
f as (select run, split, place, r2 as accepted, 0 as since, epoch as best_epoch, r2 as best_r2, null::int as stop from b where place = 1
union all select b.run, b.split, b.place, case when b.r2 > accepted + 0.01 then b.r2 else accepted end, case when b.r2 > accepted + 0.01 then 0 else since + 1 end,
  case when b.r2 > best_r2 then b.epoch else best_epoch end, greatest(b.r2, best_r2), case when b.r2 <= accepted + 0.01 and since + 1 >= 2 then b.epoch end
  from f join b on b.run = f.run and b.split = f.split and b.place = f.place + 1 where f.stop is null)
select run, split, arg_max(best_epoch, place) as best_epoch, max(best_r2) as best_r2, max(stop) as stop_epoch from f group by run, split""")
def early_stop_least_gain(spark, sf_dir):
    """Stops two points after the last gain of more than a hundredth; small gains add up."""
    return curves.early_stop(rounded(_curve(spark, sf_dir), 9), ["run", "split"], 2, 0.01)


@query(f"""with {_CURVE}, w as (select *, min(r2) over (partition by run, split) as lo, max(r2) over (partition by run, split) as hi from c)
select run, split, epoch, substr('▁▂▃▄▅▆▇█', least(8, round(round((r2 - lo) / greatest(hi - lo, 1e-12), 9) * 7) + 1)::int, 1) as glyph from w""")
def spark_lines(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("run", "split")
    rows = _curve(spark, sf_dir).select("run", "split", "epoch", "r2", F.min("r2").over(w).alias("lo"), F.max("r2").over(w).alias("hi"))
    share = F.round((F.col("r2") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)), 9)
    return rows.select("run", "split", "epoch", curves.spark_line(share, F.lit(0.0), F.lit(1.0)).alias("glyph"))


@query(f"with {_ORDERS}, r as (select row_id, row_number() over (order by row_id) - 1 as step, count(*) over () as n from o) select row_id, round(case when step < 100 then (step + 1) / 100.0::double else 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (step - 100) / 900.0::double))) end, 8) as share from r")
def lr_schedule(spark, sf_dir):
    """The rate at each row's place, if rows were steps: warm-up over 100, cosine to a tenth at 1000."""
    rows = with_rank(_orders(spark, sf_dir).select("row_id"), "row_id", "row_id")
    return rounded(rows.select("row_id", numeric.warmup_cosine((F.col("rank") - 1).cast("double"), 100, 1000, 0.1).alias("share")), 8)


# ---- models


@query("select p_partkey, round(0.5::double * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715::double * x * x * x))), 8) as g, round(sin(x), 8) as s, round(exp(least(x, 15.0::double)), 6) as e, round(ln(greatest(x, 1e-6)), 8) as l, round(tanh(x), 8) as t, round(sqrt(greatest(x, 0.0::double)), 8) as q from (select p_partkey, (p_size - 25) / 10.0::double as x from part)")
def activations(spark, sf_dir):
    x = (F.col("p_size") - F.lit(25.0)) / F.lit(10.0)
    p = _t(spark, sf_dir, "part")
    return rounded(p.select("p_partkey", numeric.gelu(x).alias("g"), *[numeric.primitive(n, x).alias(a) for n, a in (("sin", "s"), ("exp", "e"), ("log", "l"), ("tanh", "t"), ("sqrt", "q"))]), 8, e=6)


def _bspline_sql(x: str, grid: int) -> list[str]:
    step = 6.0 / grid
    out = []
    for i in range(grid + 3):
        t = f"abs({x} - ({-3.0 + step * (i - 1)})::double) / {step}::double"
        out.append(f"(case when {t} < 1 then 2.0::double / 3 - ({t}) * ({t}) + 0.5 * ({t}) * ({t}) * ({t}) when {t} < 2 then (2 - {t}) * (2 - {t}) * (2 - {t}) / 6 else 0 end)")
    return out


_X = "((p_size - 25) / 10.0::double)"


@query(f"select p_partkey, i as basis, round([{', '.join(_bspline_sql(_X, 5))}][i + 1], 8) as value from part, (select unnest(range(8))::int as i)")
def bspline_basis(spark, sf_dir):
    x = (F.col("p_size") - F.lit(25.0)) / F.lit(10.0)
    return rounded(_t(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(*numeric.bspline(x, 5))).alias("basis", "value")), 8)


_DENSE = {"weights": [[0.5, -0.3], [0.2, 0.8]], "bias": [0.1, -0.2]}


@query("""with z as (select p_partkey, (p_size - 25) / 10.0::double as a, (p_retailprice - 1000) / 500.0::double as b from part),
h as (select p_partkey, a * 0.5 + b * 0.2 + 0.1 as u, a * -0.3 + b * 0.8 - 0.2 as v from z),
g as (select p_partkey, 0.5::double * u * (1 + tanh(sqrt(2 / pi()) * (u + 0.044715::double * u * u * u))) as u, 0.5::double * v * (1 + tanh(sqrt(2 / pi()) * (v + 0.044715::double * v * v * v))) as v from h)
select p_partkey, round(u * 1.5 - v * 0.7 + 0.3, 7) as pred from g""")
def dense_score(spark, sf_dir):
    """A network with pinned weights, as a select for each layer."""
    z = _t(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") - F.lit(25.0)) / F.lit(10.0)).alias("a"), ((F.col("p_retailprice") - F.lit(1000.0)) / F.lit(500.0)).alias("b"))
    layers = [{"kind": "dense", **_DENSE, "activate": True}, {"kind": "dense", "weights": [[1.5], [-0.7]], "bias": [0.3], "activate": False}]
    return rounded(models.score(z, ["a", "b"], layers, ["p_partkey"]), 7)


_W = [0.2, -0.1, 0.4, 0.3, -0.5, 0.6, 0.1, -0.2]


@query(f"select p_partkey, round(0.25 + 0.7 * (0.5::double * {_X} * (1 + tanh(sqrt(2 / pi()) * ({_X} + 0.044715::double * {_X} * {_X} * {_X})))) + " + " + ".join(f"({w}) * {b}" for w, b in zip(_W, _bspline_sql(_X, 5))) + ", 7) as pred from part")
def spline_score(spark, sf_dir):
    z = _t(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") - F.lit(25.0)) / F.lit(10.0)).alias("a"))
    return rounded(models.score(z, ["a"], [{"kind": "spline", "base": [[0.7]], "spline": [[_W]], "bias": [0.25], "grid": 5}], ["p_partkey"]), 7)


_EDGE_SQL = "0.7 * (0.5::double * {x} * (1 + tanh(sqrt(2 / pi()) * ({x} + 0.044715::double * {x} * {x} * {x})))) + ".format(x=_X) + " + ".join(f"({w}) * {b}" for w, b in zip(_W, _bspline_sql(_X, 5)))
_LAYER = {"kind": "spline", "base": [[0.7]], "spline": [[_W]], "bias": [0.25], "grid": 5}


@query(f"select p_partkey, 0 as input, 0 as output, round({_X}, 8) as x, round({_EDGE_SQL}, 7) as value from part")
def edge_curve(spark, sf_dir):
    """What one edge of a spline layer makes of each part's size."""
    z = _t(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") - F.lit(25.0)) / F.lit(10.0)).alias("a"))
    return rounded(models.edge_values(z, ["a"], _LAYER, ["p_partkey"]), 8, value=7)


@query(f"select round(avg(abs({_EDGE_SQL})), 7) as l1 from part")
def edge_l1(spark, sf_dir):
    z = _t(spark, sf_dir, "part").select(((F.col("p_size") - F.lit(25.0)) / F.lit(10.0)).alias("a"))
    return rounded(models.edge_l1(z, ["a"], _LAYER), 7)


@query(f"""with {_KFOLD}, x as (select k.fold, y, x0, x1 from o join k using (row_id) where part = 'pool'),
l as (select fold, y, 'x0' as feature, x0 as x from x union all select fold, y, 'x1', x1 from x),
s as (select feature, fold, count(*)::double as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy from l group by all),
t as (select s.*, sum(n) over w - n as rn, sum(sx) over w - sx as rx, sum(sy) over w - sy as ry, sum(sxx) over w - sxx as rxx, sum(sxy) over w - sxy as rxy from s window w as (partition by feature)),
c as (select t.*, g.candidate, g.strength, (rxy - rx * ry / rn) / ((rxx - rx * rx / rn) * (1 + strength)) as w from t, (values (0, 0.0::double), (1, 0.1::double), (2, 1.0::double)) g(candidate, strength)),
z as (select *, (ry - w * rx) / rn as b from c)
select candidate, feature, strength, fold, round(1 - (syy - 2 * w * sxy - 2 * b * sy + w * w * sxx + 2 * w * b * sx + n * b * b) / (syy - sy * sy / n), 6) as r2 from z""")
def search_univariate(spark, sf_dir):
    """Every candidate on every fold from one aggregate of sums."""
    o = _orders(spark, sf_dir)
    rows = o.join(split.kfold(o, "row_id").where("part = 'pool'").select("row_id", "fold"), "row_id")
    return rounded(models.univariate_search(rows, ["x0", "x1"], "y", "fold", [0.0, 0.1, 1.0]), 6)


@query()
def search_splines(spark, sf_dir):
    """Additive spline models of lineitem prices by grid and ridge, on five folds: mean and spread of R2."""
    line = _t(spark, sf_dir, "lineitem")
    stats = scaling.literals(scaling.fit(line, ["l_quantity", "l_discount"]))
    z = line.select(*[scaling.transform(c, stats).alias(c) for c in ("l_quantity", "l_discount")], F.col("l_extendedprice").alias("y"), F.pmod(F.xxhash64(*line.columns), F.lit(5)).cast("int").alias("fold"))
    found = spline_search.search(z, ["l_quantity", "l_discount"], "y", "fold", [4, 8], [1e-6, 1e-3])
    runs = found.select(F.format_string("grid=%d ridge=%g", "grid", "strength").alias("candidate"), F.lit(0).alias("seed"), F.lit(0).alias("repeat"), "fold", "r2")
    return rounded(metrics.over_runs(runs, ["candidate"]), 6)




def _price_edges(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    samples = line.groupBy("l_returnflag", "l_quantity").agg(F.avg("l_extendedprice").alias("y")).select(F.col("l_returnflag").alias("edge"), ((F.col("l_quantity") - F.lit(25.0)) / F.lit(15.0)).alias("x"), (F.col("y") / F.lit(10000.0)).alias("y"))
    return symbolic.fit_edges(samples, ["edge"])


@query()
def symbolic_fit(spark, sf_dir):
    """The primitive that fits price by quantity best, for each return flag."""
    return rounded(_price_edges(spark, sf_dir), 4)


@query()
def weak_best_edges(spark, sf_dir):
    """Worst and mean R2 of the edges' best fits of nine primitives, and how many edges are below 0.99 even so."""
    return rounded(symbolic.edge_quality(_price_edges(spark, sf_dir)), 4)


def _best_fits(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    samples = line.groupBy(F.col("l_returnflag").alias("edge"), ((F.col("l_quantity") - F.lit(25.0)) / F.lit(15.0)).alias("x")).agg((F.avg("l_extendedprice") / F.lit(10000.0)).alias("y"))
    settings = symbolic.grid(spark).where(F.col("name").isin("sin", "tanh", "x^2"))
    return symbolic.fit_round(samples, settings, ["edge"]).groupBy("edge", "name").agg(F.max("r2").alias("r2"))


_FIT = "p as (select l_returnflag as edge, (l_quantity - 25) / 15.0::double as x, avg(l_extendedprice) / 10000.0::double as y from lineitem group by 1, 2)"


@query(f"""with {_FIT}, g as (select n, -3 + 6 * i / 12.0::double as b, -4 + 8 * j / 12.0::double as c from (values ('sin'), ('tanh'), ('x^2')) t(n), (select unnest(range(13)) as i), (select unnest(range(13)) as j)),
v as (select edge, n, b, c, y, case n when 'sin' then sin(b * x + c) when 'tanh' then tanh(b * x + c) else (b * x + c) * (b * x + c) end as f from p, g)
select edge, n as name, round(max(coalesce(r2, 0)), 6) as r2 from (select edge, n, b, c, case when var_pop(f) > 1e-12 and var_pop(y) > 1e-12 then covar_pop(f, y) ** 2 / (var_pop(f) * var_pop(y)) end as r2 from v group by all) group by edge, n""")
def symbolic_round(spark, sf_dir):
    """The best R2 of three primitives over the whole grid of settings, for each return flag."""
    return rounded(_best_fits(spark, sf_dir), 6)


@query("select p_partkey, round(2 * sin(1.5 * p_size / 10.0::double - 0.5) + 0.3 + 1.7 * ln(greatest(p_retailprice / 1000.0::double + 3, 1e-6)) - 0.4 + 0.1, 7) as pred from part")
def formula_score(spark, sf_dir):
    """A symbolic formula as one Column."""
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / F.lit(10.0)).alias("size"), (F.col("p_retailprice") / F.lit(1000.0)).alias("price"))
    edges = [symbolic.Edge("size", "sin", 2.0, 1.5, -0.5, 0.3), symbolic.Edge("price", "log", 1.7, 1.0, 3.0, -0.4)]
    return rounded(p.select("p_partkey", symbolic.formula_column(edges, 0.1).alias("pred")), 7)


@query(f"with {_ORDERS}, r as (select row_id, row_number() over (order by row_id) - 1 as k, count(*) over () as n from o), w as (select distinct floor(i * (n / 256.0::double))::bigint as k from (select max(n) as n from r), (select unnest(range(256)) as i)) select row_id from r join w using (k)")
def calibration_sample(spark, sf_dir):
    """256 rows at even strides of the order of ids (the operator's own size)."""
    return diagnostics.calibration_sample(_orders(spark, sf_dir), "row_id")


@query("""with c as (select unnest(string_split(text, '')) as ch from documents), v as (select ch, count(*) as n from c where ch <> '' group by ch)
select ch, n, (row_number() over (order by encode(ch)) - 1)::int as id from v""")
def char_vocabulary(spark, sf_dir):
    return characters.vocabulary(_t(spark, sf_dir, "documents"), "text")


@query("""with x as (select p_partkey, (p_size - 25) / 25.0::double as a, (p_retailprice - 1000) / 1000.0::double as b from part)
select p_partkey, round(a + b, 8) as "sum_y", round(a * b, 8) as product_y, round(sin(3 * a), 8) as sine_y0, round(cos(3 * a), 8) as sine_y1, round(0.5 * a * a - a + 1, 8) as polynomial_y,
round((5.5 + 4.5 * a) * (5.5 + 4.5 * a) * sin(2 * (0.8 + 0.7 * b)) / 9.81, 7) as projectile_y from x""")
def sample_functions(spark, sf_dir):
    """The known functions over inputs that parts give."""
    a, b = (F.col("p_size") - F.lit(25.0)) / F.lit(25.0), (F.col("p_retailprice") - F.lit(1000.0)) / F.lit(1000.0)
    at = {"sum": [a, b], "product": [a, b], "sine": [F.lit(3.0) * a], "polynomial": [a], "projectile": [F.lit(5.5) + F.lit(4.5) * a, F.lit(0.8) + F.lit(0.7) * b]}
    made = {n: generators.truth(n, x) for n, x in at.items()}
    out = _t(spark, sf_dir, "part").select("p_partkey", *[y.alias(f"{n}_y" if len(ys) == 1 else f"{n}_y{i}") for n, ys in made.items() for i, y in enumerate(ys)])
    return rounded(out, 8, projectile_y=7)


# ---- delivery


@query("""with s as (select min(p_size) as l0, max(p_size) as h0, min(p_retailprice) as l1, max(p_retailprice) as h1 from part where p_size % 2 = 0)
select p_partkey, p_size, round(900 + 12.5 * p_size, 4) as p_retailprice, round(p_size * 2.0::double, 4) as y_new, ((p_size < l0 or p_size > h0)::int + (p_retailprice < l1 or p_retailprice > h1)::int) as n_warnings from part, s""")
def export_predictions(spark, sf_dir):
    """One output in place of its namesake, one appended, and how many inputs were out of the fitted range."""
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    stats = scaling.literals(scaling.fit(part.where("p_size % 2 = 0"), ["p_size", "p_retailprice"]))
    outputs = {"p_retailprice": lambda c: F.lit(900.0) + F.lit(12.5) * c["p_size"], "y_new": lambda c: c["p_size"] * F.lit(2.0)}
    return rounded(scoring.export(part, ["p_size", "p_retailprice"], outputs, stats), 4)


@query("""with s as (select min(p_size) as l0, max(p_size) as h0, min(p_retailprice) as l1, max(p_retailprice) as h1 from part where p_size % 2 = 0)
select count(*) as total, count(*) filter (p_size < l0 or p_size > h0 or p_retailprice < l1 or p_retailprice > h1) as extrapolated from part, s""")
def export_summary(spark, sf_dir):
    return scoring.summary(export_predictions(spark, sf_dir))


@query()
def dataset_fingerprint(spark, sf_dir):
    return provenance.fingerprint(_orders(spark, sf_dir), "row_id", ["x0", "x1"], ["y"])


# ---- searches, reports


@query(f"""with {_KFOLD}, f as (select fold, count(*) as n from k where part = 'pool' group by fold),
g as (select a * 2 + b as candidate from (select unnest(range(2)) as a), (select unnest(range(2)) as b))
select candidate, seed, fold, (sum(n) over (partition by candidate, seed) - n)::bigint as train_rows, n as val_rows from g, (values (0), (1)) s(seed), f""")
def search_runs(spark, sf_dir):
    """Every run of the balanced grid on five folds, with the rows that it trains on and scores."""
    axes = {k: search.BUDGETS["balanced"][k] for k in ("grid", "strength")}
    folds = split.kfold(_orders(spark, sf_dir), "row_id").where("part = 'pool'").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    return search.runs(search.candidates(spark, axes), folds, [0, 1]).select("candidate", "seed", "fold", "train_rows", "val_rows")


@query(f"""with {_PREDS}, a as (select 1 - sum((pred - target) ** 2) / (var_pop(target) * count(*)) as r2, (select avg(nrmse) from m) as nrmse from p),
w as (select min(r2) as worst, avg(r2) as mean, arg_min(output, (r2, output)) as worst_output from m)
select worst_output, unnest(['worst_output_r2', 'aggregate_r2', 'mean_output_r2', 'nrmse']) as objective, round(unnest([worst, r2, mean, -nrmse]), 6) as score from w, a""")
def objective_scores(spark, sf_dir):
    rows, scales = _predictions(spark, sf_dir)
    each = metrics.per_output(rows, scales)
    return rounded(search.objectives(each, metrics.overall(rows, each)), 6)


@query(f"""with {_FIT}, g as (select n, -3 + 6 * i / 12.0::double as b, -4 + 8 * j / 12.0::double as c from (values ('sin'), ('tanh'), ('x^2')) t(n), (select unnest(range(13)) as i), (select unnest(range(13)) as j)),
v as (select edge, n, b, c, y, case n when 'sin' then sin(b * x + c) when 'tanh' then tanh(b * x + c) else (b * x + c) * (b * x + c) end as f from p, g),
r as (select edge, n, max(coalesce(r2, 0)) as r2 from (select edge, n, b, c, case when var_pop(f) > 1e-12 and var_pop(y) > 1e-12 then covar_pop(f, y) ** 2 / (var_pop(f) * var_pop(y)) end as r2 from v group by all) group by edge, n)
select n as name, round(min(r2), 4) as worst, round(avg(r2), 4) as mean, count(*) filter (r2 < 0.99) as weak from r group by n""")
def weak_edges(spark, sf_dir):
    """How well each primitive does over all edges, and how many edges it leaves below 0.99."""
    return rounded(symbolic.primitive_quality(_best_fits(spark, sf_dir), ["edge"]), 4)


@query(f"""with {_RES}, {_RANGES[len(_ORDERS) + 2:]} """ + " union all ".join(
    [f"select 'tail_ratio' as kind, '{x}' as feature, round(avg(case when k < n // 10 or k >= n - n // 10 then abs(e) end) / avg(case when k >= n // 5 and k < n - n // 5 then abs(e) end), 6) as value from (select e, row_number() over (order by {x}, row_id) - 1 as k, count(*) over () as n from e)" for x in ("x0", "x1")]
    + [f"select 'sign_changes' as kind, '{x}' as feature, round(count(*) filter (e * p < 0) / (count(*) - 1)::double, 6) as value from (select e, lag(e) over (order by {x}, row_id) as p from e)" for x in ("x0", "x1")]
    + [f"select 'outside', '{x}', count(*) filter ({x} < l{x[1]} or {x} > h{x[1]})::double from o, s" for x in ("x0", "x1")]))
def diagnostic_report(spark, sf_dir):
    """Residual structure and range violations of each feature, as one table."""
    o, rows = _orders(spark, sf_dir), _residuals(spark, sf_dir)
    return rounded(diagnostics.report(rows, ["x0", "x1"], "row_id", "e", scaling.range_report(o, ["x0", "x1"], _urgent(o))), 6)


@query("""with t as (select text, unnest(range(length(text) - 1)) as i from documents where length(text) > 1)
select substr(text, i + 1, 1) as context, substr(text, i + 2, 1) as following, count(*) as n from t group by 1, 2""")
def char_transitions(spark, sf_dir):
    """Character windows of one context and one target, counted over all texts."""
    return characters.transitions(_t(spark, sf_dir, "documents"), "text")


@query(f"with {_INTER} select turn, p_partkey, p_retailprice from i join part on row_id = p_partkey")
def gather_rows(spark, sf_dir):
    """Rows picked by place, with their turn."""
    part = _t(spark, sf_dir, "part")
    return diagnostics.gather(part, "p_partkey", diagnostics.interleaved(part, "p_partkey", 300)).select("turn", "p_partkey", "p_retailprice")
