"""Registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import drift, features, identity, metrics, models, prep, profile, splits
from . import reporting

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut)


def _gappy(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with nulls in a third of two columns."""
    hole = F.col("l_linenumber") % 3 == 0
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(~hole, F.col("l_quantity")).alias("l_quantity"), F.when(~hole, F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus", "l_shipdate"
    )


_GAPPY = """gappy as (select l_orderkey, l_linenumber, case when l_linenumber % 3 <> 0 then l_quantity end as l_quantity,
  case when l_linenumber % 3 <> 0 then l_returnflag end as l_returnflag, l_linestatus, l_shipdate from lineitem)"""

# ---- profiles -----------------------------------------------------------------------------------------------


@query(
    """select 'c_acctbal' as "column", count(c_acctbal) as n, count(*) filter (c_acctbal is null) as n_null,
  round(avg(c_acctbal), 4) as mean, round(stddev_samp(c_acctbal), 4) as std, min(c_acctbal) as min, round(quantile_cont(c_acctbal, 0.25), 4) as q25,
  round(quantile_cont(c_acctbal, 0.5), 4) as q50, round(quantile_cont(c_acctbal, 0.75), 4) as q75, max(c_acctbal) as max from customer"""
)
def column_profile(spark, d):
    r = profile.describe(table(spark, d, "customer").select("c_acctbal"))
    return r.select("column", "n", "n_null", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q75")], "max")


@query(
    f"""with {_GAPPY}
select 'l_quantity' as "column", count(*) filter (l_quantity is null) as n_null, round(count(*) filter (l_quantity is null) / count(*)::double, 6) as null_ratio from gappy
union all select 'l_returnflag', count(*) filter (l_returnflag is null), round(count(*) filter (l_returnflag is null) / count(*)::double, 6) from gappy
union all select 'l_linestatus', count(*) filter (l_linestatus is null), round(count(*) filter (l_linestatus is null) / count(*)::double, 6) from gappy"""
)
def null_counts(spark, d):
    return profile.null_counts(_gappy(spark, d), ["l_quantity", "l_returnflag", "l_linestatus"]).withColumn("null_ratio", F.round("null_ratio", 6))


@query(
    f"""with {_GAPPY}
select 'l_quantity' as "column", count(distinct l_quantity) + max((l_quantity is null)::int) as n_unique from gappy
union all select 'l_returnflag', count(distinct l_returnflag) + max((l_returnflag is null)::int) from gappy
union all select 'l_orderkey', count(distinct l_orderkey) from gappy"""
)
def distinct_counts(spark, d):
    return profile.distinct_counts(_gappy(spark, d), ["l_quantity", "l_returnflag", "l_orderkey"])


@query("select o_orderpriority as value, count(*) as n from orders where o_orderpriority is not null group by 1")
def value_counts(spark, d):
    return profile.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query("select c as column_name from (select 'p_partkey' as c, count(distinct p_partkey) as n from part union all select 'p_name', count(distinct p_name) from part union all select 'p_brand', count(distinct p_brand) from part union all select 'p_type', count(distinct p_type) from part union all select 'p_size', count(distinct p_size) from part) where n > 50")
def high_cardinality(spark, d):
    names = profile.high_cardinality(table(spark, d, "part"))
    return spark.createDataFrame([(n,) for n in names], "column_name string")


@query("select coalesce(sum(n), 0)::bigint as n_duplicates from (select count(*) as n from (select s_nationkey, round(s_acctbal / 1000) as b from supplier) group by s_nationkey, b having count(*) > 1)")
def duplicate_rows(spark, d):
    return profile.duplicate_rows(table(spark, d, "supplier").select("s_nationkey", F.round(F.col("s_acctbal") / 1000).alias("b")))


# ---- preparation --------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag from lineitem")
def drop_columns(spark, d):
    gone = ["l_partkey", "l_suppkey", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]
    return prep.drop_columns(table(spark, d, "lineitem"), gone, target="l_quantity")


@query("select sha256(l_orderkey::varchar || ':' || l_linenumber::varchar) as row_id, l_quantity from lineitem")
def feature_label_split(spark, d):
    rows = table(spark, d, "lineitem").withColumn("row_id", F.sha2(F.concat_ws(":", "l_orderkey", "l_linenumber"), 256))
    return rows.select("row_id", "l_quantity")


@query(f"with {_GAPPY} select l_orderkey, l_linenumber, coalesce(l_quantity, (select median(l_quantity) from gappy)) as l_quantity from gappy")
def median_impute(spark, d):
    df = _gappy(spark, d)
    model = prep.PrepModel([], prep.medians(df, ["l_quantity"]), {}, [])
    return model.transform(df.select("l_orderkey", "l_linenumber", "l_quantity"))


@query(
    f"""with {_GAPPY}, best as (select l_returnflag as m from gappy where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1)
select l_orderkey, l_linenumber, coalesce(l_returnflag, (select m from best)) as l_returnflag from gappy"""
)
def mode_impute(spark, d):
    df = _gappy(spark, d)
    model = prep.PrepModel([], {}, prep.modes(df, ["l_returnflag"]), [])
    return model.transform(df.select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("select o_orderkey, year(o_orderdate)::int as o_orderdate_year, month(o_orderdate)::int as o_orderdate_month, day(o_orderdate)::int as o_orderdate_day, isodow(o_orderdate)::int as o_orderdate_weekday from orders")
def date_decompose(spark, d):
    return prep.date_parts(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"])


@query(f"with {_GAPPY} select l_orderkey, l_linenumber, case when l_linestatus = 'O' then 1 else 0 end as l_linestatus from gappy")
def target_orient(spark, d):
    return prep.orient_target(_gappy(spark, d).select("l_orderkey", "l_linenumber", "l_linestatus"), "l_linestatus", "O")


@query("select v as value, (row_number() over (order by v) - 1)::int as code from (select distinct o_orderpriority as v from orders)")
def category_codes(spark, d):
    return prep.category_codes(table(spark, d, "orders"), "o_orderpriority", "code").withColumnRenamed("o_orderpriority", "value")


@query(
    f"""with {_GAPPY}, m as (select median(l_quantity) as q from gappy),
top as (select l_returnflag as v from gappy where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1),
flag as (select v, (row_number() over (order by v) - 1)::int as c from (select distinct l_returnflag as v from gappy where l_returnflag is not null))
select l_orderkey::double as l_orderkey, l_linenumber::double as l_linenumber, coalesce(l_quantity, (select q from m)) as l_quantity, flag.c as l_returnflag, l_linestatus,
  year(l_shipdate)::int as l_shipdate_year, month(l_shipdate)::int as l_shipdate_month, day(l_shipdate)::int as l_shipdate_day, isodow(l_shipdate)::int as l_shipdate_weekday
from gappy join flag on flag.v = coalesce(l_returnflag, (select v from top))"""
)
def prep_pipeline(spark, d):
    df = _gappy(spark, d)
    return prep.fit_prep(df, target="l_linestatus").transform(df)


# ---- drift --------------------------------------------------------------------------------------------------

_SIDES = """v as (select 'value' as c, value::double as v, case when ts < timestamp '2024-01-16' then 0 else 1 end as side from events
  union all select 'user_id', user_id::double, case when ts < timestamp '2024-01-16' then 0 else 1 end from events)"""
_PSI = f"""with {_SIDES},
e as (select c, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as edges from v group by c),
b as (select v.c, len(list_filter(edges, lambda x: v.v >= x))::int as bin, count(*) filter (side = 0) as r, count(*) filter (side = 1) as l from v join e using (c) group by 1, 2)"""


@query(f'{_PSI} select c as "column", bin, r, l from b')
def psi_bins(spark, d):
    return drift.psi_bins(*_sides(spark, d), ["value", "user_id"])


@query(
    f"""{_PSI}, t as (select c, greatest(r / sum(r) over (partition by c), 1e-6) as p, greatest(l / sum(l) over (partition by c), 1e-6) as q from b),
s as (select c, round(sum((q - p) * ln(q / p)), 6) as psi from t group by c)
select c as "column", psi, case when psi > 0.3 then 'severe' when psi > 0.2 then 'moderate' else 'none' end as level from s"""
)
def psi_report(spark, d):
    return drift.psi_report(*_sides(spark, d), ["value", "user_id"])


@query(
    f"""with {_SIDES}, g as (select c, v, count(*) filter (side = 0) as r, count(*) filter (side = 1) as l from v group by 1, 2),
s as (select c, sum(r) over (partition by c order by v) as cr, sum(l) over (partition by c order by v) as cl, sum(r) over (partition by c) as nr, sum(l) over (partition by c) as nl from g)
select c as "column", round(max(abs(cr / nr - cl / nl)), 9) as d, max(nr)::bigint as n_ref, max(nl)::bigint as n_live from s group by c"""
)
def ks_statistic(spark, d):
    return drift.ks_statistics(*_sides(spark, d), ["value", "user_id"]).withColumn("d", F.round("d", 9))


_CHI = """n as (select c, sum(r) as nr, sum(l) as nl, count(*) as k from g group by c),
x as (select g.c, k, nr, nl, r, l, (r + l) * nr / (nr + nl) as er, (r + l) * nl / (nr + nl) as el from g join n using (c)),
y as (select c, k, nr, nl, er, el, abs(r - er) - case when k = 2 then least(0.5, abs(r - er)) else 0 end as dr, abs(l - el) - case when k = 2 then least(0.5, abs(l - el)) else 0 end as dl from x)
select c as "column", round(sum(dr * dr / er + dl * dl / el), 6) as statistic, (max(k) - 1)::bigint as dof, max(nr)::bigint as n_ref, max(nl)::bigint as n_live from y group by c"""


@query(f"with g as (select 'event_type' as c, event_type as v, count(*) filter (ts < timestamp '2024-01-16') as r, count(*) filter (ts >= timestamp '2024-01-16') as l from events group by 2), {_CHI}")
def chi2_statistic(spark, d):
    return drift.chi2_statistics(*_sides(spark, d), ["event_type"]).withColumn("statistic", F.round("statistic", 6))


@query(
    f"""with g as (select 'flag' as c, v, count(*) filter (y < 1998) as r, count(*) filter (y >= 1998) as l from (select case when o_totalprice > 20000 then 'big' else 'small' end as v, year(o_orderdate) as y from orders) group by v
  union all select 'o_orderpriority', o_orderpriority, count(*) filter (year(o_orderdate) < 1998), count(*) filter (year(o_orderdate) >= 1998) from orders group by 2), {_CHI}"""
)
def drift_summary(spark, d):
    orders = table(spark, d, "orders").withColumn("flag", F.when(F.col("o_totalprice") > 20000, "big").otherwise("small"))
    old, new = orders.where(F.year("o_orderdate") < 1998), orders.where(F.year("o_orderdate") >= 1998)
    return drift.chi2_statistics(old, new, ["flag", "o_orderpriority"]).withColumn("statistic", F.round("statistic", 6))


# ---- identity and splits ------------------------------------------------------------------------------------


@query("select n_nationkey, sha256(sha256(concat_ws('|', '=' || n_name, '=' || n_nationkey::varchar, '=' || n_regionkey::varchar)) || ':0') as row_id from nation")
def row_ids(spark, d):
    return identity.with_row_ids(table(spark, d, "nation")).select("n_nationkey", "row_id")


_COPIES = """r as (select o_custkey, o_orderpriority, o_orderstatus, sha256(concat_ws('|', '=' || o_custkey::varchar, '=' || o_orderpriority, '=' || o_orderstatus)) as h from orders),
i as (select o_custkey, o_orderpriority, o_orderstatus, sha256(h || ':' || (row_number() over (partition by h order by h) - 1)::varchar) as row_id from r)"""


def _copies(spark, d) -> DataFrame:
    """orders by customer, priority and status: rows repeat."""
    return table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")


@query(f"with {_COPIES} select o_custkey, row_id from i")
def row_ids_orders(spark, d):
    return identity.with_row_ids(_copies(spark, d)).select("o_custkey", "row_id")


@query(f"with {_COPIES} select o_custkey, o_orderpriority, o_orderstatus from i order by sha256('42:' || row_id) limit (select round(0.1 * count(*))::bigint from orders)")
def sample_exact(spark, d):
    from ..session import exact_sample

    return exact_sample(_copies(spark, d), 0.1, 42)


_DIGITS = ", ".join(f"sum(('0x' || substr(h, {15 * i + 1}, 15))::bigint::hugeint)::varchar as s{i}" for i in range(4))


@query(
    f"""with r as (select sha256(concat_ws('|', '=' || o_custkey::varchar, '=' || o_orderkey::varchar, '=' || o_orderpriority, '=' || o_orderstatus)) as h from orders),
s as (select count(*) as n_rows, {_DIGITS} from r)
select n_rows, sha256(concat_ws('|', 'o_custkey:bigint,o_orderkey:bigint,o_orderpriority:string,o_orderstatus:string', n_rows::varchar, s0, s1, s2, s3)) as digest from s"""
)
def frame_digest_scalable(spark, d):
    return identity.frame_digest(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"))


_LINE = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
_LEAVES = f"""h as (select sha256(concat_ws('|', '=' || l_linenumber::varchar, '=' || l_linestatus, '=' || l_orderkey::varchar, '=' || l_returnflag)) as h from lineitem),
n3 as (select prefix, n_rows, sha256(concat_ws('|', n_rows::varchar, s0, s1, s2, s3)) as digest from (select substr(h, 1, 3) as prefix, count(*) as n_rows, {_DIGITS} from h group by 1)),
n2 as (select substr(prefix, 1, 2) as prefix, sum(n_rows) as n_rows, sha256(string_agg(prefix || ':' || digest, '|' order by prefix)) as digest from n3 group by 1),
n1 as (select substr(prefix, 1, 1) as prefix, sum(n_rows) as n_rows, sha256(string_agg(prefix || ':' || digest, '|' order by prefix)) as digest from n2 group by 1),
n0 as (select '' as prefix, sum(n_rows) as n_rows, sha256(string_agg(prefix || ':' || digest, '|' order by prefix)) as digest from n1)"""


@query(f"with {_LEAVES} select n_rows::bigint as n_rows, sha256('l_linenumber:' || (select typeof(l_linenumber) from lineitem limit 1).lower().replace('integer', 'int') || ',l_linestatus:string,l_orderkey:bigint,l_returnflag:string|' || digest) as digest from n0")
def frame_digest(spark, d):
    return identity.merkle_digest(table(spark, d, "lineitem").select(*_LINE))


@query(f"with {_LEAVES} select prefix, n_rows::bigint as n_rows, digest from n3 union all select prefix, n_rows::bigint, digest from n2 union all select prefix, n_rows::bigint, digest from n1 union all select prefix, n_rows::bigint, digest from n0")
def merkle_tree(spark, d):
    return identity.merkle_nodes(identity.digest_leaves(table(spark, d, "lineitem").select(*_LINE)))


@query("""with h as (select substr(sha256(concat_ws('|', '=' || l_linenumber::varchar, '=' || l_linestatus, '=' || l_orderkey::varchar, '=' || l_returnflag)), 1, 3) as prefix, l_orderkey % 5000 = 7 as gone from lineitem)
  select prefix, count(*) as n_left, count(*) filter (not gone) as n_right from h group by 1 having bool_or(gone)""")
def damaged_ranges(spark, d):
    rows = table(spark, d, "lineitem").select(*_LINE)
    tree = lambda df: identity.merkle_nodes(identity.digest_leaves(df))
    return identity.differing_ranges(tree(rows), tree(rows.where(F.col("l_orderkey") % 5000 != 7)))


def _ids(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("row_id"), F.col("o_orderdate").alias("t"), F.col("o_orderpriority").alias("y"), F.col("o_custkey").alias("g"))


_IDS = "ids as (select sha256(o_orderkey::varchar) as row_id, o_orderdate as t, o_orderpriority as y from orders)"
_FOLDED = """select row_id, f.f::smallint as fold, case when own = f.f then 'validation' else 'train' end as role, 0::smallint as repeat from folded, (select unnest(range(0, 5)) as f) f"""
_KFOLD = f"""with {_IDS}, p as (select row_id, row_number() over (order by row_id) - 1 as pos, count(*) over () as n from ids),
folded as (select row_id, (case when pos < (n % 5) * (n // 5 + 1) then pos // (n // 5 + 1) else n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) end)::int as own from p)"""


@query(f"{_KFOLD} {_FOLDED}")
def kfold_split(spark, d):
    return splits.kfold(_ids(spark, d), 5)


@query(
    f"""with {_IDS}, p as (select row_id, row_number() over (order by sha256('7:' || row_id)) - 1 as pos, count(*) over () as n from ids),
folded as (select row_id, (case when pos < (n % 5) * (n // 5 + 1) then pos // (n // 5 + 1) else n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) end)::int as own from p) {_FOLDED}"""
)
def kfold_shuffled(spark, d):
    return splits.kfold(_ids(spark, d), 5, seed=7)


@query(
    f"""with {_IDS}, first as (select y, min(row_id) as f from ids group by y),
s as (select ids.row_id, ids.y, row_number() over (order by first.f, ids.row_id) - 1 as p, row_number() over (partition by ids.y order by ids.row_id) - 1 as r from ids join first using (y)),
a as (select y, p % 5 as f, count(*) as n from s group by 1, 2),
u as (select y, f, sum(n) over (partition by y order by f) as upto from a),
folded as (select s.row_id, (select count(*) from u where u.y = s.y and u.upto <= s.r)::int as own from s) {_FOLDED}"""
)
def stratified_split(spark, d):
    return splits.stratified(_ids(spark, d), "y", 5)


def _time_sql(embargo: int) -> str:
    return f"""with {_IDS}, p as (select row_id, row_number() over (order by t, row_id) - 1 as pos, count(*) over () as n from ids),
e as (select row_id, pos, f, n - (4 - f) * (n // 5) as start, n // 5 as size from p, (select unnest(range(0, 4)) as f)),
x as (select row_id, f::smallint as fold, case when pos >= start and pos < start + size then 'validation' when pos < start - {embargo} then 'train' end as role, 0::smallint as repeat from e)
select * from x where role is not null"""


@query(_time_sql(0))
def time_split(spark, d):
    return splits.time_split(_ids(spark, d), "t", 4)


@query(_time_sql(25))
def purged_time_split(spark, d):
    return splits.time_split(_ids(spark, d), "t", 4, embargo=25)


@query(f"with m as ({_KFOLD} {_FOLDED}) select fold, role, count(*) as n from m group by 1, 2")
def fold_counts(spark, d):
    return splits.fold_counts(splits.kfold(_ids(spark, d), 5))


@query(f"with m as ({_KFOLD} {_FOLDED}) select count(*)::bigint as n_rows, 0::bigint as n_bad_roles, 0::bigint as n_duplicates, 0::bigint as n_overlap, 0::bigint as n_one_sided from m")
def split_validation(spark, d):
    r = splits.split_summary(splits.kfold(_ids(spark, d), 5))
    return r.select(*[F.col(c).cast("long").alias(c) for c in r.columns])


@query(f"with m as ({_time_sql(0)}), i as (select sha256(o_orderkey::varchar) as row_id, o_orderdate as t from orders) select fold, max(t) filter (role = 'train') as last_train, min(t) filter (role = 'validation') as first_validation, coalesce(max(t) filter (role = 'train') < min(t) filter (role = 'validation'), false) as ok from m join i using (row_id) group by fold")
def temporal_check(spark, d):
    ids = _ids(spark, d)
    return splits.temporal_summary(splits.time_split(ids, "t", 4), ids, "t")


@query(
    """with recursive g as (select o_custkey::varchar as g, count(*) as n, row_number() over (order by count(*) desc, o_custkey::varchar) as i from orders group by 1),
  dealt as (select 0::bigint as i, [0, 0, 0, 0, 0]::bigint[] as loads union all
    select g.i, list_transform(loads, lambda x, k: x + case when k = list_position(loads, list_min(loads)) then g.n else 0 end) from dealt join g on g.i = dealt.i + 1),
  last as (select loads from dealt order by i desc limit 1),
  v as (select f - 1 as fold, loads[f] as own, list_sum(loads)::bigint as total from last, (select unnest(range(1, 6)) as f) f)
  select fold::smallint as fold, 'validation' as role, own as n from v union all select fold::smallint, 'train', total - own from v"""
)
def group_split(spark, d):
    return splits.fold_counts(splits.group_kfold(_ids(spark, d), "g", 5))


# ---- metrics ------------------------------------------------------------------------------------------------


def _scored(spark, d) -> DataFrame:
    """lineitem with a rule's score of its return flag and price."""
    li = table(spark, d, "lineitem")
    score = F.least(F.greatest(F.col("l_quantity") / 50 * 0.7 + (F.col("l_linenumber") % 4) * 0.07, F.lit(0.02)), F.lit(0.98))
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y"), score.alias("s"), (score > 0.5).cast("int").alias("p"), F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * 1500).alias("guess"), F.col("l_returnflag").alias("flag"))


_SCORED = """sc as (select (l_returnflag = 'R')::int as y, least(greatest(l_quantity / 50 * 0.7::double + (l_linenumber % 4) * 0.07::double, 0.02::double), 0.98::double) as s, l_extendedprice as price, l_quantity * 1500 as guess, l_returnflag as flag from lineitem)"""


@query(f"with {_SCORED} select round(sqrt(avg((price - guess) ** 2)), 4) as rmse, round(avg(abs(price - guess)), 4) as mae, round(1 - avg((price - guess) ** 2) / var_pop(price), 6) as r2 from sc")
def regression_metrics(spark, d):
    return metrics.regression_metrics(_scored(spark, d), "price", "guess").select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query(
    f"""with {_SCORED}, c as (select y, (s > 0.5)::int as p from sc), k as (select y as k from c union select p from c),
f as (select k, 2.0 * count(*) filter (y = k and p = k) / (count(*) filter (y = k) + count(*) filter (p = k)) as f1 from k, c group by k)
select round((select count(*) filter (y = p) / count(*)::double from c), 6) as accuracy, round((select avg(f1) from f), 6) as f1_macro"""
)
def confusion_f1(spark, d):
    return metrics.classification_metrics(_scored(spark, d), "y", "p").select(F.round("accuracy", 6).alias("accuracy"), F.round("f1_macro", 6).alias("f1_macro"))


@query(
    f"""with {_SCORED}, g as (select s, count(*) filter (y = 1) as p, count(*) filter (y = 0) as n from sc group by s),
r as (select p, n, sum(n) over (order by s) - n as below from g) select round(sum(p * (below + n / 2.0)) / sum(p) / sum(n), 6) as roc_auc from r"""
)
def roc_auc(spark, d):
    return metrics.roc_auc(_scored(spark, d), "y", "s").select(F.round("roc_auc", 6).alias("roc_auc"))


@query(f"with {_SCORED} select round(-avg(case when y = 1 then ln(s) else ln(1 - s) end), 6) as log_loss from sc")
def log_loss(spark, d):
    return metrics.log_loss(_scored(spark, d), "y", "s").select(F.round("log_loss", 6).alias("log_loss"))


@query("select o_orderpriority, round(avg(v), 4) as mean, round(stddev_pop(v), 4) as std from (select o_orderpriority, o_orderkey % 5 as fold, avg(o_totalprice) as v from orders group by 1, 2) group by 1")
def fold_mean_std(spark, d):
    folds = table(spark, d, "orders").groupBy("o_orderpriority", (F.col("o_orderkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("v"))
    return metrics.fold_summary(folds, ["o_orderpriority"], "v").select("o_orderpriority", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("select o_orderstatus, round(case when b <> 0 then -(s - b) / abs(b) end, 6) as lift from (select o_orderstatus, avg(o_totalprice) as s, (select avg(o_totalprice) from orders) as b from orders group by 1)")
def lift(spark, d):
    orders = table(spark, d, "orders")
    base = orders.agg(F.avg("o_totalprice").alias("b"))
    by = orders.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("s")).crossJoin(F.broadcast(base))  # one row
    return by.select("o_orderstatus", F.round(metrics.lift(F.col("s"), F.col("b"), "rmse"), 6).alias("lift"))


@query("select round((select avg(l_extendedprice) from lineitem), 4) as prediction, round(sqrt(avg((l_extendedprice - (select avg(l_extendedprice) from lineitem)) ** 2)), 4) as rmse from lineitem")
def naive_baseline_reg(spark, d):
    li = table(spark, d, "lineitem").select("l_extendedprice")
    scored = models.naive()(li, [], "l_extendedprice")(li)
    return scored.agg(F.round(F.first("prediction"), 4).alias("prediction"), F.round(F.sqrt(F.avg(F.pow(F.col("l_extendedprice") - F.col("prediction"), F.lit(2)))), 4).alias("rmse"))


@query("with t as (select (o_orderkey % 3)::int as y from orders), top as (select y from t group by y order by count(*) desc, y limit 1) select (select y from top)::double as prediction, round(count(*) filter (y = (select y from top)) / count(*)::double, 6) as accuracy from t")
def naive_baseline_clf(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_orderkey") % 3).cast("int").alias("y"))
    scored = models.naive()(rows, [], "y")(rows)
    return scored.agg(F.first("prediction").alias("prediction"), F.round(F.avg((F.col("y") == F.col("prediction")).cast("double")), 6).alias("accuracy"))


# ---- features -----------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) as v from lineitem")
def interaction_multiply(spark, d):
    i = features.Interaction("multiply", "l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(i.expression, 4).alias("v"))


@query("select l_orderkey, l_linenumber, round(case when abs(l_discount) > 1e-10 then l_extendedprice / l_discount else 0 end, 4) as v from lineitem")
def interaction_ratio(spark, d):
    i = features.Interaction("ratio", "l_extendedprice", "l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(i.expression, 4).alias("v"))


@query("select round(avg(((l_extendedprice - m) / s) ** 3), 6) as skew from lineitem, (select avg(l_extendedprice) as m, stddev_pop(l_extendedprice) as s from lineitem)")
def target_skewness(spark, d):
    return spark.createDataFrame([(features.skewness(table(spark, d, "lineitem"), "l_extendedprice"),)], "skew double").select(F.round("skew", 6).alias("skew"))


@query("select event_id, round(ln(1 + value), 9) as z, round(value, 6) as back from events")
def log1p_target(spark, d):
    t = features.TargetTransform("log1p")
    return table(spark, d, "events").select("event_id", F.round(t.forward(F.col("value")), 9).alias("z"), F.round(t.inverse(t.forward(F.col("value"))), 6).alias("back"))


@query("select p_partkey, coalesce(c, 0)::int as code from part left join (select v, row_number() over (order by v) - 1 as c from (select distinct p_type as v from part where p_size > 5)) on p_type = v")
def embedding_codes(spark, d):
    part = table(spark, d, "part")
    codes = features.contiguous_codes(part.where("p_size > 5"), "p_type")
    return features.with_codes(part, "p_type", codes, "code").select("p_partkey", "code")


@query("select p_partkey, round(n / (select count(*) from part), 9) as p_type_emb_0 from part join (select p_type as v, count(*) as n from part group by 1) on p_type = v")
def frequency_encoding(spark, d):
    part = table(spark, d, "part")
    wide = features.augment(part, ["p_type"], {"p_type": features.fit_frequency_encoding(part, "p_type")})
    return wide.select("p_partkey", F.round("p_type_emb_0", 9).alias("p_type_emb_0"))


# ---- contracts and audits -----------------------------------------------------------------------------------


@query(f"with {_GAPPY} select 'l_quantity' as \"column\", round(count(*) filter (l_quantity is null) / count(*)::double, 6) as null_ratio from gappy having count(*) filter (l_quantity is null) / count(*)::double > 0.1")
def contract_nulls(spark, d):
    r = profile.null_counts(_gappy(spark, d), ["l_quantity", "l_linestatus"])
    return r.where("null_ratio > 0.1").select("column", F.round("null_ratio", 6).alias("null_ratio"))


@query("select l_orderkey, l_suppkey % 7 as k, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def contract_unique(spark, d):
    return profile.repeated_keys(table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 7).alias("k")), ["l_orderkey", "k"])


@query("select 'warning' as severity, 'id_like' as code, 'o_orderkey' as \"column\" union all select 'warning', 'continuous_target', 'o_totalprice' union all select 'warning', 'rare_class', 'o_totalprice'")
def preflight_issues(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    found = profile.preflight(orders, "o_totalprice", "classification")
    return spark.createDataFrame([(i.severity, i.code, i.column) for i in found], "severity string, code string, `column` string")


@query("select d.doc_id from documents d left join labels l on d.doc_id = l.doc_id and l.quality < 0.5 where l.doc_id is null")
def label_quality_filter(spark, d):
    from ..operators.audit import drop_noise

    scores = table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("quality_score"))
    return drop_noise(table(spark, d, "documents").select(F.col("doc_id").alias("row_id")), scores).withColumnRenamed("row_id", "doc_id")


# ---- reporting ----------------------------------------------------------------------------------------------


def _runs(spark, d) -> DataFrame:
    """events as completed runs: run = user, model = type, one score whose metric goes by the event's number."""
    e = table(spark, d, "events")
    metric = F.element_at(F.array(F.lit("roc_auc"), F.lit("rmse"), F.lit("zeta")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(
        F.lit("model_completed").alias("event"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("model"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(F.col("event_id") % 2 == 0, "classification").otherwise("regression").alias("task"), F.create_map(metric, "value").alias("cv_scores"),
        F.when(F.col("event_id") % 5 > 0, F.create_map(F.lit("depth"), (F.col("event_id") % 7).cast("string"))).alias("params"), F.lit("a").alias("artifact_path"), F.col("event_id").alias("line"),
    )


_RUNS = """runs as (select user_id::varchar as run_id, event_type as model, ts, event_id as line, value as score,
  case event_id % 3 when 0 then 'roc_auc' when 1 then 'rmse' else 'zeta' end as metric, case when event_id % 2 = 0 then 'classification' else 'regression' end as task, event_id % 5 > 0 as has_params from events),
last as (select * from runs qualify row_number() over (partition by run_id, model order by ts desc, line desc) = 1)"""


@query(f"with {_RUNS} select run_id, model, line, metric, round(score, 6) as score from last")
def event_dedupe(spark, d):
    return reporting.with_primary(reporting.dedupe_events(_runs(spark, d))).select("run_id", "model", "line", "metric", F.round("score", 6).alias("score"))


@query(f"with {_RUNS} select run_id, model, task, metric, round(score, 6) as score from last order by task, case when metric = 'rmse' then -score else score end desc, ts desc, run_id, model limit 20")
def leaderboard(spark, d):
    board = reporting.leaderboard(reporting.with_primary(reporting.dedupe_events(_runs(spark, d))), 20)
    return board.select("run_id", "model", "task", "metric", F.round("score", 6).alias("score"))


@query(f"with {_RUNS} select task, metric, run_id, model, round(score, 6) as score from last qualify row_number() over (partition by task, metric order by case when metric = 'rmse' then -score else score end desc, ts desc, run_id, model) = 1")
def champion(spark, d):
    runs = reporting.with_primary(reporting.dedupe_events(_runs(spark, d)))
    return reporting.champions(runs, ["task", "metric"]).select("task", "metric", "run_id", "model", F.round("score", 6).alias("score"))


@query(
    """with r as (select user_id, event_type as model, case event_id % 3 when 0 then 'roc_auc' when 1 then 'rmse' else 'zeta' end as metric, max(value) as v from events where user_id in (1, 2) group by 1, 2, 3),
a as (select * from r where user_id = 1), b as (select * from r where user_id = 2)
select coalesce(a.model, b.model) as model, coalesce(a.metric, b.metric) as metric, round(a.v, 6) as score_a, round(b.v, 6) as score_b, round(b.v - a.v, 6) as delta from a full join b on a.model = b.model and a.metric = b.metric"""
)
def run_diff(spark, d):
    return reporting.run_diff(_runs(spark, d), "1", "2").select("model", "metric", *[F.round(c, 6).alias(c) for c in ("score_a", "score_b", "delta")])


@query(
    f"""with {_RUNS} select count(*) filter (model = 'click' and has_params and metric = 'roc_auc') as injected, 0::bigint as no_model, count(*) filter (model <> 'click') as other_model,
  count(*) filter (model = 'click' and not has_params) as no_params, 0::bigint as no_scores, count(*) filter (model = 'click' and has_params and metric <> 'roc_auc') as other_metric from runs"""
)
def warmstart_counters(spark, d):
    from ..operators.search import warm_start

    return warm_start(_runs(spark, d), "click", "roc_auc")[1]


@query("select event_id as line, user_id::varchar as run_id, event_type as model from events order by event_id desc limit 15")
def last_n_events(spark, d):
    return reporting.last_events(_runs(spark, d), 15).select("line", "run_id", "model")


_SHARES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
_SPREAD = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    " union all ".join(
        f"""select '{c}' as "column", {", ".join(f"round(quantile_cont({c}, {s}), 6) as q{round(100 * s)}" for s in _SHARES)} from lineitem""" for c in _SPREAD
    )
)
def exact_quantiles(spark, d):
    from ..operators.quantiles import quantiles
    from ..schema import unpivoted

    found = quantiles(unpivoted(table(spark, d, "lineitem"), list(_SPREAD)), _SHARES)
    names = [f"q{round(100 * s)}" for s in _SHARES]
    rows = spark.createDataFrame([(c, *map(float, v)) for c, v in found.items()], ", ".join(["column string", *[f"{n} double" for n in names]]))
    return rows.select("column", *[F.round(n, 6).alias(n) for n in names])


# ---- catalog ------------------------------------------------------------------------------------------------

def _lake_root(spark) -> str:
    """A new folder for a lake, in the shared folder of the cluster."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    if base and not base.startswith(("file:", "/")):
        raise ValueError("the lake needs a mounted shared folder")
    return tempfile.mkdtemp(dir=base.removeprefix("file://").removeprefix("file:") if base else None)


def _orders_lake(spark, d):
    """A lake with the orders as bronze, silver and gold products; the gold one."""
    from ..operators.profile import Contract
    from .lake import Lake

    lake = Lake(spark, _lake_root(spark))
    bronze = lake.bronze(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), {"table": "orders"})
    gold = lake.gold(lake.silver(bronze, Contract()), "o_orderpriority", "kfold", 5)
    lake.catalog()
    return gold


@query(
    """with n as (select count(*) as n from orders)
  select 'bronze' as layer, 1::bigint as n_products, n as row_count from n union all select 'silver', 1, n + 4 from n union all select 'gold', 1, 7 * n from n"""
)
def catalog_query(spark, d):
    from .lake import catalog_query as run

    _orders_lake(spark, d)
    return run(spark, "with p as (select * from products) select layer, count(*) as n_products, sum(row_count) as row_count from p group by layer")


@query("select 'bronze' as layer, count(*) as row_count from orders union all select 'silver', count(*) + 4 from orders")
def lineage_edges(spark, d):
    from .lake import lineage_closure

    gold = _orders_lake(spark, d)
    return lineage_closure(spark.table("lineage"), gold.product_id).join(spark.table("products"), "product_id").select("layer", "row_count")


_FOLDED = """folded as (select (l_orderkey % 5)::int as fold, 1.0::double as one, l_quantity::double - 25 as quantity, l_discount::double as discount,
  l_extendedprice::double - 30000 as price from lineitem)"""
_NAMES = ("one", "quantity", "discount", "price")


def _folded(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") % 5).cast("int").alias("fold"), F.lit(1.0).alias("one"), (F.col("l_quantity").cast("double") - 25).alias("quantity"), F.col("l_discount").cast("double").alias("discount"), (F.col("l_extendedprice").cast("double") - 30000).alias("price"))


@query(
    f"with {_FOLDED} "
    + " union all ".join(f"select fold, '{a}' as a, '{b}' as b, round(sum({a} * {b}), 1) as total from folded group by fold" for i, a in enumerate(_NAMES) for b in _NAMES[i:])
)
def fold_moments(spark, d):
    from ..operators.moments import fold_products

    return fold_products(_folded(spark, d), "fold", {n: F.col(n) for n in _NAMES}).withColumn("total", F.round("total", 1))


@query(
    f"""with {_FOLDED}, folds as (select unnest(range(5))::int as k),
  trained as (select k, covar_pop(quantity, price) * count(*) / (var_pop(quantity) * count(*) + 1.0) as w, avg(price) as my, avg(quantity) as mx
    from folds, folded where fold <> k group by k)
  select k as fold, round(1 - avg(power(price - my - w * (quantity - mx), 2)) / var_pop(price), 6) as r2,
    round(sqrt(avg(power(price - my - w * (quantity - mx), 2))), 4) as rmse from trained, folded where fold = k group by k"""
)
def ridge_moments_cv(spark, d):
    from ..operators.moments import fold_moments as moments
    from ..operators.moments import ridge_scores

    scores = ridge_scores(moments(_folded(spark, d), ["quantity"], "price", "fold", 5))
    rows = spark.createDataFrame([(k, s["r2"], s["rmse"]) for k, s in enumerate(scores)], "fold int, r2 double, rmse double")
    return rows.select("fold", F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"))


_RULED = """ruled as (select l_orderkey, l_linenumber, ((l_returnflag = 'R')::int) as y, ((l_orderkey * 37 + l_linenumber * 11) % 101) / 100.0::double as p from lineitem)"""


@query(
    f"""with {_RULED}, bars as (select avg(p) filter (y = 1) as t1, avg(1 - p) filter (y = 0) as t0 from ruled),
  sure as (select y, case when p >= t1 and (1 - p < t0 or p > 1 - p) then 1 when 1 - p >= t0 then 0 end as j from ruled, bars),
  counted as (select y, j, count(*) as n from sure where j is not null group by 1, 2),
  sized as (select y, count(*) as size from ruled group by 1)
  select c.y as label, c.j as likely, c.n as confident, ((2 * c.n * s.size + sum(c.n) over (partition by c.y)) // (2 * sum(c.n) over (partition by c.y)))::bigint as estimated
  from counted c join sized s using (y)"""
)
def confident_joint(spark, d):
    from ..operators.audit import confident_counts, estimated_joint

    li = table(spark, d, "lineitem")
    p = F.expr("(l_orderkey * 37 + l_linenumber * 11) % 101").cast("double") / 100
    scored = li.select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.array(1 - p, p).alias("probability"))
    sizes = {r.y: r.n for r in scored.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = confident_counts(scored, 2)
    joint = estimated_joint(counts, [sizes.get(k, 0) for k in range(2)])
    return spark.createDataFrame([(i, j, counts[i][j], joint[i][j]) for i in range(2) for j in range(2) if counts[i][j]], "label int, likely int, confident long, estimated long")


def _with_year(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate").cast("string"))


@query(
    """with t as (select '0=' || l_returnflag as a, '1=' || l_linestatus as b, '2=' || year(l_shipdate)::varchar as c from lineitem),
  p as (select a as u, b as v from t union all select b, a from t union all select a, c from t union all select c, a from t union all select b, c from t union all select c, b from t),
  n as (select u, v, count(*) as n from p group by 1, 2), d as (select u, sum(n) as d from n group by 1)
  select n.u, n.v, n.n, round(n.n / sqrt(d.d::double * e.d::double), 9) as w from n join d on n.u = d.u join d e on n.v = e.u"""
)
def category_co_occurrence(spark, d):
    from ..operators.embedding import co_occurrence, normalised

    counts = co_occurrence(_with_year(spark, d), ["l_returnflag", "l_linestatus", "year"])
    return counts.join(normalised(counts), ["u", "v"]).select("u", "v", "n", F.round("w", 9).alias("w"))


@query()
def entity_embedding(spark, d):
    from ..operators.embedding import fit_embeddings

    rows = _with_year(spark, d).withColumn("l_partkey", F.col("l_partkey").cast("string"))
    return fit_embeddings(rows, ["l_partkey"], 4, ["l_returnflag", "year", "l_linestatus"])["l_partkey"]


@query()
def denoised_categories(spark, d):
    from ..operators.embedding import fit_denoiser

    rows = _with_year(spark, d)
    found = fit_denoiser(rows, ["l_returnflag", "l_linestatus", "year"], latent=4)
    z = found.encode()
    return rows.select("l_orderkey", "l_linenumber", *[F.round(F.get(z, F.lit(i)), 6).alias(f"z{i}") for i in range(4)])


_FLAGS = """flags as (select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as y,
  (l_quantity >= 10)::int + (l_quantity >= 20)::int + (l_quantity >= 30)::int + (l_quantity >= 40)::int as quantity, (l_discount >= 0.03)::int + (l_discount >= 0.06)::int as discount from lineitem)"""


@query(
    f"""with {_FLAGS}, total as (select count(*)::double as n from flags), prior as (select k, count(*) filter (y = k) / max(t.n) as p from flags, (select unnest([0, 1, 2]) as k), total t group by k),
  cells as (select p.k, p.p, 0 as feature, quantity as bin, y from flags, prior p union all select p.k, p.p, 1, discount, y from flags, prior p)
  select k as class, feature, bin, round(sum(p - (y = k)::int), 5) as g, round(sum(p * (1 - p)), 5) as h from cells group by k, feature, bin"""
)
def boosting_histogram(spark, d):
    import math

    from ..operators import boosting

    at_least = lambda c, edges: sum(((F.col(c) >= e).cast("int") for e in edges), F.lit(0))
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    bins = F.array(at_least("l_quantity", (10, 20, 30, 40)), at_least("l_discount", (0.03, 0.06)))
    rows = table(spark, d, "lineitem").select(y.alias("y"), bins.alias("bins")).groupBy("y", "bins").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    prior = [math.log(sizes[k] / sum(sizes.values())) for k in range(3)]
    root = [{"feature": [-1], "bin": [0], "value": [0.0]}] * 3
    cells = boosting.histogram(boosting.with_slopes(rows.withColumn("scores", F.array(*map(F.lit, prior)))), root, 0)
    return cells.select("class", "feature", "bin", F.round("g", 5).alias("g"), F.round("h", 5).alias("h"))


@query()
def gbt_three_classes(spark, d):
    from ..operators.labels import fit_labels

    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", F.year("l_shipdate").cast("double").alias("year"))
    coded = fit_labels(rows, "l_returnflag").encode(rows)
    fitted = models.make_model("gbt", "classification", 3, trees=2, depth=3)(coded, ["l_quantity", "l_discount", "year"], "l_returnflag")
    return _values(spark, models.measure(fitted(coded), "l_returnflag", ["accuracy", "log_loss", "roc_auc"], 3))


# ---- models: rows only --------------------------------------------------------------------------------------


def _model_rows(spark, d) -> DataFrame:
    """Return flags of a bounded set of order lines, by price, quantity, discount and ship year."""
    li = table(spark, d, "lineitem")
    return li.select(F.sha2(F.concat_ws(":", "l_orderkey", "l_linenumber"), 256).alias("row_id"), (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity", "l_extendedprice", "l_discount", F.year("l_shipdate").cast("double").alias("year"))


_X = ["l_quantity", "l_extendedprice", "l_discount", "year"]


def _values(spark, rows: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in rows.items()], "name string, value double")


@query()
def domain_classifier(spark, d):
    return _values(spark, {"auc": drift.domain_auc(*_sides(spark, d))})


@query()
def linear_baseline_cv(spark, d):
    found = models.cross_validate(_model_rows(spark, d), _X, "y", models.make_model("linear", "classification"), ["roc_auc", "f1_macro"])
    return _values(spark, {m: v[0] for m, v in found.items()})


@query()
def ridge_baseline_cv(spark, d):
    found = models.cross_validate(_model_rows(spark, d), ["l_quantity", "l_discount", "year"], "l_extendedprice", models.make_model("linear", "regression"), ["r2", "rmse"])
    return _values(spark, {m: v[0] for m, v in found.items()})


@query()
def gbt_cv(spark, d):
    found = models.cross_validate(_model_rows(spark, d), _X, "y", models.gbt("classification", trees=5, depth=3), ["roc_auc"], folds=2)
    return _values(spark, {m: v[0] for m, v in found.items()})


@query()
def calibration(spark, d):
    rows = _model_rows(spark, d)
    fit = models.make_model("linear", "classification")
    c = models.fit_calibrator(rows, _X, "y", fit, "platt", folds=2)
    scored = fit(rows, _X, "y")(rows).withColumn("p", c.apply(F.get("probability", F.lit(1))))
    return metrics.log_loss(scored, "y", "p")


@query()
def leakage_audit(spark, d):
    from ..operators.audit import leakage_audit as run

    rows = _model_rows(spark, d).withColumn("leak", F.col("y") * 2.0 + F.col("l_discount"))
    found = run(rows, ["l_quantity", "leak"], "y", "classification", folds=2)
    return spark.createDataFrame([(f.feature, f.baseline, f.permuted) for f in found], "feature string, baseline double, permuted double")


@query()
def noise_audit(spark, d):
    from ..operators.audit import label_noise

    return label_noise(_model_rows(spark, d), _X, "y", folds=2).scores


@query()
def interaction_discovery(spark, d):
    rows = _model_rows(spark, d).withColumn("y", (F.col("l_quantity") * F.col("l_discount") > 1.2).cast("int"))
    found = features.discover_interactions(rows, ["l_quantity", "l_discount"], "y", models.make_model("linear", "classification"), "roc_auc", ["l_quantity", "l_discount"], least_lift=0.0, folds=2)
    return spark.createDataFrame([(i.name, v) for i, v in found], "name string, lift double")


@query()
def hpo_search(spark, d):
    from ..operators.search import SPACES, hash_sample, successive_halving

    rows = _model_rows(spark, d).cache()
    score = lambda s, share: models.cross_validate(hash_sample(rows, share), _X, "y", models.make_model("linear", "classification", **s), ["roc_auc"], folds=2)["roc_auc"][0]
    best, _ = successive_halving(score, SPACES["linear"], "roc_auc", trials=4, keep=2)
    return _values(spark, {"c": best.settings["c"], "roc_auc": best.score})


@query()
def medallion_run(spark, d):
    from .lake import medallion_run as run

    root = _lake_root(spark)
    out = run(spark, root, _model_rows(spark, d).drop("row_id"), "y", "classification", folds=2)
    return spark.createDataFrame([(k, str(v)) for k, v in out.items()], "name string, value string")


@query()
def target_power_transform(spark, d):
    t = features.fit_target_transform(table(spark, d, "events"), "value")
    rows = table(spark, d, "events").select("event_id", F.round(t.forward(F.col("value")), 6).alias("z"))
    return rows


