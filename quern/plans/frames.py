"""Queries on the frame operators: joins, sets, groups, windows, order, shape and missing data."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import combine, convert, expressions, grouping, joins, missing, order, reshape, stats, windows
from quern.plans.tpch import table as T

PLANS: dict = {}


def plan(sql: str | None):
    def put(run):
        PLANS[run.__name__] = (run, sql)
        return run

    return put


# Projection, predicates, expressions.


@plan("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS value, l_quantity + 1 AS quantity_next FROM lineitem WHERE l_discount > 0.05 AND l_returnflag <> 'N'")
def select_filter_assign(s, d):
    t = T(s, d, "lineitem").filter((F.col("l_discount") > 0.05) & (F.col("l_returnflag") != "N"))
    return t.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * F.col("l_extendedprice")).alias("value"), (F.col("l_quantity") + 1).alias("quantity_next"))


@plan("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25 AND (l_discount <= 0.04 OR l_tax = 0.08) AND NOT l_linestatus = 'F'")
def query_expression(s, d):
    t = T(s, d, "lineitem")
    return expressions.query(t, "l_quantity > 25 and (l_discount <= @limit or l_tax == 0.08) and not l_linestatus == 'F'", {"limit": 0.04}).select("l_orderkey", "l_linenumber", "l_quantity")


@plan("SELECT o_orderkey, round(o_totalprice / (o_custkey + 1) + 1e-9, 6) AS ratio, o_orderkey - 7 * floor(o_orderkey / 7.0) AS slot FROM orders")
def eval_expression(s, d):
    t = expressions.eval_(T(s, d, "orders"), "ratio = o_totalprice / (o_custkey + 1)\nslot = o_orderkey % 7")
    return t.select("o_orderkey", F.round(F.col("ratio") + 1e-9, 6).alias("ratio"), "slot")


@plan("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0 END AS kept, CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_acctbal END AS masked FROM customer")
def where_mask(s, d):
    c = F.col("c_acctbal")
    return T(s, d, "customer").select("c_custkey", missing.where(c >= 0, c, 0.0).alias("kept"), missing.mask(c > 5000, c).alias("masked"))


@plan("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def isin_list(s, d):
    return T(s, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_mktsegment")


@plan("SELECT p_partkey AS id, p_name AS part_name, p_size AS size_value FROM part")
def rename_columns(s, d):
    return T(s, d, "part").select("p_partkey", "p_name", "p_size").withColumnsRenamed({"p_partkey": "id", "p_name": "part_name", "p_size": "size_value"})


@plan("SELECT p_partkey, p_size, p_retailprice FROM part")
def select_dtypes(s, d):
    return convert.select_dtypes(T(s, d, "part"), ["number"])


@plan("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS o_totalprice FROM orders")
def astype(s, d):
    return convert.astype(T(s, d, "orders").withColumn("o_totalprice", F.floor("o_totalprice")), {"o_custkey": "string", "o_totalprice": "bigint"}).select("o_orderkey", "o_custkey", "o_totalprice")


@plan("SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def to_numeric(s, d):
    return T(s, d, "events").select("event_id", convert.to_numeric(F.regexp_extract("props", "[0-9]+", 0), "coerce").alias("k"), convert.to_numeric(F.col("event_type"), "coerce").alias("bad"))


@plan("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(s, d):
    return T(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@plan("SELECT o_orderkey, make_timestamp(CAST(epoch_us(o_orderdate) AS BIGINT)) AS again, strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS parsed FROM orders")
def to_datetime(s, d):
    t = F.col("o_orderdate").cast("timestamp")
    return T(s, d, "orders").select("o_orderkey", convert.to_datetime(F.unix_micros(t), unit="us").alias("again"), convert.to_datetime(F.date_format(t, "dd/MM/yyyy"), "dd/MM/yyyy").alias("parsed"))


# Joins.


@plan("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def merge_inner(s, d):
    j = joins.merge(T(s, d, "customer"), T(s, d, "nation"), left_on="c_nationkey", right_on="n_nationkey")
    return joins.merge(j, T(s, d, "region"), left_on="n_regionkey", right_on="r_regionkey").select("c_custkey", "n_name", "r_name")


@plan("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'")
def merge_left(s, d):
    o = T(s, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return joins.merge(T(s, d, "customer"), o, "left", left_on="c_custkey", right_on="o_custkey").select("c_custkey", "o_orderkey", "o_totalprice")


@plan("SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s RIGHT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0) c ON s_nationkey = c_nationkey")
def merge_right(s, d):
    a, b = T(s, d, "supplier").filter("s_acctbal > 0"), T(s, d, "customer").filter("c_acctbal < 0")
    return joins.spread(a.select("s_suppkey", "s_nationkey"), b.select("c_custkey", "c_nationkey"), "right", "s_nationkey", "c_nationkey").select("s_suppkey", "c_custkey")


@plan("SELECT coalesce(a.k, b.k) AS k, a.n AS n_x, b.n AS n_y, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS _merge FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def merge_outer_indicator(s, d):
    a = T(s, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = T(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return joins.merge(a, b, "outer", on="k", indicator=True)


@plan("SELECT a.c_custkey AS x, b.c_custkey AS y FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer WHERE c_acctbal > 9500) a JOIN (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer WHERE c_acctbal < -900) b ON a.k IS NOT DISTINCT FROM b.k")
def merge_null_keys(s, d):
    c = T(s, d, "customer").withColumn("k", F.nullif("c_nationkey", F.lit(3)))
    a = c.filter("c_acctbal > 9500").select(F.col("c_custkey").alias("x"), "k")
    return joins.spread(a, c.filter("c_acctbal < -900").select(F.col("c_custkey").alias("y"), "k"), "inner", "k", "k").select("x", "y")


@plan("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(s, d):
    return joins.isin(T(s, d, "customer"), "c_custkey", T(s, d, "orders").filter("o_totalprice > 200000"), "o_custkey").select("c_custkey")


@plan("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(s, d):
    return joins.isin(T(s, d, "customer"), "c_custkey", T(s, d, "orders").filter("o_totalprice > 300000"), "o_custkey", negate=True).select("c_custkey")


@plan("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(s, d):
    return joins.cross(T(s, d, "region").select("r_name"), T(s, d, "nation").select("n_name"))


@plan("SELECT l.event_id, r.value AS value_right FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_join(s, d):
    e = T(s, d, "events")
    buys = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.asof(e.filter("event_type = 'click'"), buys, "ts", ["user_id"], ["value"]).select("event_id", "value_right")


@plan("SELECT l.event_id, r.value AS value_right FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) r ON l.user_id = r.user_id AND l.ts < r.ts")
def asof_join_forward(s, d):
    e = T(s, d, "events")
    views = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.asof(e.filter("event_type = 'click'"), views, "ts", ["user_id"], ["value"], "forward", allow_exact=False).select("event_id", "value_right")


@plan("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 20")
def interval_join(s, d):
    spans = T(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 20).alias("hi"))
    return joins.interval(T(s, d, "part").select("p_partkey", "p_retailprice"), spans, "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "s_suppkey")


# Sets.


@plan("SELECT key, id, name, balance FROM (SELECT 'c' AS key, c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_suppkey, s_name, NULL FROM supplier)")
def concat_outer(s, d):
    a = T(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return combine.concat([a, T(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))], keys=["c", "s"])


@plan("SELECT coalesce(a.k, b.k) AS k, a.customers, b.suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.k = b.k")
def concat_columns(s, d):
    a = grouping.agg(T(s, d, "customer").withColumnRenamed("c_nationkey", "k"), ["k"], customers=("c_custkey", "size"))
    return combine.concat_columns(a, grouping.agg(T(s, d, "supplier").withColumnRenamed("s_nationkey", "k"), ["k"], suppliers=("s_suppkey", "size")), ["k"])


@plan("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def drop_duplicates_first(s, d):
    t = T(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return combine.drop_duplicates(t, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@plan("SELECT user_id, event_type, event_id, ts::DATE AS day FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type, ts::DATE) AS n FROM events) WHERE n = 1")
def drop_duplicates_none(s, d):
    return combine.drop_duplicates(T(s, d, "events").select("user_id", "event_type", "event_id", F.to_date("ts").alias("day")), ["user_id", "event_type", "day"], keep=False)


@plan("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) > 1 AS duplicated FROM events")
def duplicated_last(s, d):
    return combine.duplicated(T(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "last").select("event_id", "duplicated")


@plan("SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1")
def unique_first_seen(s, d):
    return combine.unique(T(s, d, "events"), "event_type", "event_id")


@plan("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_rows(s, d):
    return combine.drop_duplicates(T(s, d, "customer").select("c_mktsegment", "c_nationkey"))


# Groups.

@plan("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q_sum, round(avg(l_quantity), 6) AS q_mean, min(l_quantity) AS q_min, max(l_quantity) AS q_max, count(l_quantity) AS q_count, count(*) AS q_size, round(var_samp(l_quantity), 6) AS q_var, round(stddev_samp(l_quantity), 6) AS q_std, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 8) AS q_sem, round(skewness(l_quantity), 6) AS q_skew, round(kurtosis(l_quantity), 6) AS q_kurt, count(DISTINCT l_quantity) AS q_nunique, round(median(l_quantity), 6) AS q_median FROM lineitem GROUP BY ALL")
def groupby_agg_all(s, d):
    names = ["sum", "mean", "min", "max", "count", "size", "var", "std", "sem", "skew", "kurt", "nunique", "median"]
    out = grouping.agg(T(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], **{f"q_{n}": ("l_quantity", n) for n in names})
    digits = {"mean": 6, "var": 6, "std": 6, "sem": 8, "skew": 6, "kurt": 6, "median": 6}
    return out.select("l_returnflag", "l_linestatus", *[F.round(f"q_{n}", digits[n]).alias(f"q_{n}") if n in digits else f"q_{n}" for n in names])


@plan("SELECT o_orderstatus, round(product(1 + o_totalprice / 1e9), 8) AS p, bool_and(o_totalprice > 1000) AS all_large, bool_or(o_totalprice > 400000) AS any_huge FROM orders GROUP BY 1")
def groupby_prod_all_any(s, d):
    t = T(s, d, "orders").select("o_orderstatus", (1 + F.col("o_totalprice") / 1e9).alias("f"), (F.col("o_totalprice") > 1000).alias("a"), (F.col("o_totalprice") > 400000).alias("b"))
    return grouping.agg(t, ["o_orderstatus"], p=("f", "prod"), all_large=("a", "all"), any_huge=("b", "any")).withColumn("p", F.round("p", 8))


@plan("SELECT nullif(c_nationkey, 7) AS k, count(*) AS n FROM customer WHERE c_nationkey <> 7 GROUP BY 1")
def groupby_drops_null_keys(s, d):
    return grouping.agg(T(s, d, "customer").withColumn("k", F.nullif("c_nationkey", F.lit(7))), ["k"], n=("c_custkey", "size"))


@plan("SELECT c_mktsegment, c_nationkey, sum(c_acctbal)::DECIMAL(18, 2)::DOUBLE AS total FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def groupby_rollup(s, d):
    return grouping.grouping_sets(T(s, d, "customer"), ["c_mktsegment", "c_nationkey"], "rollup", total=("c_acctbal", "sum")).withColumn("total", F.round("total", 2))


@plan("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def groupby_cube(s, d):
    return grouping.grouping_sets(T(s, d, "orders"), ["o_orderstatus", "o_orderpriority"], "cube", n=("o_orderkey", "size"))


@plan("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey) + 1e-6, 4) AS mean, count(*) OVER (PARTITION BY o_custkey) AS n, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM orders")
def groupby_transform(s, d):
    t = grouping.transform(T(s, d, "orders"), ["o_custkey"], mean=("o_totalprice", "mean"), n=("o_totalprice", "size"), total=("o_totalprice", "sum"))
    return t.select("o_orderkey", F.round(F.col("mean") + 1e-6, 4).alias("mean"), "n", F.round(F.col("o_totalprice") / F.col("total"), 8).alias("share"))


@plan("SELECT event_id, round(sum(value) OVER w, 6) AS cumsum, max(value) OVER w AS cummax, min(value) OVER w AS cummin, row_number() OVER w - 1 AS cumcount FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def groupby_cumulative(s, d):
    t = grouping.cumulative(T(s, d, "events"), ["user_id"], ["ts", "event_id"], cumsum=("value", "cumsum"), cummax=("value", "cummax"), cummin=("value", "cummin"), cumcount=("value", "cumcount"))
    return t.select("event_id", F.round("cumsum", 6).alias("cumsum"), "cummax", "cummin", "cumcount")


@plan("SELECT event_id, round(product(1 + value / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 8) AS cumprod FROM events")
def groupby_cumprod(s, d):
    t = T(s, d, "events").withColumn("f", 1 + F.col("value") / 1e6)
    return grouping.cumulative(t, ["user_id"], ["ts", "event_id"], cumprod=("f", "cumprod")).select("event_id", F.round("cumprod", 8).alias("cumprod"))


@plan("WITH t AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events) SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM t")
def groupby_fill(s, d):
    t = T(s, d, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    k, o = ["user_id"], ["ts", "event_id"]
    return t.select("event_id", grouping.fill(t, k, o, "v").alias("f"), grouping.fill(t, k, o, "v", "bfill").alias("b"))


@plan("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def groupby_head(s, d):
    return grouping.head(T(s, d, "events"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id")


@plan("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 2")
def groupby_tail(s, d):
    return grouping.tail(T(s, d, "events"), ["user_id"], ["ts", "event_id"], 2).select("user_id", "event_id")


@plan("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events) WHERE a = 2 OR b = 1")
def groupby_nth(s, d):
    return grouping.nth(T(s, d, "events"), ["user_id"], ["ts", "event_id"], [1, -1]).select("user_id", "event_id")


@plan("SELECT event_id, rank() OVER w + (count(*) OVER (PARTITION BY user_id, floor(value)) - 1) / 2.0 AS average, CAST(rank() OVER w AS DOUBLE) AS low, CAST(dense_rank() OVER w AS DOUBLE) AS dense FROM events WINDOW w AS (PARTITION BY user_id ORDER BY floor(value))")
def groupby_rank(s, d):
    t = T(s, d, "events").withColumn("f", F.floor("value"))
    return t.select("event_id", grouping.rank(["user_id"], ["f"]).alias("average"), grouping.rank(["user_id"], ["f"], "min").alias("low"), grouping.rank(["user_id"], ["f"], "dense").alias("dense"))


@plan("SELECT o_custkey, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY 1")
def groupby_apply(s, d):
    def spread(pdf):
        price = pdf["o_totalprice"]
        return pdf["o_custkey"].iloc[0], round(price.max() - price.min(), 2)

    return grouping.apply(T(s, d, "orders").select("o_custkey", "o_totalprice"), ["o_custkey"], spread, "o_custkey long, spread double")


@plan("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS path FROM events GROUP BY 1")
def groupby_str_concat(s, d):
    return T(s, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), ",").alias("path"))


# Reductions and statistics.


@plan("SELECT sum(l_quantity) AS a, min(l_tax) AS b, max(l_tax) AS c, count(l_discount) AS d, round(avg(l_extendedprice), 4) AS e, round(var_samp(l_discount), 10) AS f, round(stddev_pop(l_discount), 10) AS g, round(skewness(l_extendedprice), 6) AS h, round(kurtosis(l_extendedprice), 6) AS i, count(DISTINCT l_suppkey) AS j, bool_and(l_quantity > 0) AS k, bool_or(l_quantity > 49) AS l, round(stddev_samp(l_tax) / sqrt(count(l_tax)), 12) AS m FROM lineitem")
def frame_reductions(s, d):
    t = T(s, d, "lineitem").withColumns({"pos": F.col("l_quantity") > 0, "big": F.col("l_quantity") > 49})
    o = stats.aggregate(t, a=("l_quantity", "sum"), b=("l_tax", "min"), c=("l_tax", "max"), d=("l_discount", "count"), e=("l_extendedprice", "mean"), f=("l_discount", "var"), g=("l_discount", lambda c: F.sqrt(stats.variance(c, 0))), h=("l_extendedprice", "skew"), i=("l_extendedprice", "kurt"), j=("l_suppkey", "nunique"), k=("pos", "all"), l=("big", "any"), m=("l_tax", "sem"))
    digits = {"e": 4, "f": 10, "g": 10, "h": 6, "i": 6, "m": 12}
    return o.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in o.columns])


@plan("SELECT round(quantile_cont(l_extendedprice, 0.3), 6) AS linear, quantile_disc(l_quantity, 0.5) AS lower FROM lineitem")
def quantiles(s, d):
    t = T(s, d, "lineitem")
    low = stats.quantile_by_rank(t, "l_quantity", 0.5, "lower").select(F.col("value").alias("lower"))
    return stats.quantile_by_rank(t, "l_extendedprice", 0.3, "linear").select(F.round("value", 6).alias("linear")).crossJoin(low)


@plan("SELECT a, b, round(corr, 8) AS corr FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_quantity', 1 UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1 UNION ALL SELECT 'l_extendedprice', 'l_quantity', corr(l_extendedprice, l_quantity) FROM lineitem)")
def corr_matrix(s, d):
    return stats.corr_matrix(T(s, d, "lineitem"), ["l_quantity", "l_extendedprice"]).withColumn("corr", F.round("corr", 8))


@plan("SELECT user_id, round(corr(x, y), 6) AS autocorr FROM (SELECT user_id, value AS x, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events) WHERE y IS NOT NULL GROUP BY 1")
def autocorr(s, d):
    return stats.autocorr(T(s, d, "events"), ["user_id"], ["ts", "event_id"], "value", 2).withColumn("autocorr", F.round("autocorr", 6))


@plan("SELECT * FROM (VALUES ('count', (SELECT count(value) FROM events)::DOUBLE), ('mean', (SELECT round(avg(value), 6) FROM events)), ('std', (SELECT round(stddev_samp(value), 6) FROM events)), ('min', (SELECT min(value) FROM events)), ('25%', (SELECT round(quantile_cont(value, 0.25), 6) FROM events)), ('50%', (SELECT round(quantile_cont(value, 0.5), 6) FROM events)), ('75%', (SELECT round(quantile_cont(value, 0.75), 6) FROM events)), ('max', (SELECT max(value) FROM events))) AS t(statistic, value)")
def describe(s, d):
    return stats.describe(T(s, d, "events"), ["value"]).withColumn("value", F.round("value", 6))


@plan("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def value_counts(s, d):
    return stats.value_counts(T(s, d, "events"), "event_type")


@plan("SELECT o_orderpriority, round(count(*) / (SELECT count(*) FROM orders), 8) AS proportion FROM orders GROUP BY 1")
def value_counts_normalized(s, d):
    return stats.value_counts(T(s, d, "orders"), "o_orderpriority", normalize=True).withColumn("proportion", F.round("proportion", 8))


@plan("SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'medium' WHEN p_size > 30 AND p_size <= 50 THEN 'large' END AS bin FROM part")
def cut(s, d):
    return T(s, d, "part").select("p_partkey", stats.cut(F.col("p_size"), [0, 10, 30, 50], labels=["small", "medium", "large"]).alias("bin"))


@plan("SELECT p_partkey, (p_retailprice > e[1])::INT + (p_retailprice > e[2])::INT + (p_retailprice > e[3])::INT AS bin FROM part, (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS e FROM part)")
def qcut(s, d):
    return stats.qcut(T(s, d, "part"), "p_retailprice", 4).select("p_partkey", "bin")


@plan("SELECT least(floor((value - 0) / 50.0), 9)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1")
def histogram(s, d):
    return stats.histogram(T(s, d, "events"), "value", 10, 0.0, 500.0)


@plan("SELECT bool_and(ok) AS monotonic FROM (SELECT coalesce(o_orderdate >= lag(o_orderdate) OVER (ORDER BY o_orderkey), true) AS ok FROM orders)")
def is_monotonic(s, d):
    return stats.is_monotonic(T(s, d, "orders"), "o_orderkey", "o_orderdate")


@plan("WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority FROM c WHERE n = (SELECT max(n) FROM c)")
def mode(s, d):
    return stats.mode(T(s, d, "orders"), "o_orderpriority")


# Windows.


@plan("SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(sum(value) OVER w, 6) END AS total, CASE WHEN count(value) OVER w >= 5 THEN round(avg(value) OVER w, 6) END AS mean, CASE WHEN count(value) OVER w >= 5 THEN min(value) OVER w END AS low, CASE WHEN count(value) OVER w >= 5 THEN max(value) OVER w END AS high, CASE WHEN count(value) OVER w >= 5 THEN round(stddev_samp(value) OVER w, 5) END AS std, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)")
def rolling_groups(s, d):
    r = lambda how: windows.rolling(["user_id"], ["ts", "event_id"], 5, "value", how)
    return T(s, d, "events").select("event_id", F.round(r("sum"), 6).alias("total"), F.round(r("mean"), 6).alias("mean"), r("min").alias("low"), r("max").alias("high"), F.round(r("std"), 5).alias("std"), r("count").alias("n"))


@plan("SELECT event_id, CASE WHEN count(value) OVER w >= 4 THEN round(median(value) OVER w, 6) END AS median, CASE WHEN count(value) OVER w >= 4 THEN round(var_samp(value) OVER w, 4) END AS var FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 3 PRECEDING)")
def rolling_median_var(s, d):
    r = lambda how: windows.rolling(["user_id"], ["ts", "event_id"], 4, "value", how)
    return T(s, d, "events").select("event_id", F.round(r("median"), 6).alias("median"), F.round(r("var"), 4).alias("var"))


@plan("SELECT event_id, CASE WHEN count(value) OVER w >= 1 THEN round(avg(value) OVER w, 6) END AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def rolling_centered(s, d):
    return T(s, d, "events").select("event_id", F.round(windows.rolling(["user_id"], ["ts", "event_id"], 5, "value", "mean", 1, center=True), 6).alias("mean"))


@plan("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW), 6) AS day_total FROM events")
def rolling_time(s, d):
    e = T(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", F.round(windows.rolling_time(["user_id"], "ts", 86400, "value", "sum"), 6).alias("day_total"))


@plan("SELECT event_id, CASE WHEN count(value) OVER w >= 6 THEN round(covar_samp(value, event_id) OVER w + 1e-5, 2) END AS cov FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 5 PRECEDING)")
def rolling_cov(s, d):
    return T(s, d, "events").select("event_id", F.round(windows.rolling_pair(["user_id"], ["ts", "event_id"], 6, "value", "event_id", "cov") + 1e-5, 2).alias("cov"))


@plan("SELECT event_id, round(avg(value) OVER w + 1e-9, 6) AS mean, max(value) OVER w AS high, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def expanding(s, d):
    e = lambda how: windows.expanding(["user_id"], ["ts", "event_id"], "value", how)
    return T(s, d, "events").select("event_id", F.round(e("mean") + 1e-9, 6).alias("mean"), e("max").alias("high"), e("count").alias("n"))


@plan("SELECT event_id, lag(value, 2) OVER w AS back, lead(value) OVER w AS ahead, round(value - lag(value) OVER w, 6) AS diff, round(value / nullif(lag(value) OVER w, 0) - 1, 6) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def shift_diff_change(s, d):
    k, o = ["user_id"], ["ts", "event_id"]
    return T(s, d, "events").select("event_id", windows.shift(k, o, "value", 2).alias("back"), windows.shift(k, o, "value", -1).alias("ahead"), F.round(windows.diff(k, o, "value"), 6).alias("diff"), F.round(windows.pct_change(k, o, "value"), 6).alias("change"))


@plan("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders")
def global_positions(s, d):
    return windows.positions(T(s, d, "orders").select("o_orderkey"), "o_orderkey")


@plan("SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, max(o_totalprice) OVER w AS high, min(o_totalprice) OVER w AS low FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def global_cumulative(s, d):
    t = windows.cumulative(T(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", total=("o_totalprice", "cumsum"), high=("o_totalprice", "cummax"), low=("o_totalprice", "cummin"))
    return t.select("o_orderkey", F.round("total", 2).alias("total"), "high", "low")


@plan("WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END AS v FROM orders) SELECT o_orderkey, last_value(v IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS filled FROM t")
def global_ffill(s, d):
    t = T(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice")).alias("v"))
    return windows.cumulative(t, "o_orderkey", filled=("v", "ffill")).select("o_orderkey", "filled")


@plan("SELECT o_orderkey, CASE WHEN count(*) OVER w >= 7 THEN round(avg(o_totalprice) OVER w, 4) END AS mean FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS 6 PRECEDING)")
def global_rolling(s, d):
    t = windows.positions(T(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return windows.rolling_frame(t, "position", 7, mean=("o_totalprice", "mean")).select("o_orderkey", F.round("mean", 4).alias("mean"))


@plan("SELECT o_orderkey, lag(o_totalprice, 3) OVER (ORDER BY o_orderkey) AS back FROM orders")
def global_shift(s, d):
    t = windows.positions(T(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return windows.shift_frame(t, "position", 3, back="o_totalprice").select("o_orderkey", "back")


@plan("WITH RECURSIVE t AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), r AS (SELECT event_id, user_id, n, value AS s, 1.0::DOUBLE AS w FROM t WHERE n = 1 UNION ALL SELECT t.event_id, t.user_id, t.n, 0.7 * r.s + t.value, 0.7 * r.w + 1 FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1) SELECT event_id, round(s / w, 6) AS ewm FROM r")
def ewm_mean(s, d):
    return windows.ewm(T(s, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value", windows.alpha_of(alpha=0.3)).select("event_id", F.round("ewm", 6).alias("ewm"))


# Order.


@plan("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def nlargest(s, d):
    return order.nlargest(T(s, d, "orders").select("o_orderkey", "o_totalprice"), 20, ["o_totalprice"], order=["o_orderkey"])


@plan("SELECT p_partkey, p_size FROM part WHERE p_size <= (SELECT p_size FROM part ORDER BY p_size LIMIT 1 OFFSET 9)")
def nsmallest_all(s, d):
    return order.nsmallest(T(s, d, "part").select("p_partkey", "p_size"), 10, ["p_size"], keep="all")


@plan("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey")
def sort_values(s, d):
    return order.sort_values(T(s, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"])


@plan("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
def head(s, d):
    return order.head(T(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@plan("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail(s, d):
    return order.tail(T(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@plan("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 100")
def iloc_slice(s, d):
    t = windows.positions(T(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return t.filter(F.col("position").between(100, 109)).drop("position")


@plan("SELECT min(o_orderkey) AS label FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def idxmax(s, d):
    return order.idxmax(T(s, d, "orders"), "o_totalprice", "o_orderkey", ["o_orderkey"])


# Shape.


@plan("SELECT o_custkey, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS p FROM orders GROUP BY 1")
def pivot_table(s, d):
    t = reshape.pivot_table(T(s, d, "orders"), ["o_custkey"], "o_orderstatus", "o_totalprice", ["F", "O", "P"], "sum")
    return t.select("o_custkey", *[F.round(c, 2).alias(c.lower()) for c in ("F", "O", "P")])


@plan("SELECT coalesce(o_orderpriority, 'All') AS o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) AS everything FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ROLLUP (o_orderpriority)")
def pivot_margins(s, d):
    t = reshape.pivot_table(T(s, d, "orders"), ["o_orderpriority"], "o_orderstatus", "o_orderkey", ["F", "O"], "count", margins=True)
    return t.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("All").alias("everything"))


@plan("SELECT c_nationkey, max(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS building, max(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY 1")
def pivot(s, d):
    t = T(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_acctbal").alias("v"))
    return reshape.pivot(t, ["c_nationkey"], "c_mktsegment", "v", ["BUILDING", "MACHINERY"]).select("c_nationkey", F.col("BUILDING").alias("building"), F.col("MACHINERY").alias("machinery"))


@plan("SELECT l_orderkey, l_linenumber, variable, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME variable VALUE value)")
def melt(s, d):
    return reshape.melt(T(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@plan("SELECT c_custkey, 'hi' AS level, c_acctbal AS value FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'lo', c_acctbal FROM customer WHERE c_acctbal <= 0")
def stack(s, d):
    t = T(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("hi"), F.when(F.col("c_acctbal") <= 0, F.col("c_acctbal")).alias("lo"))
    return reshape.stack(t, ["c_custkey"], ["hi", "lo"])


@plan("SELECT vec_id, unnest(embedding)::DOUBLE AS embedding FROM embeddings")
def explode(s, d):
    return reshape.explode(T(s, d, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", F.col("embedding").cast("double").alias("embedding"))


@plan("SELECT o_orderkey, (o_orderstatus = 'F')::INT AS s_F, (o_orderstatus = 'O')::INT AS s_O, (o_orderstatus = 'P')::INT AS s_P FROM orders")
def get_dummies(s, d):
    return reshape.get_dummies(T(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"], "s")


@plan("SELECT 'n' AS field, count(*) FILTER (r_name = 'AFRICA')::DOUBLE AS \"AFRICA\", count(*) FILTER (r_name = 'ASIA')::DOUBLE AS \"ASIA\" FROM nation JOIN region ON n_regionkey = r_regionkey")
def transpose(s, d):
    t = joins.merge(T(s, d, "nation"), T(s, d, "region"), left_on="n_regionkey", right_on="r_regionkey").groupBy("r_name").agg(F.count("*").cast("double").alias("n"))
    return reshape.transpose(t, "r_name", ["AFRICA", "ASIA"], ["n"])


# Missing data.

_HOLES = "(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS t FROM events)"


def _holes(s, d):
    e = T(s, d, "events")
    return e.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("t"))


@plan(f"SELECT event_id, coalesce(v, -1) AS v, coalesce(t, 'none') AS t FROM {_HOLES}")
def fillna(s, d):
    return missing.fillna(_holes(s, d), {"v": -1.0, "t": "none"})


@plan(f"SELECT * FROM {_HOLES} WHERE v IS NOT NULL AND t IS NOT NULL")
def dropna_any(s, d):
    return missing.dropna(_holes(s, d))


@plan(f"SELECT * FROM {_HOLES} WHERE v IS NOT NULL OR t IS NOT NULL")
def dropna_all(s, d):
    return missing.dropna(_holes(s, d), "all", subset=["v", "t"])


@plan(f"SELECT event_id, v IS NULL AS missing_v, t IS NOT NULL AS present_t FROM {_HOLES}")
def isna(s, d):
    return _holes(s, d).select("event_id", missing.isna("v").alias("missing_v"), missing.notna("t").alias("present_t"))


@plan("SELECT event_id, CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' ELSE event_type END AS event_type FROM events")
def replace_values(s, d):
    return missing.replace(T(s, d, "events").select("event_id", "event_type"), {"view": "v", "click": "c"}, subset=["event_type"])


@plan("SELECT event_id, regexp_replace(event_type, '[aeiou]+', '_', 'g') AS event_type FROM events")
def replace_regex(s, d):
    return missing.replace_regex(T(s, d, "events").select("event_id", "event_type"), "event_type", "[aeiou]+", "_")


@plan("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def category_codes(s, d):
    return convert.category(T(s, d, "orders"), "o_orderpriority").select("o_orderkey", "code")


# The data-frame API on whole tables.

_FO = "(SELECT o_custkey, sum(o_totalprice) AS total, count(*)::DOUBLE AS n FROM orders WHERE o_orderstatus = '{}' GROUP BY 1)"
_BOTH = f"{_FO.format('F')} a FULL JOIN {_FO.format('O')} b ON a.o_custkey = b.o_custkey"


def _sides(s, d):
    from quern import frame as Q

    def of(status):
        t = T(s, d, "orders").filter(F.col("o_orderstatus") == status)
        return Q.Frame(t.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("n")), "o_custkey")

    return of("F"), of("O")


def _orders(s, d):
    from quern import frame as Q

    return Q.Frame(T(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


@plan(f"SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, round(coalesce(a.total, 0) + coalesce(b.total, 0), 2) AS total, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM {_BOTH}")
def frame_add_fill(s, d):
    a, b = _sides(s, d)
    return a.add(b, fill_value=0.0).sdf.withColumn("total", F.round("total", 2))


@plan(f"SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, round(a.total - b.total, 2) AS total, a.n - b.n AS n FROM {_BOTH}")
def frame_sub_aligned(s, d):
    a, b = _sides(s, d)
    return (a - b).sdf.withColumn("total", F.round("total", 2))


@plan(f"SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.total > b.total, false) AS total, coalesce(a.n > b.n, false) AS n FROM {_BOTH}")
def frame_gt_aligned(s, d):
    a, b = _sides(s, d)
    return (a > b).sdf


@plan("SELECT o_orderkey, 100 - o_custkey AS o_custkey, round(100 - o_totalprice, 2) AS o_totalprice FROM orders")
def frame_reflected_scalar(s, d):
    return (100 - _orders(s, d)).sdf.withColumn("o_totalprice", F.round("o_totalprice", 2))


@plan("SELECT o_orderkey, o_custkey * 2 AS o_custkey, round(o_totalprice * 0.5, 3) AS o_totalprice FROM orders")
def frame_mul_mapping(s, d):
    return _orders(s, d).mul({"o_custkey": 2, "o_totalprice": 0.5}).sdf.withColumn("o_totalprice", F.round("o_totalprice", 3))


@plan(f"SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, round(coalesce(a.total, b.total), 2) AS total, coalesce(a.n, b.n) AS n FROM {_BOTH}")
def frame_combine_first(s, d):
    a, b = _sides(s, d)
    return a.combine_first(b).sdf.withColumn("total", F.round("total", 2))


@plan(f"SELECT 'n' AS \"column\", round(corr(a.n, b.n), 6) AS corr FROM {_BOTH} WHERE a.n IS NOT NULL AND b.n IS NOT NULL UNION ALL SELECT 'total', round(corr(a.total, b.total), 6) FROM {_BOTH} WHERE a.n IS NOT NULL AND b.n IS NOT NULL")
def frame_corrwith(s, d):
    a, b = _sides(s, d)
    return a.corrwith(b).sdf.withColumn("corr", F.round("corr", 6))


@plan("SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def groupby_getitem(s, d):
    return _orders(s, d).groupby("o_custkey")["o_totalprice"].sum().sdf.withColumn("o_totalprice", F.round("o_totalprice", 2))


@plan("SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS o_custkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS o_totalprice FROM orders")
def frame_rank(s, d):
    return _orders(s, d).rank().sdf


@plan("SELECT o_orderkey, greatest(least(o_custkey, 100), 20) AS o_custkey, o_totalprice FROM orders")
def frame_clip(s, d):
    return _orders(s, d).clip(20, 100, "o_custkey").sdf


@plan("SELECT i::INT AS i, j::INT AS j, round(covar_samp(CASE i WHEN 0 THEN o_custkey ELSE o_totalprice END, CASE j WHEN 0 THEN o_custkey ELSE o_totalprice END), 3) AS v FROM orders, range(2) a(i), range(2) b(j) GROUP BY 1, 2")
def frame_cov(s, d):
    return _orders(s, d).cov(["o_custkey", "o_totalprice"]).sdf.withColumn("v", F.round("v", 3))


@plan("SELECT l_orderkey, round(sum(l_quantity) FILTER (l_linenumber = 1), 2) AS l_quantity_1, round(sum(l_quantity) FILTER (l_linenumber = 2), 2) AS l_quantity_2 FROM lineitem GROUP BY 1")
def frame_unstack(s, d):
    from quern import frame as Q

    return Q.Frame(T(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity")), ["l_orderkey", "l_linenumber"]).unstack([1, 2]).sdf


@plan("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber = 2")
def frame_xs(s, d):
    from quern import frame as Q

    return Q.Frame(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"]).xs(2, "l_linenumber").sdf


@plan("SELECT o_orderkey AS k, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 10 AND 500")
def frame_truncate_rename_axis(s, d):
    return _orders(s, d).truncate(10, 500).rename_axis("k").sdf


@plan("SELECT c_custkey AS o_custkey, round(total, 2) AS total FROM customer LEFT JOIN " + _FO.format("F") + " ON o_custkey = c_custkey")
def frame_reindex_like(s, d):
    from quern import frame as Q

    a, _ = _sides(s, d)
    like = Q.Frame(T(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(0.0).alias("total")), "o_custkey")
    return a.reindex_like(like).sdf.select("o_custkey", F.round("total", 2).alias("total"))


@plan("SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderkey)::BIGINT AS o_custkey, max(o_totalprice) OVER (ORDER BY o_orderkey) AS top FROM orders")
def frame_cumsum(s, d):
    from quern import frame as Q

    f = Q.Frame(T(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("top")), "o_orderkey", order="o_orderkey")
    return f.cumsum("o_custkey").cummax("top").sdf


@plan("SELECT o_orderkey AS label FROM orders WHERE o_orderkey IN (1, 2, 3, 64)")
def index_to_series(s, d):
    f = _orders(s, d)
    return f[f.index_frame().isin([1, 2, 3, 64])].index_frame().to_frame().rename_axis("label").sdf.select("label")


@plan("SELECT 'o_orderpriority' AS \"column\", sum(strlen(o_orderpriority))::BIGINT AS bytes FROM orders UNION ALL SELECT 'o_totalprice', count(*) * 8 FROM orders")
def frame_memory_usage(s, d):
    from quern import frame as Q

    return Q.Frame(T(s, d, "orders").select("o_orderpriority", "o_totalprice")).memory_usage().sdf
