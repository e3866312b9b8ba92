"""Decision-support queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q01(spark, d):
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, d, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(disc), 2).alias("sum_disc_price"),
            F.round(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
    )


Q01 = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus"""

PLANS = {"tpch_q01": (q01, Q01)}




def plan(sql: str):
    def put(run):
        PLANS[f"tpch_{run.__name__}"] = (run, sql)
        return run

    return put


_REV = "sum(l_extendedprice * (1 - l_discount))"


def _revenue():
    return F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))


@plan(f"SELECT l_orderkey, round({_REV}, 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY {_REV} DESC, o_orderdate, l_orderkey LIMIT 10")
def q03(spark, d):
    day = F.lit("1998-03-15").cast("timestamp")
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").filter(F.col("o_orderdate") < day).select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") > day).select("l_orderkey", "l_extendedprice", "l_discount")
    g = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("l_orderkey", "o_orderdate").agg(_revenue().alias("revenue"))
    return g.orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10).select("l_orderkey", F.round("revenue", 2).alias("revenue"), "o_orderdate")


@plan("SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def q04(spark, d):
    o = table(spark, d, "orders").filter((F.col("o_orderdate") >= F.lit("1997-07-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1997-10-01").cast("timestamp")))
    late = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return o.join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("order_count"))


@plan(f"SELECT n_name, round({_REV}, 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def q05(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region").filter("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    o = table(spark, d, "orders").filter((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")))
    j = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.groupBy("n_name").agg(F.round(_revenue(), 2).alias("revenue"))


@plan("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24")
def q06(spark, d):
    t = table(spark, d, "lineitem").filter((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")) & F.col("l_discount").between(0.045, 0.075) & (F.col("l_quantity") < 24))
    return t.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@plan(f"SELECT s.n_name AS supp_nation, c.n_name AS cust_nation, year(l_shipdate) AS l_year, round({_REV}, 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation s ON s_nationkey = s.n_nationkey JOIN nation c ON c_nationkey = c.n_nationkey WHERE (s.n_name = 'NATION_1' AND c.n_name = 'NATION_2') OR (s.n_name = 'NATION_2' AND c.n_name = 'NATION_1') GROUP BY ALL")
def q07(spark, d):
    n = table(spark, d, "nation").filter(F.col("n_name").isin("NATION_1", "NATION_2"))
    s = table(spark, d, "supplier").join(F.broadcast(n.select("n_nationkey", F.col("n_name").alias("supp_nation"))), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "supp_nation")
    c = table(spark, d, "customer").join(F.broadcast(n.select("n_nationkey", F.col("n_name").alias("cust_nation"))), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "cust_nation")
    j = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).filter("supp_nation <> cust_nation")
    return j.groupBy("supp_nation", "cust_nation", F.year("l_shipdate").cast("long").alias("l_year")).agg(F.round(_revenue(), 2).alias("revenue"))


@plan("SELECT year(o_orderdate) AS o_year, round(sum(CASE WHEN s.n_name = 'NATION_3' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 8) AS mkt_share FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey JOIN region ON c.n_regionkey = r_regionkey JOIN nation s ON s_nationkey = s.n_nationkey WHERE r_name = 'ASIA' AND p_type = 'ECONOMY' GROUP BY 1")
def q08(spark, d):
    n = table(spark, d, "nation")
    asia = n.join(table(spark, d, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"))
    c = table(spark, d, "customer").join(F.broadcast(asia), F.col("c_nationkey") == F.col("k"), "left_semi").select("c_custkey")
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    j = table(spark, d, "lineitem").join(table(spark, d, "part").filter("p_type = 'ECONOMY'").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    v = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return j.groupBy(F.year("o_orderdate").cast("long").alias("o_year")).agg(F.round(F.sum(F.when(F.col("n_name") == "NATION_3", v).otherwise(0.0)) / F.sum(v), 8).alias("mkt_share"))


@plan(f"SELECT c_custkey, c_name, round({_REV}, 2) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-04-01' AND l_returnflag = 'R' GROUP BY ALL ORDER BY {_REV} DESC, c_custkey LIMIT 20")
def q10(spark, d):
    o = table(spark, d, "orders").filter((F.col("o_orderdate") >= F.lit("1997-10-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1998-04-01").cast("timestamp")))
    j = table(spark, d, "lineitem").filter("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(_revenue().alias("revenue"))
    c = j.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.orderBy(F.desc("revenue"), "c_custkey").limit(20).select("c_custkey", "c_name", F.round("revenue", 2).alias("revenue"), "c_acctbal", "n_name")


@plan("SELECT o_orderpriority, count(*) FILTER (l_linestatus = 'O') AS open_lines, count(*) FILTER (l_linestatus <> 'O') AS other_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def q12(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("A", "R") & (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp")))
    j = li.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count_if(F.col("l_linestatus") == "O").alias("open_lines"), F.count_if(F.col("l_linestatus") != "O").alias("other_lines"))


@plan("SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) GROUP BY 1")
def q13(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    c = table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).alias("c_count"))
    return c.groupBy("c_count").agg(F.count("*").alias("custdist"))


@plan("SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1998-03-01'")
def q14(spark, d):
    v = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    j = table(spark, d, "lineitem").filter((F.col("l_shipdate") >= F.lit("1997-09-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1998-03-01").cast("timestamp"))).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.agg(F.round(100.0 * F.sum(F.when(F.col("p_type").startswith("PROMO"), v).otherwise(0.0)) / F.sum(v), 6).alias("promo_revenue"))


@plan(f"WITH r AS (SELECT l_suppkey, round({_REV}, 2) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-07-01' GROUP BY 1) SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total_revenue = (SELECT max(total_revenue) FROM r)")
def q15(spark, d):
    r = table(spark, d, "lineitem").filter((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1997-07-01").cast("timestamp"))).groupBy("l_suppkey").agg(F.round(_revenue(), 2).alias("total_revenue"))
    best = r.join(F.broadcast(r.agg(F.max("total_revenue").alias("total_revenue"))), "total_revenue")
    return best.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "total_revenue")


@plan("SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#1' AND p_size IN (1, 4, 9, 14, 19, 23, 36, 45) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL")
def q16(spark, d):
    p = table(spark, d, "part").filter((F.col("p_brand") != "Brand#1") & F.col("p_size").isin(1, 4, 9, 14, 19, 23, 36, 45))
    bad = table(spark, d, "supplier").filter("s_acctbal < 0").select("s_suppkey")
    j = table(spark, d, "lineitem").join(bad, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand", "p_type", "p_size").agg(F.count_distinct("l_suppkey").alias("supplier_cnt"))


@plan("SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT l_partkey AS k, 0.4 * avg(l_quantity) AS limit_q FROM lineitem GROUP BY 1) ON k = l_partkey WHERE p_type = 'ECONOMY' AND l_quantity < limit_q")
def q17(spark, d):
    p = table(spark, d, "part").filter("p_type = 'ECONOMY'").select("p_partkey")
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    small = li.groupBy(F.col("l_partkey").alias("k")).agg((0.4 * F.avg("l_quantity")).alias("limit_q"))
    return li.join(small, F.col("l_partkey") == F.col("k")).filter("l_quantity < limit_q").agg(F.round(F.sum("l_extendedprice") / 7.0, 4).alias("avg_yearly"))


@plan("SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 200) GROUP BY ALL ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def q18(spark, d):
    big = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity")).filter("quantity > 200")
    j = big.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "quantity")


@plan("SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30)")
def q19(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part").filter(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")), F.col("l_partkey") == F.col("p_partkey"))
    q, s, b = F.col("l_quantity"), F.col("p_size"), F.col("p_brand")
    cond = ((b == "Brand#1") & q.between(1, 11) & s.between(1, 15)) | ((b == "Brand#2") & q.between(10, 20) & s.between(1, 30)) | ((b == "Brand#3") & q.between(20, 30))
    return j.filter(cond).agg(F.round(_revenue(), 2).alias("revenue"))


@plan("SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R' AND (SELECT count(DISTINCT l_suppkey) FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey) > 1 AND (SELECT count(DISTINCT l_suppkey) FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l_returnflag = 'R') = 1 GROUP BY 1 ORDER BY numwait DESC, s_name LIMIT 100")
def q21(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    per = li.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("late")).filter("n > 1 AND late = 1").select("l_orderkey")
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    j = li.filter("l_returnflag = 'R'").join(per, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("s_name").agg(F.count("*").alias("numwait")).orderBy(F.desc("numwait"), "s_name").limit(100)


@plan("SELECT c_mktsegment, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY 1")
def q22(spark, d):
    c = table(spark, d, "customer")
    mean = c.filter("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))
    rich = c.crossJoin(F.broadcast(mean)).filter("c_acctbal > mean")
    big = table(spark, d, "orders").filter("o_totalprice > 300000").select("o_custkey")
    return rich.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("numcust"), F.round(F.sum("c_acctbal"), 2).alias("totacctbal"))


#: The tables have no partsupp; its part is taken by the pairs in lineitem, with the least unit price as cost and the quantity sold as stock.
_PS = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_supplycost, sum(l_quantity) AS ps_availqty FROM lineitem GROUP BY ALL)"


def _partsupp(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("ps_supplycost"), F.sum("l_quantity").alias("ps_availqty"))


@plan(f"WITH ps AS (SELECT * FROM {_PS} JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE') SELECT s_name, n_name, p_partkey, round(ps_supplycost, 4) AS ps_supplycost FROM part JOIN ps ON p_partkey = ps_partkey JOIN (SELECT ps_partkey AS k, min(ps_supplycost) AS c FROM ps GROUP BY 1) ON k = ps_partkey AND c = ps_supplycost WHERE p_size < 10 ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100")
def q02(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region").filter("r_name = 'EUROPE'")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "s_acctbal", "n_name")
    p = table(spark, d, "part").filter("p_size < 10").select("p_partkey")
    j = _partsupp(spark, d).join(p, F.col("ps_partkey") == F.col("p_partkey")).join(s, F.col("ps_suppkey") == F.col("s_suppkey"))
    best = j.withColumn("least", F.min("ps_supplycost").over(Window.partitionBy("ps_partkey"))).filter("ps_supplycost = least")
    return best.orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey").limit(100).select("s_name", "n_name", "p_partkey", F.round("ps_supplycost", 4).alias("ps_supplycost"))


@plan(f"SELECT n_name, year(o_orderdate) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 2) AS profit FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN {_PS} ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%a%' GROUP BY ALL")
def q09(spark, d):
    p = table(spark, d, "part").filter(F.col("p_name").contains("a")).select("p_partkey")
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    j = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(_partsupp(spark, d), (F.col("l_partkey") == F.col("ps_partkey")) & (F.col("l_suppkey") == F.col("ps_suppkey"))).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("n_name", F.year("o_orderdate").cast("long").alias("o_year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("ps_supplycost") * F.col("l_quantity")), 2).alias("profit"))


@plan(f"WITH ps AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS v FROM {_PS} JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3')) SELECT ps_partkey, round(sum(v), 2) AS worth FROM ps GROUP BY 1 HAVING sum(v) > (SELECT sum(v) * 0.001 FROM ps)")
def q11(spark, d):
    n = table(spark, d, "nation").filter(F.col("n_name").isin("NATION_1", "NATION_2", "NATION_3"))
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey")
    per = _partsupp(spark, d).join(s, F.col("ps_suppkey") == F.col("s_suppkey"), "left_semi").groupBy("ps_partkey").agg(F.sum(F.col("ps_supplycost") * F.col("ps_availqty")).alias("worth"))
    total = per.agg((F.sum("worth") * 0.001).alias("least"))
    return per.crossJoin(F.broadcast(total)).filter("worth > least").select("ps_partkey", F.round("worth", 2).alias("worth"))


@plan(f"SELECT s_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey < 5 AND s_suppkey IN (SELECT ps_suppkey FROM {_PS} WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_type LIKE 'E%') AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate < TIMESTAMP '1999-01-01'))")
def q20(spark, d):
    p = table(spark, d, "part").filter(F.col("p_type").startswith("E")).select("p_partkey")
    sold = table(spark, d, "lineitem").filter(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")).groupBy("l_partkey", "l_suppkey").agg((0.5 * F.sum("l_quantity")).alias("half"))
    ps = _partsupp(spark, d).join(p, F.col("ps_partkey") == F.col("p_partkey"), "left_semi").join(sold, (F.col("ps_partkey") == F.col("l_partkey")) & (F.col("ps_suppkey") == F.col("l_suppkey"))).filter("ps_availqty > half").select("ps_suppkey")
    return table(spark, d, "supplier").filter("s_nationkey < 5").join(ps, F.col("s_suppkey") == F.col("ps_suppkey"), "left_semi").select("s_name", "s_suppkey")
