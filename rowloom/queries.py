"""The registered queries of the engine and, for each, the same in SQL.

Programs read the whole tables. Numbers are doubles and dates are days since 1960-01-01, so the SQL casts; sums are rounded
on both sides, for the order of additions is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import stats, summary
from rowloom.session import Session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _quiet(*_: object) -> None:
    pass


def session(spark: SparkSession, sf_dir: str, *tables: str) -> Session:
    return Session(spark, _quiet).parquet(sf_dir, *tables)


def rounded(df: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return df
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def program(name: str, tables: str, text: str, sql: str | None, out: str = "out", digits: int | None = None) -> None:
    """A query that runs program text and returns the dataset `out`."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(session(spark, sf_dir, *tables.split()).run(text).frame(out), digits)

    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def call(name: str, tables: str, f: Callable[[Session], DataFrame], sql: str | None, digits: int | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(f(session(spark, sf_dir, *tables.split())), digits)

    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


DAYS = "date_diff('day', DATE '1960-01-01', CAST({} AS DATE))::DOUBLE"
LINE = "l_orderkey l_partkey l_suppkey l_quantity l_extendedprice"
LINE_SQL = "l_orderkey::DOUBLE AS l_orderkey, l_partkey::DOUBLE AS l_partkey, l_suppkey::DOUBLE AS l_suppkey, l_quantity, l_extendedprice"

# summaries

program("means_class", "lineitem", "proc means data=lineitem n mean sum min max std; class l_returnflag l_linestatus; var l_quantity l_extendedprice; output out=out; run;",
    "SELECT l_returnflag, l_linestatus, " + ", ".join(f"round({f}({v})::DOUBLE, 4) AS {v}_{s}" for v in ("l_quantity", "l_extendedprice") for s, f in (("n", "count"), ("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"))) + " FROM lineitem GROUP BY ALL", digits=4)
program("means_types", "lineitem", "proc means data=lineitem n sum; class l_returnflag l_linestatus; types () l_returnflag l_returnflag*l_linestatus; var l_quantity; output out=out; run;",
    "SELECT l_returnflag, l_linestatus, count(l_quantity)::DOUBLE AS l_quantity_n, round(sum(l_quantity), 4) AS l_quantity_sum FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linestatus))", digits=4)
program("means_ways", "orders", "proc means data=orders n mean; class o_orderstatus o_orderpriority; ways 0 1; var o_totalprice; output out=out; run;",
    "SELECT o_orderstatus, o_orderpriority, count(o_totalprice)::DOUBLE AS o_totalprice_n, round(avg(o_totalprice), 4) AS o_totalprice_mean FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))", digits=4)
program("means_percentiles", "lineitem", "proc means data=lineitem median p5 p25 p75 p95 range nmiss; class l_shipmode_; var l_extendedprice; output out=out; run;".replace("l_shipmode_", "l_returnflag"),
    "SELECT l_returnflag, round(median(l_extendedprice), 4) AS l_extendedprice_median, round(quantile_cont(l_extendedprice, 0.05), 4) AS l_extendedprice_p5, round(quantile_cont(l_extendedprice, 0.25), 4) AS l_extendedprice_p25, round(quantile_cont(l_extendedprice, 0.75), 4) AS l_extendedprice_p75, round(quantile_cont(l_extendedprice, 0.95), 4) AS l_extendedprice_p95, round(max(l_extendedprice) - min(l_extendedprice), 4) AS l_extendedprice_range, (count(*) - count(l_extendedprice))::DOUBLE AS l_extendedprice_nmiss FROM lineitem GROUP BY l_returnflag", digits=4)
program("means_missing_values", "orders", "data x; set orders; if mod(o_orderkey, 7) = 0 then o_totalprice = .; run; proc means data=x n nmiss mean max; class o_orderstatus; var o_totalprice; output out=out; run;",
    "SELECT o_orderstatus, count(v)::DOUBLE AS o_totalprice_n, (count(*) - count(v))::DOUBLE AS o_totalprice_nmiss, round(avg(v), 4) AS o_totalprice_mean, max(v) AS o_totalprice_max FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) GROUP BY o_orderstatus", digits=4)
program("means_limits_skew", "part", "proc means data=part lclm uclm skew kurt cv stderr; class p_brand; var p_retailprice; output out=out; run;", None, digits=6)
program("freq_oneway", "orders", "proc freq data=orders; tables o_orderpriority / out=out; run;",
    "SELECT o_orderpriority, count(*)::DOUBLE AS count, round(100.0 * count(*) / (SELECT count(*) FROM orders), 6) AS percent FROM orders GROUP BY 1", digits=6)
program("freq_twoway", "orders", "proc freq data=orders; tables o_orderstatus*o_orderpriority / out=out; run;",
    "SELECT a.o_orderstatus, b.o_orderpriority, coalesce(n, 0)::DOUBLE AS count, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM orders), 6) AS percent FROM (SELECT DISTINCT o_orderstatus FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) b LEFT JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) c USING (o_orderstatus, o_orderpriority)", digits=6)


def _numbers(s: Session, values: dict[str, float]) -> DataFrame:
    return stats.table(s.spark, ["statistic", "value"], [(k, float(v)) for k, v in values.items()]).visible()


call("freq_chisq", "orders", lambda s: _numbers(s, {k: v for k, v in summary.chisq(summary.crosstab(s.dataset("orders"), "o_orderstatus", "o_orderpriority")[2]).items() if k in ("chisq", "df", "lr")}),
    "WITH c AS (SELECT o_orderstatus a, o_orderpriority b, count(*)::DOUBLE n FROM orders GROUP BY ALL), e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM c), r AS (SELECT count(DISTINCT a) r, count(DISTINCT b) k FROM c) SELECT 'df' AS statistic, ((r - 1) * (k - 1))::DOUBLE AS value FROM r UNION ALL SELECT 'chisq', round(sum((n - e) ** 2 / e), 6) FROM e UNION ALL SELECT 'lr', round(2 * sum(n * ln(n / e)), 6) FROM e", digits=6)
call("freq_odds_ratio", "labels", lambda s: _numbers(s, {k: v for k, v in summary.two_by_two(summary.crosstab(s.run("data l; set labels; q = quality; t = (mod(doc_id, 3) = 0); run;").dataset("l"), "q", "t")[2]).items() if k in ("odds_ratio", "relative_risk", "risk_difference")}),
    "WITH c AS (SELECT sum((quality = 0 AND doc_id % 3 <> 0)::INT)::DOUBLE a, sum((quality = 0 AND doc_id % 3 = 0)::INT)::DOUBLE b, sum((quality = 1 AND doc_id % 3 <> 0)::INT)::DOUBLE c, sum((quality = 1 AND doc_id % 3 = 0)::INT)::DOUBLE d FROM labels) SELECT 'odds_ratio' AS statistic, round(a * d / (b * c), 6) AS value FROM c UNION ALL SELECT 'relative_risk', round((a / (a + b)) / (c / (c + d)), 6) FROM c UNION ALL SELECT 'risk_difference', round(a / (a + b) - c / (c + d), 6) FROM c", digits=6)
call("freq_kappa", "events", lambda s: _numbers(s, summary.agreement(summary.crosstab(s.run("data e; set events; a = mod(event_id, 3); b = mod(int(event_id / 2), 3); run;").dataset("e"), "a", "b")[2])),
    "WITH c AS (SELECT (event_id % 3) a, ((event_id // 2) % 3) b, count(*)::DOUBLE n FROM events GROUP BY ALL), t AS (SELECT sum(n) n, sum(CASE WHEN a = b THEN n END) o FROM c), e AS (SELECT sum(x.n * y.n) e FROM (SELECT a, sum(n) n FROM c GROUP BY a) x JOIN (SELECT b, sum(n) n FROM c GROUP BY b) y ON x.a = y.b) SELECT 'agreement' AS statistic, round(o / n, 6) AS value FROM t UNION ALL SELECT 'kappa', round((o / n - e / n / n) / (1 - e / n / n), 6) FROM t, e", digits=6)
program("univariate_moments", "part", "proc univariate data=part; var p_retailprice p_size; output out=out; run;",
    " UNION ALL ".join(f"SELECT '{v}' AS _varname_, count({v})::DOUBLE AS _n_, round(avg({v}), 4) AS _mean_, round(stddev_samp({v}), 4) AS _std_, round(var_samp({v}), 4) AS _variance_, round(skewness({v}), 4) AS _skew_, round(kurtosis({v}), 4) AS _kurt_, round(min({v})::DOUBLE, 4) AS _min_, round(max({v})::DOUBLE, 4) AS _max_, round(median({v}), 4) AS _median_, round((SELECT {v}::DOUBLE FROM part GROUP BY {v} ORDER BY count(*) DESC, {v} LIMIT 1), 4) AS _mode_, round(sum({v})::DOUBLE, 4) AS _sum_ FROM part" for v in ("p_retailprice", "p_size")), digits=4)
program("tabulate_pivot", "orders", "proc tabulate data=orders out=out; class o_orderpriority o_orderstatus; var o_totalprice; table o_orderpriority, o_orderstatus*o_totalprice*(n mean); run;",
    "SELECT o_orderpriority, s AS _stat_, " + ", ".join(f"round(CASE s WHEN 'n' THEN count(*) FILTER (o_orderstatus = '{k}') ELSE avg(o_totalprice) FILTER (o_orderstatus = '{k}') END::DOUBLE, 4) AS {k.lower()}" for k in "FOP") + " FROM orders, (VALUES ('n'), ('mean')) v(s) GROUP BY o_orderpriority, s", digits=4)
program("tabulate_pctsum", "orders", "proc tabulate data=orders out=out; class o_orderpriority o_orderstatus; var o_totalprice; table o_orderpriority, o_orderstatus*o_totalprice*(pctsum); run;",
    "SELECT o_orderpriority, 'pctsum' AS _stat_, " + ", ".join(f"round(100 * sum(o_totalprice) FILTER (o_orderstatus = '{k}') / (SELECT sum(o_totalprice) FROM orders), 4) AS {k.lower()}" for k in "FOP") + " FROM orders GROUP BY o_orderpriority", digits=4)
program("report_group_break", "orders", "proc report data=orders out=out; column o_orderstatus o_orderpriority o_totalprice; define o_orderstatus / group; define o_orderpriority / group; define o_totalprice / analysis sum; break after o_orderstatus / summarize; rbreak after / summarize; run;",
    "SELECT coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_orderpriority, '') AS o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice, CASE WHEN grouping(o_orderstatus) = 1 THEN '_rbreak_' WHEN grouping(o_orderpriority) = 1 THEN 'o_orderstatus' ELSE '' END AS _break_ FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", digits=2)

# rows: filters, projections, joins

program("subsetting_if", "lineitem", f"data out; set lineitem(keep={LINE}); if l_quantity > 45 and l_extendedprice < 30000; revenue = round(l_quantity * 2, .01); run;",
    f"SELECT {LINE_SQL}, round(l_quantity * 2, 2) AS revenue FROM lineitem WHERE l_quantity > 45 AND l_extendedprice < 30000")
program("where_option_rename", "orders", "data out; set orders(where=(o_totalprice > 250000 and o_orderstatus in ('F', 'O')) rename=(o_orderkey=k) keep=o_orderkey o_totalprice o_orderstatus); run;",
    "SELECT o_orderkey::DOUBLE AS k, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus IN ('F', 'O')")
program("missing_compares", "orders", "data out; set orders(keep=o_orderkey o_totalprice); v = o_totalprice; if mod(o_orderkey, 5) = 0 then v = .; low = (v < 100000); eq = (v = .); ge = (v >= 100000); s = sum(v, 1); a = v + 1; d = 5 / 0; keep o_orderkey low eq ge s a d; run;",
    "SELECT o_orderkey::DOUBLE AS o_orderkey, CASE WHEN v IS NULL OR v < 100000 THEN 1.0 ELSE 0.0 END::DOUBLE AS low, CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS eq, CASE WHEN v >= 100000 THEN 1.0 ELSE 0.0 END::DOUBLE AS ge, coalesce(v, 0) + 1 AS s, v + 1 AS a, NULL::DOUBLE AS d FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders)")
program("select_when", "part", "data out; set part(keep=p_partkey p_size); length band $ 8; select; when (p_size <= 10) band = 'small'; when (p_size <= 30) band = 'medium'; otherwise band = 'large'; end; select (mod(p_partkey, 3)); when (0, 1) k = 1; otherwise k = 2; end; run;",
    "SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS band, CASE WHEN p_partkey % 3 IN (0, 1) THEN 1.0 ELSE 2.0 END::DOUBLE AS k FROM part")
program("multi_output_route", "orders", "data big(keep=o_orderkey o_totalprice) out(keep=o_orderkey o_totalprice half); set orders; half = o_totalprice / 2; if o_totalprice > 200000 then output big; else output out; run;",
    "SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice, o_totalprice / 2 AS half FROM orders WHERE NOT o_totalprice > 200000")
program("do_explode_output", "part", "data out; set part(keep=p_partkey p_size); do k = 1 to p_size by 10; v = k * 2; output; end; run;",
    "SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, k::DOUBLE AS k, (k * 2)::DOUBLE AS v FROM (SELECT p_partkey, p_size, unnest(range(1, p_size + 1, 10)) AS k FROM part)")
program("array_unroll", "lineitem", f"data out; set lineitem(keep={LINE}); array a[4] a1-a4; do i = 1 to 4; a[i] = l_quantity * i; end; total = sum(of a1-a4); j = 2; pick = a[j + 1]; drop i j; run;",
    f"SELECT {LINE_SQL}, l_quantity AS a1, l_quantity * 2 AS a2, l_quantity * 3 AS a3, l_quantity * 4 AS a4, l_quantity * 10 AS total, l_quantity * 3 AS pick FROM lineitem")
program("set_concat", "customer supplier", "data out; set customer(in=c keep=c_name c_acctbal rename=(c_name=name c_acctbal=bal)) supplier(keep=s_name s_acctbal rename=(s_name=name s_acctbal=bal)); src = c; run;",
    "SELECT c_name AS name, c_acctbal AS bal, 1.0::DOUBLE AS src FROM customer UNION ALL SELECT s_name, s_acctbal, 0.0 FROM supplier")
program("set_interleave_by", "customer supplier", "data out; set customer(keep=c_nationkey c_custkey rename=(c_nationkey=n c_custkey=k)) supplier(keep=s_nationkey s_suppkey rename=(s_nationkey=n s_suppkey=k)); by n; if first.n; run;",
    "SELECT n::DOUBLE AS n, k::DOUBLE AS k FROM (SELECT n, k, row_number() OVER (PARTITION BY n ORDER BY src, k) AS r FROM (SELECT c_nationkey n, c_custkey k, 0 src FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 1 FROM supplier)) WHERE r = 1")
program("append", "nation", "data base; set nation(keep=n_nationkey n_name); run; data more; set nation(keep=n_nationkey n_regionkey); run; proc append base=base data=more; run;",
    "SELECT n_nationkey::DOUBLE AS n_nationkey, n_name, NULL::DOUBLE AS n_regionkey FROM nation UNION ALL SELECT n_nationkey, '', n_regionkey FROM nation", out="base")
program("merge_inner", "customer orders", "proc sort data=orders out=o; by o_custkey; run; data out; merge customer(in=a keep=c_custkey c_name rename=(c_custkey=k)) o(in=b keep=o_custkey o_orderkey o_totalprice rename=(o_custkey=k)); by k; if a and b; run;",
    "SELECT c_custkey::DOUBLE AS k, c_name, o_orderkey::DOUBLE AS o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
program("merge_left", "orders lineitem", "proc means data=lineitem sum noprint; class l_orderkey; var l_quantity; output out=q; run; data out; merge orders(in=a keep=o_orderkey o_orderstatus rename=(o_orderkey=k)) q(rename=(l_orderkey=k)); by k; if a; run;",
    "SELECT o_orderkey::DOUBLE AS k, o_orderstatus, round(q, 4) AS l_quantity_sum FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey", digits=4)
program("merge_anti", "orders lineitem", "data out; merge orders(in=a keep=o_orderkey o_totalprice rename=(o_orderkey=k)) lineitem(in=b keep=l_orderkey rename=(l_orderkey=k)); by k; if a and not b; run;",
    "SELECT o_orderkey::DOUBLE AS k, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
program("merge_full_in_flags", "nation supplier", "data out; merge nation(in=a keep=n_nationkey n_name rename=(n_nationkey=k)) supplier(in=b keep=s_nationkey s_suppkey rename=(s_nationkey=k)); by k; ina = a; inb = b; run;",
    "SELECT coalesce(n_nationkey, s_nationkey)::DOUBLE AS k, coalesce(n_name, '') AS n_name, s_suppkey::DOUBLE AS s_suppkey, (n_nationkey IS NOT NULL)::INT::DOUBLE AS ina, (s_nationkey IS NOT NULL)::INT::DOUBLE AS inb FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey")
program("merge_many_many_held", "customer supplier", "proc sort data=customer out=c; by c_nationkey c_custkey; run; proc sort data=supplier out=s; by s_nationkey s_suppkey; run; data out; merge c(keep=c_nationkey c_custkey rename=(c_nationkey=k)) s(keep=s_nationkey s_suppkey rename=(s_nationkey=k)); by k; run;",
    "WITH c AS (SELECT c_nationkey k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) r, count(*) OVER (PARTITION BY c_nationkey) n FROM customer), s AS (SELECT s_nationkey k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) r, count(*) OVER (PARTITION BY s_nationkey) n FROM supplier), m AS (SELECT k, max(n) n FROM (SELECT k, n FROM c UNION ALL SELECT k, n FROM s) GROUP BY k), p AS (SELECT k, unnest(range(1, n + 1)) r FROM m) SELECT p.k::DOUBLE AS k, c.c_custkey::DOUBLE AS c_custkey, s.s_suppkey::DOUBLE AS s_suppkey FROM p LEFT JOIN c ON c.k = p.k AND c.r = least(p.r, c.n) LEFT JOIN s ON s.k = p.k AND s.r = least(p.r, s.n)")
program("merge_positional", "nation region", "proc sort data=nation out=n; by n_nationkey; run; proc sort data=region out=r; by r_regionkey; run; data out; merge n(keep=n_nationkey n_name) r(keep=r_regionkey r_name); run;",
    "SELECT n_nationkey::DOUBLE AS n_nationkey, n_name, r_regionkey::DOUBLE AS r_regionkey, coalesce(r_name, '') AS r_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) i FROM nation) LEFT JOIN (SELECT *, row_number() OVER (ORDER BY r_regionkey) i FROM region) USING (i)")
program("update_overlay", "customer orders", "proc sort data=orders out=o; by o_custkey o_orderkey; run; data t; set o(keep=o_custkey o_orderkey o_totalprice); if mod(o_orderkey, 2) = 0 then o_totalprice = .; rename o_custkey = k o_totalprice = bal; drop o_orderkey; run; data out; update customer(keep=c_custkey c_acctbal rename=(c_custkey=k c_acctbal=bal)) t; by k; run;",
    "WITH t AS (SELECT o_custkey k, max_by(o_totalprice, o_orderkey) b FROM orders WHERE o_orderkey % 2 <> 0 GROUP BY 1), a AS (SELECT c_custkey k FROM customer UNION SELECT o_custkey FROM orders) SELECT a.k::DOUBLE AS k, coalesce(t.b, c_acctbal) AS bal FROM a LEFT JOIN t ON a.k = t.k LEFT JOIN customer ON a.k = c_custkey")
program("hash_find", "customer nation", "data out; set customer(keep=c_custkey c_nationkey); length n_name $ 25; if _n_ = 1 then do; declare hash h(dataset: 'nation'); h.definekey('n_nationkey'); h.definedata('n_name'); h.definedone(); end; n_nationkey = c_nationkey; if mod(c_custkey, 4) = 0 then n_nationkey = 99; rc = h.find(); keep c_custkey n_name rc; run;",
    "SELECT c_custkey::DOUBLE AS c_custkey, coalesce(n_name, '') AS n_name, CASE WHEN n_name IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS rc FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 99 ELSE c_nationkey END k FROM customer) LEFT JOIN nation ON k = n_nationkey")
program("hash_check_anti", "orders lineitem", "data out; set orders(keep=o_orderkey o_totalprice); if _n_ = 1 then do; declare hash h(dataset: 'lineitem'); h.definekey('l_orderkey'); h.definedone(); end; if h.check(key: o_orderkey) ne 0; run;",
    "SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")

# order and state

program("sort_nodupkey", "orders", "proc sort data=orders(keep=o_custkey o_orderkey o_totalprice) out=o; by o_custkey o_orderkey; run; proc sort data=o nodupkey out=out dupout=dups; by o_custkey; run;",
    "SELECT o_custkey::DOUBLE AS o_custkey, o_orderkey::DOUBLE AS o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
program("sort_dupout", "orders", "proc sort data=orders(keep=o_custkey o_orderkey) out=o; by o_custkey o_orderkey; run; proc sort data=o nodupkey out=kept dupout=out; by o_custkey; run;",
    "SELECT o_custkey::DOUBLE AS o_custkey, o_orderkey::DOUBLE AS o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1")
program("sort_desc_obs", "orders", "proc sort data=orders(keep=o_orderkey o_totalprice) out=o; by descending o_totalprice o_orderkey; run; data out; set o(firstobs=11 obs=60); run;",
    "SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
program("first_last_flags", "events", "proc sort data=events(keep=user_id event_id value) out=e; by user_id event_id; run; data out; set e; by user_id; f = first.user_id; l = last.user_id; run;",
    "SELECT user_id::DOUBLE AS user_id, event_id::DOUBLE AS event_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)::INT::DOUBLE AS f, (row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)::INT::DOUBLE AS l FROM events")
program("sum_stmt_reset", "events", "proc sort data=events(keep=user_id event_id value) out=e; by user_id event_id; run; data out; set e; by user_id; if first.user_id then do; total = 0; n = 0; end; total + value; n + 1; if last.user_id; keep user_id total n; run;",
    "SELECT user_id::DOUBLE AS user_id, round(sum(value), 4) AS total, count(*)::DOUBLE AS n FROM events GROUP BY user_id", digits=4)
program("retain_running_total", "orders", "proc sort data=orders(keep=o_orderkey o_totalprice) out=o; by o_orderkey; run; data out; set o; run_ + o_totalprice; i = _n_; run;",
    "SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice, round(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS run_, row_number() OVER (ORDER BY o_orderkey)::DOUBLE AS i FROM orders", digits=2)
program("retain_running_max", "events", "proc sort data=events(keep=user_id event_id value) out=e; by user_id event_id; run; data out; set e; by user_id; retain top; if first.user_id then top = .; top = max(top, value); run;",
    "SELECT user_id::DOUBLE AS user_id, event_id::DOUBLE AS event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS top FROM events")
program("locf", "events", "proc sort data=events(keep=event_id value) out=e; by event_id; run; data out; set e; retain seen; if mod(event_id, 3) = 0 then seen = value; run;",
    "SELECT event_id::DOUBLE AS event_id, value, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events")
program("lag_dif", "events", "proc sort data=events(keep=event_id value) out=e; by event_id; run; data out; set e; a = lag(value); b = lag3(value); c = dif(value); run;",
    "SELECT event_id::DOUBLE AS event_id, value, lag(value) OVER w AS a, lag(value, 3) OVER w AS b, value - lag(value) OVER w AS c FROM events WINDOW w AS (ORDER BY event_id)")
program("lag_by_group", "events", "proc sort data=events(keep=user_id event_id value) out=e; by user_id event_id; run; data out; set e; by user_id; p = lag(value); if first.user_id then p = .; run;",
    "SELECT user_id::DOUBLE AS user_id, event_id::DOUBLE AS event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events")
program("state_machine_sessions", "events", "proc sort data=events(keep=user_id event_id value) out=e; by user_id event_id; run; data out; set e; by user_id; retain level; if first.user_id then level = 0; if value > 50 then level = level * 0.5 + 1; else level = level + 0.25; if last.user_id; keep user_id level; run;", None, digits=6)
program("set_key_point", "nation region", "data out; do p = 25, 3, 1; set nation point=p nobs=n; output; end; stop; run;", None)
program("rank_ties", "part", "proc rank data=part(keep=p_partkey p_brand p_size) descending out=out; by p_brand; var p_size; ranks r; run;",
    "SELECT p_partkey::DOUBLE AS p_partkey, p_brand, p_size::DOUBLE AS p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS r FROM part")
program("rank_groups_by", "part", "proc rank data=part(keep=p_partkey p_brand p_retailprice) groups=4 out=out; by p_brand; var p_retailprice; ranks g; run;",
    "SELECT p_partkey::DOUBLE AS p_partkey, p_brand, p_retailprice, least(floor((rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 - 1) * 4 / count(*) OVER (PARTITION BY p_brand)), 3)::DOUBLE AS g FROM part")
program("standard_z", "part", "proc standard data=part(keep=p_partkey p_size) mean=0 std=1 out=out; var p_size; run;",
    "SELECT p_partkey::DOUBLE AS p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part), 6) AS p_size FROM part", digits=6)
program("standard_replace", "orders", "data x; set orders(keep=o_orderkey o_totalprice); if mod(o_orderkey, 9) = 0 then o_totalprice = .; run; proc standard data=x replace out=out; var o_totalprice; run;",
    "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END v FROM orders) SELECT o_orderkey::DOUBLE AS o_orderkey, round(coalesce(v, (SELECT avg(v) FROM x)), 4) AS o_totalprice FROM x", digits=4)
program("transpose_wide", "orders", "proc means data=orders sum mean noprint; class o_orderstatus; var o_totalprice; output out=m; run; proc transpose data=m out=out; by o_orderstatus; var o_totalprice_sum o_totalprice_mean; run;",
    "SELECT o_orderstatus, 'o_totalprice_sum' AS _name_, round(sum(o_totalprice), 2) AS col1 FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, 'o_totalprice_mean', round(avg(o_totalprice), 2) FROM orders GROUP BY 1", digits=2)
program("transpose_id", "orders", "proc means data=orders sum noprint; class o_orderpriority o_orderstatus; var o_totalprice; output out=m; run; proc transpose data=m prefix=s_ out=out; by o_orderpriority; id o_orderstatus; var o_totalprice_sum; run;",
    "SELECT o_orderpriority, 'o_totalprice_sum' AS _name_, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderstatus = '{k}'), 2) AS s_{k.lower()}" for k in "FOP") + " FROM orders GROUP BY 1", digits=2)
program("compare_id", "customer", "data other; set customer; if mod(c_custkey, 10) = 0 then c_acctbal = c_acctbal + 1; if mod(c_custkey, 15) = 0 then c_name = 'X'; run; proc compare base=customer compare=other out=out; id c_custkey; var c_acctbal c_name; run; data out; set out(keep=c_custkey _var_); run;",
    "SELECT c_custkey::DOUBLE AS c_custkey, 'c_acctbal' AS _var_ FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, 'c_name' FROM customer WHERE c_custkey % 15 = 0")
program("compare_criterion", "customer", "data other; set customer; c_acctbal = c_acctbal + mod(c_custkey, 4) / 10; run; proc compare base=customer compare=other criterion=0.15 out=out; id c_custkey; var c_acctbal; run; data out; set out(keep=c_custkey _var_); run;",
    "SELECT c_custkey::DOUBLE AS c_custkey, 'c_acctbal' AS _var_ FROM customer WHERE c_custkey % 4 IN (2, 3)")
program("surveyselect_strata", "orders", "proc surveyselect data=orders method=srs n=20 seed=7 out=s; strata o_orderstatus; run; proc freq data=s; tables o_orderstatus / out=out; run;",
    "SELECT o_orderstatus, 20.0::DOUBLE AS count, round(100.0 / (SELECT count(DISTINCT o_orderstatus) FROM orders), 6) AS percent FROM orders GROUP BY 1", digits=6)

# functions, formats, macro language

program("fn_string", "customer", "data out; set customer(keep=c_custkey c_name c_mktsegment); u = upcase(c_name); p = propcase(c_mktsegment); s = substr(c_name, 2, 5); w = scan(c_name, -1, '#'); c = compress(c_name, '0'); i = index(c_name, '#'); n = length(c_mktsegment); t = tranwrd(c_name, 'Customer', 'Client'); x = catx('-', c_mktsegment, c_custkey); r = reverse(c_mktsegment); v = verify(c_name, 'Custome'); l = translate(c_mktsegment, 'xy', 'AE'); f = findc(c_name, '#'); k = countw(c_mktsegment); keep c_custkey u p s w c i n t x r v l f k; run;",
    "SELECT c_custkey::DOUBLE AS c_custkey, upper(c_name) AS u, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS p, c_name[2:6] AS s, split_part(c_name, '#', -1) AS w, replace(c_name, '0', '') AS c, instr(c_name, '#')::DOUBLE AS i, length(c_mktsegment)::DOUBLE AS n, replace(c_name, 'Customer', 'Client') AS t, c_mktsegment || '-' || c_custkey AS x, reverse(c_mktsegment) AS r, (length(c_name) - length(ltrim(c_name, 'Custome')) + 1)::DOUBLE AS v, translate(c_mktsegment, 'AE', 'xy') AS l, instr(c_name, '#')::DOUBLE AS f, 1.0::DOUBLE AS k FROM customer")
program("fn_numeric", "lineitem", f"data out; set lineitem(keep={LINE}); a = int(l_extendedprice / 7); b = mod(l_quantity, 6); c = sqrt(l_quantity); d = log(l_quantity); e = max(l_quantity, 20, .); f = min(l_quantity, 20); g = mean(l_quantity, 10, .); h = n(l_quantity, .); j = floor(-l_quantity / 3); k = ceil(l_quantity / 3); m = abs(10 - l_quantity); s = sign(l_quantity - 25); t = l_quantity ** 2; q = std(l_quantity, 10, 20); run;",
    f"SELECT {LINE_SQL}, trunc(l_extendedprice / 7) AS a, l_quantity % 6 AS b, round(sqrt(l_quantity), 8) AS c, round(ln(l_quantity), 8) AS d, greatest(l_quantity, 20) AS e, least(l_quantity, 20) AS f, (l_quantity + 10) / 2 AS g, 1.0::DOUBLE AS h, floor(-l_quantity / 3) AS j, ceil(l_quantity / 3) AS k, abs(10 - l_quantity) AS m, sign(l_quantity - 25)::DOUBLE AS s, l_quantity ** 2 AS t, round(sqrt(((l_quantity - (l_quantity + 30) / 3) ** 2 + (10 - (l_quantity + 30) / 3) ** 2 + (20 - (l_quantity + 30) / 3) ** 2) / 2), 8) AS q FROM lineitem", digits=8)
program("fn_date", "orders", "data out; set orders(keep=o_orderkey o_orderdate); d = datepart(o_orderdate); y = year(d); m = month(d); k = day(d); w = weekday(d); q = qtr(d); c = intck('month', '01JAN1990'd, d); n = intnx('month', d, 1); e = intnx('year', d, -1); z = mdy(m, 1, y); keep o_orderkey d y m k w q c n e z; run;",
    f"SELECT o_orderkey::DOUBLE AS o_orderkey, {DAYS.format('o_orderdate')} AS d, year(o_orderdate)::DOUBLE AS y, month(o_orderdate)::DOUBLE AS m, day(o_orderdate)::DOUBLE AS k, (dayofweek(o_orderdate) + 1)::DOUBLE AS w, quarter(o_orderdate)::DOUBLE AS q, ((year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1)::DOUBLE AS c, {DAYS.format(chr(39).join(('date_trunc(', 'month', ', o_orderdate) + INTERVAL 1 MONTH')))} AS n, {DAYS.format(chr(39).join(('date_trunc(', 'year', ', o_orderdate) - INTERVAL 1 YEAR')))} AS e, {DAYS.format(chr(39).join(('date_trunc(', 'month', ', o_orderdate)')))} AS z FROM orders")
program("fn_conditional", "orders", "data out; set orders(keep=o_orderkey o_totalprice o_orderstatus); a = ifn(o_totalprice > 100000, 1, 2); b = ifc(o_orderstatus = 'F', 'done', 'open'); c = coalesce(., o_totalprice, 3); d = coalescec(' ', o_orderstatus); e = missing(o_orderstatus); f = (o_orderstatus = 'F') + (o_totalprice > 5); g = input('12.5', 8.); h = o_totalprice between 1000 and 50000; keep o_orderkey a b c d e f g h; run;",
    "SELECT o_orderkey::DOUBLE AS o_orderkey, CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 2.0 END::DOUBLE AS a, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS b, o_totalprice AS c, o_orderstatus AS d, 0.0::DOUBLE AS e, ((o_orderstatus = 'F')::INT + (o_totalprice > 5)::INT)::DOUBLE AS f, 12.5::DOUBLE AS g, (o_totalprice BETWEEN 1000 AND 50000)::INT::DOUBLE AS h FROM orders")
program("fmt_put", "orders", "data out; set orders(keep=o_orderkey o_orderdate); d = datepart(o_orderdate); a = put(d, date9.); b = put(d, yymmdd10.); c = put(d, mmddyy10.); z = put(o_orderkey, z8.); e = put(o_orderkey * 1000, comma12.); f = put(o_orderkey, dollar12.2); keep o_orderkey a b c z e f; run;",
    "SELECT o_orderkey::DOUBLE AS o_orderkey, upper(strftime(o_orderdate, '%d%b%Y')) AS a, strftime(o_orderdate, '%Y-%m-%d') AS b, strftime(o_orderdate, '%m/%d/%Y') AS c, lpad(o_orderkey::VARCHAR, 8, '0') AS z, format('{:,}', o_orderkey * 1000) AS e, '$' || format('{:,}', o_orderkey) || '.00' AS f FROM orders")
program("user_format_range", "part", "proc format; value band low-<1000 = 'cheap' 1000-<1500 = 'fair' 1500-high = 'dear'; value $brand 'Brand#1' = 'one' other = 'rest'; run; data out; set part(keep=p_partkey p_retailprice p_brand); a = put(p_retailprice, band.); b = put(p_brand, $brand.); run;",
    "SELECT p_partkey::DOUBLE AS p_partkey, p_retailprice, p_brand, CASE WHEN p_retailprice < 1000 THEN 'cheap' WHEN p_retailprice < 1500 THEN 'fair' ELSE 'dear' END AS a, CASE WHEN p_brand = 'Brand#1' THEN 'one' ELSE 'rest' END AS b FROM part")
program("fcmp_inline", "part", "proc fcmp; function tier(p) $; if p < 1000 then return('low'); if p < 1500 then return('mid'); return('top'); endsub; function sq(x); y = x * x; return(y + 1); endsub; run; data out; set part(keep=p_partkey p_size p_retailprice); t = tier(p_retailprice); s = sq(p_size); run;",
    "SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, p_retailprice, CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'mid' ELSE 'top' END AS t, (p_size * p_size + 1)::DOUBLE AS s FROM part")
program("macro_loop", "orders", "%let limit = 150000; %macro parts(n); %do i = 1 %to &n; data p&i; set orders(keep=o_orderkey o_totalprice); if mod(o_orderkey, &n) = %eval(&i - 1) and o_totalprice > &limit; part = &i; run; %end; data out; set %do i = 1 %to &n; p&i %end; ; run; %mend; %parts(3)",
    "SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice, (o_orderkey % 3 + 1)::DOUBLE AS part FROM orders WHERE o_totalprice > 150000")

# embedded SQL

program("sql_join_agg", "customer orders nation", "proc sql; create table out as select n_name, count(*) as n, sum(o_totalprice) as s from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name; quit;",
    "SELECT n_name, count(*)::DOUBLE AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", digits=2)
program("sql_window", "orders", "proc sql; create table out as select o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc) as r from orders; quit;",
    "SELECT o_orderkey::DOUBLE AS o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)::DOUBLE AS r FROM orders")
program("sql_setops", "customer supplier", "proc sql; create table out as select c_nationkey as k from customer except select s_nationkey from supplier union all (select s_nationkey from supplier intersect select c_nationkey from customer); quit;",
    "SELECT k::DOUBLE AS k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier UNION ALL (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer))")
program("sql_cte", "orders", "proc sql; create table out as with m as (select o_custkey, max(o_totalprice) as top from orders group by o_custkey) select o.o_orderkey, m.top from orders o join m on o.o_custkey = m.o_custkey and o.o_totalprice = m.top; quit;",
    "WITH m AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1) SELECT o.o_orderkey::DOUBLE AS o_orderkey, m.top FROM orders o JOIN m ON o.o_custkey = m.o_custkey AND o.o_totalprice = m.top")
program("sql_qualify", "orders", "proc sql; create table out as select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2; quit;",
    "SELECT o_custkey::DOUBLE AS o_custkey, o_orderkey::DOUBLE AS o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
program("sql_asof", "events", "data quotes; set events(keep=event_id user_id value); where mod(event_id, 3) = 0; rename event_id = q_id value = q; run; data trades; set events(keep=event_id user_id); where mod(event_id, 3) = 1; run; proc sql; create table out as select t.event_id, x.q_id, x.q from trades t asof left join quotes x on t.user_id = x.user_id and t.event_id >= x.q_id; quit;",
    "WITH q AS (SELECT event_id q_id, user_id, value q FROM events WHERE event_id % 3 = 0) SELECT t.event_id::DOUBLE AS event_id, x.q_id::DOUBLE AS q_id, x.q FROM (SELECT event_id, user_id FROM events WHERE event_id % 3 = 1) t ASOF LEFT JOIN q x ON t.user_id = x.user_id AND t.event_id >= x.q_id")

# statistics

call("corr_pairs", "lineitem", lambda s: stats.corr(s.dataset("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).visible().select("_name_", "with", "n", "r"),
    " UNION ALL ".join(f"SELECT '{a}' AS _name_, '{b}' AS \"with\", count(*)::DOUBLE AS n, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount") for b in ("l_quantity", "l_extendedprice", "l_discount")), digits=6)
call("reg_coeffs", "lineitem", lambda s: stats.regress(s.dataset("lineitem"), "l_extendedprice", ["l_quantity"]).estimates(s.spark).visible().select("parameter", "estimate"),
    "SELECT 'intercept' AS parameter, round(regr_intercept(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem", digits=4)
program("reg_scored", "part", "proc reg data=part; model p_retailprice = p_size; output out=o p=yhat r=res; run; data out; set o(keep=p_partkey yhat res); run;",
    "SELECT p_partkey::DOUBLE AS p_partkey, round((SELECT regr_intercept(p_retailprice, p_size) FROM part) + (SELECT regr_slope(p_retailprice, p_size) FROM part) * p_size, 4) AS yhat, round(p_retailprice - (SELECT regr_intercept(p_retailprice, p_size) FROM part) - (SELECT regr_slope(p_retailprice, p_size) FROM part) * p_size, 4) AS res FROM part", digits=4)
program("ttest_pooled", "lineitem", "data x; set lineitem; where l_linestatus in ('F', 'O'); run; proc ttest data=x out=t; class l_linestatus; var l_extendedprice; run; data out; set t(keep=method difference df t); where method = 'pooled'; run;",
    "WITH g AS (SELECT l_linestatus k, count(*)::DOUBLE n, avg(l_extendedprice) m, var_samp(l_extendedprice) v FROM lineitem GROUP BY 1), p AS (SELECT a.m - b.m d, a.n + b.n - 2 df, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n) v FROM g a, g b WHERE a.k = 'F' AND b.k = 'O') SELECT 'pooled' AS method, round(d, 6) AS difference, df, round(d / sqrt(v), 6) AS t FROM p", digits=6)
program("anova_oneway", "part", "proc anova data=part out=a; class p_brand; model p_retailprice = p_brand; run; data out; set a(keep=source df ss f); run;",
    "WITH g AS (SELECT count(*)::DOUBLE n, avg(p_retailprice) m, var_samp(p_retailprice) * (count(*) - 1) w FROM part GROUP BY p_brand), t AS (SELECT (SELECT avg(p_retailprice) FROM part) mu, count(*)::DOUBLE k, sum(n) n, sum(w) w FROM g), b AS (SELECT sum(g.n * (m - mu) ** 2) b FROM g, t) SELECT 'p_brand' AS source, k - 1 AS df, round(b, 2) AS ss, round(b / (k - 1) / (w / (n - k)), 2) AS f FROM t, b UNION ALL SELECT 'error', n - k, round(w, 2), NULL FROM t UNION ALL SELECT 'total', n - 1, round(b + w, 2), NULL FROM t, b", digits=2)
call("npar_ranksum", "part", lambda s: stats.npar1way(s.dataset("part"), "p_size", "p_brand")["scores"].visible(),
    "WITH r AS (SELECT p_brand, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS r FROM part) SELECT p_brand, count(*)::DOUBLE AS n, round(sum(r), 4) AS sum_of_scores, round(count(*) * ((SELECT count(*) FROM part) + 1) / 2.0, 4) AS expected, round(avg(r), 4) AS mean_score FROM r GROUP BY p_brand", digits=4)
program("lifetest_km", "orders", "data x; set orders; t = mod(o_orderkey, 50) + 1; c = (mod(o_custkey, 4) ne 0); run; proc lifetest data=x out=out; time t*c(0); run;",
    "WITH x AS (SELECT (o_orderkey % 50 + 1)::DOUBLE t, (o_custkey % 4 <> 0)::INT c FROM orders), g AS (SELECT t, sum(c)::DOUBLE d, count(*)::DOUBLE m FROM x GROUP BY t), r AS (SELECT t, d, sum(m) OVER (ORDER BY t DESC) n FROM g), s AS (SELECT t, n, d, CASE WHEN max((d >= n)::INT) OVER (ORDER BY t) = 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) END) OVER (ORDER BY t)) END AS s, sum(CASE WHEN d < n THEN d / (n * (n - d)) END) OVER (ORDER BY t) v FROM r) SELECT t, n AS \"left\", d AS failed, round(s, 6) AS survival, round(s * sqrt(coalesce(v, 0)), 6) AS stderr FROM s", digits=6)
program("timeseries_decomp", "orders", "data d; set orders; day = datepart(o_orderdate); run; proc means data=d sum noprint; class day; var o_totalprice; output out=m; run; proc sort data=m; by day; run; proc timeseries data=m out=out; var o_totalprice_sum; decomp / period=7; run;",
    "WITH d AS (SELECT row_number() OVER (ORDER BY CAST(o_orderdate AS DATE))::DOUBLE i, sum(o_totalprice) y FROM orders GROUP BY CAST(o_orderdate AS DATE)), t AS (SELECT i, y, CASE WHEN count(*) OVER w = 7 THEN avg(y) OVER w END AS t FROM d WINDOW w AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), s AS (SELECT (i - 1) % 7 k, avg(y - t) m FROM t GROUP BY 1), z AS (SELECT k, m - (SELECT avg(m) FROM s) s FROM s) SELECT i AS period, round(y, 2) AS observed, round(t, 2) AS trend, round(s, 2) AS seasonal, round(y - t - s, 2) AS residual FROM t JOIN z ON (i - 1) % 7 = k", digits=2)
_EVENTS = "data x; set events; y = (value > 50); a = mod(event_id, 11); b = mod(user_id, 7); run;"
call("logistic_coefs", "events", lambda s: stats.glm(s.run(_EVENTS).dataset("x"), "y", ["a", "b"]).estimates(s.spark).visible(), None, digits=4)
call("genmod_poisson", "lineitem", lambda s: stats.glm(s.dataset("lineitem"), "l_quantity", ["l_discount", "l_tax"], family="poisson").estimates(s.spark).visible(), None, digits=4)
call("robustreg_coefs", "part", lambda s: stats.robust(s.dataset("part"), "p_retailprice", ["p_size"]).estimates(s.spark).visible(), None, digits=3)
call("quantreg_median", "part", lambda s: stats.quantile_regress(s.dataset("part"), "p_retailprice", ["p_size"], rounds=30).estimates(s.spark).visible().select("parameter", "estimate"), None, digits=1)
call("mixed_random_intercept", "orders", lambda s: stats.mixed(s.run("data x; set orders; m = mod(o_orderkey, 10); run;").dataset("x"), "o_totalprice", ["m"], "o_custkey").estimates(s.spark).visible(), None, digits=2)
call("phreg_cox", "orders", lambda s: stats.phreg(s.run("data x; set orders; t = mod(o_orderkey, 50) + 1; c = (mod(o_custkey, 4) ne 0); z = mod(o_custkey, 5); run;").dataset("x"), "t", "c", [0.0], ["z"]).estimates(s.spark).visible(), None, digits=4)
call("nlin_growth", "part", lambda s: s.run("proc nlin data=part; parms a=900 b=1; model p_retailprice = a + b * p_size; run;").values["nlin.fit"].estimates(s.spark).visible().select("parameter", "estimate"),
    "SELECT 'a' AS parameter, round(regr_intercept(p_retailprice, p_size), 2) AS estimate FROM part UNION ALL SELECT 'b', round(regr_slope(p_retailprice, p_size), 2) FROM part", digits=2)
call("princomp_values", "lineitem", lambda s: stats.princomp(s.dataset("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])["eigenvalues"].visible(), None, digits=5)
call("factor_loadings", "lineitem", lambda s: stats.factor(s.dataset("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 1)["loadings"].visible(), None, digits=2)
call("cancorr_values", "lineitem", lambda s: stats.cancorr(s.dataset("lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"])["correlations"].visible(), None, digits=4)
call("pls_variation", "lineitem", lambda s: stats.pls(s.dataset("lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])["variation"].visible(), None, digits=5)
call("discrim_confusion", "lineitem", lambda s: stats.discrim(s.dataset("lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"])["confusion"].visible(), None)
call("hpsplit_importance", "lineitem", lambda s: stats.hpsplit(s.dataset("lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"], 4)["importance"].visible(), None, digits=4)
call("fastclus_means", "part", lambda s: stats.fastclus(s.dataset("part"), ["p_size", "p_retailprice"], 3)["means"].visible(), None, digits=2)
call("cluster_merges", "nation", lambda s: stats.cluster(s.dataset("nation"), ["n_nationkey", "n_regionkey"], "ward").visible(), None, digits=4)
call("arima_forecast", "orders", lambda s: stats.arima(s.run("data d; set orders; m = intnx('month', datepart(o_orderdate), 0); run; proc means data=d sum noprint; class m; var o_totalprice; output out=mm; run; proc sort data=mm; by m; run;").dataset("mm"), "o_totalprice_sum", 1, 0, 0, 6)["forecast"].visible(), None, digits=0)

# functions, statements and procedures beside those above

SECONDS = "date_diff('second', TIMESTAMP '1960-01-01', CAST({} AS TIMESTAMP))"
program("fn_string_more", "customer", "data out; set customer(keep=c_custkey c_name c_mktsegment); a = lowcase(c_mktsegment); b = trim(c_name) || '!'; c = strip('  ' || c_mktsegment); d = left('   ' || c_name); e = compbl('a    b ' || c_name); f = lengthn(c_name); g = indexc(c_name, '123'); h = findw('the ' || trim(c_mktsegment) || ' end', 'end'); i = cat(c_name, c_mktsegment); j = cats(c_name, c_mktsegment); k = quote(trim(c_mktsegment)); l = dequote(quote(trim(c_name))); m = prxmatch('/0+1/', c_name); n = repeat('ab', 2); drop c_name c_mktsegment; run;",
    "SELECT c_custkey::DOUBLE AS c_custkey, lower(c_mktsegment) AS a, c_name || '!' AS b, c_mktsegment AS c, c_name AS d, 'a b ' || c_name AS e, length(c_name)::DOUBLE AS f, length(regexp_extract(c_name, '^[^123]*[123]'))::DOUBLE AS g, (length(c_mktsegment) + 6)::DOUBLE AS h, c_name || c_mktsegment AS i, c_name || c_mktsegment AS j, '\"' || c_mktsegment || '\"' AS k, c_name AS l, (CASE WHEN regexp_matches(c_name, '0+1') THEN length(regexp_extract(c_name, '^(.*?)0+1', 1)) + 1 ELSE 0 END)::DOUBLE AS m, 'ababab' AS n FROM customer")
program("fn_numeric_more", "part", "data out; set part(keep=p_partkey p_size p_retailprice); if mod(p_partkey, 4) = 0 then z = .; else z = p_size; a = exp(p_size / 50); b = log10(p_retailprice); c = nmiss(z, p_size, .); d = n(z, p_size); drop p_retailprice; run;",
    "SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, z::DOUBLE AS z, round(exp(p_size / 50.0), 4) AS a, round(log10(p_retailprice), 4) AS b, ((z IS NULL)::INT + 1)::DOUBLE AS c, ((z IS NOT NULL)::INT + 1)::DOUBLE AS d FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS z FROM part)", digits=4)
program("fn_time", "events", "data out; set events(keep=event_id ts); t = timepart(ts); h = hour(ts); m = minute(ts); s = int(second(ts)); x = hms(1, 2, 3); y = dhms(datepart(ts), 0, 1, 0) - datepart(ts) * 86400; d = '01jan1960:00:01:00'dt; e = '12:30't; f = '05mar2024'd; t = int(t); drop ts; run;",
    f"SELECT event_id::DOUBLE AS event_id, ({SECONDS.format('ts')} % 86400)::DOUBLE AS t, hour(ts)::DOUBLE AS h, minute(ts)::DOUBLE AS m, floor(second(ts))::DOUBLE AS s, 3723.0::DOUBLE AS x, 60.0::DOUBLE AS y, 60.0::DOUBLE AS d, 45000.0::DOUBLE AS e, date_diff('day', DATE '1960-01-01', DATE '2024-03-05')::DOUBLE AS f FROM events")
program("formats_more", "orders", "data out; set orders(keep=o_orderkey o_totalprice o_orderstatus o_orderdate); a = put(o_orderkey, 8.); b = put(o_totalprice, 12.1); c = put(o_orderstatus, $1.); d = put(datepart(o_orderdate), ddmmyy10.); e = put(datepart(o_orderdate), monyy7.); f = put(datepart(o_orderdate), worddate.); g = put(mod(o_orderkey, 86400), time8.); h = input('1,234', comma8.) + input('05/03/2024', ddmmyy10.); a = strip(a); b = strip(b); f = strip(f); g = strip(g); keep o_orderkey a b c d e f g h; run;",
    "SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderkey::VARCHAR AS a, printf('%.1f', o_totalprice) AS b, o_orderstatus AS c, strftime(o_orderdate, '%d/%m/%Y') AS d, upper(strftime(o_orderdate, '%b%Y')) AS e, strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS f, printf('%d:%02d:%02d', (o_orderkey % 86400) // 3600, (o_orderkey % 3600) // 60, o_orderkey % 60) AS g, (1234 + date_diff('day', DATE '1960-01-01', DATE '2024-03-05'))::DOUBLE AS h FROM orders")
program("where_contains_like", "part", "data out; set part(keep=p_partkey p_name p_type); where p_name contains 'a' and p_type like '%S%'; run;",
    "SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_type FROM part WHERE p_name LIKE '%a%' AND p_type LIKE '%S%'")
program("return_and_attributes", "orders", "data out; length size $ 5; set orders(keep=o_orderkey o_totalprice); attrib k label='key' format=8.; label o_totalprice='price'; k = o_orderkey + 1; if o_totalprice < 100000 then do; size = 'small'; return; end; size = 'large'; twice = o_totalprice * 2; rename k=next; run;",
    "SELECT CASE WHEN o_totalprice < 100000 THEN 'small' ELSE 'large' END AS size, o_orderkey::DOUBLE AS o_orderkey, o_totalprice, (o_orderkey + 1)::DOUBLE AS next, CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_totalprice * 2 END AS twice FROM orders")
program("do_over_list_and_dim", "part", "data out; set part(keep=p_partkey p_size); array v p_size w; w = 5; total = 0; do over v; total = total + v; end; do k = 1, 3, 9; total = total + k; end; array a[3] a1-a3 (1 2 3); d = dim(a) + hbound(a) * 10 + lbound(a) * 100; keep p_partkey total d; run;",
    "SELECT p_partkey::DOUBLE AS p_partkey, (p_size + 18)::DOUBLE AS total, 133.0::DOUBLE AS d FROM part")
program("do_while_rows", "part", "data out; set part(keep=p_partkey p_size); n = 0; x = p_size; do while (x > 1); x = x / 2; n = n + 1; if n > 20 then leave; end; m = 0; do until (m >= p_size); m = m + 7; end; odd = 0; do k = 1 to 5; if mod(k, 2) = 0 then continue; odd = odd + k; end; drop k x; run;",
    "SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, greatest(0, ceil(log2(p_size)))::DOUBLE AS n, (ceil(greatest(p_size, 1) / 7.0) * 7)::DOUBLE AS m, 9.0::DOUBLE AS odd FROM part")
program("hash_changes", "nation", "data out(keep=n_nationkey n_regionkey seen total left); length n_regionkey total 8; if _n_ = 1 then do; declare hash h(); h.definekey('n_regionkey'); h.definedata('total'); h.definedone(); end; set nation; if h.find() ne 0 then total = 0; total = total + n_nationkey; h.replace(); seen = (h.check() = 0); left = h.num_items; run;",
    "SELECT n_nationkey::DOUBLE AS n_nationkey, n_regionkey::DOUBLE AS n_regionkey, 1.0::DOUBLE AS seen, (sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::DOUBLE AS total, (SELECT count(DISTINCT m.n_regionkey) FROM nation m WHERE m.n_nationkey <= nation.n_nationkey)::DOUBLE AS \"left\" FROM nation")
program("set_end_nobs", "nation", "data out(keep=n_nationkey rows final); set nation end=last nobs=k; rows = k; final = last; run;",
    "SELECT n_nationkey::DOUBLE AS n_nationkey, (SELECT count(*) FROM nation)::DOUBLE AS rows, (n_nationkey = (SELECT max(n_nationkey) FROM nation))::INT::DOUBLE AS final FROM nation")
program("stop_step", "nation", "data out; set nation(keep=n_nationkey); if n_nationkey >= 5 then stop; run;", "SELECT n_nationkey::DOUBLE AS n_nationkey FROM nation WHERE n_nationkey < 5")
program("lag_expression", "events", "proc sort data=events(keep=event_id value) out=e; by event_id; run; data out; set e; d = value - lag(value); run;",
    "SELECT event_id::DOUBLE AS event_id, value, round(value - lag(value) OVER (ORDER BY event_id), 6) AS d FROM events", digits=6)
program("freq_three_way", "lineitem", "proc freq data=lineitem; tables l_returnflag*l_linestatus*l_linenumber / out=out; run; data out; set out; if count > 0; keep l_returnflag l_linestatus l_linenumber count; run;",
    "SELECT l_returnflag, l_linestatus, l_linenumber::DOUBLE AS l_linenumber, count(*)::DOUBLE AS count FROM lineitem GROUP BY ALL")
program("sql_outer_union_corr", "nation region", "proc sql; create table out as select n_nationkey as k, n_name as name from nation outer union corr select r_regionkey as k, r_name as region from region; quit;",
    "SELECT n_nationkey::DOUBLE AS k, n_name AS name, NULL AS region FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
program("sql_dialect", "orders", "proc sql; create table out as select * exclude (o_orderdate, o_custkey, total), total / (o_custkey - o_custkey) as nothing from (select *, o_totalprice as total, strftime(date '2024-01-31', '%Y-%m') as calculated_ from work.orders) qualify row_number() over (partition by o_orderstatus order by o_orderkey) <= 3; quit;",
    "SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, NULL::DOUBLE AS nothing, '2024-01' AS calculated_ FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 3")
program("sql_window_filter", "orders", "proc sql; create table out as select o_orderkey, count(*) filter (where o_totalprice > 100000) over (partition by o_orderstatus) as n, row_number() over (partition by o_custkey order by o_orderkey) as r, quantile_cont(o_totalprice, 0.5) over (partition by o_orderpriority) as q from orders; quit;",
    "SELECT o_orderkey::DOUBLE AS o_orderkey, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_orderstatus)::DOUBLE AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::DOUBLE AS r, round(quantile_cont(o_totalprice, 0.5) OVER (PARTITION BY o_orderpriority), 4) AS q FROM orders", digits=4)
program("sql_into", "orders", "proc sql noprint; select count(*), max(o_orderkey) into :n, :m from orders; quit; data out; set orders(keep=o_orderkey where=(o_orderkey = &m)); n = &n; run;",
    "SELECT max(o_orderkey)::DOUBLE AS o_orderkey, count(*)::DOUBLE AS n FROM orders")
program("macro_loops", "nation", "%global total; %let total = 0; %let i = 0; %macro up(n); %local k; %let k = 1; %do %while (&k <= &n); %let total = %eval(&total + &k); %let k = %eval(&k + 1); %end; %do %until (&i >= 3); %let i = %eval(&i + 1); %end; %put total is &total; %mend; %up(4) data out; set nation(keep=n_nationkey); t = &total; i = &i; h = %sysevalf(7 / 2); u = \"%upcase(ab)%substr(xyz, 2, 1)\"; w = \"%scan(a b c, 2)\"; l = %length(abcd); x = %sysfunc(max(3, 9)); run;",
    "SELECT n_nationkey::DOUBLE AS n_nationkey, 10.0::DOUBLE AS t, 3.0::DOUBLE AS i, 3.5::DOUBLE AS h, 'ABy' AS u, 'b' AS w, 4.0::DOUBLE AS l, 9.0::DOUBLE AS x FROM nation")
program("call_symput", "nation", "data _null_; set nation; if n_nationkey = 7 then do; call symput('name', trim(n_name)); call symputx('k', n_nationkey * 2); end; run; data out; set nation(keep=n_nationkey); name = \"&name\"; k = &k; run;",
    "SELECT n_nationkey::DOUBLE AS n_nationkey, (SELECT n_name FROM nation WHERE n_nationkey = 7) AS name, 14.0::DOUBLE AS k FROM nation")
program("call_missing", "nation", "data out; set nation(keep=n_nationkey n_name n_regionkey); if n_regionkey = 1 then call missing(n_name, n_regionkey); run;",
    "SELECT n_nationkey::DOUBLE AS n_nationkey, CASE WHEN n_regionkey = 1 THEN '' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END::DOUBLE AS n_regionkey FROM nation")
program("datasets_change", "region", "data a; set region; run; data b; set region; run; proc datasets lib=work; delete b; change a=out; run;", "SELECT r_regionkey::DOUBLE AS r_regionkey, r_name FROM region")
program("contents_orders", "orders", "proc contents data=orders out=out; run; data out; set out(keep=num name type nobs); run;",
    "SELECT (row_number() OVER ())::DOUBLE AS num, name, type, (SELECT count(*) FROM orders)::DOUBLE AS nobs FROM (VALUES ('o_orderkey', 'num'), ('o_custkey', 'num'), ('o_orderstatus', 'char'), ('o_totalprice', 'num'), ('o_orderdate', 'num'), ('o_orderpriority', 'char')) v(name, type)")
program("datalines", "", "data out; input id name $ x; datalines;\n1 ann 2.5\n2 bob .\n3 cat 4\n;\nrun;", "SELECT * FROM (VALUES (1.0::DOUBLE, 'ann', 2.5::DOUBLE), (2.0, 'bob', NULL), (3.0, 'cat', 4.0)) v(id, name, x)")
program("fcmp_subroutine", "part", "proc fcmp outlib=work.f.p; subroutine halves(x, a, b); outargs a, b; a = x / 2; b = x - a; endsub; function total(v[*]); t = 0; do k = 1 to dim(v); t = t + v[k]; end; return (t); endsub; run; data out; set part(keep=p_partkey p_size); array w[2] w1-w2; a = 0; b = 0; call halves(p_size, a, b); w1 = a; w2 = b * 2; t = total(w); drop w1 w2; run;",
    "SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, p_size / 2.0::DOUBLE AS a, p_size / 2.0::DOUBLE AS b, p_size * 1.5::DOUBLE AS t FROM part")
program("compare_by_transform", "supplier", "data a; set supplier(keep=s_suppkey s_nationkey s_acctbal); run; data b; set a; if mod(s_suppkey, 3) = 0 then s_acctbal = -s_acctbal; if mod(s_suppkey, 5) = 0 then s_acctbal = s_acctbal + 1000000; run; proc compare base=a(where=(s_suppkey > 2)) compare=b out=out criterion=0.001; by s_nationkey; id s_suppkey; transform s_acctbal = abs; run; data out; set out(keep=s_nationkey s_suppkey _var_); run;",
    "SELECT s_nationkey::DOUBLE AS s_nationkey, s_suppkey::DOUBLE AS s_suppkey, 's_acctbal' AS _var_ FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN -s_acctbal ELSE s_acctbal END + CASE WHEN s_suppkey % 5 = 0 THEN 1000000 ELSE 0 END AS b FROM supplier) WHERE s_suppkey > 2 AND abs(abs(s_acctbal) - abs(b)) > 0.001")
program("tabulate_two_classes", "lineitem", "proc tabulate data=lineitem out=out; class l_returnflag l_linestatus l_linenumber; var l_quantity; table l_returnflag*l_linestatus, l_linenumber*l_quantity*(sum); run;",
    "SELECT l_returnflag, l_linestatus, 'sum' AS _stat_, " + ", ".join(f"sum(l_quantity) FILTER (l_linenumber = {k}) AS \"{k}\"" for k in range(1, 8)) + " FROM lineitem GROUP BY ALL", digits=4)
program("rank_all_rows", "orders", "proc rank data=orders(keep=o_orderkey o_totalprice) out=out descending; var o_totalprice; ranks r; run;",
    "SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice, rank() OVER (ORDER BY o_totalprice DESC) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS r FROM orders")
program("sql_asof_all", "events", "proc sql; create table trades as select event_id, user_id, value from events; create table quotes as select event_id as q_id, user_id as q_user, value as q_value from events; create table out as select t.event_id, t.value, q.q_id, q.q_value from trades t asof left join quotes q on t.user_id = q.q_user and t.event_id > q.q_id; quit;",
    "SELECT event_id::DOUBLE AS event_id, value, (lag(event_id) OVER w)::DOUBLE AS q_id, lag(value) OVER w AS q_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
