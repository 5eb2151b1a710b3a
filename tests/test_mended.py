"""Options of COMPARE, APPEND and TABULATE, SQL of other dialects, ranks without groups."""

import pytest
from pyspark.sql import functions as F


def rows(session, name, *columns):
    return [tuple(r[c] for c in columns) for r in session.frame(name).collect()]


@pytest.fixture
def pair(session):
    return session.run("""
        data old; input grp $ id x; datalines;
    a 1 10
    a 2 20
    b 1 -4
    b 2 40
    ;
    run;
        data new; input grp $ id x; datalines;
    a 1 10
    a 2 99
    b 1 4
    b 2 40
    ;
    run;
    """)


def test_compare_by(pair):
    pair.run("proc compare base=old compare=new out=d; by grp; id id; run;")
    assert sorted(rows(pair, "d", "grp", "id", "_var_", "_base_", "_compare_")) == [("a", 2.0, "x", "20", "99"), ("b", 1.0, "x", "-4", "4")]
    pair.run("proc compare base=old compare=new out=d; by grp; run;")
    assert sorted(rows(pair, "d", "grp", "_obs_")) == [("a", 2.0), ("b", 1.0)]


def test_compare_transform_and_options(pair):
    pair.run("proc compare base=old(where=(id = 1)) compare=new out=d; by grp; id id; transform x = abs; run;")
    assert rows(pair, "d", "grp") == []
    with pytest.raises(ValueError, match="TRANSFORM"):
        pair.run("proc compare base=old compare=new out=d; transform x = cube; run;")


def test_append_options_of_base(pair):
    pair.run("proc append base=old(where=(x > 15)) data=new(where=(x > 90)); run;")
    assert sorted(rows(pair, "old", "x")) == [(20.0,), (40.0,), (99.0,)]


def test_sql_division_and_dates(session):
    session.run("data a; do x = 0 to 2; output; end; run; proc sql; create table o as select x, 6 / x as q, strftime(date '2024-03-05' + cast(x as int), '%Y/%m/%d') as d from a; quit;")
    assert sorted(rows(session, "o", "x", "q", "d")) == [(0.0, None, "2024/03/05"), (1.0, 6.0, "2024/03/06"), (2.0, 3.0, "2024/03/07")]


def test_sql_nulls_go_last_and_window_filter(session):
    session.run("data a; input x g; datalines;\n3 1\n. 1\n1 2\n2 2\n;\nrun; proc sql; create table o as select x, row_number() over (order by x) as r, sum(x) filter (where x > 1) over (partition by g) as s from a; quit;")
    assert sorted(rows(session, "o", "r", "x", "s")) == [(1, 1.0, 2.0), (2, 2.0, 2.0), (3, 3.0, 3.0), (4, None, 3.0)]


def test_sql_into_keeps_all_digits(session):
    session.run("data a; do k = 8999990 to 8999999; v = k + 1 / 3; output; end; v = 0.1 + 0.2; k = 1e16; output; run; proc sql noprint; select max(k), max(v), min(v) into :m, :v, :w from a where k < 1e15; select max(k), min(v) into :b, :s from a; quit;")
    session.run("data o; set a; if k = &m or k = &b; same = v in (&v, &s); run;")
    assert sorted(rows(session, "o", "k", "same")) == [(8999999.0, 1.0), (1e16, 1.0)]
    session.run("proc sql noprint; select k into :all separated by ',' from a where k > 8999997 and k < 1e15; quit;")
    assert sorted(session.macro.get("all").split(",")) == ["8999998", "8999999"]


def test_rank_without_groups(session, spark):
    session.run("data a; input x; datalines;\n10\n30\n20\n30\n.\n;\nrun; proc rank data=a out=o descending; var x; ranks r; run; proc rank data=a out=g groups=2; var x; ranks r; run;")
    assert sorted(rows(session, "o", "x", "r"), key=str) == sorted([(10.0, 4.0), (30.0, 1.5), (20.0, 3.0), (30.0, 1.5), (None, None)], key=str)
    assert sorted(r for x, r in rows(session, "g", "x", "r") if x is not None) == [0.0, 0.0, 1.0, 1.0]


def test_tabulate_classes_and_variables(session):
    session.run("""data a; input g $ h $ k $ x y; datalines;
a p u 1 5
a q u 2 6
b p v 3 7
;
run; proc tabulate data=a out=o; class g h k; var x; table g*h, k*x*(sum n); run;""")
    assert sorted((r["g"], r["h"], r["_stat_"], r["u"], r["v"]) for r in session.frame("o").collect() if r["_stat_"] == "sum") == [("a", "p", "sum", 1.0, None), ("a", "q", "sum", 2.0, None), ("b", "p", "sum", None, 3.0)]
    with pytest.raises(ValueError, match="one analysis variable"):
        session.run("proc tabulate data=a out=o; class g; var x y; table g, (x y)*(sum mean); run;")


def test_cluster_labels_and_outtree(session):
    session.run("data p; input name $ x y; datalines;\nalpha 1 1\nbravo 1.1 0.9\ncharlie 10 10\ndelta 10.1 9.9\n;\nrun; proc cluster data=p method=average outtree=t; var x y; id name; run;")
    found = rows(session, "t", "first", "second")
    assert len(found) == 3 and {"alpha", "bravo", "charlie", "delta"} <= {x for r in found for x in r}


def test_transpose_of_repeated_ids_takes_the_last(session):
    session.run("data a; input g k $ v; datalines;\n1 x 5\n1 y 6\n1 x 7\n;\nrun; proc transpose data=a out=o; by g; id k; var v; run;")
    assert rows(session, "o", "x", "y") == [(7.0, 6.0)]


def test_contents_counts_rows(session):
    session.run("data a; do x = 1 to 7; output; end; run; proc contents data=a out=o; run;")
    assert {r["nobs"] for r in session.frame("o").select(F.col("nobs")).collect()} == {7.0}


def test_option_filters_reach_the_scan_where_order_counts(spark, session):
    session.parquet("/root/testdata/sf0.001", "orders")
    session.run("data big; set orders(where=(o_totalprice > 200000) keep=o_orderkey o_custkey o_totalprice); by o_custkey notsorted; if first.o_custkey then t = 0; t + o_totalprice; run;")
    from rowloom.language.ast import Ref
    from rowloom.plans import sources

    ds = session.dataset("orders").filtered(F.col("o_totalprice") > 200000)
    plan = ds.df.select("o_orderkey", "__o0")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,200000.0)" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1]
    assert sources.with_options(session.dataset("orders"), Ref("orders", obs=3)).df.count() == 3


def test_regression_with_large_means(session):
    import numpy as np

    from rowloom.operators import stats

    session.run("data a; do i = 1 to 50; x = 1000000000 + i; y = 3 * i + mod(i * 7, 5) + 5000000000; output; end; run;")
    fit = stats.regress(session.dataset("a"), "y", ["x"])
    i = np.arange(1, 51)
    y = 3 * i + i * 7 % 5
    slope, level = np.polyfit(i, y, 1)
    assert fit.beta[1] == pytest.approx(slope, rel=1e-9) and fit.more["sse"] == pytest.approx(((y - slope * i - level) ** 2).sum(), rel=1e-6)
    assert fit.beta[0] == pytest.approx(level + 5e9 - slope * 1e9, rel=1e-9)
