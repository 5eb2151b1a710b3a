"""Procedures, SQL, sources, reports."""

import math
import sqlite3

import pytest

from rowloom.functions import dist
from rowloom.operators import stats, summary
from rowloom.sql import statements


def rows(session, name):
    return [tuple(r) for r in session.dataset(name).ordered().collect()]


def load(session, spark, name, columns, data):
    session.register(name, spark.createDataFrame(data, columns))


def test_distributions():
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert dist.f_upper(4, 2, 9) == pytest.approx(0.057157, abs=1e-6)
    assert dist.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.norm_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_sort_and_duplicates(session):
    session.run("data a; input x y; datalines;\n1 1\n1 2\n2 3\n. 4\n;\nrun; proc sort data=a nodupkey out=b dupout=d; by x; run; proc sort data=a out=c; by descending x; run;")
    assert rows(session, "b") == [(None, 4.0), (1.0, 1.0), (2.0, 3.0)] and rows(session, "d") == [(1.0, 2.0)]
    assert [r[0] for r in rows(session, "c")] == [2.0, 1.0, 1.0, None]


def test_rank_standard_transpose(session):
    session.run("data a; input n $ s; datalines;\np 90\nq 70\nr 80\ns 70\n;\nrun; proc rank data=a descending out=r; var s; ranks k; run; proc standard data=a mean=0 std=1 out=z; var s; run; proc transpose data=a out=t; id n; var s; run;")
    assert [r[2] for r in rows(session, "r")] == [1.0, 3.5, 2.0, 3.5]
    z = [r[1] for r in rows(session, "z")]
    assert sum(z) == pytest.approx(0) and sum(v * v for v in z) == pytest.approx(3)
    assert rows(session, "t") == [("s", 90.0, 70.0, 80.0, 70.0)]


def test_means_levels_and_limits(session):
    session.run("data a; input g $ v; datalines;\na 1\na 3\nb 5\nb .\n;\nrun; proc means data=a n nmiss mean std lclm uclm; class g; var v; output out=o; run; proc means data=a n; class g; ways 0 1; output out=w; run;")
    assert rows(session, "o")[0][:5] == ("a", 2.0, 0.0, 2.0, pytest.approx(math.sqrt(2)))
    assert rows(session, "o")[0][5] == pytest.approx(2 - dist.t_ppf(0.975, 1))
    assert rows(session, "o")[1][4:] == (None, None, None) and len(rows(session, "w")) == 3


def test_frequencies(session):
    session.run("data a; input a $ b $; datalines;\nx p\nx q\ny p\ny p\n;\nrun; proc freq data=a; tables a*b / chisq agree out=o; tables a / out=w; run;")
    assert rows(session, "o") == [("x", "p", 1.0, 25.0), ("x", "q", 1.0, 25.0), ("y", "p", 2.0, 50.0), ("y", "q", 0.0, 0.0)]
    assert session.values["freq.chisq"] == pytest.approx(4 / 3) and sum(r[2] for r in rows(session, "w")) == 100


def test_compare_and_sample(session):
    session.run("data a; input id x; datalines;\n1 1\n2 2\n3 .\n;\nrun; data b; set a; if id = 2 then x = 9; run; proc compare base=a compare=b out=o; id id; run; proc surveyselect data=a n=2 seed=3 out=s; run;")
    assert [r[:4] for r in rows(session, "o")] == [(2.0, "x", "2", "9")] and len(rows(session, "s")) == 2
    with pytest.raises(ValueError):
        session.run("proc surveyselect data=a out=s; run;")


def test_univariate_and_report(session):
    session.run("data a; input g $ x; datalines;\na 1\na 2\nb 3\nb 10\n;\nrun; proc univariate data=a; var x; output out=u; run; proc report data=a out=r; column g x; define g / group; define x / analysis sum; rbreak after / summarize; run; proc tabulate data=a out=t; class g; var x; table g, x*sum; run;")
    assert rows(session, "u")[0][1:3] == (4.0, 4.0)
    assert [r[1] for r in rows(session, "r")] == [3.0, 13.0, 16.0] and [r[1] for r in rows(session, "t")] == [3.0, 13.0]


def test_regression_and_selection(session, spark):
    load(session, spark, "d", ["x", "z", "y"], [(float(i), float(i * 7 % 5), 2.0 * i + 1 + (i % 3) * 0.01) for i in range(30)])
    fit = stats.regress(session.dataset("d"), "y", ["x", "z"], selection="backward", slstay=0.01)
    assert fit.names == ["intercept", "x"] and fit.beta[1] == pytest.approx(2, abs=1e-2) and fit.more["r2"] > 0.999
    for f in (stats.robust(session.dataset("d"), "y", ["x"]), stats.quantile_regress(session.dataset("d"), "y", ["x"])):
        assert f.beta[1] == pytest.approx(2, abs=0.01)


def test_logistic_and_cox_directions(session, spark):
    load(session, spark, "d", ["x", "y", "t", "c"], [(i % 10 / 10, float((i * 37 % 100) / 100 < i % 10 / 10), float(1 + (i * 13) % 20 + 10 * (1 - i % 10 / 10)), float(i % 5 > 0)) for i in range(300)])
    fit = stats.glm(session.dataset("d"), "y", ["x"])
    assert fit.beta[1] > 0 and 0.5 < stats.concordance(session.dataset("d"), fit, "y")["c"] <= 1
    assert stats.phreg(session.dataset("d"), "t", "c", [0.0], ["x"]).beta[0] > 0


def test_tests_by_hand(session, spark):
    load(session, spark, "d", ["x"], [(float(v),) for v in range(1, 6)])
    assert stats.ttest(session.dataset("d"), "x", h0=2.0).ordered().head()["t"] == pytest.approx(1.414214, abs=1e-6)
    load(session, spark, "s", ["t", "c"], [(1.0, 0.0), (2.0, 1.0), (3.0, 0.0), (4.0, 1.0), (5.0, 1.0), (6.0, 1.0)])
    curve = {r["t"]: r["survival"] for r in stats.lifetest(session.dataset("s"), "t", "c", [0.0])["curve"].ordered().collect()}
    assert [round(curve[t], 4) for t in (2.0, 4.0, 5.0, 6.0)] == [0.8, 0.5333, 0.2667, 0.0]


def test_multivariate(session, spark):
    load(session, spark, "p", ["x", "y", "z", "g"], [(float(i), float(2 * i + i % 3), float(i * 5 % 7), "a" if i < 10 else "b") for i in range(20)])
    p = stats.princomp(session.dataset("p"), ["x", "y", "z"])
    assert sum(r["eigenvalue"] for r in p["eigenvalues"].ordered().collect()) == pytest.approx(3)
    assert len(stats.cluster(session.dataset("p"), ["x", "y"], "ward").ordered().collect()) == 19
    d = stats.discrim(session.dataset("p"), "g", ["x"])["out"].df
    assert d.where("_into_ = g").count() == 20
    k = stats.fastclus(session.dataset("p"), ["x", "y"], 2)["out"].df
    assert {r["cluster"] for r in k.select("cluster").distinct().collect()} == {1.0, 2.0}
    assert stats.cancorr(session.dataset("p"), ["x", "z"], ["y"])["correlations"].ordered().head()["correlation"] > 0.99
    assert stats.pls(session.dataset("p"), "y", ["x", "z"])["variation"].ordered().collect()[-1]["cumulative"] > 0.99


def test_series(session, spark):
    load(session, spark, "s", ["y"], [(10 + 0.5 * i + [0, 3, -3, 0][i % 4],) for i in range(40)])
    out = stats.timeseries(session.dataset("s"), "y", 4).ordered().collect()
    assert [round(r["seasonal"], 6) for r in out[:4]] == [0, 3, -3, 0] and out[0]["trend"] is None
    f = stats.arima(session.dataset("s"), "y", d=1, lead=3)
    assert f["forecast"].columns == ["period", "forecast", "l95", "u95"] and len(f["forecast"].ordered().collect()) == 3


def test_mixed_finds_the_slope(session, spark):
    load(session, spark, "m", ["s", "x", "y"], [(f"s{i % 25}", float(i % 7), 2.0 * (i % 7) + (i % 25) * 0.3 + (i * 11 % 5) * 0.1) for i in range(250)])
    fit = stats.mixed(session.dataset("m"), "y", ["x"], "s")
    assert fit.beta[1] == pytest.approx(2, abs=0.05) and fit.more["intercept"] > fit.more["residual"]


def test_sql_statements_and_shims(session):
    assert statements("a; select ';' from b; -- x;\n c") == ["a", "select ';' from b", "-- x;\n c"]
    session.run("data a; input g $ x; datalines;\na 1\na 2\nb 5\n;\nrun; proc sql; create table s as with t as (select g, sum(x) as x from a group by g) select * from t; insert into s values ('c', 7); update s set x = x + 1 where g = 'c'; delete from s where g = 'a'; create table e as select * exclude (x) from a; create table q as select g, x from a qualify row_number() over (partition by g order by x desc) = 1; select count(*) into :n from a; quit; data o; n = &n; run;")
    assert sorted(rows(session, "s")) == [("b", 5.0), ("c", 8.0)] and session.dataset("e").columns == ["g"]
    assert sorted(rows(session, "q")) == [("a", 2.0), ("b", 5.0)] and rows(session, "o") == [(3.0,)]


def test_libraries(session, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as con:
        con.execute("create table students (id integer, name text, score real)")
        con.executemany("insert into students values (?, ?, ?)", [(1, "A", 90.5), (2, "B", None)])
    session.run(f"libname db '{tmp_path}/x.db'; data o; set db.students; run; data db.more; x = 1; run; libname dir '{tmp_path}'; data dir.t; y = 2; run; data p; set dir.t; run; proc sql; create table j as select count(*) as n from db.students; quit; proc datasets lib=db; delete more; run;")
    assert rows(session, "o") == [(1.0, "A", 90.5), (2.0, "B", None)] and rows(session, "p") == [(2.0,)] and rows(session, "j") == [(2.0,)]
    assert session.libraries["db"].names() == ["students"]


def test_text_input(session, tmp_path):
    (tmp_path / "f.csv").write_text('name,age\n"Smith, J",30\nLee,\n')
    (tmp_path / "g.txt").write_text("Alice\n 30\nBobby\n 45\n")
    session.run(f"data a; infile '{tmp_path}/f.csv' dsd firstobs=2; input name $ age; run; data b; infile '{tmp_path}/g.txt'; input name $ 1-5 / age 1-3; run; proc import datafile='{tmp_path}/f.csv' out=c dbms=csv; run; proc export data=b outfile='{tmp_path}/h.csv' dbms=csv; run;")
    assert rows(session, "a") == [("Smith, J", 30.0), ("Lee", None)] and rows(session, "b") == [("Alice", 30.0), ("Bobby", 45.0)]
    assert session.dataset("c").columns == ["name", "age"] and (tmp_path / "h.csv").read_text().startswith("name,age")


def test_documents_and_plots(session, tmp_path):
    session.run(f"data a; input g $ x; datalines;\na 1\nb 2\n;\nrun; title 'T'; ods html file='{tmp_path}/o.html'; ods pdf file='{tmp_path}/o.pdf'; ods rtf file='{tmp_path}/o.rtf'; proc print data=a; run; ods _all_ close; proc sgplot data=a out='{tmp_path}/p.png'; vbar g / response=x; run;")
    assert "<table" in (tmp_path / "o.html").read_text() and (tmp_path / "o.pdf").read_bytes().startswith(b"%PDF")
    assert (tmp_path / "o.rtf").read_text().startswith("{\\rtf") and (tmp_path / "p.png").read_bytes().startswith(b"\x89PNG")


def test_unknown_procedure(session):
    with pytest.raises(NotImplementedError):
        session.run("proc nothing; run;")


def test_stream_step(spark, tmp_path):
    from rowloom.streaming import stream_step

    spark.range(5).selectExpr("cast(id as double) x").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("x double").parquet(f"{tmp_path}/in")
    made = stream_step(source, "data o; set stream; y = x * 2; if y > 4; run;")
    query = made.writeStream.format("memory").queryName("made").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["y"] for r in spark.table("made").collect()) == [6.0, 8.0]


def test_normality_and_summary_names(session, spark):
    load(session, spark, "n", ["x"], [(float(v),) for v in range(50)])
    assert 0 < summary.normality(session.dataset("n"), "x")["d"] < 0.2
