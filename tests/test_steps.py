"""Data steps as small programs."""

import pytest


def rows(session, name):
    return [tuple(r) for r in session.dataset(name).ordered().collect()]


XS = "data a; input g $ x; datalines;\na 1\na 2\nb 5\n;\nrun;\n"
LEFT = "data l; input id x; datalines;\n1 10\n2 20\n2 21\n;\nrun;\n"
RIGHT = "data r; input id y; datalines;\n1 5\n2 6\n2 7\n2 8\n3 9\n;\nrun;\n"

CASES = {
    "if else": ("data o; set a; length k $ 5; if x >= 2 then k = 'big'; else k = 'small'; keep k; run;", [("small",), ("big",), ("big",)]),
    "missing is least": ("data o; set a; if x = 1 then x = .; lt = x < 0; eq = x = .; s = sum(x, 1); p = x + 1; keep lt eq s p; run;", [(1.0, 1.0, 1.0, None), (0.0, 0.0, 3.0, 3.0), (0.0, 0.0, 6.0, 6.0)]),
    "division by zero": ("data o; x = 5 / 0; y = . + 1; run;", [(None, None)]),
    "first and last": ("data o; set a; by g; f = first.g; l = last.g; keep f l; run;", [(1.0, 0.0), (0.0, 1.0), (1.0, 1.0)]),
    "sum statement": ("data o; set a; t + x; keep t; run;", [(1.0,), (3.0,), (8.0,)]),
    "sum with reset": ("data o; set a; by g; if first.g then t = 0; t + x; if last.g; keep g t; run;", [("a", 3.0), ("b", 5.0)]),
    "retain with assignment": ("data o; set a; by g; retain t; if first.g then t = 0; t = t + x; if last.g then output; keep g t; run;", [("a", 3.0), ("b", 5.0)]),
    "running maximum": ("data o; set a; retain m; m = max(m, x); keep m; run;", [(1.0,), (2.0,), (5.0,)]),
    "carried forward": ("data o; set a; retain v; if x ne 2 then v = x; keep v; run;", [(1.0,), (1.0,), (5.0,)]),
    "lag and dif": ("data o; set a; p = lag(x); d = dif(x); q = lag2(x); keep p d q; run;", [(None, None, None), (1.0, 1.0, None), (2.0, 3.0, 1.0)]),
    "row number": ("data o; set a; n = _n_; keep n; run;", [(1.0,), (2.0,), (3.0,)]),
    "end flag": ("data o; set a end=e nobs=n; keep x k m; k = e; m = n; run;", [(1.0, 0.0, 3.0), (2.0, 0.0, 3.0), (5.0, 1.0, 3.0)]),
    "array and loop": ("data o; set a; array h[3] h1-h3; do i = 1 to 3; h[i] = x * i; end; s = sum(of h1-h3); keep s i; run;", [(4.0, 6.0), (4.0, 12.0), (4.0, 30.0)]),
    "array of two dimensions": ("data o; array m[2,2] a b c d (1 2 3 4); k = 2; v = m[k,1]; n = dim(m, 1); keep v n; run;", [(3.0, 2.0)]),
    "do over": ("data o; set a; array h h1-h2; h1 = x; h2 = 2; do over h; h = h + 1; end; keep h1 h2; run;", [(2.0, 3.0), (3.0, 3.0), (6.0, 3.0)]),
    "select": ("data o; set a; select (g); when ('a') k = 1; otherwise k = 2; end; keep k; run;", [(1.0,), (1.0,), (2.0,)]),
    "one row for each turn": ("data o; set a; do k = 1 to x; output; end; keep g k; run;", [("a", 1.0), ("a", 1.0), ("a", 2.0), *[("b", float(k)) for k in range(1, 6)]]),
    "while loop": ("data o; x = 1; n = 0; do while (x < 100); x = x * 2; n + 1; end; run;", [(128.0, 7.0)]),
    "until loop": ("data o; x = 1; do until (x > 0); x = x + 1; end; run;", [(2.0,)]),
    "leave": ("data o; set a; do i = 1 to 10; if i > x then leave; end; keep i; run;", [(2.0,), (3.0,), (6.0,)]),
    "stop": ("data o; set a; if x = 2 then stop; run;", [("a", 1.0)]),
    "delete and return": ("data o; set a; if x = 1 then delete; if x = 2 then return; x = 9; run;", [("a", 2.0), ("b", 9.0)]),
    "conditional lag": ("data o; set a; if x ne 2 then p = lag(x); keep p; run;", [(None,), (None,), (1.0,)]),
    "options": ("data o(rename=(x=z) where=(x > 1)); set a(where=(x < 5) keep=g x); run;", [("a", 2.0)]),
    "firstobs and obs": ("data o; set a(firstobs=2 obs=2); run;", [("a", 2.0)]),
    "where": ("data o; set a; where x > 1; by g; f = first.g; keep f; run;", [(1.0,), (1.0,)]),
    "call missing": ("data o; set a; call missing(g, x); run;", [("", None)] * 3),
    "character functions": ("data o; s = 'Hello World'; a = scan(s, 2); b = substr(s, 1, 4); c = upcase(s); d = index(s, 'World'); e = compress(s, 'lo'); f = tranwrd(s, 'World', 'x'); g = propcase(\"o'neil mary-ann\"); keep a b c d e f g; run;", [("World", "Hell", "HELLO WORLD", 7.0, "He Wrd", "Hello x", "O'Neil Mary-Ann")]),
    "dates": ("data o; d = '01JAN2010'd; y = year(d); w = put(d, date9.); n = intnx('month', d, 1); c = intck('year', d, '31DEC2012'd); k = weekday(d); keep d y w n c k; run;", [(18263.0, 2010.0, "01JAN2010", 18294.0, 2.0, 6.0)]),
    "formats": ("data o; a = put(1234.5, comma10.2); b = put(.25, percent8.1); c = put(7, z3.); d = put(., best.); e = put(3661, time8.); run;", [("1,234.50", "25.0%", "007", ".", "1:01:01")]),
    "implicit conversion": ("data o; c = '12'; x = c + 1; s = 'n=' || 5; keep x s; run;", [(13.0, "n=5")]),
}


@pytest.mark.parametrize("name", CASES)
def test_step(session, name):
    program, want = CASES[name]
    session.run(XS + program)
    assert rows(session, "o") == want


def test_match_merge_holds_last_row(session):
    session.run(LEFT + RIGHT + "data o; merge l(in=a) r(in=b); by id; ia = a; ib = b; run;")
    assert rows(session, "o") == [(1.0, 10.0, 5.0, 1.0, 1.0), (2.0, 20.0, 6.0, 1.0, 1.0), (2.0, 21.0, 7.0, 1.0, 1.0), (2.0, 21.0, 8.0, 1.0, 1.0), (3.0, None, 9.0, 0.0, 1.0)]


def test_merge_by_missing_keys(session):
    session.run("data l; input id x; datalines;\n. 1\n2 2\n;\nrun; data r; input id y; datalines;\n. 3\n;\nrun; data o; merge l r; by id; run;")
    assert rows(session, "o") == [(None, 1.0, 3.0), (2.0, 2.0, None)]


def test_positional_merge_and_update(session):
    session.run(LEFT + RIGHT + "data p; merge l r; run; data u; update l r(rename=(y=x)); by id; run;")
    assert len(rows(session, "p")) == 5
    assert rows(session, "u") == [(1.0, 5.0), (2.0, 8.0), (3.0, 9.0)]


def test_interleave_is_ascending_with_missing_first(session):
    session.run("data l; input id; datalines;\n3\n.\n;\nrun; data r; input id; datalines;\n2\n;\nrun; data o; set l r; by id; run;")
    assert rows(session, "o") == [(None,), (2.0,), (3.0,)]


def test_hash_lookup_keeps_values_on_a_miss(session):
    session.run(LEFT + RIGHT + "data o; set r; x = 0; if _n_ = 1 then do; declare hash h(dataset: 'l'); h.definekey('id'); h.definedata('x'); h.definedone(); end; rc = h.find(); run;")
    assert rows(session, "o") == [(1.0, 5.0, 10.0, 0.0), (2.0, 6.0, 20.0, 0.0), (2.0, 7.0, 20.0, 0.0), (2.0, 8.0, 20.0, 0.0), (3.0, 9.0, 0.0, 1.0)]


def test_hash_filled_by_rows_and_written_out(session):
    session.run(RIGHT + "data o; set r end=e; if _n_ = 1 then do; declare hash h(); h.definekey('id'); h.definedata('id', 'y'); h.definedone(); end; if h.check() ne 0 then h.add(); if e then h.output(dataset: 'd'); run;")
    assert rows(session, "d") == [(1.0, 5.0), (2.0, 6.0), (3.0, 9.0)]


def test_point_access(session):
    session.run(RIGHT + "data o; do p = 3, 1; set r point=p nobs=n; k = n; output; end; stop; run;")
    assert rows(session, "o") == [(2.0, 7.0, 5.0), (1.0, 5.0, 5.0)]


def test_keyed_set_keeps_the_last_hit(session):
    session.run("data c; input id city $; datalines;\n1 NYC\n;\nrun; data q; input id; datalines;\n1\n9\n;\nrun; data o; set q; set c key=id; io = _iorc_; keep id city io; run;")
    assert rows(session, "o") == [(1.0, "NYC", 0.0), (9.0, "NYC", 1.0)]


def test_totals_beside_all_rows(session):
    session.run(XS + "data t; total = 8; run; data o; set a; if _n_ = 1 then set t; share = x / total; keep share; run;")
    assert rows(session, "o") == [(0.125,), (0.25,), (0.625,)]


def test_no_rows_keep_columns(session):
    session.run(XS + "data o; set a; y = x * 2; if x > 100; run;")
    assert session.dataset("o").columns == ["g", "x", "y"] and rows(session, "o") == []


def test_plans_keep_their_tier(session):
    session.run(XS)
    assert session.explain_step("data o; set a; y = x + 1; run;") == ["tier 1: columns"]
    assert any("tier 2" in n for n in session.explain_step("data o; set a; t + x; run;"))
    assert session.explain_step("data o; set a; do while (x < 9); x = x + 1; end; run;")[0].startswith("tier 3")


@pytest.mark.parametrize("program", ["data o; set a; by g; if first.g then t = 0; t + x; run;", "data o; set a; y = lag(x); run;", "data o; set a; retain m; m = max(m, x); run;"])
def test_tiers_agree(session, program):
    from rowloom.language.parser import Parser
    from rowloom.plans import machine

    session.run(XS + program)
    made, _ = machine.run(Parser(program).program()[0], session.context())
    want, columns = rows(session, "o"), session.dataset("o").columns
    assert [tuple(r[c] for c in columns) for r in made["o"].ordered().collect()] == want


def test_steps_push_filters_to_the_scan(session, spark, tmp_path):
    spark.range(100).selectExpr("cast(id as double) x", "cast(id * 2 as double) y", "'s' z").write.parquet(f"{tmp_path}/t.parquet")
    session.parquet(str(tmp_path), "t")
    session.run("data o; set t(keep=x where=(x > 90)); run;")
    plan = session.frame("o")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<x:double>" in plan and "GreaterThan(x,90.0)" in plan


def test_put_file_symput_execute(session, tmp_path):
    session.run(XS + f"data _null_; set a; file '{tmp_path}/o.txt'; put g $ x; call symputx(cats('v', _n_), x); if x = 5 then call execute('data z; q = 1; run;'); run; data y; v = \"&v3\"; run;")
    assert (tmp_path / "o.txt").read_text() == "a 1\na 2\nb 5\n"
    assert rows(session, "z") == [(1.0,)] and rows(session, "y") == [("5",)]


def test_functions_and_subroutines(session):
    session.run("proc fcmp; function grade(s) $; if s >= 90 then return('A'); if s >= 80 then return('B'); return('C'); endsub; function total(v[*]); t = 0; do i = 1 to dim(v); t = t + v[i]; end; return(t); endsub; subroutine swap(a, b); outargs a, b; c = a; a = b; b = c; endsub; run;"
        "data o; array q[2] q1-q2 (3 4); s = 85; g = grade(s); call swap(q1, q2); keep g q1 q2; run;")
    assert rows(session, "o") == [(4.0, 3.0, "B")] or rows(session, "o") == [("B", 4.0, 3.0)]
