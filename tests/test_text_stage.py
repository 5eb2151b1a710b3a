"""Macro stage and parser."""

import pytest

from rowloom.language.macro import MacroError, MacroStage
from rowloom.language.parser import Parser
from rowloom.language.tokens import ParseError


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("%let a=1; &a", "1"),
        ("%let a=b; %let b=c; &&&a", "c"),
        ("%let x=5; %if &x > 3 %then yes; %else no;", "yes"),
        ("%macro m(a, b=2); &a-&b %mend; %m(1) %m(3, b=4)", "1-2 3-4"),
        ("%macro m; %do i=1 %to 3; x&i %end; %mend; %m", "x1 x2 x3"),
        ("%macro m; %let i=0; %do %while(&i < 2); a&i %let i=%eval(&i+1); %end; %mend; %m", "a0 a1"),
        ("%macro m; %let i=0; %do %until(&i >= 2); a&i %let i=%eval(&i+1); %end; %mend; %m", "a0 a1"),
        ("%eval(7/2) %sysevalf(7/2) %sysevalf(7/2, ceil)", "3 3.5 4"),
        ("%upcase(ab) %substr(hello, 2, 3) %scan(a b c, 2) %length(abc) %index(abc, c)", "AB ell b 3 3"),
        ("%sysfunc(mdy(1,1,2010)) %sysfunc(putn(18263, date9.)) %sysfunc(intnx(month, 18263, 1))", "18263 01JAN2010 18294"),
        ("'&a' /* gone */ x", "'&a' x"),
        ('%let a=1; "&a"', '"1"'),
        ("%str(a;b)", "a;b"),
    ],
)
def test_expand(text, want):
    assert " ".join(MacroStage(log=lambda s: None).expand(text).split()) == want


def test_scopes_and_put():
    said = []
    m = MacroStage(log=said.append)
    m.expand("%let a=out; %macro f; %local a; %let a=in; %put &a; %mend; %f %put &a;")
    assert said == ["in", "out"]


def test_include_and_errors(tmp_path):
    (tmp_path / "i.txt").write_text("%let z=7;")
    assert MacroStage().expand(f"%include '{tmp_path}/i.txt'; &z").strip() == "7"
    with pytest.raises(MacroError):
        MacroStage().expand("%macro a; x")
    with pytest.raises(MacroError):
        MacroStage().expand("%eval(1/0)")


def test_parse_errors_say_where():
    with pytest.raises(ParseError, match="line 2"):
        Parser("data a;\n x = ) ; run;").program()


def test_steps_end_where_the_next_begins():
    assert [type(s).__name__ for s in Parser("data a; x=1; proc print; data b; y=2; run; title 'T'; proc sql; create table c as select 1 as k; quit;").program()] == ["DataStep", "Proc", "DataStep", "Global", "Proc"]
