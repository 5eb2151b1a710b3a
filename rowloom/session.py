"""A session: datasets, libraries, macro variables, formats and titles; it runs program text step by step."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowloom.functions.formats import UserFormat
from rowloom.functions.lower import Unsupported
from rowloom.language.ast import DataStep, Global, Proc, Ref
from rowloom.language.macro import MacroStage
from rowloom.language.parser import Parser, step_spans
from rowloom.plans import machine
from rowloom.plans.dataset import Dataset, from_frame
from rowloom.plans.datastep import ColumnStep, Context
from rowloom.report.ods import Destinations
from rowloom.sources import files
from rowloom.sources.libraries import Library, open_library


class Session:
    def __init__(self, spark: SparkSession, log: Callable[[str], None] = print):
        self.spark, self.log = spark, log
        # so that joins and windows on part of a key keep one shuffle
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.tables: dict[str, Dataset] = {}
        self.libraries: dict[str, Library] = {}
        self.formats: dict[str, UserFormat] = {}
        self.functions: dict = {}
        self.titles: dict[int, str] = {}
        self.footnotes: dict[int, str] = {}
        self.results: list[tuple[str, DataFrame]] = []
        self.values: dict[str, object] = {}
        self.notes: list[str] = []
        self.last: str | None = None
        self.macro = MacroStage(log=log)
        self.ods = Destinations()

    # datasets

    def register(self, name: str, df: DataFrame, nan: bool = True) -> Dataset:
        """A data frame as a dataset; its rows are in scan order. nan: whether its doubles may be NaN, which counts as missing."""
        return self.put(name, from_frame(df, nan=nan))

    def parquet(self, folder: str, *names: str, nan: bool = False) -> Session:
        """Parquet tables; those with NaN need nan, at the cost of filters that do not reach the scan."""
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"), nan)
        return self

    def put(self, name: str, ds: Dataset) -> Dataset:
        if name == "_null_":
            return ds
        if "." in name:
            lib, table = name.split(".", 1)
            if lib in self.libraries:
                self.libraries[lib].write(table, ds)
        self.tables[name] = ds
        self.last = name
        return ds

    def dataset(self, name: str) -> Dataset:
        if name == "__spark":
            return self.spark  # type: ignore[return-value]
        if name == "_last_" and self.last:
            name = self.last
        if name in self.tables:
            return self.tables[name]
        if "." in name:
            lib, table = name.split(".", 1)
            if lib in self.libraries:
                return from_frame(self.libraries[lib].read(table))
        raise KeyError(f"no dataset {name}")

    def frame(self, name: str) -> DataFrame:
        """A dataset's rows in no particular order."""
        return self.dataset(name).visible()

    def context(self) -> Context:
        return Context(self.dataset, self.formats, self.functions)

    # programs

    def run(self, text: str) -> Session:
        """Run program text. Open code is expanded and run unit by unit, so that what a step puts in macro variables is there for the next."""
        for unit in _units(text):
            expanded = self.macro.expand(unit)
            for begin, end in step_spans(expanded):
                for step in Parser(expanded[begin:end]).program():
                    self.step(step)
        return self

    def step(self, step: DataStep | Proc | Global) -> None:
        if isinstance(step, DataStep):
            self.data_step(step)
        elif isinstance(step, Proc):
            from rowloom import procs

            procs.run(self, step)
        else:
            self._global(step)

    def explain_step(self, text: str) -> list[str]:
        """How a data step would run."""
        step = Parser(self.macro.expand(text)).program()[0]
        try:
            plan = ColumnStep(step, self.context(), self._given(step))
            plan.run()
            return plan.notes
        except Unsupported as e:
            return [f"tier 3: {e}"]

    def _given(self, step: DataStep) -> Dataset | None:
        return files.inline_or_file(self.spark, step)

    def data_step(self, step: DataStep) -> None:
        given = self._given(step)
        lines: list[tuple[str, str]] = []
        try:
            out = ColumnStep(step, self.context(), given).run()
            self.notes.append("columns")
        except Unsupported as e:
            self.notes.append(f"state machine: {e}")
            out, lines = machine.run(step, self.context(), given)
        for name, ds in out.items():
            self.put(name, ds)
        program = self._lines(step, lines)
        if program:
            self.run(program)

    def _lines(self, step: DataStep, lines: list[tuple[str, str]]) -> str:
        """PUT lines go where FILE says, SYMPUT into macro variables; EXECUTE text is returned."""
        from rowloom.plans.datastep import walk

        modes = {str(s["path"]): bool(s["mod"]) for s in walk(step.body) if s.kind == "file"}
        texts: dict[str, list[str]] = {}
        program = []
        for kind, text in lines:
            if kind == "__symput":
                name, _, value = text.partition("=")
                self.macro.set(name, value, glob=True)
            elif kind == "__execute":
                program.append(text)
            elif kind.startswith("__put:"):
                texts.setdefault(kind[6:], []).append(text)
        for path, own in texts.items():
            if path in ("log", "print"):
                for t in own:
                    self.log(t)
            else:
                files.write_lines(path, own, modes.get(path, False))
        return "\n".join(program)

    # statements between steps

    def _global(self, g: Global) -> None:
        text = g.text
        if g.kind == "libname":
            found = re.match(r"libname\s+(\w+)\s+(?:(\w+)\s+)?(?:([\"'])(.*?)\3)?\s*(clear)?", text, re.IGNORECASE | re.DOTALL)
            name = found[1].lower()
            if found[5] or (found[2] or "").lower() == "clear":
                self.libraries.pop(name, None)
            else:
                self.libraries[name] = open_library(self.spark, found[4])
        elif re.fullmatch(r"title\d*|footnote\d*", g.kind):
            slots = self.titles if g.kind.startswith("title") else self.footnotes
            k = int(re.sub(r"\D", "", g.kind) or 1)
            found = re.search(r"([\"'])(.*)\1", text, re.DOTALL)
            for n in [n for n in slots if n >= k]:
                slots.pop(n)
            if found:
                slots[k] = found[2]
        elif g.kind == "ods":
            self.ods.statement(text)

    def show(self, title: str, df: DataFrame) -> None:
        """A printed result: kept, and sent to whatever output destinations are open."""
        self.results.append((title, df))
        self.ods.add(title, df, [self.titles[k] for k in sorted(self.titles)], [self.footnotes[k] for k in sorted(self.footnotes)])


def _units(text: str) -> list[str]:
    """Open code cut after each step; macro definitions and blocks stay whole."""
    out, start, depth = [], 0, 0
    for found in re.compile(r"%(macro|mend|do|end)\b|\b(run|quit)\s*;|/\*.*?\*/|'[^']*'|\"[^\"]*\"|(?:datalines|cards)\s*;.*?^\s*;", re.IGNORECASE | re.DOTALL | re.MULTILINE).finditer(text):
        word = (found[1] or "").lower()
        if word in ("macro", "do"):
            depth += 1
        elif word in ("mend", "end"):
            depth -= 1
        elif found[2] and depth <= 0:
            out.append(text[start : found.end()])
            start = found.end()
    return [*out, text[start:]] if text[start:].strip() else out


__all__ = ["Ref", "Session"]
