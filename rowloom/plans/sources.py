"""Row sources of a data step: SET, MERGE and UPDATE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from rowloom.functions.lower import Lowering
from rowloom.functions.values import choose
from rowloom.language.ast import Ref
from rowloom.plans.dataset import Dataset, first_last, numbered, sort_key


def resolve(names: list[str], columns: list[str]) -> list[str]:
    """Names, prefixes and ranges of columns; unknown names are left out."""
    out: list[str] = []
    for n in names:
        if n.endswith(":"):
            out += [c for c in columns if c.startswith(n[:-1])]
        elif "--" in n:
            a, b = n.split("--")
            if a in columns and b in columns:
                out += columns[columns.index(a) : columns.index(b) + 1]
        elif n in columns:
            out.append(n)
        elif n == "_all_":
            out += columns
    return list(dict.fromkeys(out))


def limited(ds: Dataset, firstobs: int | None, obs: int | None) -> Dataset:
    """Rows firstobs to obs, both counted from 1 over the whole dataset."""
    if firstobs in (None, 1) and obs is None:
        return ds
    rows = ds.df.orderBy(*ds.sort_columns()) if ds.order else ds.df
    if obs is not None:
        rows = rows.limit(obs)
    if firstobs not in (None, 1):
        rows = rows.offset(firstobs - 1)
    return ds.with_df(rows)


def with_options(ds: Dataset, ref: Ref, formats: dict | None = None) -> Dataset:
    """Input options: where, rows, keep, drop, rename."""
    if ref.where is not None:
        ds = ds.filtered(Lowering(ds.val, formats).filter(ref.where))
    ds = limited(ds, ref.firstobs, ref.obs)
    columns = ds.columns
    if ref.keep is not None:
        columns = [c for c in columns if c in resolve(ref.keep, columns)]
    if ref.drop is not None:
        columns = [c for c in columns if c not in resolve(ref.drop, columns)]
    hidden = [c for c in ds.df.columns if c.startswith("__")]
    df = ds.df.select(*(F.col(f"`{c}`").alias(ref.rename.get(c, c)) for c in columns), *hidden)
    move = lambda d: {ref.rename.get(k, k): v for k, v in d.items()}
    return Dataset(df, ds.order, move(ds.formats), move(ds.labels))


def output_options(ds: Dataset, ref: Ref) -> Dataset:
    return with_options(ds, Ref(ref.name, ref.keep, ref.drop, ref.rename, ref.where, ref.firstobs, ref.obs))


def _meta(parts: list[Dataset]) -> tuple[dict, dict]:
    formats, labels = {}, {}
    for p in parts:
        formats |= {k: v for k, v in p.formats.items() if k not in formats}
        labels |= {k: v for k, v in p.labels.items() if k not in labels}
    return formats, labels


def _aligned(parts: list[Dataset]) -> tuple[list[str], dict[str, str]]:
    columns: dict[str, str] = {}
    for p in parts:
        for c in p.columns:
            columns.setdefault(c, p.kind(c))
    return list(columns), columns


def concatenate(parts: list[Dataset], by: list[str] | None = None, descending: list[bool] | None = None, flags: list[str | None] | None = None) -> Dataset:
    """One after the other, or interleaved by `by`; character values that a part lacks are blank."""
    columns, kinds = _aligned(parts)
    wide = max(len(p.order) for p in parts)
    # orders of unlike kinds are put as row numbers
    alike = len({tuple((p.df.schema[c].dataType.simpleString(), up) for c, up in p.order) for p in parts}) == 1
    rows = parts if alike else [numbered(p) for p in parts]
    wide = len(rows[0].order) if alike else 1
    frames = []
    for i, p in enumerate(rows):
        picked = [F.col(f"`{c}`").alias(c) if c in p.columns else F.lit("" if kinds[c] == "char" else None).cast("string" if kinds[c] == "char" else "double").alias(c) for c in columns]
        own = [F.col(c).alias(f"__k{j}") for j, (c, _) in enumerate(p.order)]
        marks = [F.lit(1.0 if i == j else 0.0).alias(f) for j, f in enumerate(flags or []) if f]
        frames.append(p.df.select(*picked, *marks, F.lit(float(i)).alias("__src"), *own))
    df = reduce(lambda a, b: a.unionByName(b), frames)
    order = [("__src", True)] + [(f"__k{j}", up) for j, (_, up) in zip(range(wide), rows[0].order, strict=False)]
    renamed = {c: f"__o{i}" for i, (c, _) in enumerate(order)}
    ds = Dataset(df.withColumnsRenamed(renamed), [(renamed[c], up) for c, up in order], *_meta(parts))
    return ds.sorted_by(by, descending or [False] * len(by)) if by else ds


def _keys(ds: Dataset, by: list[str]) -> list[Column]:
    return [sort_key(ds, k) for k in by]


def merge_by(parts: list[Dataset], by: list[str], descending: list[bool] | None = None, flags: list[str | None] | None = None) -> Dataset:
    """Match-merge: within a key rows are paired by ordinal, and the last row of the shorter side is held. Later parts overwrite.

    Parts are joined on the key and the ordinal; a window over the key then carries each side's last row on. Keys match if
    missing, too.
    """
    columns, kinds = _aligned(parts)
    flags = flags or [None] * len(parts)
    joined = None
    for i, p in enumerate(parts):
        keys = _keys(p, by)
        ordinal = F.row_number().over(Window.partitionBy(*keys).orderBy(*(p.sort_columns() or [F.lit(0)])))
        side = p.df.select(*(k.alias(f"__b{j}") for j, k in enumerate(keys)), ordinal.alias("__rn"), F.struct(F.lit(True).alias("__here"), *(F.col(f"`{c}`").alias(c) for c in p.columns)).alias(f"__s{i}"))
        if joined is None:
            joined = side
            continue
        other = side.withColumnsRenamed({f"__b{j}": f"__c{j}" for j in range(len(by))} | {"__rn": "__rm"})
        match = F.col("__rn") == F.col("__rm")
        for j in range(len(by)):
            match = match & F.col(f"__b{j}").eqNullSafe(F.col(f"__c{j}"))
        joined = joined.join(other, match, "full_outer")
        pick = lambda a, b: F.when(F.col("__rn").isNotNull(), F.col(a)).otherwise(F.col(b))
        keep = [pick(f"__b{j}", f"__c{j}").alias(f"__b{j}") for j in range(len(by))]
        joined = joined.select(*keep, F.coalesce("__rn", "__rm").alias("__rn"), *(f"__s{k}" for k in range(i + 1)))
    group = [f"__b{j}" for j in range(len(by))]
    upto = Window.partitionBy(*group).orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)
    held = joined.select(*group, "__rn", *(F.last(f"__s{i}", ignorenulls=True).over(upto).alias(f"__s{i}") for i in range(len(parts))))
    out: list[Column] = []
    for c in columns:
        if c in by:
            j = by.index(c)
            sides = [i for i, p in enumerate(parts) if c in p.columns]
            out.append(F.coalesce(*(F.col(f"__s{i}").getField(c) for i in sides)).alias(c))
            continue
        value = None
        for i, p in enumerate(parts):
            if c in p.columns:
                mine = F.col(f"__s{i}").getField(c)
                value = mine if value is None else F.when(F.col(f"__s{i}").isNotNull(), mine).otherwise(value)
        out.append((F.coalesce(value, F.lit("")) if kinds[c] == "char" else value).alias(c))
    marks = [F.when(F.col(f"__s{i}").isNotNull(), 1.0).otherwise(0.0).alias(f) for i, f in enumerate(flags) if f]
    df = held.select(*out, *marks, *(F.col(g).alias(f"__o{j}") for j, g in enumerate(group)), F.col("__rn").alias(f"__o{len(group)}"))
    down = descending or [False] * len(by)
    return Dataset(df, [(f"__o{j}", not d) for j, d in enumerate(down)] + [(f"__o{len(group)}", True)], *_meta(parts))


def merge_rows(parts: list[Dataset], flags: list[str | None] | None = None) -> Dataset:
    """Row by row: the first with the first, and so on; as many rows as the longest part."""
    columns, kinds = _aligned(parts)
    flags = flags or [None] * len(parts)
    joined = None
    for i, p in enumerate(parts):
        side = numbered(p).df.select(F.col("__n"), F.struct(*(F.col(f"`{c}`").alias(c) for c in p.columns)).alias(f"__s{i}"))
        joined = side if joined is None else joined.join(side, "__n", "full_outer")
    out = []
    for c in columns:
        value = None
        for i, p in enumerate(parts):
            if c in p.columns:
                mine = F.col(f"__s{i}").getField(c)
                value = mine if value is None else F.when(F.col(f"__s{i}").isNotNull(), mine).otherwise(value)
        out.append((F.coalesce(value, F.lit("")) if kinds[c] == "char" else value).alias(c))
    marks = [F.when(F.col(f"__s{i}").isNotNull(), 1.0).otherwise(0.0).alias(f) for i, f in enumerate(flags) if f]
    return Dataset(joined.select(*out, *marks, F.col("__n").alias("__o0")), [("__o0", True)], *_meta(parts))


def update_by(master: Dataset, changes: Dataset, by: list[str], flags: list[str | None] | None = None) -> Dataset:
    """One row a key: the master's last row, over it the last non-missing value of each variable among the changes; new keys are added."""
    flags = flags or [None, None]
    columns, kinds = _aligned([master, changes])
    names = [f"__b{j}" for j in range(len(by))]

    def side(ds: Dataset, mark: str, blank: bool):
        position = F.struct(*(F.col(c) for c, _ in ds.order)) if ds.order else F.lit(0)
        if not all(up for _, up in ds.order):
            ds = numbered(ds)
            position = F.col("__n")
        aggs = []
        for c in ds.columns:
            col = F.col(f"`{c}`")
            if blank:
                here = F.when(F.trim(col) != "", col) if ds.kind(c) == "char" else col
                aggs.append(F.max(F.when(here.isNotNull(), F.struct(position.alias("p"), here.alias("v")))).getField("v").alias(f"{mark}{c}"))
            else:
                aggs.append(F.max(F.struct(position.alias("p"), col.alias("v"))).getField("v").alias(f"{mark}{c}"))
        keyed = ds.df.withColumns(dict(zip(names, _keys(ds, by), strict=True)))
        return keyed.groupBy(*names).agg(*aggs, F.lit(1.0).alias(f"{mark}here"))

    a, b = side(master, "__m_", False), side(changes, "__t_", True).withColumnsRenamed({n: f"{n}t" for n in names})
    match = F.lit(True)
    for n in names:
        match = match & F.col(n).eqNullSafe(F.col(f"{n}t"))
    both = a.join(b, match, "full_outer")
    out = []
    for c in columns:
        have = [F.col(f"{m}{c}") for m, ds in (("__t_", changes), ("__m_", master)) if c in ds.columns]
        if c in by:
            have = have[::-1]
        out.append(F.coalesce(*have, *([F.lit("")] if kinds[c] == "char" else [])).alias(c))
    marks = [F.coalesce(F.col(f"{m}here"), F.lit(0.0)).alias(f) for m, f in zip(("__m_", "__t_"), flags, strict=True) if f]
    keys = [F.when(F.col("__m_here").isNotNull(), F.col(n)).otherwise(F.col(f"{n}t")).alias(f"__o{j}") for j, n in enumerate(names)]
    return Dataset(both.select(*out, *marks, *keys), [(f"__o{j}", True) for j in range(len(by))], *_meta([master, changes]))


__all__ = ["choose", "concatenate", "first_last", "limited", "merge_by", "merge_rows", "output_options", "resolve", "update_by", "with_options"]
