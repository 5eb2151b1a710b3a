"""Output destinations: results as HTML, RTF or PDF, each with the standard library alone."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Rows of a result that a document shows.
SHOWN = 1000


@dataclass
class Part:
    title: str
    columns: list[str]
    rows: list[list[str]]
    titles: list[str]
    footnotes: list[str]


def part_of(title: str, df: DataFrame, titles: list[str], footnotes: list[str]) -> Part:
    rows = [["" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r] for r in df.limit(SHOWN).collect()]
    return Part(title, list(df.columns), rows, titles, footnotes)


def as_html(parts: list[Part]) -> str:
    out = ["<!DOCTYPE html><html><head><meta charset='utf-8'></head><body>"]
    for p in parts:
        out += [f"<h1>{html.escape(t)}</h1>" for t in p.titles]
        out.append(f"<h2>{html.escape(p.title)}</h2><table border='1'><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in p.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{html.escape(v)}</td>" for v in r) + "</tr>" for r in p.rows]
        out.append("</table>" + "".join(f"<p>{html.escape(f)}</p>" for f in p.footnotes))
    return "\n".join([*out, "</body></html>"])


def as_rtf(parts: list[Part]) -> str:
    plain = lambda s: "".join(c if ord(c) < 128 and c not in "\\{}" else f"\\{c}" if c in "\\{}" else f"\\u{ord(c)}?" for c in s)
    out = ["{\\rtf1\\ansi\\deff0"]
    for p in parts:
        out += [f"{{\\b {plain(t)}\\b0}}\\par" for t in [*p.titles, p.title]]
        width = max(800, 9000 // max(1, len(p.columns)))
        for r in [p.columns, *p.rows]:
            out.append("\\trowd" + "".join(f"\\cellx{width * (i + 1)}" for i in range(len(r))) + " " + "".join(f"{plain(v)}\\cell " for v in r) + "\\row")
        out += [f"\\par {plain(f)}" for f in p.footnotes]
    return "\n".join([*out, "}"])


def as_pdf(parts: list[Part]) -> bytes:
    lines: list[str] = []
    for p in parts:
        widths = [max([len(c), *(len(r[i]) for r in p.rows)]) for i, c in enumerate(p.columns)]
        lines += [*p.titles, p.title, "  ".join(c.ljust(w) for c, w in zip(p.columns, widths, strict=True))]
        lines += ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) for r in p.rows]
        lines += [*p.footnotes, ""]
    pages = [lines[k : k + 60] for k in range(0, len(lines), 60)] or [[]]
    objects: list[bytes] = []
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects.append(b"<< /Type /Catalog /Pages 2 0 R >>")
    objects.append(f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode())
    objects.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>")
    for i, page in enumerate(pages):
        show = "\n".join("(" + re.sub(r"([\\()])", r"\\\1", x) + ") Tj T*" for x in page)
        stream = zlib.compress(f"BT /F1 8 Tf 36 800 Td 12 TL\n{show}\nET".encode("cp1252", "replace"))
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
        objects.append(f"<< /Length {len(stream)} /Filter /FlateDecode >>\nstream\n".encode() + stream + b"\nendstream")
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects):
        places.append(len(out))
        out += f"{k + 1} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


@dataclass
class Destinations:
    open: dict[str, tuple[str, list[Part]]] = field(default_factory=dict)

    def statement(self, text: str) -> None:
        """ods html|rtf|pdf file="..."; and ods html|rtf|pdf|_all_ close;"""
        words = text.split()
        kind = words[1].lower() if len(words) > 1 else ""
        found = re.search(r"(?:file|body)\s*=\s*([\"'])(.*?)\1", text, re.IGNORECASE)
        if found and kind in ("html", "rtf", "pdf"):
            self.close(kind)
            self.open[kind] = (found[2], [])
        elif re.search(r"\bclose\b", text, re.IGNORECASE):
            for k in list(self.open) if kind == "_all_" else [kind]:
                self.close(k)

    def add(self, title: str, df: DataFrame, titles: list[str], footnotes: list[str]) -> None:
        if self.open:
            part = part_of(title, df, titles, footnotes)
            for _, parts in self.open.values():
                parts.append(part)

    def close(self, kind: str) -> None:
        if kind not in self.open:
            return
        path, parts = self.open.pop(kind)
        data = as_pdf(parts) if kind == "pdf" else (as_html if kind == "html" else as_rtf)(parts).encode()
        with open(path, "wb") as f:
            f.write(data)
