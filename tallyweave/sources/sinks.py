"""Outputs: data-lake CSV and Parquet by Spark, single named files by the driver."""

from __future__ import annotations

import csv
import zipfile
from collections.abc import Iterable, Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

STAMP = (2026, 1, 1, 0, 0, 0)
SAMPLED = 200


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Partitioned output by the executors; the way for tables of any size."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def text_of(v: Any) -> str:
    """Printed form of a cell: None empty, booleans yes and no, lists and maps joined by semicolons."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "yes" if v else "no"
    if isinstance(v, Mapping):
        return "; ".join(f"{k}={text_of(x)}" for k, x in v.items() if x is not None)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return "; ".join(text_of(x) for x in v)
    if hasattr(v, "asDict"):
        return text_of(v.asDict())
    return str(v)


def _rows(df: DataFrame, columns: Sequence[str]) -> Iterator[list[str]]:
    """Rows one partition at a time, so the driver holds a partition and not the table."""
    for row in df.select(*columns).toLocalIterator():
        yield [text_of(v) for v in row]


def write_csv(df: DataFrame, path: str | Path, columns: Sequence[str]) -> None:
    """One named file: UTF-8, line feeds, fixed column order, other columns left out."""
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(columns)
        out.writerows(_rows(df, columns))


def _letters(n: int) -> str:
    s = ""
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


def _sheet(columns: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    widths = [min(60, max(10, *(len(text_of(r[i])) + 2 for r in [columns, *rows[:SAMPLED]]))) for i in range(len(columns))]
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))

    def cell(x: int, y: int, v: Any, style: int) -> str:
        at = f"{_letters(x)}{y}"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}" s="{style}"><v>{v!r}</v></c>'
        return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text_of(v))}</t></is></c>'

    body = "".join(f'<row r="{y}">' + "".join(cell(x, y, v, int(y == 1)) for x, v in enumerate(r, 1)) + "</row>" for y, r in enumerate([columns, *rows], 1))
    last = f"{_letters(len(columns))}{len(rows) + 1}"
    return (
        '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        f'<cols>{cols}</cols><sheetData>{body}</sheetData><autoFilter ref="A1:{last}"/></worksheet>'
    )


def write_workbook(path: str | Path, sheets: Mapping[str, tuple[Sequence[str], Iterable[Sequence[Any]]]]) -> None:
    """An OOXML workbook with bold header rows, a frozen first row and filters. The same rows give the same bytes."""
    names = list(sheets)
    ns = "http://schemas.openxmlformats.org"
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
    parts = {
        "[Content_Types].xml": f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>',
        "_rels/.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="rId1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets>'
        + "".join(f'<sheet name="{escape(n)[:31]}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{ns}/package/2006/relationships">'
        + "".join(f'<Relationship Id="rId{i}" Type="{ns}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        + f'<Relationship Id="rId{len(names) + 1}" Type="{ns}/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{ns}/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    }
    for i, n in enumerate(names, 1):
        columns, rows = sheets[n]
        parts[f"xl/worksheets/sheet{i}.xml"] = _sheet(columns, [list(r) for r in rows])
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            info = zipfile.ZipInfo(name, STAMP)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, text.encode("utf-8"))


def brief(title: str, counts: Mapping[str, Any], top: Sequence[Mapping[str, Any]], columns: Sequence[str], notes: Sequence[str] = ()) -> str:
    """A Markdown page: counts along the run, the leading rows, profiles of the first three, notes."""

    def line(values: Iterable[Any]) -> str:
        return "| " + " | ".join(text_of(v).replace("|", "\\|") for v in values) + " |"

    out = [f"# {title}", "", "## Counts", ""]
    out += [line(("step", "count")), line(("---", "---")), *[line((k, v)) for k, v in counts.items()]]
    out += ["", f"## Leading {len(top)}", "", line(columns), line("---" for _ in columns), *[line(r.get(k) for k in columns) for r in top]]
    for r in top[:3]:
        out += ["", f"### {text_of(r.get('name') or r.get('display_name'))}", "", *[f"- {k}: {text_of(v)}" for k, v in r.items() if v is not None]]
    if notes:
        out += ["", "## Notes", "", *[f"- {n}" for n in notes]]
    return "\n".join(out) + "\n"
