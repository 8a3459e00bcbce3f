"""Report rows: dictionary-encoded columns, and a self-contained page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dictionary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with each column replaced by <column>_code, the rank from 0 of its value.

    Distinct values of a label column are few; they are ranked apart and joined
    back, so rows are never brought into one task.
    """
    from pyspark.sql import Window

    for c in columns:
        codes = rows.select(c).distinct().withColumn(f"{c}_code", (F.row_number().over(Window.orderBy(c)) - 1).cast("int"))
        rows = rows.join(codes, rows[c].eqNullSafe(codes[c]), "left").drop(codes[c]).drop(c)
    return rows


def labels(paths: list[str]) -> list[str]:
    """Sample labels from file paths: the stem, with parent folders where stems collide, then #n."""
    parts = [p.rstrip("/").split("/") for p in paths]
    stem = lambda s: s.removesuffix(".gz").rsplit(".", 1)[0] if "." in s.removesuffix(".gz") else s.removesuffix(".gz")
    out = []
    for p in parts:
        depth, name = 1, stem(p[-1])
        while depth < len(p) and sum(_at(q, depth, stem) == name for q in parts) > 1:
            depth += 1
            name = _at(p, depth, stem)
        out.append(name)
    seen: dict[str, int] = {}
    for i, name in enumerate(out):
        seen[name] = seen.get(name, 0) + 1
        if seen[name] > 1:
            out[i] = f"{name}#{seen[name]}"
    return out


def _at(parts: list[str], depth: int, stem) -> str:
    return "/".join([*parts[-depth:-1], stem(parts[-1])])


def page(rows: list[dict], title: str = "Variants") -> str:
    """One HTML page with the rows as JSON; the text can't end the script element."""
    data = json.dumps(rows, ensure_ascii=False).replace("<", "\\u003c")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><table id='t'></table><script>const rows={data};const t=document.getElementById('t');const cols=Object.keys(rows[0]||{{}});const add=(v,k)=>{{const r=document.createElement('tr');v.forEach(x=>{{const c=document.createElement(k);c.textContent=x??'-';r.append(c)}});t.append(r)}};add(cols,'th');rows.forEach(r=>add(cols.map(c=>r[c]),'td'));</script></body></html>"
