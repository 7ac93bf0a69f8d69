"""Sinks: canonical JSON lines, CSV for review, and publication of several outputs at once."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_row
from ..operators.checks import ContractViolation, multiset_differs
from ..operators.manifest import require_root


def canonical_json(df: DataFrame):
    """A row as canonical JSON: keys in order at every depth, nulls included."""
    return canonical_row(df)


def write_jsonl(df: DataFrame, path: str, order: list[str], single: bool = True) -> None:
    """Canonical JSON lines in a total order. single: one file; else range-partitioned files whose order is their names'."""
    lines = df.select(*order, canonical_json(df).alias("value")) if order else df.select(canonical_json(df).alias("value"))
    lines = lines.coalesce(1).sortWithinPartitions(*order) if single and order else lines.orderBy(*order) if order else lines
    lines.select("value").write.text(path)


def write_spaced_jsonl(df: DataFrame, path: str | os.PathLike, order: list[str], most: int = 100_000) -> None:
    """JSON lines with ", " and ": " between parts, fields in the order of the columns, rows in a total order, in one
    driver-side file: for sheets and manifests, whose bytes others compare. More than `most` rows are refused, not cut."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ContractViolation(f"more than {most} rows; use write_jsonl")
    atomic_write(path, "".join(json.dumps(r.asDict(recursive=True), ensure_ascii=False, allow_nan=False) + "\n" for r in rows))


def atomic_write(path: str | os.PathLike, text: str, private: bool = False) -> None:
    """A driver-side file, complete or not there at all: written beside its place, then renamed. private: mode 0600."""
    target = Path(path)
    fd, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.chmod(name, 0o600 if private else 0o644)
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_manifest(path: str | os.PathLike, value: dict) -> None:
    atomic_write(path, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n")


def write_review_csv(df: DataFrame, path: str | os.PathLike, header: list[str], most: int = 100_000) -> None:
    """A review sheet for people: fixed header, byte order mark. A sheet is small; a larger one is refused, not cut."""
    rows = df.select(*header).limit(most + 1).collect()
    if len(rows) > most:
        raise ContractViolation(f"a review sheet holds {most} rows at most")
    out = io.StringIO()
    sheet = csv.writer(out, lineterminator="\r\n")
    sheet.writerow(header)
    sheet.writerows([["" if v is None else v for v in r] for r in rows])
    atomic_write(path, "﻿" + out.getvalue())


def publish(outputs: dict[str, DataFrame], root: str, checks=lambda staged: None, registered: dict[str, str] | None = None) -> None:
    """All outputs or none: each is written under a staging folder, checked together, then the folder is renamed.

    registered: roots (operators/manifest.py) that what was written must have, taken from the staged files, in any number and order."""
    jvm = next(iter(outputs.values())).sparkSession._jvm
    conf = next(iter(outputs.values())).sparkSession._jsc.hadoopConfiguration()
    final, staging = jvm.org.apache.hadoop.fs.Path(root), jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}.staging")
    fs = final.getFileSystem(conf)
    if fs.exists(final):
        raise ContractViolation(f"{root} is there already")
    try:
        for name, df in outputs.items():
            df.write.parquet(f"{staging}/{name}")
        staged = {name: df.sparkSession.read.parquet(f"{staging}/{name}") for name, df in outputs.items()}
        for name, expected in (registered or {}).items():
            require_root(staged[name], expected, name)
        checks(staged)
        if not fs.rename(staging, final):
            raise ContractViolation(f"{root} could not be published")
    finally:
        fs.delete(staging, True)


def require_distinct(paths: list[str | os.PathLike]) -> None:
    """Inputs and outputs must be different files, hard links included."""
    seen: dict = {}
    for p in map(Path, paths):
        key = (p.stat().st_dev, p.stat().st_ino) if p.exists() else str(p.resolve())
        if key in seen:
            raise ContractViolation(f"{p} and {seen[key]} are one file")
        seen[key] = p


def write_back(old: DataFrame, new: DataFrame, key: str, path: str) -> bool:
    """Writes new to path only if a row differs from old; whether it did."""
    changed = not multiset_differs(old, new).isEmpty()
    if changed:
        new.orderBy(key).write.parquet(path)
    return changed


def svg_lines(points: list[tuple[str, float, float]], width: int = 640, height: int = 360, title: str = "", margin: int = 40) -> str:
    """A polyline per series from scaled points (series, x, y), as plot_points gives them, with axes and a title."""
    inner_w, inner_h = width - 2 * margin, height - 2 * margin
    by: dict[str, list[str]] = {}
    for series, x, y in sorted(points):
        by.setdefault(series, []).append(f"{margin + x * inner_w:.2f},{margin + (1 - y) * inner_h:.2f}")
    lines = "".join(f'<polyline class="{escape(s)}" fill="none" stroke="black" points="{" ".join(p)}"/>' for s, p in by.items())
    axes = f'<path fill="none" stroke="black" d="M{margin},{margin} V{height - margin} H{width - margin}"/>'
    head = f'<text x="{margin}" y="{margin // 2}">{escape(title)}</text>' if title else ""
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">{head}{axes}{lines}</svg>\n'
