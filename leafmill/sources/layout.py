"""The structuring steps of ``operators.structure`` for one page inside a worker."""

from __future__ import annotations

import re
from math import floor
from statistics import median

from leafmill.functions.text import SECTION_NAMES
from leafmill.operators.structure import DEFAULT_GAP, GAP_FACTOR, LINE_BUCKET

_CAPTION = re.compile(r"\s*(figure|fig\.?|table|scheme|plate)\s*\d", re.I)
_NUMBERED = re.compile(r"\d+(?:\.\d+)*[.)]?\s+([A-Za-z].*)", re.S)


def kind_of(text: str) -> str:
    t = text.strip()
    if not t:
        return "other"
    if _CAPTION.match(t):
        return "caption"
    m = _NUMBERED.fullmatch(t)
    bare = (m[1] if m else t).rstrip(":.").strip()
    n = len(bare.split())
    named = bare.lower() in SECTION_NAMES
    return "section_header" if named or m and n <= 8 and not bare.endswith(".") or n <= 6 and bare.isupper() and len(bare) > 2 else "paragraph"


def lines_of_items(items: list[dict], height: float) -> list[dict]:
    """A page's text items (x, baseline, width, height, text; bottom-up) as lines (text, bbox; top-down)."""
    rows: dict[int, list[tuple]] = {}
    for i in items:
        if i["text"].strip():
            top = height - i["baseline"] - i["height"]
            rows.setdefault(floor(top / LINE_BUCKET + 0.5), []).append((i["x"], top, i["x"] + i["width"], top + i["height"], i["text"]))
    out = []
    for _, row in sorted(rows.items()):
        row.sort(key=lambda r: r[0])
        text = " ".join(" ".join(r[4] for r in row).split())
        if text:
            out.append({"text": text, "bbox": [min(r[0] for r in row), min(r[1] for r in row), max(r[2] for r in row), max(r[3] for r in row)]})
    return out


def blocks_of_words(words: list[dict], page: int) -> list[dict]:
    """A page's words as blocks."""
    rows: dict[int, list[dict]] = {}
    for w in words:
        rows.setdefault(round(w["top"] / LINE_BUCKET), []).append(w)
    lines = []
    for _, row in sorted(rows.items()):
        row.sort(key=lambda w: w["x0"])
        text = " ".join(w["text"] for w in row)
        lines.append({"text": text, "bbox": [min(w["x0"] for w in row), min(w["top"] for w in row), max(w["x1"] for w in row), max(w["bottom"] for w in row)]})
    return blocks_of_lines(lines, page)


def blocks_of_lines(rows: list[dict], page: int) -> list[dict]:
    """A page's lines (text, bbox) as blocks."""
    lines = [(r["text"].strip(), r["bbox"], kind_of(r["text"])) for r in rows if r["text"].strip()]
    limit = GAP_FACTOR * median(b[3] - b[1] for _, b, _ in lines) if lines else DEFAULT_GAP
    groups: list[list] = []
    for line in lines:
        last = groups[-1][-1] if groups else None
        if last is None or line[1][1] - last[1][3] > limit or line[2] != "paragraph" or last[2] != "paragraph":
            groups.append([])
        groups[-1].append(line)
    out = []
    for g in groups:
        text = g[0][0]
        for t, _, _ in g[1:]:
            text = text[:-1] + t if text.endswith("-") else f"{text} {t}"
        boxes = [b for _, b, _ in g]
        out.append({"page": page, "kind": kind_of(text), "text": text, "bbox": [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)]})
    return out


def padded(tables: list[list[list]], page: int) -> list[dict]:
    """Tables with rows of equal length."""
    out = []
    for t in tables:
        cols = max(map(len, t), default=0)
        if cols:
            out.append({"page": page, "rows": len(t), "cols": cols, "cells": [[c or "" for c in r] + [""] * (cols - len(r)) for r in t], "caption": None})
    return out
