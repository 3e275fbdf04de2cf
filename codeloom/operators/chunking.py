"""Chunkers and token counts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TIERS

_TOKEN = re.compile(r"\w+|[^\w\s]")


def count_tokens(text: str) -> int:
    """A stand-in for a model's tokenizer: words and punctuation marks."""
    return len(_TOKEN.findall(text))


def token_windows(text: str, size: int, overlap: int, count=count_tokens) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of windows of whole lines with at most ``size`` tokens, each starting with
    the last lines of the one before, up to ``overlap`` tokens. A line of more tokens than a window is cut
    into pieces that step by size - overlap tokens."""
    lines = text.split("\n")
    costs = [count(line) for line in lines]
    out, at = [], 0
    while at < len(lines):
        if costs[at] > size:
            spans = [m.span() for m in _TOKEN.finditer(lines[at])]
            step = max(1, size - overlap)
            for k in range(0, len(spans), step):
                part = spans[k : k + size]
                out.append((at + 1, at + 1, lines[at][part[0][0] : part[-1][1]]))
                if k + size >= len(spans):
                    break
            at += 1
            continue
        stop, used = at, 0
        while stop < len(lines) and used + costs[stop] <= size:
            used += costs[stop]
            stop += 1
        out.append((at + 1, stop, "\n".join(lines[at:stop])))
        if stop >= len(lines):
            break
        back, kept = stop, 0
        while back - 1 > at and kept + costs[back - 1] <= overlap:
            back -= 1
            kept += costs[back]
        at = back if costs[stop] <= size and kept + costs[stop] <= size else stop
    return out


def header(path: str, scope: str, kind: str, tags: list[str], start: int, stop: int, body: str, part: tuple[int, int] | None = None) -> str:
    which = f" (Part {part[0]}/{part[1]})" if part else ""
    return f"File: {path}\nEntity: {scope}{which}\nTags: {' '.join(tags)}\nType: {kind}\nLines: {start}-{stop}\nCode:\n{body}"


def chunk_text(path: str, text: str, scope: str, kind: str, tags: list[str], tier: int, first: int = 1) -> list[dict]:
    """One chunk, or parts ``scope_part_i`` where it has more tokens than its tier allows."""
    _, size, overlap = TIERS[tier]
    windows = token_windows(text, size, overlap)
    if len(windows) <= 1:
        stop = first + text.count("\n")
        return [{"path": path, "scope": scope, "tier": tier, "start_line": first, "end_line": stop, "text": header(path, scope, kind, tags, first, stop, text), "tags": tags}]
    n = len(windows)
    return [
        {"path": path, "scope": f"{scope}_part_{i}", "tier": tier, "start_line": first + a - 1, "end_line": first + b - 1, "text": header(path, scope, kind, tags, first + a - 1, first + b - 1, body, (i, n)), "tags": tags}
        for i, (a, b, body) in enumerate(windows, 1)
    ]


def three_tiers(path: str, text: str, symbols: list[dict]) -> list[dict]:
    """Tier 1 by symbol (the whole file where there is none), tiers 2 and 3 by file; of equal scopes the last stays."""
    out: dict[tuple, dict] = {}
    parts = [(s["fqn"], s["kind"], s.get("tags", []), s["text"], s["start_line"]) for s in symbols] or [("Full File", "file", [], text, 1)]
    for scope, kind, tags, body, first in parts:
        for c in chunk_text(path, body, scope, kind, tags, 1, first):
            out.pop((1, c["scope"]), None)
            out[1, c["scope"]] = c
    for tier in (2, 3):
        for c in chunk_text(path, text, "Full File", "file", [], tier):
            out[tier, c["scope"]] = c
    return list(out.values())


def chunk_files(files: DataFrame, tier: int = 2) -> DataFrame:
    """Token windows of whole files (path, text), over Arrow batches."""
    def run(batches):
        for pdf in batches:
            rows = [c for p, t in zip(pdf.path, pdf.text.fillna("")) for c in chunk_text(p, t, "Full File", "file", [], tier)]
            yield pd.DataFrame(rows, columns=["path", "scope", "tier", "start_line", "end_line", "text", "tags"])

    return files.select("path", F.col("text")).mapInPandas(run, "path string, scope string, tier int, start_line int, end_line int, text string, tags array<string>")
