"""Markdown chunks: headings, paragraphs, small ones merged, large ones cut, headings attached."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..operators.resolution import chunked

HEADING = re.compile(r"^(#{1,6})[ \t]+(\S.*?)[ \t]*#*$", re.M)
BREAK = re.compile(r"\n[ \t]*\n")


def headings_of(text: str) -> list[tuple[int, int, str]]:
    """(offset, level, title) of each heading line outside fenced code."""
    fenced = [m.start() for m in re.finditer(r"^(?:```|~~~)", text, re.M)]
    inside = lambda at: sum(f < at for f in fenced) % 2 == 1
    return [(m.start(), len(m[1]), m[2]) for m in HEADING.finditer(text) if not inside(m.start())]


def paragraphs_of(text: str) -> list[tuple[int, int]]:
    """(begin, end) of what stands between blank lines; a heading begins a paragraph of its own."""
    cuts = {0, len(text)} | {at for at, _, _ in headings_of(text)}
    for m in BREAK.finditer(text):
        cuts |= {m.start(), m.end()}
    edges = sorted(cuts)
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if text[a:b].strip()]


def chunks_of(text: str, least: int = 200, most: int = 1500, overlap: int = 100) -> list[tuple[int, list[str], str]]:
    """(offset, headings above, content): paragraphs of one section are merged while the chunk is smaller than `least`; what is larger than `most` is cut."""
    if not 0 <= overlap < most:
        raise ValueError("overlap must be smaller than most")
    heads = headings_of(text)
    section = lambda at: sum(h <= at for h, _, _ in heads)
    merged: list[list[int]] = []
    for a, b in paragraphs_of(text):
        if merged and section(merged[-1][0]) == section(a) and merged[-1][1] - merged[-1][0] < least:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    out = []
    for a, b in merged:
        stack: list[tuple[int, str]] = []
        for at, level, title in heads:
            if at > a:
                break
            stack = [s for s in stack if s[0] < level] + [(level, title)]
        step = most - overlap
        pieces = range(a, max(a + 1, b - overlap), step) if b - a > most else [a]
        out += [(i, [t for _, t in stack], text[i : min(b, i + most)].strip("\n")) for i in pieces]
    return out


def chunk_documents(texts: DataFrame, least: int = 200, most: int = 1500, overlap: int = 100) -> DataFrame:
    """(id, n, start, headings, content) of texts (id, text)."""
    return texts.select("id", "text").mapInPandas(lambda batches: chunked(batches, lambda t: chunks_of(t, least, most, overlap)), "id long, n int, start int, headings array<string>, content string")
