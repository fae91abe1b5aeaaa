"""Finding a passage in a rendered text: folding with offsets, segments, nearest matches. Offsets count code points."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯ᄀ-ᇿ㄰-㆏]")
SENTENCE_END = re.compile("([。！？.!?;；]+)")
LEAST_SEGMENT = 8
PARTIAL = 0.6
FOUND = "key string, ranges array<struct<start:int,end:int>>, coverage double"


def folded(text: str) -> tuple[str, list[int]]:
    """The text in one form, and where each of its characters came from."""
    out: list[str] = []
    source: list[int] = []
    gap = -1
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if c == "-" and at and text[at - 1].isascii() and text[at - 1].isalpha():
            m = re.compile(r"\r?\n[ \t]*(?=[a-z])").match(text, at + 1)
            if m:  # a word that the line end split
                at = m.end()
                continue
        if c == "­":
            pass
        elif c.isspace():
            gap = at if gap < 0 and out else gap
        else:
            own = unicodedata.normalize("NFKC", c).lower()
            if gap >= 0:
                if not (CJK.match(out[-1]) and CJK.match(own[:1] or " ")):
                    out.append(" ")
                    source.append(gap)
                gap = -1
            out.extend(own)
            source.extend([at] * len(own))
        at += 1
    return "".join(out), source


def segments(passage: str) -> list[str]:
    """The passage's sentences, folded, that are long enough to look for."""
    out = []
    for line in re.split(r"\n+", passage):
        parts = SENTENCE_END.split(line) + [""]
        for k in range(0, len(parts) - 1, 2):
            own = folded(parts[k] + parts[k + 1])[0].strip()
            if len(own) >= LEAST_SEGMENT:
                out.append(own)
    return out


def nearest(haystack: str, needle: str, near: int) -> int:
    """The occurrence closest to a place, the first of equals; -1 without one."""
    before = haystack.rfind(needle, 0, near + len(needle)) if near >= 0 else -1
    after = haystack.find(needle, max(0, near))
    if before < 0 or after < 0:
        return max(before, after)
    return before if near - before <= after - near else after


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find(haystack: str, passage: str, near: int = 0) -> tuple[list[tuple[int, int]], float]:
    """Ranges of the passage's segments in a folded text, and the share of it that was found."""
    pieces = segments(passage)
    total = sum(map(len, pieces))
    if not total or not haystack:
        return [], 0.0
    ranges, found = [], 0
    for piece in pieces:
        part = -(-len(piece) * 6 // 10)
        for own in (piece, piece[:part], piece[len(piece) - part :]):
            at = nearest(haystack, own, near)
            if at >= 0:
                ranges.append((at, at + len(own)))
                found += len(own)
                break
    return merged(ranges), found / total


def find_passages(rows: DataFrame) -> DataFrame:
    """FOUND for rows (key, haystack, passage, near); ranges are in the original text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, coverage = [], []
            for haystack, passage, near in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                text, source = folded(haystack or "")
                found, share = find(text, passage or "", near or 0)
                ranges.append([{"start": source[a], "end": source[b - 1] + 1} for a, b in found])
                coverage.append(share)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranges, kind), pa.array(coverage, pa.float64())], names=["key", "ranges", "coverage"])

    return rows.selectExpr("cast(key AS string) AS key", "haystack", "passage", "cast(near AS int) AS near").mapInArrow(run, FOUND)


def located(ranges: DataFrame, runs: DataFrame) -> DataFrame:
    """Ranges (key, start, end) cut at text runs (key, run, start, end): a range join on overlap within the key."""
    from pyspark.sql import functions as F

    a, b = ranges.alias("a"), runs.alias("b")
    meets = (F.col("a.key") == F.col("b.key")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return a.join(b, meets).select(F.col("a.key").alias("key"), "b.run", (F.greatest("a.start", "b.start") - F.col("b.start")).alias("start"), (F.least("a.end", "b.end") - F.col("b.start")).alias("end"))
