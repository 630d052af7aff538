"""Splitting oversized items at natural boundaries (problem 5): content-defined chunking.

A hash rolls over the last WIDTH characters; where it falls on a multiple of the spacing stands a
landmark.  A piece ends at the natural boundary nearest to the first landmark between its smallest
and largest size.  Since landmarks depend on nearby characters only, an edit changes the pieces
around it and the cuts after them fall where they fell before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 16
BASE = np.uint64(0x9E3779B97F4A7C15)

PIECES = "item_kind string, item_id string, piece_no int, n_pieces int, start long, end long, overlap int, piece string"

# ends of paragraphs, lines, sentences and clauses, each with the strength of the boundary after it
_MARKS = (
    (4, re.compile(r"\n[ \t　\r]*\n\s*|\r\n[ \t]*\r\n\s*")),
    (3, re.compile(r"\r\n|\n|\r| | |\x0b|\x0c|\x85")),
    (2, re.compile(r"[。！？!?；;…]+[”’」』）)\"']*|\.[”’)\"']*(?=\s)")),
    (1, re.compile(r"[，、,：:]|\s+")),
)
#: A cut never stands before one of these: it would part a character from its marks.
_JOINED = re.compile(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︀-️︠-︯‍\U0001f3fb-\U0001f3ff\U000e0100-\U000e01ef]|(?<=‍).|(?<=\r)\n", re.S)


def rolling_hash(codes: np.ndarray) -> np.ndarray:
    """Of each position, the hash of the WIDTH code points before it (fewer at the start)."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * BASE
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(len(codes) + 1, np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for back in range(min(WIDTH, len(codes))):
            total[back + 1 :] += mixed[: len(codes) - back] * factor
            factor = factor * np.uint64(6364136223846793005)
        total ^= total >> np.uint64(31)
        total *= np.uint64(0xBF58476D1CE4E5B9)
    return total >> np.uint64(33)


def boundaries(text: str) -> np.ndarray:
    """Strength of the natural boundary before each position (0: none, -1: no cut allowed)."""
    strength = np.zeros(len(text) + 1, np.int8)
    for level, mark in reversed(_MARKS):
        for m in mark.finditer(text):
            strength[m.end()] = level
    for m in _JOINED.finditer(text):
        strength[m.start()] = -1
    return strength


def _snap(at: int, lo: int, hi: int, strength: np.ndarray) -> int:
    """The sentence end or stronger boundary nearest to ``at``, else the nearest clause end, else the nearest allowed place."""
    window = strength[lo : hi + 1]
    for least in (2, 1, 0):
        ok = np.flatnonzero(window >= least)
        if len(ok):
            return lo + int(ok[np.argmin(np.abs(ok - (at - lo)))])
    return hi


def cuts(text: str, max_chars: int, overlap: int) -> list[int]:
    """Ends of the pieces: the first piece is at most ``max_chars`` long, later ones leave room for the overlap."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks, strength, n = rolling_hash(codes), boundaries(text), len(codes)
    room = max(1, max_chars - overlap)
    least = min(max(overlap, room // 4, 1), room)
    landmark = marks % np.uint64(max(1, room // 4)) == 0
    out, start = [], 0
    while True:
        most = max_chars if not start else room
        if n - start <= most:
            out.append(n)
            return out
        lo, hi = start + (least if start else max(least, overlap)), start + most
        at = np.flatnonzero(landmark[lo : hi + 1])
        at = lo + int(at[0] if len(at) else np.argmax(marks[lo : hi + 1]))
        start = _snap(at, lo, hi, strength)
        out.append(start)


def split_text(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of each piece; ``start`` includes the overlap, which is 0 in the first piece.

    An overlap as long as the limit or longer would leave no room for anything new; it is cut to one character less.
    The overlap that each piece has is part of the result.
    """
    overlap = max(0, min(overlap, max_chars - 1))
    out, start = [], 0
    for end in cuts(text, max_chars, overlap):
        lap = min(overlap, start)
        out.append((start - lap, end, lap))
        start = end
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for kind, item, text, most, lap in zip(pdf.item_kind, pdf.item_id, pdf.text, pdf.max_chars, pdf.overlap_chars):
            spans = split_text(text, int(most), int(lap))
            rows += [(kind, item, i, len(spans), a, b, o, text[a:b]) for i, (a, b, o) in enumerate(spans)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Items (item_kind, item_id, text) longer than their limit in code points, repeated rows once."""
    limits = limits.select("item_kind", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars")).where("max_chars > 0")
    return (
        items.select("item_kind", "item_id", "text")
        .join(limits, "item_kind")
        .where(F.length("text") > F.col("max_chars"))
        .dropDuplicates(["item_kind", "item_id", "text"])
    )


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every oversized item: PIECES.  The item is the pieces without their overlaps, in order.

    Null, empty and short texts are not oversized; a kind without a limit has no oversized items;
    a null id stays null; equal rows give one set of pieces; an empty table gives no pieces.  A text
    without any boundary is cut at landmarks.  Extra columns are ignored.  Only oversized texts
    reach Python, and each text is cut by itself.
    """
    return oversized(items, limits).mapInPandas(_pieces, PIECES)
