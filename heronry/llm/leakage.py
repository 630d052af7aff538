"""Evaluation texts leaking into training text (problem 6): a generalised suffix automaton.

All normalised test texts go into one automaton.  The training text streams through it; at every
character the automaton knows the longest stretch ending there that occurs in some test text, and in
which ones.  Stretches that reach the limit are leaks.  Shorter ones that reach the length which a
text changed in at most one unit of ten must keep somewhere are anchors: there the whole test text is
compared with the surroundings by bit-parallel approximate matching.

Every leak has its spans in the original text: unbroken runs over the limit of length, and stretches
that cover a complete test text but for one unit in ten.  ``without_leaks`` takes them out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unbroken run of letters and digits that is a leak: Chinese items and English items.
RUN_CJK, RUN_LATIN = 24, 60
#: One in so many characters (Chinese) or words (English) of a complete text may be changed.
ONE_IN = 10
#: Characters of test texts in one automaton; more of them are searched in blocks.
BLOCK_CHARS = 400_000

_MARKUP = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|&(?:[a-zA-Z]{2,8}|#\d{1,7}|#x[0-9a-fA-F]{1,6});", re.S)
_LINK = re.compile(r"\]\([^()\s]*\)")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}\p{Cc}--\s]+", regex.V1)
_TOKEN = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[㐀-鿿豈-﫿]")


def normalise(text: str) -> tuple[str, list[int]]:
    """Letters and digits only, and where each word begins.  Character width, case, white space,
    punctuation, marks, invisible characters and markup fall away; a word is a run of Latin letters
    and digits or one Chinese character."""
    text = unicodedata.normalize("NFKC", _LINK.sub("] ", _MARKUP.sub(" ", text))).casefold()
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    out, starts, n = [], [], 0
    for m in _TOKEN.finditer(text):
        token = m.group()
        starts.append(n)
        if _CJK.search(token):
            starts.extend(range(n + 1, n + len(token)))
        out.append(token)
        n += len(token)
    return "".join(out), starts


def _joins(ch: str) -> bool:
    """Whether the character can melt with the one before it under NFKC."""
    return unicodedata.category(ch)[0] == "M" or "\u1160" <= ch <= "\u11ff" or ch in "\uff9e\uff9f"


def located(text: str) -> tuple[str, list[int], list[tuple[int, int]]]:
    """The same as ``normalise``, and the place of each letter or digit in the text (start and end)."""
    src = [(i, i + 1) for i in range(len(text))]
    for pattern, sign in ((_MARKUP, " "), (_LINK, "] ")):
        parts, places, end = [], [], 0
        for m in pattern.finditer(text):
            parts += [text[end : m.start()], sign]
            places += [*src[end : m.start()], *[src[m.start()]] * len(sign)]
            end = m.end()
        text, src = "".join([*parts, text[end:]]), places + src[end:]
    chars, places, i = [], [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[j] > "\u02ff" and _joins(text[j]):
            j += 1
        piece = unicodedata.normalize("NFKC", text[i:j]).casefold()
        piece = _INVISIBLE.sub("", unicodedata.normalize("NFKC", piece))
        chars += piece
        places += [(src[i][0], src[j - 1][1])] * len(piece)
        i = j
    out, starts, where = [], [], []
    for m in _TOKEN.finditer("".join(chars)):
        starts += range(len(where), len(where) + len(m.group())) if _CJK.search(m.group()) else [len(where)]
        out.append(m.group())
        where += places[m.start() : m.end()]
    return "".join(out), starts, where


class Automaton:
    """Generalised suffix automaton with the set of texts of each state."""

    def __init__(self, texts: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, int]] = []
        for number, text in enumerate(texts):
            last = 0
            for ch in text:
                last = self._extend(last, ch)
                ends.append((last, number))
        held: list[set] = [set() for _ in self.len]
        for state, number in ends:
            while state > 0 and number not in held[state]:
                held[state].add(number)
                state = self.link[state]
        self.texts = [frozenset(s) for s in held]

    def _state(self, length: int, link: int, step: dict[str, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(step)
        return len(self.len) - 1

    def _split(self, p: int, ch: str, q: int) -> int:
        """A copy of q for the shorter stretches that reach it through p."""
        copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(ch) == q:
            self.next[p][ch] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, ch: str) -> int:
        q = self.next[last].get(ch)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, ch, q)
        cur = self._state(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and ch not in self.next[p]:
            self.next[p][ch] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][ch]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, ch, q)
        return cur

    def at_least(self, length: int) -> list[int]:
        """Of each state, the shortest suffix state that still holds its suffix of ``length`` characters."""
        out = [0] * len(self.len)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            link = self.link[s]
            out[s] = out[link] if self.len[link] >= length else s
        return out

    def matches(self, text: str, least: int = 1) -> list[tuple[int, int, int]]:
        """(position, state, length) of the longest match that ends at each character, where it has ``least`` characters."""
        step, link, lens = self.next, self.link, self.len
        state = length = i = 0
        out = []
        for ch in text:
            q = step[state].get(ch)
            while q is None and state:
                state = link[state]
                length = lens[state]
                q = step[state].get(ch)
            if q is not None:
                state = q
                length += 1
                if length >= least:
                    out.append((i, state, length))
            i += 1
        return out


def approximate(pattern: list, text: list, limit: int) -> bool:
    """Whether some stretch of ``text`` is within ``limit`` edits of ``pattern``; bit-parallel, any symbols."""
    m = len(pattern)
    peq: dict = {}
    for i, s in enumerate(pattern):
        peq[s] = peq.get(s, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for s in text:
        eq = peq.get(s, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score <= limit:
            return True
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return score <= limit


def _scores(pattern: list, text: list) -> Iterator[int]:
    """After each symbol of ``text`` the least number of edits between the pattern and a stretch that ends there."""
    m = len(pattern)
    peq: dict = {}
    for i, s in enumerate(pattern):
        peq[s] = peq.get(s, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for s in text:
        eq = peq.get(s, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        yield score
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv


def stretches(pattern: list, text: list, limit: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the stretches of ``text`` within ``limit`` edits of the pattern, the best one where they overlap."""
    ends: list[tuple[int, int]] = []
    for i, score in enumerate(_scores(pattern, text)):
        if score > limit:
            continue
        if not ends or i + 1 - ends[-1][0] > limit * 2 + 1:
            ends.append((i + 1, score))
        elif score < ends[-1][1]:
            ends[-1] = (i + 1, score)
    out = []
    for end, score in ends:
        # over the same stretch from behind the pattern has the same number of edits; there its start is
        lo = max(0, end - len(pattern) - limit)
        back = [n for n, edits in enumerate(_scores(pattern[::-1], text[lo:end][::-1]), 1) if edits <= score]
        out.append((end - (back[0] if back else end - lo), end, score))
    return out


class Searcher:
    """What a block of test texts needs for streaming: the automaton, the limits and the anchors."""

    Q = 3

    def __init__(self, items: list[tuple[str, str]]):
        texts = [(case, *normalise(t)) for case, t in items]
        texts = [(case, t, starts) for case, t, starts in texts if t]
        self.cases = [case for case, _, _ in texts]
        self.cjk = [bool(_CJK.search(t)) for _, t, _ in texts]
        self.run = [RUN_CJK if c else RUN_LATIN for c in self.cjk]
        self.units = [list(t) if c else [t[a:b] for a, b in zip(s, [*s[1:], len(t)])] for c, (_, t, s) in zip(self.cjk, texts)]
        self.anchor = [self._anchor(u) for u in self.units]
        self.grams = [[tuple(u[i : i + self.Q]) for i in range(len(u) - self.Q + 1)] for u in self.units]
        self.automaton = Automaton([t for _, t, _ in texts])
        self.length = [len(t) for _, t, _ in texts]
        self.levels = sorted({*self.run, *self.anchor})
        self.up = {n: self.automaton.at_least(n) for n in self.levels}
        self.least = min(self.levels, default=0)
        self.least_run = min(self.run, default=0)

    @staticmethod
    def _anchor(units: list) -> int:
        """Characters that the longest untouched run of a text with at most one edit in ONE_IN units must have."""
        edits = len(units) // ONE_IN
        run = max(1, -(-(len(units) - edits) // (edits + 1)))
        sizes = [len(u) for u in units]
        return min(sum(sizes[i : i + run]) for i in range(len(sizes) - run + 1))

    def leaks(self, text: str) -> set[tuple[str, str, int]]:
        """(case_id, how, length): the longest of the runs that reach the limit, and complete texts with few changes."""
        flat, starts = normalise(text)
        runs, anchors = self._matches(flat)
        found = {(self.cases[k], "run", max(end - start for start, end in ends.items())) for k, ends in runs.items()}
        ran = {case for case, _, _ in found}
        for k, blocks in anchors.items():
            if self.cases[k] not in ran and any(self._near(k, flat, starts, blocks)):
                found.add((self.cases[k], "approximate", self.length[k]))
        return found

    def spans(self, text: str) -> list[tuple[str, str, int, int, int, float]]:
        """(case_id, how, start, end, length, coverage) of every leak, in characters of the original text: ``run`` is
        over the limit of length, ``approximate`` over that of coverage; length counts letters and digits, coverage
        is the share of the test text."""
        if not self.leaks(text):
            return []
        flat, starts, places = located(text)
        runs, anchors = self._matches(flat)
        found = {(k, "run", start, end, (end - start) / self.length[k]) for k, ends in runs.items() for start, end in ends.items()}
        for k, blocks in anchors.items():
            for window, bounds in self._near(k, flat, starts, blocks):
                for a, b, edits in stretches(self.units[k], window, len(self.units[k]) // ONE_IN):
                    found.add((k, "approximate", bounds[a], bounds[b], 1 - edits / len(self.units[k])))
        # a text that two blocks of anchors find in two windows comes out once
        return sorted({(self.cases[k], how, places[a][0], places[b - 1][1], b - a, round(share, 4)) for k, how, a, b, share in found if b > a})

    def _matches(self, flat: str) -> tuple[dict[int, dict[int, int]], dict[int, set]]:
        """Of each test text the runs that reach its limit (start and largest end), and the blocks of its anchors."""
        runs: dict[int, dict[int, int]] = {}
        anchors: dict[int, set] = {}
        if not self.cases or len(flat) < self.least:
            return runs, anchors
        sets, link, lens = self.automaton.texts, self.automaton.link, self.automaton.len
        before: dict[int, int] = {}
        for i, state, length in self.automaton.matches(flat, self.least):
            # the suffix links lead to the shorter stretches, which more test texts hold
            s, n, seen = state, length, frozenset()
            while n >= self.least_run:
                for k in sets[s] - seen:
                    if n >= self.run[k]:
                        runs.setdefault(k, {})[i + 1 - n] = i + 1
                seen = sets[s]
                s = link[s]
                n = lens[s]
            for n in self.levels:
                if length < n:
                    break
                at = self.up[n][state]
                if before.get(n) == (at, i - 1):
                    before[n] = (at, i)
                    continue
                before[n] = (at, i)
                for k in sets[at]:
                    if n == self.anchor[k]:
                        anchors.setdefault(k, set()).add(i // max(1, self.length[k]))
        return runs, anchors

    def _near(self, k: int, flat: str, starts: list[int], blocks: set) -> Iterator[tuple[list, list[int]]]:
        """Compare text k with the surroundings of its anchors; anchors in one block share a window.  Gives the windows
        that hold it, with the place where each of their units begins and the last ends."""
        from bisect import bisect_left

        pattern, limit, n = self.units[k], len(self.units[k]) // ONE_IN, self.length[k]
        reach = n + n // 4 + 40
        for b in blocks:
            lo, hi = max(0, b * n - reach), min(len(flat), (b + 1) * n + reach)
            if self.cjk[k]:
                window, bounds = list(flat[lo:hi]), list(range(lo, hi + 1))
            else:
                first, last = bisect_left(starts, lo), bisect_left(starts, hi)
                bounds = [*starts[first:last], starts[last] if last < len(starts) else len(flat)]
                window = [flat[x:y] for x, y in zip(bounds, bounds[1:])]
            # a stretch within ``limit`` edits keeps all but q * limit of the text's q-grams
            there = {tuple(window[i : i + self.Q]) for i in range(len(window) - self.Q + 1)}
            kept = sum(g in there for g in self.grams[k])
            if kept >= len(self.grams[k]) - self.Q * limit and approximate(pattern, window, limit):
                yield window, bounds


def blocks(items: list[tuple[str, str]], size: int = BLOCK_CHARS) -> list[list[tuple[str, str]]]:
    """The test texts in blocks of bounded size."""
    out, room = [[]], size
    for case, text in items:
        if out[-1] and len(text) > room:
            out.append([])
            room = size
        out[-1].append((case, text))
        room -= len(text)
    return out


def leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, case_col: str, text_cols: list[str]) -> DataFrame:
    """id, case_id, how, length: every document with every test item that it leaks.

    The test items are the stated query set; they are sent to the tasks in blocks of BLOCK_CHARS
    characters, whose automata are bounded, and all documents stream past each block.  Null and empty
    texts leak nothing; copies of a document under other ids are reported for each id; an item whose
    texts are null or empty is never found.
    """
    spark = docs.sparkSession
    texts = _texts(items, case_col, text_cols)
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    out = None
    for block in blocks(texts):
        shared = spark.sparkContext.broadcast(Searcher(block))
        part = source.mapInPandas(_search(shared), f"id {id_type}, case_id string, how string, length int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id", "case_id").agg(F.max("how").alias("how"), F.max("length").alias("length"))


def _texts(items: DataFrame, case_col: str, text_cols: list[str]) -> list[tuple[str, str]]:
    long = items.select(F.col(case_col).cast("string").alias("case_id"), F.explode(F.array(*text_cols)).alias("text")).where("text is not null and text <> ''").distinct().orderBy("case_id", "text")
    return [(r.case_id, r.text) for r in long.toLocalIterator()]


SPANS = "array<struct<case_id:string,how:string,start:int,end:int,length:int,coverage:double>>"


def without_leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, case_col: str, text_cols: list[str]) -> DataFrame:
    """id, text, spans: every document with its leaked spans (offsets in characters of the original text) and
    its text without them.  Documents that leak nothing, null and empty texts stay as they are, with no spans.
    The documents pass the blocks of test texts one after the other; nothing is shuffled."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast(SPANS).alias("spans"))
    for block in blocks(_texts(items, case_col, text_cols)):
        shared = spark.sparkContext.broadcast(Searcher(block))
        out = out.mapInArrow(_add_spans(shared), f"id {id_type}, text string, spans {SPANS}")
    return out.mapInArrow(_take_out, f"id {id_type}, text string, spans {SPANS}")


def _add_spans(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = shared.value
        names = ("case_id", "how", "start", "end", "length", "coverage")
        for batch in batches:
            spans = [[*old, *(dict(zip(names, s)) for s in searcher.spans(text))] if text else old for text, old in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(spans, batch.schema.field("spans").type)], schema=batch.schema)

    return search


def take_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which may overlap."""
    out, end = [], 0
    for a, b in sorted(spans):
        out.append(text[end : max(a, end)])
        end = max(end, b)
    return "".join([*out, text[end:]])


def _take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [take_out(text, [(s["start"], s["end"]) for s in some]) if some else text for text, some in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, batch.schema.field("text").type), batch.column("spans")], schema=batch.schema)


def _search(shared):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = shared.value
        for pdf in batches:
            rows = [(i, *leak) for i, t in zip(pdf["id"], pdf["text"]) for leak in searcher.leaks(t)]
            yield pd.DataFrame(rows, columns=["id", "case_id", "how", "length"])

    return search
