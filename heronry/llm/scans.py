"""Noise in text from scanned pages (problem 4).

1. Page furniture: the lines at the head and foot of a page are counted per document and over the
   corpus, and against the lines inside the text; what comes again at the edges is furniture.
2. Vocabulary: words, neighbours and stretches of characters of all running text are counted; what
   is frequent goes into tries, in blocks.
3. Wrong characters: a word is run as a Levenshtein automaton over the trie, which gives every
   word of the vocabulary within the distance; the neighbours rank them.  Chinese text has no
   words, so there every stretch of GRAM characters is a word.  What the scanner takes for each
   other is learned from the corpus: edits that many unrelated words ask for and that no digital
   page has.  Every distinct word with its neighbours and every distinct stretch is judged once.
4. Repair: furniture is removed, cut words are joined, misread ones replaced, lines reflowed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.tables import staged

#: Non-blank lines at the head and at the foot of a page that can be furniture.
ZONE = 3
#: A line is furniture of its document if it comes again on this share of the pages, and on two at least.
DOC_SHARE = 0.1
#: Share of its places in the document that must be at the edges; a sentence that comes again and again is no furniture.
DOC_EDGE = 0.75
#: A line or first word is furniture of the corpus if this share of its places is at the edges, in this many documents.
EDGE_SHARE, EDGE_DOCS = 0.9, 5
GRAM = 4
#: A reading is wrong if another one in the same surroundings is this many times as frequent, and seen so often.
RATIO, SEEN = 12, 10
#: The scanner takes two characters for each other if so many entries say it and at most one in CASES_EACH of them is genuine.
CASES, CASES_EACH = 8, 20
#: Fewer cases need a candidate this many times as frequent.
WEAK_RATIO = 40
#: Entries of the trie in one task.
BLOCK = 50_000

_HAN = "㐀-鿿"
_NUM_CN = "零〇一二三四五六七八九十百千"
_PAGE_NO = re.compile(
    rf"^(?:[-–—~·•〔\[(（【<|]*\s*(?P<n>[0-9]{{1,4}})\s*[-–—~·•〕\])）】>|]*|(?P<a>[0-9]{{1,4}})\s*(?:/|of|von)\s*[0-9]{{1,4}}|(?:共\s*[0-9]+\s*[页頁]\s*[,，]?\s*)?第\s*(?P<c>[0-9]{{1,4}}|[{_NUM_CN}]{{1,6}})\s*[页頁](?:\s*[,，/]?\s*共\s*[0-9{_NUM_CN}]+\s*[页頁])?"
    rf"|(?:page|p\.?|pg\.?|seite|s\.)\s*(?P<p>[0-9]{{1,4}})(?:\s*(?:/|of|von)\s*[0-9]{{1,4}})?|(?P<r>[ivxl]{{1,6}}))$",
    re.I,
)
_VERSION = re.compile(r"^(?:v|ver\.?|version|rev\.?|版本)\s*\d+(?:\.\d+)*(?:\s+\d{4}[-./]\d{1,2}(?:[-./]\d{1,2})?)?$", re.I)
_NOTICE = re.compile(r"^(?:©|\(c\)|copyright\b)|all rights reserved|(?:for )?internal use only|confidential|内部资料|请勿外传|版权所有", re.I)
_SIDE_NO = re.compile(r"^\d{1,4}\s{2,}(?=\S)|(?<=\S)\s{2,}\d{1,4}$")
_HEADING = re.compile(rf"^(?:#+\s|第[{_NUM_CN}0-9]+[章节条部篇]|[{_NUM_CN}]+、|(?:chapter|section|part)\s+\d+|\d+(?:\.\d+)*[.、]?\s)", re.I)
#: A line that starts a paragraph of its own: a heading or an item of a list.
_STARTS = re.compile(rf"^(?:#+\s|第[{_NUM_CN}0-9]+[章节条部篇]|[{_NUM_CN}]+、|(?:chapter|section|part)\s+\d+|\d{{1,3}}(?:\.\d+)*[.、]\s)", re.I)
_TOKEN = re.compile(rf"[A-Za-z0-9†]+(?:['’][A-Za-z]+)?")
_CUT = re.compile(r"[A-Za-z†][-‐‑]$")
#: Characters and pairs that scanners take for each other.
LOOKALIKE = [("l", "1"), ("i", "1"), ("l", "i"), ("i", "!"), ("l", "|"), ("o", "0"), ("s", "5"), ("g", "9"), ("q", "9"), ("b", "6"), ("b", "8"), ("z", "2"), ("e", "c"), ("h", "b"), ("t", "†"), ("f", "t"), ("n", "u"), ("a", "o"), ("v", "y"), ("w", "vv"), ("m", "rn"), ("d", "cl"), ("h", "li"), ("u", "ii"), ("n", "ri"), ("k", "lc")]


# ---------------------------------------------------------------- furniture


def line_key(line: str) -> str:
    """A line without the page number beside it, in lower case, with single spaces."""
    return re.sub(r"\s+", " ", _SIDE_NO.sub("", line.strip())).casefold()


def page_number(line: str) -> int | None:
    m = _PAGE_NO.match(line.strip())
    if not m:
        return None
    if m["r"]:
        values = {"i": 1, "v": 5, "x": 10, "l": 50}
        nums = [values[c] for c in m["r"].lower()]
        return sum(-a if a < b else a for a, b in zip(nums, [*nums[1:], 0]))
    text = m["n"] or m["a"] or m["c"] or m["p"]
    if text.isdigit():
        return int(text)
    total = unit = 0
    for c in text:
        d = "零一二三四五六七八九".find("零" if c == "〇" else c)
        if d >= 0:
            unit = d
        else:
            total += max(unit, 1) * {"十": 10, "百": 100, "千": 1000}[c]
            unit = 0
    return total + unit


def _edge_lines(text: str) -> tuple[list[int], list[int], list[str]]:
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    return full[:ZONE], full[-ZONE:], lines


def _line_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, page, text in zip(pdf.doc_id, pdf.page_num, pdf.text):
            head, foot, lines = _edge_lines(text)
            edge = {*head, *foot}
            for i, line in enumerate(lines):
                key = line_key(line)
                if not key:
                    continue
                number = page_number(line) if i in edge else None
                rows.append((doc, page, i in edge, key if number is None else "", key.split(" ")[0] if " " in key else "", None if number is None else number - page))
        yield pd.DataFrame(rows, columns=["doc_id", "page_num", "edge", "key", "word", "shift"])


def furniture(pages: DataFrame) -> DataFrame:
    """doc_id, keys, shifts: of each document the lines that are furniture at its edges, and the differences
    between printed and counted page numbers that come again.  Both lists are bounded: an entry needs
    DOC_SHARE of the pages, and a page has 2 * ZONE places."""
    lines = staged(pages.mapInPandas(_line_rows, "doc_id string, page_num int, edge boolean, key string, word string, shift int"), "lines")
    n_pages = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    in_doc = lines.where("key <> '' or shift is not null").groupBy("doc_id", "key", "word", "shift").agg(F.countDistinct(F.when(F.col("edge"), F.col("page_num"))).alias("on"), F.avg(F.col("edge").cast("int")).alias("at_edge"))
    in_doc = in_doc.where(f"on > 0 and at_edge >= {DOC_EDGE}")
    by_key = (
        lines.where("key <> ''").groupBy("key").agg(F.countDistinct(F.when(F.col("edge"), F.col("doc_id"))).alias("docs"), F.avg(F.col("edge").cast("int")).alias("share"))
    ).where(f"docs >= {EDGE_DOCS} and share >= {EDGE_SHARE}")
    by_word = (
        lines.where("word <> '' and length(word) >= 3").groupBy("word")
        .agg(F.countDistinct(F.when(F.col("edge"), F.col("doc_id"))).alias("w_docs"), F.avg(F.col("edge").cast("int")).alias("w_share"), F.countDistinct("key").alias("rests"))
    ).where(f"w_docs >= {EDGE_DOCS} and w_share >= {EDGE_SHARE} and rests >= 3")
    marked = (
        in_doc.join(n_pages, "doc_id")
        .join(by_key.select("key", F.lit(True).alias("known")), "key", "left")
        .join(by_word.select("word", F.lit(True).alias("publisher")), "word", "left")
        .withColumn("again", F.col("on") >= F.greatest(F.lit(2), F.col("pages") * DOC_SHARE))
    )
    kept = F.struct("key", F.coalesce("publisher", F.lit(False)).alias("publisher"))
    return marked.groupBy("doc_id").agg(
        F.collect_set(F.when((F.col("key") != "") & (F.col("again") | F.col("known") | F.col("publisher")), kept)).alias("keys"),
        F.collect_set(F.when(F.col("shift").isNotNull() & (F.col("again") | (F.col("pages") < 3)), F.col("shift"))).alias("shifts"),
    )


def near(a: str, b: str) -> bool:
    """Equal but for one wrong character in eight."""
    if a == b:
        return True
    most = max(len(a), len(b)) // 8
    if not most or abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


def classify(lines: list[str], first_page: bool, page: int, keys: list[tuple[str, bool]], shifts: set[int]) -> dict[int, str]:
    """line index -> ``header`` or ``page_no``; the title that opens the text on the first page is neither."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    head, foot = full[:ZONE], full[-ZONE:]
    out: dict[int, str] = {}
    numbered = False
    for side in (head, foot[::-1]):
        open_ = True
        titles = []
        for i in side:
            if not open_ or i in out:
                break
            line = lines[i].strip()
            number, key = page_number(line), line_key(line)
            if number is not None and not numbered and (number - page in shifts or not line.isdigit()):
                out[i] = "page_no"
                numbered = True
            elif _VERSION.match(key) or len(key) < 40 and _NOTICE.search(key) and not re.search(r"[。，,;；]", key):
                out[i] = "header"
            else:
                hit = [p for k, p in keys if near(k, key)] if not re.search(r"[。；;，]$", key) and not _HEADING.match(line) else []
                side_no = _SIDE_NO.search(line) and not re.search(r"[。，,]", key)
                if hit or (side_no and any(key.startswith(k[:8]) for k, _ in keys)):
                    out[i] = "header"
                    if side is head and not any(hit) and not side_no:
                        titles.append(i)
                else:
                    open_ = False
        if side is head and first_page and titles:
            del out[titles[-1]]
    return out


# ---------------------------------------------------------------- vocabulary


class Trie:
    """Words with counts; ``within`` intersects it with the Levenshtein automaton of a word."""

    def __init__(self, counts: dict[str, int]):
        self.root: dict = {}
        self.back: dict = {}
        for word, n in counts.items():
            for root, letters in ((self.root, word), (self.back, word[::-1])):
                node = root
                for ch in letters:
                    node = node.setdefault(ch, {})
                node[""] = n

    def within(self, word: str, most: int) -> list[tuple[str, int, int]]:
        """Every (word, distance, count) of the trie at most ``most`` edits away.  With one edit one half of the word is
        untouched: the search starts behind it, from the front or from the back."""
        if most != 1 or len(word) < 2:
            return self._search(self.root, "", word, most)
        half = len(word) // 2
        found: dict[str, tuple[int, int]] = {}
        for root, fixed, rest, way in ((self.root, word[:half], word[half:], 1), (self.back, word[half:][::-1], word[:half][::-1], -1)):
            node: dict | None = root
            for ch in fixed:
                node = node.get(ch) if node is not None else None
            for other, d, n in self._search(node, fixed, rest, 1) if node is not None else ():
                found[other[::way]] = min((d, n), found.get(other[::way], (d, n)))
        return [(w, d, n) for w, (d, n) in found.items()]

    def _search(self, root: dict, start: str, word: str, most: int) -> list[tuple[str, int, int]]:
        """The words below ``root``, which ``start`` leads to.  A state of the automaton
        is the row of distances to the prefixes of the word, cut at ``most`` + 1; a step depends on the row
        and on where the character stands in the word only, so steps are kept."""
        out: list[tuple[str, int, int]] = []
        n, cap = len(word), most + 1
        places = {ch: tuple(word[i] == ch for i in range(n)) for ch in word}
        nowhere = (False,) * n
        steps: dict[tuple, tuple | None] = {}
        stack = [(start, root, tuple(min(i, cap) for i in range(n + 1)))]
        while stack:
            prefix, node, row = stack.pop()
            if row[n] <= most and "" in node:
                out.append((prefix, row[n], node[""]))
            # with no edit left only the characters that the word itself has next can follow
            spent = min(row) == most
            for ch in {word[i] for i in range(n) if row[i] == most} if spent else node:
                child = node.get(ch)
                if child is None or ch == "":
                    continue
                at = places.get(ch, nowhere)
                now = steps.get((row, at), 0)
                if now == 0:
                    new = [min(row[0] + 1, cap)]
                    for i in range(n):
                        new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (not at[i]), cap))
                    now = steps[row, at] = tuple(new) if min(new) <= most else None
                if now is not None:
                    stack.append((prefix + ch, child, now))
        return out


def running(lines: list[str], marked: dict[int, str]) -> list[int]:
    """Indices of the lines of running text, in order."""
    return [i for i, x in enumerate(lines) if x.strip() and i not in marked and not x.strip().isdigit()]


def joins_next(line: str, following: str) -> bool:
    """Whether a word of letters is cut at the end of the line and goes on in the next line of running text."""
    line, following = line.rstrip(), following.lstrip()
    if not _CUT.search(line) or not re.match(r"[a-z†]", following):
        return False
    return bool(re.search(r"(?:^|[\s(\"'“‘/-])[A-Za-z†'’]+(?:[-‐‑][A-Za-z†'’]+)*[-‐‑]$", line))


class Stream:
    """The running text of a page with the neighbouring ends: tokens and Chinese characters with their lines."""

    def __init__(self, lines: list[str], marked: dict[int, str], before: str, after: str):
        self.words: list[tuple[str, list[int]]] = []  # a token and the line of each of its characters
        self.han: list[tuple[str, int, int]] = []  # a character, its line and its place in the line
        self.cuts: list[int] = []
        body = [(-1, before)] * bool(before) + [(i, lines[i]) for i in running(lines, marked)] + [(-2, after)] * bool(after)
        carry: tuple[str, list[int]] | None = None
        for k, (at, line) in enumerate(body):
            text = line.strip()
            following = body[k + 1][1] if k + 1 < len(body) else ""
            cut = joins_next(text, following)
            if cut and at >= 0:
                self.cuts.append(at)
            for m in _TOKEN.finditer(text[:-1] if cut else text):
                token = (m.group(), [at] * len(m.group()))
                if carry and m.start() == 0:
                    token = (carry[0] + token[0], carry[1] + token[1])
                if cut and m.end() == len(text) - 1:
                    carry = token
                else:
                    self.words.append(token)
                    carry = None if m.start() == 0 or carry is None else carry
            if not cut:
                carry = None
            self.han += [(c, at, place) for c, place in _flat(line)]


_LETTERS, _NUMBERS = re.compile(r"[A-Za-z†][A-Za-z0-9†-]*"), re.compile(rf"[{_NUM_CN}两]+|[0-9][0-9.,:]*")


def _flat(line: str) -> list[tuple[str, int]]:
    """The line without white space, a word of letters as A and a number as 9; each character with its place in the line."""
    flat = [(c, i) for i, c in enumerate(line) if not c.isspace()]
    for pattern, sign in ((_LETTERS, "A"), (_NUMBERS, "9")):
        text = "".join([c for c, _ in flat])
        if not pattern.search(text):
            continue
        out, end = [], 0
        for m in pattern.finditer(text):
            out += [*flat[end : m.start()], (sign, flat[m.start()][1])]
            end = m.end()
        flat = out + flat[end:]
    return flat


def _han_grams(stream: Stream) -> list[str]:
    """Stretches of GRAM characters with two Chinese ones at least."""
    text = "".join([c for c, _, _ in stream.han])
    han = ["㐀" <= c <= "鿿" for c in text]
    return [text[i : i + GRAM] for i in range(len(text) - GRAM + 1) if sum(han[i : i + GRAM]) >= 2]


def _shape(token: str) -> str:
    """A token of digits and letters with 9 for every digit; empty for other tokens."""
    return re.sub("[0-9]", "9", token) if re.search("[0-9]", token) and re.search("[^0-9]", token) else ""


def _streams(pdf: pd.DataFrame) -> Iterator[tuple]:
    for row in pdf.itertuples(index=False):
        marked = dict(zip((int(x) for x in row.marked_at), row.marked_as))
        lines = row.text.split("\n")
        yield row, lines, marked, Stream(lines, marked, row.before or "", row.after or "")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts = {(sort, clean): Counter() for sort in "wsbh" for clean in (True, False)}
        for row, _, _, stream in _streams(pdf):
            clean = bool(row.clean)
            own = [w.casefold() for w, _ in stream.words]
            counts["w", clean].update(own)
            counts["s", clean].update([re.sub("[0-9]", "9", w) for w, _ in stream.words if not w.isalpha()])
            counts["b", clean].update([f"{a} {b}" for a, b in zip(own, own[1:])])
            counts["h", clean].update(_han_grams(stream))
        rows = [(sort, entry, n, n * clean) for (sort, clean), some in counts.items() for entry, n in some.items()]
        yield pd.DataFrame(rows, columns=["sort", "entry", "n", "clean"])


def vocabulary(pages: DataFrame) -> DataFrame:
    """sort (w: word, s: shape of a token with digits, b: two neighbours, h: stretch of Chinese), entry, n: sightings in
    all running text, clean: those on digital pages, which have no misreadings.  Nothing is left out."""
    return staged(pages.mapInPandas(_count, "sort string, entry string, n long, clean long").groupBy("sort", "entry").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean")), "counts")


# ---------------------------------------------------------------- wrong characters


def edit(right: str, wrong: str) -> tuple[int, str, str]:
    """Where two words part, and what stands there in each, without what they share at both ends."""
    a, most = 0, min(len(right), len(wrong))
    while a < most and right[a] == wrong[a]:
        a += 1
    b = 0
    while b < most - a and right[-1 - b] == wrong[-1 - b]:
        b += 1
    return a, right[a : len(right) - b], wrong[a : len(wrong) - b]


def _match(asked: pd.DataFrame, vocabulary: pd.DataFrame) -> pd.DataFrame:
    trie = Trie(dict(zip(vocabulary.entry, vocabulary.n)))
    rows = []
    for sort, entry, n, clean in zip(asked.sort, asked.entry, asked.n, asked.clean):
        for other, d, k in trie.within(entry, 2 if sort == "w" and len(entry) >= 4 and not clean else 1):
            if other == entry or k < RATIO * n:
                continue
            place, right, wrong = edit(other, entry)
            if sort == "h" and not ("㐀" <= right <= "鿿" and "㐀" <= wrong <= "鿿"):
                continue
            rows.append((sort, entry, n, clean, other, k, d, place, right, wrong))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _CANDIDATES.split(", ")])


_CANDIDATES = "sort string, entry string, n long, clean long, other string, other_n long, d int, place int, right string, wrong string"


def candidates(counts: DataFrame) -> DataFrame:
    """Of every entry that could be wrong all frequent entries within the distance: the Levenshtein automata of all entries
    meet the trie of the frequent ones.  The trie is cut into blocks of BLOCK entries at most and the
    entries are dealt out, so a task holds one block and at most about BLOCK entries; each entry meets every block."""
    words = counts.where("sort <> 'b' and length(entry) >= 2")
    top = words.groupBy("sort").agg(F.max("n").alias("top"))
    frequent = words.where(f"n >= {SEEN}")
    asked = words.join(F.broadcast(top), "sort").where(f"n * {RATIO} <= top and not entry rlike '^[0-9]+$'").drop("top")
    sizes = {sort: (len_, ask) for sort, len_, ask in frequent.groupBy("sort").agg(F.count("*").alias("f")).join(asked.groupBy("sort").agg(F.count("*").alias("a")), "sort").collect()}
    parallel = counts.sparkSession.sparkContext.defaultParallelism
    blocks, salts = F.lit(1), F.lit(1)
    for sort, (f, a) in sizes.items():  # three sorts
        blocks = F.when(F.col("sort") == sort, F.lit(-(-f // BLOCK))).otherwise(blocks)
        salts = F.when(F.col("sort") == sort, F.lit(max(-(-a // BLOCK), min(parallel, -(-a // 500))))).otherwise(salts)
    left = asked.withColumn("salt", F.pmod(F.xxhash64("entry", F.lit(1)), salts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    right = frequent.select("sort", "entry", "n").withColumn("block", F.pmod(F.xxhash64("entry"), blocks).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))))
    keys = ["sort", "block", "salt"]
    right = right.toDF(*right.columns)  # columns of their own: both sides come from one table
    return staged(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_match, _CANDIDATES), "candidates")


def confusions(found: DataFrame) -> DataFrame:
    """sort, right, wrong, cases, strong: characters that the scanner takes for each other, learned from the corpus.

    A misreading comes in many unrelated words and stretches and never on a digital page; a genuine wording with another
    character in one place comes in few, or on digital pages too.  Each unattested entry counts for the edit that
    explains most.  ``strong`` edits have CASES entries and hardly any attested one, or are known look-alikes."""
    by = ["sort", "right", "wrong"]
    seen = found.groupBy(*by).agg(F.countDistinct(F.when(F.col("clean") == 0, F.col("entry"))).alias("open"), F.countDistinct(F.when(F.col("clean") > 0, F.col("entry"))).alias("attested"))
    best = F.max_by(F.struct("right", "wrong"), F.struct(F.col("open") / (F.col("attested") + 1), "other_n", "right", "wrong"))
    cases = found.where("clean = 0").join(seen, by).groupBy("sort", "entry").agg(best.alias("e")).groupBy("sort", F.col("e.right").alias("right"), F.col("e.wrong").alias("wrong")).agg(F.count("*").alias("cases"))
    rival = F.max("cases").over(Window.partitionBy("sort", "wrong"))
    pairs = {(a, b) for x, y in LOOKALIKE for a, b in ((x, y), (y, x))}
    known = (F.col("sort") != "h") & F.concat_ws("\n", "right", "wrong").isin(sorted(f"{a}\n{b}" for a, b in pairs))
    rows = cases.join(seen, by).withColumn("rival", rival).where(f"attested * {CASES_EACH} <= cases and cases * {CASES_EACH} >= rival")
    return staged(rows.select(*by, "cases", "attested", (known | (F.col("cases") >= CASES)).alias("strong")), "confusions")


def accepted(found: DataFrame, learned: DataFrame) -> DataFrame:
    """The candidates that can stand for an entry, with ``level``: 2 for a strong edit; 1 for another edit of a rare
    entry, for which the surroundings must speak more clearly.  Shapes need a letter known to be read for a digit."""
    digit = learned.where("sort = 'w' and strong and right rlike '^[0-9]$'").groupBy(F.col("wrong").alias("low")).agg(F.max_by("right", F.struct("cases", "right")).alias("digit"))
    shapes = found.where("sort = 's' and clean = 0 and right = '9' and length(wrong) = 1").withColumn("low", F.lower("wrong")).join(digit, "low").withColumn("level", F.lit(2)).withColumn("cases", F.lit(0))
    others = found.where("sort <> 's' and clean = 0").join(learned, ["sort", "right", "wrong"], "left").withColumn("digit", F.lit(None).cast("string"))
    weak = F.when(F.col("sort") == "h", F.expr(f"cases >= 3 and attested = 0 and other_n >= {WEAK_RATIO} * n")).otherwise(F.expr("length(entry) >= 5 and not entry rlike '[^a-z]'")) & (F.col("n") <= SEEN // 2)
    level = F.when(F.coalesce("strong", F.lit(False)), 2).when(weak, 1)
    names = ["sort", "entry", "n", "other", "other_n", "d", "place", "right", "wrong", "digit", "level", "cases"]
    return staged(others.withColumn("level", level).where("level is not null").select(names).unionByName(shapes.select(names)), "accepted")


_MARKS = "uid string, doc_id string, num int, line int, place int, kind string, token string, entry string, before string, after string, offset int"


def marks(rows: DataFrame, wrong_chars: set[str]) -> DataFrame:
    """Everything on a page that a verdict can fall on: furniture and cut words (final), words (w) and shapes (s) with
    their neighbours, and Chinese characters that scanners are known to write (h) with the GRAM - 1 characters on both sides."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for r, _, marked, stream in _streams(pdf):
                ids = (r.uid, r.doc_id, r.num)
                out += [(*ids, i, -1, kind, "", "", "", "", 0) for i, kind in marked.items()]
                out += [(*ids, i, -1, "hyphen", "", "", "", "", 0) for i in stream.cuts]
                low = [w.casefold() for w, _ in stream.words]
                for k, (token, at) in enumerate(stream.words):
                    if at[0] == -2 or len(token) < 2 or token.isdigit() or not any(x >= 0 for x in at):
                        continue
                    line = next(x for x in at if x >= 0)
                    sides = (low[k - 1] if k else "", low[k + 1] if k + 1 < len(low) else "")
                    # a token over the end of a line: place is the number of its characters on the first line
                    first = sum(x == at[0] for x in at) if at[0] >= 0 and at[-1] != at[0] else 0
                    out.append((*ids, line, first, "w", token, low[k], *sides, at[-1] if first and at[-1] >= 0 else -1))
                    if _shape(token):
                        out.append((*ids, line, first, "s", token, _shape(token), *sides, at[-1] if first and at[-1] >= 0 else -1))
                text = "".join(c for c, _, _ in stream.han)
                for p, (ch, line, place) in enumerate(stream.han):
                    if line >= 0 and ch in wrong_chars:
                        lo = max(0, p - GRAM + 1)
                        out.append((*ids, line, place, "h", ch, text[lo : p + GRAM], "", "", p - lo))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _MARKS.split(", ")])
            yield frame.astype({"num": "Int32"})

    return staged(rows.mapInPandas(find, _MARKS), "marks")


def _han_verdicts(seen: DataFrame, counts: DataFrame, fit: DataFrame) -> DataFrame:
    """entry (surroundings), offset, right: of each distinct surroundings of a suspicious character.  It stays if one of the
    stretches over it stands on a digital page."""
    some = seen.where("kind = 'h'").select("entry", "offset").distinct()
    at = F.expr(f"sequence(greatest(0, offset - {GRAM - 1}), least(offset, length(entry) - {GRAM}))")
    grams = some.where(f"length(entry) >= {GRAM}").select("entry", "offset", F.explode(at).alias("i")).select("entry", "offset", F.substring("entry", F.col("i") + 1, F.lit(GRAM)).alias("gram"), (F.col("offset") - F.col("i")).alias("place"))
    attested = counts.where("sort = 'h' and clean > 0").select(F.col("entry").alias("gram"), F.lit(1).alias("attested"))
    fit = fit.where("sort = 'h'").select(F.col("entry").alias("gram"), "place", "right", "level", "cases", F.when(F.col("other_n") >= 10 * F.greatest(F.lit(SEEN), F.col("n") * WEAK_RATIO), 2).otherwise(1).alias("votes"))
    wide = grams.join(attested, "gram", "left").join(fit, ["gram", "place"], "left")
    per = wide.groupBy("entry", "offset").agg(F.max("attested").alias("attested"), F.collect_list(F.when(F.col("right").isNotNull(), F.struct("right", "level", "cases", "votes"))).alias("hits"), F.size(F.collect_set("place")).alias("stretches"))
    each = per.where("attested is null and size(hits) > 0").select("entry", "offset", "stretches", F.explode("hits").alias("x")).groupBy("entry", "offset", "stretches", "x.right").agg(F.max("x.level").alias("level"), F.max("x.cases").alias("cases"), F.sum("x.votes").alias("votes"))
    good = each.where("level = 2 or votes >= least(2, stretches)")
    return good.groupBy("entry", "offset").agg(F.max_by("right", F.struct("level", "cases", "votes", "right")).alias("right"))


def _word_verdicts(seen: DataFrame, counts: DataFrame, fit: DataFrame) -> DataFrame:
    """entry, before, after, right: of each distinct word with its neighbours, the candidate that the neighbours want most."""
    fit = fit.where("sort = 'w'").select("entry", "other", "d", "level", "cases")
    asked = seen.where("kind = 'w'").select("entry", "before", "after").distinct().join(fit, "entry")
    near = lambda role, a, b: F.struct(F.lit(role).alias("role"), F.concat_ws(" ", a, b).alias("pair"))
    pairs = F.explode(F.array(near("l", "before", "other"), near("r", "other", "after"), near("m", "before", "entry"), near("m", "entry", "after")))
    keys = ["entry", "before", "after", "other", "d", "level", "cases"]
    known = counts.where("sort = 'b'").select(F.col("entry").alias("pair"), F.col("n").alias("times"))
    times = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("times"))), F.lit(0))
    got = asked.withColumn("x", pairs).select(*keys, "x.role", "x.pair").join(known, "pair", "left").groupBy(*keys).agg(times("l").alias("l"), times("r").alias("r"), times("m").alias("mine"))
    strange = F.col("entry").rlike("[^a-z]")
    enough = F.when(F.col("level") == 2, F.col("l") + F.col("r") >= F.when(strange, 1).otherwise(3)).otherwise((F.col("l") >= 3) & (F.col("r") >= 3))
    good = got.where(enough & (F.col("l") + F.col("r") >= 5 * F.col("mine")))
    return good.groupBy("entry", "before", "after").agg(F.max_by("other", F.struct("level", (F.col("l") + F.col("r")) / F.col("d"), "cases", "other")).alias("right"))


def readings(rows: DataFrame, counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks, fixes) of ``rows``, by the vocabulary of ``counted``.  fixes: uid, doc_id, num, line, place, sort (w, h), wrong, right."""
    counts = vocabulary(counted)
    found = candidates(counts)
    learned = confusions(found)
    fit = accepted(found, learned)
    # at most as many as there are Chinese characters
    wrong_chars = {r.wrong for r in fit.where("sort = 'h'").select("wrong").distinct().toLocalIterator()}
    seen = marks(rows, wrong_chars)
    ids = ["uid", "doc_id", "num", "line", "place"]
    han = seen.where("kind = 'h'").join(_han_verdicts(seen, counts, fit), ["entry", "offset"]).select(*ids, F.lit("h").alias("sort"), F.col("token").alias("wrong"), "right")
    words = seen.where("kind = 'w'").join(_word_verdicts(seen, counts, fit), ["entry", "before", "after"]).select(*ids, "offset", "token", F.col("entry").alias("low"), "right")
    shapes = fit.where("sort = 's'").groupBy("entry").agg(F.max_by(F.struct("place", "digit"), F.struct("other_n", "other")).alias("e")).select("entry", F.col("e.place").alias("at"), "e.digit")
    numbers = seen.where("kind = 's'").join(shapes, "entry").select(*ids, "offset", "token", F.lower("token").alias("low"), F.expr("overlay(token placing digit from at + 1 for 1)").alias("right"))
    # where the two part decides on the line of a token that goes over the end of a line
    part = F.expr("coalesce(array_min(filter(sequence(1, length(low)), i -> substring(low, i, 1) <> substring(right, i, 1))), 1)")
    line = F.when((F.col("place") > 0) & (F.col("offset") >= 0) & (part > F.col("place")), F.col("offset")).otherwise(F.col("line"))
    latin = words.unionByName(numbers.join(words.select("uid", "line", "token").distinct(), ["uid", "line", "token"], "left_anti"))
    latin = latin.withColumn("line", line).select(*ids, F.lit("w").alias("sort"), F.col("token").alias("wrong"), "right")
    return seen, han.unionByName(latin)


# ---------------------------------------------------------------- the jobs


def scanned(pages: DataFrame) -> DataFrame:
    """All pages, repeated rows once, with ``scan``: whether the document is scanned.  A document is digital if a page says so; if no page
    says anything, it is taken for a scan if its lines are as narrow as those of a scan."""
    width = F.array_max(F.transform(F.split("text", "\n"), lambda x: F.length(x) + F.length(F.regexp_replace(x, rf"[^{_HAN}，。、；：]", ""))))
    once = pages.select("doc_id", F.col("page_num").cast("int").alias("page_num"), "text", F.lower(F.element_at("metadata", "ocr")).alias("ocr")).where("text is not null and doc_id is not null and page_num is not null").distinct()
    says = once.groupBy("doc_id").agg(F.max((F.col("ocr") == "true").cast("int")).alias("yes"), F.max((F.col("ocr") == "false").cast("int")).alias("no"), F.max(width).alias("widest"))
    scan = F.expr("coalesce(no, 0) = 0 and (yes = 1 or widest <= 84)")
    return once.drop("ocr").join(says.select("doc_id", scan.alias("scan")), "doc_id")


def _spread(pages: DataFrame) -> DataFrame:
    """Few bytes, long work: a stated number of partitions keeps pages from being put together into one task."""
    return pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "page_num")


def prepared(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scanned pages with their furniture (marked_at, marked_as) and the last running line before and the first after the page.
    The digital pages come beside them: they have none of it, and count for the vocabulary; then the furniture of each document."""
    pages = staged(_spread(scanned(pages)), "pages")
    scans, digital = pages.where("scan").drop("scan"), pages.where("not scan").drop("scan")
    first = Window.partitionBy("doc_id")
    kept = staged(furniture(scans), "furniture")
    rows = scans.withColumn("first_page", F.col("page_num") == F.min("page_num").over(first)).join(kept, "doc_id", "left")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                lines = r.text.split("\n")
                keys = [(k["key"], k["publisher"]) for k in r.keys] if r.keys is not None else []
                marked = classify(lines, r.first_page, r.page_num, keys, {int(s) for s in r.shifts} if r.shifts is not None else set())
                body = running(lines, marked)
                out.append((r.doc_id, r.page_num, r.text, list(marked), list(marked.values()), lines[body[0]] if body else None, lines[body[-1]] if body else None))
            yield pd.DataFrame(out, columns=["doc_id", "page_num", "text", "marked_at", "marked_as", "opens", "ends"])

    marked = rows.mapInPandas(mark, "doc_id string, page_num int, text string, marked_at array<int>, marked_as array<string>, opens string, ends string")
    order = Window.partitionBy("doc_id").orderBy("page_num", "text")
    none = F.lit(None).cast("string")
    clean = digital.withColumns({"marked_at": F.array().cast("array<int>"), "marked_as": F.array().cast("array<string>"), "before": none, "after": none})
    return staged(_spread(marked.withColumn("before", F.lag("ends").over(order)).withColumn("after", F.lead("opens").over(order)).drop("opens", "ends")), "prepared"), clean, kept


def _with_uid(rows: DataFrame, num: str) -> DataFrame:
    """Rows whose key can come with several texts get an own key."""
    return rows.withColumn("num", F.col(num).cast("int")).withColumn("uid", F.md5(F.concat_ws("\n", "doc_id", "num", "text")))


def noisy_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_num, line_no (from 1), kind: header, page_no, hyphen or misread.

    Null texts, pages without key and digital documents have no cases; empty pages have none; repeated
    rows count once; pages with one key but different texts are taken one after the other; an empty
    table gives an empty result.
    """
    rows, clean, _ = prepared(pages)
    seen, fixes = readings(_with_uid(rows, "page_num"), _counted(rows, clean))
    lines = seen.where("kind not in ('w', 's', 'h')").select("doc_id", "num", "line", "kind")
    lines = lines.unionByName(fixes.select("doc_id", "num", "line", F.lit("misread").alias("kind")))
    return lines.select("doc_id", F.col("num").alias("page_num"), (F.col("line") + 1).alias("line_no"), "kind").distinct()


def _counted(rows: DataFrame, clean: DataFrame) -> DataFrame:
    return rows.withColumn("clean", F.lit(False)).unionByName(clean.withColumn("clean", F.lit(True)))


def _of_text(fixes: DataFrame) -> DataFrame:
    return fixes.groupBy("uid").agg(F.collect_list(F.struct("line", "place", "sort", "wrong", "right")).alias("fixes"))


def _by_line(fixes) -> tuple[dict[int, list[tuple[str, str]]], list[tuple[int, int, str, str]]]:
    """Wrong tokens of each line, and wrong Chinese characters as (line, place in it, wrong, right)."""
    words: dict[int, list[tuple[str, str]]] = {}
    han = []
    for f in fixes if fixes is not None else []:
        if f["sort"] == "h":
            han.append((f["line"], f["place"], f["wrong"], f["right"]))
        else:
            words.setdefault(f["line"], []).append((f["wrong"], f["right"]))
    return words, han


def repaired(pages: DataFrame) -> DataFrame:
    """doc_id, page_num, clean: the running text of every scanned page in paragraphs.  A word or sentence
    that goes on over the page's end is completed on the page where it begins."""
    rows, clean, _ = prepared(pages)
    keyed = _with_uid(rows, "page_num")
    _, fixes = readings(keyed, _counted(rows, clean))

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                marked = dict(zip((int(x) for x in r.marked_at), r.marked_as))
                out.append((r.doc_id, r.page_num, reflow(r.text.split("\n"), marked, *_by_line(r.fixes), r.before or "", r.after or "")))
            yield pd.DataFrame(out, columns=["doc_id", "page_num", "clean"])

    return keyed.join(_of_text(fixes), "uid", "left").mapInPandas(repair, "doc_id string, page_num int, clean string")


def split_known(raw: str, known: list[tuple[int, str]], keys: list[str], shifts: set[int]) -> list[tuple[int, str, bool]]:
    """(page, text, whether the page is known) of a whole document.  Its text follows the known pages as far
    as it is the same; behind that a page break lies in every run of lines that look like furniture."""
    raw = re.sub(r"\r\n?", "\n", raw)
    out: list[tuple[int, str, bool]] = []
    rest: str | None = raw
    for page, text in known:
        text = re.sub(r"\r\n?", "\n", text)
        if rest.startswith(text + "\n"):
            out.append((page, text, True))
            rest = rest[len(text) + 1 :]
        else:
            if text.startswith(rest):
                out.append((page, rest, True))
                rest = None
            break
    if not rest:
        return out
    page = out[-1][0] + 1 if out else 1
    part: list[str] = []

    def furniture_like(line: str) -> bool:
        number, key = page_number(line), line_key(line)
        if number is not None:
            return not line.strip().isdigit() or bool({number - page, number - page - 1} & shifts)
        return bool(_VERSION.match(key) or len(key) < 40 and _NOTICE.search(key) and not re.search(r"[。，,;；]", key) or any(near(k, key) for k in keys))

    lines = rest.replace("\f", "\n").split("\n")
    i = 0
    while i < len(lines):
        if not lines[i].strip() or not furniture_like(lines[i]):
            part.append(lines[i])
            i += 1
            continue
        run = [i]
        for j in range(i + 1, len(lines)):
            if lines[j].strip():
                if not furniture_like(lines[j]):
                    break
                run.append(j)
        end = run[-1] + 1
        if any(x.strip() for x in part) and any(x.strip() for x in lines[end:]):
            # a number says whether it is the foot of this page or the head of the next; else what is too much for the head goes to the foot
            at = run[max(0, len(run) - ZONE)]
            for j in run:
                number = page_number(lines[j])
                if number is not None and number - page in shifts:
                    at = j + 1
                elif number is not None and number - page - 1 in shifts:
                    at = min(at, j)
            out.append((page, "\n".join(part + lines[i:at]), False))
            page, part = page + 1, lines[at:end]
        else:
            part += lines[i:end]
        i = end
    return [*out, (page, "\n".join(part), False)]


def repaired_documents(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, doc_version, clean: the running text of every version of every scanned document in paragraphs, also over the ends of pages.

    Null and blank texts give no row, repeated rows one.  Pages, furniture and vocabulary come from ``pages`` (the newest version);
    what an outdated version has beyond them is split by its own furniture, and counts for the vocabulary as well.  A document
    without pages is a scan if it is a PDF or a picture and its lines are narrow.
    """
    rows, clean, kept = prepared(pages)
    says = scanned(pages).select("doc_id", "scan").distinct()
    known = pages.where("doc_id is not null and page_num is not null").select("doc_id", F.struct(F.col("page_num").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text")).alias("p")).distinct()
    known = known.groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("known"))
    whole = docs.where("doc_id is not null and trim(raw_text) <> ''").select("doc_id", F.col("doc_version").cast("int").alias("doc_version"), "file_type", "raw_text").distinct()
    lone = F.lower("file_type").isin("pdf", "jpg", "jpeg", "png", "tif", "tiff", "bmp") & (F.array_max(F.transform(F.split("raw_text", "\r\n?|\n"), lambda x: F.length(x) + F.length(F.regexp_replace(x, rf"[^{_HAN}，。、；：]", "")))) <= 84)
    whole = whole.join(says, "doc_id", "left").where(F.coalesce("scan", lone)).drop("scan", "file_type").distinct()
    whole = whole.join(known, "doc_id", "left").join(kept, "doc_id", "left").withColumn("text_key", F.concat_ws(":", "doc_id", "doc_version", F.xxhash64("raw_text")))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                parts = split_known(r.raw_text, [(p["page"], p["text"]) for p in r.known] if r.known is not None else [], [k["key"] for k in r.keys] if r.keys is not None else [], {int(x) for x in r.shifts} if r.shifts is not None else set())
                out += [(r.text_key, r.doc_id, r.doc_version, k, page, text, known) for k, (page, text, known) in enumerate(parts)]
            frame = pd.DataFrame(out, columns=["text_key", "doc_id", "doc_version", "k", "page_num", "text", "known"])
            yield frame.astype({"doc_version": "Int32"})

    parts = staged(whole.mapInPandas(split, "text_key string, doc_id string, doc_version int, k int, page_num int, text string, known boolean"), "parts")
    strange = parts.where("not known").select("text_key").distinct()
    own = furniture(parts.join(strange, "text_key").select(F.col("text_key").alias("doc_id"), "page_num", "text"))
    own = own.select(F.col("doc_id").alias("text_key"), F.col("keys").alias("own_keys"), F.col("shifts").alias("own_shifts"))
    texts = parts.groupBy("text_key", "doc_id", "doc_version").agg(F.sort_array(F.collect_list(F.struct("k", "page_num", "text", "known"))).alias("parts")).join(kept, "doc_id", "left").join(own, "text_key", "left")

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                keys = [(k["key"], k["publisher"]) for some in (r.keys, r.own_keys) if some is not None for k in some]
                shifts = {int(x) for some in (r.shifts, r.own_shifts) if some is not None for x in some}
                text, rest = [], []
                first = min(p["page_num"] for p in r.parts)
                for p in r.parts:
                    lines = p["text"].split("\n")
                    marked = classify(lines, p["page_num"] == first, p["page_num"], keys, shifts)
                    left = [x for i, x in enumerate(lines) if i not in marked]
                    text += left
                    rest += [] if p["known"] else left
                out.append((r.doc_id, r.doc_version, "\n".join(text), "\n".join(rest)))
            yield pd.DataFrame(out, columns=["doc_id", "doc_version", "text", "rest"]).astype({"doc_version": "Int32"})

    bodies = staged(texts.mapInPandas(body, "doc_id string, doc_version int, text string, rest string"), "bodies")
    none = F.lit(None).cast("string")
    more = bodies.where("rest <> ''").select("doc_id", F.lit(0).alias("page_num"), F.col("rest").alias("text")).distinct()
    more = more.withColumns({"marked_at": F.array().cast("array<int>"), "marked_as": F.array().cast("array<string>"), "before": none, "after": none})
    targets = _with_uid(bodies.drop("rest").withColumns({"marked_at": F.array().cast("array<int>"), "marked_as": F.array().cast("array<string>"), "before": none, "after": none}), "doc_version")
    _, fixes = readings(targets, _counted(rows.unionByName(more), clean))

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                out.append((r.doc_id, r.doc_version, reflow(r.text.split("\n"), {}, *_by_line(r.fixes), "", "")))
            yield pd.DataFrame(out, columns=["doc_id", "doc_version", "clean"]).astype({"doc_version": "Int32"})

    # few bytes, long work: a stated number keeps the documents from being put together into one task
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return targets.join(_of_text(fixes), "uid", "left").repartition(n, "uid").mapInPandas(repair, "doc_id string, doc_version int, clean string")


def reflow(lines: list[str], marked: dict[int, str], words: dict[int, list[tuple[str, str]]], han: list[tuple[int, int, str, str]], before: str, after: str) -> str:
    body = running(lines, marked)
    fixed: dict[int, str] = {}
    swapped: dict[int, dict[int, str]] = {}
    for line, place, _, right in han:
        swapped.setdefault(line, {})[place] = right
    for i in body:
        text = "".join(swapped[i].get(k, c) for k, c in enumerate(lines[i])) if i in swapped else lines[i]
        fixed[i] = re.sub(r"[ \t]+", " ", text.strip())
    swaps = list(dict.fromkeys(pair for i in body for pair in words.get(i, [])))
    wide = max((len(lines[i].strip()) for i in body), default=0)
    out, part = [], ""
    if body and joins_next(before, lines[body[0]]):
        fixed[body[0]] = re.sub(r"^[A-Za-z†'’]+", "", fixed[body[0]])
    for k, i in enumerate(body):
        text = fixed[i]
        following = lines[body[k + 1]] if k + 1 < len(body) else after
        if joins_next(text, following):
            text = text[:-1]
            tail = re.match(r"\s*([A-Za-z†'’]+)", following)
            if k + 1 == len(body) and tail:
                text += tail.group(1)
            part += text
            continue
        part += text
        ends = bool(re.search(r"[。！？.!?:：]$", text)) and len(lines[i].strip()) < 0.9 * wide
        if _HEADING.match(text) and len(text) < 0.6 * wide or ends or _STARTS.match(following.strip()) or (k + 1 < len(body) and body[k + 1] > i + 1 and re.search(r"[。！？.!?]$", text)):
            out.append(part)
            part = ""
        elif re.search(r"[A-Za-z0-9,;.)]$", text) and re.match(r"\s*[A-Za-z0-9(]", following):
            part += " "
    out.append(part)
    clean = "\n".join(p for p in out if p.strip())
    for wrong, right in swaps:
        clean = re.sub(rf"(?<![A-Za-z0-9]){re.escape(wrong)}(?![A-Za-z0-9])", right.capitalize() if wrong[:1].isupper() else right, clean)
    return clean
