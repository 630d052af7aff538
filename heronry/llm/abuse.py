"""Abusive, hateful or sexual content (problem 8): a bidirectional gated recurrent network with
attention pooling, trained in numpy.

A text becomes steps: a Chinese character, or a Latin word.  A step has a character input (the
character with its neighbour; the letter trigrams of a word) and a word input.  The network reads
overlapping windows of WIDTH steps at every STRIDE; a document's score is that of its worst window.

Labels are ratings of whole documents.  They are settled by majority; within a positive document
the sentence that the other ratings make most likely is taken for the cause (a start lexicon of
strong words counts as evidence), and documents where nothing can be the cause are left out: raters err.
The network is fitted on a bounded sample of rated documents (MAX_DOCS, MAX_WINDOWS); every document
is scored, whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.tables import code_state, exists, shared_dir

#: Rated documents and windows (in one phase) that the network is fitted on, at most.
MAX_DOCS, MAX_WINDOWS = 6000, 6000
WIDTH, STRIDE = 40, 20
SIZE, HIDDEN, CHARS, WORDS = 24, 24, 1 << 13, 1 << 13
EPOCHS, BATCH, RATE = 9, 96, 6e-3
#: Letters of a step; a longer word is several steps.
LETTERS = 24
THRESHOLD = 0.5

#: Characters of a rated document that the network is fitted on, at most; longer ones are scored, but teach nothing.
MAX_CHARS = 20_000

#: Strong words that start the search for the cause within a document.
LEXICON = (
    "傻逼 煞笔 傻b 脑残 智障 白痴 弱智 废物 畜生 人渣 蠢货 垃圾东西 狗东西 王八蛋 混蛋 贱人 婊子 去死 草泥马 操你 nmsl 尼玛 滚远点 滚蛋 臭不要脸 窝囊废 "
    "劣等 低贱 贼种 恶心的物种 砸了你 打断你 砍死 扇死 弄死 约炮 裸聊 做爱 自慰 奶子 脱光 无码 援交 "
    "idiot moron scumbag asshole bitch bastard fuck shit shithead cunt retard vermin subhuman nudes hookup tits horny"
).split()
_LEXICON = re.compile("|".join(rf"(?<![a-z]){re.escape(w)}(?![a-z])" if w.isascii() else re.escape(w) for w in LEXICON))

_CJK = "㐀-鿿豈-﫿"
_STEP = re.compile(rf"[{_CJK}]|[a-z*]+|[0-9]+|[^\sa-z0-9{_CJK}]")
_SENTENCE = re.compile(r"[^。！？!?\n；;]+?(?:[。！？!?\n；;]+|\.\s+|$)")
_LEET = str.maketrans("013457@$", "oieastas")


def plain(text: str) -> str:
    """One spelling for many: width, case, invisible characters, letters or characters set apart, digits for letters."""
    text = unicodedata.normalize("NFKC", text).casefold()
    text = re.sub(r"[​-‏‪-‮⁠-⁯﻿­̀-ͯ]", "", text)
    text = re.sub(rf"(?<=[{_CJK}])[ \t　*·•.\-_~|/]{{1,3}}(?=[{_CJK}])", "", text)
    text = re.sub(r"(?<![a-z0-9@$])[a-z0-9@$](?:[ .\-_*·][a-z0-9@$]){2,}(?![a-z0-9@$])", lambda m: re.sub(r"[ .\-_*·]", "", m.group()), text)
    return re.sub(r"(?<![a-z0-9@$*-])(?=[a-z@$0-9]*[a-z])(?:[a-z]+[0134573@$]+[a-z0-9@$]*|[013457@$][a-z]{2,}[a-z013457@$]*)(?![a-z0-9-])", lambda m: m.group().translate(_LEET) if sum(c.isdigit() for c in m.group()) <= 3 else m.group(), text)


def steps(text: str) -> list[str]:
    """Chinese characters, words, signs; a word of more than LETTERS letters is as many steps as it needs."""
    out = []
    for t in _STEP.findall(text):
        if t[0].isdigit():
            out.append("0")
        elif len(t) > LETTERS:
            out += [t[i : i + LETTERS] for i in range(0, len(t), LETTERS)]
        else:
            out.append(t)
    return out


@lru_cache(maxsize=1 << 17)
def _ids(token: str, nxt: str) -> tuple[int, list[int]]:
    """(word input, character inputs)."""
    if len(token) == 1:
        pair = token + (nxt if len(nxt) == 1 else "")
        return zlib.crc32(("w" + pair).encode("utf-8", "surrogatepass")) % WORDS, [zlib.crc32(token.encode("utf-8", "surrogatepass")) % CHARS]
    padded = f"<{token}>"
    return zlib.crc32(("w" + token).encode()) % WORDS, [zlib.crc32(padded[i : i + 3].encode()) % CHARS for i in range(len(padded) - 2)]


def spans(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over n steps; every stretch of STRIDE steps lies whole in one of them."""
    if n <= WIDTH:
        return [(0, n)] if n else []
    starts = list(range(0, n - WIDTH, STRIDE)) + [n - WIDTH]
    return [(a, a + WIDTH) for a in starts]


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s, k=0.1: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"chars": f(CHARS, SIZE), "words": f(WORDS, SIZE), "wa": f(2 * HIDDEN, HIDDEN, k=0.2), "va": f(HIDDEN, k=0.2), "wo": f(2 * HIDDEN, k=0.2), "bo": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": f(SIZE, 3 * HIDDEN, k=SIZE**-0.5), f"u{d}": f(HIDDEN, 3 * HIDDEN, k=HIDDEN**-0.5), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def embed(self, words: np.ndarray, chars: np.ndarray, owners: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The word input of each step and the mean of its character inputs.  ``chars`` lists the character inputs of one
        step after the other; ``owners`` are their numbers and the places of the steps."""
        counts, at = owners
        out = self.p["words"][words]
        if len(at):
            out.reshape(-1, SIZE)[at] += np.add.reduceat(self.p["chars"][chars], np.cumsum(counts) - counts) / counts[:, None].astype(out.dtype)
        return out

    def _gru(self, d: str, xw: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """xw: (steps, batch, 3H) inputs; the state stands still where the mask is 0."""
        u, h, n = self.p[f"u{d}"], np.zeros((xw.shape[1], HIDDEN), np.float32), xw.shape[0]
        out, trace = np.empty((n, xw.shape[1], HIDDEN), np.float32), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            g = h @ u
            z = 1 / (1 + np.exp(-(xw[t, :, :HIDDEN] + g[:, :HIDDEN])))
            r = 1 / (1 + np.exp(-(xw[t, :, HIDDEN : 2 * HIDDEN] + g[:, HIDDEN : 2 * HIDDEN])))
            c = np.tanh(xw[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = h + mask[t][:, None] * (1 - z) * (c - h)
            if keep:
                trace.append((t, h, z, r, c, g[:, 2 * HIDDEN :]))
            h = out[t] = new
        return out, trace

    def forward(self, x: np.ndarray | None, mask: np.ndarray, keep: bool = False, projected: tuple | None = None):
        """x: (steps, batch, SIZE), or ``projected`` inputs of both directions; gives the logits."""
        both, traces = [], []
        for k, d in enumerate("fb"):
            xw = projected[k] if projected else x @ self.p[f"w{d}"] + self.p[f"b{d}"]
            h, tr = self._gru(d, xw, mask, keep)
            both.append(h)
            traces.append(tr)
        h = np.concatenate(both, -1)
        a = np.tanh(h @ self.p["wa"])
        e = a @ self.p["va"] + (mask - 1) * 1e9
        e = np.exp(e - e.max(0))
        att = e / e.sum(0)
        pooled = (att[..., None] * h).sum(0)
        logit = pooled @ self.p["wo"] + self.p["bo"]
        return (logit, (traces, h, a, att, pooled)) if keep else logit

    def gradients(self, words, chars, owners, mask, y, weight):
        """Cross-entropy gradients by back-propagation through time; words and mask are (steps, batch)."""
        p, x = self.p, self.embed(words, chars, owners)
        logit, (traces, h, a, att, pooled) = self.forward(x, mask, keep=True)
        d_logit = ((1 / (1 + np.exp(-logit)) - y) * weight / len(y)).astype(np.float32)
        g = {"wo": pooled.T @ d_logit, "bo": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * p["wo"]
        d_att = (h * d_pool).sum(-1)
        d_e = att * (d_att - (att * d_att).sum(0))
        d_a = d_e[..., None] * p["va"] * (1 - a * a)
        g["va"] = (a * d_e[..., None]).sum((0, 1))
        g["wa"] = h.reshape(-1, 2 * HIDDEN).T @ d_a.reshape(-1, HIDDEN)
        d_h = att[..., None] * d_pool + d_a @ p["wa"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, du = p[f"u{d}"], np.zeros_like(p[f"u{d}"])
            d_xw, d_g = np.zeros((*x.shape[:2], 3 * HIDDEN), x.dtype), np.empty((x.shape[1], 3 * HIDDEN), x.dtype)
            back = np.zeros((x.shape[1], HIDDEN), x.dtype)
            for t, prev, z, r, c, gc in reversed(traces[k]):
                total = back + d_h[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                m = mask[t][:, None]
                open_ = total * m * (1 - z)
                d_c = open_ * (1 - c * c)
                d_xw[t, :, :HIDDEN] = d_g[:, :HIDDEN] = open_ * (prev - c) * z
                d_xw[t, :, HIDDEN : 2 * HIDDEN] = d_g[:, HIDDEN : 2 * HIDDEN] = d_c * gc * r * (1 - r)
                d_xw[t, :, 2 * HIDDEN :] = d_c
                d_g[:, 2 * HIDDEN :] = d_c * r
                du += prev.T @ d_g
                back = total - open_ + d_g @ u.T
            g[f"u{d}"], g[f"w{d}"], g[f"b{d}"] = du, x.reshape(-1, SIZE).T @ d_xw.reshape(-1, 3 * HIDDEN), d_xw.sum((0, 1))
            d_x += d_xw @ p[f"w{d}"].T
        g["words"] = _scatter(words.ravel(), d_x.reshape(-1, SIZE), WORDS)
        counts, at = owners
        g["chars"] = _scatter(chars, np.repeat(d_x.reshape(-1, SIZE)[at] / counts[:, None], counts, axis=0), CHARS)
        loss = float(np.mean(weight * (np.logaddexp(0, logit) - y * logit)))
        return loss, g


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(at, kind="stable")
    ids, first = np.unique(at[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[ids] = np.add.reduceat(rows[order], first, axis=0) if len(ids) else 0
    return out


def _arrays(windows: list[list[str]]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """words and mask, (steps, batch); the character inputs of all steps, and how many each step has and where it is."""
    n, size = max(map(len, windows)), len(windows)
    words, mask = np.zeros((n, size), np.int64), np.zeros((n, size), np.float32)
    chars: list[int] = []
    counts: list[int] = []
    for b, w in enumerate(windows):
        ids = [_ids(t, nxt) for t, nxt in zip(w, [*w[1:], ""])]
        words[: len(w), b] = [x for x, _ in ids]
        mask[: len(w), b] = 1
        for _, cs in ids:
            chars += cs
            counts.append(len(cs))
    at = np.concatenate([np.arange(len(w)) * size + b for b, w in enumerate(windows)])
    return words, np.array(chars, np.int64), (np.array(counts), at), mask


def _grams(tokens: list[str]) -> set[tuple]:
    """Pairs of words and triples of characters."""
    pairs = {(a, b) for a, b in zip(tokens, tokens[1:]) if len(a) > 1 or len(b) > 1}
    return pairs | {t for t in zip(tokens, tokens[1:], tokens[2:]) if all(len(x) == 1 for x in t)}


def causes(docs: list[tuple[str, float]]) -> list[tuple[list[str], list[tuple[int, int]], bool]]:
    """Rated documents (plain text, share of raters who object) as (steps, step spans of causes, whether
    the rest is clean).

    A sentence is a cause if it has a word of the lexicon, or if most of its pairs and triples are many
    times as frequent in documents that raters object to as in the others, and come in two of them.
    A document that is objected to without a cause is left out; causes that raters missed are kept out
    of the clean windows.
    """
    cut = []
    for t, y in docs:
        tokens, parts = steps(t), []
        for m in _SENTENCE.finditer(t):
            own = steps(m.group())
            if own:
                a = parts[-1][1] if parts else 0
                parts.append((a, a + len(own), _grams(own), bool(_LEXICON.search(m.group()))))
        cut.append((tokens, parts, y))
    n_pos, n_neg = Counter(), Counter()
    pos, neg = sum(y > 0.5 for _, _, y in cut), sum(y < 0.5 for _, _, y in cut)
    for _, parts, y in cut:
        (n_pos if y > 0.5 else n_neg).update(set().union(*[g for _, _, g, _ in parts]))
    ratio = 8 * (pos + 1) / (neg + 1)

    def telling(grams: set) -> bool:
        hits = sum(n_pos[g] >= 2 and n_pos[g] >= ratio * n_neg[g] for g in grams)
        return len(grams) >= 4 and hits >= 0.6 * len(grams)

    out = []
    for tokens, parts, y in cut:
        where = [(a, b) for a, b, g, has in parts if has or telling(g)]
        if y > 0.5 and not where:
            continue
        out.append((tokens, where, True))
    return out


def examples(rated: list[tuple[list[str], list, bool]], seed: int, limit: int) -> tuple[list[list[str]], list[list[str]]]:
    """Windows that hold most of a cause, shifted about (a third of ``limit`` at most), and windows without any
    (four times ``limit`` at most, from which the network picks)."""
    rng = np.random.default_rng(seed)
    good, bad = [], []
    for tokens, where, clean in rated:
        for a, b in where:
            for _ in range(6):
                length = int(rng.integers(min(WIDTH, max(6, b - a)), WIDTH + 1))
                lead = int(rng.integers(0, max(1, length - min(b - a, length) + 1)))
                start = max(0, a - lead)
                bad.append(tokens[start : start + length])
        for a, b in spans(len(tokens)) if clean else []:
            if all(b <= x or a >= y for x, y in where):
                good.append(tokens[a:b])
    bad = [bad[i] for i in rng.permutation(len(bad))[: limit // 3]]
    good = [good[i] for i in rng.permutation(len(good))[: 4 * limit]]
    return bad, good


def train(docs: list[tuple[str, float]], seed: int = 7, limit: int = MAX_WINDOWS, epochs: int = EPOCHS) -> Network:
    """Fit on rated documents (text, share of raters who object): first with clean windows taken at random, then
    with half of them replaced by those that the network found worst."""
    net, rng = Network(seed), np.random.default_rng(seed)
    bad, pool = examples(causes([(plain(t), r) for t, r in docs if t and t.strip() and r != 0.5]), seed, limit)
    if not bad or not pool:
        net.p["bo"][:] = -20.0  # nothing to learn from: nothing is found
        net.p["wo"][:] = 0.0
        return net
    room = limit - len(bad)
    m, v = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    for phase, rounds in enumerate((epochs // 2, epochs - epochs // 2)):
        good = pool[:room]
        if phase:
            worst = np.argsort(-np.array(Scorer(net).windows(pool)), kind="stable")[: room // 2]
            good = [pool[i] for i in worst] + pool[: room - len(worst)]
        windows, y = bad + good, np.array([1.0] * len(bad) + [0.0] * len(good), np.float32)
        weight = np.where(y > 0, np.minimum(8.0, (1 - y).sum() / y.sum()) ** 0.5, 1.0).astype(np.float32)
        total = rounds * (len(y) // BATCH + 1)
        for k in range(total):
            if k % (len(y) // BATCH + 1) == 0:
                order = rng.permutation(len(y))
            at = order[k % (len(y) // BATCH + 1) * BATCH :][:BATCH]
            if not len(at):
                continue
            words, chars, owners, mask = _arrays([_blur(windows[i], rng) for i in at])
            _, g = net.gradients(words, chars, owners, mask, y[at], weight[at])
            step += 1
            norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = RATE * (1 - (0.5 if not phase else 1.0) * k / total) * min(1.0, 5.0 / (norm + 1e-9)) * (0.6 if phase else 1.0)
            for name, x in g.items():
                m[name] = 0.9 * m[name] + 0.1 * x
                v[name] = 0.999 * v[name] + 0.001 * x * x
                net.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-7)
    return net


def _blur(window: list[str], rng: np.random.Generator) -> list[str]:
    """Now and then a step is dropped or a letter lost, so that no single spelling is relied on."""
    out = []
    for t, x in zip(window, rng.random(len(window)).tolist()):
        if x < 0.04:
            continue
        if x < 0.08 and len(t) > 3 and t.isalpha() and t.isascii():
            k = int(rng.integers(1, len(t)))
            t = t[:k] + "*" + t[k + 1 :]
        out.append(t)
    return out or window


class Scorer:
    """Scores texts in chunks of windows; the inputs of a token are computed once and kept."""

    CHUNK, KEPT = 4096, 200_000

    def __init__(self, net: Network):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[tuple[str, str], int] = {}
        self.table = [np.zeros((0, 3 * HIDDEN), np.float32)] * 2

    def _tokens(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.rows) > self.KEPT:
            self._reset()
        new: list[tuple[str, str]] = []
        out = []
        for tokens in texts:
            ids = np.empty(len(tokens), np.int64)
            for i, t in enumerate(tokens):
                nxt = tokens[i + 1] if len(t) == 1 and i + 1 < len(tokens) and len(tokens[i + 1]) == 1 else ""
                key = (t, nxt)
                at = self.rows.get(key)
                if at is None:
                    at = self.rows[key] = len(self.rows)
                    new.append(key)
                ids[i] = at
            out.append(ids)
        for k in range(0, len(new), 20_000):
            pairs = [_ids(*x) for x in new[k : k + 20_000]]
            counts = np.array([len(c) for _, c in pairs])
            x = self.net.embed(np.array([w for w, _ in pairs]), np.array([c for _, cs in pairs for c in cs]), (counts, np.arange(len(pairs)))).astype(np.float32)
            self.table = [np.concatenate([t, x @ self.net.p[f"w{d}"] + self.net.p[f"b{d}"]]).astype(np.float32) for t, d in zip(self.table, "fb")]
        return out

    def windows(self, parts: list[list[str]]) -> list[float]:
        """The score of each window of steps."""
        best = np.zeros(len(parts))
        for k in range(0, len(parts), 2000):
            ids = self._tokens(parts[k : k + 2000])
            self._worst(best[k : k + 2000], ids)
        return best.tolist()

    def scores(self, texts: list[str]) -> list[float]:
        """The score of the worst window of each text; a text without any letter scores 0."""
        read = [steps(plain(t)) if t else [] for t in texts]
        best = np.zeros(len(texts))
        self._worst(best, self._tokens([x if any(t[0].isalpha() for t in x) else [] for x in read]))
        return best.tolist()

    def _worst(self, best: np.ndarray, ids: list[np.ndarray]) -> None:
        windows = sorted((b - a, k, a) for k, x in enumerate(ids) for a, b in spans(len(x)))
        for c in range(0, len(windows), self.CHUNK):
            part = windows[c : c + self.CHUNK]
            n = part[-1][0]
            at = np.zeros((n, len(part)), np.int64)
            mask = np.zeros((n, len(part)), np.float32)
            for j, (length, k, a) in enumerate(part):
                at[:length, j] = ids[k][a : a + length]
                mask[:length, j] = 1
            logit = self.net.forward(None, mask, projected=(self.table[0][at], self.table[1][at]))
            np.maximum.at(best, [k for _, k, _ in part], 1 / (1 + np.exp(-logit.astype(np.float64))))


def ratings(labels: DataFrame, id_col: str = "doc_id", kinds: tuple[str, ...] = ("is_abusive", "is_hateful", "is_sexual")) -> DataFrame:
    """id, objects: the share of raters who object to a document in any kind.  A rating whose kinds are all null does not count."""
    any_ = F.greatest(*[F.col(k).cast("double") for k in kinds])
    once = labels.select(F.col(id_col).alias("id"), "rater", any_.alias("y")).where("id is not null and y is not null").distinct()
    return once.groupBy("id").agg(F.avg("y").alias("objects"))


def fit(docs: DataFrame, id_col: str, text_col: str, rated: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Network:
    """A network from at most ``max_docs`` rated documents, those first in the order of a hash of their id, of at most
    ``max_chars`` characters each: that bounds what the driver holds.  Nothing else is left out, and unrated documents teach nothing."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    rows = known.join(rated, "id").orderBy(F.xxhash64("id"), "id").limit(max_docs).collect()
    return train([(r.text, r.objects) for r in rows])


def save(net: Network, spark: SparkSession, path: str) -> None:
    """One row for each array of the network; about two megabytes in all."""
    rows = [(k, list(map(int, x.shape)), bytearray(x.astype("<f4").tobytes())) for k, x in sorted(net.p.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Network:
    net = Network()
    net.p = {r.name: np.frombuffer(bytes(r.data), "<f4").reshape(r["shape"]).copy() for r in spark.read.parquet(path).collect()}
    return net


def fitted(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame) -> Network:
    """The network of these documents and ratings: fitted once and kept in the shared folder, where later queries find it.
    What tells two inputs apart is the content of the ratings and the ids and lengths of the documents."""
    spark = docs.sparkSession
    rows = labels.select(F.xxhash64(*sorted(labels.columns)).alias("h"))
    texts = docs.select(F.xxhash64(id_col, F.length(text_col)).alias("h"))
    ink = "-".join(f"{r[0]}.{r[1] or 0:x}" for r in (df.agg(F.count("*"), F.bit_xor("h")).first() for df in (rows, texts)))
    path = f"{shared_dir(spark)}/abuse-{code_state('llm')}-{ink}"
    if not exists(spark, f"{path}/_SUCCESS"):
        save(fit(docs, id_col, text_col, ratings(labels)), spark, path)
    return load(spark, path)


def score(docs: DataFrame, id_col: str, text_col: str, net: Network) -> DataFrame:
    """docs with ``score``: 0 for null, empty and blank texts; equal texts score alike; other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = Network()
        net.p = shared.value
        scorer = Scorer(net)
        for texts in batches:
            out: list[float] = []
            values = texts.tolist()
            for k in range(0, len(values), 1000):
                out += scorer.scores(values[k : k + 1000])
            yield pd.Series(out, dtype="float64")

    return docs.withColumn("score", F.round(F.pandas_udf(run, "double")(F.col(text_col)), 6))
