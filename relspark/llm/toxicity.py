r"""Toxicity: a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel of two words counts the letter triples they share in order, gaps allowed: a triple that spans n letters
weighs DECAY ** (n - 3), up to a span of SPAN, and the kernel is normalised (a cosine of weighted triple counts, so it is
positive definite).  Letters that are inserted or dropped widen gaps and lower it little.  Words, or starts of words, mark toxic training texts: they are chosen one by one, each for the texts that
those before it lack, by log odds.  Landmarks are these, copies of them with letters inserted, doubled or dropped, and the
clean words most like them.
K(landmarks)^(-1/2) maps kernel values to Nystrom features, on which a linear SVM with squared hinge loss is trained to
tell marking words and their copies from words of clean texts.  As the kernel is an inner product over triples, the
trained function of a word is one sum over its triples.

A sentence or text has the margin of its worst word, but not less than a floor (``WordScorer.least``), below which words
need not be computed: a bound that takes a word's triples for distinct tells.  A logistic fit (Platt) of labelled texts'
margins, each by a model of the other folds, gives scores in 0..1.

Words are runs without white space, lower-cased, of which letters are kept (so i.d.i.o.t is idiot); what stands between
signs counts as words too (you,idiot), and three or more single letters in a row are one word (i d i o t).

Training uses at most ``PER_CLASS`` labelled documents of each class (by hash of the id); word counts come from these too.
Labels are never inputs of a score.  Null and empty texts score like texts without any word.  Documents with a null id
are scored and not held out.  Repeated rows get equal scores; repeated labels count as toxic if any is.  Without labels
of both classes, or without words that mark one, every score is 0.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, give_back, mix, table, word_batches

PER_CLASS = 4000
CANDIDATES, ODDS, TEXTS = 600, 1.5, 3  # marking words to choose from; their log odds and texts at least
CHANCE = 1e-5  # of taking a word as surely marking that is not
STEMS = (5, 6, 7, 8)  # letters of a start of a word, with the mark of the start
MARKED, LIKE, COMMON = 64, 1500, 500  # words that mark toxic texts; clean words most like them, and most frequent ones
LANDMARKS = 320
SPAN, DECAY = 7, 0.75
COPIES = 60  # changed copies of each marking word
LONGEST = 24  # longer words are seen as windows of this length, half overlapping
LEAST_MARGIN, LEAST_LIKE = -0.5, 0.5  # the floor: this margin, or that of a word so much like what marks
FOLDS = 3
_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LETTERS = re.compile(r"[^\W\d_]+")
_BITS = 20


def forms(word: str) -> list[str]:
    """A word's letters, and the parts of three or more letters between its signs, with the marks of start and end."""
    parts = _LETTERS.findall(word.lower())
    whole = "".join(parts)
    return [f"^{w}$" for w in dict.fromkeys([whole, *(p for p in parts if len(p) > 2)]) if len(w) > 2]


def windows(word: str) -> list[str]:
    """A word with its marks, in parts if it is long."""
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _grid(words: list[str]) -> np.ndarray:
    """Code points, a column for each word; 0 below its end."""
    out = np.zeros((max(map(len, words), default=0), len(words)), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    who = np.repeat(np.arange(len(words)), size)
    out[np.arange(len(flat)) - (np.cumsum(size) - size)[who], who] = flat
    return out


def _hashed(grid: np.ndarray):
    """(weight, hashes by place and word) of each kind of gap; a triple that reaches below a word's end has some hash as well."""
    c = grid.astype(np.uint64)
    x, y, z = mix(c * _A + _B), mix(c * _B + _C), mix(c * _C + _A)
    n = len(grid)
    for a, b in _GAPS:
        if b < n:
            yield DECAY ** (b - 2), b, x[: n - b] + y[a : n - b + a] + z[b:]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, triple hash, weight) of the distinct gapped triples of words, whose weights add up to length 1."""
    grid = _grid(words)
    who, what, how = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0)]
    for weight, b, h in _hashed(grid):
        place, word = np.nonzero(grid[b:])
        who.append(word), what.append(h[place, word]), how.append(np.full(len(word), weight))
    who, what, how = np.concatenate(who), np.concatenate(what), np.concatenate(how)
    order = np.lexsort((what, who))
    who, what, how = who[order], what[order], how[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    who, what, how = who[new], what[new], np.add.reduceat(how, np.flatnonzero(new)) if len(how) else how
    return who, what, how / np.sqrt(np.maximum(np.bincount(who, how * how, len(words)), 1e-12))[who]


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Kernel values of each word of ``a`` with each of ``b``."""
    who, what, how = triples(b)
    every, at = np.unique(what, return_inverse=True)
    right = np.zeros((len(every), len(b)))
    right[at, who] = how
    out = np.zeros((len(a), len(b)))
    for k in range(0, len(a), 256):  # a row for each triple that is shared: so few words at a time
        who, what, how = triples(a[k : k + 256])
        at = np.minimum(np.searchsorted(every, what), max(0, len(every) - 1))
        same = every[at] == what if len(every) else np.zeros(len(what), bool)
        who, at, how = who[same], at[same], how[same]
        if len(who):
            first = np.flatnonzero(np.diff(who, prepend=-1))
            out[k + who[first]] = np.add.reduceat(right[at] * how[:, None], first, axis=0)
    return out


def copies(word: str, rng: np.random.Generator, n: int) -> list[str]:
    """``word`` (without marks) with one or two letters inserted, or one doubled, or one dropped."""
    out = []
    for k in range(n):
        w = list(word)
        if k % 6 == 5 and len(w) > 5:
            del w[rng.integers(1, len(w))]
        elif k % 6 == 4:
            i = int(rng.integers(len(w)))
            w[i:i] = [w[i]] * int(rng.integers(1, 3))
        else:
            for _ in range(1 + k % 2):
                w.insert(int(rng.integers(1, len(w))), chr(97 + int(rng.integers(26))))
        out.append("".join(w))
    return out


class WordScorer:
    """A trained function of words: ``bias`` plus the sum of ``value`` over a word's normalised triples."""

    def __init__(self, keys: np.ndarray, value: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.value, self.bias = keys[order], value[order], bias
        self.least = max(LEAST_MARGIN, bias + LEAST_LIKE)
        self._first = None

    def __getstate__(self):
        return self.__dict__ | {"_first": None}

    def _looked_up(self, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``what``, their keys' numbers) of the triples that are keys."""
        top = (self.keys >> np.uint64(64 - _BITS)).astype(np.int64)
        if self._first is None:
            self._first = np.full(1 << _BITS, -1, np.int32)
            self._first[top[::-1]] = np.arange(len(top), dtype=np.int32)[::-1]
            self._most = int(np.bincount(top).max())
        at = self._first[(what >> np.uint64(64 - _BITS)).astype(np.int32)]
        hit = np.flatnonzero(at >= 0)
        at, what = at[hit], what[hit]
        same = self.keys[at] == what
        for k in range(1, self._most):  # keys that share their first bits stand side by side
            next_ = np.minimum(at + k, len(self.keys) - 1)
            other = ~same & (self.keys[next_] == what)
            at, same = np.where(other, next_, at), same | other
        return hit[same], at[same]

    def exact(self, words: list[str]) -> np.ndarray:
        who, what, how = triples(words)
        at = np.minimum(np.searchsorted(self.keys, what), len(self.keys) - 1)
        return self.bias + np.bincount(who, how * self.value[at] * (self.keys[at] == what), len(words))

    def above(self, words: list[str], least: float | None = None, step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, margins) of the words above the floor; all words have at most ``LONGEST`` letters."""
        least = self.least if least is None else least
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        lengths = np.arange(LONGEST + 1)
        # a word whose triples all differ is the shortest of its length: its bound is the largest
        norm = np.sqrt(sum((b - 1) * np.maximum(0, lengths - b) * DECAY ** (2 * (b - 2)) for b in range(2, SPAN)))
        ids, found = [], []
        for k in range(0, len(order), step):
            part = order[k : k + step]
            own = [words[i] for i in part.tolist()]
            total = np.zeros(len(own))
            for weight, _, h in _hashed(_grid(own)):
                hit, at = self._looked_up(h.ravel())
                total += np.bincount(hit % len(own), weight * self.value[at], len(own))
            bound = self.bias + np.maximum(total, 0) / np.maximum(norm[size[part]], 1e-12)
            near = np.flatnonzero(bound > least)
            if len(near):
                value = self.exact([own[i] for i in near.tolist()])
                ids.append(part[near[value > least]]), found.append(value[value > least])
        return (np.concatenate(ids), np.concatenate(found)) if ids else (np.zeros(0, np.int64), np.zeros(0))


def _is_letter() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


_LETTER: list[np.ndarray] = []


def _word_forms(names: list[bytes]) -> tuple[list[str], np.ndarray]:
    """All windows of all forms of many words, and the number of each one's word."""
    if not names:
        return [], np.zeros(0, np.int64)
    if not _LETTER:
        _LETTER.append(_is_letter())
    lower = b"\n".join(names).decode("utf-8", "replace").lower()
    code = np.frombuffer(lower.encode("utf-32-le", "replace"), np.uint32)
    letter, end = _LETTER[0][code], code == 10
    # the letters of each word, joined, by one pass over all
    out = ["^" + w + "$" for w in code[letter | end].tobytes().decode("utf-32-le").split("\n")]
    owner = np.arange(len(out))
    # words with more than one run of letters have further forms
    runs = letter.copy()
    runs[1:] &= ~letter[:-1]
    word = np.cumsum(end) - end
    several = np.flatnonzero(np.bincount(word[runs], minlength=len(out)) > 1)
    odd = set(several.tolist()) | set(np.flatnonzero(np.fromiter(map(len, out), np.int64, len(out)) > LONGEST).tolist())
    keep = np.fromiter((len(w) > 4 for w in out), bool, len(out))
    keep[list(odd)] = False
    more = [(x, k) for k in sorted(odd) for f in forms(names[k].decode("utf-8", "replace")) for x in windows(f)]
    at = np.flatnonzero(keep)
    return [out[k] for k in at.tolist()] + [x for x, _ in more], np.concatenate([owner[at], np.array([k for _, k in more], np.int64)])


def _spelled(buf: bytes, s: np.ndarray, e: np.ndarray, off: np.ndarray) -> list[tuple[int, str]]:
    """(text number, word) of each run of three or more words of one letter within a text."""
    a = np.frombuffer(buf, np.uint8)
    size, first = e - s, a[s]
    latin = lambda c: ((c | 32) >= 97) & ((c | 32) <= 122)
    alone = (size == 1) & latin(first)
    # with a sign after it, or of several bytes
    second = a[np.minimum(s + 1, len(a) - 1)]
    for i in np.flatnonzero((size > 1) & (size < 5) & ((first >= 0xC2) | latin(first) & ~latin(second) & ((second < 48) | (second > 57)))).tolist():
        w = buf[s[i] : e[i]].decode("utf-8", "replace")
        alone[i] = len(w) < 3 and w[0].isalpha() and not w[1:2].isalnum()
    starts = np.zeros(len(alone), bool)
    starts[off[:-1][off[:-1] < len(alone)]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], alone, [False]]).astype(np.int8)))
    out: list[tuple[int, str]] = []
    for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        cuts = [lo, *(lo + 1 + np.flatnonzero(starts[lo + 1 : hi])).tolist(), hi]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y - x > 2:
                word = "".join(buf[s[i] : e[i]].decode("utf-8", "replace")[0] for i in range(x, y)).lower()
                text = int(np.searchsorted(off, x, side="right")) - 1
                out.extend((text, w) for w in windows(f"^{word}$"))
    return out


def margins(texts: list[bytes | None], scorer: WordScorer) -> np.ndarray:
    """Each whole text's margin: that of its worst word, or the floor."""
    out = np.full(len(texts), scorer.least)
    for i, _, buf, h, s, e, off in word_batches(texts, 1 << 21):
        if not len(h):
            continue
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        words, owner = _word_forms([buf[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)])
        at, value = scorer.above(words)
        best = np.full(len(first), scorer.least)
        np.maximum.at(best, owner[at], value)
        tok = np.flatnonzero(best[inverse] > scorer.least)
        np.maximum.at(out, i + np.searchsorted(off, tok, side="right") - 1, best[inverse[tok]])
        if spelled := _spelled(buf, s, e, off):
            at, value = scorer.above([w for _, w in spelled])
            np.maximum.at(out, i + np.array([t for t, _ in spelled])[at], value)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0, steps: int = 60) -> np.ndarray:
    """Weights (with a bias last) of a linear SVM, squared hinge loss, the classes' weights made equal; Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y == 1, 1.0, -1.0)
    cost = c * len(y) * weight * np.where(y == 1, 0.5 / weight[y == 1].sum(), 0.5 / weight[y == 0].sum())
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        active = 1 - sign * (x @ w) > 0
        xa = x[active]
        new = np.linalg.solve(ridge + 2 * (xa * cost[active][:, None]).T @ xa, 2 * xa.T @ (cost[active] * sign[active]))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def fit_platt(f: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a f + b))), smoothed targets; ``share`` is how much class 1 weighs."""
    pos, neg = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y == 1, share / pos, (1 - share) / neg)
    ab = np.array([1.0, 0.0])
    z = np.stack([f, np.ones_like(f)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ z, -30, 30)))
        grad = z @ (weight * (p - target)) + 1e-4 * ab * [1, 0]
        hess = (z * (weight * p * (1 - p))) @ z.T + 1e-6 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(ab[0]), float(ab[1])


def _column(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


class Model:
    """A scorer of words (none without training) and Platt's line; picklable and small."""

    def __init__(self, scorer: WordScorer | None = None, a: float = 1.0, b: float = 0.0, marked=()):
        self.scorer, self.a, self.b, self.marked = scorer, a, b, list(marked)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.scorer is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.a * margins(texts, self.scorer) + self.b, -30, 30)))


def _with_stems(text: bytes | None) -> set[str]:
    own = set(_word_forms(list(set((text or b"").lower().split())))[0])
    return own | {w[:k] for w in own for k in STEMS if len(w) > k + 1 and w[0] == "^"}


def cover(docs: list[tuple[int, list[int]]], names: list[str], toxic: int, clean: int) -> list[tuple[int, int]]:
    """(candidate, toxic texts it adds) one by one: each has the highest number times log odds among texts not covered yet."""
    left, out = list(docs), []
    while len(out) < MARKED:
        t, c = Counter(), Counter()
        for y, own in left:
            (t if y else c).update(own)
        best = max(((t[k] * o, len(names[k]), names[k], k) for k in t if t[k] >= TEXTS and (o := _odds(t[k], c[k], toxic, clean, np.log)) > ODDS), default=None)
        if best is None:
            break
        out.append((best[3], t[best[3]]))
        left = [(y, own) for y, own in left if best[3] not in own]
    return out


def word_counts(sample: DataFrame) -> DataFrame:
    """(w, t0.., c0..): in how many toxic and other texts of each fold a form, or a start of one, occurs."""
    names = [f"{k}{f}" for k in "tc" for f in range(FOLDS)]

    def run(batches):
        for b in batches:
            seen = [Counter() for _ in names]
            for t, y, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                seen[(0 if y else FOLDS) + f].update(_with_stems(t))
            words = list(set().union(*seen))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)], names=["w", *names])

    rows = sample.select("text", "y", "fold").mapInArrow(run, "w string, " + ", ".join(f"{n} long" for n in names))
    return rows.groupBy("w").agg(*(F.sum(n).alias(n) for n in names))


def _odds(t, c, toxic, clean, log):
    return log(((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1)))


def _surely(t: int, c: int, toxic: int, clean: int) -> bool:
    """Whether log odds of ODDS would give so many toxic texts among t + c with a chance below CHANCE (Chernoff's bound)."""
    p = np.exp(ODDS) * toxic / (np.exp(ODDS) * toxic + clean)
    n, q = t + c, t / max(1, t + c)
    if t < TEXTS or q <= p:
        return False
    return n * (q * np.log(q / p) + (1 - q) * np.log(max(1 - q, 1e-300) / (1 - p))) > -np.log(CHANCE)


def fit_words(marked: list[tuple[str, float]], plain: list[tuple[str, float]]) -> WordScorer:
    """The trained function from (word with marks, weight) of words that mark toxic texts and of words of other texts."""
    rng = np.random.default_rng(11)
    words, y, weight = [], [], []
    taken = {w for w, _ in plain}
    for w, v in marked:
        word, stem = w.strip("^$"), not w.endswith("$")
        ends = ["".join(chr(97 + int(i)) for i in rng.integers(0, 26, int(rng.integers(0, 6)))) if stem else "" for _ in range(COPIES)]
        own = [w] + [f"^{x}{end}$"[:LONGEST] for x, end in zip([*[word] * (COPIES // 3 * stem), *copies(word, rng, COPIES)], ends, strict=False)]
        own = own[:1] + [x for x in dict.fromkeys(own[1:]) if x not in taken]
        words += own
        y += [1] * len(own)
        weight += [v / 2] + [v / 2 / max(1, len(own) - 1)] * (len(own) - 1)
    marks = len(words)
    words += [w for w, _ in plain]
    y, weight = np.array(y + [0] * len(plain)), np.array(weight + [v for _, v in plain])
    few = max(1, (LANDMARKS - len(marked)) // 2)
    chosen = dict.fromkeys([w for w, _ in marked] + words[1:marks : max(1, marks // few)] + [w for w, _ in plain[: LANDMARKS // 2]])
    landmarks = list(chosen)[:LANDMARKS]
    gram = kernel(landmarks, landmarks)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    w = fit_svm(kernel(words, landmarks) @ root, y, weight)
    beta = root @ w[:-1]
    who, what, how = triples(landmarks)
    keys, at = np.unique(what, return_inverse=True)
    return WordScorer(keys, np.bincount(at, how * beta[who]), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic); the caller has left out what is held out."""
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    labels = durable(labels.filter("y in (0, 1)"))
    share = (0.4 + (labels.agg(F.avg("y")).first()[0] or 0.0)) / 2  # between what is labelled and even odds: a missed toxic text costs more than a lost clean one
    by_hash = lambda y: labels.filter(F.col("y") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(per_class)
    picked = F.broadcast(by_hash(0).unionAll(by_hash(1)))  # at most 2 * per_class rows of two numbers
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    # the only pass over all documents; what follows reads this bounded sample
    sample = durable(_column(docs).join(picked, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y", fold))
    n = {(r.y, r.fold): r["count"] for r in sample.groupBy("y", "fold").count().collect()}
    total = lambda y, but=None: sum(v for (k, f), v in n.items() if k == y and f != but)
    if not total(0) or not total(1):
        return Model()
    seen = durable(word_counts(sample.repartition(max(1, min(64, (total(0) + total(1)) // 100)), "doc_id")))
    t, c = (sum((F.col(f"{k}{f}") for f in range(1, FOLDS)), F.col(f"{k}0")) for k in "tc")
    seen = seen.withColumns({"t": t, "c": c}).withColumn("odds", _odds(F.col("t"), F.col("c"), total(1), total(0), F.log))
    some = seen.filter((F.col("t") >= TEXTS) & (F.col("odds") > ODDS)).orderBy(F.desc(F.col("t") * F.col("odds")), "w").limit(CANDIDATES).collect()
    if not some:
        return Model()
    candidates = [r.w for r in some]
    number = {w: k for k, w in enumerate(candidates)}

    def incidence(batches):
        for b in batches:
            own = [sorted(number[w] for w in _with_stems(t) if w in number) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(own, pa.list_(pa.int32()))], names=["y", "fold", "own"])

    texts = [(r.y, r.fold, r.own) for r in sample.mapInArrow(incidence, "y int, fold int, own array<int>").filter("size(own) > 0").orderBy("fold", "y", "own").collect()]  # bounded: 2 * per_class rows

    def chosen(but: int | None) -> list[tuple[str, float]]:
        found = cover([(y, own) for y, f, own in texts if f != but], candidates, total(1, but), total(0, but)) if total(1, but) and total(0, but) else []
        own = {candidates[k]: 1 + float(np.log1p(n)) for k, n in found}
        # texts that have several marks leave some of them out: whole words that surely mark toxic texts come as well
        for r in some:
            t_, c_ = (sum(r[f"{k}{f}"] for f in range(FOLDS) if f != but) for k in "tc")
            if found and _surely(t_, c_, total(1, but), total(0, but)) and len(own) < MARKED and r.w.endswith("$") and not any(r.w.startswith(w) for w in own if not w.endswith("$")):
                own.setdefault(r.w, 1 + float(np.log1p(t_)))
        return list(own.items())

    marked = chosen(None)
    if not marked:
        return Model()
    names = [w for w, _ in marked]

    def likeness(batches):
        for b in batches:
            for i in range(0, len(b), 20_000):
                part = b.slice(i, 20_000)
                like = kernel(part.column(0).to_pylist(), names).max(1, initial=0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(like)], names=[*part.schema.names, "like"])

    clean = seen.filter("c >= 1 and odds < 0.5 and w like '%$'")
    kinds = ", ".join(f"{x} {k}" for x, k in clean.dtypes)
    like = clean.mapInArrow(likeness, f"{kinds}, like double").orderBy(F.desc("like"), F.desc("c"), "w").limit(LIKE).collect()
    often = clean.orderBy(F.desc("c"), "w").limit(COMMON).collect()
    plain = list({r.w: r for r in [*like, *often]}.values())

    def fitted(but: int | None) -> WordScorer | None:
        good, count = marked if but is None else chosen(but), lambda r: sum(r[f"c{f}"] for f in range(FOLDS) if f != but)
        rest = [(r.w, 1.0 + np.log1p(count(r))) for r in plain if count(r)]
        return fit_words(good, rest) if good and rest else None

    scorers = [fitted(None), *(fitted(f) for f in range(FOLDS))]
    if None in scorers:
        return Model()
    shared = docs.sparkSession.sparkContext.broadcast(scorers)  # some thousand triples each

    def run(batches):
        for b in batches:
            text, fold_ = b.column(1).to_pylist(), b.column(3).to_numpy()
            out = np.zeros(len(text))
            for f in range(FOLDS):
                at = np.flatnonzero(fold_ == f)
                out[at] = margins([text[i] for i in at.tolist()], shared.value[f + 1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out)], names=["doc_id", "y", "margin"])

    rows = sample.mapInArrow(run, "doc_id long, y int, margin double").toArrow()  # bounded: 2 * per_class rows
    order = np.lexsort((rows["margin"].to_numpy(), rows["doc_id"].to_numpy()))
    return Model(scorers[0], *fit_platt(rows["margin"].to_numpy()[order], rows["y"].to_numpy()[order], share), marked=names)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred short words and numbers

    def run(batches):
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])
            give_back()

    return _column(docs).mapInArrow(run, "doc_id long, score double")


def clean_documents(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is under ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score_of(s):
        import pandas as pd

        out = pd.Series(shared.value.score([None if t is None else bytes(t) for t in s]))
        give_back()
        return out

    return docs.filter(score_of(F.col("text").cast("string").cast("binary")) < limit)


def held_out(col: Column) -> Column:
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_from(spark: SparkSession, sf_dir: str) -> Model:
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), train_from(spark, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
