r"""LM scoring by subword lattices.

The pieces of an existing vocabulary span a lattice over each word: every segmentation counts, weighted by the product of
its pieces' weights, and a forward recursion in log space returns the word's marginal log probability.  Weights come from
the vocabulary file alone, whose scores fall with the rank: a piece of rank r weighs 1 / (r + 10), as words of a language
do by their ranks; nothing is trained or estimated anew.  A piece with the word mark starts a word, so that words and the
end of a text form a distribution: each text ends where the next piece is the end.

From the training texts the model learns words, as further edges of the lattice that span a whole word: a word seen c
times has the probability (c + V L) / (N + V), where L is the marginal over all segmentations into pieces, N counts all
training tokens and V the distinct ones (1, if there are none).  ``score`` is the log10 marginal of a text under this
model, ``lattice_score`` that under the vocabulary's pieces alone.

Words ``[^\x20\x09-\x0D]+``, A-Z lower-cased; the base score is an add-one word unigram.  Counting goes by chunks of
documents: each chunk gives its distinct words as 64-bit fingerprints with counts, and its documents as arrays of
chunk-local word numbers with each word's L.  One shuffle brings a word's entries together, which gives its count; another
takes counts back to their chunks.  So neither texts nor words nor (document, word) pairs are shuffled, and only N and V
reach the driver.

Null and empty texts have only the end.  Rows that repeat are scored one by one, and count again in training.  Rows with
a null doc_id are not held out.  With an empty training set, N and V are 0 and the base score of each token is log10(1).
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import _INV, _MULT, U, durable, give_back, mix, table, word_batches

VOCAB = public_tokenizers.path("piece_bpe_32k.model")
CHUNK = 8 << 20  # bytes of text: the larger, the fewer chunks a word is in
#: What a task of the two shuffles gets on average: entries of words, and chunks; so tasks grow in number, not in size.
TASK_ENTRIES, TASK_CHUNKS = 2_000_000, 2
LONG_WORD, WORDS = 64, 8_192  # code points of words that go one by one; words that go at once
MARK = 0x2581
_SLOTS = 1 << 20


@lru_cache(2)
def pieces(path: str) -> tuple[dict[str, float], dict[int, float], float]:
    """Log weights of the pieces, of the bytes (for characters without a piece), and of the end, normalised together."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = {sp.id_to_piece(i): 1 / (max(0.0, -sp.get_score(i)) + 10) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    last = 1 / (n + 10)
    total = sum(plain.values()) + 257 * last
    starts = sum(w for p, w in plain.items() if p[0] == "▁") + last  # what can follow a whole word
    return {p: math.log(w / total) for p, w in plain.items()}, dict.fromkeys(range(256), math.log(last / total)), math.log(last / starts)


class Lattice:
    """Marginal log probabilities of words under the pieces' weights (natural logs)."""

    def __init__(self, path: str):
        self.logp, self.bytes, self.end = pieces(path)
        self.most = max(map(len, self.logp))
        self.single = np.full(0x110000, np.nan)  # of characters, filled as they come
        names = [p for p in self.logp if len(p) > 1]
        size = np.array([len(p) for p in names])
        grid = np.zeros((self.most, len(names)), np.uint32)
        for k, p in enumerate(names):
            grid[: len(p), k] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        self.power, self.inverse = (np.array([pow(m, k, 1 << 64) for k in range(LONG_WORD + 2)], np.uint64) for m in (_MULT, _INV))
        key = self._sums(grid)[size, np.arange(len(names))] + size.astype(np.uint64)
        self.maybe = np.zeros(_SLOTS, bool)
        self.maybe[(key & U(_SLOTS - 1)).astype(np.int64)] = True
        order = np.argsort(key)
        self.key, self.value = key[order], np.array([self.logp[p] for p in names])[order]

    def _sums(self, codes: np.ndarray) -> np.ndarray:
        """Running sums, down the rows, of the characters' hashes times powers; row t covers t characters."""
        out = np.zeros((len(codes) + 1, codes.shape[1]), np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + U(77)) * self.power[: len(codes), None], axis=0, out=out[1:])
        return out

    def _singles(self, codes: np.ndarray) -> np.ndarray:
        out = self.single[codes]
        if np.isnan(out).any():
            for c in np.unique(codes[np.isnan(out)]).tolist():
                p = self.logp.get(chr(c))
                self.single[c] = p if p is not None else sum(self.bytes[b] for b in chr(c).encode("utf-8", "replace"))
            out = self.single[codes]
        return out

    def word(self, w: str) -> float:
        """One word by itself, whatever its length."""
        s = "▁" + w
        n, get = len(s), self.logp.get
        alone = self._singles(np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)).tolist()
        alpha = [0.0] + [-math.inf] * n
        for j in range(1, n + 1):
            terms = [alpha[j - 1] + alone[j - 1]]
            terms += [alpha[i] + p for i in range(max(0, j - self.most), j - 1) if (p := get(s[i:j])) is not None]
            top = max(terms)
            alpha[j] = top + math.log(sum(math.exp(x - top) for x in terms))
        return alpha[n]

    def words(self, names: list[bytes]) -> np.ndarray:
        """Many words at once: words of like length side by side, one step of the recursion for each of their places."""
        out = np.zeros(len(names))
        if not names:
            return out
        text = np.frombuffer(b"\n".join(names).decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        cut = np.flatnonzero(text == 10)
        start, stop = np.append(0, cut + 1), np.append(cut, len(text))
        size = stop - start
        order = np.argsort(size, kind="stable")
        short = int(np.searchsorted(size[order], LONG_WORD, side="right"))
        for k in order[short:].tolist():
            out[k] = self.word(names[k].decode("utf-8", "replace"))
        for at in range(0, short, WORDS):
            part = order[at : min(short, at + WORDS)]
            out[part] = self._together(text, start[part], size[part])
        return out

    def _together(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``size`` rises; the k-th word's place 0 is the word mark."""
        longest, n = int(size[-1]) + 1, len(size)
        codes = np.full((longest, n), MARK, np.uint32)
        if longest > 1:
            codes[1:] = text[np.minimum(start + np.arange(longest - 1)[:, None], len(text) - 1)]
        sums, alone = self._sums(codes), self._singles(codes)
        alpha, out = np.zeros((longest + 1, n)), np.zeros(n)
        for t in range(1, longest + 1):
            f = int(np.searchsorted(size, t - 1))  # words before it are shorter
            terms = [alpha[t - 1, f:] + alone[t - 1, f:]]
            for i in range(max(0, t - self.most), t - 1):
                h = (sums[t, f:] - sums[i, f:]) * self.inverse[i] + U(t - i)
                hit = np.flatnonzero(self.maybe[(h & U(_SLOTS - 1)).astype(np.int64)])
                if not len(hit):
                    continue
                at = np.minimum(np.searchsorted(self.key, h[hit]), len(self.key) - 1)
                same = self.key[at] == h[hit]
                if same.any():
                    term = np.full(n - f, -np.inf)
                    hit = hit[same]
                    term[hit] = alpha[i, f:][hit] + self.value[at[same]]
                    terms.append(term)
            if len(terms) > 1:
                every = np.stack(terms)
                top = every.max(0)
                alpha[t, f:] = top + np.log(np.exp(every - top).sum(0))
            else:
                alpha[t, f:] = terms[0]
            done = int(np.searchsorted(size, t - 1, side="right"))
            out[f:done] = alpha[t, f:done]
        return out


@lru_cache(1)
def lattice_of(path: str) -> Lattice:
    return Lattice(path)


def chunks(docs: DataFrame, held_out, path: str = VOCAB) -> DataFrame:
    """Rows of two kinds: (chunk, local, word, c) for a chunk's distinct words, and (chunk, blob, n_train) for its documents.

    ``word`` is a fingerprint; c counts it in the chunk's training documents (0: only others have it).  A blob packs doc
    ids, null marks, held-out marks, word offsets, local word numbers and the words' marginals.
    """

    def run(batches):
        task = TaskContext.get()
        part, seq = task.partitionId(), 0
        ids, texts, held, size = [], [], [], 0

        def flush():
            nonlocal seq, ids, texts, held, size
            if not texts:
                return
            hashes, lens, bufs, places = [], [], [], []
            flags = np.array(held, bool)
            for _, _, buf, h, s, e, off in word_batches(texts):
                lens.append(np.diff(off))
                hashes.append(h)
                u, at = np.unique(h, return_index=True)
                places.append((u, np.full(len(u), len(bufs)), s[at], e[at]))
                bufs.append(buf)
            texts = []
            u_all, at = np.unique(np.concatenate([x[0] for x in places]), return_index=True)
            where = [np.concatenate([x[k] for x in places])[at].tolist() for k in (1, 2, 3)]
            names = [bufs[k][a:b].lower() for k, a, b in zip(*where, strict=True)]
            del bufs, places, where
            marginal = lattice_of(path).words(names)
            del names
            h, lens = np.concatenate(hashes), np.concatenate(lens)
            local = np.searchsorted(u_all, h).astype(np.uint32)
            del h, hashes, at
            c = np.bincount(local[np.repeat(~flags, lens)], minlength=len(u_all))
            chunk = (part << 20) + seq
            seq += 1
            nulls = np.array([x is None for x in ids], np.uint8)
            doc = np.array([x or 0 for x in ids], np.int64)
            raw = np.int64(len(ids)).tobytes() + doc.tobytes() + nulls.tobytes() + flags.astype(np.uint8).tobytes() + lens.astype(np.int64).tobytes() + np.int64(len(local)).tobytes() + local.tobytes() + marginal.tobytes()
            blob = zstandard.ZstdCompressor(level=1).compress(raw)
            del raw, local, marginal, doc
            step = 100_000
            for k in range(0, len(u_all), step):
                m = len(u_all[k : k + step])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), pa.array(np.arange(k, k + m, dtype=np.int32)), pa.array(u_all[k : k + step].view(np.int64)), pa.array(c[k : k + step].astype(np.int64)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], names=names_)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([blob], pa.binary()), pa.array([int((~flags).sum())], pa.int64())], names=names_)
            ids, texts, held, size = [], [], [], 0
            del u_all, c, blob
            give_back()

        names_ = ["chunk", "local", "word", "c", "blob", "n_train"]
        for b in batches:
            for i in range(0, len(b), 256):
                for d, t, x in zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True):
                    ids.append(d), texts.append(t or b""), held.append(x)
                    size += len(texts[-1])
                    if size >= CHUNK:
                        yield from flush()
        yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    return rows.mapInArrow(run, "chunk long, local int, word long, c long, blob binary, n_train long")


def _unblob(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at = 8
    doc = np.frombuffer(raw, np.int64, n, at)
    at += 8 * n
    nulls, held = np.frombuffer(raw, np.uint8, n, at), np.frombuffer(raw, np.uint8, n, at + n)
    at += 2 * n
    lens = np.frombuffer(raw, np.int64, n, at)
    at += 8 * n
    words = int(np.frombuffer(raw, np.int64, 1, at)[0])
    return doc, nulls.astype(bool), held.astype(bool), lens, np.frombuffer(raw, np.uint32, words, at + 8), np.frombuffer(raw, np.float64, -1, at + 8 + 4 * words)


def score(docs: DataFrame, held_out, path: str = VOCAB) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score."""
    packed = durable(chunks(docs, held_out, path))
    entries = packed.filter("blob is null").select("chunk", "local", "word", "c")
    blobs = packed.filter("blob is not null").select("chunk", "blob", "n_train")
    n_entries, n_chunks, n_end = packed.agg(F.count("c"), F.count("n_train"), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle by word: each entry gets its word's count, and one of them stands for the word
    entries = entries.repartition(max(least, -(-n_entries // TASK_ENTRIES)), "word")
    by, place = Window.partitionBy("word"), F.struct("chunk", "local")
    entries = durable(entries.select("chunk", "local", F.sum("c").over(by).alias("c"), (F.min(place).over(by) == place).alias("first")))
    n, v = entries.filter("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v, known_end = n + n_end, v + (n_end > 0), int(n_end > 0)
    types, last = max(v, 1), pieces(path)[2]
    base_end = math.log10((n_end + 1) / (n + v + 1))
    end = math.log10((n_end + types * math.exp(last)) / (n + types))

    def finish(blob: pd.DataFrame, dic: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(len(dic), np.int64)
        c[dic.local.to_numpy()] = dic.c.to_numpy()
        base = np.log10((c + 1) / (n + v + 1))
        out = []
        for packed_ in blob.blob:
            doc, nulls, held, lens, local, marginal = _unblob(packed_)
            own = np.log10(np.maximum((c + types * np.exp(marginal)) / (n + types), 1e-300))
            far = (c == 0) & (marginal < -600)  # beyond what floats hold outside of logs
            own[far] = (marginal[far] + math.log(types / (n + types))) / math.log(10)
            rows = np.repeat(np.arange(len(doc)), lens)
            add = lambda x: np.bincount(rows, x[local], len(doc)) if len(local) else np.zeros(len(doc))  # noqa: B023, E731
            out.append(pd.DataFrame({
                "doc_id": pd.array(np.where(nulls, 0, doc), "Int64"), "held_out": held, "n_tokens": lens + 1, "n_known": add((c > 0).astype(float)).round().astype(np.int64) + known_end, "train_tokens": n,
                "base_score": add(base) + base_end, "score": add(own) + end, "lattice_score": (add(marginal) + last) / math.log(10),
            }))
            out[-1].loc[nulls, "doc_id"] = pd.NA
        return pd.concat(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    tasks = max(least, -(-n_chunks // TASK_CHUNKS))
    known = entries.select(F.col("chunk").alias("part"), "local", "c").repartition(tasks, "part")
    return blobs.repartition(tasks, "chunk").groupBy("chunk").cogroup(known.groupBy("part")).applyInPandas(finish, schema)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(table(spark, sf_dir, "documents"), held)


QUERIES = {"op9_lm": op9_lm}
ORACLE: dict[str, str] = {}
