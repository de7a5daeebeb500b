"""Toxicity of deobfuscated text by a noisy-channel model.

A writer's word passes a channel that may swap letters for look-alikes (``1d10t``,
``$tup1d``), repeat them (``stuuupid``), or put signs or blanks between them
(``i.d.i.o.t``, ``i d i o t``). A token that shows traces of it becomes a lattice
of the characters each sign may stand for; Viterbi search finds the word that is
likeliest under the channel and a language model of character trigrams, whose
counts are gathered from all texts of the table. Tokens without traces have one
path and stay.

Restored words are looked up in a lexicon of words and word beginnings with the
log-odds of label 1 (what long tokens hold is looked up there, but words are learnt from
tokens of up to ``LONGEST`` signs, from parts of longer ones between signs, and from
spaced letters), learnt from at most ``SAMPLE`` labelled texts a class; the
score is a logistic function of a text's strongest and summed evidence, fitted
on the same sample.

Only features that hold in at least ``SUPPORT`` toxic sample texts enter, and at
most ``LEXICON`` of them (the strongest), so what is broadcast is bounded.

Defined results: null and empty texts have no evidence and get the score of
that; without labels of both classes every score is the share of label 1 (0
without labels); of several labels of an id the largest counts, of several texts
of an id the smallest is learnt from, none of over
``quality_knn.LONGEST_LEARNT`` bytes. Equally likely words go to the one found
first, in the order of ``LOOKS``. Repeated rows
each get a row. Texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, small_batches
from .quality_knn import labelled_sample

SAMPLE, SUPPORT, LEXICON = 4000, 3, 20_000
#: Lengths of word beginnings that may be features.
STEMS = (4, 5, 6)
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "€": "e"}
BETWEEN = ".-_*~'`^·"
#: Log-probabilities of the channel.
SWAP, DROP, TWICE, LOSE = -2.0, -1.0, -1.5, -9.0
#: Longer tokens are read in overlapping parts, in which words may begin anywhere.
LONGEST = 40
#: Letters of a word in such parts while no lexicon is known.
REACH = 12
#: Paths that are followed at a time; a path that is cut was less likely than so many others up to there.
BEAM = 24

_SIGNS = re.escape("".join(LOOKS) + BETWEEN)
_TOKEN = re.compile(r"\S+")
_TRACE = re.compile(rf"[^\W\d_][{_SIGNS}]|[{_SIGNS}][^\W\d_]|([^\W\d_])\1")
_REPEAT = re.compile(r"([^\W\d_])\1")
_MANY = re.compile(r"(.)\1{3,}", re.DOTALL)
_MUTE = re.compile(rf"[^\w{re.escape(''.join(LOOKS))}]|[_·]")
_JOINS = re.compile(rf"[{re.escape(BETWEEN)}/\\,;:&=?#]+")
_EDGE = " .,;:?!\"()[]{}<>&%#*…«»„“”"
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_WORD = re.compile(r"[^\W\d_]+")


def symbol(c: str) -> int:
    """Letters of the model's alphabet: a-z, the Latin-1 letters, one for others; 0 is the edge."""
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    if 0xDF <= o <= 0xFF:
        return o - 0xDF + 27
    return 60 if c.isalpha() else 0


SYMBOLS = 61


class LanguageModel:
    """Character trigrams with backing-off to bigrams and single characters, by interpolation."""

    def __init__(self, counts: dict[int, int]):
        tri = np.zeros(SYMBOLS**3)
        for k, n in counts.items():
            tri[k] += n
        tri = tri.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        bi, uni = tri.sum(0), tri.sum((0, 1)) + 1.0
        p1 = uni / uni.sum()
        p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
        p3 = (tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20)
        self.log = np.log(p3).astype(np.float32)

    def __call__(self, a: int, b: int, c: int) -> float:
        return float(self.log[a, b, c])


def word_trigrams(words: Counter) -> Counter:
    out: Counter = Counter()
    for w, n in words.items():
        a = b = 0
        for c in (*map(symbol, w), 0):
            out[(a * SYMBOLS + b) * SYMBOLS + c] += n
            a, b = b, c
    return out


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place what it may stand for, with the channel's log-probability."""
    out, k = [], 0
    while k < len(token):
        c, e = token[k], k + 1
        while e < len(token) and token[e] == c:
            e += 1
        opts: list[tuple[str, float]] = []
        if c.isalpha():
            opts.append((c, 0.0 if e - k == 1 else TWICE))
            if e - k >= 2:
                opts.append((c + c, 0.0 if e - k == 2 else TWICE))
        else:
            opts += [(x, SWAP * (e - k)) for x in LOOKS.get(c, "")]
            opts += [(x + x, SWAP * 2) for x in LOOKS.get(c, "") if e - k >= 2]
            if c in BETWEEN or c == " ":
                opts.append(("", DROP))
            elif k == 0 or e == len(token):  # a sign at the edge may be no letter at all
                opts.append(("", LOSE))
        out.append(opts or [("", DROP)])
        k = e
    return out


def decode(token: str, lm: LanguageModel) -> str:
    """The likeliest word behind the token."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in lattice(token):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (p, said) in best.items():
            for x, cost in options:
                q, i, j = p + cost, a, b
                for c in x:
                    s = symbol(c)
                    q += lm(i, j, s)
                    i, j = j, s
                if (i, j) not in after or q > after[i, j][0]:
                    after[i, j] = (q, said + x)
        best = dict(sorted(after.items(), key=lambda r: -r[1][0])[:BEAM])
    return max(((p + lm(a, b, 0), said) for (a, b), (p, said) in best.items()), default=(0, ""))[1]


class Reader:
    """Features of tokens; what it remembers is bounded."""

    def __init__(self, lm: LanguageModel):
        self.lm = lm
        self.restore = lru_cache(100_000)(lambda t: decode(t, lm))

    def words(self, token: str) -> list[str]:
        """A lower-cased token's words: as they are, and restored."""
        bare = token.strip(_EDGE)
        if bare.isalpha() and not _REPEAT.search(bare):
            return [bare] if len(token) - len(bare) < 2 or not _TRACE.search(token) else [bare, *self._word(token)]
        found = [bare] if bare.isalpha() else _WORD.findall(bare)
        for t in (token, bare) if token != bare else (bare,):
            if _TRACE.search(t):
                found += self._word(t)
        if len(token) > LONGEST:
            for t in _JOINS.split(bare):
                if t != bare and len(t) > 2 and _TRACE.search(t):
                    found += self._word(t)
        return found

    def _word(self, token: str) -> list[str]:
        """The token as one word; what is no word even without its repeats and signs is left to runs()."""
        if len(token) > LONGEST:
            token = squeeze(token)
        return [self.restore(token)] if len(token) <= LONGEST else []

    def runs(self, token: str, reach: int = REACH) -> Iterator[str]:
        """Of a token of more than LONGEST signs: letters in which words may begin anywhere."""
        if len(token) > LONGEST and _TRACE.search(token):
            yield from self._parts(token, reach)

    def spaced(self, text: str, reach: int = REACH) -> Iterator[str]:
        """Words spelt with white space, any and of any length, between their letters."""
        for m in _SPACED.finditer(text):
            yield from self._parts("".join(m[0].split()), reach)

    def _parts(self, letters: str, reach: int) -> Iterator[str]:
        """Every word of up to reach letters, each written up to three times, is whole in some part."""
        letters = squeeze(letters)
        step = max(LONGEST // 2, 3 * reach)
        for s in range(0, max(1, len(letters) - step), step):
            part = letters[s : s + 2 * step]
            if part.isalpha():
                yield part
            if not part.isalpha() or _REPEAT.search(part):
                yield decode(part, self.lm)


def squeeze(token: str) -> str:
    """Without signs that stand for no letter; of longer repeats three are left."""
    return _MANY.sub(r"\1\1\1", _MUTE.sub("", token))


def stems(word: str) -> list[str]:
    return [f"{word}$", *[word[:n] for n in STEMS if len(word) >= n]]


def features(reader: Reader, text: str | None) -> set[str]:
    low = (text or "").lower()
    found: set[str] = set()
    for t in set(_TOKEN.findall(low)):
        for w in reader.words(t):
            found.update(stems(w))
    for run in reader.spaced(low):
        # Where words begin and end is not said: every place is tried.
        for a in range(len(run)):
            found.update(f"{run[a:b]}$" for b in range(a + 3, min(len(run), a + LONGEST) + 1))
    return found


def inside(run: str, lengths: list[int]) -> Iterator[str]:
    """All its parts that are as long as some word of a lexicon."""
    for n in lengths:
        for a in range(len(run) - n + 1):
            yield f"{run[a : a + n]}$"


class Scorer:
    def __init__(self, lm: LanguageModel, weights: dict[str, float], fit: tuple[float, float, float]):
        self.lm, self.weights, self.fit = lm, weights, fit
        self.reader: Reader | None = None
        #: Lengths of the lexicon's words; beginnings are not sought within runs.
        self.lengths = sorted({n for f in weights if f.endswith("$") and (n := len(f) - 1) > 2})
        self.reach = max(self.lengths, default=REACH)

    def __getstate__(self):
        return {"lm": self.lm, "weights": self.weights, "fit": self.fit, "reader": None, "lengths": self.lengths, "reach": self.reach}

    def _token(self, t: str) -> float:
        """Evidence of a token: its strongest feature."""
        assert self.reader is not None
        own = max((self.weights.get(f, 0.0) for w in self.reader.words(t) for f in stems(w)), default=0.0)
        return max([own, *map(self._run, self.reader.runs(t, self.reach))])

    def _run(self, run: str) -> float:
        return max((self.weights.get(f, 0.0) for f in inside(run, self.lengths)), default=0.0)

    def evidence(self, text: str | None) -> tuple[float, float]:
        """The strongest and the summed evidence of a text."""
        if self.reader is None:
            self.reader, outer = Reader(self.lm), self

            class Seen(dict):
                def __missing__(self, t: str) -> float:
                    v = outer._token(t)
                    if len(self) < 200_000 and len(t) < 64:
                        self[t] = v
                    return v

            self.seen = Seen()
        low = (text or "").lower()
        got = [v for v in map(self.seen.__getitem__, low.split()) if v > 0]
        got += [v for v in map(self._run, self.reader.spaced(low, self.reach)) if v > 0]
        return (max(got, default=0.0), math.log1p(sum(got)))

    def score(self, text: str | None) -> float:
        a, b = self.evidence(text)
        w0, w1, w2 = self.fit
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, w0 + w1 * a + w2 * b))))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return tuple(float(v) for v in w)


def train_language_model(docs: DataFrame) -> LanguageModel:
    """Trigram counts over all texts, summed per batch before they are moved."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: Counter = Counter()
            for x in b.column(0):
                words.update((x.as_py() or "").lower().split())
            clean: Counter = Counter()
            for t, n in words.items():
                t = t.strip(_EDGE)
                if t.isalpha():
                    clean[t] += n
            c = word_trigrams(clean)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["gram", "n"])

    # At most 61**3 rows, whatever the size of the table.
    rows = docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return LanguageModel({r["gram"]: r["n"] for r in rows})


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = SAMPLE) -> Scorer:
    lm = train_language_model(docs)
    sample, share = labelled_sample(docs, labels, learn, label, per_class)
    reader = Reader(lm)
    y = np.array([r["y"] for r in sample], float)
    if len(set(y)) < 2:
        p = min(1 - 1e-6, max(1e-6, share or 0.0))
        return Scorer(lm, {}, (math.log(p / (1 - p)), 0.0, 0.0))
    df = (Counter(), Counter())
    for r in sample:
        df[r["y"]].update(features(reader, r["text"]))
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    odds = {}
    for f, a in df[1].items():
        if a >= SUPPORT:
            w = math.log((a + 0.1) / (n1 + 1)) - math.log((df[0][f] + 0.1) / (n0 + 1))
            if w > 1.5:
                odds[f] = w * math.sqrt(a / (a + 5))
    weights = dict(sorted(odds.items(), key=lambda r: (-r[1], r[0]))[:LEXICON])
    trial = Scorer(lm, weights, (0, 0, 0))
    x = np.array([trial.evidence(r["text"]) for r in sample])
    w0, w1, w2 = logistic(x, y)
    # The sample holds the classes in other shares than the table.
    w0 += math.log(share / (1 - share)) - math.log(n1 / n0)
    return Scorer(lm, weights, (w0, w1, w2))


def score(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> DataFrame:
    """doc_id, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, learn, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.value.score(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op5_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    got = score(docs, labels, crc_mod("doc_id", 5) != 0)
    return got.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
