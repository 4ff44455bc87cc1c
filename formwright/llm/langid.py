"""Language identification by unigram pieces, summed over all segmentations.

The pieces are all those of a fixed public vocabulary that consist of letters, with their mark of a word's start, and every
single letter of the labelled sample. A letter beyond these has a probability learned per language. A word's probability in a
language is the sum, over all ways to cut it into pieces, of the products of the pieces' probabilities; a forward pass gives
it, for runs of letters of any length. A text's words are independent, so a text's log-probability is a sum over its words.
Piece probabilities per language are fitted on labelled documents by expectation maximisation over the same lattice: the
sample's words are counted in Spark, and each round sends back expected counts per piece alone.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formwright.llm.common import checkpoint, kept, named, packed_rows, trimmed

#: Numbers that are not decimal digits, such as Roman numerals and fractions: a pattern takes them for word characters.
_NUMERALS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_BLANKS = dict.fromkeys(map(ord, _NUMERALS), " ")
_RUNS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
START = "▁"  # stands before a word, as in the vocabulary
_ALL_LETTERS = 140_000  # letters that Unicode has, about
_TRAINED = 32  # in training, a longer run of letters is learned in stretches of this length


def vocabulary(path: str) -> list[str]:
    """Lower-case letter pieces of a sentencepiece model file, and the mark of a word's start alone or before letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted({p for p in got if p.removeprefix(START).isalpha()} | {START})


def runs_of(text: str | None) -> list[str]:
    """Runs of letters, as Unicode has them, in lower case."""
    text = (text or "").lower()
    if not text.isascii() and not _NUMERALS.isdisjoint(text):
        text = text.translate(_BLANKS)
    return _RUNS.findall(text)


def words_of(text: str | None) -> list[str]:
    return [START + w for w in runs_of(text)]


def _points(words: list[str], length: int) -> np.ndarray:
    return np.array(words, dtype=f"U{length}").view(np.uint32).reshape(len(words), length)


class Lattice:
    """The pieces by length, to be found in words given as matrices of code points."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.index: list[tuple[np.ndarray, np.ndarray]] = []
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append(i)
        for n in range(1, self.longest + 1):
            numbers = np.array(by.get(n, ()), np.int64)
            keys = np.zeros(len(numbers), np.uint64)
            for column in _points([pieces[i] for i in numbers.tolist()], n).T if len(numbers) else ():
                keys = keys * np.uint64(1_114_129) + column  # exact up to three code points, a 64-bit hash beyond
            order = np.argsort(keys)
            self.index.append((keys[order], numbers[order]))

    def pieces(self, points: np.ndarray) -> list[np.ndarray | None]:
        """Of words of one length: for each piece length, (words, places) with the piece's number or -1; None if there is none."""
        length = points.shape[1]
        points = points.astype(np.uint64)
        out: list[np.ndarray | None] = []
        code = np.zeros(points.shape, np.uint64)
        for n in range(1, min(self.longest, length) + 1):
            code = code[:, : length - n + 1] * np.uint64(1_114_129) + points[:, n - 1 :]
            keys, numbers = self.index[n - 1]
            found = None
            if len(keys):
                at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                hit = keys[at] == code
                found = np.where(hit, numbers[at], -1) if hit.any() else None
            out.append(np.full(code.shape, -1) if found is None and n == 1 else found)
        return out


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(part):
            n = int(lengths[part[0]])
            step = max(1, min(4096, (1 << 17) // n))
            for lo in range(0, len(part), step):
                yield n, part[lo : lo + step]


def _share(found: list[np.ndarray | None], size: int, place: int, table: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    f = found[size - 1][:, place]
    p = table[f]
    return np.where(f[:, None] < 0, unseen, p) if size == 1 else p


def log_sums(lattice: Lattice, words: list[str], length: int, table: np.ndarray, unseen: np.ndarray, stretch: int = 1 << 18) -> np.ndarray:
    """(words, languages): logarithms of the sums over all segmentations, of words of one length. table's last row is for no
    piece (0). The pass keeps as many columns as the longest piece has letters, and rescales them as it goes."""
    points = _points(words, length)
    most = min(lattice.longest, length)
    recent = [np.ones((len(words), table.shape[1]))]
    scale = np.zeros_like(recent[0])
    step = max(most, stretch // len(words))
    for lo in range(0, length, step):
        hi, first = min(length, lo + step), max(0, lo - most + 1)
        found = lattice.pieces(points[:, first:hi])
        sizes = [n for n, f in enumerate(found, 1) if f is not None]
        for end in range(lo + 1, hi + 1):
            total = np.zeros_like(scale)
            for size in sizes:
                if size > end:
                    break
                total += recent[-size] * _share(found, size, end - size - first, table, unseen)
            recent.append(total)
            del recent[:-most]
            if end % 16 == 0 and end < length:
                recent = [r / total for r in recent]
                scale += np.log(total)
    return scale + np.log(np.maximum(recent[-1], 1e-300))


def forward(found: list[np.ndarray | None], length: int, table: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    """(places, words, languages): sums over the segmentations of each prefix, for training."""
    alpha = np.zeros((length + 1, found[0].shape[0], table.shape[1]))
    alpha[0] = 1.0
    for end in range(1, length + 1):
        for size in range(1, min(len(found), end) + 1):
            if found[size - 1] is not None:
                alpha[end] += alpha[end - size] * _share(found, size, end - size, table, unseen)
    return alpha


def backward(found: list[np.ndarray | None], length: int, table: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    beta = np.zeros((length + 1, found[0].shape[0], table.shape[1]))
    beta[length] = 1.0
    for start in range(length - 1, -1, -1):
        for size in range(1, min(len(found), length - start) + 1):
            if found[size - 1] is not None:
                beta[start] += beta[start + size] * _share(found, size, start, table, unseen)
    return beta


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    table: np.ndarray  # (pieces + 1, languages), the last row 0
    unseen: np.ndarray  # probability of a letter that no piece covers
    prior: np.ndarray

    def word_scores(self, words: list[str], lattice: Lattice) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        for length, at in _by_length(words):
            out[at] = log_sums(lattice, [words[i] for i in at], length, self.table, self.unseen)
        return out


def expected(lattice: Lattice, words: list[str], times: np.ndarray, table: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    """Of one language's words and their numbers: how often each piece is expected, over all segmentations."""
    k = len(table) - 1
    out = np.zeros(k)
    for length, at in _by_length(words):
        found = lattice.pieces(_points([words[i] for i in at], length))
        a, b = forward(found, length, table, unseen), backward(found, length, table, unseen)
        whole = np.maximum(a[length][:, 0], 1e-300)
        for size, f in enumerate(found, 1):
            if f is None:
                continue
            for start in range(length - size + 1):
                here = f[:, start]
                own = here >= 0
                share = a[start][:, 0] * table[here, 0] * b[start + size][:, 0] / whole * times[at]
                out += np.bincount(here[own], share[own], minlength=k)
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trimmed()
        got: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = got.setdefault(lang, Counter())
            for w in words_of(text):
                if len(w) <= _TRAINED:
                    own[w] += 1
                else:
                    own.update(w[i : i + _TRAINED] for i in range(0, len(w), _TRAINED))
        rows = [(lang, w, n) for lang, c in got.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])


def _expect(model: Model):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(model.pieces), np.zeros((len(model.table) - 1, len(model.langs)))
        number = {x: c for c, x in enumerate(model.langs)}
        for batch in batches:
            c = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            words, times = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
            for own in np.unique(c).tolist():
                at = np.flatnonzero(c == own)
                total[:, own] += expected(lattice, [words[i] for i in at], times[at], model.table[:, own : own + 1], model.unseen[own : own + 1])
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "c", "n"])

    return expect


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", vocabulary_path: str = "", most_docs: int = 4000, rounds: int = 3, smooth: float = 0.5) -> Model:
    """Fit on a bounded sample of labelled rows: about ``most_docs`` of each language, those with the smallest hashes of the
    id (of the text where that is null), the same at each run. The prior is that of all labelled rows.

    All words of the sample are learned from. The driver sees one count per language, per letter, and per piece and round.
    """
    names, texts = F.col(named(lang)).cast("string"), F.col(named(text)).cast("string")
    labelled = docs.select(names.alias("lang"), texts.alias("text"), F.col(named(doc_id)).alias("id")).where("lang is not null and text is not null")
    prior = dict(sorted(map(tuple, labelled.groupBy("lang").count().collect())))
    if not prior:
        return Model([], vocabulary(vocabulary_path), np.zeros((1, 1)), np.ones(1), np.zeros(1))
    langs = list(prior)
    h = F.shiftrightunsigned(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), 1)
    bounds = F.create_map(*(F.lit(x) for name, n in prior.items() for x in (name, min(most_docs, n) * (2**63 - 1) // n)))
    sample = labelled.where(h <= bounds[F.col("lang")]).select("lang", "text")
    words = checkpoint(sample.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    letters = words.select("lang", F.explode(F.split("word", "")).alias("x"), "n").where(F.col("x") != "").groupBy("lang", "x").agg(F.sum("n").alias("n")).collect()
    pieces = sorted({*vocabulary(vocabulary_path), *(r.x for r in letters)})
    k = len(pieces)
    # the mass of letters met once (Good and Turing), spread over the letters not met
    often = {x: [r.n for r in letters if r.lang == x] for x in langs}
    unseen = np.array([(sum(n == 1 for n in often[x]) + 0.5) / (sum(often[x]) + 1) / _ALL_LETTERS for x in langs])
    table = np.zeros((k + 1, len(langs)))
    table[:k] = 1.0 / k
    seen = np.array(list(prior.values()), float)
    model = Model(langs, pieces, table, unseen, np.log(seen / seen.sum()))
    for _ in range(rounds):
        got = words.mapInArrow(_expect(model), "piece int, c int, n double").groupBy("piece", "c").agg(F.sum("n").alias("n")).toPandas()
        table = np.full_like(table, smooth)
        table[got["piece"].to_numpy(), got["c"].to_numpy()] += got["n"].to_numpy()
        table[k] = 0
        model.table = table = table / table.sum(0)
    return model


#: Word scores that a Python worker has worked out are bounded in number and in the words' length.
_MOST_KNOWN, _MOST_LETTERS = 150_000, 64


def _predict(model: Model, key: str, place: int):
    """place: of the text within own."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(("langid", key), lambda: [Lattice(model.pieces), {}, np.zeros((1 << 14, len(model.prior)))])
        lattice, index, scores = known
        for whole in batches:
            trimmed()
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                lists = [runs_of(t) for t in pc.struct_field(batch.column(0), [place]).to_pylist()]
                if len(index) > _MOST_KNOWN:
                    index.clear()
                new = list({w for ws in lists for w in ws if w not in index and len(w) <= _MOST_LETTERS})
                if new and model.langs:
                    base = len(index)
                    while base + len(new) > len(scores):
                        scores = np.concatenate([scores, np.zeros_like(scores)])
                    scores[base : base + len(new)] = model.word_scores([START + w for w in new], lattice)
                    index.update(zip(new, range(base, base + len(new)), strict=True))
                    known[2] = scores
                langs, probabilities = [], []
                for ws in lists:
                    if not ws or not model.langs:
                        langs.append(UNKNOWN)
                        probabilities.append(0.0)
                        continue
                    try:
                        total = model.prior + scores[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(0)
                    except KeyError:  # runs too long to be kept
                        at = [index[w] for w in ws if w in index]
                        long = [START + w for w in ws if w not in index]
                        total = model.prior + scores[np.array(at, np.int64)].sum(0) + model.word_scores(long, lattice).sum(0)
                    p = np.exp(total - total.max())
                    best = int(p.argmax())
                    langs.append(model.langs[best])
                    probabilities.append(float(p[best] / p.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(probabilities, pa.float64())], ["own", "lang_pred", "score"])

    return predict


def judged(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(own, lang_pred, score) per row of docs, own holding all of its columns: ``und`` if the text is null or has no letter,
    else the language of the highest posterior probability, which is the score; of equal ones the first by name. ``und`` has
    score 0. Whole texts are scored; a model without languages says ``und``."""
    import hashlib

    key = hashlib.md5(model.table.tobytes() + repr(model.langs).encode()).hexdigest()
    shape, own = packed_rows(docs)  # the text goes to Python once, within its row
    place = docs.columns.index(text)
    return shape.mapInArrow(_predict(model, key, place), T.StructType([own, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def predicted(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, and lang_pred and score of ``judged``."""
    some = docs.select(*(F.col(named(c)) for c in dict.fromkeys((*keep, text))))
    got = judged(some, model, text)
    return got.select(*(F.col("own")[c].alias(c) for c in keep), "lang_pred", "score")
