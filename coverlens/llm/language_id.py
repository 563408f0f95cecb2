"""Language ID by a linear-chain conditional random field over words.

A word's features are its affixes, the character n-grams inside it and its entry in a lexicon of training words; learned transitions tie
neighbours. Forward-backward gives every word's label probabilities, so a text that switches languages is labelled word by word; a
document's language is the one with the largest mean probability. Training sees a bounded sample of labelled windows, spliced so that
switches occur; prediction reads whole texts in Arrow batches and shuffles nothing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import byte_slices, texts_of, tidy, worker_state

#: Expected labelled documents for each language, and the characters of the window taken from each at a place given by a hash.
SAMPLE_DOCS, WINDOW_CHARS = 300, 400
SEQUENCE, EPOCHS, RATE, DECAY = 24, 40, 0.15, 1e-5
MIN_COUNT = 2
UNKNOWN = "und"
CACHE_WORDS = 400_000
SLICE_BYTES = 1 << 21
LANE = 256
MAX_ORDER = 3

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """Affixes, inner n-grams and the word itself, each kind with a prefix of its own. Repeats count once."""
    n = len(word)
    out = {"=" + word}
    for k in range(1, MAX_ORDER + 1):
        if k <= n:
            out.add("<" + word[:k])
            out.add(">" + word[-k:])
        out.update("." + word[i : i + k] for i in range(n - k + 1))
    return list(out)


@dataclass
class Model:
    """langs sorted; index of features; weights (features + 1, langs), the last row for none; transition and start scores."""

    langs: list[str]
    index: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of every label for each word; unseen features score nothing."""
        get, rows, ends = self.index.get, [], []
        for w in words:
            rows.extend(i for f in features(w) if (i := get(f)) is not None)
            rows.append(len(self.index))
            ends.append(len(rows))
        if not words:
            return np.zeros((0, len(self.langs)))
        return np.add.reduceat(self.weights[rows], [0, *ends[:-1]], axis=0)


def step(e: np.ndarray) -> np.ndarray:
    return np.exp(e - e.max(axis=-1, keepdims=True))


def fit(windows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Full-batch Adam on the conditional log-likelihood of sequences spliced from (text, lang) windows."""
    langs = sorted({lang for _, lang in windows})
    rng = np.random.default_rng(seed)
    of, label, ids = {}, [], []
    for k in rng.permutation(len(windows)):
        text, lang = windows[k]
        found = [of.setdefault(w, len(of)) for w in words_of(text)]
        ids += found
        label += [langs.index(lang)] * len(found)
    n = len(ids) // SEQUENCE * SEQUENCE
    kinds, counts = {}, {}
    lists = [features(w) for w in of]
    for fs in lists:
        for f in fs:
            counts[f] = counts.get(f, 0) + 1
    seen = np.bincount(ids, minlength=len(of)) if ids else np.zeros(len(of))
    for w, k in of.items():  # a lexicon entry needs repeated use, other features repeated words
        if seen[k] >= MIN_COUNT:
            counts["=" + w] = MIN_COUNT
    for f, c in counts.items():
        if c >= MIN_COUNT:
            kinds[f] = len(kinds)
    K, none = len(langs), len(kinds)
    model = Model(langs, kinds, np.zeros((none + 1, K)), np.zeros((K, K)), np.zeros(K))
    if not n or K < 2:
        return model
    rows, cols = zip(*((k, kinds.get(f, none)) for k, fs in enumerate(lists) for f in (*fs, "")))
    rows, cols = np.array(rows), np.array(cols)
    starts = np.searchsorted(rows, np.arange(len(of)))
    ids, label = np.array(ids[:n]).reshape(-1, SEQUENCE), np.array(label[:n]).reshape(-1, SEQUENCE)
    order = rng.permutation(len(ids) * 2)  # half sequences spliced at random: labels switch inside
    half = SEQUENCE // 2
    ids, label = (x.reshape(-1, half)[order].reshape(-1, SEQUENCE) for x in (ids, label))
    hot = np.eye(K)[label]
    pairs = np.zeros((K, K))
    np.add.at(pairs, (label[:, :-1].ravel(), label[:, 1:].ravel()), 1)
    params = [model.weights, model.trans, model.start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for it in range(1, EPOCHS + 1):
        e = step(np.add.reduceat(model.weights[cols], starts, axis=0)[ids])
        t = np.exp(model.trans)
        a, b = np.empty_like(e), np.ones_like(e)
        a[:, 0] = np.exp(model.start) * e[:, 0]
        a[:, 0] /= a[:, 0].sum(1, keepdims=True)
        for i in range(1, SEQUENCE):
            a[:, i] = a[:, i - 1] @ t * e[:, i]
            a[:, i] /= a[:, i].sum(1, keepdims=True)
        for i in range(SEQUENCE - 2, -1, -1):
            b[:, i] = (e[:, i + 1] * b[:, i + 1]) @ t.T
            b[:, i] /= b[:, i].sum(1, keepdims=True)
        p = a * b
        p /= p.sum(2, keepdims=True)
        x = a[:, :-1, :, None] * t * (e * b)[:, 1:, None, :]
        x /= x.sum((2, 3), keepdims=True)
        d = (p - hot).reshape(-1, K)
        byword = np.stack([np.bincount(ids.ravel(), d[:, k], len(of)) for k in range(K)], 1)[rows]
        grads = [np.stack([np.bincount(cols, byword[:, k], none + 1) for k in range(K)], 1), x.sum((0, 1)) - pairs, d.reshape(-1, SEQUENCE, K)[:, 0].sum(0)]
        for q, g, mm, vv in zip(params, grads, m, v):
            g = g / len(ids) + DECAY * q
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            q -= RATE * (mm / (1 - 0.9**it)) / (np.sqrt(vv / (1 - 0.99**it)) + 1e-8)
    return model


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of words in a row, where `first` marks each text's first word. (words, labels) in, the same out.

    The row is cut into lanes that run side by side: the product of the steps of each lane gives the vectors at all lane ends, from
    which both passes restart. A first word's step forgets what came before it, so texts stay independent."""
    n, K = e.shape
    if n == 0:
        return e
    lanes = -(-n // LANE)
    pad = lanes * LANE - n
    e = step(np.concatenate([e, np.zeros((pad, K))])).reshape(lanes, LANE, K)
    cut = np.concatenate([first, np.ones(pad, bool)]).reshape(lanes, LANE, 1)
    t, s = np.exp(trans), np.exp(start)
    whole = np.repeat(np.eye(K)[None], lanes, 0)
    for i in range(LANE):
        whole = np.where(cut[:, i, None], whole.sum(2, keepdims=True) * s, whole @ t) * e[:, i, None, :]
        whole /= whole.max((1, 2), keepdims=True)
    ahead, behind = np.ones((lanes, K)), np.ones((lanes, K))
    for k in range(1, lanes):
        ahead[k] = ahead[k - 1] @ whole[k - 1]
        ahead[k] /= ahead[k].sum()
    for k in range(lanes - 2, -1, -1):
        behind[k] = whole[k + 1] @ behind[k + 1]
        behind[k] /= behind[k].sum()
    a, p = ahead, np.empty_like(e)
    for i in range(LANE):
        a = np.where(cut[:, i], a.sum(1, keepdims=True) * s, a @ t) * e[:, i]
        a = a / a.sum(1, keepdims=True)
        p[:, i] = a
    b = behind
    for i in range(LANE - 1, -1, -1):
        p[:, i] *= b
        x = e[:, i] * b
        b = np.where(cut[:, i], (x @ s)[:, None], x @ t.T)
        b = b / b.sum(1, keepdims=True)
    p /= p.sum(2, keepdims=True)
    return p.reshape(-1, K)[:n]


def predictor_of(model: Model) -> Predictor:
    """The worker's predictor for a model, kept over its tasks."""
    key = hashlib.sha256(model.weights.tobytes() + model.trans.tobytes() + repr(model.langs).encode()).digest()
    return worker_state(key, lambda: Predictor(model))


class Predictor:
    """A model with a bounded cache of word scores; over the limit the shorter half of the words stays, which return more often."""

    def __init__(self, model: Model):
        self.model, self.ids, self.scores = model, {}, np.zeros((0, len(model.langs)))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of all words, words of each text)."""
        lists = [words_of(x) for x in texts]
        if len(self.ids) > CACHE_WORDS:
            longest = sorted(map(len, self.ids))[len(self.ids) // 2]
            kept = [w for w in self.ids if len(w) < longest]
            self.scores = self.scores[[self.ids[w] for w in kept]]
            self.ids = dict(zip(kept, range(len(kept))))
        new = list({w for ws in lists for w in ws}.difference(self.ids))
        self.scores = np.concatenate([self.scores, self.model.emissions(new)])
        self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
        counts = np.array([len(ws) for ws in lists], np.int64)
        total = int(counts.sum())
        at = np.fromiter((self.ids[w] for ws in lists for w in ws), np.int64, total)
        first = np.zeros(total, bool)
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        return marginals(self.scores[at], first, self.model.trans, self.model.start), counts

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.model.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        p, counts = self.words(texts)
        sums = np.zeros((len(texts), len(self.model.langs)))
        if len(p):
            full = counts > 0
            sums[full] = np.add.reduceat(p, (np.cumsum(counts) - counts)[full], axis=0)
        best = sums.argmax(1)
        score = np.clip(sums[np.arange(len(texts)), best] / np.maximum(counts, 1), 0, 1)
        known = [c > 0 and any(map(str.isalpha, t)) for c, t in zip(counts.tolist(), texts)]
        return [self.model.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known)], [s if k else 0.0 for s, k in zip(score.tolist(), known)]


def held_out(id_col: str = "doc_id") -> Column:
    """The documents that nothing is learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model of a bounded sample: about SAMPLE_DOCS windows of each language, drawn by a hash of their ids at a rate set by the counts of
    the languages, a closed set of few values. Only windows of WINDOW_CHARS characters reach the driver."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(id_col, text_col, lang_col)
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not counts:
        return fit([])
    rate = F.create_map(*(x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, SAMPLE_DOCS / n)))))
    draw = F.pmod(F.xxhash64(F.lit("draw"), id_col), F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.xxhash64(F.lit("place"), id_col), F.greatest(F.lit(1), F.length(text_col) - WINDOW_CHARS)).cast("int") + 1
    few = known.where(draw < rate[F.col(lang_col)]).select(F.substring(text_col, place, F.lit(WINDOW_CHARS)).alias("t"), F.col(lang_col).alias("l"), F.xxhash64(id_col).alias("h"))
    few = few.orderBy("h", "t", "l").limit(2 * SAMPLE_DOCS * len(counts))
    return fit([(r["t"], r["l"]) for r in few.collect()])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score. Null texts and texts without a letter are `und` with score 0; repeated rows are
    predicted alike, ties take the first language in order, and no other column is read."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = predictor_of(model)
        for whole in batches:
            for batch in byte_slices(whole, text_col, SLICE_BYTES):
                lang, score = predictor.predict(texts_of(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with words: id, words, langs, probs, aligned arrays of the most likely label of each word."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, words array<string>, langs array<string>, probs array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = predictor_of(model)
        for whole in batches:
            for batch in byte_slices(whole, text_col, SLICE_BYTES):
                texts = texts_of(batch.column(1))
                p, counts = predictor.words(texts)
                stops = np.cumsum(counts)
                rows = []
                for text, a, b in zip(texts, (stops - counts).tolist(), stops.tolist()):
                    best = p[a:b].argmax(1)
                    rows.append((words_of(text), [model.langs[k] for k in best], p[a:b].max(1).tolist() if b > a else []))
                w, la, pr = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.list_(pa.string())), pa.array(la, pa.list_(pa.string())), pa.array(pr, pa.list_(pa.float64()))], [id_col, "words", "langs", "probs"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with a known language, with all their columns; filtered inside the Arrow batches.

    The score is the share of one language, which is low in clean texts that switch between several, so it rejects nothing."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = predictor_of(model)
        for whole in batches:
            for batch in byte_slices(whole, text_col, SLICE_BYTES):
                lang, _ = predictor.predict(texts_of(batch.column(at)))
                yield batch.filter(pa.array([x != UNKNOWN for x in lang], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
