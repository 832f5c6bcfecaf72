"""Toxicity by a small convolutional text classifier.

Words are hashed twice and embedded as the sum of two table rows; filters of several widths slide
over the whole text, the largest response of each filter is kept (max pooling), and a logistic
layer weighs them. It is trained here, in numpy, on a bounded sample of labelled rows, by one task
on an executor; the driver only passes the model on. The table starts from each bucket's log-odds
of standing in a toxic text, so that pooling looks at telling words from the first step on.

Thresholds are calibrated by language. The language is not read from a column when scoring: a
table of word log-likelihoods, learned on the same sample, names it from the text. Languages with
too few labels to be calibrated share one border. The returned score is the logistic of
(response - threshold of that language), so 0.5 is the calibrated border.

Defined results: null, empty or wordless texts score 0; documents with several labels count as
toxic if any label is; null labels are ignored; without labels of both kinds all score 0; of rows that
share an id one is learned from. ``scored`` takes the name of its result, so that no key clashes.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from storeyline.llm import textcodes
from storeyline.llm.common import column_or_null, held, positional

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 4
LANG_BUCKETS = 1 << 12
#: Labelled documents of each label in the sample, and words in all: later texts are not learned from.
MAX_TRAIN = 2000
MAX_WORDS = 8_000_000
#: Rows of each label that a language's own border is calibrated on.
CALIBRATED = 10


@dataclass
class Model:
    one: np.ndarray  # (BUCKETS, DIM), by the low bits of a word's hash
    two: np.ndarray  # (BUCKETS, DIM), by other bits
    filters: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    dense: np.ndarray
    offset: float
    langs: np.ndarray  # (LANG_BUCKETS, languages): log-likelihoods
    borders: np.ndarray  # by language
    scale: float


def _ids(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), ((hashes >> np.uint64(24)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _lang_ids(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(46)) & np.uint64(LANG_BUCKETS - 1)).astype(np.int64)


def _padded(bounds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words followed by two empty places; (positions of the words, starts of the texts)."""
    n = np.diff(bounds)
    starts = bounds[:-1] + 2 * np.arange(len(n))
    return np.arange(len(hashes)) + np.repeat(2 * np.arange(len(n)), n), starts


def _pooled(model: Model, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list]:
    """(texts, all filters): the largest response of each filter; and what training needs."""
    at, starts = _padded(bounds, hashes)
    a, b = _ids(hashes)
    size = len(hashes) + 2 * (len(bounds) - 1)
    emb = np.zeros((size + 2, DIM), np.float32)
    emb[at] = model.one[a] + model.two[b]
    live = np.zeros(size, bool)
    live[at] = True
    out, kept = [], []
    for w, f in zip(WIDTHS, model.filters, strict=True):
        r = sum(emb[j : j + size] @ f[j] for j in range(w))
        r[~live] = -1e9
        out.append(np.maximum.reduceat(r, starts, axis=0))
        kept.append(r)
    pooled = np.concatenate(out, 1) + model.bias
    pooled[np.diff(bounds) == 0] = 0
    return np.maximum(pooled, 0), [emb, kept, at, starts, a, b, size]


def _responses(model: Model, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.full(len(bounds) - 1, -30.0)
    pooled, _ = _pooled(model, hashes, bounds)
    return pooled @ model.dense + model.offset


def _languages(model: Model, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if model.langs.shape[1] == 1 or not len(hashes):
        return np.zeros(len(bounds) - 1, np.int64)
    likely = model.langs[_lang_ids(hashes)]
    total = np.add.reduceat(np.concatenate((likely, likely[:1] * 0)), bounds[:-1], axis=0)
    return np.argmax(total * (np.diff(bounds) > 0)[:, None], 1)


def score_texts(model: Model | None, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    hashes, bounds = textcodes.words(*textcodes.folded(texts))
    z = (_responses(model, hashes, bounds) - model.borders[_languages(model, hashes, bounds)]) * model.scale
    out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    out[np.diff(bounds) == 0] = 0
    return out


class Sample:
    """The hashed words of different texts, added a few at a time; the texts are not kept."""

    def __init__(self, max_words: int = MAX_WORDS):
        self.hashes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.labels: list[int] = []
        self.langs: list[str | None] = []
        self.left = max_words
        self.met: set[bytes] = set()

    def add(self, texts: list[str], labels: list[int], langs: list[str | None], step: int = 100) -> None:
        for at in range(0, len(texts), step):
            if self.left <= 0:
                return
            new = []
            for i in range(at, min(at + step, len(texts))):
                digest = hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if digest not in self.met:
                    self.met.add(digest)
                    new.append(i)
            h, b = textcodes.words(*textcodes.folded([texts[i] for i in new]))
            self.hashes.append(h)
            self.counts.append(np.diff(b))
            self.labels += [labels[i] for i in new]
            self.langs += [langs[i] for i in new]
            self.left -= len(h)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, np.uint64), *self.hashes]), np.cumsum(np.concatenate([[0], *self.counts]))


def _slice(hashes: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [hashes[bounds[i] : bounds[i + 1]] for i in rows]
    return np.concatenate(parts) if parts else hashes[:0], np.cumsum([0, *map(len, parts)])


def fit(sample: Sample, epochs: int = 12, seed: int = 7) -> Model | None:
    """A model from a bounded sample; every sixth row of each label only calibrates the borders."""
    labels, langs = np.asarray(sample.labels, int), sample.langs
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    hashes, bounds = sample.words()
    n, owner = np.diff(bounds), np.repeat(np.arange(len(labels)), np.diff(bounds))
    aside = np.zeros(len(labels), bool)
    for y in (0, 1):
        own = np.flatnonzero(labels == y)
        if len(own) >= 30:
            aside[own[::6]] = True
    train = np.flatnonzero(~aside & (n > 0))

    def odds(ids: np.ndarray) -> np.ndarray:
        pair = np.unique(ids * len(labels) + owner)  # a word counts once a text
        who, what = pair % len(labels), pair // len(labels)
        use = ~aside[who]
        hit = [np.bincount(what[use & (labels[who] == y)], minlength=BUCKETS) for y in (0, 1)]
        total = [max(1, int((labels[train] == y).sum())) for y in (0, 1)]
        v = np.log((hit[1] + 0.5) / (total[1] + 1)) - np.log((hit[0] + 0.5) / (total[0] + 1))
        spread = np.sqrt(1 / (hit[1] + 0.5) + 1 / (hit[0] + 0.5))
        return np.where(hit[0] + hit[1] > 0, np.sign(v) * np.maximum(0, np.abs(v) - 2 * spread), 0)

    a, b = _ids(hashes)
    tables = []
    for ids in (a, b):
        t = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        t[:, 0] = odds(ids) / 2
        tables.append(t)
    rows_of: dict[str | None, list[int]] = {}
    for i in np.flatnonzero(aside):
        rows_of.setdefault(langs[i], []).append(int(labels[i]))
    # the others share the last place; these are at most as many as the sample has rows for
    names = sorted(x for x, own in rows_of.items() if x is not None and min(sum(own), len(own) - sum(own)) >= CALIBRATED)
    place = {x: k for k, x in enumerate(names)}
    of = np.array([place.get(x, len(names)) for x in langs])
    pair = _lang_ids(hashes) * (len(names) + 1) + of[owner]
    counts = 0.5 + np.bincount(pair, minlength=LANG_BUCKETS * (len(names) + 1)).reshape(LANG_BUCKETS, -1)
    model = Model(*tables, [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 0.3, np.float32), -1.0, np.log(counts / counts.sum(0)).astype(np.float32), np.zeros(len(names) + 1), 1.0)
    for f in model.filters:
        f[0, 0, :2] = 1.0
    weight = {y: len(train) / max(1, 2 * (labels[train] == y).sum()) for y in (0, 1)}
    rate = 0.05
    for epoch in range(epochs):
        order = rng.permutation(train)
        for i in range(0, len(order), 128):
            rows = order[i : i + 128]
            h, bd = _slice(hashes, bounds, rows)
            pooled, (emb, kept, at, starts, ia, ib, size) = _pooled(model, h, bd)
            y = labels[rows]
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.dense + model.offset, -30, 30)))
            g = ((p - y) * np.where(y == 1, weight[1], weight[0]) / len(rows)).astype(np.float32)
            gp = g[:, None] * model.dense * (pooled > 0)
            model.dense -= rate * 4 * (pooled.T @ g)
            model.offset -= rate * 4 * float(g.sum())
            model.bias -= rate * gp.sum(0)
            word_at = np.full(size + 2, -1)
            word_at[at] = np.arange(len(h))
            ends = np.append(starts[1:], size)
            for k, (w, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
                for c in range(FILTERS):
                    r, gc = kept[k][:, c], gp[:, k * FILTERS + c]
                    for d in np.flatnonzero(gc):
                        top = starts[d] + int(np.argmax(r[starts[d] : ends[d]]))
                        step = rate * gc[d]
                        for j in range(w):
                            if (word := word_at[top + j]) >= 0:
                                old = f[j, :, c].copy()
                                f[j, :, c] -= step * emb[top + j]
                                model.one[ia[word]] -= 4 * step * old
                                model.two[ib[word]] -= 4 * step * old
        rate *= 0.85
    check = np.flatnonzero(aside & (n > 0)) if aside.any() else train
    z = _responses(model, *_slice(hashes, bounds, check))
    said = _languages(model, *_slice(hashes, bounds, check))

    def border(z: np.ndarray, y: np.ndarray) -> float:
        """Between the two values where the fewest are wrong, in the middle of the widest such gap."""
        order = np.argsort(z)
        z, y = z[order], y[order]
        wrong = np.concatenate(([0], np.cumsum(y == 1))) + np.concatenate((np.cumsum((y == 0)[::-1])[::-1], [0]))
        cuts = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
        gaps = np.concatenate(([0], np.diff(z), [0]))
        best = np.flatnonzero(wrong == wrong.min())
        return float(cuts[best[np.argmax(gaps[best])]])

    overall = border(z, labels[check])
    model.borders[:] = overall
    for k in range(len(names)):
        own = said == k
        if (labels[check][own] == 1).sum() >= CALIBRATED and (labels[check][own] == 0).sum() >= CALIBRATED:
            model.borders[k] = border(z[own], labels[check][own])
    model.scale = float(4 / max(0.5, np.abs(z - overall).mean()))
    return model


def sample(docs: DataFrame, labels: DataFrame, allowed: Column, per_label: int = MAX_TRAIN) -> DataFrame:
    """text, y, lang of at most ``per_label`` documents of each label, drawn by hash of the id: one
    partition in the order of that hash. The ids drawn are bounded by 2 * per_label."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(allowed).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    drawn = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), column_or_null(docs, "lang", "string").alias("lang")).where("text is not null")
    one = F.min_by(F.struct("text", "lang", "y"), F.xxhash64("text", "lang")).alias("one")  # whatever an id's number of rows
    return rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(one).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("one.text", "one.y", "one.lang")


def trained(rows: DataFrame) -> bytes:
    """The pickled model of a ``sample``, fitted by the task that holds its one partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sample()
        for batch in batches:
            own.add(*(batch.column(i).to_pylist() for i in range(3)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(own))], pa.binary())], names=["model"])

    found = rows.mapInArrow(run, "model binary").first()
    return bytes(found.model) if found else pickle.dumps(None)


def scored(df: DataFrame, text: Column, keys: list[Column], model: bytes, name: str = "score") -> DataFrame:
    """``keys`` and the score under ``name``: one pass, no shuffle. The model has a fixed size and is broadcast."""
    shared, key = df.sparkSession.sparkContext.broadcast(model), ("toxicity", uuid.uuid4().hex)
    source, fields = positional(df, keys, text)
    n, schema = len(fields), StructType([*fields, StructField(name, DoubleType())])
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(key, lambda: pickle.loads(shared.value))
        for batch in batches:
            scores = score_texts(own, batch.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(scores, pa.float64())], names=names)

    return source.mapInArrow(run, schema)
