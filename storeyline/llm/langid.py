"""Language by hyperdimensional profiles.

Every letter, that is every code point, has a random vector of +1 and -1 of its own, made from its
number when it is first met. A trigram's vector binds its letters: the product of the first letter's
vector permuted twice, the second's permuted once and the third's; what is between words is a symbol
too. A document bundles, that is adds, the vectors of its trigrams; a language's prototype bundles
those of its training documents. A document gets the language whose prototype has the largest cosine
with it.

Training documents are bundled on the executors, ``DIM`` numbers a task and language, and these are
added up; only the prototypes reach the driver. Every language is learned. Training uses about
``max_train`` documents, drawn by hash of the id, and one of each language at least; prediction reads
every text whole.

Defined results: ``und`` with score 0 where a text is null or has no letter; ties go to the
language that sorts first; without any training document all are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from storeyline.llm import textcodes
from storeyline.llm.common import held, positional, written

DIM = 1024
SEED = 20_001
#: Trigrams and letters whose vectors a worker keeps, the first it meets; those of others are made anew.
GRAMS, LETTERS = 20_000, 20_000
_BITS = 21


def trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct trigrams, 21 bits a letter, and their counts; those within three gaps are none."""
    letters, starts = textcodes.folded(texts)
    s = letters.astype(np.int64)
    codes = (s[:-2] << 2 * _BITS) | (s[1:-1] << _BITS) | s[2:]
    for i in range(len(texts)):
        own = codes[starts[i] : starts[i + 1]]
        own = np.sort(own[own > 0])
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, int)
        yield own[at], np.diff(np.append(at, len(own)))


class Space:
    """The vectors of letters and trigrams, made when first met."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.keys, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vectors = np.empty((1024, dim), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if (v := self.letters.get(code)) is None:
            v = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
            if len(self.letters) < LETTERS:
                self.letters[code] = v
        return v

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of trigrams."""
        mask = (1 << _BITS) - 1
        out = None
        for shift, turn in ((2 * _BITS, 2), (_BITS, 1), (0, 0)):
            codes, which = np.unique((grams >> shift) & mask, return_inverse=True)
            v = np.stack([np.roll(self.letter(int(c)), turn) for c in codes])[which]
            out = v if out is None else out * v
        return out

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, grams)
        known = np.zeros(len(grams), bool)
        near = at < len(self.keys)
        known[near] = self.keys[at[near]] == grams[near]
        weights = counts.astype(np.float32)
        out = weights[known] @ self.vectors[self.rows[at[known]]]
        new = np.flatnonzero(~known)
        for i in range(0, len(new), 2048):
            part = new[i : i + 2048]
            v = self.bound(grams[part]).astype(np.float32)
            out += weights[part] @ v
            if room := GRAMS - len(self.keys):
                made, take = len(self.keys), part[:room]
                while made + len(take) > len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                self.vectors[made : made + len(take)] = v[: len(take)]
                into = np.searchsorted(self.keys, grams[take])
                self.keys, self.rows = np.insert(self.keys, into, grams[take]), np.insert(self.rows, into, np.arange(made, made + len(take)))
        return out


def space(dim: int = DIM, seed: int = SEED) -> Space:
    return held(("langid", dim, seed), lambda: Space(dim, seed))


def profiles(train: DataFrame, text: Column, lang: Column, key: Column, max_train: int = 24_000) -> tuple[list[str], np.ndarray]:
    """(languages in order, unit prototypes) from rows with a language."""
    rows = train.select(text.cast("string").alias("t"), lang.cast("string").alias("l"), F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 40)).alias("h")).where("l is not null")
    # the first by hash is drawn always: every language with a text has a prototype
    least = F.min(F.when(F.col("t").rlike(r"\p{L}"), F.struct("h", F.xxhash64("t").alias("ht")))).alias("least")
    langs = written(rows.groupBy("l").agg(F.count("*").alias("n"), least))
    whole = langs.agg(F.sum("n").alias("n"), F.count("*").alias("langs")).first()
    if not whole.langs:
        return [], np.zeros((0, DIM), np.float32)
    share = min(1.0, max_train / whole.n)
    rate = F.least(F.lit(1.0), F.greatest(F.lit(share), F.lit(max_train / (8 * whole.langs)) / F.col("n")))
    langs = langs.select("l", (rate * (1 << 40)).cast("long").alias("keep"), "least")

    def bundled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = space(), {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["l", "v"])

        for batch in batches:
            for (grams, counts), k in zip(trigrams(batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True):
                if k not in sums and len(sums) == 256:
                    yield out()
                    sums.clear()
                v = own.bundle(grams, counts).astype(float) / max(1.0, np.sqrt((counts.astype(float) ** 2).sum()))
                sums[k] = sums[k] + v if k in sums else v
        if sums:
            yield out()

    drawn = rows.join(F.broadcast(langs), "l").where((F.col("h") < F.col("keep")) | F.coalesce(F.struct("h", F.xxhash64("t").alias("ht")) == F.col("least"), F.lit(False)))
    parts = drawn.select("t", "l").mapInArrow(bundled, "l string, v array<double>").select("l", F.posexplode("v").alias("i", "x"))
    whole = parts.groupBy("l", "i").agg(F.round(F.sum("x"), 6).alias("x")).groupBy("l").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    made = sorted(((r.l, np.array(r.v)) for r in whole.toLocalIterator()), key=lambda x: x[0])
    return [k for k, _ in made], np.array([v / max(1e-9, float(np.linalg.norm(v))) for _, v in made], np.float32).reshape(-1, DIM)


def predict(df: DataFrame, text: Column, keys: list[Column], learned: tuple[list[str], np.ndarray]) -> DataFrame:
    """``keys`` with lang_pred and score, the cosine with that prototype (negative ones as 0)."""
    langs, prototypes = learned
    source, fields = positional(df, keys, text)
    n, schema = len(fields), StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = space()
        for batch in batches:
            said, scores = [], []
            for grams, counts in trigrams(batch.column(n).to_pylist()):
                v = own.bundle(grams, counts) if len(grams) and langs else None
                if v is None:
                    said.append("und")
                    scores.append(0.0)
                    continue
                near = prototypes @ v / max(1e-9, float(np.linalg.norm(v)))
                best = int(np.argmax(near))
                said.append(langs[best])
                scores.append(float(min(1.0, max(0.0, near[best]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=names)

    return source.mapInArrow(run, schema)
