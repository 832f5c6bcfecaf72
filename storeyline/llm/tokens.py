"""Exact token counts of every prefix, by dynamic programming over prefixes.

A byte-pair encoding is valid exactly when each token encodes to itself and each pair of
neighbours encodes to that pair. So the encoding of a prefix is the encoding of a shorter prefix
and one last token, and that token is unique: one table over the prefixes of a word holds the
last token and the count of each. Words are the runs between white space, which the tokenizer
drops and never crosses; the count at any prefix of a text is a running sum over its words plus
one entry of the last word's table. Truncation and budget questions read these tables, nothing is
encoded again.

Defined results: a null text is empty and has 0 tokens; rows keep their multiplicity; strings of
special tokens inside a text are one token each, as the library does by default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from storeyline.llm.common import held, positional
from storeyline.llm.encode import KEPT_CHARS, WORD, words

#: Words whose results a worker keeps, the first it meets, among which are the frequent ones; longer
#: words than ``KEPT_CHARS`` are not kept, so that bytes are bounded too.
MEMO = 400_000
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_STOPS = frozenset(",.;:!?|")
_CONTRACTION = re.compile("'(?:[stmd]|re|ve|ll)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """The token count at every prefix, for vocabularies of words with an end marker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.end:
            raise ValueError("a BPE vocabulary with an end-of-word marker is needed")
        lib = Tokenizer.from_file(path)
        self.normalise, self.pre = lib.normalizer.normalize_str, lib.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = model["vocab"]
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.longest = max(map(len, self.vocab))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.bytes = _byte_alphabet()
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        self.split = {a + b: (a, b) for a, b in reversed(self.rank)}
        #: Tokens that encode to themselves.
        self.own = frozenset(t for t in self.vocab if self._merge(self._symbols(t)) == [t])
        self.units: dict[str, int] = {}
        self.state: dict[str, str] = {}
        self.shown = str.maketrans({i: self.bytes[i] for i in range(256) if self.bytes[i] != chr(i)})
        self.counts: dict[str, int] = {}

    # -- the encoding of short symbol sequences, which decides which tokens may be neighbours

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            head = token[: -len(self.end)]
            return [*head[:-1], head[-1] + self.end]
        return list(token)

    def _merge(self, symbols: list[str]) -> list[str]:
        rank = self.rank
        while len(symbols) > 1:
            best, at = min((rank.get((symbols[i], symbols[i + 1]), 1 << 60), i) for i in range(len(symbols) - 1))
            if best == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _pair_fits(self, a: str, b: str) -> bool:
        """Whether a and b stay apart where they meet: no merge across the border comes before the
        merges that made the parts of a and b which touch it. Undoes those merges, latest first."""
        rank, split, limit = self.rank, self.split, 1 << 60
        made = lambda t: rank[split[t]] if t in split else -1
        while True:
            if rank.get((a, b), 1 << 60) < limit:
                return False
            of_a, of_b = made(a), made(b)
            if of_a < 0 and of_b < 0:
                return True
            if of_a > of_b:
                limit, a = of_a, split[a][1]
            else:
                limit, b = of_b + 1, split[b][0]

    # -- the tables

    def _inner(self, s: str) -> tuple[list[str], list[int]]:
        """For s[:0], s[:1], ..., s, as beginnings of a longer word: the last token and the count."""
        own, longest = self.own, self.longest
        last, count = [""], [0]
        for k in range(1, len(s) + 1):
            for b in range(max(0, k - longest), k):
                t = s[b:k]
                if t in own and (not b or self._remember(last[b], t)):
                    last.append(t)
                    count.append(count[b] + 1)
                    break
            else:
                raise ValueError(f"no encoding of {s[:k]!r}")
        return last, count

    def _remember(self, a: str, b: str) -> bool:
        known = self.fits.get(a)
        if known is None:
            known = self.fits[a] = {}
        if (out := known.get(b)) is None:
            out = self._pair_fits(a, b)
            if self.n_fits < MEMO:
                known[b] = out
                self.n_fits += 1
        return out

    def _last(self, s: str) -> str:
        """The last token of s as a beginning: the same table, kept by prefix for all words, made on demand."""
        if (known := self.state.get(s)) is not None:
            return known
        own, n = self.own, len(s)
        for b in range(max(0, n - self.longest), n):
            t = s[b:]
            if t in own and (not b or self._remember(self._last(s[:b]), t)):
                if len(self.state) < MEMO // 2:
                    self.state[s] = t
                return t
        raise ValueError(f"no encoding of {s!r}")

    def _whole(self, s: str, k: int, last: Callable[[int], str]) -> int:
        """Where the last token of s[:k] as a whole word begins; ``last`` gives that of s[:b] as a beginning."""
        for b in range(max(0, k - self.longest), k):
            t = s[b:k] + self.end
            if t in self.own and (not b or self._remember(last(b), t)):
                return b
        raise ValueError(f"no encoding of {s[:k]!r}")

    def _unit(self, s: str) -> int:
        """The count of one whole unit: one final token and those of the beginning before it."""
        if (known := self.units.get(s)) is not None:
            return known
        if len(s) > 48:  # deep recursion is no option
            last, count = self._inner(s[:-1])
            return count[self._whole(s, len(s), last.__getitem__)] + 1
        last = lambda b: self._last(s[:b])
        k, n = self._whole(s, len(s), last), 1
        while k:
            k -= len(last(k))
            n += 1
        if len(self.units) < MEMO // 2:
            self.units[s] = n
        return n

    def _unit_prefixes(self, s: str, ends: list[int]) -> list[int]:
        """The counts of s[:k] as whole units, for each k of ``ends``; one pass over s."""
        last, count = self._inner(s[:-1])
        return [count[self._whole(s, k, last.__getitem__)] + 1 for k in ends]

    def _word_units(self, word: str) -> Iterator[str | int]:
        """The units of a run without white space; special tokens as their ids."""
        if word[-1:] in _STOPS and (head := word[:-1]).isalpha() and max(head) < "\u0180" and len(low := head.lower()) == len(head) and low.isalpha():
            yield low if low.isascii() else low.encode().decode("latin-1").translate(self.shown)
            yield word[-1]
            return
        if word.isalpha() and max(word) < "\u0180" and len(low := word.lower()) == len(word) and low.isalpha():
            yield low if low.isascii() else low.encode().decode("latin-1").translate(self.shown)
            return
        if "<" in word and self.split_special.search(word):
            at = 0
            for m in self.split_special.finditer(word):
                yield from self._word_units(word[at : m.start()])
                yield self.special[m[0]]
                at = m.end()
            word = word[at:]
        if word.isascii():
            yield from (u if u.isprintable() else self._as_bytes(u) for u in _ASCII.findall(word.lower()))
        else:
            yield from (u for u, _ in self.pre(self.normalise(word)))

    def _as_bytes(self, unit: str) -> str:
        return "".join(self.bytes[b] for b in unit.encode())

    def _word_count(self, word: str) -> int:
        if (known := self.counts.get(word)) is None:
            known = sum(1 if isinstance(u, int) else self._unit(u) for u in self._word_units(word))
            if len(self.counts) < MEMO and len(word) <= KEPT_CHARS:
                self.counts[word] = known
        return known

    def count(self, text: str | None) -> int:
        """The count at the last prefix: the running sum over the words."""
        if not text:
            return 0
        own = words(text)
        found = list(map(self.counts.get, own))
        if None in found:
            return sum(self._word_count(w) if n is None else n for w, n in zip(own, found, strict=True))
        return sum(found)

    def _clusters(self, plain: str) -> list[str]:
        """The shortest pieces of a word that are normalised independently of each other."""
        if self.normalise(plain) == "".join(map(self.normalise, plain)):
            return list(plain)
        out = [plain[0]]
        for c in plain[1:]:
            if not unicodedata.combining(c) and self.normalise(out[-1] + c) == self.normalise(out[-1]) + self.normalise(c):
                out.append(c)
            else:
                out[-1] += c
        return out

    def _normal_prefixes(self, norm: str) -> tuple[list[int], list[int]]:
        """For norm[:0], norm[:1], ..., norm, a normalised run without white space: the counts, and for each
        of them where the last unit of a longer prefix can begin."""
        out, starts, before = [0], [0], 0
        for unit, (a, b) in self.pre(norm):
            chars = norm[a:b]
            if len(chars) > 1 and _CONTRACTION.fullmatch(chars):  # cut, it is a quote and letters
                quote = self._unit(chars[0])
                own = [quote, *(quote + self._unit(chars[1:k]) for k in range(2, len(chars))), self._unit(unit)]
            else:
                own = self._unit_prefixes(unit, np.cumsum([len(c.encode()) for c in chars]).tolist())
            out += [before + n for n in own]
            starts += [a] * len(chars)
            before = out[-1]
        return out, starts

    def _plain_prefixes(self, plain: str) -> list[int]:
        """The counts of plain[:1], plain[:2], ..., of a run without white space and special strings.

        One pass, but for prefixes that end inside a composed letter: each of these takes a pass over
        the unit it ends in, because the letter's beginning has another normal form."""
        if not plain:
            return []
        pieces = self._clusters(plain)
        parts = [self.normalise(p) for p in pieces]
        norm = "".join(parts)
        table, starts = self._normal_prefixes(norm)
        out, at = [], 0
        for piece, part in zip(pieces, parts, strict=True):
            for k in range(1, len(piece)):
                unit = starts[at]
                out.append(table[unit] + sum(self._unit(u) for u, _ in self.pre(norm[unit:at] + self.normalise(piece[:k]))))
            at += len(part)
            out.append(table[at])
        return out

    def _word_prefixes(self, word: str) -> np.ndarray:
        """Counts of word[:1], word[:2], ...; one pass, whatever the length."""
        out, before, at = [], 0, 0
        for m in self.split_special.finditer(word):
            head = m.start() - at
            own = self._plain_prefixes(word[at : m.end() - 1])  # a special string that is cut is plain text
            out += [before + n for n in own]
            before += (own[head - 1] if head else 0) + 1
            out.append(before)
            at = m.end()
        out += [before + n for n in self._plain_prefixes(word[at:])]
        return np.array(out, np.int64)

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """The exact count of text[:0], text[:1], ..., text; one entry per code point and one more."""
        text = text or ""
        out, before, at = np.zeros(len(text) + 1, np.int64), 0, 0
        for m in WORD.finditer(text):
            out[at : m.start() + 1] = before
            table = self._word_prefixes(m[0])
            out[m.start() + 1 : m.end() + 1] = table + before
            before += int(table[-1])
            at = m.end() + 1
        out[at:] = before
        return out

    def longest_prefix(self, text: str | None, budget: int) -> int:
        """Code points in the longest prefix with at most ``budget`` tokens.

        Only the words around the budget are looked into: a word of k code points changes the
        running sum by k tokens at most, so words before the sum comes near the budget are skipped.
        """
        text = text or ""
        best, before = 0, 0
        for m in WORD.finditer(text):
            if before > budget:
                break
            best = m.start()
            n = self._word_count(m[0])
            if before + n <= budget and before + 16 * len(m[0]) <= budget:
                best = m.end()
            else:
                fits = np.flatnonzero(self._word_prefixes(m[0]) + before <= budget)
                if len(fits):
                    best = m.start() + int(fits[-1]) + 1
            before += n
        return len(text) if before <= budget else best


def token_counts(df: DataFrame, text: Column, keys: list[Column], path: str, budgets: list[int] = [], prefixes: bool = False) -> DataFrame:
    """``keys`` with n_bytes, n_tokens, for each budget b ``chars_within_b`` (code points of the
    longest prefix of at most b tokens) and, on request, ``prefix_counts`` (the count at every
    code point). One pass over the rows, no shuffle; memory is one Arrow batch and the memo."""
    source, fields = positional(df, keys, text)
    n, added = len(fields), ["n_bytes", "n_tokens", *(f"chars_within_{b}" for b in budgets)]
    schema = StructType([*fields, *(StructField(a, LongType()) for a in added), *[StructField("prefix_counts", ArrayType(LongType()))] * prefixes])

    every = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(("tokens", path), lambda: PrefixCounter(path))
        for batch in batches:
            texts = batch.column(n).to_pylist()
            ns = [own.count(t) for t in texts]
            columns = [batch.column(i) for i in range(n)]
            columns += [pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(ns, pa.int64())]
            columns += [pa.array([len(t or "") if k <= b else own.longest_prefix(t, b) for t, k in zip(texts, ns, strict=True)], pa.int64()) for b in budgets]
            if prefixes:
                columns.append(pa.array([own.prefix_counts(t).tolist() for t in texts], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=every)

    return source.mapInArrow(run, schema)
