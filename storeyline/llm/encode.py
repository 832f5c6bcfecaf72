"""Token ids of whole texts by the tokenizer library, which sees each new word once.

White space is never part of a token and no token crosses it, so a text's ids are its words' ids in
a row. A worker keeps the ids of the first ``MEMO`` words it meets, among which are the frequent
ones. Of the other words of a batch most are letters with a stop behind at most: such letters are one
unit whatever stands beside them, so all that are new go through the library in a few long strings,
whose ids are parted after every token that ends a unit. The rest go through it with a mark, a word
of its own, after each.

Defined results: a null text has no ids; special strings inside a text are one id each, the
library's default.
"""

from __future__ import annotations

import re

import numpy as np

MEMO = 500_000
#: Longer words are not kept.
KEPT_CHARS = 64
#: White space as the tokenizer's normaliser sees it; str.split() also splits at four control characters.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD, _CONTROL = re.compile(f"[^{SPACE}]+"), "\x1c\x1d\x1e\x1f"
_STOPS = frozenset(",.;:!?")
_MARK = "\x01"
_STRING = 1 << 16


def words(text: str) -> list[str]:
    return WORD.findall(text) if any(c in text for c in _CONTROL) else text.split()


class WordIds:
    """Little-endian uint32 ids of texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.largest = max(vocab.values())
        suffix = self.library.model.end_of_word_suffix
        if not suffix:
            raise ValueError("a vocabulary with an end-of-word marker is needed")
        self.ends = np.zeros(self.largest + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        (self.mark,) = self._encoded(_MARK)
        self.stops = {c: self._encoded(c).tobytes() for c in _STOPS}
        self.kept: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _parted(self, fresh: list[str], between: str, parting: np.ndarray, kept: int) -> dict[str, bytes]:
        """The ids of distinct words, each with ``between`` after it; ``parting`` tells which ids end a word,
        of which ``kept`` belong to it."""
        out: dict[str, bytes] = {}
        at = 0
        while at < len(fresh):
            upto, size = at, 0
            while upto < len(fresh) and size < _STRING:
                size += len(fresh[upto])
                upto += 1
            part = fresh[at:upto]
            ids = self._encoded(between.join([*part, ""]))
            raw, cut = ids.tobytes(), ((np.flatnonzero(parting[ids]) + 1) * 4).tolist()
            if len(cut) == len(part):
                out.update(zip(part, [raw[a : b - 4 + 4 * kept] for a, b in zip([0, *cut], cut)], strict=True))
            else:  # letters to Python and not to the library, or a mark inside a word
                out.update((w, self._encoded(w).tobytes()) for w in part)
            at = upto
        return out

    def _new(self, fresh: list[str]) -> dict[str, bytes]:
        """The ids of distinct words."""
        plain: list[str] = []
        runs: list[str] = []
        stops: list[bytes] = []
        others: list[str] = []
        stop_of = self.stops.get
        for word in fresh:
            last = stop_of(word[-1])
            run = word if last is None else word[:-1]
            run = run if "\u03a3" in run else run.lower()  # Python's lower case of a sigma depends on its place
            if run.isalpha():
                plain.append(word)
                runs.append(run)
                stops.append(last or b"")
            else:
                others.append(word)
        letters = self.letters
        known = self._parted(list({run for run in runs if run not in letters}), " ", self.ends, 1)
        out = {word: (known.get(run) or letters[run]) + stop for word, run, stop in zip(plain, runs, stops, strict=True)}
        if others:
            marks = np.zeros(self.largest + 1, bool)
            marks[self.mark] = True
            out |= self._parted(others, f" {_MARK} ", marks, 0)
        if room := MEMO - len(letters):
            letters.update([(run, ids) for run, ids in known.items() if len(run) <= KEPT_CHARS][:room])
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [words(t) if t else [] for t in texts]
        get = self.kept.get
        found = [list(map(get, own)) for own in split]
        holes = [i for i, ids in enumerate(found) if None in ids]
        fresh = self._new(list({w for i in holes for w, ids in zip(split[i], found[i], strict=True) if ids is None}))
        for i in holes:
            found[i] = [fresh[w] if ids is None else ids for w, ids in zip(split[i], found[i], strict=True)]
        if room := MEMO - len(self.kept):
            self.kept.update([(w, ids) for w, ids in fresh.items() if len(w) <= KEPT_CHARS][:room])
        return [b"".join(ids) for ids in found]
