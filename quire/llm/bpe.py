"""Normalising and pre-splitting for a word-end BPE tokenizer file, vectorised.

The library itself stays the judge: the class of every code point (letter, number, space,
other) and its lower case are read from the library's own normaliser and pre-tokenizer the
first time a code point is seen, and texts with anything out of the ordinary (not in
composed form, odd lower case) are normalised by the library.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from tokenizers import Tokenizer

LETTER, NUMBER, OTHER, SPACE, UNSEEN, ODD = 0, 1, 2, 3, 4, 8


class Splitter:
    """Turns texts into code points and finds the pre-tokens in all of them at once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.classes = np.full(0x110000, UNSEEN, np.uint8)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _learn(self, points: np.ndarray) -> None:
        pre, norm = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.normalizer.normalize_str
        for p in points:
            c = chr(p)
            inside = pre(f"a{c}a")
            if len(inside) == 1:
                kind = LETTER
            elif len(inside) == 2:
                kind = SPACE
            else:
                kind = OTHER if len(pre(f"!{c}!")) == 1 else NUMBER
            lower = norm(c)
            self.classes[p] = kind | (ODD if lower != (" " if kind == SPACE else c.lower()) or c in "Σİ" else 0)

    def kinds(self, points: np.ndarray) -> np.ndarray:
        k = self.classes[points]
        if (new := points[k == UNSEEN]).size:
            self._learn(np.unique(new))
            k = self.classes[points]
        return k

    def normal(self, text: str) -> str:
        """As the library's normaliser gives it, up to which white space stands for a space."""
        if text.isascii():
            return text.lower()
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        if unicodedata.is_normalized("NFC", text) and not (self.kinds(points) & ODD).any():
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text)

    def parts(self, text: str) -> list[str | None]:
        """Normalised stretches between special strings; None stands for one of these."""
        if not any(s in text for s in self.specials):
            return [self.normal(text)]
        out: list[str | None] = []
        while text:
            found = [(at, -len(s), s) for s in self.specials if (at := text.find(s)) >= 0]
            if not found:
                out.append(self.normal(text))
                break
            at, _, s = min(found)
            if at:
                out.append(self.normal(text[:at]))
            out.append(None)
            text = text[at + len(s) :]
        return out

    def pretokens(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and after-last positions of the pre-tokens in normalised texts laid end to end.

        Letters and others form runs, a number stands alone, white space falls away, and an
        apostrophe that begins a pre-token takes s, t, re, ve, m, ll or d with it.
        """
        n = len(points)
        k = self.kinds(points) & 3
        begin = np.ones(n + 1, bool)
        if n:
            begin[1:n] = (k[1:] != k[:-1]) | (k[1:] == NUMBER)
            begin[offsets] = True
            quotes = np.flatnonzero((points == 0x27) & begin[:n])
            if len(quotes):
                after = np.concatenate([points, np.zeros(3, points.dtype)])
                edge = np.zeros(n + 4, bool)
                edge[offsets] = True
                one, two = after[quotes + 1], after[quotes + 2]
                single = np.isin(one, [ord(c) for c in "stmd"]) & ~edge[quotes + 1]
                double = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
                double &= ~edge[quotes + 1] & ~edge[quotes + 2]
                for hit, size in ((single, 2), (double, 3)):
                    q = quotes[hit]
                    begin[q + 1] = False
                    begin[q + size] = True
        at = np.flatnonzero(begin)
        first, last = at[:-1], at[1:]
        real = k[first] != SPACE
        return first[real], last[real]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts laid end to end, and the offsets of the texts."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets
