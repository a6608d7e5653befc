"""Token counts by a tokenizer compiled to a finite-state transducer.

A deterministic transducer reads the bytes of a normalised text; each transition carries the
number of tokens that it adds.  Byte-pair encoding fits because the last token of a prefix's
encoding fixes the encoding: a state is the set of places where a vocabulary entry may still
be under way, each with the last token before it and its count against the newest place,
together with the pre-token that is being read.  Two prefixes with the same set are one
state, so states are few and are compiled when first reached; the table is rebuilt when it
outgrows ``MAX_STATES``.

Texts are cut into chunks of ``CHUNK`` bytes, and each chunk becomes a map from entry state to
(exit state, count).  All chunks run side by side, one table lookup for all of them per byte.
A map is kept for the entry states that can arise: first the one that the ``LOOK`` bytes
before the chunk lead to, then, until nothing is missing, every exit of the chunk before.
States forget what lies further back, so maps stay small.  A prefix scan composes the maps by
doubling, which gives each chunk's true entry state and count with or without white space.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.bpe import LETTER, NUMBER, OTHER, SPACE, Splitter, code_points
from quire.llm.shared import tidy
from quire.llm.text import slices

CHUNK, LOOK = 256, 32
#: Bytes of the chunks that are mapped at a time, which bounds the states that come new meanwhile.
GROUP = 1 << 18
#: States, and pairs of tokens known to fit, beyond which the table is compiled anew.
MAX_STATES, MAX_PAIRS = 400_000, 1_000_000
END = "</w>"


class Merges:
    """Vocabulary and merge rules of the tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.trie: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for t in self.vocab:
            node = 0
            for s in self.symbols(t):
                nxt = self.trie[node].get(s)
                if nxt is None:
                    nxt = self.trie[node][s] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                node = nxt
            self.token[node] = t

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            chars = token[: -len(END)]
            return [*chars[:-1], chars[-1] + END]
        return list(token)

    def encode(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair encoding: the best-ranked pair first, left before right."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def adjacent(self, left: str, right: str) -> bool:
        """May these two tokens follow each other in an encoding?"""
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self.encode(self.symbols(left) + self.symbols(right)) == [left, right]
        return known

    def step(self, places: tuple, symbol: str) -> tuple[tuple, int]:
        """Read one symbol.  places: (trie node, last token, count - newest count), newest last."""
        out, new = [], None
        for node, last, count in places:
            to = self.trie[node].get(symbol)
            if to is None:
                continue
            out.append((to, last, count))
            t = self.token[to]
            if new is None and t is not None and (last == "" or self.adjacent(last, t)):
                new = (0, t, count + 1)
        if new is None:
            raise ValueError(f"no encoding reaches {symbol!r}")
        added = new[2]
        return tuple((n, last, c - added) for n, last, c in [*out, new]), added


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [chars[b] for b in range(256)]


FRESH = ((0, "", 0),)
#: What follows an apostrophe into one pre-token: first byte to the whole.
SHORT = {"s": ("s",), "t": ("t",), "m": ("m",), "d": ("d",), "r": ("re",), "v": ("ve",), "l": ("ll",)}


class Transducer:
    """The compiled tokenizer.  State 0 is between pre-tokens; symbol 0 changes nothing."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        self.merges = Merges(path)
        self.chars = byte_symbols()
        self.ascii_kinds = (self.splitter.kinds(np.arange(128, dtype=np.uint32)) & 3).tolist()
        self.column = np.zeros(1024, np.int32)  # symbol to table column
        self.columns = 1
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {("start",): 0}
        self.states: list[tuple] = [("start",)]
        self.next = np.full((1024, 64), -1, np.int32)
        self.emit = np.zeros((1024, 64), np.int8)
        self.next[:, 0] = np.arange(1024)
        for c in range(1, self.columns):
            self._room(0, c)

    # A symbol is a byte below 256; lead bytes of numbers and others get their own (256.., 512..).
    def symbols(self, points: np.ndarray, data: np.ndarray) -> np.ndarray:
        kinds = self.splitter.kinds(points) & 3
        sym = data.astype(np.int32)
        lead = (data & 0xC0) != 0x80
        of = kinds[np.cumsum(lead) - 1]
        sym[lead & (of == SPACE)] = 32
        drop = ~lead & (of == SPACE)
        high = lead & (data >= 0x80)
        sym[high & (of == NUMBER)] += 256
        sym[high & (of == OTHER)] += 512
        sym[drop] = 1023
        new = np.unique(sym[self.column[sym] == 0])
        for s in new:
            self.column[s] = self.columns
            self.columns += 1
            self._room(len(self.states) - 1, self.columns - 1)
        self.by_column = np.flatnonzero(self.column)
        self.by_column = self.by_column[np.argsort(self.column[self.by_column])]
        return self.column[sym]

    def _room(self, state: int, column: int) -> None:
        rows, cols = self.next.shape
        if state >= rows or column >= cols:
            more = (rows + (rows // 2 if state >= rows else 0), cols + (32 if column >= cols else 0))
            grown, emitted = np.full(more, -1, np.int32), np.zeros(more, np.int8)
            grown[:rows, :cols], emitted[:rows, :cols] = self.next, self.emit
            grown[:, 0] = np.arange(more[0])
            self.next, self.emit = grown, emitted

    # States: ("start",) | ("run", kind, places, pending byte, bytes missing) | ("quote", letter read or "")
    def _kind(self, symbol: int) -> int:
        if symbol >= 512:
            return OTHER
        if symbol >= 256:
            return NUMBER
        if symbol >= 128:
            return LETTER
        return self.ascii_kinds[symbol]

    def _finish(self, places: tuple, pending: int) -> int:
        return self.merges.step(places, self.chars[pending] + END)[1]

    def _word(self, text: str) -> int:
        s = self.merges.symbols(text + END)
        return len(self.merges.encode(s))

    def _open(self, symbol: int) -> tuple:
        byte, kind = symbol & 255, self._kind(symbol)
        if symbol == 0x27:
            return ("quote", "")
        missing = 0 if byte < 0xC0 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
        return ("run", kind, FRESH, byte, missing)

    def _go(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        if symbol == 1023:  # the rest of a wide space
            return state, 0
        if state[0] == "start":
            return (state, 0) if symbol == 32 else (self._open(symbol), 0)
        if state[0] == "quote":
            held = state[1]
            letter = chr(symbol) if symbol < 128 else ""
            if not held:
                if letter in SHORT and letter:
                    whole = SHORT[letter][0]
                    return (("start",), self._word("'" + whole)) if len(whole) == 1 else (("quote", letter), 0)
                if symbol != 32 and self._kind(symbol) == OTHER:  # an ordinary run that begins with the apostrophe
                    return self._go(("run", OTHER, FRESH, 0x27, 0), symbol)
                to, n = self._go(("start",), symbol)
                return to, n + self._word("'")
            if letter and held + letter == SHORT[held][0]:
                return ("start",), self._word("'" + held + letter)
            to, n = self._go(("run", LETTER, FRESH, ord(held), 0), symbol)
            return to, n + self._word("'")
        _, kind, places, pending, missing = state
        if 128 <= symbol < 192:
            places, n = self.merges.step(places, self.chars[pending])
            return ("run", kind, places, symbol, missing - 1), n
        same = symbol != 32 and self._kind(symbol) == kind and kind != NUMBER
        if same:
            places, n = self.merges.step(places, self.chars[pending])
            byte = symbol & 255
            missing = 0 if byte < 0xC0 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
            return ("run", kind, places, byte, missing), n
        n = self._finish(places, pending)
        return (("start",), n) if symbol == 32 else (self._open(symbol), n)

    def _compile(self, states: np.ndarray, columns: np.ndarray) -> None:
        for pair in np.unique(states.astype(np.int64) * 1024 + columns):
            s, c = divmod(int(pair), 1024)
            to, n = self._go(self.states[s], int(self.by_column[c - 1]))
            k = self._number(to, c)
            self.next[s, c], self.emit[s, c] = k, n

    def _number(self, state: tuple, column: int) -> int:
        k = self.ids.get(state)
        if k is None:
            k = self.ids[state] = len(self.states)
            self.states.append(state)
            self._room(k, column)
        return k

    def run(self, cols: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run lanes (start, size) of the column sequence from their states: (end state, tokens)."""
        order = np.argsort(-size, kind="stable")
        at, state, size = start[order].copy(), state[order].copy(), size[order]
        total = np.zeros(len(order), np.int64)
        alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        for n in alive:
            c = cols[at[:n]]
            s = state[:n]
            flat = s.astype(np.int64) * self.next.shape[1] + c
            to = self.next.ravel()[flat]
            if (to < 0).any():
                self._compile(s[to < 0], c[to < 0])
                flat = s.astype(np.int64) * self.next.shape[1] + c
                to = self.next.ravel()[flat]
            total[:n] += self.emit.ravel()[flat]
            state[:n] = to
            at[:n] += 1
        end, counts = np.empty_like(state), np.empty_like(total)
        end[order], counts[order] = state, total
        return end, counts

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each normalised text without special strings."""
        texts = [t + " " for t in texts]  # every text ends between pre-tokens
        points, _ = code_points(texts)
        data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        leads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        offsets = np.append(0, leads[np.cumsum([len(t) for t in texts], dtype=np.int64)])
        cols = self.symbols(points, data)
        # Chunks begin at every text's beginning, and every CHUNK bytes within it.
        per = -(-np.diff(offsets) // CHUNK)
        owner = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        begin = offsets[owner] + nth * CHUNK
        size = np.minimum(begin + CHUNK, offsets[owner + 1]) - begin
        out = np.zeros(len(texts), np.int64)
        state, at = 0, 0
        while at < len(begin):  # in groups; the state at a group's end is carried over
            if len(self.states) > MAX_STATES:
                state = self.restart(state)
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + GROUP)))
            tokens, state = self.scan(cols, begin[at:to], size[at:to], nth[at:to] == 0, state)
            out += np.bincount(owner[at:to], tokens, len(texts)).astype(np.int64)
            at = to
        return out

    def restart(self, state: int) -> int:
        """Forgets the table but for one state; its new number."""
        kept = self.states[state]
        self.clear()
        if len(self.merges.fits) > MAX_PAIRS:
            self.merges.fits.clear()
        return self._number(kept, 0)

    def scan(self, cols: np.ndarray, begin: np.ndarray, size: np.ndarray, fresh: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """(tokens of each chunk, state after the last) of chunks in a row, ``state`` before the first; ``fresh`` ones begin a text."""
        n = len(begin)
        back = np.where(fresh, 0, LOOK)
        entry, _ = self.run(cols, begin - back, back, np.zeros(n, np.int32))
        entry[0] = state
        # The maps as rows (chunk, entry state, exit state, count), in order; one of each pair.
        key, exits, counts = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        new = np.arange(n, dtype=np.int64) << 32 | entry
        while len(new):
            chunk = new >> 32
            end, tokens = self.run(cols, begin[chunk], size[chunk], (new & 0xFFFFFFFF).astype(np.int32))
            key, exits, counts = np.concatenate([key, new]), np.concatenate([exits, end]), np.concatenate([counts, tokens])
            follow = (chunk + 1) << 32 | end
            new = np.setdiff1d(follow[chunk + 1 < n], key)
        order = np.argsort(key)
        key, exits, counts = key[order], exits[order], counts[order]
        follow = ((key >> 32) + 1) << 32 | exits
        jump = np.minimum(np.searchsorted(key, follow), len(key) - 1)  # rows of the last chunk lead nowhere and aren't followed
        row = np.full(n, np.searchsorted(key, state))
        # Composition by doubling: jump leads over 1, 2, 4 ... chunks at once.
        left = np.arange(n)
        while left.any():
            odd = left & 1 == 1
            row[odd] = jump[row[odd]]
            jump = jump[jump]
            left >>= 1
        return counts[row], int(exits[row[-1]])


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def count_tokens(df: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; no shuffle.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows come out as often as they
    go in; other columns are not read.  A text with a special string counts one token for it,
    as the library does by default.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in slices(batches, "text"):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
            for i, x in enumerate(texts):
                for p in t.splitter.parts(x):
                    if p is None:
                        extra[i] += 1
                    else:
                        parts.append(p)
                        owner.append(i)
            if parts:
                extra += np.bincount(owner, t.count(parts), len(texts)).astype(np.int64)
            sizes = [len(x) if x.isascii() else len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(extra), pa.array(extra > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select("doc_id", "text").mapInArrow(tidy(kernel), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
