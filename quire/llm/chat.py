"""Chat formatting at the level of tokens, and reading it back.

Each segment of a turn is encoded by itself; reserved ids that no text encodes to are spliced
between them, and the loss mask follows from prefix sums over the segments' lengths.  Control
strings inside texts are escaped, so the written-out form can be read back as well.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import tidy

#: Reserved ids above the vocabulary, and how they are written out.
START, END = 50257, 50258
WRITTEN = {START: "<|im_start|>", END: "<|im_end|>"}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("segments", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def escape(text: str) -> str:
    """One more backslash between ``<`` and ``|``; no control string is left in the result."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"


def _role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def assemble(role: str, text: str, enc: tiktoken.Encoding) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of one turn: start, role line, text, end, line break; the loss is on an assistant's text."""
    parts = [[START], enc.encode_ordinary(_role_line(role)), enc.encode_ordinary(escape(text)), [END], enc.encode_ordinary("\n")]
    edges = np.cumsum([0, *map(len, parts)])
    change = np.zeros(edges[-1] + 1, np.int8)
    if role == "assistant":
        np.add.at(change, edges[[2, 3]], [1, -1])
    return np.concatenate([np.array(p, np.int32) for p in parts]), np.cumsum(change)[:-1].astype(bool)


def written(ids: np.ndarray, enc: tiktoken.Encoding) -> str:
    """Ids as text, reserved ones as their control strings."""
    out, at = [], 0
    for p in [*np.flatnonzero(ids >= START).tolist(), len(ids)]:
        out.append(enc.decode_bytes(ids[at:p].tolist()).decode("utf-8"))
        if p < len(ids):
            out.append(WRITTEN[int(ids[p])])
        at = p + 1
    return "".join(out)


TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a written-out conversation."""
    return [(_role_of(m[1]), unescape(m[2])) for m in TURN.finditer(text)]


#: Rows and bytes of a batch that are Python objects at a time; one longer turn comes alone.
ROWS, BYTES = 512, 1 << 20


def cut_by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``ROWS`` rows and, but for single rows, about ``BYTES`` bytes."""
    todo = [batch.slice(at, ROWS) for at in range(batch.num_rows - batch.num_rows % ROWS, -1, -ROWS)]
    while todo:
        part = todo.pop()
        if part.num_rows > 1 and part.nbytes > BYTES:
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]
        elif part.num_rows:
            yield part


FORMATTED = "conv_id long, turn long, role string, text string, ids array<int>, loss_from int, loss_to int"


def format_turns(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, turn, role, text, ids, loss_from, loss_to) of every turn.

    A conversation is the concatenation of its turns' ids by turn; the loss is on the ids from
    loss_from to before loss_to.  Null roles and texts are empty.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for part in cut_by_size(batch):
                ids, begin, end = [], [], []
                for role, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    own, mask = assemble(role or "", text or "", enc)
                    on = np.flatnonzero(mask)
                    ids.append(own)
                    begin.append(int(on[0]) if len(on) else 0)
                    end.append(int(on[-1]) + 1 if len(on) else 0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["conv_id", "turn", "role", "text", "ids", "loss_from", "loss_to"])

    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.mapInArrow(tidy(kernel), FORMATTED)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the ids alone.

    Ids are decoded and parsed where the rows lie; then each conversation's turns stream by in
    order (turn, then role and text; a null turn first) through running digests, so that a
    conversation of any length needs no more memory than a batch.  Repeated rows are repeated
    turns; rows with a null conv_id are one conversation; an empty table gives none.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for part in cut_by_size(batch):
                roles, texts, losses, chars = [], [], [], []
                for ids, a, b in zip(part.column(2), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    own = ids.values.to_numpy()
                    whole = written(own, enc)
                    ((role, text),) = read_turns(whole)
                    roles.append(role)
                    texts.append(text)
                    losses.append(unescape(written(own[a:b], enc)))
                    chars.append(len(whole))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(losses, pa.string()), pa.array(chars, pa.int64())], ["conv_id", "turn", "role", "text", "loss", "chars"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = digest
        turns = loss = None
        n = lost = chars = 0
        for batch in (part for whole in batches for part in cut_by_size(whole)):
            done = []
            for conv, role, text, own, size in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5)), strict=True):
                if conv != current:
                    if current is not digest:
                        done.append((current, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
                    current, turns, loss, n, lost, chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(own.encode())
                n, lost, chars = n + 1, lost + len(own), chars + size
            if done:
                yield _table(done)
        if current is not digest:
            yield _table([(current, n, turns.hexdigest(), lost, loss.hexdigest(), chars)])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in READ.split(", ")])

    rows = formatted.select("conv_id", "turn", "ids", "loss_from", "loss_to").mapInArrow(tidy(parse), "conv_id long, turn long, role string, text string, loss string, chars long")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(tidy(digest), READ)
