"""Token counts of sections from one encoding of the whole document.

A document is encoded once; token lengths in bytes give every token's span. Sections (lines, by default) have spans of the
same bytes; both lists are ordered, so the interval join of tokens and sections is a binary search of boundaries. A token
that crosses a boundary goes to one section by RULES: ``start`` (the section of its first byte), ``end`` (of its last) or
``largest`` (that holds most of its bytes, the earlier at a tie). Counts of sections add up to the document's.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

RULES = ("start", "end", "largest")
#: White space of the pattern, and the length of a run of it that is encoded by itself: the pattern's search backs off over a
#: run place by place and fails at about a million. What is returned does not depend on this length.
_SPACE, LONG_RUN = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000", 100_000
_HELD: dict = {}
_OUT = "doc_id long, section long, start long, n_bytes long, n_tokens long, n_crossing long, doc_tokens long"


class Encoder:
    """A byte-level BPE from a file of ranks, with the length of every token."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        """The tokens of a text. A long run of white space before a word is one token sequence but for its last character,
        which the pattern gives to what follows."""
        parts, at = [], 0
        for run in re.finditer(f"[{_SPACE}]{{{LONG_RUN},}}", text) if len(text) >= LONG_RUN else ():
            end = run.end() - (run.end() < len(text))
            parts += [self.encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()), self.encoding._encode_single_piece(text[run.start() : end])]
            at = end
        parts.append(self.encoding.encode_to_numpy(text[at:], disallowed_special=()))
        return np.concatenate([np.asarray(x, np.uint32) for x in parts])

    def ends(self, text: str) -> np.ndarray:
        """Byte position after each token."""
        return np.cumsum(self.lengths[self.ids(text)])


def line_starts(data: bytes) -> np.ndarray:
    """Where lines start; a line keeps its line feed, and an empty text is one empty line."""
    after = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.concatenate(([0], after[after < len(data)]))


def attribute(ends: np.ndarray, starts: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and tokens that touch it and another section too."""
    n = len(starts)
    begins = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ends) else ends
    first, last = (np.searchsorted(starts, x, side="right") - 1 for x in (begins, ends - 1))
    if rule == "start":
        owner = first
    elif rule == "end":
        owner = last
    else:
        owner = first.copy()
        for i in np.flatnonzero(last > first):
            cuts = np.concatenate(([begins[i]], starts[first[i] + 1 : last[i] + 1], [ends[i]]))
            owner[i] = first[i] + int(np.argmax(np.diff(cuts)))
    step = np.zeros(n + 1, np.int64)
    over = last > first
    np.add.at(step, first[over], 1)
    np.add.at(step, last[over] + 1, -1)
    return np.bincount(owner, minlength=n), np.cumsum(step)[:n]


def section_tokens(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "largest") -> DataFrame:
    """One row per line of each row's whole text: doc_id, section (from 0), start and n_bytes in UTF-8 bytes, n_tokens,
    n_crossing, doc_tokens.

    A null or empty text has one empty section without tokens. Repeated rows give their rows each, null ids are kept, other
    columns are ignored, an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks not in _HELD:
            _HELD[ranks] = Encoder(ranks, pattern)
        for batch in batches:
            parts, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = text.encode()
                starts, ends = line_starts(data), _HELD[ranks].ends(text)
                counts, crossing = attribute(ends, starts, rule)
                n = len(starts)
                parts.append((np.arange(n), starts, np.diff(np.append(starts, len(data))), counts, crossing, np.full(n, len(ends))))
                rows.append(np.full(n, i))
            if parts:
                columns = [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(rows))), *map(pa.array, columns)], names=[c.split()[0] for c in _OUT.split(", ")])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, _OUT)
