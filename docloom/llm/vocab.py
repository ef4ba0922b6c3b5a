"""Cutting texts into pieces whose tokens don't depend on their neighbours, with memos."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
MEMO_ENTRIES = 500_000
MEMO_CHARS = 64

# A space that follows white space belongs to a longer run, which is one token or more.
_RUN = re.compile(r"\s(?= )")
_SAFE = re.compile(r"(?<=\S) ")


def safe_pieces(text: str) -> list[str]:
    """Split ``text`` at spaces that follow a visible character.

    Every piece but the first stands for a space and itself. No pre-tokenizer
    pattern used here lets a token run from a visible character into a space,
    so pieces may be encoded alone.
    """
    return text.split(" ") if _RUN.search(text) is None else _SAFE.split(text)


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of ``column`` each; freed memory goes back to the system at the end."""
    col = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
    release()


def release() -> None:
    """Give freed memory back: a Python worker lives on through all stages of a job, beside others on its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


class Recent(dict):
    """A memo of ``make`` in two generations: what was not asked for since the last turn is forgotten."""

    def __init__(self, make: Callable[[str], tuple], entries: int):
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: str) -> tuple:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_CHARS:
            self[key] = value
        return value

    def all(self, keys: list[str]) -> list[tuple]:
        """The values of ``keys``; those of long keys are made anew each time."""
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()
        return list(map(self.__getitem__, keys))
