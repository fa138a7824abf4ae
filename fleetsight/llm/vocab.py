"""Public tokenizers inside Spark tasks, with bounded memory of what was encoded before."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

#: Entries that one memory keeps before it starts anew.
REMEMBERED = 400_000
#: Longer keys are computed again each time.
LONGEST_KEY = 64


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def tokenizer(path: str):
    """The tokenizer of a file, one in each worker process; no truncation or padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Memory(dict):
    """Results of ``make`` by key. Bounded: when full, it forgets everything."""

    def __init__(self, make: Callable, limit: int = REMEMBERED):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST_KEY:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def byte_letters() -> dict[int, int]:
    """Byte value to the letter that stands for it in byte-level vocabularies.

    Printable Latin-1 stands for itself; the other bytes take the letters from 256 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}
