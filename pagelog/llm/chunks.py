"""Cutting texts at places that no tokenizer piece crosses, and bounded tables of what each distinct chunk becomes.

A table lives in a Python worker and is dropped when it outgrows its bound; it only ever saves work, since any chunk can be
worked out again. Executors that are lost lose nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

MARK = "▁"
#: Bytes that each half of a table holds, and what an entry takes besides its contents.
HELD, ENTRY = 32 << 20, 190
#: Longer chunks are worked out anew each time.
LONG = 256


class Table:
    """Chunk -> value, never None; ``work`` gets the missing chunks of a batch at once, each distinct one once.

    It has two halves of bounded size: when the new half is full, it replaces the old one, and what is still asked for moves
    over. ``weigh`` tells the bytes of a value.
    """

    def __init__(self, work: Callable[[list[str]], Iterable], held: int = HELD, weigh: Callable[[object], int] = lambda v: 24):
        self.work, self.held, self.weigh, self.size, self.new, self.old = work, held, weigh, 0, {}, {}

    def of(self, parts: list[str]) -> list:
        """The value of each chunk, by position."""
        out = list(map(self.new.get, parts))
        gone = [k for k, v in enumerate(out) if v is None]
        if not gone:
            return out
        missing = list(dict.fromkeys([parts[k] for k in gone]))
        found = list(map(self.old.get, missing))
        fresh = iter(self.work([p for p, v in zip(missing, found) if v is None]))
        made = {p: next(fresh) if v is None else v for p, v in zip(missing, found)}
        for k in gone:
            out[k] = made[parts[k]]
        for lo in range(0, len(missing), 512):
            if self.size >= self.held:
                self.old, self.new, self.size = self.new, {}, 0
            some = {p: made[p] for p in missing[lo : lo + 512] if len(p) <= LONG}
            self.new.update(some)
            self.size += ENTRY * len(some) + sum(map(len, some)) + sum(map(self.weigh, some.values()))
        return out


_RUN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def marked(text: str) -> list[str]:
    """Chunks of a text whose spaces become marks, with one mark before the text: cut before each run of marks, and at \\n.

    A chunk is written without its leading mark; one that follows a line break starts with \\n and stands for the break and
    what follows it, unmarked. Chunks that hold further marks are written in full, starting with a mark. The pieces must
    not hold \\n, nor a mark after another character.
    """
    if not text:
        return []
    parts = text.replace("\n", " \n").split(" ")
    if "" in parts or MARK in text:
        return _RUN.findall(MARK + text.replace(" ", MARK))
    return parts
