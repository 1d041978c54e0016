"""Prefix-free parsing of texts into phrases of windows.

A rolling hash over k-grams picks the trigger of every window: its k-gram of least hash. Consecutive windows of one
trigger are a phrase. Equal windows have the same trigger at the same place, so phrases of equal content parse equally
wherever they stand, and windows can only be equal within phrases of equal trigger.
"""

from __future__ import annotations

import numpy as np

from plinth.llm import hashing

TRIGGER_BYTES = 24
#: Low bits of a sort key that hold a position; the rest is hash.
_LOW = np.uint64((1 << 28) - 1)


class Phrases:
    """Phrases of texts laid end to end (together below 256 MB): for each its text, first window, number of windows and
    trigger hash. Positions are those in the joined bytes; starts has where each text begins."""

    def __init__(self, raw: list[bytes], window: int):
        self.window = window
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.cumsum(size) - size
        n, grams = len(self.data), len(self.data) - TRIGGER_BYTES + 1
        spread = window - TRIGGER_BYTES + 1
        empty = np.zeros(0, np.int64)
        self.text = self.first = self.windows = empty
        self.trigger = empty.astype(np.uint64)
        if n < window:
            return
        self.ranges = hashing.Ranges(self.data)
        at = np.arange(grams)
        gram = self.ranges.of(at, at + TRIGGER_BYTES)
        least = gram & ~_LOW | at.astype(np.uint64)
        done = 1
        while done < spread:
            step = min(done, spread - done)
            least = np.minimum(least[: len(least) - step], least[step:])
            done += step
        own = np.flatnonzero(size >= window)
        change = np.zeros(n + 1, np.int32)
        change[self.starts[own]] += 1
        change[self.starts[own] + size[own] - window + 1] -= 1
        valid = np.cumsum(change)[: n - window + 1] > 0
        trigger = (least & _LOW).astype(np.int64)
        fresh = valid & np.concatenate([[True], (trigger[1:] != trigger[:-1]) | ~valid[:-1]])
        fresh[self.starts[own]] = True
        self.first = np.flatnonzero(fresh)
        run = np.cumsum(valid)
        total = np.concatenate([run[self.first[1:]] - 1, run[-1:]]) if len(self.first) else empty
        self.windows = total - run[self.first] + 1 if len(self.first) else empty
        # texts without bytes share their start with the next one, which the right side of the search gives
        self.text = np.searchsorted(self.starts, self.first, "right") - 1
        self.trigger = gram[trigger[self.first]]
