"""A dictionary that computes what it lacks and never outgrows a bound."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """``memo[key]`` is ``fn(key)``; at ``limit`` entries it starts afresh.

    Frequent keys are back within a few rows, so a restart costs little, and
    memory stays bounded however many distinct keys a partition has. Keys
    longer than ``longest`` are computed each time.
    """

    def __init__(self, fn: Callable, limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.fn, self.limit, self.longest = fn, limit, longest

    def __missing__(self, key):
        value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value
