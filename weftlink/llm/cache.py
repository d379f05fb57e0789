"""A cache for pre-tokens."""

from __future__ import annotations


class BoundedCache(dict):
    """``cache[key]`` computes what is missing, and holds ``limit`` computed entries at most.

    Two generations: when the younger is full it becomes the older, and what is asked for again
    moves back, so frequent keys stay. ``keep`` says which keys are worth an entry.
    """

    def __init__(self, compute, limit: int, seed: dict | None = None, keep=None):
        super().__init__(seed or {})
        self.compute, self.half, self.seed, self.keep = compute, max(1, limit // 2), seed or {}, keep
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if self.keep and not self.keep(key):
                return value
        return self._hold(key, value)

    def _hold(self, key, value):
        if len(self) - len(self.seed) >= self.half:
            self.older = dict(self)
            self.clear()
            self.update(self.seed)
        self[key] = value
        return value

    def many(self, keys: list, compute) -> list:
        """Values of ``keys``; ``compute`` takes the distinct missing ones together and gives a list."""
        out = list(map(self.get, keys))
        gaps = [i for i, v in enumerate(out) if v is None]
        lacking = list(dict.fromkeys(keys[i] for i in gaps if keys[i] not in self.older))
        found = dict(zip(lacking, compute(lacking))) if lacking else {}
        older = self.older
        for i in gaps:
            key = keys[i]
            out[i] = value = found[key] if key in found else older[key]
            if not self.keep or self.keep(key):
                self._hold(key, value)
        return out
