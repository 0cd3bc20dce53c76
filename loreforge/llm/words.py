"""Hashes of words, remembered within a task."""

from __future__ import annotations

KEPT = 500_000  # words a task remembers


class Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h
