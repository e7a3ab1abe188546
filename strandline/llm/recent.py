"""A dictionary of bounded size for Python workers."""

from __future__ import annotations


class Recent:
    """Keeps what was asked for lately: half of ``size`` keys, and those of the turn before that were asked for again.

    With words of a corpus, most of which are rare, nearly all repeated look-ups find their key.
    """

    def __init__(self, size: int):
        self.half = size // 2
        self.new: dict = {}
        self.old: dict = {}

    def missing(self, keys: set, turn: bool = True) -> set:
        """The keys that it doesn't hold; the others are in ``new`` at least until the next call with ``turn``."""
        if turn and len(self.new) + len(keys) > self.half:
            self.old, self.new = self.new, {}
        left = keys.difference(self.new)
        again = left.intersection(self.old)
        self.new.update((k, self.old[k]) for k in again)
        return left - again
