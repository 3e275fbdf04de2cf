"""A bounded cache of words that keeps the ones that come again."""

from __future__ import annotations


class Cache:
    """Two generations of at most ``entries`` words: when the new one is full it becomes the old one,
    and words that are asked for again move over. ``now`` is the dict to look words up in."""

    def __init__(self, entries: int):
        self.entries, self.now, self.old = entries, {}, {}

    def unknown(self, words: set) -> list:
        """Those of ``words`` that ``now`` must still be given; the others are in it afterwards."""
        now, old, out = self.now, self.old, []
        lack = words.difference(now)
        if lack and len(now) + len(lack) > self.entries and now:
            self.old, self.now = old, now = now, {}
            lack = words
        for w in lack:
            if (v := old.get(w)) is None:
                out.append(w)
            else:
                now[w] = v
        return out
