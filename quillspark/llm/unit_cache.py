"""A bounded cache of how short units of text are encoded, for tokenizers that never merge across units."""

from __future__ import annotations

from collections.abc import Callable, Sequence

#: Units kept in a worker, and the longest one that is kept.
MOST_UNITS, LONGEST_UNIT = 400_000, 48


class UnitCache:
    """encode: gives the values of several new units at once. When half of the room is used, what was not asked for
    since the last such moment is forgotten, so common units stay."""

    def __init__(self, encode: Callable[[list[str]], Sequence], most: int = MOST_UNITS):
        self.encode, self.most, self.known, self.older = encode, most, {}, {}

    def values(self, units: list[list[str]]) -> list[list]:
        """The value of every unit in every list."""
        known, older = self.known, self.older
        missing = set().union(*units).difference(known)
        if not missing:
            return [list(map(known.__getitem__, own)) for own in units]
        fresh = {u: older[u] for u in missing.intersection(older)} if older else {}
        new = list(missing.difference(fresh)) if fresh else list(missing)
        known.update(fresh)
        known.update(zip(new, self.encode(new)))
        out = [list(map(known.__getitem__, own)) for own in units]
        for unit in [u for u in new if len(u) > LONGEST_UNIT]:
            del known[unit]
        if len(known) > self.most // 2:
            self.known, self.older = {}, known
        return out

    def flat(self, units: list[str]) -> list:
        """The value of every unit; quicker than values() where most units are known."""
        known, older = self.known, self.older
        out = list(map(known.get, units))
        gaps = [i for i, value in enumerate(out) if value is None]
        if not gaps:
            return out
        missing = dict.fromkeys(units[i] for i in gaps)
        fresh = {u: older[u] for u in missing if u in older} if older else {}
        new = [u for u in missing if u not in fresh]
        known.update(fresh)
        known.update(zip(new, self.encode(new)))
        for i in gaps:
            out[i] = known[units[i]]
        for unit in new:
            if len(unit) > LONGEST_UNIT:
                del known[unit]
        if len(known) > self.most // 2:
            self.known, self.older = {}, known
        return out
