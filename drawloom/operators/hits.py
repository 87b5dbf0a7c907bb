"""Conditions on the hits of tickets, written as ``name:least,name:least``.

A name is a zone of the game or a logical group of zones, whose hits are added
up.  What is not understood is an error with the place it stands at; a condition
is never left out silently.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The group of all zones.
TOTAL = "total"


def parse_condition(text: str | None) -> dict[str, int]:
    """Names and least hits, in the order they are named; of a name given twice the larger number holds; nothing asks for nothing."""
    out: dict[str, int] = {}
    for part in (text or "").split(","):
        part = part.strip()
        if not part:
            continue
        name, colon, least = (x.strip() for x in part.partition(":"))
        if not colon:
            raise ValueError(f"a condition is name:least, not {part!r}")
        if not name:
            raise ValueError(f"{part!r} names no zone")
        try:
            number = int(least)
        except ValueError:
            raise ValueError(f"{least!r} in {part!r} is no whole number") from None
        if number < 0:
            raise ValueError(f"{part!r} asks for fewer than 0 hits")
        out[name] = max(number, out.get(name, 0))
    return out


def describe_condition(condition: dict[str, int]) -> str:
    """A condition in words."""
    return " and ".join(f"{name} >= {least}" for name, least in condition.items()) or "any"


class Game:
    """The zones of a game, each with the column of its hits, and its logical groups of zones."""

    def __init__(self, zones: dict[str, str], groups: dict[str, list[str]] | None = None, choose: dict[str, int] | None = None):
        strange = {z for members in (groups or {}).values() for z in members} - set(zones)
        if strange:
            raise ValueError(f"no such zones: {sorted(strange)}")
        self.zones, self.groups, self.choose = zones, {TOTAL: list(zones), **(groups or {})}, choose or {}

    def names(self) -> list[str]:
        """All names a condition may use: the total, the zones, the groups."""
        return list(dict.fromkeys([TOTAL, *self.zones, *self.groups]))

    def hits(self, name: str) -> Column:
        """The hits of a zone or group; a zone without a value has none."""
        members = self.groups.get(name, [name] if name in self.zones else None)
        if members is None:
            raise ValueError(f"no zone {name!r}; there are {', '.join(self.names())}")
        out = F.lit(0)
        for z in members:
            out = out + F.coalesce(F.col(self.zones[z]), F.lit(0))
        return out

    def condition(self, text: str | None) -> Column:
        """Whether a ticket meets all parts of a condition."""
        ok = F.lit(True)
        for name, least in parse_condition(text).items():
            ok = ok & (self.hits(name) >= least)
        return ok

    def choices(self) -> list[str]:
        """The conditions on the total that some ticket can meet."""
        return [f"{TOTAL}:{n}" for n in range(1, sum(self.choose.get(z, 1) for z in self.zones) + 1)]


def condition_of_games(games: dict[str, Game], text: str | None, lottery: str | None = None) -> Column:
    """A condition on tickets of one game, or of all games: then only the total may be asked for, as zones differ."""
    condition = parse_condition(text)
    if lottery is not None:
        if lottery not in games:
            raise ValueError(f"no game {lottery!r}")
        return (F.col("lottery") == lottery) & games[lottery].condition(text)
    zoned = [name for name in condition if name != TOTAL]
    if zoned:
        raise ValueError(f"over all games only {TOTAL} can be asked for, not {', '.join(zoned)}")
    met = F.lit(False)
    for name, game in games.items():
        met = met | ((F.col("lottery") == name) & game.condition(text))
    return met
