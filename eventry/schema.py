"""Names of the columns that an ordered event table has."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventSchema:
    """``order`` must be a total order inside ``group``: it ends in a unique column."""

    group: str = "game"
    period: str = "period"
    sequence: str = "seq"
    id: str = "id"
    time: str = "t"
    type: str = "type"
    team: str = "team"
    player: str = "player"
    x: str = "x"
    y: str = "y"
    order: tuple[str, ...] = field(default=("period", "t", "id"))

    def window(self, *extra: str, descending: bool = False) -> WindowSpec:
        keys = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(self.group, *extra).orderBy(*keys)

    def in_period(self, **kw) -> WindowSpec:
        return self.window(self.period, **kw)

    def in_sequence(self, **kw) -> WindowSpec:
        return self.window(self.sequence, **kw)


DEFAULT = EventSchema()
