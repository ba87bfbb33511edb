"""Column layout of a table: order, hidden columns, widths."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..constants import LEAST_WIDTH, MOST_WIDTH


def clamp_width(width: float) -> float:
    return max(LEAST_WIDTH, min(MOST_WIDTH, width))


@dataclass
class Layout:
    order: list[str]
    hidden: list[str] = field(default_factory=list)
    widths: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, columns: list[str]) -> Layout:
        return cls(list(dict.fromkeys(columns)))

    @property
    def visible(self) -> list[str]:
        return [c for c in self.order if c not in self.hidden]

    def hide(self, name: str) -> bool:
        """False where the column is unknown, hidden already, or the last one shown."""
        if name not in self.visible or len(self.visible) == 1:
            return False
        self.hidden.append(name)
        return True

    def show(self, name: str) -> bool:
        if name not in self.hidden:
            return False
        self.hidden.remove(name)
        return True

    def toggle(self, name: str) -> bool:
        return self.show(name) if name in self.hidden else self.hide(name)

    def move(self, name: str, to: int) -> None:
        """Puts a column at a place among all columns."""
        if name in self.order:
            self.order.remove(name)
            self.order.insert(max(0, min(to, len(self.order))), name)

    def move_before(self, name: str, other: str | None) -> None:
        """Puts a column in front of another, or last."""
        if name not in self.order or name == other:
            return
        self.order.remove(name)
        self.order.insert(self.order.index(other) if other in self.order else len(self.order), name)

    def resize(self, name: str, width: float) -> None:
        if name in self.order:
            self.widths[name] = clamp_width(width)

    def reset(self, columns: list[str]) -> None:
        self.order, self.hidden, self.widths = list(dict.fromkeys(columns)), [], {}

    def reconcile(self, columns: list[str]) -> None:
        """Follows a new schema: its missing columns go, its new ones come last, at least one is shown."""
        known = dict.fromkeys(columns)
        self.order = [c for c in dict.fromkeys([*self.order, *columns]) if c in known]
        self.hidden = [c for c in dict.fromkeys(self.hidden) if c in known]
        self.widths = {c: w for c, w in self.widths.items() if c in known}
        if self.order and not self.visible:
            self.hidden.remove(self.order[0])

    def select(self, df: DataFrame) -> DataFrame:
        return df.select(*[f"`{c}`" for c in self.visible])
