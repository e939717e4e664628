"""What the map-file sources leave unread: records outside a box, rows with other attributes, columns that nobody asked for."""

from __future__ import annotations

import operator
from collections.abc import Iterable

from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

#: The columns of a record's own box.
BOX = ("xmin", "ymin", "xmax", "ymax")
BOX_COLUMNS = ", ".join(f"{c} double" for c in BOX)
_COMPARED = {LessThan: operator.lt, LessThanOrEqual: operator.le, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, EqualTo: operator.eq}


class Wanted:
    """The filters that a source keeps by itself: comparisons of the box's columns, and values or beginnings of attributes."""

    def __init__(self) -> None:
        self.box: list[tuple[int, object, float]] = []
        self.values: list[tuple[str, str, tuple]] = []

    def take(self, filters: list[Filter], attributes: set[str]) -> Iterable[Filter]:
        """Keep what can be kept; the rest goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            compared = _COMPARED.get(type(f))
            if name in BOX and compared and isinstance(f.value, (int, float)):
                self.box.append((BOX.index(name), compared, float(f.value)))
            elif name in BOX and isinstance(f, IsNotNull):
                self.box.append((BOX.index(name), operator.eq, None))
            elif name in attributes and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.values.append((name, "in", (f.value,)))
            elif name in attributes and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.values.append((name, "in", tuple(f.value)))
            elif name in attributes and isinstance(f, StringStartsWith):
                self.values.append((name, "starts", (f.value,)))
            elif name in attributes and isinstance(f, IsNotNull):
                self.values.append((name, "there", ()))
            else:
                yield f

    def names(self) -> set[str]:
        return {name for name, _, _ in self.values}

    def row(self, values: dict[str, str | None]) -> bool:
        for name, how, told in self.values:
            value = values[name]
            if value is None or (how == "in" and value not in told) or (how == "starts" and not value.startswith(told[0])):
                return False
        return True

    def inside(self, box: tuple[float, ...] | None) -> bool:
        """Whether a record's box passes; one without a box passes no comparison."""
        return all(box is not None and (limit is None or compared(box[at], limit)) for at, compared, limit in self.box)
