"""Folds of the rows of one page, and indexes over its boxes for those that look at what they kept before."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Width and height of a cell, and of a stripe, in pixels.
CELL_W, CELL_H, STRIPE_H = 128, 64, 16


def _turns(t: pa.Table, keys: list[str]) -> list[int]:
    """Rows at which a page begins, and the end."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for k in keys:
        null, v = t[k].is_null().to_numpy(), pc.fill_null(t[k], 0).to_numpy()
        new |= (v[1:] != v[:-1]) | (null[1:] != null[:-1])
    return [0, *(np.flatnonzero(new) + 1).tolist(), t.num_rows]


def by_page(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[pa.Table, list[int]], pa.Table], schema: str) -> DataFrame:
    """fold(rows of whole pages in their order, where each begins and the end) for all pages, many at a time.

    Pages are brought together by sorting each partition by page and order, so that none costs a call of its own; a
    page that fills several batches is put together first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # of one page
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            both = pa.concat_tables([*(h.slice(h.num_rows - 1) for h in held[-1:]), t])
            last = _turns(both, keys)[-2] - (1 if held else 0)  # where the last page of the batch begins
            if last < 0 or not held and last == 0:
                held.append(t)
                continue
            whole = pa.concat_tables([*held, t.slice(0, last)]).combine_chunks()
            held = [t.slice(last)]
            yield from fold(whole, _turns(whole, keys)).to_batches()
        if held:
            whole = pa.concat_tables(held).combine_chunks()
            yield from fold(whole, _turns(whole, keys)).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def boxes_of(t: pa.Table) -> list[tuple]:
    return list(zip(*(t[c].to_pylist() for c in ("x0", "y0", "x1", "y1")), strict=True))


def overlap_share(a: tuple, b: tuple) -> float:
    """Intersection over union of two boxes (x0, y0, x1, y1), areas counted as 1 at least."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda x: max(1, (x[2] - x[0]) * (x[3] - x[1]))
    return w * h / (area(a) + area(b) - w * h)


class Cells:
    """Kept boxes by the cells that they touch: a box is compared with those of its own cells only."""

    def __init__(self) -> None:
        self.cells: dict[tuple[int, int], list[tuple]] = {}

    @staticmethod
    def _at(b: tuple):
        for x in range(int(b[0] // CELL_W), int(max(b[0], b[2]) // CELL_W) + 1):
            for y in range(int(b[1] // CELL_H), int(max(b[1], b[3]) // CELL_H) + 1):
                yield x, y

    def add(self, box: tuple) -> None:
        for c in self._at(box):
            self.cells.setdefault(c, []).append(box)

    def repeats(self, box: tuple, least: float) -> bool:
        """Whether a kept box shares `least` or more with this one."""
        return any(overlap_share(k, box) >= least for c in self._at(box) for k in self.cells.get(c, ()))

    def add_new(self, boxes: list[tuple], least: float) -> list[int]:
        """Places of the boxes that repeat no kept one, nor one before them; these are kept."""
        out = []
        for i, b in enumerate(boxes):
            if not self.repeats(b, least):
                self.add(b)
                out.append(i)
        return out


class Stripes:
    """Growing boxes by the stripes of page height that they touch, numbered in the order in which they were made."""

    def __init__(self, height: float = STRIPE_H) -> None:
        self.height, self.stripes, self.known = max(1.0, height), {}, {}

    def put(self, i: int, y0: float, y1: float) -> None:
        """Box i reaches from y0 to y1, as far as before at least."""
        a, z = int(y0 // self.height), int(max(y0, y1) // self.height)
        was = self.known.get(i)
        for s in range(a, z + 1):
            if was is None or not was[0] <= s <= was[1]:
                self.stripes.setdefault(s, []).append(i)
        self.known[i] = (a, z) if was is None else (min(a, was[0]), max(z, was[1]))

    def near(self, y0: float, y1: float) -> list[int]:
        """Boxes of the stripes from y0 to y1, oldest first."""
        a, z = int(y0 // self.height), int(max(y0, y1) // self.height)
        if z - a > len(self.stripes):
            return sorted(self.known)
        return sorted({i for s in range(a, z + 1) for i in self.stripes.get(s, ())})


def rows_by_y(boxes: list[tuple], page_h: float) -> list[list[int]]:
    """Places of boxes in lines by centre heights: sorted by y0 (equal within 2, then x0), a new line where the centre leaves the last line's by more than a tolerance."""
    med = sorted(max(1, b[3] - b[1]) for b in boxes)[len(boxes) // 2]
    tol = max(4, 0.6 * med, 0.001 * page_h)
    # The comparison is no order over a whole page, so it needs a comparator: no key sorts the same.
    order = sorted(range(len(boxes)), key=cmp_to_key(lambda i, j: boxes[i][1] - boxes[j][1] if abs(boxes[i][1] - boxes[j][1]) > 2 else boxes[i][0] - boxes[j][0]))
    out, top, low = [], 0.0, 0.0
    for i in order:
        if not out or abs((boxes[i][1] + boxes[i][3]) / 2 - (top + low) / 2) > tol:
            out.append([])
            top, low = boxes[i][1], boxes[i][3]
        top, low = min(top, boxes[i][1]), max(low, boxes[i][3])
        out[-1].append(i)
    return out
