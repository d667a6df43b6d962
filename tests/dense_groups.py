"""Independent dense restatement of the equi-depth grouping, for tests only.

Works on a full weight array over all cells (like a tree pre-filled with every
cell), recursing axis by axis; returns {group_id: sorted cell ids}.
"""

from __future__ import annotations

import math


def dense_groups(weights: dict[int, int], splits: list[int], n_groups: int) -> dict[int, list[int]]:
    d = len(splits)
    mult = [math.prod(splits[i + 1:]) for i in range(d)]
    f = float(n_groups) ** (1.0 / d)
    all_cells = range(math.prod(splits))

    def coord(cell: int, i: int) -> int:
        return (cell // mult[i]) % splits[i] if i else cell // mult[0]

    groups: list[list[int]] = []

    def cut(cells: list[int], level: int, parent_target: float) -> None:
        q = parent_target / f
        s = splits[level]
        tot = [0] * (s + 1)
        by_c: list[list[int]] = [[] for _ in range(s)]
        for c in cells:
            k = coord(c, level)
            tot[k] += weights.get(c, 0)
            by_c[k].append(c)
        t, run = 0, []
        for i in range(s):
            t += tot[i]
            run += by_c[i]
            x = tot[i + 1]
            if t > q or (t <= q < t + x and (q - t) < (t + x - q)):
                emit(run, level, q)
                t, run = 0, []
        if t > 0:
            emit(run, level, q)

    def emit(run: list[int], level: int, q: float) -> None:
        if level == d - 1:
            groups.append(sorted(run))
        else:
            cut(run, level + 1, q)

    total = sum(weights.get(c, 0) for c in all_cells)
    cut(list(all_cells), 0, float(total))
    return dict(enumerate(groups))


def box_of(cells: list[int], splits: list[int]) -> list[tuple[int, int]]:
    d = len(splits)
    mult = [math.prod(splits[i + 1:]) for i in range(d)]
    cs = [[(c // mult[i]) % splits[i] for i in range(d)] for c in cells]
    return [(min(x[i] for x in cs), max(x[i] for x in cs)) for i in range(d)]
