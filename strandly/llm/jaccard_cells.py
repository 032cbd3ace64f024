"""The recursion of the Jaccard join inside one cell: pivots, Voronoi regions and windows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .components import Sets

U64 = np.uint64
#: Of how many rows of a region one is a pivot at least.
SHARE = 8


class Cell:
    """The sets of one cell in compressed rows. `compared` counts comparisons with pivots and
    `links` those that are links; there is no other way a link is found."""

    def __init__(self, sets: list[np.ndarray], t: tuple[int, int]):
        self.lens = np.array([len(s) for s in sets], np.int64)
        universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat, self.starts = flat.astype(np.int64), np.concatenate([[0], np.cumsum(self.lens)])
        self.flag = np.zeros(len(universe), np.int32)
        self.t, self.r = t, 1 - t[0] / t[1]
        #: A linked set may lack so many members; a prefix is one longer.
        self.prefix = self.lens - -(-self.lens * t[0] // t[1]) + 1
        self.sets = Sets(len(sets))
        self.compared = self.links = 0

    def laid(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.lens[rows]
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        at = np.repeat(self.starts[rows] - starts, lens) + np.arange(int(lens.sum()))
        return self.flat[at], starts

    def against(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        """Distances of a pivot to rows; links found are joined."""
        flat, starts = self.laid(rows)
        own = self.flat[self.starts[pivot] : self.starts[pivot + 1]]
        self.flag[own] = 1
        both = np.add.reduceat(self.flag[flat], starts).astype(np.int64)
        self.flag[own] = 0
        union = self.lens[rows] + self.lens[pivot] - both
        found = rows[both * self.t[1] >= union * self.t[0]].tolist()
        for i in found:
            self.sets.join(pivot, i)
        self.compared += len(rows)
        self.links += len(found)
        return 1 - both / union

    def roots(self, rows: np.ndarray) -> np.ndarray:
        return np.array([self.sets.root(i) for i in rows.tolist()], np.int64)

    def solve(self, rows: np.ndarray) -> None:
        """Finds all links between rows, up to those within a component already found."""
        stack = [np.asarray(rows, np.int64)]
        while stack:
            stack.extend(self.split(stack.pop()))

    def groups(self, rows: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, row) by group: rows whose prefixes share a member. Members are ordered by how
        many of these rows hold them, the rarest first, so what all rows share separates none.
        Groups of one row, or of one component, are left out: linked rows of different components
        share a group."""
        flat, starts = self.laid(rows)
        _, member, count = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(rows)), self.lens[rows])
        order = np.lexsort((member, count[member], owner))
        member, owner = member[order], owner[order]
        keep = (np.arange(len(owner)) - starts[owner] < self.prefix[rows][owner]) & (count[member] > 1)
        member, owner = member[keep], owner[keep]
        order = np.argsort(member, kind="stable")
        member, owner = member[order], owner[order]
        if not len(member):
            return member, owner
        first = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]]))
        several = np.minimum.reduceat(roots[owner], first) < np.maximum.reduceat(roots[owner], first)
        sizes = np.diff(np.concatenate([first, [len(member)]]))
        keep = np.repeat(several, sizes)
        return np.repeat(np.cumsum(several) - 1, sizes)[keep], owner[keep]

    def split(self, rows: np.ndarray) -> list[np.ndarray]:
        """A region's pivots compared with all rows they may link with, and the regions of the others.

        Pivots are a largest set of rows no two of which share a group, so each row meets one, and
        then the rows farthest from theirs, until one of SHARE rows is a pivot. A pivot is compared
        with the rows of its groups; after that it has no links to be found and leaves."""
        if len(rows) < 2:
            return []
        roots = self.roots(rows)
        group, owner = self.groups(rows, roots)
        if not len(group):
            return []
        n = len(rows)
        cuts = np.searchsorted(group, np.arange(group[-1] + 2))
        by = np.argsort(owner, kind="stable")
        held = np.searchsorted(owner[by], np.arange(n + 1))
        nearest, home, pivot = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        known: list[tuple[np.ndarray, np.ndarray]] = []

        def compare(p: int, other: bool) -> None:
            """With the rows of its groups that are no pivots; of other components only, if so."""
            pivot[p] = True
            own = np.unique(np.concatenate([owner[cuts[g] : cuts[g + 1]] for g in group[by[held[p] : held[p + 1]]].tolist()]))
            own = own[~pivot[own] & (roots[own] != roots[p])] if other else own[~pivot[own]]
            if len(own):
                d = self.against(int(rows[p]), rows[own])
                known.append((p * n + own, d))
                closer = d < nearest[own]
                nearest[own[closer]], home[own[closer]] = d[closer], p

        there = np.unique(owner)
        for p in there.tolist():
            if home[p] < 0:
                compare(p, False)
        left = there[~pivot[there]]
        if len(left) < 2 or len(set((roots := self.roots(rows))[left].tolist())) == 1:
            return []
        while pivot.sum() * SHARE < len(there):
            p = int(left[np.argmax(np.where(pivot[left], -1.0, nearest[left]))])
            if pivot[p]:
                break
            compare(p, True)
        left = left[~pivot[left]]
        return [x for x in self.regions(rows, left, group, owner, pivot, home, nearest, known) if len(x) > 1]

    def regions(self, rows: np.ndarray, left: np.ndarray, group: np.ndarray, owner: np.ndarray, pivot: np.ndarray, home: np.ndarray, nearest: np.ndarray, known: list) -> list[np.ndarray]:
        """The Voronoi regions of the pivots, with the rows of other regions that may link into them.

        If s is at home at pivot h and t links with s, both share a group, and by the triangle
        inequality t is at most r farther from h than the farthest row at home there. So t is
        copied into the region of each home in its groups, unless it is known to be beyond that
        window. Regions that would hold most rows, or many rows more than once, are joined as one."""
        n = len(rows)
        stay = ~pivot[owner]
        group, owner = group[stay], owner[stay]
        homes = np.unique(group * n + home[owner])
        several = np.bincount(homes // n, minlength=int(group[-1]) + 1 if len(group) else 1)
        if not len(group) or several[group].sum() > 16 * len(group):
            return [rows[left]]
        first = np.searchsorted(homes // n, group)
        times = several[group]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
        pairs = np.unique(homes[at] % n * n + np.repeat(owner, times))
        radius = np.zeros(n)
        np.maximum.at(radius, home[left], nearest[left])
        keys, d = np.concatenate([k for k, _ in known]), np.concatenate([x for _, x in known])
        order = np.argsort(keys)
        keys, d = keys[order], d[order]
        place = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        beyond = (keys[place] == pairs) & (d[place] > radius[pairs // n] + self.r + 1e-12)
        pairs = pairs[~beyond]
        cuts = np.flatnonzero(np.concatenate([[True], pairs[1:] // n != pairs[:-1] // n, [True]]))
        if 2 * np.diff(cuts).max() > len(left) or 2 * len(pairs) > 3 * len(left):
            return [rows[left]]
        return [rows[pairs[a:b] % n] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def cell_links(t: tuple[int, int]) -> Callable[[pa.Table], pa.Table]:
    """Of rows (cell, key, root, members) links (a, b) that connect what links connect, cell by
    cell; rows of one root are connected already."""

    def run(table: pa.Table) -> pa.Table:
        cells: dict[int, dict[int, tuple[int, np.ndarray]]] = {}
        for cell, key, root, members in zip(table.column("cell").to_pylist(), table.column("key").to_pylist(), table.column("root").to_pylist(), table.column("members"), strict=True):
            cells.setdefault(cell, {}).setdefault(key, (root, np.asarray(members.values).view(U64)))
        a, b = [], []
        for own in cells.values():
            keys = sorted(own)
            cell = Cell([own[k][1] for k in keys], t)
            first: dict[int, int] = {}
            for i, k in enumerate(keys):
                cell.sets.join(first.setdefault(own[k][0], i), i)
            cell.solve(np.arange(len(keys)))
            for i, k in enumerate(keys):
                if (root := cell.sets.root(i)) != i:
                    a.append(k)
                    b.append(keys[root])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run
