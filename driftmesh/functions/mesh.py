"""Simplex tables of the regular space-time mesh: each unit cube of n dimensions splits into n! simplices.

Types are ranks among the sorted vertex lists, dimension 0 first and time last. A cell is a
corner (lattice point) and a type. The tables are small constants that a query ships with its closures.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, permutations, product

Vertex = tuple[int, ...]
Simplex = tuple[Vertex, ...]


def subdivide_cube(n: int) -> list[Simplex]:
    """The n! simplices of a unit cube: monotone paths from the zero corner to the one corner."""
    out = set()
    for order in permutations(range(n)):
        at, path = [0] * n, [(0,) * n]
        for axis in order:
            at[axis] = 1
            path.append(tuple(at))
        out.add(tuple(sorted(path)))
    return sorted(out)


def reduce_simplex(simplex: Simplex) -> tuple[Simplex, Vertex]:
    """The simplex moved to its own corner, and that corner."""
    corner = tuple(min(v[d] for v in simplex) for d in range(len(simplex[0])))
    return tuple(sorted(tuple(a - c for a, c in zip(v, corner)) for v in simplex)), corner


@lru_cache
def unit_simplices(n: int, k: int) -> tuple[Simplex, ...]:
    """All k-simplex types of the n-dimensional mesh, in the order of their type ids."""
    if k == n:
        return tuple(subdivide_cube(n))
    found = {reduce_simplex(side)[0] for s in unit_simplices(n, k + 1) for side in combinations(s, k + 1)}
    return tuple(sorted(found))


def is_ordinal(simplex: Simplex) -> bool:
    """Whether all vertices have one time."""
    return all(v[-1] == 0 for v in simplex)


@lru_cache
def sides(n: int, k: int, kind: int) -> tuple[tuple[int, Vertex], ...]:
    """(type, corner offset) of a k-simplex's (k-1)-dimensional sides."""
    types = {s: i for i, s in enumerate(unit_simplices(n, k - 1))}
    got = set()
    for side in combinations(unit_simplices(n, k)[kind], k):
        reduced, corner = reduce_simplex(side)
        got.add((types[reduced], corner))
    return tuple(sorted(got))


@lru_cache
def cofaces(n: int, k: int, kind: int) -> tuple[tuple[int, Vertex], ...]:
    """(type, corner offset) of the (k+1)-simplices that a k-simplex is a side of."""
    if k == n:
        return ()
    got = set()
    for up in range(len(unit_simplices(n, k + 1))):
        for side, corner in sides(n, k + 1, up):
            if side == kind:
                got.add((up, tuple(-c for c in corner)))
    return tuple(sorted(got))


@dataclass(frozen=True)
class Lattice:
    """A box of lattice points, time last; dimension 0 varies fastest in linear ids."""

    starts: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def nd(self) -> int:
        return len(self.sizes)

    def linear(self, point):
        """Linear id of a point, or of arrays of coordinates."""
        out, step = 0, 1
        for x, a, n in zip(point, self.starts, self.sizes):
            out = out + (x - a) * step
            step *= n
        return out

    def point(self, linear):
        out = []
        for a, n in zip(self.starts, self.sizes):
            out.append(linear % n + a)
            linear = linear // n
        return tuple(out)

    def holds(self, point) -> bool:
        return all(a <= x < a + n for x, a, n in zip(point, self.starts, self.sizes))

    def tag(self, corner, kind, k: int):
        return self.linear(corner) * len(unit_simplices(self.nd, k)) + kind

    def untag(self, tag, k: int):
        n = len(unit_simplices(self.nd, k))
        return self.point(tag // n), tag % n

    def split(self, n_parts: int, ghost: int = 0) -> list[tuple[Lattice, Lattice]]:
        """(core, core with ghosts) boxes: prime factors of ``n_parts`` cut the longest spatial axis each."""
        factors, left, p = [], n_parts, 2
        while left > 1:
            while left % p == 0:
                factors.append(p)
                left //= p
            p += 1
        boxes = [self]
        for f in sorted(factors, reverse=True):
            new = []
            for b in boxes:
                axis = max(range(b.nd), key=lambda d: b.sizes[d])
                at = b.starts[axis]
                for part in range(f):
                    n = b.sizes[axis] // f + (part < b.sizes[axis] % f)
                    new.append(
                        Lattice(
                            tuple(at if d == axis else s for d, s in enumerate(b.starts)), tuple(n if d == axis else s for d, s in enumerate(b.sizes))
                        )
                    )
                    at += n
            boxes = new
        out = []
        for b in boxes:
            lo = [max(s, a - ghost) for a, s in zip(b.starts, self.starts)]
            hi = [min(s + n, a + m + ghost) for a, m, s, n in zip(b.starts, b.sizes, self.starts, self.sizes)]
            out.append((b, Lattice(tuple(lo), tuple(h - x for x, h in zip(lo, hi)))))
        return out


def cube_cells(lattice: Lattice):
    """Corners of the unit cubes (the mesh without simplices)."""
    return product(*(range(a, a + n - 1) for a, n in zip(lattice.starts, lattice.sizes)))
