"""Neighbors: all pairs within a cutoff, with or without periodic images, and the k nearest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import minimum_image
from ..storage import stored

#: The most bytes of vectors that are shipped to all executors.
SHIPPED_BYTES = 64_000_000


def wrapped(atoms: DataFrame, cell: list[list[float]], periodic: tuple[bool, bool, bool]) -> DataFrame:
    """atoms with wx, wy, wz, the number of the cell that an atom lies in, counted along the periodic directions, and fx, fy, fz, its place in that cell in shares of the lattice vectors."""
    inverse = np.linalg.inv(np.array(cell, float))
    place = [sum((F.col(c) * F.lit(float(inverse[i, j])) for i, c in enumerate("xyz")), F.lit(0.0)) for j in range(3)]
    numbered = atoms.withColumns({f"w{c}": F.floor(f).cast("int") if p else F.lit(0) for c, f, p in zip("xyz", place, periodic)})
    return numbered.withColumns({f"f{c}": f - F.col(f"w{c}") for c, f in zip("xyz", place)})


def halo(atoms: DataFrame, cell: list[list[float]], periodic: tuple[bool, bool, bool], cutoff: float) -> DataFrame:
    """wrapped() atoms with a row for each image that lies in the cell or within cutoff of its faces, and its shift sx, sy, sz from the atom in the cell: (1 + 2 cutoff / height) ** 3 rows of an atom on average."""
    m = np.array(cell, float)
    volume = abs(np.linalg.det(m))
    for i, (c, p) in enumerate(zip("xyz", periodic)):
        reach = float(cutoff * np.linalg.norm(np.cross(m[(i + 1) % 3], m[(i + 2) % 3])) / volume) * (1 + 1e-9) if p else 0.0
        images = F.sequence(F.ceil(-F.lit(reach) - F.col(f"f{c}")).cast("int"), F.floor(F.lit(1 + reach) - F.col(f"f{c}")).cast("int"))
        atoms = atoms.withColumn(f"s{c}", F.explode(images) if p else F.lit(0))
    return atoms


#: Of a cube and the 26 around it, itself and one of each two that lie opposite one another.
HALF = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)]
ALL = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]


def around(df: DataFrame, cube: list[Column], offsets: list[tuple[int, int, int]], wrap: list[int | None] = (None, None, None)) -> DataFrame:
    """df with a row for each cube cx, cy, cz at one of the offsets, and own: whether it is the cube itself."""
    steps = F.array(*(F.struct(*(F.lit(v).alias(f"o{c}") for c, v in zip("xyz", o))) for o in offsets))
    moved = df.withColumns({f"b{c}": b for c, b in zip("xyz", cube)}).withColumn("o", F.explode(steps))
    at = [F.col(f"b{c}") + F.col(f"o.o{c}") for c in "xyz"]
    out = moved.withColumns({f"c{c}": (v if n is None else F.pmod(v, F.lit(n))).cast("int") for c, v, n in zip("xyz", at, wrap)})
    return out.withColumn("own", (F.col("o.ox") == 0) & (F.col("o.oy") == 0) & (F.col("o.oz") == 0)).drop("o", "bx", "by", "bz")


#: The most atoms of a group that meets whole, whatever the method: cubes would be more rows than its pairs.
SMALL_GROUP = 32


def cubes_of_cell(cell: list[list[float]], periodic: tuple[bool, bool, bool], width: float) -> Column:
    """Whether the cube cx, cy, cz may hold an atom of the cell."""
    m, held = np.array(cell, float), F.lit(True)
    for i, c in enumerate("xyz"):
        if all(periodic[j] or not m[j, i] for j in range(3)):
            low, high = float(np.minimum(m[:, i], 0).sum()), float(np.maximum(m[:, i], 0).sum())
            slack = 1e-6 * (high - low + width)
            held &= F.col(f"c{c}").between(int(np.floor((low - slack) / width)), int(np.floor((high + slack) / width)))
    return held


def both_ways(pairs: DataFrame, keys: list[str], signed: tuple[str, ...], carry: tuple[str, ...]) -> DataFrame:
    """Each pair and its mirror image: ends change places, and the columns signed their sign."""
    there = F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), *(F.col(c).alias(c) for c in signed), *(F.col(f"{e}_{c}").alias(f"{e}_{c}") for c in carry for e in ("src", "dst")))
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), *((F.lit(0) - F.col(c)).alias(c) for c in signed), *(F.col(f"{o}_{c}").alias(f"{e}_{c}") for c in carry for e, o in (("src", "dst"), ("dst", "src"))))
    return pairs.select(*keys, "dist", F.explode(F.array(there, back)).alias("p")).select(*keys, "p.src", "p.dst", "dist", *(f"p.{c}" for c in signed), *(f"p.{e}_{c}" for e in ("src", "dst") for c in carry))


def radius_graph(
    atoms: DataFrame, cutoff: float, cell: list[list[float]] | None = None, periodic: tuple[bool, bool, bool] = (True, True, True),
    self_images: bool = True, method: str = "auto", keys: tuple[str, ...] = ("gid",), wrap: bool = False, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(keys.., src, dst, dist, dx, dy, dz, sx, sy, sz) of ordered pairs with dist < cutoff, in every group of atoms (keys.., node_id, x, y, z).

    carry: columns of atoms that come along as src_<column> and dst_<column>.

    cell: rows are lattice vectors, the same for all groups; None: no images.
    Atoms may lie anywhere: they meet in the cell, and the shifts say between
    which images of the atoms as they are given. self_images: keep pairs of an
    atom with its own images. wrap: bring atoms of a rectangular cell into it
    first. Joins of atoms are never broadcast: their size in files or in a
    stream says little about that in memory. method: "cells" gives each atom the number of a cube of the
    cutoff's width and meets half of the cubes around it, which pays where a
    group fills many cubes, so that groups of SMALL_GROUP atoms at most still
    meet whole; "group" meets all of the group; "auto" compares
    both costs. Each pair is found once and mirrored: between two atoms of the
    cell in one direction, and of images only those on the upper side.
    """
    keys_ = list(keys)
    if wrap and cell is not None:
        atoms = atoms.withColumns({c: F.pmod(F.col(c), F.lit(float(cell[i][i]))) if periodic[i] else F.col(c) for i, c in enumerate("xyz")})
    if method == "auto":
        method = cheaper(atoms, cutoff, keys)
    own = atoms.select(*keys_, "node_id", "x", "y", "z", *carry)
    if cell is None:
        own = own.withColumns({f"w{c}": F.lit(0) for c in "xyz"})
    else:
        own = wrapped(own, cell, periodic)
    m = np.zeros((3, 3)) if cell is None else np.array(cell, float)
    move = lambda i, n: sum((F.col(f"{n}{a}") * F.lit(float(m[j, i])) for j, a in enumerate("xyz") if m[j, i]), F.lit(0.0))
    inside = [F.col(c) - move(i, "w") for i, c in enumerate("xyz")]
    cube_of = lambda columns: [F.floor(v / F.lit(float(cutoff))).cast("int") for v in columns]
    end = lambda df, n, more=(): df.select(*keys_, *more, F.col("node_id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in (*"xyz", *(f"w{c}" for c in "xyz"), *carry)))
    home = [F.col(f"h{c}") for c in "xyz"]

    def meeting(own: DataFrame, by: str) -> DataFrame:
        first = end(own, "src", [v.alias(f"h{c}") for c, v in zip("xyz", cube_of(inside))])
        others = end(own, "dst", [v.alias(f"h{c}") for c, v in zip("xyz", cube_of(inside))])
        on = list(keys_)
        if by == "cells":
            on += ["cx", "cy", "cz"]
            here = around(first, home, HALF).drop("hx", "hy", "hz")
            there = others.withColumns({f"c{c}": F.col(f"h{c}") for c in "xyz"}).drop("hx", "hy", "hz")
            pairs = here.join(there.hint("merge"), on).where(~F.col("own") | (F.col("src") < F.col("dst"))).drop("own", "cx", "cy", "cz")
        else:
            pairs = first.drop("hx", "hy", "hz").join(others.drop("hx", "hy", "hz").hint("merge"), on).where("src < dst")
        pairs = pairs.withColumns({f"s{c}": F.lit(0) for c in "xyz"})
        if cell is None or not any(periodic):
            return pairs
        ghosts = halo(own, cell, periodic, cutoff).where("(sx > 0) OR (sx = 0 AND sy > 0) OR (sx = 0 AND sy = 0 AND sz > 0)")
        at = [x + move(i, "s") for i, x in enumerate(inside)]
        ghosts = end(ghosts, "dst", ["sx", "sy", "sz", *(v.alias(f"h{c}") for c, v in zip("xyz", cube_of(at)))])
        if by == "cells":
            ghosts = around(ghosts, home, ALL).drop("hx", "hy", "hz", "own").where(cubes_of_cell(cell, periodic, cutoff))
            met = first.withColumns({f"c{c}": F.col(f"h{c}") for c in "xyz"}).drop("hx", "hy", "hz").join(ghosts.hint("merge"), on).drop("cx", "cy", "cz")
        else:
            met = first.drop("hx", "hy", "hz").join(ghosts.drop("hx", "hy", "hz").hint("merge"), on)
        return pairs.unionByName(met if self_images else met.where("src <> dst"))

    if method == "cells":
        sizes = own.groupBy(*keys_).agg(F.count("*").alias("__n")).hint("merge")
        small, large = (own.join(sizes.where(which), keys_, "left_semi") for which in (F.col("__n") <= SMALL_GROUP, F.col("__n") > SMALL_GROUP))
        pairs = meeting(small, "group").unionByName(meeting(large, "cells"))
    else:
        pairs = meeting(own, "group")
    # From the atoms in the cell to the atoms as they are given.
    pairs = pairs.withColumns({f"s{c}": (F.col(f"s{c}") + F.col(f"src_w{c}") - F.col(f"dst_w{c}")).cast("int") for c in "xyz"})
    d = {f"d{c}": F.col(f"dst_{c}") + move(i, "s") - F.col(f"src_{c}") for i, c in enumerate("xyz")}
    near = pairs.withColumns(d).withColumn("square", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).where(F.col("square") < cutoff * cutoff)
    found = both_ways(near.withColumn("dist", F.sqrt("square")), keys_, ("dx", "dy", "dz", "sx", "sy", "sz"), carry)
    return found if self_images or cell is None else found.where("src <> dst")


def minimum_image_graph(atoms: DataFrame, cutoff: float, box: tuple[float | None, float | None, float | None], keys: tuple[str, ...] = ("gid",), method: str = "auto") -> DataFrame:
    """(keys.., src, dst, dist, dx, dy, dz): pairs by their nearest image in a rectangular box; None: not periodic that way.

    method "cells" gives each atom the number of a cube, which goes round where
    the box is periodic, and meets half of the cubes around it; that takes a box
    of three cubes or more that way, otherwise all of the group meet, as with
    "group". "auto" compares both costs. Each pair is found once and mirrored.
    """
    d = [F.col(c) - F.col(c + "0") for c in "xyz"]
    d = [minimum_image(v, F.lit(float(b))) if b else v for v, b in zip(d, box)]
    own = atoms.select(*keys, F.col("node_id").alias("src"), *(F.col(c).alias(c + "0") for c in "xyz"))
    other = atoms.select(*keys, F.col("node_id").alias("dst"), "x", "y", "z")
    number = [int(b // cutoff) if b else None for b in box]
    if method == "auto":
        method = cheaper(atoms, cutoff, keys)
    if method == "cells" and all(n is None or n >= 3 for n in number):
        cube = lambda end: [F.floor(F.col(c + end) / F.lit(float(b / n if b else cutoff))).cast("int") for c, b, n in zip("xyz", box, number)]
        here, there = around(own, cube("0"), HALF, number), around(other, cube(""), [(0, 0, 0)], number).drop("own")
        pairs = here.join(there, [*keys, "cx", "cy", "cz"]).where(~F.col("own") | (F.col("src") < F.col("dst")))
    else:
        pairs = own.join(other, list(keys)).where("src < dst")
    near = pairs.select(*keys, "src", "dst", *(v.alias(f"d{c}") for c, v in zip("xyz", d)))
    square = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    near = near.withColumn("square", square).where(F.col("square") < cutoff * cutoff).withColumn("dist", F.sqrt("square"))
    return both_ways(near, list(keys), ("dx", "dy", "dz"), ()).where("src <> dst")


def cheaper(atoms: DataFrame, cutoff: float, keys: tuple[str, ...]) -> str:
    """"cells" or "group", by the number of pairs that a join on each of them looks at."""
    ranges = [F.floor((F.max(c) - F.min(c)) / cutoff) + 1 for c in "xyz"]
    per = atoms.groupBy(*keys).agg(F.count("*").alias("n"), (ranges[0] * ranges[1] * ranges[2]).alias("cells"))
    group, cells = per.agg(F.sum(F.col("n") * F.col("n")), F.sum(27 * F.col("n") * F.col("n") / F.col("cells") + 27 * F.col("n"))).first()
    return "cells" if group is not None and cells < group else "group"


def nearest_of(edges: DataFrame, k: int, keys: tuple[str, ...] = ("gid",), strict: bool = True) -> DataFrame:
    """The k shortest edges into each dst, ranked from 1, ties by src. strict: fail if a dst has fewer."""
    into = Window.partitionBy(*keys, "dst")
    ranked = edges.withColumn("rank", F.row_number().over(into.orderBy("dist", "src")))
    if strict:
        ranked = ranked.withColumn("enough", F.count("*").over(into))
        ranked = ranked.where(F.coalesce(F.assert_true(F.col("enough") >= k, "a node has fewer neighbors than k within the cutoff").isNull(), F.lit(True))).drop("enough")
    return ranked.where(F.col("rank") <= k)


NEAR = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("dist", T.DoubleType())])


#: Pairs that a task compares, and rows that it takes, at most on average.
TASK_PAIRS, TASK_ROWS = 800_000_000, 100_000
#: Pairs that a task which holds a unit compares at most.
UNIT_PAIRS = 3_000_000_000
#: Searches and vectors that a matrix product takes at a time.
SEARCHES, COLUMNS = 512, 4096


def true_at(x: np.ndarray) -> np.ndarray:
    """As np.flatnonzero(x), for booleans of which few are true: eight are looked at at a time."""
    flat = x.reshape(-1)
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    row, column = np.nonzero(flat[:whole].reshape(-1, 8)[eights])
    return np.concatenate([eights[row] * 8 + column, np.flatnonzero(flat[whole:]) + whole])


class Held:
    """Vectors to be searched: products in single precision tell which of them may be near, and only their distances are worked out in full.

    Ties go by ids, so that of equal vectors those of the smallest ids are
    enough: k of them, whichever one id is left out.
    """

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        good = np.isfinite(matrix).all(1)
        seen: dict[bytes, tuple] = {}
        marks = np.ascontiguousarray(matrix).view(np.uint64) @ np.random.default_rng(0).integers(0, 2**64, matrix.shape[1], np.uint64)  # equal where vectors are
        _, of, times = np.unique(marks, return_inverse=True, return_counts=True)
        often = np.flatnonzero(times[of] > k)
        for i in often[np.argsort(ids[often], kind="stable")].tolist():
            key, own = matrix[i].tobytes(), ids[i]
            total, last, same, most = seen.get(key, (0, own, 0, 0))  # rows before, and those of the last id and the most of one before it
            if own != last:
                same, most = 0, max(same, most)
            good[i] &= total - most < k and same < k
            seen[key] = total + 1, own, same + 1, most
        self.ids, self.matrix = (ids, matrix) if good.all() else (ids[good], matrix[good])
        self.sorted = np.sort(self.ids)
        self.middle = self.matrix.mean(0) if len(self.ids) else np.zeros(matrix.shape[1])
        self.scale = float(np.abs(self.matrix - self.middle).max(initial=0)) or 1.0
        double = self.lifted(slice(None))
        self.most = float(np.sqrt(double[:, -1].max(initial=0)))
        self.single = double.astype(np.float32)

    def lifted(self, at: slice) -> np.ndarray:
        """Some of the vectors from their middle, in shares of the largest entry, and their squares behind them."""
        off = (self.matrix[at] - self.middle) / self.scale
        return np.concatenate([off, (off**2).sum(1)[:, None]], 1)

    def nearest(self, own: np.ndarray, x: np.ndarray, k: int, itself: bool, positive: bool, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As nearest_in(); within: distances beyond which nothing is wanted, infinite where none is known."""
        found, far = np.full((len(own), k), -1, np.int64), np.full((len(own), k), np.inf)
        within = np.full(len(own), np.inf) if within is None else within
        for at in range(0, len(own) if len(self.ids) else 0, SEARCHES):
            here = slice(at, at + SEARCHES)
            self._search(own[here], x[here], k, itself, positive, within[here], found[here], far[here])
        return found, far

    def _search(self, own, x, k, itself, positive, best, found, far) -> None:
        off = (x - self.middle) / self.scale
        square = (off**2).sum(1)
        good = square < 1e30  # what lies farther off, or nowhere, is compared with all
        off, square = np.where(good[:, None], off, 0), np.where(good, square, 0)
        size, width = np.sqrt(square), off.shape[1]
        drift = 2.0**-50 * width**0.5 * (1 + np.abs(self.middle).max(initial=0) / self.scale + size)
        lifted = np.concatenate([-2 * off, np.ones((len(x), 1))], 1)
        once = np.searchsorted(self.sorted, own, "right") - np.searchsorted(self.sorted, own) <= 1 if itself else np.ones(len(x), bool)
        for at in range(0, len(self.ids), COLUMNS):
            part = slice(at, at + COLUMNS)
            for kind, unit in (np.float32, 2.0**-24), (np.float64, 2.0**-53):
                rough = lifted.astype(kind) @ (self.single[part] if kind is np.float32 else self.lifted(part)).T
                # More than rounding can do to so many products.
                slack = 4 * (width + 9) * unit * (2 * size * self.most + self.most**2) + 4 * drift * (size + self.most + drift) + 1e-30
                with np.errstate(over="ignore"):
                    edge = np.where(good, (best / self.scale) ** 2 * (1 + 1e-9) - square + slack, np.inf)
                blank, wanted = good & once & np.isinf(edge), k + itself
                if blank.any() and rough.shape[1] >= wanted:
                    low = rough[blank]
                    if positive:
                        low[low + square[blank, None] <= 2 * slack[blank, None]] = np.inf  # perhaps at distance 0
                    edge[blank] = np.partition(low, wanted - 1, 1)[:, wanted - 1] + 2 * slack[blank]
                with np.errstate(over="ignore"):
                    row, column = np.divmod(true_at(rough <= np.nextafter(edge.astype(kind), kind(np.inf))[:, None]), rough.shape[1])
                if len(row) <= 64 * len(x):
                    break  # otherwise double precision tells more of them apart
            if len(row):
                self._settle(own, x, row, column + at, k, itself, positive, found, far)
                best = np.minimum(best, far[:, -1])

    def _settle(self, own, x, row, column, k, itself, positive, found, far) -> None:
        """Puts what is nearer than before of the candidates (row, column) into found and far."""
        away = np.empty(len(row))
        for at in range(0, len(row), 32_768):
            some = slice(at, at + 32_768)
            away[some] = np.sqrt(((self.matrix[column[some]] - x[row[some]]) ** 2).cumsum(1)[:, -1])  # summed in order, so that equal vectors tie in every plan
        ids = self.ids[column]
        kept = np.isfinite(away) & (away <= far[row, -1])
        if itself:
            kept &= ids != own[row]
        if positive:
            kept &= away > 0
        row, ids, away = row[kept], ids[kept], away[kept]
        touched = np.unique(row)
        rows = np.concatenate([np.repeat(touched, k), row])
        ids, away = np.concatenate([found[touched].ravel(), ids]), np.concatenate([far[touched].ravel(), away])
        order = np.lexsort((ids, away, rows))
        place = np.arange(len(order)) - np.searchsorted(rows[order], touched)[np.searchsorted(touched, rows[order])]
        order = order[place < k]
        found[touched], far[touched] = ids[order].reshape(-1, k), away[order].reshape(-1, k)


def nearest_in(own: np.ndarray, x: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, itself: bool, positive: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest rows of matrix to each row of x, a row of k for each, ties by ids; infinite where there are fewer. itself: rows under the asking id don't count; positive: nor do those at distance 0."""
    return Held(ids, matrix, k).nearest(own, x, k, itself, positive)


def _vectors(batch) -> tuple[np.ndarray, np.ndarray]:
    ids, x = batch.column("node_id").to_numpy(), batch.column("x")
    if len(ids) and not x.null_count and not x.values.null_count:
        return ids, x.flatten().to_numpy().reshape(len(ids), -1)
    return ids, np.array(x.to_pylist(), float).reshape(len(ids), -1 if len(ids) else 0)


def _near_batch(own: np.ndarray, found: np.ndarray, far: np.ndarray):
    import pyarrow as pa

    good = np.isfinite(far)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(own, good.sum(1))), pa.array(found[good]), pa.array(far[good])], names=NEAR.names)


class Cells:
    """Vectors dealt into cells around pivots, and cells into units that a task holds.

    Each vector belongs to the nearest pivot. A cell knows how near and how far
    from its pivot its vectors lie, so that a search whose k nearest are within
    a radius passes over cells that lie beyond it by the triangle inequality or
    on the far side of a bisecting plane.
    """

    def __init__(self, pivots: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray, rows: int):
        self.pivots, self.counts, self.low, self.high = pivots, counts, low, high
        self.squares = (pivots**2).sum(1)
        # Cells that lie near one another share a unit: they are taken in the order of the nearest of a few pivots.
        lead = pivots[: max(1, int(counts.sum() // rows) + 1)]
        order = np.lexsort((self.squares, ((pivots[:, None, :] - lead[None]) ** 2).sum(2).argmin(1))) if len(pivots) * lead.size < 5e7 else np.arange(len(pivots))
        self.pieces, self.first = np.maximum(1, -(-counts // rows)), np.zeros(len(pivots), np.int64)
        unit, filled = 0, 0
        for c in order:
            if filled and (filled + counts[c] > rows or self.pieces[c] > 1):
                unit, filled = unit + 1, 0
            self.first[c] = unit
            filled += counts[c]
            if self.pieces[c] > 1:
                unit, filled = unit + int(self.pieces[c]), 0
        self.units = int((self.first + self.pieces).max())

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + self.squares[None] - 2 * x @ self.pivots.T))

    def reached(self, far: np.ndarray, cells: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Which cells may hold something within the radius of each search, from its distances to all pivots and its own cell."""
        home = far[np.arange(len(cells)), cells][:, None]
        between = np.sqrt(np.maximum(1e-300, self.squares[cells][:, None] + self.squares[None] - 2 * self.pivots[cells] @ self.pivots.T))
        bound = np.maximum(np.maximum(far - self.high[None], self.low[None] - far), (far**2 - home**2) / (2 * between))
        slack = 1e-6 * (1 + far + home)
        return (bound <= radius[:, None] + slack) & (self.counts > 0)[None]


def dealt_out(points: DataFrame, n: int, against: int) -> DataFrame:
    """n points in as many tasks as comparing each with so many others is worth, whatever the files they are read from."""
    tasks = max(n * against // TASK_PAIRS, n // TASK_ROWS) + 1
    return points.repartition(tasks, "node_id") if tasks > 1 else points


def knn(points: DataFrame, k: int, among: DataFrame | None = None, id_col: str = "node_id", vec_col: str = "x", include_self: bool = False, positive: bool = False, most_bytes: int = SHIPPED_BYTES) -> DataFrame:
    """(src, dst, rank, dist): the k nearest of among (default: the points themselves) to every point, ties by dst.

    Rank counts from 1; a point itself has rank 0 if include_self. positive:
    only what is at a distance above 0. Vectors of among that take no more than
    most_bytes are shipped to where the points lie. More are dealt into cells
    around pivots: see knn_by_cells(). Null vectors are no points.
    """
    itself = among is None
    named = lambda df: df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("node_id"), F.col(vec_col).cast("array<double>").alias("x"))
    points, among = named(points), named(points if itself else among)
    n, width = among.agg(F.count("*"), F.max(F.size("x"))).first()
    if int(n) * 8 * int(width or 0) <= most_bytes:
        batch = among.toArrow().combine_chunks()  # most_bytes at most
        ids, x = _vectors(batch.to_batches()[0]) if batch.num_rows else (np.empty(0, np.int64), np.empty((0, int(width or 0))))
        shipped = points.sparkSession.sparkContext.broadcast((ids, x))

        def run(batches):
            held = Held(*shipped.value, k)
            for batch in batches:
                own, x = _vectors(batch)
                yield _near_batch(own, *held.nearest(own, x, k, itself, positive))

        found = dealt_out(points, int(n) if itself else points.count(), int(n)).mapInArrow(run, NEAR)
    else:
        found = knn_by_cells(points, among, k, int(n), int(width), itself, positive, most_bytes)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("rank") <= k)
    ranked = ranked.select("src", "dst", "rank", "dist")
    if include_self and itself:
        ranked = ranked.unionByName(points.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0).alias("rank"), F.lit(0.0).alias("dist")))
    return ranked


#: Vectors around a pivot on average.
CELL_ROWS = 2048
#: The share of a unit's cells in reach from which on it is searched as a whole.
WHOLE = 0.2


class Unit:
    """The cells that a task holds, to be searched one by one or as a whole."""

    def __init__(self, cells: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
        self.cells, self.k, self.held = cells, k, {}

    def cell(self, c: int) -> Held:
        if c not in self.held:
            self.held[c] = Held(*self.cells[c], self.k)
        return self.held[c]

    def whole(self) -> Held:
        if None not in self.held:
            self.held[None] = Held(*map(np.concatenate, zip(*self.cells.values())), self.k)
        return self.held[None]


def visited(searches, every: Cells) -> np.ndarray:
    """(row, unit) for each row of a batch of searches (x, cell, radius) and every unit that has a cell within its radius."""
    _, x = _vectors(searches)
    search, cell = np.nonzero(every.reached(every.distances(x), searches.column("cell").to_numpy(), searches.column("radius").to_numpy()))
    n = every.pieces[cell]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    asked = np.zeros((len(x), every.units), bool)
    asked[np.repeat(search, n), np.repeat(every.first[cell], n) + step] = True
    return np.argwhere(asked)


def visits(known: DataFrame, cells) -> DataFrame:
    """A copy of each search (node_id, x, cell, radius) for every unit that has a cell within its radius, with unit; cells: a broadcast of Cells."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                pairs = visited(some, cells.value)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].astype(np.int32)), *(some.column(c).take(pa.array(pairs[:, 0])) for c in ("node_id", "x", "cell", "radius"))], names=["unit", "node_id", "x", "cell", "radius"])

    return known.mapInArrow(run, "unit int, node_id long, x array<double>, cell int, radius double")


def visitors(known: DataFrame, cells) -> dict[int, int]:
    """How many searches visits() sends to each unit that gets any, counted without copying them."""

    def run(batches):
        import pyarrow as pa

        n = np.zeros(cells.value.units, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                n += np.bincount(visited(batch.slice(at, 512), cells.value)[:, 1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0])], names=["unit", "n"])

    return {r.unit: r.n for r in known.mapInArrow(run, "unit int, n long").groupBy("unit").agg(F.sum("n").alias("n")).collect()}  # a row per unit


def knn_by_cells(points: DataFrame, among: DataFrame, k: int, n: int, width: int, itself: bool, positive: bool, most_bytes: int = SHIPPED_BYTES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(src, dst, dist) with the k nearest of every point among them, without comparing all pairs.

    Vectors belong to the nearest of some pivots, whose number is bounded by
    most_bytes; cells of neighboring pivots form units of most_bytes, and cells
    larger than that are split. A first pass searches each point's own cell (or
    a piece of it), which gives a radius for its k nearest. A second pass sends
    the point once to each unit that has a cell within this radius. A unit
    that many points ask is held by several tasks, a share of the points each.
    """
    spark, unit_rows = points.sparkSession, max(1, most_bytes // (8 * width))
    every = max(1, n // max(2, min(max(n // cell_rows, 8 * n // unit_rows), unit_rows)))  # several cells a unit, so that few are split
    drawn = among.where(F.pmod(F.xxhash64("x"), F.lit(every)) == 0).select("x").distinct().limit(2 * unit_rows)
    pivots = np.array([r[0] for r in drawn.collect()] or [among.first()[1]], float)  # twice most_bytes at most; any choice gives the same result
    sent = spark.sparkContext.broadcast(pivots)

    def place(batches):
        import pyarrow as pa

        pivots = sent.value
        squares = (pivots**2).sum(1)
        for batch in batches:
            ids, x = _vectors(batch)
            rows = max(1, 4_000_000 // len(pivots))
            cell = np.concatenate([np.empty(0, np.int64), *((squares[None] - 2 * x[at : at + rows] @ pivots.T).argmin(1) for at in range(0, len(ids), rows))])
            away = np.sqrt(((x - pivots[cell]) ** 2).sum(1)) if len(ids) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("node_id"), batch.column("x"), pa.array(cell.astype(np.int32)), pa.array(away)], names=["node_id", "x", "cell", "away"])

    placed = stored(among.mapInArrow(place, "node_id long, x array<double>, cell int, away double"), "cells")
    counts, low, high = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect():  # a row per pivot
        counts[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    cells = spark.sparkContext.broadcast(Cells(pivots, counts, low, high, unit_rows))
    table = spark.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(cells.value.first, cells.value.pieces))], "cell int, first int, pieces int")
    piece = F.pmod(F.xxhash64("node_id", "x"), F.col("pieces")).cast("int")
    theirs = placed.join(F.broadcast(table), "cell").select((F.col("first") + piece).alias("unit"), "node_id", "x", "cell")
    asking = (placed if itself else points.mapInArrow(place, placed.schema)).join(F.broadcast(table), "cell").select((F.col("first") + piece).alias("unit"), "node_id", "x", "cell", F.lit(None).cast("double").alias("radius"))

    def meet(asks: DataFrame, parts: dict[int, int], schema, answer) -> DataFrame:
        """answer(ids, x, cells, radii, held) for the asks of each unit; parts: in how many tasks a unit is held, if not in one."""
        shares = F.lit(1)
        if any(p > 1 for p in parts.values()):
            lookup = F.create_map(*(F.lit(v) for item in parts.items() for v in item))
            shares = F.coalesce(F.try_element_at(lookup, F.col("unit")), F.lit(1))
        held = theirs.withColumn("part", F.explode(F.sequence(F.lit(0), shares - 1))).select("unit", "part", F.lit(False).alias("asks"), "node_id", "x", "cell", F.lit(None).cast("double").alias("radius"))
        dealt = asks.withColumn("part", F.pmod(F.xxhash64("node_id", F.lit(1)), shares).cast("int")).select("unit", "part", F.lit(True).alias("asks"), "node_id", "x", "cell", "radius")
        places, tasks = [], 0
        for u in range(cells.value.units):
            places.append(tasks)
            tasks += parts.get(u, 1)
        place = F.get(F.lit(places), F.col("unit")) + F.col("part")  # a task of its own for each share of a unit
        met = held.unionByName(dealt).repartitionById(max(1, tasks), place.cast("int")).sortWithinPartitions("unit", "part", "asks")

        def run(batches):
            key, parts, unit = None, [], None
            for batch in batches:
                pairs = np.stack([batch.column(c).to_numpy() for c in ("unit", "part")], 1)
                asks = batch.column("asks").to_numpy(zero_copy_only=False)
                edge = np.flatnonzero((np.diff(pairs, axis=0) != 0).any(1) | (np.diff(asks.astype(int)) != 0)) + 1
                for a, b in zip([0, *edge], [*edge, len(asks)]):
                    if b == a:
                        continue
                    if tuple(pairs[a]) != key:
                        key, parts, unit = tuple(pairs[a]), [], None
                    part = batch.slice(a, b - a)
                    if not asks[a]:
                        parts.append((*_vectors(part), part.column("cell").to_numpy()))
                        continue
                    if unit is None and parts:
                        ids, x, cell = map(np.concatenate, zip(*parts))
                        order = np.argsort(cell, kind="stable")
                        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
                        unit = Unit({int(cell[order[s]]): (ids[order[s:e]], x[order[s:e]]) for s, e in zip(first, [*first[1:], len(order)])}, k)
                        parts = []
                    for at in range(0, part.num_rows, 2048):
                        some = part.slice(at, 2048)
                        yield answer(*_vectors(some), some.column("cell").to_numpy(), some.column("radius"), unit or Unit({}, k))

        return met.mapInArrow(run, schema)

    def radii(own, x, home, _, unit):
        import pyarrow as pa

        radius = np.full(len(own), np.inf)
        for c in np.unique(home):
            here = np.flatnonzero(home == c)
            if int(c) in unit.cells:
                radius[here] = unit.cell(int(c)).nearest(own[here], x[here], k, itself, positive)[1][:, -1]
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(x), pa.list_(pa.float64())), pa.array(home), pa.array(radius)], names=["node_id", "x", "cell", "radius"])

    known = stored(meet(asking, {}, "node_id long, x array<double>, cell int, radius double", radii), "radii")

    sought, asked = visits(known, cells), visitors(known, cells)
    parts = {u: max(-(-v // (4 * unit_rows)), -(-v * unit_rows // UNIT_PAIRS)) for u, v in asked.items()}

    def search(own, x, home, radius, unit):
        every, radius = cells.value, radius.to_numpy()
        reached = every.reached(every.distances(x), home, radius)
        if reached[:, list(unit.cells)].mean() > WHOLE if unit.cells else False:
            return _near_batch(own, *unit.whole().nearest(own, x, k, itself, positive, radius))
        found, far = np.full((len(own), k), -1, np.int64), np.full((len(own), k), np.inf)
        for c in unit.cells:
            here = np.flatnonzero(reached[:, c])
            if len(here):
                more, away = unit.cell(c).nearest(own[here], x[here], k, itself, positive, np.minimum(radius[here], far[here, -1]))
                more, away = np.concatenate([found[here], more], 1), np.concatenate([far[here], away], 1)
                order = np.lexsort((more, away), axis=1)[:, :k]
                found[here], far[here] = np.take_along_axis(more, order, 1), np.take_along_axis(away, order, 1)
        return _near_batch(own, found, far)

    return meet(sought, parts, NEAR, search)


def edges_from_neighbors(nodes: DataFrame, keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """(keys.., src, dst, rank, dist) from a list of neighbor ids and one of distances per node (node_id, ind, dist); the node itself is left out by its id, wherever it stands."""
    pairs = nodes.select(*keys, F.col("node_id").alias("src"), F.posexplode(F.arrays_zip("ind", "dist")).alias("rank", "n"))
    return pairs.select(*keys, "src", F.col("n.ind").alias("dst"), "rank", F.col("n.dist").alias("dist")).where("src <> dst")


def nearest_node(points: DataFrame, nodes: DataFrame, positive: bool = False, point: str = "id", node: str = "node", vec: str = "x") -> DataFrame:
    """(point, node, dist): the nearest of nodes (node, order, x) to every point, ties to the smallest order."""
    best = knn(points.select(F.col(point).alias("node_id"), F.col(vec).alias("x")), 1, nodes.select(F.col("order").alias("node_id"), F.col(vec).alias("x")), positive=positive)
    return best.join(nodes.select(F.col("order").cast("long").alias("dst"), F.col(node).alias("node")), "dst").select(F.col("src").alias(point), "node", "dist")


def k_nearest_nodes(points: DataFrame, nodes: DataFrame, k: int, point: str = "id", node: str = "node", vec: str = "x") -> DataFrame:
    """(point, node, rank, dist): the k nearest nodes at a distance above 0."""
    return knn(points.select(F.col(point).alias("node_id"), F.col(vec).alias("x")), k, nodes.select(F.col(node).alias("node_id"), F.col(vec).alias("x")), positive=True).select(F.col("src").alias(point), F.col("dst").alias("node"), "rank", "dist")


def cube_of(points: DataFrame, columns: tuple[str, ...], low: tuple[float, ...], width: float) -> list[Column]:
    return [F.floor((F.col(c) - F.lit(a)) / F.lit(width)).cast("int").alias(f"c{c}") for c, a in zip(columns, low)]
