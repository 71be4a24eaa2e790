"""Composition, stoichiometry, reaction energies and labels of atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def species_index(atoms: DataFrame, symbol: str = "symbol", elements: DataFrame | None = None) -> DataFrame:
    """atoms with species_idx from 0: a place among the sorted symbols that occur, or z - 1 in the table elements (z, symbol)."""
    if elements is not None:
        return atoms.join(F.broadcast(elements.select(F.col("symbol").alias(symbol), (F.col("z") - 1).alias("species_idx"))), symbol)
    known = atoms.select(symbol).distinct()  # one row per species
    known = known.withColumn("species_idx", F.row_number().over(Window.orderBy(symbol)) - 1)
    return atoms.join(F.broadcast(known), symbol)


def one_hot(index: Column, size: int, value: Column | None = None) -> Column:
    """array<double> with value (default 1) at index, 0 elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == index, F.lit(1.0) if value is None else value.cast("double")).otherwise(0.0))


def stoichiometry(atoms: DataFrame, keys: tuple[str, ...] = ("structure_id",), symbol: str = "symbol") -> DataFrame:
    """(keys.., symbol, n, fraction)."""
    counts = atoms.groupBy(*keys, symbol).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def compositions(atoms: DataFrame, keys: tuple[str, ...] = ("structure_id",), symbol: str = "symbol") -> DataFrame:
    """(keys.., symbols, fractions): a row per structure, sorted by symbol."""
    parts = stoichiometry(atoms, keys, symbol).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(symbol).alias("s"), F.col("fraction").alias("f")))).alias("p"))
    return parts.select(*keys, F.col("p.s").alias("symbols"), F.col("p.f").alias("fractions"))


def same_number_of_elements(main: Column, others: list[Column]) -> Column:
    """Whether the others together have as many different symbols as main."""
    return F.size(F.array_distinct(F.concat(*others))) == F.size(F.array_distinct(main))


def ratios_match(main_symbols: Column, main_fractions: Column, symbols: Column, fractions: Column, delta: float = 0.2) -> Column:
    """Whether each absolute difference of two fractions in one composition is within delta, exclusive, of that of the same pair in main; pairs that main lacks don't count."""
    main = F.map_from_arrays(main_symbols, main_fractions)
    own = F.arrays_zip(symbols.alias("s"), fractions.alias("f"))

    def pair_ok(a: Column, b: Column) -> Column:
        there = F.abs(F.try_element_at(main, a["s"]) - F.try_element_at(main, b["s"]))
        here = F.abs(a["f"] - b["f"])
        return F.coalesce((here < there + delta) & (here > there - delta), F.lit(True))

    return F.forall(own, lambda a: F.forall(own, lambda b: pair_ok(a, b)))


def reaction_enthalpy(first: Column, others: list[Column]) -> Column:
    """The first energy less the mean of the others."""
    return first - sum(others[1:], others[0]) / len(others)


def per_atom(energy: Column, n_atoms: Column) -> Column:
    return energy / F.nullif(n_atoms, F.lit(0))


def matching_compositions(a: DataFrame, b: DataFrame, delta: float, ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Pairs of compositions whose ratios match: a (a_symbols, a_fractions) and b (b_symbols, b_fractions), symbols in order, each composition once.

    A band join: what matches in all pairs of shared symbols matches in those
    of the first three, so compositions meet by these symbols and by cells of
    width delta that hold the differences of the first and second and of the
    first and third, a's in the neighboring cells too. The rest is checked
    after. Compositions that share fewer than two symbols always match; they
    meet by set of symbols, and all of these pairs are part of the result.
    """
    x, y = ends
    shared = F.array_intersect(f"{x}_symbols", f"{y}_symbols")
    cell = lambda p, q: F.floor(F.abs(p - q) / F.lit(float(delta))).cast("long")

    def keyed(df: DataFrame, n: str, width: int, spread: bool) -> DataFrame:
        out = df
        for i in range(width):
            out = out.select(*out.columns, F.posexplode(F.arrays_zip(F.col(f"{n}_symbols").alias("s"), F.col(f"{n}_fractions").alias("f"))).alias(f"i{i}", f"p{i}"))
            out = out.where(F.col(f"i{i}") > F.col(f"i{i - 1}")) if i else out
        for i in range(1, width):
            at = cell(F.col("p0.f"), F.col(f"p{i}.f"))
            out = out.withColumn(f"c{i}", F.explode(F.sequence(at - 1, at + 1)) if spread else at)
        return out.select(*df.columns, *(F.col(f"p{i}.s").alias(f"s{i}") for i in range(width)), *(f"c{i}" for i in range(1, width)))

    out = None
    for width in (2, 3):
        on = [*(f"s{i}" for i in range(width)), *(f"c{i}" for i in range(1, width))]
        met = keyed(a, x, width, True).join(keyed(b, y, width, False), on)
        first = F.slice(shared, 1, 3) == F.array(*(F.col(f"s{i}") for i in range(width)))
        met = met.where(first & ratios_match(*(F.col(f"{n}_{c}") for n in (x, y) for c in ("symbols", "fractions")), delta)).drop(*on)
        out = met if out is None else out.unionByName(met)
    sets = lambda df, n: df.select(f"{n}_symbols").distinct()
    size = lambda df, n: sets(df, n).withColumn("part", F.pmod(F.xxhash64(f"{n}_symbols"), F.lit(64)))
    apart = size(a, x).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(63)))).join(size(b, y).withColumnRenamed("part", "other"), "other").where(F.size(shared) < 2).drop("part", "other")
    return out.unionByName(apart.join(a, f"{x}_symbols").join(b, f"{y}_symbols").select(*out.columns))


def mixing_triples(a: DataFrame, b: DataFrame, c: DataFrame, delta: float = 0.2) -> DataFrame:
    """(a_id, b_id, c_id, enthalpy): each structure of a with one of b and one of c that together have as many elements, in matching ratios.

    Each has id, symbols, fractions, energy (per atom), one row per structure.
    Symbols that a lacks may occur, so nothing but the predicates limits the
    pairs. Equal compositions are paired as one, partners of a composition
    meet by their sets of symbols, and ids join what has passed.
    """
    parts = F.array_sort(F.arrays_zip(F.col("symbols").alias("s"), F.col("fractions").alias("f")))
    named = lambda df, n: df.withColumn("__p", parts).select(F.col("id").alias(f"{n}_id"), F.col("__p.s").alias(f"{n}_symbols"), F.col("__p.f").alias(f"{n}_fractions"), F.col("energy").alias(f"{n}_energy"))
    legs = {n: named(df, n) for n, df in (("a", a), ("b", b), ("c", c))}
    of = lambda n: [f"{n}_symbols", f"{n}_fractions"]
    kinds = {n: leg.select(*of(n)).distinct() for n, leg in legs.items()}
    pairs = {n: stored(matching_compositions(kinds["a"], kinds[n], delta, ("a", n)), f"matching-{n}") for n in "bc"}
    sets = {n: pairs[n].select(*of("a"), f"{n}_symbols").distinct() for n in "bc"}
    fitting = sets["b"].join(sets["c"], of("a")).where(same_number_of_elements(F.col("a_symbols"), [F.col("b_symbols"), F.col("c_symbols")]))
    met = fitting.join(pairs["b"], [*of("a"), "b_symbols"]).join(pairs["c"], [*of("a"), "c_symbols"])
    for n, leg in legs.items():
        met = met.join(leg, of(n))
    return met.select("a_id", "b_id", "c_id", reaction_enthalpy(F.col("a_energy"), [F.col("b_energy"), F.col("c_energy")]).alias("enthalpy"))


def require_species(atoms: DataFrame, wanted: list[str], symbol: str = "symbol") -> DataFrame:
    """atoms, if all wanted symbols occur; an error otherwise."""
    there = {r[0] for r in atoms.where(F.col(symbol).isin(*wanted)).select(symbol).distinct().collect()}
    missing = sorted(set(wanted) - there)
    if missing:
        raise ValueError(f"species that do not occur: {', '.join(missing)}")
    return atoms
