r"""Embedding near-dedup by an inverted multi-index.

Two codebooks, one for each half of the vectors, are fitted by k-means on a bounded sample
(``sample`` vectors of one dimension, by hash). A vector's cell is its pair of nearest
codewords; every vector is in the index. A multi-sequence traversal gives a vector's cells
in ascending order of the sum of its two distances: its own first, then the next best
pairs, until the sum exceeds the first by a margin. A pair is found if either of its
vectors visits the other's cell, and counted once: where both do, from the side whose own
cell comes first.

The margin is measured: of partners at exactly the threshold, a share ``recall`` must be
found. They are made from sample vectors by changes of four kinds (in any direction,
towards other vectors, in the first and in the second half only); the kind that needs most
decides. So do true pairs, if there are enough: ``probes`` vectors, by hash, are compared
with all, and of each the pairs closest to the threshold count. Closer vectors are found
more often. Verification is the cosine in double precision, so no pair below the threshold
links.

Equal vectors of one label are one class with a count (equal by 128 bits of hash). The
index holds ids and cells; vectors travel only to cells that hold one of their label. A
cell with more than ``block`` vectors is split into blocks that all its queries visit: no
cap, and no group without a bound. Blocks return sums of links and a spanning forest,
never all pairs.

Defined results: a vector that is null, empty, zero or holds a null or non-finite
component, one with a null label, and one with a null id, links with nothing and has
itself as its component (null id: null, not kept). Vectors of different lengths don't
link. Repeated rows are vectors of their own. An empty table gives no rows. Only the
columns named are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import slices
from lodestone.llm.components import connected_components
from lodestone.session import stored

#: True pairs that a probe gives at most, and how many must be there in all to count.
PER_PROBE, ENOUGH = 16, 20


def traverse(a: list[float], b: list[float], margin: float) -> Iterator[tuple[int, int]]:
    """Places (i, j) of two ascending sequences by ascending a[i] + b[j], while that is within ``margin`` of the first sum.

    The heap holds the next place of every row that is open; a row opens when the first
    place of the row before it is taken.
    """
    limit = a[0] + b[0] + margin
    heap = [(a[0] + b[0], 0, 0)]
    while heap and heap[0][0] <= limit:
        _, i, j = heapq.heappop(heap)
        yield i, j
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


@dataclass
class Codebooks:
    """Codewords of the two halves for vectors of one length, and the traversal's margin."""

    first: np.ndarray
    second: np.ndarray
    margin: float

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return _squared(unit[:, :h], self.first), _squared(unit[:, h:], self.second)

    def over(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The least margin with which x visits the cell of y, or y that of x."""
        sides = [self.distances(v) for v in (x, y)]
        at, out = np.arange(len(x)), []
        for (a, b), (oa, ob) in ((sides[0], sides[1]), (sides[1], sides[0])):
            out.append(a[at, oa.argmin(axis=1)] + b[at, ob.argmin(axis=1)] - a.min(axis=1) - b.min(axis=1))
        return np.minimum(*out)

    def visits(self, unit: np.ndarray) -> list[list[int]]:
        """For every row, the cells that it visits in order, its own first."""
        out = []
        orders, values = [], []
        for d in self.distances(unit):
            orders.append(d.argsort(axis=1, kind="stable"))
            values.append(np.take_along_axis(d, orders[-1], axis=1))
        for k in range(len(unit)):
            i_of, j_of = orders[0][k], orders[1][k]
            out.append([int(i_of[i]) * len(self.second) + int(j_of[j]) for i, j in traverse(values[0][k].tolist(), values[1][k].tolist(), self.margin)])
        return out


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1), 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _squared(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _partners(unit: np.ndarray, threshold: float, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sample vectors and partners at the threshold, for each kind of change."""
    n, dim = 2000, unit.shape[1]
    half = np.arange(dim) < dim // 2
    for part, other in ((half | ~half, False), (half | ~half, True), (half, False), (~half, False)):
        x = unit[rng.integers(len(unit), size=n)]
        away = np.where(part, unit[rng.integers(len(unit), size=n)] if other else rng.normal(size=x.shape), 0)
        own = np.where(part, x, 0)
        away -= (away * own).sum(axis=1, keepdims=True) / np.maximum((own**2).sum(axis=1, keepdims=True), 1e-300) * own
        size = np.sqrt((away**2).sum(axis=1, keepdims=True))
        some = size[:, 0] > 1e-9
        if some.any():
            yield x[some], threshold * x[some] + np.sqrt(1 - threshold**2) * away[some] / size[some]


def fit(vectors: np.ndarray, words: int, threshold: float, recall: float, pairs: tuple[np.ndarray, np.ndarray] | None = None, seed: int = 11) -> Codebooks:
    rng = np.random.default_rng(seed)
    unit = units(vectors.astype(float))
    h = unit.shape[1] // 2
    books = Codebooks(_kmeans(unit[:, :h], words, rng), _kmeans(unit[:, h:], words, rng), 0.0)
    kinds = [books.over(*k) for k in _partners(unit, threshold, rng)]
    if pairs is not None and len(pairs[0]) >= ENOUGH:
        kinds.append(books.over(units(pairs[0]), units(pairs[1])))
    books.margin = max((float(np.quantile(k, recall)) for k in kinds), default=0.0) + 1e-12
    return books


def link_block(
    residents: np.ndarray, r_count: np.ndarray, queries: np.ndarray, q_count: np.ndarray, threshold: float, own: np.ndarray | None = None, cell: int = 0, visits: list[list[int]] | None = None,
) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of the residents and of the queries (each pair of residents, and of a query and a resident), and a forest over residents then queries.

    ``own``: the queries' own cells; ``visits``: the cells that each resident visits. A pair
    whose query comes from a later cell, which the resident visits too, is counted there.
    """
    n = len(residents)
    every = np.concatenate([residents, queries])
    count = np.concatenate([r_count, q_count])
    links, group, forest = np.zeros(len(every), np.int64), np.arange(len(every)), []
    seen = {(i, c) for i, cells in enumerate(visits) for c in cells if c > cell} if visits is not None else set()
    for at in range(0, len(every), 512):
        rows = np.arange(at, min(at + 512, len(every)))
        hit = every[rows] @ residents.T >= threshold
        hit &= np.arange(n)[None, :] < rows[:, None]  # residents come first, so queries meet them all
        later = np.flatnonzero((rows >= n) & (own[np.maximum(rows - n, 0)] > cell)) if own is not None and len(own) else ()
        for i in later:
            for r in np.flatnonzero(hit[i]):
                hit[i, r] = (int(r), int(own[rows[i] - n])) not in seen
        links[rows] += hit @ r_count
        links[:n] += count[rows] @ hit
        for i in np.flatnonzero(hit.any(axis=1)):
            me, others = at + i, np.flatnonzero(hit[i])
            for g in np.unique(group[others]):
                if g != group[me]:
                    forest.append((me, int(others[group[others] == g][0])))
                    group[group == g] = group[me]
    return links[:n], links[n:], forest


def _true_pairs(classes: DataFrame, probes: dict[int, list], threshold: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: probes and their partners in all of the classes, of each the ``PER_PROBE`` closest to the threshold."""
    shared = classes.sparkSession.sparkContext.broadcast({d: (units(np.array([p["v"] for p in ps], float)), [p["label"] for p in ps], [p["node"] for p in ps]) for d, ps in probes.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            dims = np.asarray(b.column(3))
            for dim in np.unique(dims):
                t = b.take(pa.array(np.flatnonzero(dims == dim)))
                probe, labels, nodes = shared.value[int(dim)]
                unit = units(np.array(t.column(2).to_pylist(), float))
                cos = probe @ unit.T
                mine = t.column(0).to_pylist()
                for k in np.flatnonzero((cos >= threshold).any(axis=1)):
                    near = [i for i in np.argsort(cos[k]) if cos[k, i] >= threshold and mine[i] == labels[k] and t.column(1)[int(i)].as_py() != nodes[k]][:PER_PROBE]
                    columns = [pa.array([int(dim)] * len(near), pa.int32()), pa.array([int(k)] * len(near), pa.int32()), pa.array(cos[k, near]), t.column(2).take(pa.array(near, pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["dim", "probe", "cos", "v"])

    found = classes.select("label", "node", "v", "dim").mapInArrow(run, "dim int, probe int, cos double, v array<double>")
    place = F.row_number().over(Window.partitionBy("dim", "probe").orderBy("cos", "v"))
    rows = found.withColumn("place", place).where(F.col("place") <= PER_PROBE).collect()  # probes times PER_PROBE at most
    return {d: tuple(np.array(x, float) for x in zip(*[(probes[d][r["probe"]]["v"], r["v"]) for r in rows if r["dim"] == d], strict=True)) for d in {r["dim"] for r in rows}}


def near_duplicates(
    vectors: DataFrame, *, threshold: float = 0.93, recall: float = 0.98, sample: int = 4000, probes: int = 256, block: int = 2000, per_cell: int = 16,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    sound = F.expr("id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)")
    # the second hash starts from another state, so that the two are independent
    keyed = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    equal = keyed.where("sound").groupBy("label", "h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    # a node is a class, not an id: rows of one id can have different vectors
    classes = stored(equal.withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()  # a row for each length of vectors
    picked = {r["dim"]: classes.where(F.col("dim") == r["dim"]).orderBy("h1", "h2").limit(sample).select("label", "node", "v").collect() for r in sizes}
    pairs = _true_pairs(classes, {d: p[:probes] for d, p in picked.items()}, threshold)
    books: dict[int, Codebooks] = {}
    for r in sizes:
        words = int(np.clip(2 ** round(np.log2(max(1.0, np.sqrt(r["n"] / per_cell)))), 1, 256))
        books[r["dim"]] = fit(np.array([p["v"] for p in picked[r["dim"]]]), words, threshold, recall, pairs.get(r["dim"]))
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # 256 codewords a half at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            dims = np.asarray(b.column(3))
            for dim in np.unique(dims):
                t = b.take(pa.array(np.flatnonzero(dims == dim)))
                cells = shared.value[int(dim)].visits(units(np.array(t.column(2).to_pylist(), float)))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(3), pa.array(cells, pa.list_(pa.int64()))], ["label", "node", "dim", "cells"])

    lkind = classes.schema["label"].dataType.simpleString()
    placed = stored(classes.select("label", "node", "v", "dim").mapInArrow(assign, f"label {lkind}, node long, dim int, cells array<long>").withColumn("own", F.col("cells")[0]), "cells")
    full = placed.groupBy(F.col("label").alias("fl"), F.col("dim").alias("fd"), F.col("own").alias("fc")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    visits = placed.select("label", "dim", "node", "own", F.explode("cells").alias("cell"))
    dealt = visits.join(full, (F.col("label") == F.col("fl")) & (F.col("dim") == F.col("fd")) & (F.col("cell") == F.col("fc")))  # an empty cell has nothing to visit
    home = F.when(F.col("cell") == F.col("own"), F.pmod(F.hash("node"), F.col("blocks")))
    spread = dealt.withColumn("home", home).withColumn("block", F.explode(F.sequence(F.coalesce("home", F.lit(0)), F.col("blocks") - 1)))
    spread = spread.select("label", "dim", "cell", "block", "own", F.coalesce(F.col("block") == F.col("home"), F.lit(False)).alias("resident"), F.col("node").alias("to"))
    bodies = classes.select("node", "m", "v").join(placed.select(F.col("node").alias("pn"), "cells"), F.col("node") == F.col("pn"))
    rich = spread.join(bodies, F.col("to") == F.col("node")).select(
        "label", "dim", "cell", "block", "own", "resident", "node", "m", "v", F.when(F.col("resident"), F.col("cells")).alias("cells")
    )

    def verify(table: pa.Table) -> pa.Table:
        lives = np.asarray(table.column("resident"))
        order = np.concatenate([np.flatnonzero(lives), np.flatnonzero(~lives)])
        n = int(lives.sum())
        unit, m = units(np.array(table.column("v").to_pylist(), float))[order], np.asarray(table.column("m"))[order]
        node, own = table.column("node").take(pa.array(order)), np.asarray(table.column("own"))[order]
        cells = table.column("cells").take(pa.array(order[:n])).to_pylist()
        r, q, forest = link_block(unit[:n], m[:n], unit[n:], m[n:], threshold, own[n:], table.column("cell")[0].as_py(), cells)
        links = np.concatenate([r, q])
        some = np.flatnonzero(links)
        a, b = (pa.array([f[k] for f in forest], pa.int64()) for k in (0, 1))
        return pa.table({
            "node": pa.chunked_array([*node.take(pa.array(some)).chunks, *node.take(a).chunks], node.type),
            "links": pa.array([*links[some].tolist(), *[None] * len(forest)], pa.int64()),
            "other": pa.chunked_array([pa.nulls(len(some), node.type), *node.take(b).chunks], node.type),
        })

    found = stored(rich.groupBy("label", "dim", "cell", "block").applyInArrow(verify, "node long, links long, other long"), "links")
    summed = found.where("links is not null").groupBy(F.col("node").alias("s")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    numbered = (
        classes.select(F.col("label").alias("kl"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "node", "m", "least")
        .join(summed, F.col("node") == F.col("s"), "left").join(parts.withColumnRenamed("node", "p"), F.col("node") == F.col("p"), "left")
        .select("kl", "k1", "k2", "least", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("c"))
    )
    decided = numbered.join(numbered.groupBy("c").agg(F.min("least").alias("component")), "c").select("kl", "k1", "k2", "n_links", "component")
    # rows that link with nothing have no key, so that they don't meet in the join
    base = keyed.select("id", F.when(F.col("sound"), F.col("label")).alias("label"), F.when(F.col("sound"), F.col("h1")).alias("h1"), F.when(F.col("sound"), F.col("h2")).alias("h2"))
    out = base.join(decided, (F.col("label") == F.col("kl")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
