"""Operator 7: embedding near-duplicates by a dual traversal of cover trees.

Vectors are unit vectors; cosine >= c is a Euclidean distance of sqrt(2 - 2c) or less. Per label the
tree's upper part is laid out by Spark: nodes around a few pivots, each cut by hash into tiles of a
bounded size. A tile's lower part is a cover tree: nested levels whose covering radius halves from one
to the next. Two tiles, and then two nodes, are dropped when their centres are further apart than both
covering radii and the wanted distance together; what is left at the last level is compared
vector by vector in double precision. The bounds never drop a pair within the distance, so the pairs are exact.

Equal vectors are one class before anything is compared. From a pair of tiles come the number of
links per class and the edges of a spanning forest, not the pairs, so a group of near copies costs rows in
proportion to its size. Vectors far from one another leave the bounds little to drop; then the work
grows with the square of a label's vectors, in blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_lake.llm.common import configure, stored, table
from telemetry_lake.llm.components import connected_components
from telemetry_lake.llm.simhash import forest

COSINE = 0.98
TILE = 512
# Pivots of one label, and the bytes of all pivots that are sent to the tasks. Labels beyond that
# bound, smallest first, are laid out by hash alone: more pairs of tiles, the same links.
PIVOTS = 32
PIVOT_BYTES = 32 << 20
# Added to every bound: far above rounding errors of double precision, far below any distance of use.
SLACK = 1e-9
LEVELS = 6


@dataclass(frozen=True)
class Tree:
    """Vectors of one tile with their nested levels; the last level is the vectors themselves."""

    raw: np.ndarray
    norms: np.ndarray
    reps: np.ndarray
    counts: np.ndarray
    # Per level: the vector at each node's centre, its covering radius, its parent in the level above.
    centres: list[np.ndarray]
    radii: list[np.ndarray]
    parents: list[np.ndarray]

    @property
    def units(self) -> np.ndarray:
        return self.raw / self.norms[:, None]


def _net(units: np.ndarray, node: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Split every node: its centre stays one, then each vector beyond the radius of all centres so far."""
    owner = np.full(len(units), -1)
    found: list[int] = []
    for parent, first in enumerate(centres):
        members = np.flatnonzero(node == parent)
        left = np.concatenate(([first], members[members != first]))
        while len(left):
            near = np.linalg.norm(units[left] - units[left[0]], axis=1) <= radius
            near[0] = True
            owner[left[near]] = len(found)
            found.append(int(left[0]))
            left = left[~near]
    return owner, np.array(found)


def build(raw: np.ndarray, reps: np.ndarray, counts: np.ndarray) -> Tree:
    """A cover tree by halving radii from 2 on, down to LEVELS levels and the vectors themselves."""
    norms = np.sqrt((raw * raw).sum(axis=1))
    units = raw / norms[:, None]
    node, centre = np.zeros(len(raw), int), np.zeros(1, int)
    centres, radii, parents = [], [], [np.zeros(1, int)]
    for level in range(LEVELS):
        far = np.linalg.norm(units - units[centre[node]], axis=1)
        reach = np.zeros(len(centre))
        np.maximum.at(reach, node, far)
        centres.append(centre)
        radii.append(reach)
        if not reach.any():
            break
        if level < LEVELS - 1:
            below, centre = _net(units, node, centre, 1 / 2**level)
            parents.append(node[centre])
            node = below
    centres.append(np.arange(len(raw)))
    radii.append(np.zeros(len(raw)))
    parents.append(node)
    return Tree(raw, norms, reps, counts, centres, radii, parents)


def traverse(a: Tree, b: Tree, cosine: float) -> np.ndarray:
    """hit[i, j]: vector i of a and vector j of b have the cosine or more."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    units_a, units_b = a.units, b.units
    depth = max(len(a.centres), len(b.centres))
    open_pairs = np.ones((1, 1), bool)
    at_a = at_b = 0
    for level in range(depth):
        # The tree with fewer levels is descended to its vectors last.
        next_a, next_b = (min(level, len(t.centres) - 1) if level < depth - 1 else len(t.centres) - 1 for t in (a, b))
        kin_a = a.parents[next_a] if next_a != at_a or level == 0 else np.arange(len(a.centres[at_a]))
        kin_b = b.parents[next_b] if next_b != at_b or level == 0 else np.arange(len(b.centres[at_b]))
        rows = np.flatnonzero(open_pairs.any(axis=1)[kin_a])
        columns = np.flatnonzero(open_pairs.any(axis=0)[kin_b])
        following = np.zeros((len(kin_a), len(kin_b)), bool)
        if len(rows) and len(columns):
            left, right = a.centres[next_a][rows], b.centres[next_b][columns]
            alike = open_pairs[np.ix_(kin_a[rows], kin_b[columns])]
            if level < depth - 1:
                squares = np.maximum(0, 2 - 2 * (units_a[left] @ units_b[right].T))
                bound = a.radii[next_a][rows][:, None] + b.radii[next_b][columns][None, :] + reach
                alike &= squares <= bound * bound + SLACK
            else:
                cosines = (a.raw[left] @ b.raw[right].T) / (a.norms[left][:, None] * b.norms[right][None, :])
                alike &= cosines >= cosine
            following[np.ix_(rows, columns)] = alike
        open_pairs, at_a, at_b = following, next_a, next_b
    return open_pairs


def _usable() -> Column:
    """Whether a vector can link: label and id not null, every component finite, not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    return F.coalesce(known & finite & some, F.lit(False))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _cells(classes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every class with the pivot of its label that it is nearest to as its `cell`."""
    dims = sizes.agg(F.max("dim")).first()[0] or 1
    most = max(1, PIVOT_BYTES // (2 * PIVOTS * dims * 8))
    # At most `most` labels, and some PIVOTS rows of each, reach the driver.
    large = [tuple(r) for r in sizes.where(F.col("size") > TILE).orderBy(F.desc("size"), "label", "dim").limit(most).collect()]
    if not large:
        return classes.withColumn("cell", F.lit(0))
    chosen = classes.join(
        F.broadcast(classes.sparkSession.createDataFrame(large, sizes.schema)), ["label", "dim"]
    ).where(F.pmod(F.xxhash64("rep", F.lit(1)), F.ceil(F.col("size") / PIVOTS)) == 0)
    pivots: dict[tuple, list] = {}
    for row in chosen.select("label", "dim", "embedding").limit(2 * PIVOTS * len(large)).collect():
        pivots.setdefault((row.label, row.dim), []).append(row.embedding)
    units = {key: (m := np.array(rows, float)) / np.linalg.norm(m, axis=1, keepdims=True) for key, rows in pivots.items()}
    sent = classes.sparkSession.sparkContext.broadcast(units)

    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
            cells = np.zeros(len(keys), np.int32)
            for key in set(keys) & sent.value.keys():
                rows = np.array([k for k, own in enumerate(keys) if own == key])
                cells[rows] = (_vectors(part.column(2).take(pa.array(rows))) @ sent.value[key].T).argmax(axis=1)
            yield pa.record_batch([*part.columns, pa.array(cells)], [*part.schema.names, "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(nearest, f"{kinds}, cell int")


def _tiles(celled: DataFrame) -> DataFrame:
    """`label`, `dim`, `tile`, its root's `centre` and `radius`, and the `tree`."""
    counts = celled.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    cut = F.pmod(F.xxhash64("rep"), F.col("parts"))
    rows = (
        celled.join(counts, ["label", "dim", "cell"])
        .groupBy("label", "dim", (F.col("cell") * F.lit(2**40) + cut).alias("tile"))
        .agg(F.collect_list(F.struct("embedding", "rep", "n")).alias("rows"))
        .select("label", "dim", "tile", "rows.embedding", "rows.rep", "rows.n")
    )

    def plant(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(len(part)):
                one = part.slice(k, 1)
                tree = build(*(f(one.column(i)[0].values) for i, f in ((3, _vectors), (4, np.array), (5, np.array))))
                kept = [[tree.units[0].tolist()], [float(tree.radii[0][0])], [pickle.dumps(tree)]]
                arrays = [pa.array(c, t) for c, t in zip(kept, (pa.list_(pa.float64()), pa.float64(), pa.binary()), strict=True)]
                yield pa.record_batch([*one.columns[:3], *arrays], ["label", "dim", "tile", "centre", "radius", "tree"])

    kind = dict(celled.dtypes)["label"]
    schema = f"label {kind}, dim int, tile long, centre array<double>, radius double, tree binary"
    return rows.mapInArrow(plant, schema)


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links between classes (`label`, `dim`, `embedding`, `rep`, `n`).

    Rows (rep, null, links) add up to the vectors linked to a class from other classes; rows
    (rep, other, 0) are edges that connect what is connected.
    """
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size"))
    tiles = stored(_tiles(_cells(classes, sizes)), "tiles")
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK)
    roots = tiles.select("label", "dim", "tile", "centre", "radius")
    others = roots.select("label", "dim", *[F.col(c).alias(f"other_{c}") for c in ("tile", "centre", "radius")])
    apart = F.sqrt(
        F.aggregate(
            F.zip_with("centre", "other_centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x
        )
    )
    keys = ["label", "dim"]
    pairs = (
        roots.join(others, keys)
        .where("tile <= other_tile")
        .where(apart <= F.col("radius") + F.col("other_radius") + reach)
        .select(*keys, "tile", "other_tile")
    )
    trees = tiles.select(*keys, "tile", "tree")
    both = pairs.join(trees, [*keys, "tile"]).join(
        trees.select(*keys, F.col("tile").alias("other_tile"), F.col("tree").alias("other")), [*keys, "other_tile"]
    )

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for same, *blobs in zip(*(c.to_pylist() for c in part.columns), strict=True):
                a, b = map(pickle.loads, blobs)
                hit = traverse(a, b, cosine)
                if same:
                    np.fill_diagonal(hit, False)
                nodes, lows = forest(hit, a.reps, b.reps) if hit.any() else (np.zeros(0, np.int64),) * 2
                found = [(a.reps, hit @ b.counts)] if same else [(a.reps, hit @ b.counts), (b.reps, hit.T @ a.counts)]
                linked = [(reps[n > 0], n[n > 0]) for reps, n in found]
                reps = np.concatenate([nodes, *(r for r, _ in linked)])
                total = np.concatenate([np.zeros(len(nodes), np.int64), *(n for _, n in linked)])
                other = pa.array(lows.tolist() + [None] * (len(reps) - len(nodes)), pa.int64())
                yield pa.record_batch([pa.array(reps), other, pa.array(total)], ["rep", "other", "links"])

    columns = both.select((F.col("tile") == F.col("other_tile")).alias("same"), "tree", "other")
    return columns.mapInArrow(compare, "rep long, other long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """`vec_id`, `n_links`, `component_id`, `kept` for every row of `vec_id`, `embedding`, `label`.

    Only vectors of equal, not null label and of the same length are compared. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, and so do rows with
    a null vec_id, whose component is null and which are not kept. A repeated row counts as a vector of
    its own. Further columns are left out, an empty table gives no rows.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be above 0 and at most 1")
    configure(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = rows.where(_usable()).withColumn("dim", F.size("embedding"))
    same = ["label", "dim", "embedding"]
    classes = stored(usable.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    found = stored(links(classes, cosine), "links")
    edges = found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    named = connected_components(edges).withColumnRenamed("node", "rep")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    judged = (
        classes.join(counted, "rep", "left")
        .join(named, "rep", "left")
        .select(*same, F.coalesce("component", "rep").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"), "n")
    )
    linked = usable.join(judged, same).select(
        "vec_id", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id"
    )
    unlinked = rows.where(~_usable()).select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return linked.union(unlinked).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
