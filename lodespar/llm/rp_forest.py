"""Near-duplicates of embeddings by a forest of random-projection trees.

Each tree splits space again and again at the median of a random direction;
vectors within ``SPILL`` (in ranks) of a split go to both sides. Trees are
fitted on a bounded sample: the ``SAMPLE`` vectors with the smallest hash of
their id; every vector goes through every tree. Vectors that share a leaf and a
label are compared exactly, and links of cosine 0.98 or more are verified in
double precision. Groups are connected components of links.

Equal vectors of a label are one class first. A node whose sample lies within
a narrow cone is not split, for splitting would tear near-duplicates apart. The
leaves below one node of about CELL vectors are a cell: its vectors are sent to a
task once a label, not once a leaf. Where a cell holds more than MOST vectors of
a label, its leaves are sent one by one; a leaf of any size is compared in full,
block by block, each pair of blocks in a task of its own. A pair of classes that
share several leaves is counted in the first of them, so numbers of links need
no list of pairs; for groups, each cell or block sends only a spanning forest of
its links.

Vectors of each length have a forest of their own, for those of different
lengths have no cosine. A length too rare for the sample, of which there are
many vectors nonetheless, has trees fitted on random directions. The driver
takes the number of vectors by length: k lengths need k * k / 2 components, so
there are few even in a huge table.

Edge cases: null labels, null, zero-length or zero vectors, and vectors with
null or non-finite components link with nothing. Rows with equal vectors are
linked. Rows with the same id are vectors of their own; a group's component_id
is the smallest id in it, so several rows of one id may be kept. Null ids sort
after all others, and a group of null ids only has a null component_id. A cosine
of just 0.98 is a link, as computed in double precision. Other columns of the
input don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util
from ._graph import components
from ._rows import RowTable

THRESHOLD = 0.98
TREES = 8
SPILL = 0.06
#: Bound of the vectors that trees are fitted on.
SAMPLE = 20_000
#: Vectors that a leaf holds about, over all labels, and sampled vectors that it holds at least.
LEAF, LEAF_SAMPLE = 400, 12
#: A node is narrow where nine in ten of its sample have this cosine or more with their mean.
NARROW = 0.9
#: Vectors of a cell about, over all labels, and classes of one label in it at most.
CELL, MOST = 32_768, 40_960
#: Bytes of vectors that go through the trees at once; pairs that are counted at once.
GROW_BYTES, PAIRS = 32 << 20, 1 << 17
#: Classes of a block; a task compares two of them, TILE classes with TILE at once.
BLOCK, TILE = 4096, 1024
SEED = 7


class Forest:
    """Nodes in arrays: direction, low and high bound (within both: both sides), children; leaves have no children."""

    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, spill: float = SPILL, seed: int = SEED):
        self.dim = sample.shape[1] if sample.ndim == 2 else 0
        self.direction: list[np.ndarray | None] = []
        self.bounds: list[tuple[float, float]] = []
        self.child: list[tuple[int, int]] = []
        self.cell: list[int] = []
        self.roots: list[int] = []
        rng = np.random.default_rng(seed)
        if len(sample) < 4 * LEAF_SAMPLE and total > 4 * LEAF:
            sample = _unit(rng.standard_normal((1000, self.dim)))
        share = max(len(sample), 1) / max(total, 1)
        least = max(LEAF_SAMPLE, LEAF * share)
        for _ in range(trees):
            root = len(self.child)
            self.roots.append(root)
            self._add()
            todo = [(root, np.arange(len(sample)), -1)]
            while todo:
                node, at, cell = todo.pop()
                if cell < 0 and len(at) <= CELL * share:
                    cell = node
                self.cell[node] = node if cell < 0 else cell
                if len(at) <= least:
                    continue
                x = sample[at]
                mean = x.mean(0)
                norm = np.linalg.norm(mean)
                if norm > 0 and np.quantile(x @ mean / norm, 0.1) >= NARROW:
                    continue
                d = rng.standard_normal(self.dim)
                p = x @ (d / np.linalg.norm(d))
                low, high = np.quantile(p, (0.5 - spill, 0.5 + spill))
                left, right = at[p <= high], at[p >= low]
                if max(len(left), len(right)) >= 0.95 * len(at):
                    continue
                self.direction[node], self.bounds[node] = d / np.linalg.norm(d), (low, high)
                a, b = self._add(), self._add()
                self.child[node] = (a, b)
                todo += [(a, left, cell), (b, right, cell)]
        self.cells = np.array(self.cell, np.int32)
        self.is_leaf = np.array([a < 0 for a, _ in self.child], bool)

    def _add(self) -> int:
        self.direction.append(None)
        self.bounds.append((0.0, 0.0))
        self.child.append((-1, -1))
        self.cell.append(-1)
        return len(self.child) - 1

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves of each row, in rising order, one row after another; and where each row's begin, and the last ends."""
        rows, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        todo = [(r, np.arange(len(x))) for r in self.roots[::-1]]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            a, b = self.child[node]
            if a < 0:
                rows.append(at)
                nodes.append(np.full(len(at), node, np.int32))
                continue
            p = x[at] @ self.direction[node]
            low, high = self.bounds[node]
            todo += [(b, at[p >= low]), (a, at[p <= high])]
        row, node = np.concatenate(rows), np.concatenate(nodes)
        return node[np.lexsort((node, row))], np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(x)))))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares can't overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Groups:
    """Sets of the numbers below n, joined by many links at once."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the links that make a spanning forest with the links before."""
        kept = [(i[:0], j[:0])]
        while True:
            a, b = self.of[i], self.of[j]
            apart = a != b
            if not apart.any():
                return np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept])
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            kept.append((i[first], j[first]))
            # each set hangs below a lower one, so no ring can come about
            up = np.arange(len(self.of))
            up[high] = np.minimum(a, b)[first]
            while (up[up] != up).any():
                up = up[up]
            self.of = up[self.of]


def _first_shared(la: np.ndarray, i: np.ndarray, lb: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first leaf that rows i of la and j of lb share, leaves in rising order; they must share one."""
    out, at = np.zeros(len(i), la.dtype), np.arange(len(i))
    flat_a, flat_b, p, q = la.ravel(), lb.ravel(), i * la.shape[1], j * lb.shape[1]
    while len(at):
        a, b = flat_a[p], flat_b[q]
        same = a == b
        out[at[same]] = a[same]
        go = np.flatnonzero(~same)
        a, b = a[go], b[go]
        at, p, q = at[go], p[go] + (a < b), q[go] + (b < a)
    return out


def compare(xa: np.ndarray, xb: np.ndarray, la: np.ndarray, lb: np.ndarray, leaf: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in a, j in b) of the links that this leaf counts."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for p in range(0, len(xa), TILE):
        for q in range(p if same else 0, len(xb), TILE):
            i, j = np.nonzero(xa[p : p + TILE] @ xb[q : q + TILE].T >= THRESHOLD - 1e-9)
            i, j = i + p, j + q
            if same:
                i, j = i[i < j], j[i < j]
            first = _first_shared(la, i, lb, j) == leaf
            i, j = i[first], j[first]
            exact = np.einsum("ij,ij->i", xa[i], xb[j]) >= THRESHOLD
            out.append((i[exact], j[exact]))
    none = np.zeros(0, np.int64)
    return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (none, none)


def _pad(lists: pa.Array) -> np.ndarray:
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.full((len(lists), size.max(initial=1)), np.iinfo(np.int32).max, np.int32)
    out[np.repeat(np.arange(len(lists)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def _links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One pair of blocks of one leaf and label. Rows: node, other (null), n: links of a class by weight; or node, other: a link of the forest."""
    leaf = key[2].as_py()
    same = key[3].as_py() == key[4].as_py()
    side = np.array(table.column("side").to_pylist(), bool)
    x = _unit(_matrix(table.column("embedding").combine_chunks()))
    ids = table.column("class").to_numpy()
    weight = table.column("size").to_numpy().astype(float)
    lists = _pad(table.column("leaves").combine_chunks())
    a, b = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(~side), np.flatnonzero(side))
    i, j = compare(x[a], x[b], lists[a], lists[b], leaf, same)
    i, j = a[i], b[j]
    n = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    return _found(ids, n, *Groups(len(ids)).join(i, j))


def _found(ids: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.Table:
    some = np.flatnonzero(n)
    node = np.concatenate((ids[some], ids[i]))
    other = pa.array(np.concatenate((np.zeros(len(some), np.int64), ids[j])), mask=np.arange(len(node)) < len(some))
    return pa.table({"node": pa.array(node, pa.int64()), "other": other, "n": pa.array(np.concatenate((n[some], np.zeros(len(i)))).astype(np.int64))})


def _cell_links(cells: np.ndarray, cell: int, table: pa.Table) -> pa.Table:
    """All leaves of one cell and label; cells: the cell of each leaf. Rows as those of _links."""
    x = _unit(_matrix(table.column("embedding").combine_chunks()))
    ids, weight = table.column("class").to_numpy(), table.column("size").to_numpy().astype(float)
    lists = table.column("leaves").combine_chunks()
    padded = _pad(lists)
    flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
    inside = cells[flat] == cell
    flat, row = flat[inside], row[inside]
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    begin = np.flatnonzero(np.diff(flat, prepend=-1))
    n, groups, kept, held, pairs = np.zeros(len(ids)), Groups(len(ids)), [], [], 0

    def count() -> None:
        for k in range(0, pairs, PAIRS):
            i, j, leaf = (np.concatenate([h[c] for h in held])[k : k + PAIRS] for c in range(3))
            good = _first_shared(padded, i, padded, j) == leaf
            i, j = i[good], j[good]
            good = np.einsum("ij,ij->i", x[i], x[j]) >= THRESHOLD
            i, j = i[good], j[good]
            n[:] += np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
            kept.append(groups.join(i, j))
        held.clear()

    for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(flat)]):
        at = row[s:e]
        for p in range(0, e - s, TILE):
            for q in range(p, e - s, TILE):
                i, j = np.nonzero(x[at[p : p + TILE]] @ x[at[q : q + TILE]].T >= THRESHOLD - 1e-9)
                if p == q:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    held.append((at[i + p], at[j + q], np.full(len(i), flat[s])))
                    pairs += len(i)
                if pairs >= PAIRS:
                    count()
                    pairs = 0
    count()
    none = np.zeros(0, np.int64)
    return _found(ids, n, *(np.concatenate([none, *(k[c] for k in kept)]) for c in (0, 1)))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    _util.ship(spark)
    named = _util.steady(rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label")))
    named = named.withColumn("row", F.monotonically_increasing_id())
    finite = F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    # equal vectors of a label are a class, named by its first row
    key = F.struct(F.col("label"), F.expr("transform(embedding, x -> x + 0.0D)").alias("v"))
    hashed = named.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select("row", "vec_id", "label", F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("h2"))
    classes = hashed.groupBy("label", "h", "h2").agg(F.min("row").alias("class"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("size"))
    members = _util.cut(hashed.join(classes, ["label", "h", "h2"]).select("row", "class", "low", "size"))
    one = members.where("row = class")
    chosen = RowTable(one.select("row", F.array("size").alias("to")))
    reps = named.withColumn("size", F.get(chosen.get(F.col("row")), F.lit(0))).where("size is not null")
    reps = _util.cut(reps.select(F.col("row").alias("class"), "size", "label", "embedding"))
    chosen.drop()
    found = _forest_links(reps)
    _util.drop_cut(reps)
    links = found.where("other is null").groupBy(F.col("node").alias("class")).agg(F.sum("n").alias("far"))
    comp = _util.cut(components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))))
    comp = comp.withColumnRenamed("node", "class")
    lowest = one.select("class", "low").join(comp, "class").groupBy("component").agg(F.min("low").alias("lowest"))
    known = members.join(links, "class", "left").join(comp, "class", "left").join(lowest, "component", "left")
    known = known.select("row", (F.coalesce("far", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("component_id"), F.lit(True).alias("known"))
    out = named.select("row", "vec_id").join(known, "row", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _forest_links(reps: DataFrame) -> DataFrame:
    spark = reps.sparkSession
    totals = dict(reps.groupBy(F.size("embedding")).count().collect())
    sample = reps.orderBy(F.xxhash64(F.lit(SEED), "class"), "class").limit(SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks()
    size = np.asarray(sample.value_lengths()) if len(sample) else np.zeros(0, np.int64)
    samples = {int(d): _unit(_matrix(sample.filter(pa.array(size == d)))) for d in np.unique(size)}
    fitted = {d: Forest(x, totals[d]) for d, x in samples.items()}
    shared = spark.sparkContext.broadcast((fitted, totals))

    def forest(dim: int) -> Forest:
        fitted, totals = shared.value
        if dim not in fitted:
            fitted[dim] = Forest(np.zeros((0, dim)), totals[dim])
        return fitted[dim]

    def grow(batches):
        held: dict[int, list[pa.RecordBatch]] = {}

        def send(dim: int) -> pa.RecordBatch:
            part = pa.Table.from_batches(held.pop(dim)).combine_chunks().to_batches()[0]
            leaves, to = forest(dim).leaves(_unit(_matrix(part.column("embedding"))))
            row, cell = np.repeat(np.arange(part.num_rows), np.diff(to)), forest(dim).cells[leaves]
            order = np.lexsort((cell, row))
            row, cell = row[order], cell[order]
            new = (np.diff(row, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0)
            lists = [(leaves, to), (cell[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=part.num_rows)))))]
            lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v, pa.int32())) for v, o in lists]
            return pa.record_batch([*(part.column(c) for c in ("class", "size", "label", "embedding")), pa.array([dim] * part.num_rows, pa.int32()), *lists], names=["class", "size", "label", "embedding", "dim", "leaves", "cells"])

        for batch in batches:
            size = np.asarray(batch.column("embedding").value_lengths())
            for dim in np.unique(size).tolist():
                held.setdefault(dim, []).append(batch.filter(pa.array(size == dim)))
            while sum(8 * d * b.num_rows for d, bs in held.items() for b in bs) >= GROW_BYTES:
                yield send(max(held, key=lambda d: sum(8 * d * b.num_rows for b in held[d])))
        while held:
            yield send(next(iter(held)))

    def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _cell_links(forest(key[1].as_py()).cells, key[2].as_py(), table)

    def leaves_of(batches):
        for batch in batches:
            for k, (dim, cell) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("cell").to_pylist())):
                leaf = np.flatnonzero((forest(dim).cells == cell) & forest(dim).is_leaf)
                yield pa.record_batch([batch.column("label").take(pa.array([k] * len(leaf))), pa.array([dim] * len(leaf), pa.int32()), pa.array(leaf, pa.int32())], names=["label", "dim", "leaf"])

    label = reps.schema["label"].dataType.simpleString()
    placed = _util.cut(reps.mapInArrow(grow, f"class bigint, size bigint, label {label}, embedding array<double>, dim int, leaves array<int>, cells array<int>"))
    cell = ["label", "dim", "cell"]
    large = _util.cut(placed.select("label", "dim", F.explode("cells").alias("cell")).groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST).select(*cell))
    rows = placed.select("class", "size", "label", "dim", "embedding", "leaves", F.explode("cells").alias("cell"))
    some = not large.isEmpty()
    found = (rows.join(large, cell, "left_anti") if some else rows).groupBy(*cell).applyInArrow(links, "node bigint, other bigint, n bigint")
    if some:
        found = found.unionAll(_leaf_links(placed, large.mapInArrow(leaves_of, f"label {label}, dim int, leaf int")))
    found = _util.cut(found)
    _util.drop_cut(placed)
    _util.drop_cut(large)
    return found


def _leaf_links(placed: DataFrame, leaves: DataFrame) -> DataFrame:
    """The links of the given leaves by label; a leaf of more than a block is dealt into blocks by a hash, and each pair of blocks is compared."""
    leaf = ["label", "dim", "leaf"]
    single = placed.select("class", "label", "dim", F.explode("leaves").alias("leaf")).join(leaves, leaf, "left_semi")
    sizes = single.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*leaf, "blocks")
    rows = placed.select("*", F.explode("leaves").alias("leaf")).join(sizes, leaf).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "class"), F.col("blocks")).cast("int"))
    pairs = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("class", "size", "label", "dim", "embedding", "leaves", "leaf", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"), (F.col("block") > F.col("o")).alias("side"))
    return pairs.groupBy("label", "dim", "leaf", "p", "q").applyInArrow(_links, "node bigint, other bigint, n bigint")
