"""Near-duplicates of texts by BagMinHash signatures of their word shingles.

A text is the multiset of its five-word shingles; two texts are near-duplicates
when the weighted Jaccard similarity of their multisets is 0.8 or more. The
signature of a multiset takes, for each of its components, the earliest point
of Poisson processes that belong to (shingle, weight level): level intervals
are dyadic, [0,1), [1,2), [2,4), ..., a whole interval has one process with a
rate as large as the interval, and each of its points descends by random bits
to one unit level, where it counts if the shingle's weight is above. A text
draws only points before a time by which all components are very likely
filled; where one is not, the time is doubled and that text is done again, so
the signature doesn't depend on the time chosen. Components of two signatures
agree with a probability that is the weighted Jaccard similarity.

Texts with equal multisets form a class, and all that follows works on one row
per class. Bands of components give buckets; each bucket has two pivots, its
most central class (whose buckets hold most classes) and one by a hash, and
every other class of the bucket is a candidate of these: links in proportion to
the rows, whatever a bucket's size. Each
class first verifies its most frequent candidate by exact multiset overlap,
and then all candidates that still lead to other groups. The classes of buckets
that still span several groups are then joined exactly. Groups that such buckets
lead to each other belong to one family, so all pairs that share a bucket do. A
family of up to a block's size is compared in full inside one task, to which
each of its rows is sent once. A larger one is split by prefixes first: each
class lists its shingles from rare to common, and the first common shingle of
two similar classes has so much of both behind it that only about the rarest
fifth of a class, and ninth of the smaller one, can hold it; groups that share
such a shingle stay together, so similar classes do. What is still larger is
compared bucket by bucket, or, where that sends less, dealt into blocks of a
bounded size, of which all meet all. The overlaps of all classes of different
groups in two blocks are counted inside a task, which sends no pairs, only as
many links as join its groups. So no similar pair that shares a bucket stays in
two groups. Groups are connected components of links.

How common a shingle is, is counted in a table of a fixed size; that only orders
the shingles, and any order gives the same links. In one bucket of far more than
a block of small groups that share even their rarest shingles all blocks meet
all, so its time and what it sends grow with the square of its blocks.

Edge cases: null and empty texts have no shingle and stay alone. A text of
fewer than five words is one shingle of all its words. A similarity of just 0.8
is a link. Texts of any length are read whole. Repeated rows fall in one class;
of rows with the smallest id of a group the first is kept. Null ids are ordinary
values and come last. Other columns may have any names. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _util
from ._graph import Union, components, joined
from ._rows import RowTable
from ._words import U, Words, mix, shingles

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
#: Cells of the table that counts in how many classes a shingle stands; shingles of one cell count together.
CELLS = 1 << 20
#: Most items and rows of a block of a family; of a tile, of which a task compares two at once; and the items that these are compared on at once.
BLOCK_ITEMS, BLOCK_ROWS = 1 << 20, 4096
TILE_ITEMS, TILE, WIDE = 1 << 18, 1024, 2048
#: Tasks that the rows of a group are dealt over to meet its first row.
SALT = 16

_GOLD = 0x9E3779B97F4A7C15


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(row: np.ndarray, item: np.ndarray, count: np.ndarray, rows: int, size: int = BANDS * ROWS) -> np.ndarray:
    """Per row and component a 64-bit value; rows without an item get zeros. row must rise; items are distinct in a row."""
    best = np.full(rows * size, np.inf)
    weight = np.bincount(row, count, rows)
    limit = np.where(weight > 0, size * (np.log(size) + 4) / np.maximum(weight, 1), 0)
    todo = np.flatnonzero(weight > 0)
    top = int(count.max()).bit_length() + 1 if len(count) else 0
    while len(todo):
        chosen = np.zeros(rows, bool)
        chosen[todo] = True
        live = chosen[row]
        for level in range(top):
            low = 0 if level == 0 else 1 << (level - 1)
            span = 1 if level == 0 else 1 << (level - 1)
            at = np.flatnonzero(live & (count > low))
            if not len(at):
                break
            r, need = row[at], count[at] - low
            seed = mix(item[at] + U((_GOLD * (level + 1)) & (2**64 - 1)))
            t, end = np.zeros(len(at)), limit[r]
            draw = 0
            while len(at):
                x = mix(seed + U((_GOLD * (2 * draw + 1)) & (2**64 - 1)))
                t = t - np.log(_uniform(x)) / span
                on = t <= end
                at, r, need, seed, t, end = at[on], r[on], need[on], seed[on], t[on], end[on]
                y = mix(seed + U((_GOLD * (2 * draw + 2)) & (2**64 - 1)))
                slot = ((y & U(0xFFFFFFFF)) * U(size)) >> U(32)
                leaf = ((y >> U(32)) & U(span - 1)).astype(np.int64)  # one bit for each split of the interval
                ok = leaf < need
                np.minimum.at(best, r[ok] * size + slot[ok].astype(np.int64), t[ok])
                draw += 1
        full = np.isfinite(best.reshape(rows, size)).all(1)
        todo = todo[~full[todo]]
        limit[todo] *= 2
        best.reshape(rows, size)[todo] = np.inf
    out = mix(best.view(U)).reshape(rows, size)
    out[weight == 0] = 0
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, width: int = ROWS) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, width)
    x = np.tile(np.arange(bands, dtype=U) + U(1), (len(sig), 1))
    for j in range(width):
        x = mix(x * U(0xD6E8FEB86659FD93) + parts[:, :, j])
    return x


def _class_key(row: np.ndarray, item: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    x = mix(item + mix(count.astype(U)))
    total = np.zeros(rows, U)
    np.add.at(total, row, x)
    return mix(total + U(77)).view(np.int64)


def _describe(batches):
    for batch in _util.steps(batches, "text"):
        row, item, count = shingles(Words.of(batch.column("text")), SHINGLE)
        n = batch.num_rows
        key = _class_key(row, item, count, n)
        some = np.zeros(n, bool)
        some[row] = True
        bands = band_keys(signatures(row, item, count, n)).view(np.int64)
        offs = pa.array(np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32))
        yield pa.record_batch([batch.column("row"), pa.array(key, mask=~some), pa.ListArray.from_arrays(offs, pa.array(bands[some].ravel()))], names=["row", "key", "bands"])


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as sorted items and counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / max(a[1].sum() + b[1].sum() - both, 1)


def _verify(batches):
    for batch in _util.steps(batches, "ta"):
        n = batch.num_rows
        sides = []
        for name in ("ta", "tb"):
            row, item, count = shingles(Words.of(batch.column(name)), SHINGLE)
            sides.append((row, item, count))
        # one sort of both sides' items by pair and item
        row = np.concatenate([s[0] for s in sides])
        item = np.concatenate([s[1] for s in sides])
        count = np.concatenate([s[2] for s in sides])
        order = np.lexsort((item, row))
        row, item, count = row[order], item[order], count[order]
        same = (row[1:] == row[:-1]) & (item[1:] == item[:-1])
        both = np.bincount(row[1:][same], np.minimum(count[1:], count[:-1])[same], n)
        total = np.bincount(row, count, n)
        ok = both >= THRESHOLD * (total - both) - 1e-9
        yield pa.record_batch([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])


def _elements(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and item of each element of a column of sets."""
    size = np.asarray(col.value_lengths()).astype(np.int64)
    return np.repeat(np.arange(len(col)), size), col.flatten().to_numpy().view(U)


def _pieces(batches):
    """Slices of batches of sets, as _tiles cuts them."""
    for batch in batches:
        for tile in _tiles(np.asarray(batch.column("items").value_lengths()), np.arange(batch.num_rows)):
            yield batch.slice(tile[0], len(tile))
    _util.trim()


def _tally(batches):
    """Per cell the number of elements of sets in it."""
    total = np.zeros(CELLS, np.int64)
    for batch in _pieces(batches):
        item = _elements(batch.column("items"))[1]
        total += np.bincount((item & U(CELLS - 1)).astype(np.int64), minlength=CELLS)
    cell = np.flatnonzero(total)
    yield pa.record_batch([pa.array(cell, pa.int64()), pa.array(total[cell], pa.int64())], names=["cell", "n"])


def prefixes(row: np.ndarray, item: np.ndarray, count: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of each row's prefix, the weight of each one's item and of all more common ones, and the row's weight.

    The items of two rows that overlap by t are at most as common as the first they share, with a weight of at least t behind it in both.
    """
    order = np.lexsort((item, common[(item & U(CELLS - 1)).astype(np.int64)], row))
    rows = int(row.max()) + 1 if len(row) else 0
    weight = np.bincount(row, count, rows).astype(np.int64)
    done = np.cumsum(count[order]) - count[order]
    behind = weight[row[order]] - (done - (np.cumsum(weight) - weight)[row[order]])
    at = behind >= THRESHOLD * weight[row[order]] - 1e-6
    return order[at], behind[at], weight[row[order][at]]


def _families(rows: DataFrame) -> DataFrame:
    """rows: family, component, items (sets). Per component that shares an item of its prefixes with another of its family: component, family (the smallest component it leads to by these)."""
    spark = rows.sparkSession
    tally = rows.select("items").mapInArrow(_tally, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(CELLS, np.int64)
    common[tally.column("cell").to_numpy()] = tally.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(common)
    # least weight that similar classes share: of both weights together, and of twice the smaller one
    share = THRESHOLD / (1 + THRESHOLD)

    def run(batches):
        for batch in _pieces(batches):
            row, item = _elements(batch.column("items"))
            at, behind, weight = prefixes(row, item, np.ones(len(item), np.int64), shared.value)
            which = pa.array(row[at])
            yield pa.record_batch([batch.column("family").take(which), pa.array(item[at].view(np.int64)), batch.column("component").take(which), pa.array(behind >= 2 * share * weight - 1e-6)], names=["family", "item", "component", "first"])

    listed = rows.select("family", "component", "items").mapInArrow(run, "family bigint, item bigint, component bigint, first boolean").groupBy("family", "item", "component").agg(F.max("first").alias("first"))
    listed = _util.cut(listed)
    least = listed.groupBy("family", "item").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("first").alias("first")).where("low < high and first").select("family", "item", "low")
    links = listed.join(least, ["family", "item"]).select(F.col("component").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    out = _util.cut(components(links)).select(F.col("node").alias("component"), F.col("component").alias("family"))
    _util.drop_cut(listed)
    return out


def _multisets(batches):
    """A text's multiset as a sorted set: the second of equal shingles is an item of its own, and so on."""
    for batch in _util.steps(batches, "text"):
        row, item, count = shingles(Words.of(batch.column("text")), SHINGLE)
        at = np.repeat(np.arange(len(item)), count)
        again = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        x, row = mix(item[at] + U(_GOLD) * again.astype(U)).view(np.int64), row[at]
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(ends), pa.array(x[np.lexsort((x, row))]))
        yield pa.record_batch([batch.column("key"), batch.column("component"), items, items.value_lengths()], names=["key", "component", "items", "n"])


def _tiles(size: np.ndarray, which: np.ndarray) -> list[np.ndarray]:
    """Rows in runs of at most TILE rows, and of TILE_ITEMS items or one row."""
    out, start, total = [], 0, 0
    for i, n in enumerate(size[which].tolist()):
        if i > start and (i - start >= TILE or total + n > TILE_ITEMS):
            out.append(which[start:i])
            start, total = i, 0
        total += n
    return [*out, which[start:]] if len(which) else []


def _overlaps(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], rows: int, cols: int) -> np.ndarray:
    """x, y: row and item of each element of sets. How many items each row of x has in common with each of y."""
    both = np.intersect1d(x[1], y[1])
    out = np.zeros((rows, cols))
    sides = []
    for r, item in (x, y):
        at = np.minimum(np.searchsorted(both, item), max(len(both) - 1, 0))
        on = both[at] == item if len(both) else np.zeros(len(item), bool)
        order = np.argsort(at[on], kind="stable")
        sides.append((r[on][order], at[on][order]))
    for low in range(0, len(both), WIDE):
        m = []
        for (r, at), n in zip(sides, (rows, cols)):
            lo, hi = np.searchsorted(at, (low, low + WIDE))
            part = np.zeros((n, min(WIDE, len(both) - low)), np.float32)  # sums of at most WIDE ones are exact
            part[r[lo:hi], at[lo:hi] - low] = 1
            m.append(part)
        out += m[0] @ m[1].T
    return out


def _links_between(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Two blocks of a family, or one with itself: links that join its components, as few as join all that these rows do."""
    table = table.combine_chunks()
    side = table.column("side").to_numpy()
    ids, comp = table.column("key").to_numpy(), table.column("component").to_numpy()
    items = table.column("items").combine_chunks()
    items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
    size = np.asarray(items.value_lengths()).astype(np.int64)
    flat, ends = items.flatten().to_numpy(), np.cumsum(size)
    kinds, place = np.unique(comp, return_inverse=True)
    alone = not side.any()
    left = _tiles(size, np.flatnonzero(~side))
    right = left if alone else _tiles(size, np.flatnonzero(side))

    def elements(tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(tile)), size[tile]), np.concatenate([flat[ends[i] - size[i] : ends[i]] for i in tile.tolist()])

    found = Union(len(kinds))
    a, b = [], []
    for p, x in enumerate(left):
        ex = elements(x)
        for y in right[p if alone else 0 :]:
            if place[x].min() == place[x].max() == place[y].min() == place[y].max():
                continue
            n = _overlaps(ex, elements(y), len(x), len(y))
            total = size[x][:, None] + size[y][None, :]
            i, j = np.nonzero((n >= THRESHOLD * (total - n) - 1e-9) & (place[x][:, None] != place[y][None, :]))
            for u, v in zip(x[i].tolist(), y[j].tolist()):
                if found.join(int(place[u]), int(place[v])):
                    a.append(int(ids[u]))
                    b.append(int(ids[v]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _family_links(texts: DataFrame, families: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """texts: key, component, text; families: component, family; buckets: bucket, key. Links between the components of each family.

    Rows of a family are dealt into blocks, large components into blocks of
    their own, and each pair of blocks that can hold a link is compared inside
    one task, so no pair of rows is ever sent. With buckets, families of more
    than a block are split by prefixes first, and what is still larger than a
    block is compared bucket by bucket where that sends less: a row of a family
    goes to all its blocks, a row of buckets to those of its own few.
    """
    sets = _util.cut(texts.select("key", "component", "text").mapInArrow(_multisets, "key bigint, component bigint, items array<bigint>, n int"))
    # key, component, n and family: where each row is to be compared
    members = sets.select("key", "component", F.col("n").cast("bigint").alias("n")).join(families, "component")
    if buckets is not None:
        members = _split(sets, families, members, buckets)
    sizes = members.groupBy("family", "component").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("rows"))
    sizes = sizes.withColumn("large", (F.col("items") > BLOCK_ITEMS) | (F.col("rows") > BLOCK_ROWS))
    # a block is (component, number), with a null component for those of many small components
    of = sizes.groupBy("family", F.when(F.col("large"), F.col("component")).alias("of")).agg(F.sum("items").alias("items"), F.sum("rows").alias("rows")).select("family", "of", _blocks().alias("blocks"))
    all_ = of.select("family", "of", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).groupBy("family").agg(F.collect_list(F.struct("of", "block")).alias("all"))
    dealt = sizes.select("family", "component", F.when(F.col("large"), F.col("component")).alias("of"))
    dealt = dealt.join(of, (dealt["family"] == of["family"]) & dealt["of"].eqNullSafe(of["of"])).select("component", dealt["of"], "blocks", dealt["family"]).join(all_, "family")
    own = F.pmod(F.xxhash64(F.lit(5), F.when(F.col("of").isNull(), F.col("component")).otherwise(F.col("key"))), F.col("blocks")).cast("int")
    placed = members.join(dealt, ["family", "component"]).withColumn("own", F.struct("of", own.alias("block")))
    other = F.filter("all", lambda e: e["of"].isNull() | ~e["of"].eqNullSafe(F.col("own.of")))
    sent = placed.select("family", "key", "own", F.explode(other).alias("o"))
    sent = sent.select("key", F.struct("family", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), (F.col("own") > F.col("o")).alias("side")).alias("to"))
    # the sets themselves are shuffled to meet their places once, then to these
    sent = sets.select("key", "component", "items").join(sent.groupBy("key").agg(F.collect_list("to").alias("to")), "key").select("key", "component", "items", F.inline("to"))
    return sent.groupBy("family", "p", "q").applyInArrow(_links_between, "a bigint, b bigint")


def _blocks() -> Column:
    return F.ceil(F.greatest(F.col("items") / BLOCK_ITEMS, F.col("rows") / BLOCK_ROWS)).cast("int")


def _split(sets: DataFrame, families: DataFrame, members: DataFrame, buckets: DataFrame) -> DataFrame:
    """members with families of more than a block in smaller parts: by prefixes, and then by buckets where these are less to send."""
    sums = [F.sum("n").alias("items"), F.count(F.lit(1)).alias("rows")]
    wide = _util.cut(members.groupBy("family").agg(*sums).where(_blocks() > 1).select("family"))
    if wide.isEmpty():
        return members
    narrow = members.join(wide, "family", "left_anti")
    finer = _families(sets.join(families.join(wide, "family", "left_semi"), "component"))
    parts = _util.cut(sets.select("key", "component", F.col("n").cast("bigint").alias("n")).join(finer, "component"))
    total = parts.groupBy("family").agg(*sums).select("family", "items", _blocks().alias("blocks")).where("blocks > 1").select("family", (F.col("items") * F.col("blocks")).alias("cost"))
    shared = parts.join(total.select("family"), "family", "left_semi").join(buckets, "key").select("key", "component", "n", "family", "bucket")
    by = shared.groupBy("family", "bucket").agg(*sums, F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("family", "bucket", (F.col("items") * _blocks()).alias("each"))
    each = by.groupBy("family").agg(F.sum("each").alias("each"))
    cheap = _util.cut(total.join(each, "family", "left").where(F.coalesce("each", F.lit(0)) < F.col("cost")).select("family"))
    dealt = shared.join(by.join(cheap, "family", "left_semi"), ["family", "bucket"]).select("key", "component", "n", F.xxhash64("family", "bucket").alias("family"))
    rest = parts.join(cheap, "family", "left_anti")
    cols = ["key", "component", "n", "family"]
    return narrow.select(cols).unionByName(rest.select(cols)).unionByName(dealt)


def bucket_families(held: DataFrame, most_links: int | None = None) -> DataFrame:
    """held: bucket, component. Per component that shares a bucket with another: component, family (the smallest component it leads to by these)."""
    low = held.groupBy("bucket").agg(F.min("component").alias("low"))
    links = held.join(low, "bucket").select(F.col("component").alias("a"), F.col("low").alias("b"))
    return components(links, most_links).select(F.col("node").alias("component"), F.col("component").alias("family"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: row (its number, see number_rows), id, class key (null without a word) and component (the smallest class key of its group)."""
    spark = docs.sparkSession
    _util.ship(spark)
    docs = _util.steady(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    ids = docs.select(F.monotonically_increasing_id().alias("row"), "id")
    described = _util.cut(numbered.select("row", "text").mapInArrow(_describe, "row bigint, key bigint, bands array<bigint>"))
    most = described.count() * BANDS
    rows = described.select("row", "key")
    # one row per class: the smallest row number stands for it; its bands are those of any member
    classes = described.where("key is not null").groupBy("key").agg(F.min("row").alias("row"))
    buckets = classes.join(described.select("row", "bands"), "row").select("key", F.explode("bands").alias("bucket"))
    buckets = _util.cut(buckets, most)
    order = lambda salt: F.xxhash64(F.lit(salt), "key", "bucket")
    # only buckets of several classes count; a class is the more central the more classes its buckets hold
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = _util.cut(buckets.join(sizes, "bucket"), most)
    central = shared.groupBy("key").agg(F.sum("n").alias("score"))
    scored = shared.select("bucket", "key").join(central, "key")
    pivots = scored.groupBy("bucket").agg(F.max(F.struct("score", F.col("key").alias("pivot"))).alias("p"), F.min(F.struct(order(0).alias("h"), F.col("key").alias("pivot"))).alias("q")).select("bucket", F.array("p.pivot", "q.pivot").alias("pivots"))
    pairs = shared.select("bucket", "key").join(pivots, "bucket").select("key", F.explode("pivots").alias("pivot")).where("key <> pivot")
    candidates = pairs.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b"), F.col("key").alias("from")).groupBy("a", "b", "from").agg(F.count(F.lit(1)).alias("times"))
    candidates = _util.cut(candidates, 2 * most)

    def texts_of(table: DataFrame) -> DataFrame:
        """table: key, to (array). The text of each class with its values, read where its row stands."""
        rows = RowTable(classes.join(table, "key").select("row", F.concat(F.array("key"), "to").alias("to")))
        found = numbered.select("text", rows.get(F.col("row")).alias("to")).where("to is not null")
        out = _util.cut(found.select(F.get("to", F.lit(0)).alias("key"), F.slice("to", 2, F.size("to")).alias("to"), "text"))
        rows.drop()
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs: from, to; a few for each from. Their links; each text goes to those it is compared with, by one shuffle."""
        send = pairs.select(F.col("from").alias("key"), "to").unionAll(pairs.select(F.col("to").alias("key"), "to").distinct())
        sent = texts_of(send.groupBy("key").agg(F.collect_list("to").alias("to")))
        one = sent.select("key", F.explode("to").alias("to"), "text")
        left = one.where("key <> to").select(F.col("to").alias("b"), F.col("key").alias("a"), F.col("text").alias("ta"))
        right = one.where("key = to").select(F.col("key").alias("b"), F.col("text").alias("tb"))
        links = _util.cut(left.join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_verify, "a bigint, b bigint"), most)
        _util.drop_cut(sent)
        return links

    def grouped(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """pairs a, b with their groups ca, cb, where these differ."""
        for k in ("a", "b"):
            pairs = pairs.join(comp.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")), k, "left").withColumn(f"c{k}", F.coalesce(f"c{k}", k))
        return pairs.where("ca <> cb")

    # each class takes the candidate it shares most bands with; then all that still lead to other groups are tried
    other = F.when(F.col("a") == F.col("from"), F.col("b")).otherwise(F.col("a")).alias("to")
    best = candidates.groupBy("from").agg(F.max(F.struct("times", F.xxhash64("a", "b").alias("h"), "a", "b")).alias("m")).groupBy("m.a", "m.b").agg(F.min("from").alias("from"))
    best = _util.cut(best, most)
    links = verified(best.select("from", other))
    comp = _util.cut(components(links, most), most)
    _util.drop_cut(links)
    rest = grouped(candidates.groupBy("a", "b").agg(F.min("from").alias("from")).join(best, ["a", "b"], "left_anti"), comp)
    links = verified(rest.select("from", other))
    comp = _merge(comp, links, grouped, most)
    _util.drop_cut(links)
    # the classes of buckets that still hold several groups
    held = shared.join(comp.select(F.col("node").alias("key"), "component"), "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("component"))
    several = held.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    mixed = _util.cut(held.join(several, "bucket", "left_semi").select("bucket", "key", "component"), most)
    if not mixed.isEmpty():
        texts = texts_of(mixed.select("key", F.array("component").alias("to")).distinct())
        named = texts.select("key", F.get("to", F.lit(0)).alias("component"), "text")
        families = _util.cut(bucket_families(mixed, most), most)
        links = _util.cut(_family_links(named, families, mixed.select("bucket", "key")))
        comp = _merge(comp, links, grouped, most)
        for done in (texts, families, links):
            _util.drop_cut(done)
    for done in (buckets, shared, candidates, best, mixed):
        _util.drop_cut(done)
    out = rows.join(comp.withColumnRenamed("node", "key"), "key", "left").select("row", "key", F.coalesce("component", "key").alias("component"))
    return ids.join(out, "row").select("row", "id", "key", "component")


def _merge(comp: DataFrame, links: DataFrame, grouped, most: int) -> DataFrame:
    """comp after further links; comp itself if there is none."""
    found = _util.cut(grouped(links, comp).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), most)
    return comp if found.isEmpty() else _util.cut(joined(comp, found, most), most)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: row, id, component_id (the smallest id of the group; null if the group has none) and kept: the group's row of the smallest id (nulls last), the first of equal ones.

    A row without a word is its own group.
    """
    g = _util.cut(groups(docs, id_col, text_col))
    first = g.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row")).alias("m"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    # a group's first row is there SALT times, so that a large group is dealt over as many tasks; rows alone in their group need none
    first = first.select("component", F.col("m.id").alias("component_id"), F.col("m.row").alias("keep"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    out = g.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(first, ["component", "salt"], "left")
    alone = F.col("keep").isNull()
    return out.select("row", "id", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, True).otherwise(F.col("row") == F.col("keep")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, with docs' own columns. The rows are never shuffled: each task reads which of its own go."""
    names = docs.columns
    inner = _util.steady(docs.toDF(*[f"__c{i}" for i in range(len(names))]))
    found = deduplicated(inner, f"__c{names.index(id_col)}", f"__c{names.index(text_col)}")
    gone = RowTable(found.where("not kept").select("row", F.array().cast("array<bigint>").alias("to")))
    numbered = inner.withColumn("__gone", gone.has(F.monotonically_increasing_id()))
    return numbered.where("not __gone").drop("__gone").toDF(*names)
