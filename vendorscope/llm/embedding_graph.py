"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors become one node with a weight. Centroids come from spherical
   k-means on a bounded sample (``SAMPLE_PER_SHARD`` nodes a shard, at most
   ``MAX_SHARDS`` shards); every node goes to its ``overlap`` nearest shards.
2. Shards over ``cap`` nodes are split into blocks. In each block every node
   gets a robust-pruned neighbour list (candidates nearest first; a candidate
   goes when a kept one is nearer to it by the factor ALPHA), with reverse
   edges. A node's lists from all its shards are united.
3. Search: every node is a query in each of its shards, against every block.
   From the block's medoids a greedy beam search walks the united graph; then
   every visited node within ``EXPAND`` of the query is expanded too, until no
   new one turns up, so whole ranges are found, not the nearest few.
4. Found pairs are verified in double precision. A pair that shares several
   shards counts in the least of them, so no pair list is needed: a task sums
   weights per query and returns a spanning forest of its links. Components
   follow.
5. Audit: for sampled nodes the true number of linked nodes is counted against
   all nodes. The sample goes on until ``AUDIT`` nodes with a link were seen, and
   ``STRATUM`` of each size of neighbourhood (powers of two) met by then; where
   links are rare that may be the whole table. Recall is the mean over nodes with
   a link, copies aside, or that of the worst such size. Below ``least_recall``
   the search runs again with more overlap and a wider beam; after ``tries``, and
   once that costs as much, all pairs of nodes are compared, block by block.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
parts link with nothing; vectors of different length are never compared; rows
with a null id have no component and are not kept; rows with equal ids are
separate vectors; copies are linked with each other; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorscope.llm.common import by_value, shuffle_partitions, stored
from vendorscope.llm.components import components

by_value(__name__)

THRESHOLD = 0.9
EXPAND = 0.8
OVERLAP = 3
BEAM = 32
DEGREE, CANDIDATES, ALPHA = 16, 48, 1.2
CAP = 512
SHARD_NODES = 256
SAMPLE_PER_SHARD, MAX_SHARDS = 16, 4096
AUDIT, STRATUM, AUDIT_ROUND = 256, 32, 8192
EXACT_CAP = 1024
MEDOIDS = 8


def vectors_of(column: pa.Array) -> np.ndarray:
    """(rows, dim) float32; all lists have one length."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)     # large parts would overflow the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors; starts from spread-out rows."""
    centres = x[np.random.default_rng(11).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return centres


def assign_batches(centres, overlap: int):
    """mapInArrow body: (key, weight, dim, embedding) -> the same, with the
    node's shards (numbered per dim), nearest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = centres.value
        for b in batches:
            dims = b.column(2).to_numpy()
            shards: list = [None] * b.num_rows
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                first, table = tables[int(dim)]
                near = unit(vectors_of(b.column(3).take(pa.array(at)))) @ table.T
                k = min(overlap, table.shape[0])
                top = np.argsort(-near, axis=1, kind="stable")[:, :k] + first
                for i, row in zip(at.tolist(), top.tolist()):
                    shards[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shards, pa.list_(pa.int32()))],
                                             [*b.schema.names, "shards"])
    return run


def robust_prune(x: np.ndarray) -> np.ndarray:
    """(n, DEGREE) neighbour numbers, -1 where there are fewer."""
    n = len(x)
    out = np.full((n, DEGREE), -1, np.int64)
    if n < 2:
        return out
    far = np.maximum(2 - 2 * (x @ x.T), 0).astype(np.float32)
    np.fill_diagonal(far, np.inf)
    k = min(CANDIDATES, n - 1)
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    order = np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    own = np.take_along_axis(far, near, 1)
    alive = np.ones(near.shape, bool)
    rows = np.arange(n)
    for r in range(DEGREE):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = near[rows, alive.argmax(axis=1)]
        out[some, r] = pick[some]
        alive &= (ALPHA * far[pick[:, None], near] > own) & (near != pick[:, None])
    return out


def grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal leading columns of sorted batches, as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(columns)], 1)
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, z in zip(cuts, cuts[1:]):
            key = tuple(keys[a].tolist())
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(a, z - a))
    if held:
        yield last, pa.Table.from_batches(held)


def build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over (shard, block, key, embedding) sorted by block:
    (key, neighbour keys), both directions of every edge."""
    for _, t in grouped(batches, 2):
        keys = t.column(2).to_numpy()
        out = robust_prune(unit(vectors_of(t.column(3).combine_chunks())))
        a, r = np.nonzero(out >= 0)
        z = out[a, r]
        u, v = np.concatenate([keys[a], keys[z]]), np.concatenate([keys[z], keys[a]])
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["key", "near"])


def search(q: np.ndarray, x: np.ndarray, adjacency: np.ndarray, beam: int) -> np.ndarray:
    """Similarities of the nodes each query visited (-1 elsewhere): beam
    search from medoids, then expansion of the whole range."""
    nq, n = len(q), len(x)
    seen = np.full((nq, n), -1.0, np.float32)
    opened = np.zeros((nq, n), bool)
    starts = medoids(x)
    first = q @ x[starts].T
    seen[:, starts] = first
    top = np.full((nq, beam), -1.0, np.float32)
    k = min(beam, len(starts))
    top[:, :k] = -np.sort(-first, axis=1)[:, :k]
    active = np.arange(nq)
    while len(active):
        best = np.where(opened[active], np.float32(-2), seen[active]).argmax(axis=1)
        value = seen[active, best]
        go = ~opened[active, best] & (value > -1) & ((value >= top[active].min(axis=1)) | (value >= EXPAND))
        active, best = active[go], best[go]
        if not len(active):
            break
        opened[active, best] = True
        near = adjacency[best]
        a, r = np.nonzero(near >= 0)
        node = near[a, r]
        new = seen[active[a], node] == -1
        a, r, node = a[new], r[new], node[new]
        if len(a):
            sims = np.maximum(np.einsum("ij,ij->i", q[active[a]], x[node]), np.float32(-0.999999))
            seen[active[a], node] = sims
            fresh = np.full(near.shape, -1.0, np.float32)
            fresh[a, r] = sims
            both = np.concatenate([top[active], fresh], axis=1)
            top[active] = -np.partition(-both, beam - 1, axis=1)[:, :beam]
    return seen


def medoids(x: np.ndarray) -> np.ndarray:
    """The node nearest the mean, and spread-out ones far from it and from
    each other (farthest first)."""
    mean = x.mean(axis=0)
    out = [int((x @ mean).argmax())]
    best = x @ x[out[0]]
    for _ in range(min(MEDOIDS, len(x)) - 1):
        out.append(int(best.argmin()))
        best = np.maximum(best, x @ x[out[-1]])
    return np.unique(out)


class Links:
    """Union-find over node keys."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, a: int) -> int:
        while (p := self.parent.get(a, a)) != a:
            self.parent[a] = a = self.parent.get(p, p)
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def search_cells(threshold: float, beam: int | None):
    """mapInArrow body over (shard, i, j, role, key, weight, shards, embedding,
    near) sorted by cell; role 1: data, 2: query, 3: both; without a beam every
    pair is compared. Returns (key, n, pairs, other): summed weights and linked
    nodes per query, and edges of a spanning forest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, *_), t in grouped(batches, 3):
            role, key = t.column(3).to_numpy(), t.column(4).to_numpy()
            weight, homes = t.column(5).to_numpy(), t.column(6).to_pylist()
            x = unit(vectors_of(t.column(7).combine_chunks()))
            near = t.column(8).to_pylist()
            data, query = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
            if not len(data) or not len(query):
                continue
            x32 = x.astype(np.float32)
            if beam is None:
                sims = x32[query] @ x32[data].T
            else:
                number = {k: i for i, k in enumerate(key[data].tolist())}
                lists = [[number[y] for y in near[i] or () if y in number] for i in data.tolist()]
                adjacency = np.full((len(data), max(1, max(map(len, lists)))), -1, np.int64)
                for i, own in enumerate(lists):
                    adjacency[i, :len(own)] = own
                sims = search(x32[query], x32[data], adjacency, beam)
            a, z = np.nonzero(sims >= threshold - 1e-4)
            a, z = query[a], data[z]
            ok = key[a] != key[z]
            a, z = a[ok], z[ok]
            if len(query) == len(data) and (query == data).all():       # both directions of a found pair
                pairs = np.unique(np.concatenate([np.stack([a, z], 1), np.stack([z, a], 1)]), axis=0)
                a, z = pairs[:, 0], pairs[:, 1]
            # verified in double precision, some pairs at a time
            ok = np.concatenate([np.einsum("ij,ij->i", x[a[s:s + 65536]], x[z[s:s + 65536]]) >= threshold
                                 for s in range(0, len(a), 65536)] or [np.zeros(0, bool)])
            a, z = a[ok], z[ok]
            links, total, nodes = Links(), {}, {}
            for i, j in zip(a.tolist(), z.tolist()):
                if min(set(homes[i]) & set(homes[j])) == shard:
                    total[i] = total.get(i, 0) + int(weight[j])
                    nodes[i] = nodes.get(i, 0) + 1
                links.join(int(key[i]), int(key[j]))
            edges = [(k, r) for k in list(links.parent) if (r := links.find(k)) != k]
            rows = [(int(key[i]), n, nodes[i], None) for i, n in total.items()] + [(k, None, None, r) for k, r in edges]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)], ["key", "n", "pairs", "other"])
    return run


def count_true(sample, threshold: float):
    """mapInArrow body: (key, dim, embedding) -> (key, pairs): the nodes of each
    batch that the sampled nodes are linked with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, dims = (b.column(k).to_numpy() for k in range(2))
            for dim, (own, table) in sample.value.items():
                at = np.flatnonzero(dims == dim)
                total = np.zeros(len(own), np.int64)
                for s in range(0, len(at), 2048):              # some pairs at a time
                    part = at[s:s + 2048]
                    x = unit(vectors_of(b.column(2).take(pa.array(part)))).T
                    for o in range(0, len(own), 1024):
                        hit = table[o:o + 1024] @ x >= threshold
                        hit &= own[o:o + 1024, None] != keys[part][None, :]
                        total[o:o + 1024] += hit.sum(axis=1)
                some = np.flatnonzero(total)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(total[some])], ["key", "pairs"])
    return run


def by_dim(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for dim in sorted({r["dim"] for r in rows}):
        own = [r for r in rows if r["dim"] == dim]
        out[dim] = (np.array([r["key"] for r in own], np.int64),
                    unit(np.array([r["embedding"] for r in own], np.float32)))
    return out


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda e: e != 0))


def near_links(nodes: DataFrame, n: int, threshold: float, overlap: int, beam: int | None,
               cap: int) -> DataFrame:
    """(key, n, pairs, other) rows of all cells, stored; without a beam one
    shard holds all nodes of a length, and every pair is compared."""
    spark = nodes.sparkSession
    shards = 1 if beam is None else max(1, min(MAX_SHARDS, -(-2 * n // SHARD_NODES)))
    fraction = min(1.0, shards * SAMPLE_PER_SHARD / max(1, n))
    picked = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 20)) < F.lit(fraction * (1 << 20))
    # about MAX_SHARDS * SAMPLE_PER_SHARD vectors at most, whatever the input
    sample = by_dim(nodes.filter(picked).select("key", "dim", "embedding").collect())
    dims = [r["dim"] for r in nodes.select("dim").distinct().collect()]
    tables, first = {}, 0
    for dim in sorted(dims):
        _, x = sample.get(dim, (None, np.eye(1, dim)))
        table = kmeans(x, max(1, min(len(x), round(shards * len(x) / max(1, sum(len(k) for k, _ in sample.values()))))))
        tables[dim] = (first, table)
        first += len(table)
    schema = "key long, weight long, dim int, embedding array<float>, shards array<int>"
    placed = stored(nodes.select("key", "weight", "dim", "embedding")
                    .mapInArrow(assign_batches(spark.sparkContext.broadcast(tables), overlap), schema), "placed")
    each = placed.withColumn("shard", F.explode("shards"))
    # one row per shard: at most MAX_SHARDS (and one a length of vectors)
    blocks = F.broadcast(each.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / cap).cast("int").alias("blocks")))
    each = each.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("key", F.lit(5)), "blocks").cast("int"))
    parts = shuffle_partitions(spark)
    if beam is None:
        graph = each.withColumn("near", F.lit(None).cast("array<long>"))
    else:
        edges = (each.select("shard", "block", "key", "embedding").repartition(parts, "shard", "block")
                 .sortWithinPartitions("shard", "block").mapInArrow(build_blocks, "key long, near long"))
        united = edges.groupBy("key").agg(F.collect_set("near").alias("near"))     # a few dozen a node
        graph = each.join(united, "key", "left")
    whole = F.sequence(F.lit(0), F.col("blocks") - 1)
    cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    own = F.col("block")
    cells = F.concat(
        F.array(cell(own, own, 3)),
        F.transform(F.filter(whole, lambda k: k != own), lambda k: cell(k, own, 1)),
        F.transform(F.filter(whole, lambda k: k != own), lambda k: cell(own, k, 2)))
    rows = graph.withColumn("cell", F.explode(cells)).select(
        "shard", "cell.i", "cell.j", "cell.role", "key", "weight", "shards", "embedding", "near")
    return stored(rows.repartition(parts, "shard", "i", "j").sortWithinPartitions("shard", "i", "j", "key")
                  .mapInArrow(search_cells(threshold, beam), "key long, n long, pairs long, other long"), "near-links")


def recall_of(true: np.ndarray, found: np.ndarray) -> float:
    """The mean recall of nodes with links, or the least by size of their
    neighbourhood where ``STRATUM`` nodes have it."""
    part = np.minimum(found / true, 1.0)
    size = np.log2(true).astype(int)
    return float(min([part.mean(), *(part[size == k].mean() for k in np.unique(size) if (size == k).sum() >= STRATUM)]))


def audit_recall(nodes: DataFrame, n: int, counts: DataFrame, threshold: float) -> float:
    """Recall over a sample of nodes with a link (1 where no node has any)."""
    spark = nodes.sparkSession
    place = F.pmod(F.xxhash64("key", F.lit(9)), F.lit(1 << 40))
    true, found, needed = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    begin, more = 0, AUDIT
    while begin < 1 << 40:
        end = min(1 << 40, begin + max(1, round(more / max(1, n) * (1 << 40))))
        chosen = nodes.filter((place >= F.lit(begin)) & (place < F.lit(end)))
        sample = by_dim(chosen.select("key", "dim", "embedding").collect())
        if sample:
            seen = (nodes.select("key", "dim", "embedding")
                    .mapInArrow(count_true(spark.sparkContext.broadcast(sample), threshold), "key long, pairs long")
                    .groupBy("key").agg(F.sum("pairs").alias("true"))
                    .join(counts.select("key", "pairs"), "key", "left")
                    .select("true", F.coalesce("pairs", F.lit(0)).alias("found")).collect())     # one row a sampled node
            true = np.append(true, np.array([r["true"] for r in seen], np.int64))
            found = np.append(found, np.array([r["found"] for r in seen], np.int64))
        if len(true) >= AUDIT:
            size = np.log2(true).astype(int)
            needed = set(size.tolist()) if needed is None else needed
            if all((size == k).sum() >= STRATUM for k in needed):
                break
        begin, more = end, min(AUDIT_ROUND, 4 * more)
    return recall_of(true, found) if len(true) else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vec_col: str = "embedding", least_recall: float = 0.95, overlap: int = OVERLAP,
                    beam: int = BEAM, cap: int = CAP, tries: int = 3) -> DataFrame:
    """One row per row: id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("embedding"))
    nodes = stored(usable(rows.filter("id is not null"), "embedding").groupBy("embedding")
                   .agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("id"))
                   .withColumn("key", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "nodes")
    n = nodes.count()
    attempt = 0
    while True:
        exact = attempt >= tries and overlap * overlap * cap > 4 * n       # raised overlap costs as much by then
        links = near_links(nodes, n, threshold, 1 if exact else overlap, None if exact else beam,
                           EXACT_CAP if exact else cap)
        counts = links.filter("n is not null").groupBy("key").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs"))
        if exact or audit_recall(nodes, n, counts, threshold) >= least_recall:
            break
        attempt += 1
        overlap, beam = overlap + 2 if attempt < tries else 2 * overlap, min(2 * beam, 1024)
    found = components(links.filter("other is not null").select(F.col("key").alias("u"), F.col("other").alias("v")),
                       "near-edges")
    homes = nodes.select("key", "id").join(found, nodes["key"] == found["node"], "left").select(
        "key", "id", F.coalesce("component", "key").alias("root"))
    least = homes.groupBy("root").agg(F.min("id").alias("component_id"))
    known = (nodes.select("key", "weight", "embedding").join(homes.select("key", "root"), "key").join(least, "root")
             .join(counts, "key", "left")
             .select("embedding", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    return (rows.join(known, "embedding", "left")
            .select(F.col("id").alias(id_col),
                    F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))
