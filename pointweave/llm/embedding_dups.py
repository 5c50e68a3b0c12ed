"""Near-duplicate embeddings: a flat graph built on overlapping shards, searched by expanding ranges.

1. Equal vectors collapse to one node.  Spherical k-means on a bounded sample gives centres; every node belongs to the
   shards of its ``overlap`` nearest centres.  Beyond MOST_SHARDS centres a second level is fitted inside each cell of the
   first, in tasks, so that shards keep their size.  A shard with more than CAP nodes is dealt to blocks.
2. In each block every node takes its nearest candidates and some of the block's nodes far away through robust pruning:
   a candidate is dropped if one already taken is closer to it by a factor ALPHA than the node itself.  A node's
   adjacency lists from all its blocks are united.
3. In each shard (in a large one for every two blocks) all nodes are queries: a greedy beam search from the medoids of the
   shard's parts, then the range is expanded over the graph from every node found with a cosine over SLACK.  Pairs are
   verified in double precision; a pair belongs to the lowest of its common shards and counts only there, so a task gives
   out numbers of links and at most one link for each node (a spanning forest), never the pairs.  The work inside a task
   is that of the pairs there are: ``n_links`` counts every link, also in a large group.
4. Recall is measured against brute force for the nodes of all ids divisible by ASKED, strip by strip against all nodes:
   the mean over queries, taken apart for small and large groups.  While the least of these means is under TARGET the
   search is repeated with other centres, twice the overlapping shards and twice the beam; where the widest search stays
   under TARGET, all nodes are compared exactly, strip by strip (quadratic; a warning is logged).

Defined results: a vector that is null, empty, zero or has a null or non-finite component is linked with nothing; vectors of
different lengths are never linked.  Equal vectors are linked.  Every row gets a row; rows that repeat an id each count as
a vector; the component is the smallest id in it.  An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.components import connected_components
from pointweave.plans.lineage import cut, drop

COSINE = 0.9
SLACK = 0.82
#: Nodes for one centre where each node lies in OVERLAP shards, nodes of a block, and centres of one level.
SHARD, CAP, MOST_SHARDS = 375, 2000, 1024
#: Vectors for fitting the centres of the first level, and for one centre of the second (expected numbers).
SAMPLE, FOR_CENTRE = 20_000, 20
#: Nodes that one task gives to the second level's centres (expected).
CHUNK = 50_000
#: Ids divisible by this are the audit's queries.
ASKED = 50
#: Queries that a band of the audit needs to stand alone; thinner bands are taken together.
BAND = 20
#: Searches before the exact comparison, and vectors that a strip holds (expected).
ATTEMPTS, STRIP = 2, 16_000
DEGREE, NEAR, FAR, ALPHA = 16, 40, 24, 1.2
BEAM, STARTS = 24, 64
OVERLAP = 4
TARGET = 0.95
_SUB = 20
_FOUND = "node long, other long, n long, w long"
_LOG = logging.getLogger(__name__)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def centres(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means; an empty cluster takes a random vector."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), x[rng.integers(0, len(x), len(c))])
    return c


def robust_prune(x: np.ndarray, seed: int = 11) -> list[np.ndarray]:
    """Out-neighbours (places) of every row of unit vectors."""
    n = len(x)
    rng = np.random.default_rng(seed)
    out = []
    for begin in range(0, n, 512):
        s = x[begin : begin + 512] @ x.T
        s[np.arange(len(s)), np.arange(begin, begin + len(s))] = -2
        near = np.argpartition(-s, min(NEAR, n - 1) - 1, axis=1)[:, :NEAR] if n > NEAR else np.tile(np.arange(n), (len(s), 1))
        for r in range(len(s)):
            cand = np.unique(np.concatenate([near[r], rng.integers(0, n, FAR)]))
            cand = cand[cand != begin + r]
            d = 2 - 2 * s[r, cand]
            cand, d = cand[np.argsort(d, kind="stable")], np.sort(d, kind="stable")
            between = 2 - 2 * (x[cand] @ x[cand].T)
            alive = np.ones(len(cand), bool)
            taken = []
            for k in range(len(cand)):
                if alive[k]:
                    taken.append(cand[k])
                    if len(taken) == DEGREE:
                        break
                    alive &= ALPHA * between[k] > d
            out.append(np.array(taken, np.int64))
    return out


def medoids(x: np.ndarray, k: int = STARTS) -> np.ndarray:
    """Places of the rows nearest to the middles of ``k`` parts of unit vectors: where searches start."""
    return np.unique((centres(x, k, 3, 5) @ x.T).argmax(1))


def range_search(x: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, starts: np.ndarray, slack: float = SLACK, beam: int = BEAM) -> np.ndarray:
    """Which rows of ``x`` are found with a cosine over ``slack``: a flag for each (query, row).

    ``neighbours`` is padded with -1.  All queries advance together: each step opens the best unopened row of every beam,
    until no beam has one; then the range grows over the graph from whatever lies inside.
    """
    n, q = len(x), len(queries)
    near_of = np.where(neighbours < 0, n, neighbours)  # n: nowhere
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    seen[:, starts] = True
    hits = np.zeros((q, n + 1), bool)
    first = queries @ x[starts].T
    hits[:, starts] = first >= slack
    order = np.argsort(-first, axis=1, kind="stable")[:, :beam]
    ids, sims = np.full((q, beam), n), np.full((q, beam), -9.0)
    ids[:, : order.shape[1]], sims[:, : order.shape[1]] = starts[order], np.take_along_axis(first, order, 1)
    opened = ids == n
    active = np.arange(q)
    while len(active):
        left = np.where(opened[active], -9.0, sims[active])
        best = left.argmax(1)
        go = left[np.arange(len(active)), best] > -9
        active, best = active[go], best[go]
        if not len(active):
            break
        opened[active, best] = True
        near = near_of[ids[active, best]]
        new = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        s = np.where(new, np.einsum("qrd,qd->qr", x[np.minimum(near, n - 1)], queries[active]), -9.0)
        row, col = np.nonzero(s >= slack)
        hits[active[row], near[row, col]] = True
        all_ids = np.concatenate([ids[active], np.where(new, near, n)], axis=1)
        all_sims = np.concatenate([sims[active], s], axis=1)
        all_opened = np.concatenate([opened[active], ~new], axis=1)
        kept = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active], sims[active], opened[active] = (np.take_along_axis(a, kept, 1) for a in (all_ids, all_sims, all_opened))
    asked, at = np.nonzero(hits[:, :n])
    tried = hits.copy()
    tried[:, n] = True
    while len(asked):
        fresh = []
        for begin in range(0, len(asked), 2000):
            near = near_of[at[begin : begin + 2000]]
            r, t = np.repeat(asked[begin : begin + 2000], near.shape[1]), near.ravel()
            new = ~tried[r, t]
            r, t = np.divmod(np.unique(r[new] * (n + 1) + t[new]), n + 1)
            tried[r, t] = True
            inside = np.einsum("pd,pd->p", x[t], queries[r]) >= slack
            hits[r[inside], t[inside]] = True
            fresh.append((r[inside], t[inside]))
        asked, at = (np.concatenate(c) for c in zip(*fresh, strict=True))
    return hits[:, :n]


def _reaches(x: np.ndarray, x_length: np.ndarray, a: np.ndarray, y: np.ndarray, y_length: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """For which places the cosine of x[a] and y[b] reaches the threshold in double precision."""
    out = np.empty(len(a), bool)
    for begin in range(0, len(a), 50_000):
        p, q = a[begin : begin + 50_000], b[begin : begin + 50_000]
        out[begin : begin + 50_000] = np.einsum("pd,pd->p", x[p], y[q]) / (x_length[p] * y_length[q]) >= cosine
    return out


class Found:
    """Links inside one task: how many each row has, and a spanning forest."""

    def __init__(self, copies: np.ndarray):
        self.copies = copies
        self.n, self.w = np.zeros(len(copies), np.int64), np.zeros(len(copies), np.int64)
        self.root = np.arange(len(copies))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links between rows a and b, each only once over all calls."""
        for x, y in ((a, b), (b, a)):
            self.n += np.bincount(x, minlength=len(self.n))
            self.w += np.bincount(x, self.copies[y], minlength=len(self.n)).astype(np.int64)
        while True:  # hook the higher root to the lower one, until both ends of every link have one root
            u, v = self.root[a], self.root[b]
            if (u == v).all():
                return
            np.minimum.at(self.root, np.maximum(u, v), np.minimum(u, v))
            while not np.array_equal(self.root, again := self.root[self.root]):
                self.root = again

    def batch(self, node: np.ndarray) -> pa.RecordBatch:
        """``node, null, n, w`` of the rows with links, and ``node, other, null, null`` for the forest."""
        at, low = np.flatnonzero(self.n), np.flatnonzero(self.root != np.arange(len(self.root)))
        none = pa.nulls(len(low), pa.int64())
        columns = (
            (pa.array(node[at]), pa.array(node[low])), (pa.nulls(len(at), pa.int64()), pa.array(node[self.root[low]])),
            (pa.array(self.n[at]), none), (pa.array(self.w[at]), none),
        )
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x.cast(pa.int64()) for x in c]) for c in columns], names=["node", "other", "n", "w"])


def _nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, vec_id, node, copies) and nodes (node, copies, asked, embedding array<double>)."""
    e = F.col("embedding").cast("array<double>")
    fine = F.exists(e, lambda v: v != 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), e).alias("embedding")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = F.coalesce(F.pmod("vec_id", F.lit(ASKED)) == 0, F.lit(False))
    nodes = rows.where("embedding is not null").groupBy("embedding").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.max(asked).alias("asked"))
    nodes = cut(nodes, "vector-nodes")
    keyed = rows.join(nodes.select("node", "copies", F.col("embedding").alias("_e")), rows.embedding == F.col("_e"), "left").select("row", "vec_id", "node", "copies")
    return keyed, nodes


def _for_centre(overlap: int) -> int:
    """Nodes for one centre: whatever the overlap, a shard has some SHARD * OVERLAP nodes, which as a rule is one block.

    Across two blocks the graph only has the edges that other shards have found, and searches there are dear and lose links.
    """
    return max(1, SHARD * OVERLAP // overlap)


def _sample(nodes: DataFrame, n: int, most: int, salt: int) -> DataFrame:
    share = min(1_000_000, int(1_000_000 * most / max(1, n)) + 1)
    return nodes.where(F.pmod(F.xxhash64(F.lit(salt), "node"), F.lit(1_000_000)) < share)


def _nearest(nodes: DataFrame, c: np.ndarray, overlap: int) -> DataFrame:
    """``node, copies, embedding, home``: the places of the nearest centres, in order of place."""
    shared = nodes.sparkSession.sparkContext.broadcast(c)  # MOST_SHARDS vectors at most

    def run(batches):
        for b in batches:
            if b.num_rows:
                sims = unit(matrix(b.column(2))) @ shared.value.T
                near = np.sort(np.argsort(-sims, axis=1, kind="stable")[:, :overlap], axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near.astype(np.int64)), pa.list_(pa.int64()))], names=["node", "copies", "embedding", "home"])

    return nodes.select("node", "copies", "embedding").mapInArrow(run, "node long, copies long, embedding array<double>, home array<bigint>")


def _second_level(cells: DataFrame, overlap: int) -> DataFrame:
    """Homes inside cells: each cell (a value of ``home``) gets centres of its own, fitted and used in tasks."""
    held = cut(cells.select(F.explode("home").alias("cell"), "node", "copies", "embedding"), "cells")
    each = _for_centre(overlap)
    sizes = cut(held.groupBy("cell").agg(F.ceil(F.count("*") / each).cast("int").alias("k"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "cell-sizes")  # a row for each cell
    draw = F.pmod(F.xxhash64(F.lit(4), "node"), F.lit(each)) < FOR_CENTRE

    def fit(t: pa.Table) -> pa.Table:
        c = centres(unit(matrix(t.column("embedding").combine_chunks())), t.column("k")[0].as_py())
        return pa.table({"cell": pa.array([t.column("cell")[0].as_py()], pa.int64()), "chunks": pa.array([t.column("chunks")[0].as_py()], pa.int32()), "c": pa.array([c.ravel().tolist()], pa.list_(pa.float64()))})

    fitted = held.where(draw).join(F.broadcast(sizes), "cell").select("cell", "k", "chunks", "embedding").groupBy("cell").applyInArrow(fit, "cell long, chunks int, c array<double>")
    own = fitted.select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("node"), F.col("c").alias("embedding"))
    rows = held.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), "node", "embedding")

    def place(t: pa.Table) -> pa.Table:
        node, vectors, cell = t.column("node").combine_chunks(), t.column("embedding").combine_chunks(), t.column("cell")[0].as_py()
        known = node.is_valid()
        x = unit(matrix(vectors.filter(known)))
        fitted_here = vectors.filter(node.is_null()).flatten().to_numpy(zero_copy_only=False)
        c = fitted_here.reshape(-1, x.shape[1]) if len(fitted_here) and len(x) else np.zeros((1, x.shape[1]))  # a cell without a sample is one shard
        near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap] if len(x) else np.zeros((0, 1), np.int64)
        return pa.table({"node": node.filter(known).take(pa.array(np.repeat(np.arange(len(x)), near.shape[1]))), "shard": pa.array((cell << _SUB | near).ravel().astype(np.int64))})

    homes = rows.union(own).groupBy("cell", "chunk").applyInArrow(place, "node long, shard long").groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("home"))
    return cells.drop("home").join(homes, "node")


def _homes(nodes: DataFrame, n: int, overlap: int, seed: int) -> DataFrame:
    """``node, copies, embedding, home``: the shards of each node, lowest first; a cut table."""
    sample = unit(matrix(_sample(nodes, n, SAMPLE, 1).select("embedding").toArrow().column(0).combine_chunks()))
    k = -(-n // _for_centre(overlap))
    if k <= MOST_SHARDS:
        return cut(_nearest(nodes, centres(sample, max(1, k), seed=seed), overlap), "homes")
    cells = cut(_nearest(nodes, centres(sample, max(2, min(MOST_SHARDS, int(k**0.5))), seed=seed), 2), "cells")
    return cut(_second_level(cells, max(1, overlap // 2)), "homes")


def find_links(nodes: DataFrame, n: int, overlap: int = OVERLAP, beam: int = BEAM, cosine: float = COSINE, seed: int = 7) -> DataFrame:
    """Numbers of verified links and spanning forests of nodes of one vector length, as ``Found.batch`` has them; a cut table."""
    if not n:
        return nodes.sparkSession.createDataFrame([], _FOUND)
    homes = _homes(nodes, n, overlap, seed)
    each = homes.select(F.explode("home").alias("shard"), "node", "copies", "embedding", "home")
    sizes = cut(each.groupBy("shard").agg(F.ceil(F.count("*") / CAP).cast("int").alias("blocks")), "shard-sizes")
    placed = cut(each.join(sizes, "shard").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "shards")

    def build(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        lists = robust_prune(unit(matrix(t.column("embedding").combine_chunks())))
        return pa.table({"node": pa.array(node, pa.int64()), "out": pa.array([node[k] for k in lists], pa.list_(pa.int64()))})

    graph = placed.select("shard", "i", "node", "embedding").groupBy("shard", "i").applyInArrow(build, "node long, out array<bigint>")
    graph = cut(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out")), "graph")
    both = placed.join(graph, "node").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.select("shard", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "node", "copies", "embedding", "home", "out")

    def search(t: pa.Table) -> pa.Table:
        shard, p, q = (t.column(c)[0].as_py() for c in ("shard", "p", "q"))
        node, block = t.column("node").to_numpy(), t.column("i").to_numpy()
        found = Found(t.column("copies").to_numpy())
        if (block == p).any() and (block == q).any():
            y = matrix(t.column("embedding").combine_chunks())
            x, length = unit(y), np.linalg.norm(y, axis=1)
            order = np.argsort(node)
            lists = t.column("out").combine_chunks()
            flat, width = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            at = np.minimum(np.searchsorted(node[order], flat), len(node) - 1)
            local = np.where(node[order][at] == flat, order[at], -1)  # united lists name nodes of other shards too
            neighbours = np.full((len(node), max(1, int(width.max()))), -1)
            neighbours[np.repeat(np.arange(len(node)), width), np.concatenate([np.arange(w) for w in width])] = local
            homes = t.column("home").combine_chunks()
            home = np.full((len(node), int(np.diff(homes.offsets.to_numpy()).max())), -1)
            home[np.repeat(np.arange(len(node)), sizes := np.diff(homes.offsets.to_numpy())), np.concatenate([np.arange(w) for w in sizes])] = homes.flatten().to_numpy()
            starts = medoids(x)
            hits = np.concatenate([range_search(x, neighbours, x[begin : begin + 512], starts, beam=beam) for begin in range(0, len(x), 512)])
            hits |= hits.T
            for begin in range(0, len(x), 64):  # at most 64 rows' pairs at once
                a, b = np.nonzero(hits[begin : begin + 64])
                a += begin
                a, b = a[own := (a < b) & ((p == q) | (block[a] != block[b]))], b[own]
                if home.shape[1] > 1:
                    low, high = home[a][:, :, None], home[b][:, None, :]
                    first = np.where((low == high) & (low >= 0), low, np.iinfo(np.int64).max).min((1, 2))
                    a, b = a[first == shard], b[first == shard]
                hit = _reaches(y, length, a, y, length, b, cosine)
                found.add(a[hit], b[hit])
        return pa.Table.from_batches([found.batch(node)])

    links = cut(both.groupBy("shard", "p", "q").applyInArrow(search, _FOUND), "vector-links")
    for t in (homes, sizes, placed, graph):
        drop(t)
    return links


def _strips(nodes: DataFrame, n: int):
    """Bounded sets of nodes, each as ids, copies and vectors that tasks get."""
    strips = max(1, -(-n // STRIP))
    for k in range(strips):
        strip = nodes.where(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(strips)) == k).select("node", "copies", "embedding").toArrow()
        if strip.num_rows:
            ids = strip.column(0).to_numpy()
            order = np.argsort(ids)
            yield nodes.sparkSession.sparkContext.broadcast((ids[order], strip.column(1).to_numpy()[order], matrix(strip.column(2).combine_chunks())[order]))


def _against(nodes: DataFrame, strip, cosine: float, above: bool) -> DataFrame:
    """Links between all nodes and those of a strip (``above``: only with a larger id), as ``Found.batch`` has them."""

    def run(batches):
        ids, copies, y = strip.value
        u, length = unit(y), np.linalg.norm(y, axis=1)
        for b in batches:
            if not b.num_rows:
                continue
            node, x = b.column(0).to_numpy(), matrix(b.column(2))
            own = np.linalg.norm(x, axis=1)
            found = Found(np.concatenate([copies, b.column(1).to_numpy()]))
            for begin in range(0, len(x), 64):
                part = x[begin : begin + 64]
                r, c = np.nonzero(unit(part) @ u.T >= cosine - 1e-9)
                r, c = r[keep := node[begin + r] < ids[c] if above else node[begin + r] != ids[c]], c[keep]
                hit = _reaches(y, length, c, x, own, begin + r, cosine)
                found.add(c[hit], len(ids) + begin + r[hit])
            if not above:
                found.n[len(ids) :] = 0  # only the strip is asked
            yield found.batch(np.concatenate([ids, node]))

    return nodes.select("node", "copies", "embedding").mapInArrow(run, _FOUND)


def recall(nodes: DataFrame, links: DataFrame, cosine: float = COSINE) -> float:
    """The least mean recall of a query over the bands of small to large groups, for the nodes that are asked.

    Queries are compared with all nodes, and those with links fall into bands by their number of true links (1 to 3, 4 to
    15, and so on), so that neither a large group nor its many queries can make up for links lost in small ones.
    """
    asked = nodes.where("asked")
    true = None
    for strip in _strips(asked, asked.count()):
        part = cut(_against(nodes, strip, cosine, False).where("n is not null").groupBy("node").agg(F.sum("n").alias("true")), "true-links")
        true = part if true is None else true.union(part)
    if true is None:
        return 1.0
    got = links.where("n is not null").groupBy("node").agg(F.sum("n").alias("got"))
    share = F.least(F.lit(1.0), F.coalesce("got", F.lit(0)) / F.col("true"))
    rows = true.join(got, "node", "left").groupBy(F.floor(F.log2("true") / 2).alias("band")).agg(F.count("*").alias("n"), F.avg(share).alias("mean")).collect()  # a row for each band
    thin = [r for r in rows if r["n"] < BAND]
    means = [r["mean"] for r in rows if r["n"] >= BAND]
    if thin:
        means.append(sum(r["n"] * r["mean"] for r in thin) / sum(r["n"] for r in thin))
    return min(means, default=1.0)


def exact_links(nodes: DataFrame, n: int, cosine: float = COSINE) -> DataFrame:
    """All links of nodes of one vector length: each strip of nodes against all nodes, without an exchange."""
    found = None
    for strip in _strips(nodes, n):
        part = cut(_against(nodes, strip, cosine, True), "exact-links")
        found = part if found is None else found.union(part)
    return found


def all_links(nodes: DataFrame, n: int, cosine: float = COSINE) -> tuple[DataFrame, float]:
    """Links of nodes of one vector length, searched until the audit is content or else compared exactly, and their recall."""
    for attempt in range(ATTEMPTS):
        found = find_links(nodes, n, OVERLAP << attempt, BEAM << attempt, cosine, 7 + attempt)
        least = recall(nodes, found, cosine)
        _LOG.info("recall %.4f with %d shards a node", least, OVERLAP << attempt)
        if least >= TARGET:
            return found, least
        drop(found)
    _LOG.warning("recall %.4f after %d searches: all %d nodes are compared exactly", least, ATTEMPTS, n)
    return exact_links(nodes, n, cosine), 1.0


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    rows, nodes = _nodes(vectors)
    found = None
    lengths = [r["d"] for r in nodes.select(F.size("embedding").alias("d")).distinct().collect()]
    for d in lengths:  # as a rule one
        same = nodes.where(F.size("embedding") == d)
        links, _ = all_links(same, same.count(), cosine)
        found = links if found is None else found.union(links)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], _FOUND)
    links = found.where("n is not null").groupBy("node").agg(F.sum("w").alias("links"))
    parts = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = rows.join(links, "node", "left").join(parts, "node", "left")
    placed = placed.select("row", "vec_id", F.when(F.col("node").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "node", F.col("row")).alias("part"))
    least = cut(placed.groupBy("part").agg(F.min("vec_id").alias("component_id")), "least")  # apart, so that a large component's rows may be split in the join
    out = placed.join(least, "part")
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
