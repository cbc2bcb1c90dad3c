"""Near-duplicate vectors by a robust-pruned flat graph built on overlapping cluster shards.

1. Equal vectors become one node with a count. Nodes are clustered level by level (k-means on a bounded sample of each
   shard) until a shard holds about REGION nodes; a node belongs to its nearest cluster and, as an overlap, to its second.
   Shards that no centers divide, such as one dense group, are cut by a hash.
2. Each shard builds its part of the graph: a node's nearest nodes in the shard, pruned robustly (a candidate goes if it
   is much nearer to a chosen neighbour than to the node), some far nodes, and the edges' reverses. The adjacency
   lists that a node has from its shards are united.
3. Every node is searched for in the shards of its nearest `probes` clusters, but never in those whose boundary is
   farther than a link can reach. A beam search starts at the shard's medoid and at the node itself where it lies in
   the shard, then widens through all neighbours within the range.
4. Each pair found is verified in double precision. A shard counts links to the nodes that it owns, so no pair is counted
   twice, and sends one row a node with the least node it is linked to: pairs are never rows.
5. A sample of AUDIT nodes is compared with all rows by brute force. If fewer than RECALL of its links were found, the
   search is repeated with twice the probes and a wider beam.

Defined cases: vectors that are null, zero or hold null, NaN or infinite components have no links and stand for
themselves; so do rows without an id, whose component is null and which are not kept; shorter vectors count as padded
with zeros; rows that repeat an id are linked as rows, and a component's id is the least id of its rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import k_means, padded, squared_distances
from .common import arrow_type, checkpointed, looked_up, out
from .links import components

LEAST = 0.95
REGION, CLUSTERS, SAMPLE, LEVELS = 2048, 256, 4096, 4
#: Rows of a shard that one task assigns, and searches that one task makes.
PIECE, SEARCHES = 16_384, 8192
NEAREST, PRUNED, FAR, REVERSE, ALPHA = 48, 16, 4, 8, 1.2
BEAM, PROBES = 12, 2
AUDIT, RECALL, TRIES = 1024, 0.97, 4
#: A search widens through neighbours whose cosine is this much below the least one.
MARGIN = 0.03
#: What a row of a shard is there for.
OWN, NODE, QUERY = 1, 2, 4
#: Ends the name of a shard that is not divided further by centers.
CLOSED = "!"
VECTOR = pa.list_(pa.float64())


def unit(rows: list, dim: int) -> np.ndarray:
    """Rows of length 1, scaled first so that no square overflows."""
    x = padded(rows, dim)
    x /= np.maximum(np.abs(x).max(axis=1, initial=0), 5e-324)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, key (a digest of a vector that can have links, else null) and v."""
    schema = arrow_type("vec_id long, key binary").append(pa.field("v", VECTOR))

    def task(batches):
        for b in batches:
            keys, rows = [], []
            for v in b.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v or ()], float) + 0.0  # no -0.0
                x = np.trim_zeros(x, "b")
                fine = len(x) > 0 and np.isfinite(x).all()
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if fine else None)
                rows.append(x if fine else None)
            yield out(schema, b.column(0), keys, rows)

    return vectors.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double"))).mapInArrow(task, "vec_id long, key binary, v array<double>")


def renewed(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that it can meet another table made of the same one."""
    return df.toDF(*df.columns)


# Clustering


def divided(left: pa.Table, centers: np.ndarray, probes: int, dim: int, reach: float):
    """(shard number below this one, node, role) of each row: own, overlap and searched-for places."""
    x, role = unit(left.column("v").to_pylist(), dim), left.column("role").to_numpy()
    d = squared_distances(x, centers)
    order = np.argsort(d, axis=1, kind="stable")[:, : max(2, probes)]
    first, row = order[:, 0], np.arange(len(x))
    apart = np.sqrt(np.maximum(squared_distances(centers, centers), 1e-300))
    for rank in range(order.shape[1]):
        to = order[:, rank]
        # How far x is from the boundary between its nearest center and this one.
        near = (d[row, to] - d[row, first]) / (2 * apart[first, to]) <= reach if rank else np.ones(len(x), bool)
        gets = np.where((rank < probes) & near, role & QUERY, 0)
        gets |= role & (OWN | NODE) if rank == 0 else np.where(role & OWN, NODE, 0) if rank == 1 else 0
        some = np.flatnonzero(gets)
        yield to[some], some, gets[some]


def apart_by(centers: np.ndarray, least: float) -> np.ndarray:
    """Centers without those that are too near an earlier one."""
    kept: list[int] = []
    d = squared_distances(centers, centers)
    for i in range(len(centers)):
        if all(d[i, j] > least**2 for j in kept):
            kept.append(i)
    return centers[kept]


def shards(nodes: DataFrame, dim: int, probes: int, region: int) -> DataFrame:
    """shard, node, n, v, role: rows of nodes in every shard where they are owned, an overlap or searched for."""
    reach = float(np.sqrt(2 - 2 * LEAST)) + 1e-6
    fit_schema = arrow_type("shard string, n long").append(pa.field("c", VECTOR))
    schema = arrow_type("shard string, node long, n long").append(pa.field("v", VECTOR)).append(pa.field("role", pa.int32()))

    def fit(key, group):
        n, x = group.column("size")[0].as_py(), unit(group.column("v").to_pylist(), dim)
        # Centers would cut a dense group, in which most rows link with most others: it stays whole.
        dense = ((x - x.mean(0)) ** 2).sum(1).mean() <= 1 - LEAST + 0.05
        c = apart_by(k_means(x, 1 if dense else min(CLUSTERS, -(-n // region))), reach)
        return pa.Table.from_batches([out(fit_schema, [key[0].as_py()], [n], [c.ravel()])])

    def assign(key, left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        c = np.array(right.column("c")[0].as_py()).reshape(-1, dim)
        made = []
        for to, at, role in divided(left, c, probes, dim, reach):
            some = left.take(pa.array(at))
            mark = "" if len(c) > 1 else CLOSED
            made.append(out(schema, [f"{key[0].as_py()}.{t}{mark}" for t in to.tolist()], *(some.column(n).combine_chunks() for n in ("node", "n", "v")), role.astype(np.int32)))
        return pa.Table.from_batches(made, schema)

    text = ", ".join(["shard string", "node long", "n long", "v array<double>", "role int"])
    rows, done = nodes.select("shard", "node", "n", "v", F.lit(OWN | NODE | QUERY).alias("role")), []
    for level in range(LEVELS):
        size = checkpointed(rows.where(F.col("role").bitwiseAND(OWN) > 0).groupBy("shard").agg(F.count("*").alias("size")).where((F.col("size") > region) & ~F.endswith("shard", F.lit(CLOSED))))
        if size.isEmpty():
            break
        large = rows.join(size, "shard")
        done.append(rows.join(size, "shard", "left_anti"))
        sample = large.where((F.col("role").bitwiseAND(OWN) > 0) & (F.pmod(F.xxhash64("node", F.lit(level)), F.ceil(F.col("size") / SAMPLE)) == 0))
        centers = checkpointed(sample.groupBy("shard").applyInArrow(fit, "shard string, n long, c array<double>"))
        pieces = F.ceil(F.col("size") * (1 + probes) / PIECE)
        left = large.withColumn("piece", F.pmod(F.xxhash64("node"), pieces)).drop("size")
        right = centers.join(size, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), pieces.cast("long") - 1)).alias("piece"), "c")
        rows = checkpointed(renewed(left).groupBy("shard", "piece").cogroup(right.groupBy("shard", "piece")).applyInArrow(assign, text))
    for d in done:
        rows = rows.unionAll(d)
    # A shard that stays large is cut by a hash: nodes go to one part, searches to all.
    size = rows.where(F.col("role").bitwiseAND(NODE) > 0).groupBy("shard").agg(F.ceil(F.count("*") / (3 * region)).alias("parts"))
    rows = rows.join(size, "shard")  # a shard without nodes has nothing to find
    mine = F.pmod(F.xxhash64("node"), F.col("parts"))
    spread = rows.withColumn("part", F.explode(F.when(F.col("role").bitwiseAND(QUERY) > 0, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(mine))))
    role = F.when(F.col("part") == mine, F.col("role")).otherwise(F.col("role").bitwiseAND(QUERY))
    return checkpointed(spread.select(F.concat_ws("/", "shard", F.col("part").cast("string")).alias("shard"), "node", "n", "v", role.alias("role")))


# The graph


def pruned(x: np.ndarray, rows: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Robust pruning of each row's candidates (nearest first): up to PRUNED columns of x's rows, or -1."""
    cand = x[near]
    to_row = 2 - 2 * np.einsum("bld,bd->bl", cand, x[rows])
    among = 2 - 2 * cand @ cand.transpose(0, 2, 1)
    alive, chosen, b = np.ones(near.shape, bool), np.full((len(rows), PRUNED), -1), np.arange(len(rows))
    for i in range(min(PRUNED, near.shape[1])):
        some = alive.any(1)
        pick = alive.argmax(1)
        chosen[some, i] = near[b, pick][some]
        alive &= ALPHA**2 * among[b, pick] > to_row
        alive[b, pick] = False
    return chosen


def adjacency(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Neighbours of each row of x in the graph of a shard."""
    m = len(x)
    if m < 2:
        return [np.empty(0, np.int64)] * m
    x, k = x.astype(np.float32), min(NEAREST, m - 1)
    chosen = np.full((m, PRUNED), -1)
    for at in range(0, m, 256):
        rows = np.arange(at, min(m, at + 256))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        chosen[rows] = pruned(x, rows, near)
    to = np.concatenate([chosen, np.random.default_rng(seed).integers(0, m, (m, FAR))], 1)
    source = np.repeat(np.arange(m), PRUNED)
    target, rank = chosen.ravel(), np.tile(np.arange(PRUNED), m)
    good = target >= 0
    source, target, rank = source[good], target[good], rank[good]
    order = np.lexsort((rank, target))
    source, target = source[order], target[order]
    start = np.searchsorted(target, np.arange(m + 1))
    return [np.setdiff1d(np.concatenate([to[i], source[start[i] : start[i + 1]][:REVERSE]]), [-1, i]) for i in range(m)]


def built(members: DataFrame, dim: int) -> DataFrame:
    """node and its neighbours over all shards."""
    schema = arrow_type("node long").append(pa.field("nbrs", pa.list_(pa.int64())))

    def build(key, group):
        ids = group.column("node").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        near = adjacency(unit(group.column("v").to_pylist(), dim)[order], len(ids))
        return pa.Table.from_batches([out(schema, ids, [ids[x] for x in near])])

    lists = members.where(F.col("role").bitwiseAND(NODE) > 0).select("shard", "node", "v").groupBy("shard").applyInArrow(build, "node long, nbrs array<long>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))  # a list from each of a node's few shards


# The search


class Shard:
    """A shard's nodes with their vectors and the united graph between them."""

    def __init__(self, rows: pa.Table, dim: int):
        ids = rows.column("node").to_numpy()
        order = np.argsort(ids)
        self.ids, self.x = ids[order], unit(rows.column("v").to_pylist(), dim)[order]
        self.small, self.count = self.x.astype(np.float32), rows.column("n").to_numpy()[order]
        self.own = (rows.column("role").to_numpy()[order] & OWN) > 0
        lists = rows.column("nbrs").combine_chunks().take(pa.array(order))
        flat, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        row, place = np.repeat(np.arange(len(ids)), n), np.minimum(np.searchsorted(self.ids, flat), len(ids) - 1)
        here = self.ids[place] == flat  # edges to nodes of other shards are followed there
        row, place = row[here], place[here]
        n = np.bincount(row, minlength=len(ids))
        self.edges = np.repeat(np.arange(len(ids))[:, None], max(1, n.max(initial=1)), 1)
        self.edges[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = place
        self.medoid = int((self.x @ self.x.mean(0)).argmax())

    def place(self, nodes: np.ndarray) -> np.ndarray:
        """Places of nodes, or -1."""
        at = np.minimum(np.searchsorted(self.ids, nodes), len(self.ids) - 1)
        return np.where(self.ids[at] == nodes, at, -1)

    def beams(self, q: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of each query's best nodes: a greedy search for all at once."""
        b, small = np.arange(len(q)), q.astype(np.float32)
        seen = np.zeros((len(q), len(self.ids)), bool)
        start = np.stack([np.full(len(q), self.medoid), np.where(at < 0, self.medoid, at)], 1)
        beam, score = start, np.einsum("qkd,qd->qk", self.small[start], small)
        score[start[:, 0] == start[:, 1], 1] = -np.inf
        opened = score == -np.inf
        seen[b[:, None], start] = True
        while True:
            open_score = np.where(opened, -np.inf, score)
            pick = open_score.argmax(1)
            live = np.flatnonzero(open_score[b, pick] > -np.inf)
            if not len(live):
                return beam, score
            opened[live, pick[live]] = True
            near = self.edges[beam[live, pick[live]]]
            new = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            found = np.where(new, np.einsum("qkd,qd->qk", self.small[near], small[live]), -np.inf).astype(np.float32)
            some = [np.concatenate([x[live], y], 1) for x, y in ((beam, near), (score, found), (opened, ~new))]
            if some[0].shape[1] > width:
                keep = np.argpartition(-some[1], width - 1, axis=1)[:, :width]
                some = [np.take_along_axis(x, keep, 1) for x in some]
            if some[0].shape[1] > beam.shape[1]:
                grow = ((0, 0), (0, some[0].shape[1] - beam.shape[1]))
                beam, score, opened = np.pad(beam, grow), np.pad(score, grow, constant_values=-np.inf), np.pad(opened, grow, constant_values=True)
            beam[live], score[live], opened[live] = some

    def within(self, q: np.ndarray, beam: np.ndarray, score: np.ndarray, itself: int) -> np.ndarray:
        """Places of the nodes within the range of one query, other than itself: its beam, widened through the graph."""
        low, small = LEAST - MARGIN, q.astype(np.float32)
        found = front = np.unique(beam[score >= low])
        if len(found) == (itself in found):
            return np.empty(0, np.int64)
        seen = np.zeros(len(self.ids), bool)  # anew: the beam has dropped nodes that it saw
        seen[found] = True
        while len(front):
            new = np.zeros(len(self.ids), bool)
            new[self.edges[front]] = True
            new &= ~seen
            seen |= new
            new = np.flatnonzero(new)
            front = new[self.small[new] @ small >= low]
            found = np.concatenate([found, front])
        found = found[(found != itself) & self.own[found]]
        return found[self.x[found] @ q >= LEAST]


def searched(members: DataFrame, graph: DataFrame, dim: int, width: int) -> DataFrame:
    """node, n (rows that it is linked with in a shard) and root (a node that it reaches), one row a node and search."""
    schema = arrow_type("node long, n long, root long")
    is_query, is_node = (F.col("role").bitwiseAND(bit) > 0 for bit in (QUERY, NODE))
    parts = members.where(is_query).groupBy("shard").agg(F.ceil(F.count("*") / SEARCHES).alias("parts"))
    asked = members.where(is_query).join(parts, "shard").select("shard", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node", "v")
    there = members.where(is_node).join(graph, "node").join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "node", "n", "v", "role", "nbrs")

    def search(key, left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        s = Shard(right, dim)
        nodes, x = left.column("node").to_numpy(), unit(left.column("v").to_pylist(), dim)
        at = s.place(nodes)
        label = np.arange(len(s.ids) + len(nodes))  # of the shard's nodes, then of the queries
        linked, count = np.zeros(len(label), bool), np.zeros(len(nodes), np.int64)
        for low in range(0, len(nodes), 256):
            rows = slice(low, low + 256)
            for i, *found in zip(range(low, len(nodes)), x[rows], *s.beams(x[rows], at[rows], width)):
                near = s.within(*found, at[i])
                if len(near):
                    count[i] = s.count[near].sum()
                    me = at[i] if at[i] >= 0 else len(s.ids) + i
                    group = np.append(near, me)
                    linked[group] = True
                    labels = np.unique(label[group])
                    if len(labels) > 1:
                        label[np.isin(label, labels)] = labels[0]
        name = np.concatenate([s.ids, nodes])
        some = np.flatnonzero(linked)
        asked = np.flatnonzero(count)
        return pa.Table.from_batches([out(schema, np.concatenate([name[some], nodes[asked]]), np.concatenate([np.zeros(len(some), np.int64), count[asked]]), np.concatenate([name[label[some]], nodes[asked]]))])

    return renewed(asked).groupBy("shard", "part").cogroup(there.groupBy("shard", "part")).applyInArrow(search, "node long, n long, root long")


def recall(nodes: DataFrame, links: DataFrame, dim: int) -> float:
    """Share of the links of a sample of nodes, found by comparing it with all nodes, that links (node, n) holds; 1 if it has none."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(AUDIT).select("node", "v").toArrow()  # bounded
    if not sample.num_rows:
        return 1.0
    names = sample.column("node").to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast((names, unit(sample.column("v").to_pylist(), dim)))
    schema = arrow_type("node long, real long")

    def task(batches):
        names, q = shared.value
        total = np.zeros(len(names))
        for b in batches:
            for low in range(0, b.num_rows, 4096):
                part = b.slice(low, 4096)
                x = unit(part.column(2).to_pylist(), dim)
                other = part.column(0).to_numpy()[None, :] != names[:, None]
                total += ((q @ x.T >= LEAST) & other).astype(float) @ part.column(1).to_numpy()
        yield out(schema, names, total.astype(np.int64))

    true = nodes.select("node", "n", "v").mapInArrow(task, "node long, real long").groupBy("node").agg(F.sum("real").alias("real"))
    held, wanted = true.join(links, "node", "left").agg(F.sum(F.least("real", F.coalesce("n", F.lit(0)))), F.sum("real")).first()
    return held / wanted if wanted else 1.0


def linked(vectors: DataFrame, probes: int = PROBES, beam: int = BEAM, region: int = REGION, target: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = checkpointed(keyed(vectors))
    classes = rows.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("v").alias("v"))
    nodes = checkpointed(classes.withColumns({"node": F.monotonically_increasing_id(), "shard": F.lit("0")}))
    dim = nodes.agg(F.max(F.size("v"))).first()[0] or 1
    for _ in range(TRIES):
        members = shards(nodes.select("shard", "node", "n", "v"), dim, probes, region)
        found = checkpointed(searched(members, built(members, dim), dim, beam))
        links = checkpointed(found.groupBy("node").agg(F.sum("n").alias("n")))
        if recall(nodes, links, dim) >= target:
            break
        probes, beam = 2 * probes, 2 * beam
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = nodes.select("key", "node", "first", F.col("n").alias("copies")).join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = checkpointed(whole)
    least = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    named = looked_up(whole, "root", least).select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    able = rows.where("key is not null and vec_id is not null").select("vec_id", "key")
    alone = rows.where("key is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = looked_up(able, "key", named).select("vec_id", "n_links", "component_id").unionAll(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
