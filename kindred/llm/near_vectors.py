"""Embedding near-dedup: a hierarchical navigable small-world graph for each shard.

Vectors of one label (and dimension) are dealt to shards of bounded size by a hash of the id. A shard's
graph has as nodes leaders only: a vector within half the link angle of a leader joins its bucket, so
that all vectors of a bucket link with each other and a mass of near copies is a few nodes. Every
shard's leaders search every shard of their label, with beams widened until they end outside the
range that can hold links, and until an audit against brute force on a sample of leaders passes.
Links between vectors of the buckets found are then decided by cosine in double precision."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, stored

SHARD_ROWS = 8192
#: Links of a node on the upper layers and (twice) on the lowest, and the narrowest beams: to build, from a
#: node itself, from the top.
LINKS, BEAM_BUILD, BEAM_OWN, BEAM_QUERY = 16, 64, 48, 48
BATCH = 256
#: Leaders that an audit samples at first and at most, the true pairs that it wants to see, and the recall.
AUDIT, AUDIT_MOST, AUDIT_PAIRS, LEAST_RECALL = 64, 1024, 200, 0.995


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else very small or large parts could vanish or overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Graph:
    """Layers of nodes with at most LINKS (lowest layer: twice that) neighbours; similarity is cosine."""

    def __init__(self, dim: int, room: int):
        self.x = np.zeros((room, dim), np.float32)
        self.n = 0
        self.layers: list[np.ndarray] = []  # neighbours of each node, -1: none
        self.sims: list[np.ndarray] = []  # and how near they are
        self.level = np.zeros(room, np.int8)
        self.entry = 0

    def beam(self, layer: int, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ef best nodes met (-1 padded) and their similarities, best first. All
        queries take a step together: expand the best node not expanded yet."""
        near = self.layers[layer]
        b = len(q)
        ids, sim, done = np.full((b, ef), -1, np.int32), np.full((b, ef), -np.inf, np.float32), np.zeros((b, ef), bool)
        seen = np.zeros((b, self.n), bool)
        rows = np.arange(b)
        ids[:, 0], sim[:, 0] = start, np.einsum("bd,bd->b", self.x[start], q)
        seen[rows, start] = True
        while len(rows):
            open_sim = np.where(done[rows], -np.inf, sim[rows])
            best = open_sim.argmax(axis=1)
            go = open_sim[np.arange(len(rows)), best] > -np.inf
            rows, best = rows[go], best[go]
            if not len(rows):
                break
            done[rows, best] = True
            nb = near[ids[rows, best]]
            ok = nb >= 0
            ok &= ~seen[rows[:, None], nb]
            r, c = np.nonzero(ok)
            seen[rows[r], nb[r, c]] = True
            new = np.full(nb.shape, -np.inf, np.float32)
            new[r, c] = np.einsum("kd,kd->k", self.x[nb[r, c]], q[rows[r]])
            all_sim = np.concatenate([sim[rows], new], axis=1)
            keep = np.argpartition(-all_sim, ef - 1, axis=1)[:, :ef]
            sim[rows] = np.take_along_axis(all_sim, keep, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(ok, nb, -1)], axis=1), keep, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros(nb.shape, bool)], axis=1), keep, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """For each query a node of layer `to`, reached greedily from the top."""
        at = np.full(len(q), self.entry, np.int32)
        for layer in range(len(self.layers) - 1, to, -1):
            at = self.beam(layer, q, at, 1)[0][:, 0]
        return at

    def _choose(self, sim: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, best first, those nearer to the node than to any chosen one; then the nearest."""
        x = self.x[ids]
        left, keep = np.ones(len(ids), bool), []
        while len(keep) < most and left.any():
            k = int(left.argmax())
            keep.append(k)
            left[k] = False
            left &= x @ x[k] < sim
        if len(keep) < most:
            rest = np.ones(len(ids), bool)
            rest[keep] = False
            keep += np.flatnonzero(rest)[: most - len(keep)].tolist()
        return np.array(keep)

    def _link(self, layer: int, node: int, others: np.ndarray, sim: np.ndarray) -> None:
        """Links both ways; a full neighbour lets its farthest go if the node is nearer."""
        near, near_sim = self.layers[layer], self.sims[layer]
        near[node, : len(others)], near_sim[node, : len(others)] = others, sim
        worst = near_sim[others].argmin(axis=1)  # -inf where a place is free
        ok = near_sim[others, worst] < sim
        near[others[ok], worst[ok]], near_sim[others[ok], worst[ok]] = node, sim[ok]

    def add(self, q: np.ndarray, levels: np.ndarray) -> None:
        """Add nodes; those of a call find each other by their full similarities."""
        first, self.n = self.n, self.n + len(q)
        new = np.arange(first, self.n)
        self.x[new], self.level[new] = q, levels
        each = q @ q.T
        top = len(self.layers)
        for layer in range(max(top, int(levels.max()) + 1)):
            mine = np.flatnonzero(levels >= layer)
            if not len(mine):
                continue
            found = None
            if layer < top and first:
                found = self.beam(layer, q[mine], self.descend(q[mine], layer), BEAM_BUILD)
            elif layer >= top:
                self.layers.append(np.full((len(self.x), LINKS * (1 + (layer == 0))), -1, np.int32))
                self.sims.append(np.full(self.layers[-1].shape, -np.inf, np.float32))
                self.entry = int(new[mine[0]])
            for k, i in enumerate(mine):
                ids, sim = (found[0][k], found[1][k]) if found else (np.empty(0, np.int32), np.empty(0, np.float32))
                before = mine[:k]
                ids, sim = np.concatenate([ids[ids >= 0], new[before]]), np.concatenate([sim[ids >= 0], each[i, before]])
                if len(ids):
                    order = np.argsort(-sim, kind="stable")[:BEAM_BUILD]
                    ids, sim = ids[order], sim[order]
                    keep = self._choose(sim, ids, LINKS)
                    self._link(layer, int(new[i]), ids[keep], sim[keep])


def build(unit: np.ndarray, leader_cos: float) -> tuple[Graph, np.ndarray, np.ndarray]:
    """The graph of leaders, each row's leader (a node), and each node's row."""
    n = len(unit)
    g = Graph(unit.shape[1], n)
    leader, rows = np.full(n, -1, np.int64), np.empty(n, np.int64)
    rng = np.random.default_rng(n)
    size, at = 1, 0
    while at < n:
        part = np.arange(at, min(n, at + size))
        q = unit[part].astype(np.float32)
        if g.n:
            ids, _ = g.beam(0, q, g.descend(q, 0), BEAM_BUILD)
            best = ids[:, 0]
            near = np.einsum("bd,bd->b", unit[rows[best]], unit[part]) >= leader_cos
            leader[part[near]] = best[near]
        open_ = part[leader[part] < 0]
        each = unit[open_] @ unit[open_].T >= leader_cos
        fresh: list[int] = []
        for k in range(len(open_)):
            met = np.flatnonzero(each[k, fresh]) if fresh else []
            if len(met):
                leader[open_[k]] = g.n + met[0]
            else:
                leader[open_[k]] = g.n + len(fresh)
                fresh.append(k)
        if fresh:
            rows[g.n : g.n + len(fresh)] = open_[fresh]
            g.add(unit[open_[fresh]].astype(np.float32), np.minimum(12, rng.geometric(1 - 1 / LINKS, len(fresh)) - 1).astype(np.int8))
        at, size = at + len(part), min(BATCH, size * 2)
    return g, leader, rows[: g.n].copy()


def in_range(g: Graph, q: np.ndarray, least: float, start: np.ndarray | None, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of similarity >= least as the beams find them. A beam that ends inside the
    range is doubled."""
    got: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(q), BATCH):
        todo, width = np.arange(i, min(i + BATCH, len(q))), min(ef, g.n)
        at = g.descend(q[todo], 0) if start is None else start[todo]
        while len(todo):
            ids, sim = g.beam(0, q[todo], at, width)
            full = (sim[:, -1] >= least) & (width < g.n)
            r, c = np.nonzero((sim >= least) & ~full[:, None])
            got.append((todo[r], ids[r, c]))
            todo, at, width = todo[full], at[full], min(width * 2, g.n)
    return np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])


def audited(g: Graph, q: np.ndarray, least: float, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """in_range(), its beams doubled until a sample of the queries has the pairs of brute force, pairs of a node
    with itself apart. The sample grows, to a bound, until it has pairs enough to tell."""
    ef = BEAM_QUERY if start is None else BEAM_OWN
    size = AUDIT
    while True:
        sample = np.unique(np.linspace(0, len(q) - 1, min(size, len(q))).astype(int))
        true = q[sample] @ g.x[: g.n].T >= least
        if start is not None:
            true[np.arange(len(sample)), start[sample]] = False  # a beam begins at its own node
        if true.sum() >= AUDIT_PAIRS or size >= min(AUDIT_MOST, len(q)):
            break
        size *= 4
    while True:
        a, b = in_range(g, q, least, start, ef)
        met = np.zeros(true.shape, bool)
        here = np.isin(a, sample)
        met[np.searchsorted(sample, a[here]), b[here]] = True
        if ef >= g.n or (met & true).sum() >= LEAST_RECALL * true.sum():
            return a, b
        ef *= 2


def _members(leader: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by leader, and the offsets of each leader's."""
    return np.argsort(leader, kind="stable"), np.searchsorted(np.sort(leader), np.arange(n + 1))


class Shard:
    def __init__(self, raw: bytes):
        self.ids, x, self.leader, self.rows, g = pickle.loads(raw)
        self.unit = unit_rows(x)
        self.graph = Graph(self.unit.shape[1], 0)
        self.graph.__dict__ |= g
        self.graph.x = self.unit[self.rows].astype(np.float32)
        self.order, self.at = _members(self.leader, len(self.rows))
        self.size = np.diff(self.at)

    @staticmethod
    def to_bytes(ids: np.ndarray, x: np.ndarray, leader_cos: float) -> bytes:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        g, leader, rows = build(unit_rows(x), leader_cos)
        g.layers = [layer[: g.n].copy() for layer in g.layers]
        return pickle.dumps((ids, x, leader.astype(np.int32), rows.astype(np.int32), {"n": g.n, "layers": g.layers, "entry": g.entry}), protocol=5)


def links(a: Shard, b: Shard, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two shards (or one with itself): ids, links counted here and the smallest id joined here."""
    half = np.arccos(threshold) / 2
    reach = np.float32(np.cos(min(np.pi, 4 * half)) - 1e-5)  # two buckets' radii and the link's angle
    i, j = audited(b.graph, a.graph.x, reach, np.arange(a.graph.n, dtype=np.int32) if same else None)
    if same:
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j = np.unique(np.stack([i, j])[:, i != j], axis=1)
    na, nb = len(a.ids), len(b.ids)
    count = np.zeros(na + (0 if same else nb), np.int64)
    shift = 0 if same else na
    node_shift = 0 if same else a.graph.n
    root = np.arange(a.graph.n + (0 if same else b.graph.n))
    joined: list[tuple[np.ndarray, np.ndarray]] = []
    work = a.size[i] * b.size[j]
    small = np.flatnonzero(work <= 4096)
    for k in np.flatnonzero(work > 4096):
        ra, rb = a.order[a.at[i[k]] : a.at[i[k] + 1]], b.order[b.at[j[k]] : b.at[j[k] + 1]]
        any_hit = False
        for c in range(0, len(ra), 1024):
            hit = a.unit[ra[c : c + 1024]] @ b.unit[rb].T >= threshold
            np.add.at(count, ra[c : c + 1024], hit.sum(axis=1))
            np.add.at(count, rb + shift, hit.sum(axis=0))
            any_hit |= bool(hit.any())
        if any_hit:
            joined.append((i[k : k + 1], j[k : k + 1]))
    ends = np.cumsum(work[small])
    at = 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 200_000, "right")))
        k = small[at:to]
        pair = np.repeat(k, work[k])
        off = np.arange(len(pair)) - np.repeat(np.cumsum(work[k]) - work[k], work[k])
        ra = a.order[a.at[i[pair]] + off // b.size[j[pair]]]
        rb = b.order[b.at[j[pair]] + off % b.size[j[pair]]]
        hit = np.einsum("kd,kd->k", a.unit[ra], b.unit[rb]) >= threshold
        np.add.at(count, ra[hit], 1)
        np.add.at(count, rb[hit] + shift, 1)
        met = np.unique(pair[hit])
        joined.append((i[met], j[met]))
        at = to
    if same:
        count += a.size[a.leader] - 1  # a bucket's vectors all link with each other
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    leader = a.leader if same else np.concatenate([a.leader, b.leader.astype(np.int64) + node_shift])
    low = np.full(len(root), np.iinfo(np.int64).max)
    np.minimum.at(low, leader, ids)
    if joined:
        u, v = np.concatenate([x for x, _ in joined]), np.concatenate([y for _, y in joined]) + node_shift
        while True:  # each node takes its neighbours' smallest id until nothing changes
            was = low.copy()
            np.minimum.at(low, u, was[v])
            np.minimum.at(low, v, low[u])
            if (low == was).all():
                break
    some = count > 0
    return ids[some], count[some], low[leader[some]]


def near_vectors(df: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold a null or non-finite part, and rows with a null id or label,
    link with nothing. Vectors of different dimensions never link. Equal rows each count as a vector;
    rows of one id share their counts and their component. An empty table gives an empty result."""
    spark = df.sparkSession
    v = F.col(embedding)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    good = good.withColumn("dim", F.size("v"))
    counts = stored(good.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "labels")
    few = counts.count() <= 100_000
    keyed = good.join(counts.hint("broadcast" if few else "merge"), ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    leader_cos = float(np.cos(np.arccos(threshold) / 2) + 1e-9)
    label_type = df.schema[label].dataType.simpleString()

    def graph(table: pa.Table) -> pa.Table:
        x = np.array(table.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(table.num_rows, -1)
        x = x.astype(np.float32) if (x == x.astype(np.float32)).all() else x
        raw = Shard.to_bytes(table.column("vec_id").to_numpy(), x, leader_cos)
        return pa.table({"label": table.column("label")[:1], "dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "graph": pa.array([raw], pa.binary())})

    shards = stored(keyed.select("label", "dim", "shard", "vec_id", "v").groupBy("label", "dim", "shard").applyInArrow(graph, f"label {label_type}, dim int, shard int, graph binary"), "graphs")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                mine, other, same = (batch.column(k)[row].as_py() for k in range(3))
                a = Shard(mine)
                ids, count, low = links(a, a if same else Shard(other), same, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(count, pa.int64()), pa.array(low, pa.int64())], names=["vec_id", "n", "low"])

    # every shard meets every shard of its label, one task a pair
    left = shards.select("label", "dim", F.col("shard").alias("s"), F.col("graph").alias("mine"))
    right = shards.select("label", "dim", F.col("shard").alias("t"), F.col("graph").alias("other"))
    keys = left.drop("mine").join(right.drop("other").hint("shuffle_hash"), ["label", "dim"]).where("s <= t")
    keys = keys.join(left.hint("shuffle_hash"), ["label", "dim", "s"])
    pairs = keys.join(right.hint("shuffle_hash"), ["label", "dim", "t"]).select("mine", F.when(F.col("s") != F.col("t"), F.col("other")).alias("other"), (F.col("s") == F.col("t")).alias("same"), "label", "dim", "s", "t")
    pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "dim", "s", "t")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a batch holds a pair of shards
    found = stored(pairs.select("mine", "other", "same").mapInArrow(search, "vec_id long, n long, low long"), "links")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    parts = connected_components(found.select(F.col("vec_id").alias("a"), F.col("low").alias("b")), "vectors")
    n = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    out = rows.select("vec_id").join(n.hint("merge"), "vec_id", "left").join(parts.withColumnRenamed("id", "vec_id").hint("merge"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
