"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its word shingles, told by COORDS minwise values. In each of TREES independent
trees a node chooses a few coordinates and sends a document to one child for each, named by its value
there; similar documents keep meeting. The first ROOTS levels need no counts and are walked where the
document is. Then nodes of one document end, small ones are compared exhaustively by their values,
large ones branch again; what is large after LEVELS such levels is compared whole, block against block.
Of the pairs that look similar enough a node returns a spanning forest, so as many rows as it has
documents at most. The forests' components are clusters: two documents that met and look similar are in
one cluster, whatever trees they met in. In each cluster the full sets are compared, again block against
block, and a spanning forest of the true links is returned; pairs already joined are not compared.
Documents of equal sets are one in all this."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._common import connected_components, drop_stored, release, small_batches, stored

COORDS, TREES, ROOTS, LEVELS, SMALL = 128, 12, 3, 2, 128
#: Documents, and hashes of full sets, in a block.
BLOCK, BLOCK_HASHES = 512, 1 << 19
#: How far below the threshold a share of equal values may be, in standard deviations.
SLACK = 3.5
#: Pairs looked at together.
PAIRS = 30_000
BROADCAST_ROWS = 1_000_000
_U = np.uint64
_MUL = W.mix(np.arange(1, COORDS + 1, dtype=_U)) | _U(1)
_ADD = W.mix(np.arange(1001, COORDS + 1001, dtype=_U))


def minwise(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of the sets sets[at[i]:at[i+1]] (none empty) its COORDS minwise values, cut to 16 bits."""
    out = np.empty((len(at) - 1, COORDS), np.uint16)
    for k in range(COORDS):
        low = np.minimum.reduceat(sets * _MUL[k] + _ADD[k], at[:-1])
        out[:, k] = W.mix(low) >> _U(48)
    return out


def children(node: np.ndarray, values: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of node and values) and nodes of all children: a node's hash chooses 1 / threshold coordinates
    on average, one at least."""
    share = int((1 / threshold - 1) * 1024)
    h, rows = W.mix(node), np.arange(len(node))
    out = []
    for turn, mine in ((0, rows), (1, rows[(h >> _U(20)) % _U(1024) < share])):
        c = (h[mine] >> _U(32 + 8 * turn)).astype(np.int64) % COORDS
        out.append((mine, W.mix(h[mine] * _U(31) + (values[mine, c].astype(_U) << _U(8)) + c.astype(_U))))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def first_nodes(values: np.ndarray, threshold: float, trees: int, roots: int) -> list[np.ndarray]:
    """The nodes of each document after the first levels of all trees."""
    row = np.tile(np.arange(len(values)), trees)
    node = np.repeat(W.mix(np.arange(1, trees + 1, dtype=_U)), len(values))
    for _ in range(roots):
        took, node = children(node, values[row], threshold)
        row = row[took]
    order = np.argsort(row, kind="stable")
    return np.split(node[order].view(np.int64), np.searchsorted(row[order], np.arange(1, len(values))))


def document_sets(raw: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document and their offsets."""
    h, _, _, doc = W.words(raw, at)
    s, so = W.shingles(h, doc, shingle)
    if not len(s):
        return s, so
    row = np.repeat(np.arange(len(so) - 1), np.diff(so))
    order = np.lexsort((s, row)) if len(so) < 4 else np.concatenate([so[i] + np.argsort(s[so[i] : so[i + 1]]) for i in range(len(so) - 1)])
    s = s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(so) - 1))])


def sketches(docs: DataFrame, shingle: int, threshold: float, trees: int) -> DataFrame:
    """doc_id, n, digest (of the set), nodes (after the first levels), values (binary) of docs(doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = W.text_bytes(batch.column(1))
            ids = batch.column(0)
            for i, j in W.slices(at):
                s, so = document_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], shingle)
                n = np.diff(so)
                full = np.flatnonzero(n)
                values = minwise(s, np.append(so[full], so[-1])) if len(full) else np.empty((0, COORDS), np.uint16)
                nodes = first_nodes(values, threshold, trees, ROOTS) if len(full) else []
                put = np.full(len(n), -1)
                put[full] = np.arange(len(full))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, j - i), pa.array(n, pa.int64()),
                    pa.array([xxhash.xxh3_128_hexdigest(s[so[k] : so[k + 1]].tobytes()) if n[k] else None for k in range(len(n))], pa.string()),
                    pa.array([nodes[p] if p >= 0 else [] for p in put.tolist()], pa.list_(pa.int64())),
                    pa.array([values[p].tobytes() if p >= 0 else None for p in put.tolist()], pa.binary()),
                ], names=["doc_id", "n", "digest", "nodes", "values"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, digest string, nodes array<long>, values binary")


def branch(rows: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, node, values) -> (doc_id, node) of the children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, node = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(_U)
                took, child = children(node, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, COORDS), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids[took]), pa.array(child.view(np.int64))], names=["doc_id", "node"])

    return rows.select("doc_id", "node", "values").mapInArrow(run, "doc_id long, node long").distinct()


def least_equal(threshold: float) -> float:
    """Equal values from which a pair may have the similarity `threshold`."""
    return COORDS * (threshold - SLACK * (threshold * (1 - threshold) / COORDS) ** 0.5)


def final_nodes(sets: DataFrame, threshold: float, levels: int, small: int, block: int) -> DataFrame:
    """(node, doc_id, blocks) of all nodes to compare; blocks: how many blocks the node is dealt to; stored."""
    rows = sets.select("doc_id", F.explode("nodes").alias("node")).distinct()
    parts: list[DataFrame] = []
    for level in range(levels):
        rows = stored(rows, f"level{level}")
        # written, so that the join has plain inputs, which adaptive execution can split where a node is hot
        count = stored(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), f"count{level}")
        met = stored(rows.join(count.hint("merge"), "node"), f"met{level}")
        drop_stored(rows)
        parts.append(met.where(F.col("n") <= small).select("node", "doc_id", F.lit(1).alias("blocks")))
        big = met.where(F.col("n") > small)
        if level + 1 < levels:
            rows = branch(big.join(sets.select("doc_id", "values").hint("merge"), "doc_id"), threshold)
        else:
            parts.append(big.select("node", "doc_id", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stored(out.distinct(), "nodes")


def _per_pair_of_blocks(rows: DataFrame, key: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(a, b) that work returns for rows(key, doc_id, blocks, ...). A key's documents are dealt to its blocks by
    hash, and each block meets itself and each other one: work gets the rows of some whole pairs of blocks, with
    `key`, x, y (x <= y), block, doc_id, ... and sorted so."""
    spark, rest = rows.sparkSession, [c for c in rows.columns if c not in (key, "doc_id", "blocks")]
    own = rows.withColumn("block", F.pmod(F.xxhash64(key, "doc_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = own.select(F.col(key).alias("key"), "block", "doc_id", *rest, other.alias("o")).select("key", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "doc_id", *rest)
    dealt = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "x", "y").sortWithinPartitions("key", "x", "y", "block", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            t = pa.Table.from_batches(held).combine_chunks()
            k = np.stack([t.column(c).to_numpy() for c in range(3)])
            new = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            to = t.num_rows if last else (int(new[-1]) if len(new) else 0)
            if to:
                yield from work(t.slice(0, to))
            held = t.slice(to).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > 8000 or sum(b.nbytes for b in held) > 1 << 24:
                yield from flush(False)
        if held:
            yield from flush(True)
        release()

    return dealt.mapInArrow(run, "a long, b long")


def _groups(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows where the pairs of blocks of t begin, and where the second block of each begins (its end, if the
    two are the same block)."""
    key, x, y, block = (t.column(c).to_numpy() for c in range(4))
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    size = np.diff(np.append(start, len(key)))
    first = np.add.reduceat(block == x, start)
    return start, np.where(first < size, start + first, start + size)


def _same_ids(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row the first row of its group with its doc_id."""
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ids))))
    order = np.lexsort((ids, group))
    new = np.append(True, (group[order][1:] != group[order][:-1]) | (ids[order][1:] != ids[order][:-1]))
    out = np.empty(len(ids), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of (node, doc_id, blocks, n, values): a spanning forest, in each pair of blocks, of the pairs whose
    values and sizes allow the threshold."""
    least = least_equal(threshold)

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, n = t.column(4).to_numpy(), t.column(5).to_numpy()
        values = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint16).reshape(-1, COORDS)
        start, second = _groups(t)
        size = np.diff(np.append(start, len(ids)))
        row, end = np.arange(len(ids)), np.repeat(start + size, size)
        # a row meets those after it, or, where two blocks meet, those of the second
        cross = np.repeat(second < start + size, size)
        begin = np.where(cross, np.where(row < np.repeat(second, size), np.repeat(second, size), end), row + 1)
        later = end - begin
        ends = np.cumsum(later)
        root = _same_ids(ids, start)
        a, b = [], []

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            i = np.repeat(np.arange(at, to), later[at:to])
            j = np.arange(len(i)) + np.repeat(begin[at:to] - (np.cumsum(later[at:to]) - later[at:to]), later[at:to])
            ok = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
            i, j = i[ok], j[ok]
            ok = (values[i] == values[j]).sum(axis=1) >= least
            for p, q in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                x, y = find(p), find(q)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(ids[p])
                    b.append(ids[q])
            while (root[root] != root).any():
                root = root[root]
            at = to
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _per_pair_of_blocks(rows.select("node", "doc_id", "blocks", "n", "values"), "node", work)


def full_sets(docs: DataFrame, chosen: DataFrame, shingle: int) -> DataFrame:
    """chosen(doc_id, cluster, blocks) with n, values and set (binary: sorted 64-bit hashes) of the documents."""
    side = chosen.hint("broadcast" if chosen.count() <= BROADCAST_ROWS else "merge")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(side, "doc_id").select("cluster", "doc_id", "blocks", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = W.text_bytes(batch.column(3))
            for i, j in W.slices(at):
                s, so = document_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], shingle)
                full = np.flatnonzero(np.diff(so))
                if len(full):
                    values = minwise(s, np.append(so[full], so[-1]))
                    yield pa.RecordBatch.from_arrays([
                        *(c.slice(i, j - i).take(pa.array(full)) for c in batch.columns[:3]), pa.array(np.diff(so)[full], pa.int64()),
                        pa.array([v.tobytes() for v in values], pa.binary()), pa.array([s[so[k] : so[k + 1]].tobytes() for k in full], pa.binary()),
                    ], names=["cluster", "doc_id", "blocks", "n", "values", "set"])

    return rows.mapInArrow(run, "cluster long, doc_id long, blocks int, n long, values binary, set binary")


def links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of (cluster, doc_id, blocks, n, values, set): a spanning forest, in each pair of blocks, of the pairs
    with 100 * intersection >= percent * union of the full sets. What joins documents of one block is returned
    only where that block meets itself."""
    least = least_equal(percent / 100)

    def within(ids: np.ndarray, n: np.ndarray, values: np.ndarray, sets: list[np.ndarray], second: int) -> Iterator[tuple[int, int]]:
        size = len(ids)
        root = _same_ids(ids, np.zeros(1, np.int64))
        code = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        at = np.concatenate([[0], np.cumsum(n)])
        seen = np.full(int(code.max()) + 1, -1, np.int32)
        # first inside the blocks, then, over what is still apart, across
        turns = [(range(size), lambda i: (i + 1, second if i < second else size)), (range(second if second < size else 0), lambda i: (second, size))]
        for turn, (left, reach) in enumerate(turns):
            for i in left:
                p, q = reach(i)
                j = np.arange(p, q)
                j = j[(root[p:q] != root[i]) & (100 * np.minimum(n[i], n[p:q]) >= percent * np.maximum(n[i], n[p:q]))]
                j = j[(values[j] == values[i]).sum(axis=1) >= least]
                if not len(j):
                    continue
                seen[code[at[i] : at[i + 1]]] = i
                to = np.cumsum(n[j])
                place = np.arange(to[-1]) + np.repeat(at[j] - (to - n[j]), n[j])
                both = np.add.reduceat(seen[code[place]] == i, to - n[j], dtype=np.int64)
                for k in j[100 * both >= percent * (n[i] + n[j] - both)].tolist():
                    if root[k] != root[i]:
                        root[root == root[k]] = root[i]
                        if turn or second == size:
                            yield int(ids[i]), int(ids[k])

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        start, second = _groups(t)
        out: list[tuple[int, int]] = []
        for i, m, j in zip(start.tolist(), second.tolist(), [*start[1:].tolist(), t.num_rows], strict=True):
            if j - i > 1:
                part = t.slice(i, j - i)
                values = np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint16).reshape(-1, COORDS)
                sets = [np.frombuffer(x.as_buffer(), _U) for x in part.column(7)]
                out += within(part.column(4).to_numpy(), part.column(5).to_numpy(), values, sets, m - i)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return _per_pair_of_blocks(rows, "cluster", work)


def near_documents(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = TREES, levels: int = LEVELS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    A text of fewer words than a shingle, but not none, is one shingle; a text without words, or null, is
    empty and linked with nothing. Rows with a null id are kept and never linked; rows of one id are one
    document, with all its texts. Ties go to the smallest id. An empty table gives an empty result."""
    threshold = percent / 100
    every = stored(sketches(docs, shingle, threshold, trees), "sketches")
    sets = every.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # written, so that adaptive execution can split the join where a set is hot
    first = stored(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1"), "first")
    copies = stored(sets.select("doc_id", "digest").join(first.hint("merge"), "digest").where("doc_id <> rep").select("doc_id", "digest", "rep"), "copies")
    side = copies.select("doc_id", "digest").hint("broadcast" if copies.count() <= BROADCAST_ROWS // 4 else "merge")
    own = stored(sets.join(side, ["doc_id", "digest"], "left_anti").select("doc_id", "n", "nodes", "values"), "own")
    nodes = final_nodes(own, threshold, levels, small, block)
    forest = candidates(nodes.join(own.select("doc_id", "n", "values").hint("merge"), "doc_id"), threshold)
    clusters = stored(connected_components(forest, "candidates").join(own.select(F.col("doc_id").alias("id"), "n").hint("merge"), "id"), "clusters")
    size = stored(clusters.groupBy(F.col("component_id").alias("cluster")).agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_HASHES)).cast("int").alias("blocks")), "blocks")
    members = clusters.select(F.col("id").alias("doc_id"), F.col("component_id").alias("cluster")).distinct()
    chosen = stored(members.join(size.hint("merge"), "cluster").select("doc_id", "cluster", "blocks"), "chosen")
    found = links(full_sets(docs, chosen, shingle), percent)
    edges = found.union(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    comp = connected_components(edges, "documents").withColumnRenamed("id", "doc_id")
    out = every.select("doc_id", F.col("n").alias("n_shingles")).join(comp.hint("merge"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
