"""Near-duplicate vectors: small-world graphs per shard, audited against brute force."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import components
from fleetlens.session import stored

SHARD = 16384
LINKS = 12
BUILD_BEAM = 48
BEAM = 48
BATCH = 512
AUDITED = 64
RECALL = 0.98
SLACK = 1e-4  # single precision finds candidates, double precision decides


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, built and searched in batches.

    Every node is in layer 0, and in each higher layer with the chance of one in ``links``. A batch
    descends from the highest layer; in each layer a beam of the best nodes so far is widened by
    the links of those not yet looked at, for all queries of the batch in step. New nodes link to
    found ones that are nearer to them than to each other, and then to the nearest.
    """

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 1) -> None:
        self.vectors, self.links = vectors, links
        n = len(vectors)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(np.int64)
        self.level = np.minimum(level, max(0, int(np.ceil(np.log(max(n, 2)) / np.log(links))) - 1))
        self.top = -1
        self.entry = np.zeros(0, np.int64)
        self.near: list[np.ndarray] = []
        self.sims: list[np.ndarray] = []
        for layer in range(int(self.level.max(initial=0)) + 1):
            width = 2 * links if layer == 0 else links
            self.near.append(np.full((n, width), -1, dtype=np.int32))
            self.sims.append(np.full((n, width), -np.inf, dtype=np.float32))
        at = 0
        while at < n:
            size = min(BATCH, max(32, at), n - at)
            self._insert(np.arange(at, at + size), beam)
            at += size

    def _insert(self, new: np.ndarray, beam: int) -> None:
        queries = self.vectors[new]
        inside = queries @ queries.T
        np.fill_diagonal(inside, -np.inf)
        start = self.entry
        for layer in range(len(self.near) - 1, -1, -1):
            ids = sims = None
            if self.top >= layer:
                ids, sims = self.search(queries, start, beam if layer == 0 else 16, layer)
                start = ids[:, :4]
            own = self.level[new] >= layer
            if not own.any():
                continue
            peers = np.where(own[None, :], inside[own], -np.inf)
            k = min(len(new), 2 * self.links)
            best = np.argpartition(-peers, k - 1, axis=1)[:, :k]
            peer_sims = np.take_along_axis(peers, best, axis=1)
            peer_ids = np.where(np.isfinite(peer_sims), new[best], -1)
            if ids is not None:
                peer_ids = np.concatenate([ids[own], peer_ids], axis=1)
                peer_sims = np.concatenate([sims[own], peer_sims], axis=1)
            self._connect(layer, new[own], peer_ids, peer_sims.astype(np.float32))
        highest = int(self.level[new].max())
        if highest >= self.top:
            tops = new[self.level[new] == highest]
            self.entry = tops if highest > self.top else np.concatenate([self.entry, tops])[:8]
            self.top = highest

    def _chosen(self, ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates, best first, at most ``width``: those that no chosen one is nearer to, then the nearest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * width]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        rows, k = ids.shape
        if k <= width:
            return ids, sims
        vectors = self.vectors[np.maximum(ids, 0)]
        pairs = vectors @ vectors.transpose(0, 2, 1)
        closest = np.full((rows, k), -np.inf, dtype=np.float32)
        taken = np.zeros((rows, k), dtype=bool)
        for c in range(k):
            take = (ids[:, c] >= 0) & (closest[:, c] < sims[:, c]) & (taken.sum(axis=1) < width)
            taken[:, c] = take
            closest = np.where(take[:, None], np.maximum(closest, pairs[:, c]), closest)
        order = np.argsort(~taken, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def _connect(self, layer: int, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        width = self.near[layer].shape[1]
        ids, sims = self._chosen(ids, sims, width)
        k = ids.shape[1]
        self.near[layer][new, :k], self.sims[layer][new, :k] = ids, sims
        row, column = np.nonzero(ids >= 0)
        to, frm, sim = ids[row, column].astype(np.int64), new[row], sims[row, column]
        changed = np.unique(to)
        old = self.near[layer][changed]
        r, c = np.nonzero(old >= 0)
        to = np.concatenate([to, changed[r]])
        frm = np.concatenate([frm, old[r, c]])
        sim = np.concatenate([sim, self.sims[layer][changed][r, c]])
        pair = np.unique(to * len(self.vectors) + frm, return_index=True)[1]  # a peer may be linked both ways
        to, frm, sim = to[pair], frm[pair], sim[pair]
        order = np.lexsort((-sim, to))
        to, frm, sim = to[order], frm[order], sim[order]
        first = np.searchsorted(to, changed)
        place = np.arange(len(to)) - first[np.searchsorted(changed, to)]
        kept = place < 3 * width
        at = np.searchsorted(changed, to[kept])
        wide_ids = np.full((len(changed), 3 * width), -1, dtype=np.int64)
        wide_sims = np.full((len(changed), 3 * width), -np.inf, dtype=np.float32)
        wide_ids[at, place[kept]], wide_sims[at, place[kept]] = frm[kept], sim[kept]
        for begin in range(0, len(changed), BATCH):
            some = slice(begin, begin + BATCH)
            chosen = self._chosen(wide_ids[some], wide_sims[some], width)
            self.near[layer][changed[some]], self.sims[layer][changed[some]] = chosen

    def search(self, queries: np.ndarray, start: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes of a layer for each query, best first; -1 where fewer than ``beam`` were reached."""
        n, nodes = len(queries), len(self.vectors)
        if start.ndim == 1:
            start = np.broadcast_to(start, (n, len(start)))
        near = self.near[layer]
        step = max(4, beam // 12)
        visited = np.zeros((n, nodes), dtype=bool)
        ids = np.full((n, beam), -1, dtype=np.int64)
        sims = np.full((n, beam), -np.inf, dtype=np.float32)
        spent = np.ones((n, beam), dtype=bool)
        active, coming = np.arange(n), start
        while len(active):
            coming = np.sort(coming, axis=1)
            fresh = coming >= 0
            fresh[:, 1:] &= coming[:, 1:] != coming[:, :-1]
            fresh &= ~visited[active[:, None], np.maximum(coming, 0)]
            row, column = np.nonzero(fresh)
            node = coming[row, column]
            visited[active[row], node] = True
            found = np.full(coming.shape, -np.inf, dtype=np.float32)
            found[row, column] = np.einsum("ij,ij->i", self.vectors[node], queries[active[row]])
            all_sims = np.concatenate([sims[active], found], axis=1)
            all_ids = np.concatenate([ids[active], np.where(fresh, coming, -1)], axis=1)
            all_spent = np.concatenate([spent[active], ~fresh], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = own_sims = np.take_along_axis(all_sims, best, axis=1)
            ids[active] = own_ids = np.take_along_axis(all_ids, best, axis=1)
            own_spent = np.take_along_axis(all_spent, best, axis=1) | (own_ids < 0)
            open_sims = np.where(own_spent, -np.inf, own_sims)
            k = min(step, beam)
            next_ = np.argpartition(-open_sims, k - 1, axis=1)[:, :k]
            going = np.isfinite(np.take_along_axis(open_sims, next_, axis=1))
            np.put_along_axis(own_spent, next_, True, axis=1)
            spent[active] = own_spent
            from_ = np.where(going, np.take_along_axis(own_ids, next_, axis=1), -1)
            alive = going.any(axis=1)
            active, from_ = active[alive], from_[alive]
            coming = np.where(from_[:, :, None] >= 0, near[np.maximum(from_, 0)], -1).astype(np.int64)
            coming = coming.reshape(len(active), k * near.shape[1])
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def nearest(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = self.entry
        for layer in range(self.top, 0, -1):
            start = self.search(queries, start, 16, layer)[0][:, :4]
        return self.search(queries, start, beam, 0)


class Shard:
    """Range queries over the vectors of one shard."""

    def __init__(self, vectors: np.ndarray, threshold: float) -> None:
        self.exact, self.threshold = vectors, threshold
        self.single = vectors.astype(np.float32)
        self.graph = Graph(self.single)
        self.beam = BEAM
        self.audit()

    def brute(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = [np.zeros((2, 0), dtype=np.int64)]
        for at in range(0, len(queries), BATCH):
            hit = np.stack(np.nonzero(queries[at : at + BATCH] @ self.single.T >= self.threshold - SLACK))
            hit[0] += at
            pairs.append(hit)
        left, right = np.concatenate(pairs, axis=1)
        return left, right

    def audit(self) -> None:
        """Widen the beam until enough links of some vectors are found; those are known by brute force.

        Vectors are taken in a random order until ``AUDITED`` of them have a link to another vector, or
        all were taken. So a shard with few links is audited by all of them.
        """
        n = len(self.single)
        if self.beam >= n:
            return  # compared with all vectors in any case
        order = np.random.default_rng(2).permutation(n)
        linked, lefts, rights = 0, [], []
        for at in range(0, n, AUDITED):
            part = order[at : at + AUDITED]
            left, right = self.brute(self.single[part])
            other = part[left] != right
            lefts.append(part[left[other]])
            rights.append(right[other])
            linked += len(np.unique(left[other]))
            if linked >= AUDITED:
                break
        owner, right = np.concatenate(lefts), np.concatenate(rights)
        some, left = np.unique(owner, return_inverse=True)
        while self.beam < n and self.misses(left, right, *self.range(self.single[some])):
            self.beam *= 2

    def misses(self, left: np.ndarray, right: np.ndarray, got_left: np.ndarray, got_right: np.ndarray) -> bool:
        """Whether too few of the links wanted were got, over all of them or as the mean of their vectors."""
        if not len(left):
            return False
        n = len(self.single)
        got = np.isin(left * n + right, got_left * n + got_right)
        found = np.bincount(left, got)[np.unique(left)] / np.bincount(left)[np.unique(left)]
        return min(got.mean(), found.mean()) < RECALL

    def audited(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hits of vectors of other shards. ``AUDITED`` of a batch are held against brute force as well.

        Where they miss links the beam is widened, for this batch and those after it.
        """
        some = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(np.int64))
        wanted = self.brute(queries[some]) if self.beam < len(self.single) else None
        while True:
            left, right = self.range(queries)
            if self.beam >= len(self.single):
                return left, right
            at = np.minimum(np.searchsorted(some, left), len(some) - 1)
            inside = some[at] == left
            if not self.misses(*wanted, at[inside], right[inside]):
                return left, right
            self.beam *= 2

    def range(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of query and vector found with at least the threshold, up to single precision.

        A query whose whole beam is near enough is asked again with a wider one, so hits are not cut
        off; when the beam is as wide as the shard, the query is compared with all vectors.
        """
        lefts, rights = [], []
        for at in range(0, len(queries), BATCH):
            todo, beam = np.arange(at, min(at + BATCH, len(queries))), self.beam
            while len(todo):
                if beam >= len(self.single):
                    left, right = self.brute(queries[todo])
                    lefts.append(todo[left])
                    rights.append(right)
                    break
                ids, sims = self.graph.nearest(queries[todo], beam)
                hit = sims >= self.threshold - SLACK
                full = hit.all(axis=1)
                row, column = np.nonzero(hit & ~full[:, None])
                lefts.append(todo[row])
                rights.append(ids[row, column])
                todo, beam = todo[full], beam * 4
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *lefts]), np.concatenate([none, *rights])

    def links(self, queries: np.ndarray, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pairs confirmed in double precision. ``inside`` says that the queries are the shard's own."""
        single = queries.astype(np.float32)
        left, right = self.range(single) if inside else self.audited(single)
        sure = np.zeros(len(left), dtype=bool)
        for at in range(0, len(left), 1 << 14):
            some = slice(at, at + (1 << 14))
            cosine = np.einsum("ij,ij->i", queries[left[some]], self.exact[right[some]])
            sure[some] = cosine >= self.threshold
        return left[sure], right[sure]


def units(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; all rows have one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


class Forest:
    """Which links are needed to connect what a task's links connect."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while self.parent.get(x, x) != x:
            path.append(x)
            x = self.parent[x]
        for p in path:
            self.parent[p] = x
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def shard_links(rows: DataFrame, threshold: float) -> DataFrame:
    """Links between the vectors of a shard and all queries sent to it.

    ``rows`` are sorted by ``label``, ``dims``, ``shard`` and ``query`` inside partitions: the vectors
    of a shard (``query`` is false) come first and are held; the queries follow and pass in batches.
    ``needed`` marks links that connect something in this task that the links before did not.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, held, shard, ids, forest = None, [], None, None, Forest()

        def found(queries: pa.RecordBatch, inside: bool) -> pa.RecordBatch:
            left, right = shard.links(units(queries.column(5)), inside)
            a, b = queries.column(4).to_numpy()[left], ids[right]
            low, high = np.minimum(a, b), np.maximum(a, b)
            keep = low != high
            pairs = np.unique(np.stack([low[keep], high[keep]]), axis=1) if keep.any() else np.zeros((2, 0), np.int64)
            needed = [forest.joins(x, y) for x, y in zip(*pairs.tolist())]
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64()), pa.array(needed, pa.bool_())],
                names=["a", "b", "needed"],
            )

        def built() -> pa.RecordBatch:
            nonlocal shard, ids
            members = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            ids = members.column(4).to_numpy()
            shard = Shard(units(members.column(5)), threshold)
            return found(members, True)

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                part, key = batch.slice(begin, end - begin), keys[begin]
                if mark != key[:3]:
                    if held:
                        yield built()
                    mark, shard, forest = key[:3], None, Forest()
                if not key[3]:
                    held.append(part)
                else:
                    if held:
                        yield built()
                    yield found(part, False)
        if held:
            yield built()

    return rows.mapInArrow(find, "a long, b long, needed boolean")


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: only finite components, and one that is not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    shard: int = SHARD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Link vectors of one label whose cosine is ``threshold`` or more, and connect what is linked.

    One row per input row: the id, ``n_links`` (other vectors linked directly), ``component_id``
    (smallest id reachable), ``kept`` (the id is the component's).

    Equal vectors of a label are one class, linked among themselves and represented by the smallest
    id. The classes of a label are spread over shards of about ``shard`` classes, a graph is built for
    each shard in one task, and every class of the label is looked up in every shard of the label.
    Each shard is audited against brute force, by its own vectors and by some of every batch of others,
    and its beam widened until the audit passes; hits that fill a beam widen it further. Only links confirmed in double precision leave the task, each
    once; their ends are counted, and those that connect something new make the components.

    Vectors that are null, empty or zero, or have null or non-finite components, and rows without
    label or id have no links and stand alone. Vectors of different lengths are not linked. A
    repeated row counts as another vector. An empty table gives an empty result. Other columns are
    not read and may have any name.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    classes = rows.filter(good).groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = stored(classes.withColumn("dims", F.size("vector")), "vector-classes")
    per_label = reps.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    per_label = stored(per_label, "vector-labels")
    n_shards = per_label.agg(F.sum("shards").alias("n")).first().n or 1
    placed = reps.join(per_label, ["label", "dims"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    sent = placed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    parts = max(n_shards * 4, rows.sparkSession.sparkContext.defaultParallelism)
    sorted_rows = (
        sent.select("label", "dims", "shard", (F.col("shard") != F.col("own")).alias("query"), F.col("rep").cast("long"), "vector")
        .repartition(parts, "label", "dims", "shard")
        .sortWithinPartitions("label", "dims", "shard", "query", "rep")
    )
    found = stored(shard_links(sorted_rows, threshold), "vector-links")
    connected = components(found.filter("needed").select("a", "b"), "vector")
    links = found.select("a", "b").distinct()
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = reps.select(F.col("rep").alias("b"), "n")
    counts = both.join(weights, "b").groupBy("a").agg(F.sum("n").alias("more")).withColumnRenamed("a", "rep")
    classed = (
        reps.select("label", "vector", "rep", "n")
        .join(counts, "rep", "left")
        .join(connected.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "label",
            "vector",
            (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = rows.filter(good).join(classed, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
