"""Near-equal vectors: navigable small-world graphs per shard, all shards queried, links verified and joined."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, give_back, shared_dir, uri_of, written
from .text import mix

DEGREE = 16
#: Shards are at least so many, and more where one would hold more vectors than this (about 100 MB with its graph and
#: what a search keeps); queries come in slices of so many vectors and bytes at most, each a task of its own that reads
#: one shard after the other.
SHARDS = 6
SHARD_VECTORS = 60_000
#: Bytes of a shard's vectors in single precision; a task holds about five times as much.
SHARD_BYTES = 64 << 20
SLICE_VECTORS = 10_000
SLICE_BYTES = 16 << 20
#: Slices are at least so many, for the cores; and the places of a beam search of all queries together.
SLICES = 48
BEAM_PLACES = 1_000_000
FIRST_BEAM = 48
RECALL = 0.99
AUDITS = 256
SLACK = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def chosen_neighbours(sims: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of each row's candidates: those nearer to the node than to any chosen before, then the nearest.

    ids is -1 where there is none; rows are in descending order of similarity.
    """
    rows, width = ids.shape
    vectors = x[np.maximum(ids, 0)]
    between = np.matmul(vectors, vectors.transpose(0, 2, 1))
    real = ids >= 0
    kept = np.zeros_like(real)
    for k in range(width):
        near = np.where(kept, between[:, k, :], -2.0).max(axis=1)
        kept[:, k] = real[:, k] & (sims[:, k] > near) & (kept.sum(axis=1) < most)
    rank = np.argsort(np.where(kept, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, rank, axis=1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


class Layer:
    """One level: nodes (numbers of vectors) and their links (numbers of vectors), -1 where there is none."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray, degree: int):
        self.x, self.nodes, self.degree = x, nodes, degree
        self.links = np.full((len(x), degree), -1, dtype=np.int32)

    def join(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Link new nodes to chosen candidates and back; a full list is chosen anew."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        self.links[new] = chosen_neighbours(sims, ids, self.x, self.degree)
        own = self.links[new][:, : max(1, self.degree // 2)]
        target, source = own.ravel(), np.repeat(new, own.shape[1])
        target, source = target[target >= 0], source[target >= 0]
        order = np.lexsort((source, target))
        target, source = target[order], source[order]
        if not len(target):
            return
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        for k in range(0, len(heads), 1024):
            part = heads[k : k + 1024]
            width = min(int(count[k : k + 1024].max()), 2 * self.degree)
            place = first[k : k + 1024, None] + np.arange(width)
            back = np.where(np.arange(width) < count[k : k + 1024, None], source[np.minimum(place, len(source) - 1)], -1)
            both = np.concatenate((self.links[part], back), axis=1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            s = np.where(both >= 0, np.einsum("ad,akd->ak", self.x[part], self.x[np.maximum(both, 0)]), -2.0)
            order = np.argsort(-s, axis=1, kind="stable")[:, : 3 * self.degree]
            self.links[part] = chosen_neighbours(np.take_along_axis(s, order, axis=1), np.take_along_axis(both, order, axis=1), self.x, self.degree)

    def nearest(self, q: np.ndarray, entry: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries together: numbers (-1: none) and similarities of the best `beam`."""
        rows = len(q)
        ids = np.full((rows, beam), -1, dtype=np.int32)
        sims = np.full((rows, beam), -2.0, dtype=np.float32)
        done = np.zeros((rows, beam), dtype=bool)
        seen = np.zeros((rows, len(self.x)), dtype=bool)
        ids[:, 0] = entry
        sims[:, 0] = np.einsum("ad,ad->a", q, self.x[entry])
        seen[np.arange(rows), entry] = True
        expand = min(expand, beam)
        while True:
            open_ = np.where(~done & (ids >= 0), sims, -3.0)
            some = np.flatnonzero(open_.max(axis=1) > -3.0)
            if not len(some):
                return ids, sims
            best = np.argpartition(-open_[some], expand - 1, axis=1)[:, :expand]
            real = np.take_along_axis(open_[some], best, axis=1) > -3.0
            go = np.where(real, np.take_along_axis(ids[some], best, axis=1), -1)
            done[some[:, None], best] |= real
            found = np.where(go[:, :, None] >= 0, self.links[np.maximum(go, 0)], -1).reshape(len(some), -1)
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[some[:, None], np.maximum(found, 0)]] = -1
            r, c = np.nonzero(found >= 0)
            at = found[r, c]
            seen[some[r], at] = True
            fresh = np.full(found.shape, -2.0, dtype=np.float32)
            fresh[r, c] = np.einsum("ad,ad->a", q[some[r]], self.x[at])
            all_ids = np.concatenate((ids[some], found), axis=1)
            all_sims = np.concatenate((sims[some], fresh), axis=1)
            all_done = np.concatenate((done[some], np.zeros(found.shape, dtype=bool)), axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[some] = np.take_along_axis(all_ids, top, axis=1)
            sims[some] = np.take_along_axis(all_sims, top, axis=1)
            done[some] = np.take_along_axis(all_done, top, axis=1)


class Graph:
    """A hierarchical graph over unit vectors; vectors are inserted in batches no larger than the graph so far."""

    def __init__(self, x: np.ndarray, codes: np.ndarray):
        self.x = x
        chance = (mix(codes.view(np.uint64) ^ np.uint64(11)) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.minimum((-np.log(np.maximum(chance, 1e-12)) / np.log(DEGREE)).astype(int), 6)
        self.layers: list[Layer] = []
        for up in range(int(level.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(level >= up)
            layer = Layer(x, nodes, DEGREE if up else 2 * DEGREE)
            start = nodes[:512]
            s = x[start] @ x[start].T
            np.fill_diagonal(s, -2.0)
            width = min(3 * DEGREE, max(1, len(start) - 1))
            if len(start) > 1:
                top = np.argpartition(-s, width - 1, axis=1)[:, :width]
                layer.join(start, start[top].astype(np.int32), np.take_along_axis(s, top, axis=1))
            at = len(start)
            while at < len(nodes):
                new = nodes[at : at + min(at, 512)]
                ids, sims = layer.nearest(x[new], self.entry(x[new], start[0]), FIRST_BEAM)
                s = x[new] @ x[new].T
                np.fill_diagonal(s, -2.0)
                width = min(DEGREE, len(new) - 1)
                if width > 0:
                    top = np.argpartition(-s, width - 1, axis=1)[:, :width]
                    ids = np.concatenate((ids, new[top].astype(np.int32)), axis=1)
                    sims = np.concatenate((sims, np.take_along_axis(s, top, axis=1)), axis=1)
                layer.join(new, ids, sims)
                at += len(new)
            self.layers.append(layer)

    def entry(self, q: np.ndarray, first: int) -> np.ndarray:
        """Where to start below the layers built so far."""
        at = np.full(len(q), self.layers[0].nodes[0] if self.layers else first, dtype=np.int32)
        for layer in self.layers:
            ids, sims = layer.nearest(q, at, 4, 1)
            at = ids[np.arange(len(q)), sims.argmax(axis=1)]
        return at

    def search(self, q: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, number) of what reaches `least`; a query whose beam has too few others is asked again, wider."""
        base, uppers = self.layers[-1], self.layers[:-1]
        at = np.full(len(q), self.layers[0].nodes[0], dtype=np.int32)
        for layer in uppers:
            ids, sims = layer.nearest(q, at, 4, 1)
            at = ids[np.arange(len(q)), sims.argmax(axis=1)]
        rows, found, ask = [], [], np.arange(len(q))
        while len(ask):
            width = min(beam, len(self.x))
            again = [ask[:0]]
            for part in np.split(ask, range(step := max(1, BEAM_PLACES // width), len(ask), step)):
                ids, sims = base.nearest(q[part], at[part], width)
                hit = sims >= least
                full = (hit.sum(axis=1) > width // 2) & (width < len(self.x))
                r, c = np.nonzero(hit & ~full[:, None])
                rows.append(part[r])
                found.append(ids[r, c])
                again.append(part[full])
            ask = np.concatenate(again)
            beam *= 4
        return np.concatenate(rows), np.concatenate(found)


def audited_beam(graph: Graph, least: float) -> int:
    """A beam that finds what it must: copies of some vectors, moved to just above the threshold, lead back to them.

    The beam is doubled until the recall of their links, counted against all vectors of the shard, passes.
    """
    n, dim = graph.x.shape
    rng = np.random.default_rng(17)
    source = rng.choice(n, min(n, AUDITS), replace=False)
    noise = rng.standard_normal((len(source), dim)).astype(np.float32)
    noise -= np.einsum("ad,ad->a", noise, graph.x[source])[:, None] * graph.x[source]
    cos = np.float32(min(1.0, least + 0.003))
    q = cos * graph.x[source] + np.sqrt(1 - cos * cos) * unit(noise + np.float32(1e-9)) if dim > 1 else graph.x[source]
    truth = (q @ graph.x.T) >= least
    beam = FIRST_BEAM
    while beam < n:
        rows, _ = graph.search(q, beam, least)
        if len(rows) >= RECALL * truth.sum():
            break
        beam *= 2
    return beam


def verified(graph: Graph, exact: np.ndarray, q: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, number) of the vectors found whose cosine in double precision is at least `least`."""
    rows, found = graph.search(q.astype(np.float32), beam, least - SLACK)
    sims = np.empty(len(rows))
    for k in range(0, len(rows), 20_000):
        sims[k : k + 20_000] = np.einsum("ad,ad->a", q[rows[k : k + 20_000]], exact[found[k : k + 20_000]])
    return rows[sims >= least], found[sims >= least]


def steps(queries: int, stored: int) -> Iterator[tuple[int, int]]:
    """Batches of queries that keep what a search remembers to some megabytes."""
    step = int(np.clip(8_000_000 // max(stored, 1), 16, 512))
    return ((a, min(a + step, queries)) for a in range(0, queries, step))


def built_shard(codes: np.ndarray, counts: np.ndarray, vectors: np.ndarray, least: float) -> bytes:
    """A shard ready for queries: vectors, graph, the beam that its audit asks for, and which vectors link within it."""
    exact = unit(vectors.astype(np.float64))
    graph = Graph(exact.astype(np.float32), codes)
    beam = audited_beam(graph, least - SLACK)
    group = np.arange(len(codes))
    for a, b in steps(len(codes), len(codes)):
        rows, found = verified(graph, exact, exact[a:b], beam, least)
        lo, hi = np.minimum(rows + a, found), np.maximum(rows + a, found)
        for x, y in np.unique(np.stack((lo, hi), axis=1)[lo < hi], axis=0).tolist():
            while group[x] != x:
                group[x] = x = group[group[x]]
            while group[y] != y:
                group[y] = y = group[group[y]]
            group[max(x, y)] = min(x, y)
    while (group[group] != group).any():
        group = group[group]
    layers = [(layer.nodes.astype(np.int32), layer.degree, layer.links[layer.nodes]) for layer in graph.layers]
    return pickle.dumps((codes, counts, vectors, layers, beam, group.astype(np.int32)))


class Shard:
    """A built shard, read back."""

    def __init__(self, stored: bytes):
        self.codes, self.counts, vectors, layers, self.beam, self.group = pickle.loads(stored)
        self.exact = unit(vectors.astype(np.float64))
        self.graph = Graph.__new__(Graph)
        self.graph.x, self.graph.layers = self.exact.astype(np.float32), []
        for nodes, degree, links in layers:
            layer = Layer(self.graph.x, nodes, degree)
            layer.links[nodes] = links
            self.graph.layers.append(layer)

    def links(self, codes: np.ndarray, vectors: np.ndarray, least: float) -> Iterator[tuple[int, int, list[int]]]:
        """For each query with links in this shard: code, number of linked vectors, one member of each linked group."""
        q = unit(vectors.astype(np.float64))
        for a, b in steps(len(q), len(self.codes)):
            rows, found = verified(self.graph, self.exact, q[a:b], self.beam, least)
            other = self.codes[found] != codes[a + rows]
            rows, found = rows[other], found[other]
            total = np.bincount(rows, weights=self.counts[found], minlength=b - a).astype(np.int64)
            pairs = np.unique(np.stack((rows, self.group[found]), axis=1), axis=0)
            heads = np.searchsorted(pairs[:, 0], np.arange(b - a + 1))
            for r in np.unique(rows).tolist():
                yield int(codes[a + r]), int(total[r]), self.codes[pairs[heads[r] : heads[r + 1], 1]].tolist()


def stored_graph(folder: str, shard: int) -> bytes | None:
    """A built shard from the shared folder, for the task that asks it; None if the shard has no vectors."""
    store, at = pafs.FileSystem.from_uri(f"{folder}/shard={shard}")
    for file in store.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if file.path.endswith(".parquet"):
            with store.open_input_file(file.path) as f:
                return pq.ParquetFile(f).read(["graph"]).column("graph")[0].as_py()
    return None


def slices_of(number: int, floats: int) -> int:
    """Slices of a table's queries, by vectors and by bytes."""
    return max(SLICES, -(-number // SLICE_VECTORS), -(-4 * floats // SLICE_BYTES))


def shards_of(number: int, floats: int, least: int = SHARDS) -> int:
    """Shards of a table, by vectors and by bytes: those of long vectors hold fewer."""
    return max(least, -(-number // SHARD_VECTORS), -(-4 * floats // SHARD_BYTES))


def vector_links(vectors: DataFrame, least: float = 0.95, shards: int = SHARDS) -> DataFrame:
    """Links of cosine >= least among all vectors, and the groups they join.

    Returns a row for each row of vectors: vec_id, n_links (other rows linked directly), component_id (smallest
    vec_id reachable, itself included), kept (vec_id = component_id). A vector that is null, zero or empty or holds
    null or non-finite components links with nothing. Vectors of different length are never compared. Equal vectors
    are one class that is searched once and counted with its size. A row with a null vec_id takes part like any
    other; its component_id is null if no row of its group has an id, and kept is then false. Vectors of any length
    are taken whole; other columns of vectors are never read, whatever their names.

    Each shard's graph is built in one task from its part of the vectors and stored in the shared folder, which
    pyarrow.fs must be able to read. Vectors are dealt to slices; a slice's task asks every shard, reading one graph
    after the other, so that a task holds one shard and one slice, and neither graphs nor copies of vectors are shuffled.
    Candidates are verified in double precision. A query returns one member of each group it links
    to in the shard, not all links.
    """
    sound = F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    clean = F.when(F.coalesce(sound, F.lit(False)), F.transform("embedding", lambda v: v + F.lit(0).cast("float")))
    rows = vectors.select("vec_id", clean.alias("embedding")).withColumn("code", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    classes = written(rows.where("code IS NOT NULL").groupBy("code").agg(F.first("embedding").alias("embedding"), F.count("*").alias("weight")), "vector-classes")
    number, floats = classes.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    wanted = shards_of(number, floats, shards)
    held = classes.withColumn("dim", F.size("embedding").cast("long"))
    stored = held.withColumn("shard", F.col("dim") * wanted + F.pmod(F.xxhash64("code"), F.lit(wanted)))
    slices = slices_of(number, floats)
    most = 2 * max(1, -(-number // slices))  # a slice is dealt by hash, and so may be somewhat larger than others
    spark = vectors.sparkSession

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            cols = (np.concatenate(x) for x in zip(*((p.column("code").to_numpy(), p.column("weight").to_numpy(), matrix(p)) for p in parts), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([parts[0].column("shard")[0].as_py()], pa.int64()), pa.array([built_shard(*cols, least)], pa.binary())], names=["shard", "graph"])

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if parts and parts[0].column("shard")[0].as_py() != shard[a]:
                    yield done()
                    parts.clear()
                parts.append(batch.slice(a, b - a))
        if parts:
            yield done()

    # the numbers are given so that shards, which are small but costly, aren't put together in one task
    order = stored.select("shard", "code", "weight", "embedding").repartition(4 * wanted, "shard").sortWithinPartitions("shard", "code")
    graphs = f"{shared_dir(spark)}/vector-graphs-{uuid.uuid4().hex}"
    order.mapInArrow(build, "shard long, graph binary").write.partitionBy("shard").parquet(graphs)
    folder = uri_of(spark, graphs)

    def asked(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of some vectors of one length in all shards."""
        codes, own = np.concatenate([p.column("code").to_numpy() for p in parts]), np.concatenate([matrix(p) for p in parts])
        for shard in range(own.shape[1] * wanted, (own.shape[1] + 1) * wanted):
            graph = stored_graph(folder, shard)
            if graph is None:
                continue
            out = list(Shard(graph).links(codes, own, least))
            del graph
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["code", "links", "peers"])
            give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dim)) + 1).tolist(), len(dim)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for k in range(a, b, most):
                    part = batch.slice(k, min(most, b - k))
                    if parts and (parts[0].column("dim")[0].as_py() != dim[a] or sum(p.num_rows for p in parts) + part.num_rows > most):
                        yield from asked(parts)
                        parts.clear()
                    parts.append(part)
        if parts:
            yield from asked(parts)

    asking = held.select("dim", "code", "embedding").repartition(slices, "code").sortWithinPartitions("dim", "code")
    found = written(asking.mapInArrow(run, "code long, links long, peers array<long>"), "vector-links")
    discard(spark, graphs)
    linked = connected_components(found.select(F.col("code").alias("a"), F.explode("peers").alias("b"))).select(F.col("id").alias("code"), "component")
    direct = found.groupBy("code").agg(F.sum("links").alias("links"))
    facts = classes.select("code", "weight").join(direct, "code", "left").join(linked, "code", "left")
    facts = facts.select("code", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "code").alias("component"))
    known = rows.select("vec_id", "code").join(facts, "code", "left")
    smallest = known.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("smallest"))
    named = known.join(smallest, "component", "left")
    own = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    named = named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
