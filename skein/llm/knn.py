"""The k most similar vectors of every vector, by robust-pruned directed graphs over shards.

Vectors are normalised and go to the shard of a similar sampled vector (a pivot), so that tight groups stay together;
those without a similar pivot go to the shard of the nearest centroid. Besides its own shard a vector asks all whose
centroid is less similar to it than the nearest one by no more than a margin. The margins, for vectors with a similar
pivot, without one, and of groups that fill several shards, are read off the true neighbours of trial vectors, which
one pass over all vectors finds: structured vectors ask one or two shards, unstructured ones nearly all. Shards that
outgrow their size are split into parts; who asks such a shard asks all of its parts.

In each part a directed graph is grown: greedy searches over the graph so far propose the neighbours of a block of new
vectors, relaxed distance pruning keeps edges in diverse directions, and edges are entered backwards too. A beam search
over the finished graph answers every query of the part; the beam is widened where trial queries show that it misses
neighbours. All searches of a block advance together as numpy matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.layout import cut, stored

#: Vectors that a shard should hold, most centroids, and the bounded sample that centroids are fitted on.
SHARD, MOST_SHARDS, SAMPLE_PER_SHARD, MOST_SAMPLE = 8192, 8192, 1024, 131_072
#: Bytes of the sample's vectors, whatever their length; at most twice as many come to the driver, and as many go out.
MOST_BYTES = 1 << 25
#: Cosine from which a pivot counts as similar, and the nearest centroids whose pivots are looked at.
TIGHT, LOOK = 0.8, 5
#: Cosine from which unit vectors of single precision count as equal.
EQUAL = 1 - 1e-6
#: Edges kept by pruning, edges that a list may hold before it is pruned, the relaxation of distances.
DEGREE, SLACK, ALPHA = 10, 14, 1.15
#: Beam widths of the searches that build and of those that answer, and how many beams a step expands.
BUILD_BEAM, BEAM, STEP = 12, 14, 5
BLOCK = 512
#: Share of the trial vectors' neighbours that the asked shards must hold, share of the nearest vectors that a beam must
#: find, and how many trial vectors of a kind tell both.
COVER, FOUND, TRIAL = 0.98, 0.95, 256


class Graph:
    """A robust-pruned graph over the rows of a matrix of unit vectors, and beam search over it."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, n = x, len(x)
        self.edges = np.full((n, SLACK), -1, np.int32)
        self.degree = np.zeros(n, np.int32)
        self.order = np.random.default_rng(7).permutation(n).astype(np.int32)
        first = min(n, 256)
        self.seen = 0
        #: searches enter at the first third of the order, as at an upper layer
        self.entry_count = max(first, n // 3)
        self.scratch = np.empty(0, np.int32)
        start = self.order[:first]
        sims = x[start] @ x[start].T
        np.fill_diagonal(sims, -2)
        keep = min(first - 1, BUILD_BEAM)
        if keep > 0:
            near = np.argsort(-sims, axis=1, kind="stable")[:, :keep]
            self.enter(start, start[near].astype(np.int32), np.take_along_axis(sims, near, axis=1))
        self.seen = first
        while self.seen < n:
            new = self.order[self.seen : self.seen + min(self.seen, BLOCK)]
            ids, near = self.search(x[new], BUILD_BEAM)
            self.enter(new, ids, near)
            self.seen += len(new)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities (queries x beam, best first; -1 and -2 where fewer were reached)."""
        x, n, total = self.x, len(self.x), len(queries)
        entries = self.order[: min(self.entry_count, self.seen)]
        take = min(len(entries), 8)
        sims = queries @ x[entries].T
        top = np.argpartition(sims, len(entries) - take, axis=1)[:, len(entries) - take :]
        ids = np.full((total, beam), -1, np.int32)
        near = np.full((total, beam), -2, np.float32)
        width = min(take, beam)
        ids[:, :width] = entries[top[:, -width:]]
        near[:, :width] = np.take_along_axis(sims, top[:, -width:], axis=1)
        done = ids < 0
        if len(self.scratch) < total * n:
            self.scratch = np.empty(total * n, np.int32)
        mark = self.scratch[: total * n]
        mark[:] = -1
        base = (np.arange(total, dtype=np.int64) * n)[:, None]
        mark[(base + np.maximum(ids, 0)).ravel()] = 0
        out_ids, out_near = ids.copy(), near.copy()
        live = np.arange(total)
        slots = np.arange(STEP * SLACK, dtype=np.int32)[None]
        stamp = 1
        while len(live):
            pick = np.argpartition(np.where(done, np.float32(3), -near), STEP - 1, axis=1)[:, :STEP]
            skip = np.take_along_axis(done, pick, axis=1)
            np.put_along_axis(done, pick, True, axis=1)
            heads = np.take_along_axis(ids, pick, axis=1)
            nb = self.edges[np.where(skip, 0, heads)]
            nb[skip] = -1
            nb = nb.reshape(len(live), -1)
            row, col = np.nonzero(nb >= 0)
            spot = base[live[row], 0] + nb[row, col]
            fresh = mark[spot] < 0
            row, col, spot = row[fresh], col[fresh], spot[fresh]
            tag = stamp + col.astype(np.int32)
            mark[spot] = tag
            once = mark[spot] == tag
            row, col = row[once], col[once]
            stamp += slots.shape[1]
            who = nb[row, col]
            found = np.einsum("ij,ij->i", x[who], queries[live[row]])
            more = np.full(nb.shape, -2, np.float32)
            more[row, col] = found
            all_near = np.concatenate([near, more], axis=1)
            keep = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            near = np.take_along_axis(all_near, keep, axis=1)
            ids = np.take_along_axis(np.concatenate([ids, nb], axis=1), keep, axis=1)
            done = np.take_along_axis(np.concatenate([done, more <= -2], axis=1), keep, axis=1)
            ids = np.where(near > -2, ids, -1)
            over = done.all(axis=1)
            if over.any():
                out_ids[live[over]], out_near[live[over]] = ids[over], near[over]
                stay = ~over
                live, ids, near, done = live[stay], ids[stay], near[stay], done[stay]
        best = np.argsort(-out_near, axis=1, kind="stable")
        return np.take_along_axis(out_ids, best, axis=1), np.take_along_axis(out_near, best, axis=1)

    def prune(self, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of candidates sorted by similarity, those that no kept one covers: at most DEGREE a row, -1 behind them."""
        x = self.x
        vectors = x[np.maximum(ids, 0)]
        own = 2 - 2 * near
        between = (2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))) * np.float32(ALPHA**2)
        covers = between <= own[:, None, :]
        alive = ids >= 0
        kept = np.zeros(ids.shape, bool)
        count = np.zeros(len(ids), np.int32)
        for j in range(ids.shape[1]):
            take = alive[:, j] & (count < DEGREE)
            kept[:, j] = take
            count += take
            alive &= ~(covers[:, j] & take[:, None])
        # slots that pruning leaves free go to the nearest of the rest, so that dense groups stay connected
        rest = (ids >= 0) & ~kept
        room = DEGREE - count
        kept |= rest & (np.cumsum(rest, axis=1) <= room[:, None])
        place = np.argsort(~kept, axis=1, kind="stable")[:, :DEGREE]
        return np.where(np.take_along_axis(kept, place, axis=1), np.take_along_axis(ids, place, axis=1), -1)

    def enter(self, new: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
        """Give the new rows their pruned edges, and enter these backwards."""
        chosen = self.prune(ids, near)
        self.edges[new, : chosen.shape[1]] = chosen
        self.degree[new] = (chosen >= 0).sum(axis=1)
        row, col = np.nonzero(chosen >= 0)
        target, source = chosen[row, col], new[row]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        again = (self.edges[target] == source[:, None]).any(axis=1)
        target, source = target[~again], source[~again]
        if not len(target):
            return
        head = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        nth = np.arange(len(target)) - np.repeat(head, np.diff(np.append(head, len(target))))
        space = self.degree[target] + nth < SLACK
        self.edges[target[space], self.degree[target[space]] + nth[space]] = source[space]
        full, late, place = target[~space], source[~space], nth[~space]
        np.add.at(self.degree, target[space], 1)
        if len(full):
            rows, index = np.unique(full, return_inverse=True)
            start = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]]))
            k = np.arange(len(full)) - np.repeat(start, np.diff(np.append(start, len(full))))
            lists = np.full((len(rows), SLACK + int(k.max()) + 1), -1, np.int32)
            lists[:, :SLACK] = self.edges[rows]
            lists[index, SLACK + k] = late
            for a in range(0, len(rows), 1024):
                of, part = rows[a : a + 1024], lists[a : a + 1024]
                sims = np.einsum("bkd,bd->bk", self.x[np.maximum(part, 0)], self.x[of])
                sims[part < 0] = -2
                best = np.argsort(-sims, axis=1, kind="stable")
                chosen = self.prune(np.take_along_axis(part, best, axis=1), np.take_along_axis(sims, best, axis=1))
                self.edges[of] = -1
                self.edges[of, : chosen.shape[1]] = chosen
                self.degree[of] = (chosen >= 0).sum(axis=1)


def wide_enough(graph: Graph, k: int) -> int:
    """The beam, doubled from the default, at which sampled rows find the share FOUND of their k nearest."""
    x, n = graph.x, len(graph.x)
    beam, few = max(BEAM, k + 1), min(k, n - 1)
    rows = graph.order[-min(n, TRIAL) :]
    if few < 1:
        return beam
    sims = x[rows] @ x.T
    sims[np.arange(len(rows)), rows] = -2
    least = np.partition(sims, n - few, axis=1)[:, n - few] - 1e-5
    while beam < n:
        got = [graph.search(x[rows[a : a + 32]], beam) for a in range(0, len(rows), 32)]
        found, near = (np.concatenate(part) for part in zip(*got))
        hits = ((near >= least[:, None]) & (found >= 0) & (found != rows[:, None])).sum(axis=1)
        if np.minimum(hits, few).mean() >= FOUND * few:
            break
        beam *= 2
    return beam


def search_shard(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest ids of each query among a shard's vectors, without the query's own id; -1 where fewer exist."""
    graph = Graph(x)
    beam = wide_enough(graph, k)
    size = max(32, min(BLOCK, (1 << 25) // max(len(x), 16 * beam)))
    out_ids, out_near = [], []
    for a in range(0, len(queries), size):
        found, near = graph.search(queries[a : a + size], beam)
        named = np.where(found >= 0, ids[np.maximum(found, 0)], -1)
        other = (found >= 0) & (named != query_ids[a : a + size, None])
        place = np.argsort(~other, axis=1, kind="stable")[:, :k]
        ok = np.take_along_axis(other, place, axis=1)
        out_ids.append(np.where(ok, np.take_along_axis(named, place, axis=1), -1))
        out_near.append(np.where(ok, np.take_along_axis(near, place, axis=1), np.float32(-2)))
    return np.concatenate(out_ids), np.concatenate(out_near)


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are usable, and their unit vectors: exactly dim finite numbers, not all zero."""
    if not len(column):
        return np.empty(0, np.int64), np.empty((0, dim), np.float32)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(rows)).flatten()
    raw = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    top = np.abs(raw).max(axis=1, initial=0)
    fine = np.isfinite(raw).all(axis=1) & (top > 0)
    raw = raw[fine] / top[fine, None]
    return rows[fine], (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)


def fit_centroids(sample: np.ndarray, shards: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on the bounded sample."""
    rng = np.random.default_rng(11)
    centers = sample[rng.choice(len(sample), min(shards, len(sample)), replace=False)]
    for _ in range(rounds):
        of = (sample @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 1e-6, sums / np.maximum(norms, 1e-6), centers).astype(np.float32)
    return centers


class Router:
    """Centroids and pivots, fitted on a bounded sample, that send vectors to shards.

    Pivots similar to each other belong to one shard, unless so many are that they stand for more than a shard: then
    each stays in its centroid's shard. A vector is of kind 0 without a similar pivot, 1 with one, 2 with one of a
    group that fills several shards. margin has the widest gap of a kind between the similarities of the nearest
    centroid and of a centroid whose shard is asked, and parts the parts of each shard.
    """

    def __init__(self, sample: np.ndarray, shards: int, vectors: int = 0, k: int = 5) -> None:
        self.centers = fit_centroids(sample, shards) if shards > 1 else np.zeros((1, sample.shape[1]), np.float32)
        of = (sample @ self.centers.T).argmax(axis=1)
        order = np.argsort(of, kind="stable")
        self.pivots, self.shard = sample[order], of[order].astype(np.int32)
        self.start = np.searchsorted(self.shard, np.arange(shards + 1))
        self.target, self.split, self.margin = self.shard, np.zeros(len(sample), bool), np.zeros(3)
        if shards > 1:
            root = self.groups()
            size = np.bincount(root, minlength=len(sample))[root]
            self.target = np.where(size * shards <= len(sample), self.shard[root], self.shard)
            self.split = size * shards > len(sample)
        self.parts = np.maximum(1, np.round(np.bincount(self.target, minlength=shards) / max(1, len(sample)) * vectors / (2 * SHARD))).astype(np.int64)
        self.offset = np.cumsum(self.parts) - self.parts
        if shards > 1:
            # until the true neighbours of trial vectors are known, those in the sample stand for them
            self.trial = self.trials()
            near = self.pivots[np.concatenate([self.nearest_pivots(self.trial[a : a + 64], k) for a in range(0, len(self.trial), 64)])]
            self.calibrate([(t, v) for t, row in enumerate(near) for v in row])

    def groups(self) -> np.ndarray:
        """For each pivot the first pivot that similar ones lead to."""
        root = np.arange(len(self.pivots))
        one, two = self.similar()
        while True:
            low = root.copy()
            np.minimum.at(low, one, root[two])
            np.minimum.at(low, two, root[one])
            low = low[low]
            if (low == root).all():
                return root
            root = low

    def trials(self) -> np.ndarray:
        """Up to TRIAL pivots of each kind."""
        order = np.random.default_rng(13).permutation(len(self.pivots))
        kind = self.placed(self.pivots[order])[1]
        return self.pivots[order[np.concatenate([np.flatnonzero(kind == c)[:TRIAL] for c in range(3)])]]

    def nearest_pivots(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k most similar pivots of each vector but its equals."""
        sims = x @ self.pivots.T
        sims[sims > EQUAL] = -2
        few = min(k, sims.shape[1])
        return np.argpartition(-sims, few - 1, axis=1)[:, :few]

    def calibrate(self, pairs: list[tuple[int, np.ndarray]]) -> None:
        """Set the margins from (trial, a neighbour of it): they hold the share COVER of a kind's pairs."""
        if not pairs or len(self.centers) == 1:
            return
        sims, kind, home = self.placed(self.trial)
        at = np.array([t for t, _ in pairs])
        theirs = self.placed(np.stack([v for _, v in pairs]))[2]
        gap = np.where(theirs == home[at], 0, sims.max(axis=1)[at] - sims[at, theirs])
        for c in range(3):
            if (of := gap[kind[at] == c]).size:
                self.margin[c] = np.quantile(of, COVER, method="higher") + 1e-6

    def blocks(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """For the pivots of each shard: the rows that look at them, the first pivot, and the cosines."""
        sims = x @ self.centers.T
        width = min(LOOK, len(self.centers))
        look = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        row, shard = np.repeat(np.arange(len(x)), width), look.ravel()
        by = np.argsort(shard, kind="stable")
        row, shard = row[by], shard[by]
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        for a, b in zip(edges, edges[1:]):
            low, high = self.start[shard[a]], self.start[shard[a] + 1]
            for k in range(a, b if low < high else a, 4096):
                rows = row[k : min(k + 4096, b)]
                yield rows, low, x[rows] @ self.pivots[low:high].T

    def similar(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of similar pivots, for each pivot its nearest few in every block."""
        one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for rows, low, got in self.blocks(self.pivots):
            few = min(9, got.shape[1])
            top = np.argpartition(-got, few - 1, axis=1)[:, :few]
            a, b = np.nonzero(np.take_along_axis(got, top, axis=1) >= TIGHT)
            one.append(rows[a])
            two.append(low + top[a, b])
        return np.concatenate(one), np.concatenate(two)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most similar pivot of each vector among the nearest centroids' pivots, and its cosine.

        Equal pivots are left out, so that sampled vectors are treated as all others are.
        """
        best, value = np.zeros(len(x), np.int64), np.full(len(x), -2, np.float32)
        for rows, low, got in self.blocks(x):
            got[got > EQUAL] = -2
            at = got.argmax(axis=1)
            top = got[np.arange(len(rows)), at]
            better = top > value[rows]
            value[rows[better]], best[rows[better]] = top[better], low + at[better]
        return best, value

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Similarities to the centroids, kinds and own shards of vectors."""
        sims = x @ self.centers.T
        if len(self.centers) == 1:
            return sims, np.zeros(len(x), np.int8), np.zeros(len(x), np.int64)
        pivot, value = self.nearest(x)
        tight = value >= TIGHT
        return sims, np.where(tight, np.where(self.split[pivot], 2, 1), 0), np.where(tight, self.target[pivot], sims.argmax(axis=1))

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, part, role) of the places of vectors: role 0 where a vector is indexed and asks, 1 where it only asks."""
        sims, kind, home = self.placed(x)
        margin = self.margin[kind][:, None]
        asks = (sims >= sims.max(axis=1, keepdims=True, initial=-2) - margin) & (margin > 0)
        asks[np.arange(len(x)), home] = True
        row, shard = np.nonzero(asks)
        # a vector is indexed in one part of its shard, by a hash of its bits, and asks every part
        count = self.parts[shard]
        row, shard, role = np.repeat(row, count), np.repeat(shard, count), np.repeat((home[row] != shard).astype(np.int8), count)
        part = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        mixed = (np.ascontiguousarray(x).view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1) >> np.uint64(40)
        role[part != (mixed[row] % self.parts[shard].astype(np.uint64)).astype(np.int64)] = 1
        return row, (self.offset[shard] + part).astype(np.int32), role

    @property
    def total(self) -> int:
        return int(self.parts.sum())


def true_neighbours(nodes: DataFrame, trial: np.ndarray, dim: int, k: int) -> list[tuple[int, np.ndarray]]:
    """(trial, neighbour): the k most similar vectors, by one pass over all; every task keeps k of each trial vector."""
    few = nodes.sparkSession.sparkContext.broadcast(trial)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = few.value
        near, found = np.full((len(asked), k), -2, np.float32), np.zeros((len(asked), k, dim), np.float32)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                x = np.frombuffer(b"".join(batch.column(0).slice(a, 4096).to_pylist()), np.float32).reshape(-1, dim)
                sims = asked @ x.T
                sims[sims > EQUAL] = -2
                for t in np.flatnonzero((sims > near.min(axis=1)[:, None]).any(axis=1)):
                    better = np.flatnonzero(sims[t] > near[t].min())
                    all_near = np.concatenate([near[t], sims[t, better]])
                    keep = np.argsort(-all_near, kind="stable")[:k]
                    near[t], found[t] = all_near[keep], np.concatenate([found[t], x[better]])[keep]
        row, col = np.nonzero(near > -2)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(near[row, col]), pa.array([v.tobytes() for v in found[row, col]], pa.binary())], ["trial", "near", "vec"])

    kept = nodes.select("vec").mapInArrow(seek, "trial int, near float, vec binary")
    best = kept.withColumn("_n", F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("near"), "vec"))).where(F.col("_n") <= k)
    return [(r["trial"], np.frombuffer(r["vec"], np.float32)) for r in best.select("trial", "vec").collect()]


def nearest_neighbours(df: DataFrame, ident: str, embedding: str, dim: int, k: int = 5) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most similar other vectors of every usable vector.

    The accuracy is that of the graph search (recall against brute force is measured in the tests and the README).
    Centroids are fitted on at most MOST_SAMPLE vectors of MOST_BYTES in all, taken by a hash of their ids; every
    vector is indexed and every vector is a query. Copies of one vector form one class: the graph holds the class, and its members see
    the smallest ids among the class's members.

    Defined results: vectors that are null, of another length, all zero, or with a value that is null or not
    finite are not usable and have no row; null ids neither; a repeated row of one id counts once, and an id with
    several vectors is a neighbour once, at its best; ties go to the smaller id; fewer than k other vectors give
    fewer rows.
    """
    spark = df.sparkSession
    bytes_of = dim * 4

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = unit_vectors(batch.column(1), dim)
            blob = pa.Array.from_buffers(pa.binary(bytes_of), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), blob], ["id", "vec"])

    source = df.select(F.col(ident).cast("long").alias("id"), F.col(embedding).alias("embedding")).where(F.col("id").isNotNull() & (F.size("embedding") == dim))
    usable = stored(source.mapInArrow(units, "id long, vec binary"))
    # copies under several ids make classes; without any, every vector is its own class and no shuffle is needed
    copies = usable.groupBy(F.xxhash64("vec").alias("h")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).agg(F.count("*").alias("n"), F.max((F.col("lo") != F.col("hi")).cast("int")).alias("any")).first()
    if not copies["n"]:
        return spark.createDataFrame([], "id long, neighbour long, similarity float, rank int")
    members = None
    nodes = usable
    if copies["any"]:
        # the smallest id names the class, combined in the tasks; the copies of a vector are never gathered
        nodes = cut(usable.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"))
        members = cut(usable.distinct().join(nodes.select("vec", F.col("id").alias("class")), "vec").select("id", "class"))
    shards = int(max(1, min(MOST_SHARDS, round(copies["n"] / SHARD))))
    take = min(MOST_SAMPLE, MOST_BYTES // bytes_of, shards * SAMPLE_PER_SHARD)
    if copies["n"] <= 4 * take:
        drawn = nodes.orderBy(F.xxhash64("id"), "vec").limit(take).toPandas()
    else:
        bound = int((1 << 30) * 1.1 * take / copies["n"])
        drawn = nodes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(bound)).limit(2 * take).toPandas().sort_values(["id", "vec"])
    router = Router(np.frombuffer(b"".join(drawn["vec"]), np.float32).reshape(-1, dim), shards, copies["n"], k)
    if shards > 1:
        router.calibrate(true_neighbours(nodes, router.trial, dim, k))
    shards = router.total
    shared = spark.sparkContext.broadcast(router)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        for batch in batches:
            size = max(256, min(4096, (1 << 24) // len(router.centers)))
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                row, shard, role = router.route(np.frombuffer(b"".join(part.column(1).to_pylist()), np.float32).reshape(-1, dim))
                index = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(role), part.column(0).take(index), part.column(1).take(index)], ["shard", "role", "id", "vec"])

    placed = nodes.mapInArrow(assign, "shard int, role byte, id long, vec binary")
    # one task for each shard, whatever the hash of its number
    placed = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "role", "id")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            role, ids = table.column(1).to_numpy(), table.column(2).to_numpy()
            x = np.frombuffer(b"".join(table.column(3).to_pylist()), np.float32).reshape(-1, dim)
            inside = np.flatnonzero(role == 0)
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == ids[:-1]) & (role[1:] == role[:-1]) & (x[1:] == x[:-1]).all(axis=1)
            nodes_at = inside[~again[inside]]
            asks = np.flatnonzero(~again)
            if not len(nodes_at):
                found, near = np.full((len(asks), 1), -1), np.full((len(asks), 1), -2, np.float32)
            else:
                found, near = search_shard(ids[nodes_at], np.ascontiguousarray(x[nodes_at]), ids[asks], x[asks], k)
            row, col = np.nonzero(found >= 0)
            return pa.RecordBatch.from_arrays([pa.array(ids[asks][row]), pa.array(found[row, col].astype(np.int64)), pa.array(near[row, col])], ["id", "neighbour", "similarity"])

        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:]):
                if b <= a:
                    continue
                if at is not None and shard[a] != at:
                    yield answer(held)
                    held = []
                at = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield answer(held)

    links = placed.mapInArrow(solve, "id long, neighbour long, similarity float")
    if members is not None:
        links = _expand(links, members, k)
    return best_links(links, k)


def best_links(links: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each id; an id has at most k links from each shard that it asks."""
    pair = F.struct((-F.col("similarity")).alias("far"), F.col("neighbour").alias("neighbour"))
    one = links.groupBy("id").agg(F.array_sort(F.collect_list(pair)).alias("all"))
    first = F.aggregate("all", F.expr("cast(array() as array<struct<far: float, neighbour: bigint>>)"), lambda acc, p: F.when((F.size(acc) < k) & ~F.exists(acc, lambda q: q["neighbour"] == p["neighbour"]), F.concat(acc, F.array(p))).otherwise(acc))
    return one.select("id", F.posexplode(first).alias("_at", "_link")).select("id", F.col("_link.neighbour").alias("neighbour"), (-F.col("_link.far")).alias("similarity"), (F.col("_at") + 1).cast("int").alias("rank"))


def _expand(links: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Links of classes as links of members: every member sees the k + 1 smallest ids of each class near its own."""
    few = members.withColumn("_n", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("_n") <= k + 1).select("class", F.col("id").alias("member"))
    near = best_links(links, k).select(F.col("id").alias("class"), F.col("neighbour"), "similarity")
    own = members.select("class").distinct().select("class", F.col("class").alias("neighbour"), F.lit(1.0).cast("float").alias("similarity"))
    towards = near.unionByName(own).join(few.withColumnRenamed("class", "neighbour"), "neighbour").select("class", "member", "similarity")
    best = towards.withColumn("_n", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("similarity"), "member"))).where(F.col("_n") <= k + 1)
    return members.select("id", "class").join(best, "class").where(F.col("id") != F.col("member")).select("id", F.col("member").alias("neighbour"), "similarity")
