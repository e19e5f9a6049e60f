"""Records that share most of their words: exact multiset similarity over candidates from hashed bands.

A text is the multiset of its words; its k-th occurrence of a word is one element. Texts with equal multisets are
one class, named by a 64-bit hash of the multiset. Classes that agree in a band of minimum hashes meet in a bucket;
buckets are compared in tiles, exactly, by exclusive-or and bit counts of fixed-width bitmaps of the elements. The
bit difference never exceeds the true difference, so within a bucket no pair is lost, and blocks of tiles (or rows)
whose bit counts alone differ beyond the radius are skipped. What passes is decided by the true common words.

With ROWS hashes in each of BANDS bands a pair of similarity s shares a bucket with probability
1 - (1 - s ** ROWS) ** BANDS: at the default 0.9997 at s = 0.7 and 0.999998 at s = 0.75.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.layout import cut, release, spread, stored

BANDS, ROWS = 64, 6
#: 64-bit words of a bitmap.
BITMAP = 4
#: Rows of a tile: buckets above it are split into pairs of tiles, each its own group. Tiles of very large buckets
#: grow with the square root of the bucket, so that its rows are copied less often.
TILE = 2048
#: Entries that a slice of the keys should hold, that a task packs at once, and that it holds of one slice.
SLICE, PACKED, HELD = 1 << 16, 1 << 21, 1 << 20
#: Bits of a band key beyond those that number the records: chance meetings stay below 2 ** -SPARE of the entries.
SPARE = 8
#: Up to this size, buckets of a batch are compared together, neighbour by neighbour.
SMALL = 48
WORD = re.compile(r"[^\W_]+")
SALTS = np.random.default_rng(20240229).integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
SHIFTS = np.random.default_rng(20240301).integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


class Hashes(dict):
    """64-bit hashes of words; what a worker remembers is bounded, and results do not depend on it."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        out = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return out


_hashes = Hashes()


def words(text: str) -> list[str]:
    """The longest runs of letters and digits after NFKC and lower-casing."""
    return WORD.findall(text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower())


def elements(found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (word, occurrence) of several texts, one after the other and sorted in each, and where each begins."""
    sizes = np.array([len(w) for w in found], np.int64)
    flat = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(found)), np.uint64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    spans = list(zip(starts.tolist(), (starts + sizes).tolist()))
    for a, b in spans:
        flat[a:b].sort()
    again = np.zeros(len(flat), bool)
    again[1:] = flat[1:] == flat[:-1]
    again[starts] = False
    if again.any():
        # the k-th repetition of a word is an element of its own
        at = np.arange(len(flat))
        nth = (at - np.maximum.accumulate(np.where(again, 0, at)))[again].astype(np.uint64)
        flat[again] = flat[again] * np.uint64(0x9E3779B97F4A7C15) + nth * np.uint64(0xD6E8FEB86659FD93)
        for a, b in spans:
            flat[a:b].sort()
    return flat, starts


def band_keys(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band keys (rows x BANDS) of element sets that lie one after the other in flat."""
    lows = np.empty((BANDS * ROWS, len(starts)), np.uint32)
    short = (flat >> np.uint64(32)).astype(np.uint32)
    mixed = np.empty_like(short)
    for k in range(BANDS * ROWS):
        np.multiply(np.add(short, SHIFTS[k], out=mixed), SALTS[k], out=mixed)
        np.minimum.reduceat(mixed, starts, out=lows[k])
    key = np.zeros((BANDS, len(starts)), np.uint64)
    for k in range(ROWS):
        key = (key ^ lows[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return (key + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)).T


def bitmaps(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(starts), BITMAP), np.uint64)
    spot = (flat * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - (BITMAP * 64 - 1).bit_length())
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
    np.bitwise_or.at(out, (row, (spot >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (spot & np.uint64(63)))
    return out


def described(df: DataFrame, ident: str, text: str, least_words: int) -> DataFrame:
    """(id, class, n, elements, bits) of the rows with enough words."""
    rows = spread(df.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull()), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                found = [words(t) for t in part.column(1).to_pylist()]
                keep = [i for i, w in enumerate(found) if len(w) >= max(1, least_words)]
                if not keep:
                    continue
                flat, starts = elements([found[i] for i in keep])
                offsets = np.append(starts, len(flat))
                named = np.array([int.from_bytes(hashlib.blake2b(flat[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(offsets, offsets[1:])], np.int64)
                bits = bitmaps(flat, starts)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(named), pa.array(np.diff(offsets), pa.int32()), lists(offsets, flat), lists(np.arange(0, bits.size + 1, BITMAP), bits)], ["id", "class", "n", "elements", "bits"])

    return rows.mapInArrow(run, "id long, class long, n int, elements array<long>, bits array<long>")


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.reshape(-1).view(np.int64)))


class Slices:
    """How band keys (the band's number above `width` bits) are cut into slices of about SLICE entries, to travel packed.

    A packed slice holds the keys' lower bits, sorted, and behind them the classes.
    """

    def __init__(self, records: int) -> None:
        self.width = min(50, max(24, records.bit_length() + SPARE))
        total = self.width + (BANDS - 1).bit_length()
        self.shift = min(total, max(total - 30, total - (records * BANDS // SLICE).bit_length()))
        self.low = np.dtype(np.uint32 if self.shift <= 32 else np.uint64)

    def pack(self, key: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(key)
        key, classes = key[order], classes[order]
        of = (key >> np.uint64(self.shift)).astype(np.int32)
        low = (key & np.uint64((1 << self.shift) - 1)).astype(self.low)
        edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
        blobs = [low[a:b].tobytes() + classes[a:b].tobytes() for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(of[edges[:-1]]), pa.array(blobs, pa.binary())], ["slice", "blob"])

    def unpack(self, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(blob) // (self.low.itemsize + 8)
        return np.frombuffer(blob, self.low, n), np.frombuffer(blob, np.int64, n, n * self.low.itemsize)

    def entries(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed slices of the band keys of (class, elements); copies in a batch count once."""
        keys, classes, count = [], [], 0
        for batch in batches:
            _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            for k in range(0, len(first), 2000):
                part = batch.take(pa.array(first[k : k + 2000]))
                sizes = part.column(1).value_lengths().to_numpy()
                flat = part.column(1).flatten().to_numpy().view(np.uint64)
                key = band_keys(flat, np.cumsum(sizes) - sizes) >> np.uint64(64 - self.width)
                keys.append((key | np.arange(BANDS, dtype=np.uint64)[None] << np.uint64(self.width)).reshape(-1))
                classes.append(np.repeat(part.column(0).to_numpy(), BANDS))
                count += len(keys[-1])
                if count >= PACKED:
                    yield self.pack(np.concatenate(keys), np.concatenate(classes))
                    keys, classes, count = [], [], 0
        if keys:
            yield self.pack(np.concatenate(keys), np.concatenate(classes))

    def meetings(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, class, large) of packed slices sorted by slice: the entries in buckets of two classes or more.

        A bucket of more than TILE classes is large. Where a slice grows beyond HELD entries its large buckets pass on
        at once, so that a class may come out of them more than once; what is held is bounded by the other buckets.
        """
        at: int | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count, passed = 0, np.empty(0, self.low)

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count, passed
            low, classes = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((classes, low))
            low, classes = low[order], classes[order]
            fresh = np.concatenate([[True], (low[1:] != low[:-1]) | (classes[1:] != classes[:-1])])
            low, classes = low[fresh], classes[fresh]
            sizes = np.diff(np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1], [True]])))
            sizes = np.repeat(sizes, sizes)
            large = (sizes > TILE) | np.isin(low, passed)
            out = large | ((sizes > 1) & last)
            if out.any():
                key = low[out].astype(np.int64) | np.int64(at << self.shift)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(classes[out]), pa.array(large[out])], ["key", "class", "large"])
            passed = np.empty(0, self.low) if last else np.union1d(passed, low[large])
            held = [] if last else [(low[~large], classes[~large])]
            count = 0 if last else len(held[0][0])

        for batch in batches:
            for of, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if of != at and held:
                    yield from settle(True)
                at = of
                held.append(self.unpack(blob))
                count += len(held[-1][0])
                if count > HELD:
                    yield from settle(False)
        if held:
            yield from settle(True)


def compare(similarity: float):
    """A function over Arrow batches (cell, side, class, n, bits) sorted by cell: candidate pairs of classes.

    Rows of a cell on sides 0 and 1 are compared across, rows of side 2 among themselves. At most one cell, of two
    tiles, is held over from a batch to the next.
    """
    share = (1 - similarity) / (1 + similarity)

    def pairs_of(classes, n, count, bits, a, b) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tile of row numbers a against b."""
        a, b = a[np.argsort(count[a], kind="stable")], b[np.argsort(count[b], kind="stable")]
        for i in range(0, len(a), 256):
            one = a[i : i + 256]
            top = share * (int(n[one].max()) + int(n[b].max()))
            near = b[np.searchsorted(count[b], count[one[0]] - top) : np.searchsorted(count[b], count[one[-1]] + top, side="right")]
            for j in range(0, len(near), 1024):
                two = near[j : j + 1024]
                apart = np.zeros((len(one), len(two)), np.uint16)
                for w in range(BITMAP):
                    apart += np.bitwise_count(bits[one, w][:, None] ^ bits[two, w][None])
                x, y = np.nonzero(apart <= share * (n[one][:, None] + n[two][None]) + 1e-9)
                if len(x):
                    yield one[x], two[y]

    def found(cell, side, classes, n, bits) -> tuple[np.ndarray, np.ndarray]:
        count = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        sizes = np.diff(edges)
        out_a, out_b = [], []
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = (sizes <= SMALL) & (side[edges[:-1]] == 2)
        last = edges[1:][group] - 1
        rows = np.flatnonzero(small[group])
        for k in range(1, int(sizes[small].max(initial=1))):
            rows = rows[rows + k <= last[rows]]
            other = rows + k
            limit = share * (n[rows] + n[other]) + 1e-9
            near = np.abs(count[rows] - count[other]) <= limit
            x, y, limit = rows[near], other[near], limit[near]
            hit = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= limit
            out_a.append(x[hit])
            out_b.append(y[hit])
        for g in np.flatnonzero(~small):
            of = np.arange(edges[g], edges[g + 1])
            a, b = (of[side[of] == 0], of[side[of] == 1]) if side[of[0]] != 2 else (of, of)
            if len(a) and len(b):
                for x, y in pairs_of(classes, n, count, bits, a, b):
                    out_a.append(x)
                    out_b.append(y)
        if not out_a:
            return classes[:0], classes[:0]
        a, b = classes[np.concatenate(out_a)], classes[np.concatenate(out_b)]
        keep = a != b
        both = np.unique(np.stack([np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])], axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            bits = batch.column(4).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITMAP)
            parts = [*own, bits]
            if held is not None:
                parts = [np.concatenate([x, y]) for x, y in zip(held, parts)]
            cell = parts[0]
            whole = int(np.searchsorted(cell, cell[-1]))
            held = [x[whole:] for x in parts]
            if whole:
                a, b = found(*(x[:whole] for x in parts))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if held is not None:
            a, b = found(*held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def class_links(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: pairs of similar classes, from the stored table of described rows.

    Only band keys and class names of all records are shuffled; bitmaps follow for the classes that meet another one,
    elements for those in a candidate pair. Equal texts are merged before, so copies make no hot bucket.
    """
    slices = Slices(rows.count())
    packed = rows.select("class", "elements").mapInArrow(slices.entries, "slice int, blob binary")
    met = stored(packed.repartition("slice").sortWithinPartitions("slice").mapInArrow(slices.meetings, "key long, class long, large boolean"))
    one = rows.groupBy("class").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    small = met.where("not large").join(one, "class").select(F.col("key").alias("cell"), F.lit(2).alias("side"), "class", "n", "bits")
    # a large bucket is counted, key by key in the tasks first, and split into tiles; every two of them make a cell
    large = met.where("large").distinct()
    side = F.greatest(F.lit(TILE), F.sqrt("count") * 8)
    counts = large.groupBy("key").agg(F.count("*").alias("count")).select("key", F.ceil(F.col("count") / side).cast("int").alias("tiles"))
    tiled = large.join(counts, "key").join(one, "class").withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("tile")).alias("x"), F.greatest(k, F.col("tile")).alias("y")))
    cells = tiled.withColumn("at", F.explode(others)).select(
        F.xxhash64("key", "at.x", "at.y").alias("cell"), F.when(F.col("at.x") == F.col("at.y"), 2).when(F.col("tile") == F.col("at.x"), 0).otherwise(1).alias("side"), "class", "n", "bits")
    compared = [part.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare(similarity), "a long, b long") for part in (small, cells)]
    candidates = stored(compared[0].unionByName(compared[1]).distinct())
    asked = candidates.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    whole = rows.select("class", "n", "elements").join(asked, "class", "left_semi").groupBy("class").agg(F.first("n").alias("n"), F.first("elements").alias("elements"))
    a = whole.select(F.col("class").alias("a"), F.col("elements").alias("_ea"), F.col("n").alias("_na"))
    b = whole.select(F.col("class").alias("b"), F.col("elements").alias("_eb"), F.col("n").alias("_nb"))
    common = F.size(F.array_intersect("_ea", "_eb"))
    # common / (na + nb - common) >= similarity, in a form without division
    return candidates.join(a, "a").join(b, "b").where(common * (1 + F.lit(float(similarity))) >= F.lit(float(similarity)) * (F.col("_na") + F.col("_nb")) - 1e-9).select("a", "b")


def near_duplicate_pairs(df: DataFrame, ident: str, text: str, least_words: int = 8, similarity: float = 0.7) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of records whose common words are at least `similarity` of all their words.

    Defined results: null ids, null texts and texts of fewer than least_words words take no part; a repeated id
    makes a pair once, if any of its texts does, and none with itself; exact copies are pairs; ids are longs.
    """
    rows = stored(described(df, ident, text, least_words))
    links, members = class_links(rows, similarity), rows.select("id", "class").distinct()
    left, right = members.select(F.col("id").alias("_x"), F.col("class").alias("a")), members.select(F.col("id").alias("_y"), F.col("class").alias("b"))
    across = links.join(left, "a").join(right, "b").select("_x", "_y")
    # the pairs of equal texts: as many as this form of the result must have
    shared = members.groupBy("class").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("class").alias("a"))
    several = left.join(shared, "a", "left_semi")
    copies = several.join(several.withColumnRenamed("_x", "_y"), "a").where("_x < _y").select("_x", "_y")
    return across.unionByName(copies).where("_x <> _y").select(F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b")).distinct()


def smallest_linked(links: DataFrame, rounds: int = 1000) -> DataFrame:
    """(class, group): the smallest class that the links (a, b) lead to, for every class with a link.

    Each round a class, and the class that its label names, take the smallest label of a label among its neighbours
    (FastSV): whole trees are hooked, so that chains take rounds by the logarithm of their length. Labels only fall,
    and once none does all linked classes agree; that many rounds are never needed, and going beyond them raises.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = label_file = cut(both.select(F.col("a").alias("class")).distinct().withColumn("group", F.col("class")))
    for _ in range(rounds):
        named = label.join(label.select(F.col("class").alias("group"), F.col("group").alias("_grand")), "group").select("class", "group", "_grand")
        near = both.join(named.select(F.col("class").alias("b"), "_grand"), "b").groupBy(F.col("a").alias("class")).agg(F.min("_grand").alias("_near"))
        low = named.join(near, "class").select("class", "group", F.least("_grand", "_near").alias("_low"))
        own = low.select("class", F.col("group").alias("_was"), F.least("group", "_low").alias("_low"))
        hooked = low.select(F.col("group").alias("class"), F.lit(None).cast("long").alias("_was"), "_low")
        fresh = cut(own.unionByName(hooked).groupBy("class").agg(F.min("_low").alias("group"), F.min("_was").alias("_was")))
        release(label_file)
        label, label_file = fresh.select("class", "group"), fresh
        if fresh.where("group < _was").isEmpty():
            return label
    raise RuntimeError(f"groups are not settled after {rounds} rounds")


def near_duplicate_groups(df: DataFrame, ident: str, text: str, least_words: int = 8, similarity: float = 0.7, rounds: int = 1000) -> DataFrame:
    """(id, class, links, group): the class of equal word multisets, its number of similar classes, and the group.

    class is the smallest id with the multiset. group is the smallest class that similar classes lead to, found by
    passing minima along links until nothing changes (see smallest_linked); each round is written to the shared
    folder. Records that take no part (see near_duplicate_pairs) have no row; an id with several texts has a row for
    each of its classes. No pairs are made of equal texts, however many there are.
    """
    rows = stored(described(df, ident, text, least_words))
    named = rows.groupBy("class").agg(F.min("id").alias("_c"))
    links = class_links(rows, similarity)
    links = links.join(named.select(F.col("class").alias("a"), F.col("_c").alias("_a")), "a").join(named.select(F.col("class").alias("b"), F.col("_c").alias("_b")), "b")
    # two classes may have the same smallest id, if that id has several texts
    links = cut(links.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    label = smallest_linked(links.where("a <> b"), rounds)
    degree = links.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    members = rows.select("id", F.col("class").alias("_h")).distinct().join(named.select(F.col("class").alias("_h"), F.col("_c").alias("class")), "_h").select("id", "class").distinct()
    return members.join(label, "class", "left").join(degree, "class", "left").select("id", "class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "class").alias("group"))
