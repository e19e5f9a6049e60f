"""Byte-level BPE over whole columns of text, in numpy.

Texts are cut into pieces by the tokenizer's pattern. The distinct pieces of a batch are merged together:
pieces of similar length form a padded matrix of ids, and in every round each row merges its leftmost pair of
minimum rank, found in a hash table over pairs; rows without a mergeable pair leave the matrix.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from skein.plans.layout import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern of the byte_bpe_50k tokenizer (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
#: Pieces longer than this are rows of their own, whose cost does not grow with the square of the length.
LONG = 256
#: Merged pieces that a Python worker remembers; the memory is bounded, results do not depend on it.
REMEMBERED = 300_000


class BytePairs:
    """Ranks of one vocabulary file, with a hash table from pairs of ids to the id of their merge."""

    def __init__(self, lines: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
        self.width = max(self.ranks.values()) + 1
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = rank
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.probes = 0
        todo = np.arange(len(keys))
        while len(todo):
            slot = (self.slots(keys[todo]) + self.probes) & ((1 << self.bits) - 1)
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            mine = np.zeros(len(todo), bool)
            mine[first] = True
            take = mine & free
            self.keys[slot[take]], self.values[slot[take]] = keys[todo[take]], values[todo[take]]
            todo = todo[~take]
            self.probes += 1
        self.split = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they do not merge."""
        base, size = self.slots(keys), (1 << self.bits) - 1
        out = np.where(self.keys[base] == keys, self.values[base], NONE)
        open_ = np.flatnonzero((self.keys[base] != keys) & (self.keys[base] != -1))
        for step in range(1, self.probes):
            if not len(open_):
                break
            slot = (base[open_] + step) & size
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge_matrix(self, ids: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Merge the rows of a matrix padded with -1; returns the ids of each row."""
        done: list[np.ndarray] = [None] * len(ids)  # type: ignore[list-item]
        rows, columns = np.arange(len(ids)), np.arange(ids.shape[1])
        ranks = np.full((len(ids), max(ids.shape[1] - 1, 1)), NONE, np.int32)
        if ids.shape[1] > 1:
            valid = ids[:, 1:] >= 0
            ranks[valid] = self.lookup(ids[:, :-1][valid].astype(np.int64) * self.width + ids[:, 1:][valid])
        while len(rows):
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            over = best == NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done[rows[k]] = ids[k, : lengths[k]].copy()
                stay = ~over
                rows, ids, lengths, ranks, at, best = rows[stay], ids[stay], lengths[stay], ranks[stay], at[stay], best[stay]
                if not len(rows):
                    break
                width = int(lengths.max())
                ids, ranks, columns = ids[:, :width], ranks[:, : max(width - 1, 1)], columns[:width]
                each = np.arange(len(rows))
            source = np.minimum(columns[None] + (columns[None] > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ids[each, at] = best
            lengths = lengths - 1
            ids[each, lengths] = -1
            if ids.shape[1] > 1:
                pairs = columns[: ids.shape[1] - 1]
                move = np.minimum(pairs[None] + (pairs[None] >= at[:, None]), ranks.shape[1] - 1)
                ranks = np.take_along_axis(ranks, move, axis=1)
                ranks[each, lengths - 1] = NONE
                for shift in (-1, 0):
                    left = at + shift
                    ok = np.flatnonzero((left >= 0) & (left + 1 < lengths))
                    if len(ok):
                        a, b = ids[ok, left[ok]].astype(np.int64), ids[ok, left[ok] + 1]
                        ranks[ok, left[ok]] = self.lookup(a * self.width + b)
        return done

    def merge_long(self, piece: bytes) -> list[int]:
        """One long piece as a row of its own: a round merges all places of the least pair at once, from the left.

        No merge of a trained vocabulary makes a pair of lower rank than its own, so the order of merges is that of
        merge_matrix, but a round is paid for each rank that occurs and not for each merge.
        """
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].astype(np.int64)
        ranks = self.lookup(ids[:-1] * self.width + ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            # places that overlap, in runs of one repeated id: every other one merges
            each = np.arange(len(at))
            head = np.concatenate([[True], np.diff(at) > 1])
            at = at[(each - np.maximum.accumulate(np.where(head, each, 0))) % 2 == 0]
            ids[at] = best
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            now = at - np.arange(len(at))
            around = np.unique(np.concatenate([now - 1, now]))
            around = around[(around >= 0) & (around < len(ranks))]
            ranks[around] = self.lookup(ids[around] * self.width + ids[around + 1])
        return ids.tolist()

    def merge_pieces(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        coded = [p.encode() for p in pieces]
        sizes = np.array([len(b) for b in coded])
        out: dict[str, tuple[int, ...]] = {}
        low = 0
        for high in (1, 2, 3, 4, 6, 8, 11, 16, 24, 32, 48, 64, 96, 128, 192, LONG):
            of = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for start in range(0, len(of), max(64, 400_000 // high)):
                block = of[start : start + max(64, 400_000 // high)]
                flat = np.frombuffer(b"".join(coded[k] for k in block), np.uint8)
                ids = np.full((len(block), high), -1, np.int32)
                ids[np.arange(high)[None] < sizes[block][:, None]] = self.byte_ids[flat]
                for k, merged in zip(block, self.merge_matrix(ids, sizes[block].copy())):
                    out[pieces[k]] = tuple(merged.tolist())
        for k in np.flatnonzero(sizes > LONG):
            out[pieces[k]] = tuple(self.merge_long(coded[k]))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text; null and empty texts give an empty list."""
        cut = [self.split.findall(t) if t else [] for t in texts]
        fresh = list({p for c in cut for p in c} - self.known.keys())
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = list({p for c in cut for p in c})
        self.known.update(self.merge_pieces(fresh))
        ids = self.known
        return [list(chain.from_iterable([ids[p] for p in c])) for c in cut]


_tables: dict[int, BytePairs] = {}


def byte_pairs(lines: bytes) -> BytePairs:
    """One table for each Python worker and vocabulary."""
    key = hash(lines)
    if key not in _tables:
        _tables[key] = BytePairs(lines)
    return _tables[key]


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The driver's vocabulary file, as large as it is, sent along with the job."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def slices(batch: pa.RecordBatch, text: int, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a part hold about most_bytes, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    parts = np.cumsum(lengths) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode_texts(df: DataFrame, ident: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens.

    Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary
    text; rows are kept one for one, repeated ones too, and null ids stay null; an empty table gives no rows.
    The vocabulary file is read by the driver and sent to the executors.
    """
    lines = shipped(df.sparkSession, vocabulary)
    rows = spread(df.select(ident, text), ident)
    kind = rows.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_pairs(lines.value)
        for batch in batches:
            for part in slices(batch, 1):
                ids = tokens.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [ident, "ids"])

    return rows.mapInArrow(run, f"`{ident}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and n_tokens of each row's text (0 for null and empty ones)."""
    lines = shipped(df.sparkSession, vocabulary)
    rows = spread(df.select(*keep, text), *keep[:1])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_pairs(lines.value)
        for batch in batches:
            for part in slices(batch, len(keep)):
                counts = pa.array([len(x) for x in tokens.encode(part.column(len(keep)).to_pylist())], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], counts], [*keep, "n_tokens"])

    return rows.mapInArrow(run, f"{fields}, n_tokens long")
