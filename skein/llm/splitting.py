"""Cutting oversized texts at natural boundaries, by dynamic programming over boundary positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.segmentation import PARAGRAPH, behind, sentences
from skein.plans.layout import spread

#: Cost of a cut by the kind of its position.
KINDS = ("paragraph", "sentence", "clause", "word", "character")
PENALTY = (0.0, 1.0, 3.0, 6.0, 40.0)
#: Weight of the squared relative difference of a piece's size from the limit.
BALANCE = 1.0
CLAUSE = re.compile(r"(?<=[,;:，、；：،؛—–])\s*(?=\S)|(?<=[,;:])\s+(?=\S)|\n(?=\S)")
WORD = re.compile(r"(?<=\s)(?=\S)")


def blocks(text: str, limit: int) -> list[tuple[int, int, int]]:
    """Blocks (start, end, kind) of a text: its paragraphs; one longer than the limit gives its sentences instead."""
    out: list[tuple[int, int, int]] = []
    at = 0
    for m in [*PARAGRAPH.finditer(text), None]:
        end = m.start() if m else len(text)
        s, e = at, end
        while s < e and text[s].isspace():
            s += 1
        e = behind(text, s, e)
        if s < e:
            if e - s > limit:
                out += [(s + a, s + b, int(a > 0)) for a, b in sentences(text[s:e])]
            else:
                out.append((s, e, 0))
        at = m.end() if m else end
    return out


def meeting_points(found: list[tuple[int, int, int]], limit: int) -> np.ndarray:
    """Starts of the blocks at which all paths of the program over whole blocks meet.

    Its nodes are the blocks' starts and its edges the runs of blocks that a piece may hold: those of at most limit
    characters, or single blocks. first[k] is the first block of the longest run that ends with block k, which never
    falls; so a start that the run ending with its own block cannot pass is passed by no other, and lies on every path.
    """
    if len(found) < 2:
        return np.empty(0, np.int64)
    starts, ends = np.array([b[0] for b in found]), np.array([b[1] for b in found])
    each = np.arange(len(found))
    first = np.minimum(np.searchsorted(starts, ends - limit), each)
    return starts[(first == each) & (each > 0)]


def boundaries(text: str, found: list[tuple[int, int, int]], room: int) -> dict[int, int]:
    """Positions where a cut may lie, with the index of their kind; no gap between neighbours exceeds the room.

    Finer kinds are added only inside gaps that coarser ones leave wider than half the room.
    """
    spots = {s: kind for s, _, kind in found}
    spots |= {s + a: 1 for s, e, kind in found if kind == 0 and e - s > room // 2 for a, _ in sentences(text[s:e])[1:]}
    spots = {k: v for k, v in spots.items() if 0 < k < len(text)}

    def wide() -> list[tuple[int, int]]:
        edges = [0, *sorted(spots), len(text)]
        return [(a, b) for a, b in zip(edges, edges[1:]) if b - a > max(1, room // 2)]

    for kind, pattern in ((2, CLAUSE), (3, WORD)):
        for a, b in wide():
            spots |= {m.end(): kind for m in pattern.finditer(text, a, b) if a < m.end() < b}
    for a, b in wide():
        spots |= {k: 4 for k in range(a + max(1, room // 4), b, max(1, room // 4))}
    return spots


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(position, kind, needed) of the cuts of a text; the pieces run from a cut less the overlap to the next cut.

    The path of least cost from 0 to the text's end. Its nodes are boundaries, an edge is a piece of at most limit
    characters that jumps over no meeting point of the blocks; a cut before the overlap's length is a node only if it
    is such a point, and the piece behind it then starts at 0.
    """
    if len(text) <= limit:
        return []
    room = limit - overlap
    found = blocks(text, limit)
    must = {k for k in meeting_points(found, limit).tolist() if 0 < k < len(text)}
    spots = {k: kind for k, kind in boundaries(text, found, room).items() if k >= overlap}
    for k in must:
        spots.setdefault(k, 1)
    at = np.array([0, *sorted(spots), len(text)])
    kinds = [0, *(spots[k] for k in at[1:-1].tolist()), 0]
    price = np.array([0.0, *(PENALTY[k] for k in kinds[1:-1]), 0.0])
    meets = np.array([k in must for k in at.tolist()])
    begin = np.maximum(at - overlap, 0)
    best, origin = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    # the first node that an edge into each node may come from: within the limit, and no meeting point between
    lows = np.maximum(np.searchsorted(begin, at - limit), np.maximum.accumulate(np.concatenate([[0], np.where(meets, np.arange(len(at)), 0)[:-1]])))
    best[0] = 0.0
    for k in range(1, len(at)):
        low = int(lows[k])
        cost = best[low:k] + BALANCE * (1 - (at[k] - begin[low:k]) / limit) ** 2
        j = int(cost.argmin())
        best[k], origin[k] = cost[j] + price[k], low + j
    path, k = [], int(origin[-1])
    while k > 0:
        path.append((int(at[k]), kinds[k], bool(meets[k])))
        k = int(origin[k])
    return path[::-1]


def split_oversized(df: DataFrame, limits: DataFrame, keys: list[str], text: str = "text", strategy: str = "strategy", start: str | None = "start_pos", oversized: bool = False) -> DataFrame:
    """Pieces of all items, or of those above their limit only: keys, piece_no, text, start, end, source_start, cut_at, cut_kind, needed.

    limits has (strategy, max_chars, overlap_chars). An item longer than max_chars of its strategy comes out as
    pieces of at most max_chars that overlap by exactly overlap_chars (by all that lies before, where the first block
    is shorter and cannot share a piece with the next); the cuts minimise, over all boundary
    positions, the sum of their penalties and of the pieces' squared distance from the limit. A cut where two
    blocks cannot share a piece is always made and marked as needed. start and end are offsets in the item's
    text; source_start is start plus the item's own offset, null where that is null; cut_at is where the new text
    of a piece begins (null in a first piece).

    Defined results: items within their limit, of a null or unknown strategy or with an unusable limit (null or
    below 1) are one piece; null texts have no piece, empty ones a single empty piece; an overlap that is null or
    negative counts as 0 and one of more than half the limit as half; repeated limits of a strategy count once, the
    smallest; repeated items are cut each by itself.
    """
    bound = limits.groupBy(F.col("strategy").alias("_strategy")).agg(F.min(F.struct("max_chars", "overlap_chars")).alias("_limit"))
    own = F.col(start).cast("int") if start else F.lit(None).cast("int")
    items = df.select(*keys, F.col(text).alias("_text"), F.col(strategy).alias("_strategy"), own.alias("_start")).where(F.col("_text").isNotNull())
    # the limits are a few rows: Catalyst broadcasts them by their measured size, or joins by shuffle if they are not
    items = items.join(bound, "_strategy", "left").select(*keys, "_text", "_start", F.col("_limit.max_chars").cast("int").alias("_max"), F.col("_limit.overlap_chars").cast("int").alias("_over"))
    items = spread(items.where(F.length("_text") > F.col("_max")) if oversized else items, *keys)
    n = len(keys)
    names = [*keys, "piece_no", "text", "start", "end", "source_start", "cut_at", "cut_kind", "needed"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, columns = [], [[] for _ in range(8)]
            texts, starts, tops, overs = (batch.column(n + k).to_pylist() for k in range(4))
            for i, (t, own_start, top, over) in enumerate(zip(texts, starts, tops, overs)):
                over = min(max(over or 0, 0), (top or 0) // 2)
                made = cuts(t, top, over) if top and top >= 1 else []
                ends = [c[0] for c in made] + [len(t)]
                for p, (end, cut) in enumerate(zip(ends, [None, *made])):
                    begin = 0 if cut is None else max(0, cut[0] - over)
                    take.append(i)
                    row = (p, t[begin:end], begin, end, None if own_start is None else own_start + begin, cut and cut[0], cut and KINDS[cut[1]], cut is not None and cut[2])
                    for c, v in zip(columns, row):
                        c.append(v)
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            index = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in range(n)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    pieces = items.mapInArrow(run, f"{fields}, piece_no int, text string, start int, end int, source_start int, cut_at int, cut_kind string, needed boolean")
    return pieces


def needed_cuts(df: DataFrame, limits: DataFrame, keys: list[str], text: str = "text", strategy: str = "strategy") -> DataFrame:
    """The needed cuts of split_oversized, each once: keys and cut_at.

    They are the meeting points of the program's paths, whatever its costs are.
    """
    return split_oversized(df, limits, keys, text, strategy, None, oversized=True).where("needed").select(*keys, "cut_at").distinct()
