"""Hard negatives by threshold joins over an inverted index, in the manner of L2AP.

Vectors become integers and scores are integer inner products.  An anchor's positives are its best rows of the same label;
each positive opens a window of scores, and the window's best rows of other labels are the hard negatives.

Rows are packed into blocks, anchors into packs, and every pack meets every block of vectors of its length in a task of
its own.  There, dimensions are ordered from the heaviest on and dealt into segments.  For a threshold, a row is listed
only under the leading segments, up to the one from which the norm of all that follows times the anchors' norm cannot
reach the threshold; the rest of its dimensions is not indexed.  Partial scores are accumulated segment by segment, and a
row goes as soon as its partial score with every anchor plus the product of both remaining norms stays below the
threshold.  Whatever is left is scored exactly.  An anchor's threshold starts below the top of its lowest window and is
lowered until all its windows are full or nothing below is wanted.

Before all blocks are met, each pack meets one.  The last score of a window that this block fills bounds the window from
below, so the other blocks only look above it.  No window loses a row by that: the result is exact.

Edge cases: a null label, vec_id or vector, one without components, and one with null or non-finite components take no
part; vectors of another length than the anchor's are not its candidates; rows that share the anchor's vec_id are itself;
other rows that share a vec_id count each, and each anchor row has results of its own; components beyond ``LARGEST`` are
clipped so that scores fit a long; ties go to the smaller vec_id; a window of a positive below zero is empty; anchors
without positives and empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.session import materialise

POSITIVES, NEGATIVES = 5, 10
#: Hundredths of the positive's score between which its negatives lie.
LOW, HIGH = 30, 90
#: Components are multiplied by this and floored, and clipped.
SCALE, LARGEST = 256, 1 << 22
#: Bytes of a block's and of an anchor pack's vectors, at four a component.
BLOCK_BYTES, PACK_BYTES = 4 << 20, 1 << 20
#: Dimensions of a segment, and anchors that go through the index together.
SEGMENT, TOGETHER = 16, 128
#: First threshold as a share of what can be reached, factor of each lowering, and share below which everything is wanted.
START, LOWER, LEAST = 0.9, 0.8, 0.05
#: Pairs scored together.
PAIRS = 1 << 16
ANY = 1 << 62


@dataclass
class Index:
    """Segments of a block's vectors, with the norms of what follows each, and the lists of every threshold asked for."""

    exact: np.ndarray
    order: np.ndarray = field(init=False)
    segments: list[np.ndarray] = field(init=False)
    tails: np.ndarray = field(init=False)
    _lists: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.order = np.argsort(-(self.exact.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.segments = self.split(self.exact)
        self.tails = tails(self.segments)
        self.largest = float(self.tails[:, 0].max()) if len(self.exact) else 0.0

    def split(self, vectors: np.ndarray) -> list[np.ndarray]:
        ordered = vectors[:, self.order].astype(np.float32)
        return [np.ascontiguousarray(ordered[:, k : k + SEGMENT]) for k in range(0, ordered.shape[1], SEGMENT)]

    def lists(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows by the number of segments they are listed under, most first, and these numbers, for a norm that must be reached.

        Norms are rounded down to a few levels, so that a list serves many anchors; listing more is never wrong.
        """
        level = int(np.clip(np.floor(16 * least / self.largest), -1, 16)) if self.largest > 0 else -1
        if level not in self._lists:
            depth = (self.tails[:, :-1] >= level * self.largest / 16).sum(axis=1)
            rows = np.argsort(-depth, kind="stable")
            self._lists[level] = rows, depth[rows]
        return self._lists[level]

    def above(self, anchors: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs whose score is at least the anchor's limit."""
        parts = self.split(anchors)
        rest = tails(parts)
        norms = rest[:, 0]
        slack = 1e-5 * norms * self.largest + 0.5
        floor = (limits - slack).astype(np.float32)[:, None]
        least = np.min(np.where(norms > 0, floor[:, 0] / np.maximum(norms, 1e-9), np.where(floor[:, 0] <= 0, -np.inf, np.inf)))
        rows, depth = self.lists(least)
        acc = np.zeros((len(anchors), len(rows)), np.float32)
        found = []
        for s in range(len(self.segments) + 1):
            going = int(np.searchsorted(-depth, -s, "left"))  # rows listed under segment s too; the others are through
            if going < len(rows):
                bound = acc[:, going:] + np.outer(rest[:, s], self.tails[rows[going:], s]).astype(np.float32)
                a, r = np.nonzero(bound >= floor)
                found.append((a, rows[going:][r]))
                rows, depth, acc = rows[:going], depth[:going], acc[:, :going]
            if not len(rows):
                break
            acc = acc + parts[s] @ self.segments[s][rows].T
            if s + 1 < len(self.segments):
                stays = (acc + np.outer(rest[:, s + 1], self.tails[rows, s + 1]).astype(np.float32) >= floor).any(axis=0)
                if stays.mean() < 0.9:
                    rows, depth, acc = rows[stays], depth[stays], acc[:, stays]
        a, r = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        score = np.zeros(len(a), np.int64)
        for k in range(0, len(a), PAIRS):
            score[k : k + PAIRS] = np.einsum("ij,ij->i", anchors[a[k : k + PAIRS]], self.exact[r[k : k + PAIRS]])
        kept = score >= limits[a]
        return a[kept], r[kept], score[kept]


def tails(segments: list[np.ndarray]) -> np.ndarray:
    """Norm of each row from each segment on, and 0 after the last."""
    squares = np.stack([(s.astype(np.float64) ** 2).sum(axis=1) for s in segments], axis=1)
    after = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([after, np.zeros((len(after), 1))], axis=1))


def best_in_windows(index: Index, ids: np.ndarray, allowed, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """(anchor, window, vec_id, score) of the k best rows of each window; ``allowed(anchor, row)`` tells which pairs count.

    ``low`` and ``high`` are bounds by anchor and window; a window is empty where low is above high.
    """
    wanted = low <= high
    reach = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1)) * index.largest
    lowest = np.where(wanted, low, ANY).min(axis=1).astype(np.float64)
    limit = np.maximum(START * np.minimum(np.where(wanted, high, ANY).min(axis=1), reach), lowest)
    due = np.nonzero(wanted.any(axis=1) & (lowest <= reach * (1 + 1e-9)))[0]
    out = []
    while len(due):
        a, r, score = index.above(anchors[due], limit[due])
        counts = allowed(due[a], r)
        a, r, score = a[counts], r[counts], score[counts]
        open_windows, found = np.zeros(len(due), bool), []
        for w in range(low.shape[1]):
            inside = (score >= low[due[a], w]) & (score <= high[due[a], w])
            order = np.lexsort((ids[r[inside]], -score[inside], a[inside]))
            at, row, s = a[inside][order], r[inside][order], score[inside][order]
            first = np.searchsorted(at, np.arange(len(due)), "left")
            top = np.arange(len(at)) - first[at] < k
            found.append((at[top], np.full(int(top.sum()), w), ids[row[top]], s[top]))
            open_windows |= wanted[due, w] & (np.bincount(at, minlength=len(due)) < k) & (limit[due] > low[due, w])
        for at, w, vec, s in found:
            shut = ~open_windows[at]
            out.append((due[at[shut]], w[shut], vec[shut], s[shut]))
        due = due[open_windows]
        limit[due] = np.where(limit[due] * LOWER > LEAST * reach[due], np.maximum(limit[due] * LOWER, lowest[due]), lowest[due])
    return out


def usable(vectors: DataFrame, id_column: str, column: str, label: str | Column) -> DataFrame:
    """(id, label, vec, dims) of the rows that take part, components as integers."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(column).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0)).filter(~bad)
    whole = F.transform("vec", lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * SCALE))))
    return rows.select("id", "label", whole.cast("array<long>").alias("vec"), F.size("vec").alias("dims"))


PACKED = "pack long, dims int, n int, ids binary, labels binary, kind string, vectors binary"


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Packs of consecutive rows of one length, each of about ``size`` bytes at four a component; no shuffle, so no key can be hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def pack(dims: int) -> pa.RecordBatch:
            nonlocal number
            ids, labels, vectors = (np.concatenate([part[k] for part in held[dims]]) for k in range(3))
            kind = next(t for t in ("<i2", "<i4") if np.abs(vectors).max() <= np.iinfo(t).max)
            held[dims], number = [], number + 1
            values = [number, dims, len(ids), ids.tobytes(), labels.tobytes(), kind, vectors.astype(kind).tobytes()]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], [c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                vectors = part.column("vec").flatten().to_numpy().reshape(-1, d)
                most = max(1, size // (4 * d))
                for start in range(0, len(vectors), most):
                    piece = slice(start, start + most)
                    held.setdefault(d, []).append((part.column("id").to_numpy()[piece], part.column("label").to_numpy()[piece], vectors[piece]))
                    if sum(len(h[0]) for h in held[d]) >= most:
                        yield pack(d)
        for d in [d for d, parts in held.items() if parts]:
            yield pack(d)

    return rows.mapInArrow(run, PACKED)


def _unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[f"{prefix}{c}"], np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row[f"{prefix}vectors"], row[f"{prefix}kind"]).reshape(len(ids), -1).astype(np.int64)


MET = "pack long, at int, window int, anchor_id long, vec_id long, score long"


def meet(anchors: DataFrame, blocks: DataFrame, pairs: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best rows of each pair of pack and block for each window; ``same`` tells whether rows of the anchor's label are wanted or all others."""
    names = ["pack", "at", "window", "anchor_id", "vec_id", "score"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        (pack,), (block,) = left.to_pylist(), right.select(["ids", "labels", "kind", "vectors"]).to_pylist()
        a_ids, a_labels, anchors = _unpacked(pack)
        ids, labels, vectors = _unpacked(block)
        asked = pack["windows"]
        at, window, lo, hi = (np.array([x[c] for x in asked], np.int64) for c in ("at", "window", "low", "high"))
        low, high = np.full((len(a_ids), int(window.max()) + 1), 1, np.int64), np.zeros((len(a_ids), int(window.max()) + 1), np.int64)
        low[at, window], high[at, window] = lo, hi
        out = []
        by_label = [(np.nonzero(a_labels == x)[0], np.nonzero(labels == x)[0]) for x in np.unique(a_labels)] if same else [(np.arange(len(a_ids)), np.arange(len(ids)))]
        for who, rows in by_label:
            if not len(who) or not len(rows):
                continue
            index = Index(vectors[rows])
            for start in range(0, len(who), TOGETHER):
                some = who[start : start + TOGETHER]

                def allowed(a: np.ndarray, r: np.ndarray, some=some, rows=rows) -> np.ndarray:
                    return (a_ids[some[a]] != ids[rows[r]]) & (same | (a_labels[some[a]] != labels[rows[r]]))

                for a, w, vec, score in best_in_windows(index, ids[rows], allowed, anchors[some], low[some], high[some], k):
                    out.append((np.full(len(a), pack["pack"]), some[a], w, a_ids[some[a]], vec, score))
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(len(names))]
        return pa.table({n: pa.array(c).cast(t) for n, c, t in zip(names, columns, kinds)})

    asked = windows.groupBy("pack").agg(F.collect_list(F.struct("at", "window", "low", "high")).alias("windows"))  # as many as a pack has
    left = pairs.join(anchors.join(asked, "pack"), "pack").select("pack", "block", "ids", "labels", "kind", "vectors", "windows")
    others = blocks.select(F.col("pack").alias("b_block"), "ids", "labels", "kind", "vectors")
    right = pairs.select(F.col("pack").alias("b_pack"), F.col("block").alias("b_block")).join(others, "b_block")
    return left.groupBy("pack", "block").cogroup(right.groupBy("b_pack", "b_block")).applyInArrow(met, MET)


def best(anchors: DataFrame, blocks: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """``rank`` from 1, ``anchor_id``, ``vec_id`` and ``score`` of the k best of each window (pack, at, window)."""
    by = Window.partitionBy("pack", "at", "window").orderBy(F.desc("score"), "vec_id")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)

    pairs = materialise(anchors.select("dims", "pack").join(blocks.select("dims", F.col("pack").alias("block")), "dims").select("pack", "block"))
    pilot = materialise(pairs.groupBy("pack").agg(F.min_by("block", F.xxhash64("pack", "block")).alias("block")))
    first = materialise(meet(anchors, blocks, pilot, windows, k, same))
    filled = ranked(first).filter(F.col("rank") == k).select("pack", "at", "window", F.col("score").alias("_floor"))
    raised = windows.join(filled, ["pack", "at", "window"], "left").withColumn("low", F.greatest("low", F.coalesce("_floor", "low")))
    rest = meet(anchors, blocks, pairs.join(pilot, ["pack", "block"], "left_anti"), materialise(raised), k, same)
    return ranked(first.unionByName(rest))


def _hundredths(n: int) -> Column:
    """The floor of n hundredths of the positive's score."""
    return F.expr(f"({n} * positive_score - pmod({n} * positive_score, 100)) div 100")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: str | Column = "label", id_column: str = "vec_id", column: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores; ``is_anchor`` is a condition on ``id``."""
    rows = usable(vectors, id_column, column, label)
    blocks = materialise(packed(rows, BLOCK_BYTES))
    anchors = materialise(packed(rows.filter(is_anchor), PACK_BYTES))
    everything = anchors.select("pack", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    everything = everything.select("pack", "at", F.lit(0).alias("window"), F.lit(-ANY).alias("low"), F.lit(ANY).alias("high"))
    near = materialise(
        best(anchors, blocks, everything, positives, same=True).select(
            "pack", "at", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        )
    )
    low, high = -_hundredths(-LOW), _hundredths(HIGH)
    windows = near.select("pack", "at", "window", low.alias("low"), high.alias("high")).filter(F.col("low") <= F.col("high"))
    found = best(anchors, blocks, materialise(windows), negatives, same=False)
    return found.join(near, ["pack", "at", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
