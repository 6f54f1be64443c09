"""Filling containers of fixed capacity along a space-filling curve (problem 8).

Each text becomes a hashed vector of its tokens, projected to DIMENSIONS numbers; the Hilbert key of
that point orders the collection so that neighbours on the curve have similar content. Texts are
range-sorted by the key and packed along the curve: in windows of WINDOW items, largest first into
the open container with the least sufficient room; at most OPEN_CONTAINERS with room left stay open for the
next window, so a container holds items of a short stretch of the curve. A text above the capacity fills
containers of its own and its rest is packed like any other. locality() measures how similar the texts of a
container are.

Plan shape: one pass to size the texts, whose small result (no text) is kept at a checkpoint because the
range sort samples it; one range shuffle of that; packing is a stream over each range with bounded
state. Ranges hold about RANGE_ITEMS items, so each loses a few containers' room at most.

Defined cases: text null or empty: 0 tokens, assigned to a container all the same. Id null: packed,
id stays null. Repeated rows are packed as often as they occur. Ties on the curve go by id, then
size. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from siftline.common import checkpoint
from siftline.llm.tokens import RANKS, encode
from siftline.llm.util import arrow_map, spread

DIMENSIONS, BITS, HASHED = 4, 12, 256
#: Items packed at a time, and containers that stay open between windows: more fill better, fewer keep neighbours together.
WINDOW = 64
OPEN_CONTAINERS = 48
RANGE_ITEMS = 50_000
OUT = "capacity int, container long, position int, id long, piece int, token_start long, n_tokens int"


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n x d, each below 2**bits), by bitwise transposition for all points at once."""
    x = points.astype(np.uint64).T.copy()
    d = len(x)
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest level down
        p, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(d):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((HASHED, DIMENSIONS))


def token_vectors(token_lists: list[list[int]]) -> np.ndarray:
    """Unit vectors of signed hashed token counts, damped; zero for no tokens."""
    v = np.zeros((len(token_lists), HASHED))
    for k, tokens in enumerate(token_lists):
        if tokens:
            ids, n = np.unique(np.asarray(tokens, dtype=np.uint64), return_counts=True)
            h = ids * np.uint64(0x9E3779B97F4A7C15)
            sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(float)
            np.add.at(v[k], (h >> np.uint64(56)).astype(int) % HASHED, sign * np.sqrt(n))
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def curve_keys(token_lists: list[list[int]]) -> np.ndarray:
    """Hilbert key of each text: its vector projected and cut at normal quantiles."""
    z = token_vectors(token_lists) @ _projection()  # about standard normal in each dimension
    cell = (1 / (1 + np.exp(-1.702 * z)) * (1 << BITS)).astype(int)
    return hilbert_keys(np.clip(cell, 0, (1 << BITS) - 1))


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """id, n_tokens, curve of each text."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [encode(t, ranks) for t in batch.column(1).to_pylist()]
        n = pa.array([len(t) for t in tokens], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(curve_keys(tokens))], ["id", "n_tokens", "curve"])

    return arrow_map(spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))), measure, "id long, n_tokens long, curve long")


class Packer:
    """Containers of one capacity over a stream of items; best fit, with a bounded number kept open."""

    def __init__(self, capacity: int, first_container: int, most_open: int = OPEN_CONTAINERS):
        self.capacity, self.next, self.most_open = capacity, first_container, most_open
        self.free: dict[int, list[tuple[int, int]]] = {}  # room -> (container, items in it), newest last
        self.rooms = 0  # bit r is set if some open container has room r
        self.n_open = 0

    def _take(self, room: int) -> tuple[int, int]:
        stack = self.free[room]
        top = stack.pop()
        if not stack:
            del self.free[room]
            self.rooms &= ~(1 << room)
        self.n_open -= 1
        return top

    def _put(self, room: int, container: tuple[int, int]) -> None:
        if room:
            self.free.setdefault(room, []).append(container)
            self.rooms |= 1 << room
            self.n_open += 1

    def place(self, size: int) -> tuple[int, int]:
        """(container, position) of an item of at most the capacity."""
        fits = self.rooms >> size << size
        if fits:
            room = (fits & -fits).bit_length() - 1
            container, held = self._take(room)
        else:
            room, container, held = self.capacity, self.next, 0
            self.next += 1
        self._put(room - size, (container, held + 1))
        return container, held

    def end_window(self) -> None:
        """Close the fullest containers beyond the bound: they can take least."""
        while self.n_open > self.most_open:
            self._take((self.rooms & -self.rooms).bit_length() - 1)


def pack(df: DataFrame, capacities: list[int], id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, range_items: int = RANGE_ITEMS, window: int = WINDOW, most_open: int = OPEN_CONTAINERS, shuffled: bool = False) -> DataFrame:
    """capacity, container, position, id, piece, token_start, n_tokens: where each text, or piece of an oversized one, lies. shuffled: in a random order instead of the curve's, for comparison."""
    if any(c < 1 for c in capacities):
        raise ValueError("capacities must be positive")
    items = checkpoint(sized(df, id_col, text_col, ranks))
    if shuffled:
        items = items.withColumn("curve", F.xxhash64("id", "n_tokens"))
    ranges = max(1, -(-items.count() // range_items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = TaskContext.get().partitionId() << 40
        packers = [Packer(c, start, most_open) for c in capacities]
        for batch in batches:
            for at in range(0, batch.num_rows, window):
                items_now = batch.slice(at, window)
                ids, sizes = items_now.column("id").to_pylist(), items_now.column("n_tokens").to_pylist()
                for packer in packers:
                    pieces = [(min(size - s, packer.capacity), k, s) for k, size in enumerate(sizes) for s in range(0, max(size, 1), packer.capacity)]
                    pieces.sort(key=lambda x: (-x[0], x[1]))
                    rows = [(packer.capacity, *packer.place(n), ids[k], s // packer.capacity, s, n) for n, k, s in pieces]
                    packer.end_window()
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return items.repartitionByRange(ranges, "curve", "id").sortWithinPartitions("curve", "id", "n_tokens").mapInArrow(run, OUT)


def locality(packed: DataFrame, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """capacity, containers, fill, similarity: the share of room used, and the mean cosine of two texts of one container (whole texts only).

    From sums per container and vector component: the squares of the summed unit vectors count every pair twice and each text once.
    """

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = token_vectors([encode(t, ranks) for t in batch.column(1).to_pylist()]).astype(np.float32)
        at, parts = np.nonzero(v)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(parts.astype(np.int32)), pa.array(v[at, parts])], ["id", "part", "x"])

    vectors = arrow_map(spread(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).dropDuplicates(["id"])), measure, "id long, part int, x float")
    counted = packed.groupBy("capacity", "container").agg(F.sum("n_tokens").alias("held"), F.max("piece").alias("pieces"))
    whole = packed.where("piece = 0 and n_tokens > 0 and id is not null").join(counted.where("pieces = 0"), ["capacity", "container"]).select("capacity", "container", "id")
    sums = whole.join(vectors, "id").groupBy("capacity", "container", "part").agg(F.sum("x").alias("x"))
    squares = sums.groupBy("capacity", "container").agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    pairs = whole.groupBy("capacity", "container").agg(F.count("*").alias("n")).join(squares, ["capacity", "container"])
    similar = pairs.groupBy("capacity").agg((F.sum(F.col("square") - F.col("n")) / F.sum(F.col("n") * (F.col("n") - 1))).alias("similarity"))
    filled = counted.groupBy("capacity").agg(F.count("*").alias("containers"), (F.sum("held") / F.sum("capacity")).alias("fill"))
    return filled.join(F.broadcast(similar), "capacity", "left")  # one row per capacity


_NAMES = [c.split()[0] for c in OUT.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64()}[c.split()[1]] for c in OUT.split(", ")]
