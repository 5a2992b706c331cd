"""p4: the most similar other vectors of each vector, by one-bit codes of randomly rotated residuals.

Vectors get the nearest of some directions, which are fitted on bounded samples, and a shell by their angle to it; those beyond the last shell form
one pool, whatever direction is nearest. Cells that hold many vectors, and the pool, are split into blocks of at most about BLOCK. First each vector is
held against its own block, which bounds the cosine that others must reach. Then it goes only to blocks that can hold a vector so near: by the triangle
inequality of angles none that counts is left out. Of two blocks of one cell and shell, only the first goes to the second, and both are answered there.
Within a block a vector is a code of one bit a dimension of its rotated residual and three scalars; these estimate cosines with a bound of error, and
only pairs that the bound leaves open are computed again: by floats where it leaves many, and what they leave open in double precision. The bound is
EPSILON standard deviations of the estimate, so that less than one pair in a million is lost.

No batch or matrix grows with the table: what a worker holds is a block, QUERIES vectors, TILE pairs and ROWS rows to send.

Vectors that are null, all zero, not of DIM numbers, or that hold null, NaN or infinity take no part. Equal cosines go to the smaller vec_id.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engine.functions.partitions import free_shuffles, spread, written

DIM, NEAREST, LEAST = 128, 10, 0.72
#: Directions are fitted on at most SAMPLE vectors, and again on as many of those that lie FAR from all, up to FITS times and CELLS directions.
SAMPLE, CELLS, FITS, ROUNDS, COVER, FAR = 20_000, 4096, 4, 2, np.radians(40), np.radians(46)
BLOCK, QUERIES, EPSILON = 32_768, 65_536, 5.0
#: Pairs held against each other at once, rows in a batch that is sent on, and the share of open pairs from which codes don't pay.
TILE, ROWS, MANY = 1 << 21, 4096, 1 / 16
#: Shells end at these angles (degrees) from a cell's direction; beyond is the pool. A shell that ends farther out would be asked by vectors of any direction.
SHELLS = np.radians([32])
#: Cosines by floats and angles differ from the exact ones by less.
SLACK = 1e-5


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
    out = np.empty(flat.shape)
    for i in range(0, len(flat), ROWS):
        out[i : i + ROWS] = unit(flat[i : i + ROWS])
    return out


def leaders(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` unit vectors, so that each of the sample lies within COVER of one: the first that is far from all becomes one; then ROUNDS of means."""
    x = sample.astype(np.float32)
    left, chosen = np.arange(len(x)), []
    while len(left) and len(chosen) < most:
        chosen.append(left[0])
        left = left[x[left] @ x[left[0]] < np.cos(COVER)]
    c = x[chosen].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        sums = np.add.reduceat(x[order], first, axis=0)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = (sums / np.maximum(norm, 1e-6))[norm[:, 0] > 1e-6]
    return c


def rotation() -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(12).normal(size=(DIM, DIM)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


@dataclass
class Index:
    """cells: directions; rotation; blocks: a row for each cell and shell with its number, first block, blocks, and the least and greatest angle.

    The pool has the number after the last cell, and no direction. The angles are of the vectors that the blocks hold; none lies between those of empty ones.
    """

    cells: np.ndarray
    rotation: np.ndarray
    blocks: np.ndarray = None

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, shell and angle of unit vectors; in the pool the angle is that to the nearest direction."""
        cell, angle = np.zeros(len(v), np.int64), np.zeros(len(v))
        rows = max(1, TILE // len(self.cells))
        for i in range(0, len(v), rows):
            cos = v[i : i + rows].astype(np.float32) @ self.cells.T
            cell[i : i + rows] = cos.argmax(axis=1)
            angle[i : i + rows] = np.arccos(cos.max(axis=1).astype(np.float64).clip(-1, 1))
        shell = np.searchsorted(SHELLS, angle)
        return np.where(shell < len(SHELLS), cell, len(self.cells)), shell, angle

    def row(self, block: np.ndarray) -> np.ndarray:
        """The row of `blocks` that each block belongs to."""
        return np.searchsorted(self.blocks[:, 1], block, side="right") - 1

    def direction(self, block: int) -> np.ndarray:
        cell = int(self.blocks[self.row(np.array([block]))[0], 0])
        return self.cells[cell] if cell < len(self.cells) else np.zeros(DIM, np.float32)


@dataclass
class Codes:
    """Packed one-bit codes of a block's vectors and the scalars that correct the estimates."""

    bits: np.ndarray
    length: np.ndarray
    along: np.ndarray
    fit: np.ndarray

    @classmethod
    def of(cls, v: np.ndarray, direction: np.ndarray, turn: np.ndarray) -> Codes:
        parts = []
        for i in range(0, max(1, len(v)), ROWS):
            r = v[i : i + ROWS] - direction.astype(np.float64)
            length = np.sqrt((r * r).sum(axis=1))
            turned = (r @ turn) / np.maximum(length, 1e-12)[:, None]
            parts.append((np.packbits(turned > 0, axis=1), length, r @ direction, np.abs(turned).sum(axis=1) / DIM**0.5))
        return cls(*map(np.concatenate, zip(*parts, strict=True)))

    @cached_property
    def sides(self) -> np.ndarray:
        """A row for each vector; its product with a query's row is the most that the cosine can be, that of the last numbers the bound of the error."""
        fit = np.maximum(self.fit, 1e-6)
        out = np.empty((len(self.bits), DIM + 3), np.float32)
        out[:, :DIM] = np.unpackbits(self.bits, axis=1)
        out[:, :DIM] *= 2
        out[:, :DIM] -= 1
        out[:, :DIM] *= (self.length / fit / DIM**0.5).astype(np.float32)[:, None]
        out[:, DIM], out[:, DIM + 1] = self.along, 1
        out[:, DIM + 2] = self.length * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit * (EPSILON / (DIM - 1) ** 0.5)
        return out

    @staticmethod
    def asked(q: np.ndarray, direction: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """A row for each query, for the product with `sides`."""
        r = q - direction.astype(np.float64)
        return np.column_stack([r @ turn, np.ones(len(q)), q @ direction, np.sqrt((r * r).sum(axis=1))]).astype(np.float32)

    def estimate(self, q: np.ndarray, direction: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The estimated cosine of each query and vector, and the bound of its error."""
        asked = self.asked(q, direction, turn)
        error = asked[:, -1:] * self.sides[None, :, -1]
        return asked @ self.sides.T - error, error + np.float32(SLACK)


def narrowed(is_open: np.ndarray, floor: np.ndarray, most: np.ndarray, sure: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The open pairs that can reach the floors, and the floors, raised to the NEAREST-th of what is reached for certain where many pairs stay open."""
    is_open &= most >= floor[:, None] - np.float32(SLACK)
    rows = np.flatnonzero(np.count_nonzero(is_open, axis=1) > 4 * NEAREST) if np.count_nonzero(is_open) > 4 * NEAREST else ()
    if len(rows):
        floor = floor.copy()
        floor[rows] = np.maximum(floor[rows], np.partition(np.where(is_open[rows], sure(rows) - np.float32(SLACK), np.float32(-2)), -NEAREST, axis=1)[:, -NEAREST])
        is_open[rows] &= most[rows] >= floor[rows, None] - np.float32(SLACK)
    return is_open, floor


def best(r: np.ndarray, other: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The NEAREST of each row, in order of rows."""
    order = np.lexsort((other, -cos, r))
    r, other, cos = r[order], other[order], cos[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < NEAREST
    return r[keep], other[keep], cos[keep]


def joined(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *parts, strict=True))


def nearest(q: np.ndarray, ids_q: np.ndarray, v: np.ndarray, ids_v: np.ndarray, codes: Codes, direction: np.ndarray, turn: np.ndarray, least: np.ndarray, back: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row of q, id of v, cosine) of the NEAREST vectors of each query that reach `least`, by estimate and exact check.

    With `back`, what the vectors must reach, also (row of v, id of q, cosine) of the NEAREST queries of each vector.
    """
    found, returned, floats, coded = [], [], None, True
    rows = max(1, TILE // max(1, len(v)))
    lower = None if back is None else back.astype(np.float32)[None] - np.float32(SLACK)
    for i in range(0, len(q), rows):
        part, floor, wanted = q[i : i + rows], least[i : i + rows].astype(np.float32), None
        is_open = ids_q[i : i + rows, None] != ids_v[None, :]
        if coded:
            asked = codes.asked(part, direction, turn)
            most = asked @ codes.sides.T
            if back is not None:
                wanted = is_open & (most >= lower)
            is_open, floor = narrowed(is_open, floor, most, lambda x: most[x] - 2 * asked[x, -1:] * codes.sides[None, :, -1])  # noqa: B023
        if not coded or np.count_nonzero(is_open if wanted is None else is_open | wanted) > MANY * is_open.size:
            # the bound tells little here, so the rest of the block is asked by floats at once
            coded, floats = False, v.astype(np.float32) if floats is None else floats
            cos = part.astype(np.float32) @ floats.T
            if back is not None:
                wanted = (is_open if wanted is None else wanted) & (cos >= lower)
            is_open, floor = narrowed(is_open, floor, cos, lambda x: cos[x])  # noqa: B023
        if back is not None:
            is_open |= wanted
        r, c = np.divmod(np.flatnonzero(is_open), max(1, len(v)))
        exact = np.concatenate([np.zeros(0), *((part[r[j : j + ROWS]] * v[c[j : j + ROWS]]).sum(axis=1) for j in range(0, len(r), ROWS))]).round(12)
        keep = exact >= np.maximum(least[i + r], LEAST)
        found.append(best(r[keep] + i, ids_v[c[keep]], exact[keep]))
        if back is not None:
            keep = exact >= np.maximum(back[c], LEAST)
            returned.append((c[keep], ids_q[i + r[keep]], exact[keep]))
            if sum(len(x[0]) for x in returned) > TILE // 2:
                returned = [best(*joined(returned))]
    return joined(found) if back is None else (*joined(found), *best(*joined(returned)))


def locate(shared: Broadcast, vectors: bool) -> Callable:
    """Cell, shell and angle of each vector, with the vector or alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, shell, angle = shared.value.place(matrix(batch.column("vector")))
                place = [*map(pa.array, (cell.astype(np.int32), shell.astype(np.int32), angle))]
                names = ["cell", "shell", "angle"]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), *place], names=["vec_id", "vector", *names]) if vectors else pa.RecordBatch.from_arrays(place, names=names)

    return run


def lie_far(shared: Broadcast) -> Callable:
    """Those vectors that lie FAR from all directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, _, angle = shared.value.place(matrix(batch.column("vector")))
                yield batch.filter(pa.array(angle > FAR))

    return run


def own_block(shared: Broadcast) -> Callable:
    """Each vector of a block with the nearest others in it."""

    def run(table: pa.Table) -> pa.Table:
        index: Index = shared.value
        ids, v = table["vec_id"].to_numpy(), matrix(table["vector"])
        direction = index.direction(table["block"][0].as_py())
        r, other, cos = nearest(v, ids, v, ids, Codes.of(v, direction, index.rotation), direction, index.rotation, np.full(len(v), LEAST))
        ends = np.searchsorted(r, np.arange(len(v) + 1))
        full = ends[1:] - ends[:-1] >= NEAREST
        reach = np.where(full, cos[np.minimum(ends[1:], max(1, len(cos))) - 1] if len(cos) else LEAST, LEAST)
        offsets = pa.array(ends.astype(np.int32))
        return pa.table([table["vec_id"], table["vector"].combine_chunks(), table["block"], table["angle"], pa.array(reach), pa.ListArray.from_arrays(offsets, pa.array(other)), pa.ListArray.from_arrays(offsets, pa.array(cos))], names=["vec_id", "vector", "block", "angle", "reach", "others", "cosines"])

    return run


def spans(r: np.ndarray, times: np.ndarray, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and x repeated, and as many numbers from start on."""
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(r, times), np.repeat(x, times), np.repeat(start, times) + nth


def targets(index: Index, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, block, and whether the block is to answer for its own vectors too: the blocks, besides its own, that can hold vectors as near to a vector as it needs.

    Of its own cell and shell those are the blocks after its own; the vectors of earlier blocks are sent to its own block.
    """
    cell, start, count, low, high = index.blocks.T
    pool = len(index.cells)
    first = np.searchsorted(cell, np.arange(pool + 2))
    top = high[cell < pool].max(initial=0)
    step = int(np.clip(TILE // max(pool, int(count.sum())), 1, 512))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        cos = matrix(part.column("vector")).astype(np.float32) @ index.cells.T
        wide = np.arccos((part.column("reach").to_numpy() - 1e-9).clip(-1, 1)) + 1e-3
        # cells too far away whatever they hold; the pool is as near as the nearest direction allows
        r, c = np.nonzero(cos >= np.cos(np.minimum(np.pi, wide + top + 1e-3)).astype(np.float32)[:, None])
        every = np.arange(len(cos))
        angle = np.arccos(np.concatenate([cos[r, c], cos.max(axis=1)]).astype(np.float64).clip(-1, 1))
        r, c = np.concatenate([r, every]), np.concatenate([c, np.full(len(cos), pool)])
        r, angle, b = spans(r, first[c + 1] - first[c], angle, first[c])
        near = (angle - high[b] <= wide[r]) & (low[b] - angle <= wide[r])
        block = part.column("block").to_numpy()
        own = index.row(block)
        near &= b != own[r]
        r, b = np.concatenate([r[near], every]), np.concatenate([b[near], own])
        r, b, to = spans(r, count[b].astype(np.int64), b, start[b].astype(np.int64))
        both = b == own[r]
        keep = ~both | (to > block[r])
        yield r[keep] + at, to[keep], both[keep]


def load(shared: Broadcast) -> Callable:
    """How many vectors are sent to each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        n = np.zeros(int(index.blocks[:, 2].sum()), np.int64)
        for batch in batches:
            for _, block, _ in targets(index, batch):
                n += np.bincount(block, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["block", "n"])

    return run


def route(shared: Broadcast) -> Callable:
    """Each vector for each of the blocks it is sent to, in batches of ROWS however many those are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, block, both in targets(shared.value, batch):
                for i in range(0, len(r), ROWS):
                    taken = batch.select(["vec_id", "vector", "reach"]).take(pa.array(r[i : i + ROWS]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(block[i : i + ROWS].astype(np.int32)), pa.array(both[i : i + ROWS])], names=["vec_id", "vector", "reach", "block", "both"])

    return run


def other_block(shared: Broadcast) -> Callable:
    """The nearest vectors of a block for each of the vectors sent to it, and of those sent by its own cell and shell for each of the block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        index: Index = shared.value
        out = []

        if left.num_rows and right.num_rows:
            direction = index.direction(right["block"][0].as_py())
            v, others, reach = matrix(right["vector"]), right["vec_id"].to_numpy(), right["reach"].to_numpy()
            codes = Codes.of(v, direction, index.rotation)
            for back in (None, reach):
                some = left.filter(pc.invert(left["both"]) if back is None else left["both"])
                for i in range(0, some.num_rows, ROWS):
                    part = some.slice(i, ROWS)
                    ids = part["vec_id"].to_numpy()
                    r, other, cos, *returned = nearest(matrix(part["vector"]), ids, v, others, codes, direction, index.rotation, part["reach"].to_numpy(), back)
                    out.append((ids[r], other, cos))
                    if returned:
                        out.append((others[returned[0]], *returned[1:]))
        return pa.table([pa.array(x) for x in joined(out)], names=["vec_id", "other", "cos"])

    return run


def usable(table: DataFrame) -> DataFrame:
    return table.select("vec_id", "vector").where(
        (F.size("vector") == DIM)
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )


def similar(table: DataFrame) -> DataFrame:
    """vec_id, other, cos: of each vector the NEAREST others that reach LEAST."""
    context = table.sparkSession.sparkContext
    whole = spread(usable(table))
    fields = "vec_id long, vector array<float>"
    n = whole.select("vec_id").count()
    if not n:
        return table.sparkSession.createDataFrame([], "vec_id long, other long, cos double")

    def some(times: int, task: Callable | None = None) -> np.ndarray:
        """The first SAMPLE by hash, of about `times` as many for the task; the others are left out by their hash, not by a sort of the table."""
        rows = whole.where(F.xxhash64("vec_id") <= int(min(1, 1.2 * times * SAMPLE / n) * (2**64 - 1)) - 2**63)
        rows = rows.mapInArrow(task, fields) if task else rows
        return matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()["vector"])

    index = Index(leaders(some(1), CELLS), rotation())
    for _ in range(FITS if n > SAMPLE else 0):
        far = some(5, lie_far(context.broadcast(index)))
        if len(far) < 0.01 * min(n, SAMPLE) or len(index.cells) >= CELLS:
            break
        index.cells = np.concatenate([index.cells, leaders(far, CELLS - len(index.cells))])
    placed = context.broadcast(index)
    place = "cell int, shell int, angle double"
    # every cell and shell has a block, as equal angles may be told apart otherwise when the table is read again; so these counts needn't be exact
    counted = whole.mapInArrow(locate(placed, False), place).groupBy("cell", "shell").count().collect()
    count = {(r.cell, r.shell): -(-r["count"] // BLOCK) for r in counted}
    keys = [*itertools.product(range(len(index.cells)), range(len(SHELLS))), (len(index.cells), len(SHELLS))]
    counts = [count.get(x, 1) for x in keys]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).tolist()
    index.blocks = np.array([(c, start, k, np.inf, -np.inf) for (c, _), start, k in zip(keys, starts, counts, strict=True)])
    numbers = table.sparkSession.createDataFrame([(*x, start, k) for x, start, k in zip(keys, starts, counts, strict=True)], "cell int, shell int, start int, salts int")
    blocked = whole.mapInArrow(locate(placed, True), f"{fields}, {place}").join(F.broadcast(numbers), ["cell", "shell"])
    blocked = blocked.select("vec_id", "vector", "angle", (F.col("start") + F.pmod(F.xxhash64("vec_id"), F.col("salts"))).cast("int").alias("block"))
    own = blocked.groupBy("block").applyInArrow(own_block(context.broadcast(index)), f"{fields}, block int, angle double, reach double, others array<long>, cosines array<double>")
    own = written(own)
    del blocked
    free_shuffles(table.sparkSession)
    # one row a block
    for r in own.groupBy("block").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect():
        at = index.blocks[index.row(np.array([r.block]))[0]]
        at[3:] = min(at[3], r.low), max(at[4], r.high)
    shared = context.broadcast(index)
    asking = own.select("vec_id", "vector", "block", "reach")
    # a block that many vectors are sent to is held against QUERIES of them at a time; the loads are one number a block
    loads = asking.mapInArrow(load(shared), "block int, n long").groupBy("block").agg(F.sum("n").alias("n")).collect()
    shards = table.sparkSession.createDataFrame([(r.block, -(-r.n // QUERIES)) for r in loads], "block int, shards int")
    sent = asking.mapInArrow(route(shared), f"{fields}, reach double, block int, both boolean")
    queries = sent.join(F.broadcast(shards), "block").withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shards")).cast("int"))
    data = asking.join(F.broadcast(shards), "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    far = queries.select("vec_id", "vector", "reach", "both", "block", "shard").groupBy("block", "shard").cogroup(data.select("vec_id", "vector", "reach", "block", "shard").groupBy("block", "shard")).applyInArrow(other_block(shared), "vec_id long, other long, cos double")
    close = own.select("vec_id", F.explode(F.arrays_zip("others", "cosines")).alias("x")).select("vec_id", F.col("x.others").alias("other"), F.col("x.cosines").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cos"), "other"))
    return close.unionByName(far).withColumn("n", rank).where(F.col("n") <= NEAREST).drop("n")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar(spark.read.parquet(f"{sf_dir}/chunk_vectors.parquet"))
    return pairs.select(F.least("vec_id", "other").alias("vec_id_a"), F.greatest("vec_id", "other").alias("vec_id_b")).distinct()


P4_SQL = """
WITH v AS (
  SELECT vec_id, vector::DOUBLE[] AS x FROM chunk_vectors
  WHERE len(vector) = 128 AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.x, b.x), 12) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id
), best AS (SELECT a, b FROM pairs WHERE c >= 0.72 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 10)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM best
"""
