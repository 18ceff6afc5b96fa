"""The order that a graph's second eigenvector gives, by mat-vecs over its edge table."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import both_ways
from .staging import staged

_PARTS = ("x", "r", "p", "ax", "ar", "ap")
#: Nodes of a block (at most _MOST, also in sparse graphs), edges of a row of a cell, blocks whose sums a task holds at once.
_NODES, _MOST, _EDGES, _OPEN = 4096, 1 << 17, 1 << 17, 64


def _bytes(of: list[np.ndarray]) -> pa.Array:
    """One row for each array, as bytes: these go between Spark and Python without a look at each number."""
    return pa.array([np.ascontiguousarray(m).tobytes() for m in of], pa.binary())


def _floats(value: pa.Scalar, b: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.float64).reshape(-1, b)


def _packed(count: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b, w and their blocks g, h) as tables in bytes, one for each cell of some edges; a is of the lesser block."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        g, h = (table[c].to_numpy().astype(np.int64) for c in "gh")
        cell, turned = np.minimum(g, h) * count + np.maximum(g, h), pa.array(g > h)
        order = np.argsort(cell, kind="stable")
        a, b = (table[c].chunk(0) for c in "ab")
        edges = pa.record_batch([pc.if_else(turned, b, a), pc.if_else(turned, a, b), table["w"].chunk(0)], names=["a", "b", "w"]).take(pa.array(order))
        cell = cell[order]
        begin = np.flatnonzero(np.r_[True, np.diff(cell) != 0])
        blobs = []
        for lo, hi in zip(begin, np.r_[begin[1:], len(cell)], strict=True):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, edges.schema) as stream:
                stream.write_batch(edges.slice(lo, hi - lo))
            blobs.append(out.getvalue().to_pybytes())
        return pa.record_batch([pa.array(cell[begin]), pa.array(blobs, pa.binary())], names=["cell", "edges"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 8 * _EDGES:
            yield rows(held)
            held, n = [], 0
    if n:
        yield rows(held)


def _cells(count: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places (i, j) of edges in their blocks' lists of nodes, and weights; repeated pairs add up as far as they come together."""

    def rows(cell: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        i, j, w = (np.concatenate(v) for v in zip(*held, strict=True))
        if cell // count == cell % count:  # a block with itself: the order of a and b is open
            i, j = np.minimum(i, j), np.maximum(i, j)
        key = i.astype(np.int64) << 32 | j
        order = np.argsort(key)
        key = key[order]
        begin = np.flatnonzero(np.r_[True, np.diff(key) != 0])
        i, j, w = (key[begin] >> 32).astype(np.int32), key[begin].astype(np.int32), np.add.reduceat(w[order], begin)
        for k in range(0, len(i), _EDGES):
            yield pa.record_batch([pa.array([cell]), *[_bytes([v[k : k + _EDGES]]) for v in (i, j, w)]], names=["cell", "i", "j", "w"])

    now, held, n = None, [], 0
    for batch in batches:
        columns = [batch.column(c) for c in ("edges", "first", "second")]
        for cell, edges, first, second in zip(batch.column("cell").to_pylist(), *columns, strict=True):
            if held and (cell != now or n >= 16 * _EDGES):
                yield from rows(now, held)
                held, n = [], 0
            now = cell
            edges = pa.ipc.open_stream(edges.as_buffer()).read_all().combine_chunks()
            held.append((*[pc.index_in(edges[e].chunk(0), value_set=of.values.cast(edges[e].type)).to_numpy() for e, of in (("a", first), ("b", second))], edges["w"].to_numpy()))
            n += len(held[-1][0])
    if held:
        yield from rows(now, held)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of nodes (at, node, d), in the order of blocks, as a row per block."""
    held: list[pa.RecordBatch] = []

    def row() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ends = pa.array([0, table.num_rows], pa.int32())
        return pa.record_batch([table["at"].chunk(0)[:1], *[pa.ListArray.from_arrays(ends, table[c].chunk(0)) for c in ("node", "d")]], names=["at", "nodes", "d"])

    for batch in batches:
        at = batch.column("at").to_numpy()
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        for lo, hi in zip(begin, np.r_[begin[1:], len(at)], strict=True):
            if held and held[0].column("at")[0].as_py() != at[lo]:
                yield row()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield row()


def _totals(state: DataFrame, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S'S, S'AS and t'S of S = [x r p], summed from each task's own; t is the trivial eigenvector."""
    sums = np.zeros((6 * b + 1, 3 * b))
    for row in state.where("at < 0").select("t").collect():  # a row per task
        sums += np.frombuffer(row.t).reshape(6 * b + 1, 3 * b)
    return sums[: 3 * b], sums[3 * b : 6 * b], sums[6 * b]


def _best(gram: np.ndarray, inner: np.ndarray, trivial: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients in S of the b leading Ritz vectors across the trivial one, their values, and coefficients of the step to them.

    The basis holds all of x, then what p, then what r add across it: each is scaled first, and what rounding has made dependent
    goes, so that nothing of x is lost where r is small. Steps are orthogonal to the new vectors and of length 1.
    """
    gram, inner = gram - np.outer(trivial, trivial), (inner + inner.T) / 2 - np.outer(trivial, trivial)
    size = np.sqrt(np.maximum(np.diag(gram), 0))
    size = np.where(size > 1e-150, 1 / np.maximum(size, 1e-150), 0.0)
    basis, old = np.zeros((3 * b, 0)), 0
    for k in (0, 2, 1):
        more = np.diag(size)[:, k * b : (k + 1) * b]
        for _ in range(2):
            more = more - basis @ (basis.T @ gram @ more)
        values, vectors = np.linalg.eigh(more.T @ gram @ more)
        keep = values > 1e-8
        basis = np.hstack([basis, more @ vectors[:, keep] / np.sqrt(values[keep])])
        old = old or basis.shape[1] if k == 0 else old
    values, vectors = np.linalg.eigh(basis.T @ inner @ basis)
    n = min(b, len(values))
    best = vectors[:, ::-1][:, :n]
    step = best.copy()
    step[:old] = 0
    for _ in range(2):
        step = step - best @ (best.T @ step)
        step = step / np.maximum(np.linalg.norm(step, axis=0), 1e-14)
    left, sizes, _ = np.linalg.svd(step, full_matrices=False)
    step = left[:, sizes > 1e-4]
    out, late, found = np.zeros((3 * b, b)), np.zeros((3 * b, b)), np.full(b, -1.0)
    out[:, :n], late[:, : step.shape[1]], found[:n] = basis @ best, basis @ step, values[::-1][:n]
    return out, found, late


def fiedler(pairs: DataFrame, weight: str = "affinity", block: int = 8, tolerance: float = 1e-8, rounds: int = 300) -> DataFrame:
    """node, fiedler: second eigenvector of the normalised Laplacian I - D^(-1/2) W D^(-1/2), times D^(-1/2), for any number of nodes.

    LOBPCG: a block of vectors, their residuals and last steps, of which the best combinations are taken in each round. Nodes lie
    in blocks, edges in cells of two blocks, each edge once, dealt out by cell once and kept so on the executors. A round sends each
    block's residuals to its cells, sums their products by block and writes blocks; sums of products come from each task as one
    small matrix. The trivial vector is taken out exactly. It ends where the residual of the second eigenpair is below
    ``tolerance``. ``pairs``: a, b and a weight; repeated pairs add up, weights that are null or not positive and pairs of a
    node with itself go. Signed so that the least node is not positive. Of a graph in several parts it tells two sides apart.
    """
    rows = staged(pairs.select("a", "b", F.col(weight).cast("double").alias("w")).where("w > 0 AND a <> b"))
    degree = staged(both_ways(rows, "w").groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("d")))
    whole, n = degree.agg(F.sum("d"), F.count(F.lit(1))).first()
    if not n:
        return degree.select("node", F.lit(None).cast("double").alias("fiedler"))
    cores, edges, node = rows.sparkSession.sparkContext.defaultParallelism, rows.count(), degree.schema["node"].dataType.simpleString()
    # Blocks of about _NODES nodes, larger ones in sparse graphs, so that a cell of two blocks has edges enough.
    count = max(min(-(-n // _NODES), max(1, math.isqrt(edges // _EDGES))), -(-n // _MOST))
    parts = min(count * (count + 1) // 2, max(2 * cores, edges >> 20))

    def at(of: str) -> F.Column:
        return F.pmod(F.xxhash64(of), F.lit(count)).cast("int")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "cell").sortWithinPartitions("cell")

    def met(cells: DataFrame, of: DataFrame, what: str) -> DataFrame:
        """Cells with ``what`` of their first and second block, which is sent to them; the cells stay where they are."""
        ends = F.array_union(*[F.expr(f"transform(sequence({lo}, {hi}), k -> struct({cell} AS cell, {first} AS first))") for lo, hi, cell, first in (("at", count - 1, f"at * {count}L + k", "true"), (0, "at", f"k * {count}L + at", "false"))])
        sent = dealt(of.select(what, F.explode(ends).alias("e")).select("e.cell", "e.first", what))
        both = sent.groupBy("cell").agg(*[F.first(F.when(F.col("first") == side, F.col(what)), True).alias(name) for name, side in (("first", True), ("second", False))])
        return cells.hint("merge").join(both, "cell")

    blocks = staged(degree.withColumn("at", at("node")).repartition("at").sortWithinPartitions("at", "node").mapInArrow(_blocks, f"at int, nodes array<{node}>, d array<double>"))
    each = rows.select(*[F.col(e).cast(node).alias(e) for e in "ab"], "w").select("a", "b", "w", at("a").alias("g"), at("b").alias("h"))
    packed = dealt(each.mapInArrow(partial(_packed, count), "cell long, edges binary"))
    cells = staged(met(packed, blocks, "nodes").select("cell", "edges", "first", "second").mapInArrow(partial(_cells, count), "cell long, i binary, j binary, w binary"))
    cells = dealt(cells).persist(StorageLevel.DISK_ONLY)

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each cell times its blocks of r, summed by block as long as few blocks are open."""
        sums: dict[int, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(sums), pa.int32()), _bytes([m.T for m in sums.values()])], names=["at", "part"])

        for batch in batches:
            columns = [batch.column(c) for c in ("i", "j", "w", "first", "second")]
            for cell, i, j, w, first, second in zip(batch.column("cell").to_pylist(), *columns, strict=True):
                i, j = (np.frombuffer(v.as_buffer(), np.int32).astype(np.intp) for v in (i, j))
                w, first, second = np.frombuffer(w.as_buffer()), _floats(first, block), _floats(second, block)
                g, h = divmod(cell, count)
                if len(sums.keys() | {g, h}) > _OPEN and sums:
                    yield rows()
                    sums = {}
                for at, own, other, r, size in ((g, i, j, second, len(first)), (h, j, i, first, len(second))):
                    total, r = sums.setdefault(at, np.zeros((block, size))), np.ascontiguousarray(r.T)
                    for k in range(block):
                        total[k] += np.bincount(own, w * r[k][other], size)
        if sums:
            yield rows()

    kinds, root = ("t", "x", "r", "p", "ax", "ap"), math.sqrt(whole)
    state_kind = "at int, " + ", ".join(f"{c} binary" for c in ("t", *_PARTS))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with ar, of rows that come in the order of blocks: the block's own, and sums of its cells. At last this task's sums of products."""
        now, own, sums, total = None, None, 0.0, np.zeros((6 * block + 1, 3 * block))

        def row() -> pa.RecordBatch:
            t, x, r, p, ax, ap = own
            ar = sums / (t * root)
            s, a = np.hstack([x, r, p]), np.hstack([ax, ar, ap])
            total[: 3 * block] += s.T @ s
            total[3 * block : 6 * block] += s.T @ a
            total[6 * block] += t[:, 0] @ s
            return pa.record_batch([pa.array([now], pa.int32()), *[_bytes([m]) for m in (t, x, r, p, ax, ar, ap)]], names=["at", "t", *_PARTS])

        for batch in batches:
            columns = [batch.column(c) for c in ("part", *kinds)]
            for at, part, *others in zip(batch.column("at").to_pylist(), *columns, strict=True):
                if now is not None and at != now:
                    yield row()
                    sums = 0.0
                now = at
                if part.is_valid:
                    sums = sums + _floats(part, block)
                else:
                    own = [_floats(v, 1 if c == "t" else block) for c, v in zip(kinds, others, strict=True)]
        if now is not None:
            yield row()
            yield pa.record_batch([pa.array([-1], pa.int32()), _bytes([total]), *[pa.nulls(1, pa.binary())] * 6], names=["at", "t", *_PARTS])

    def heard(new: DataFrame, r: DataFrame) -> DataFrame:
        """``new`` with ar: what the neighbours' r, each by the root of its degree, sum up to, by the node's own root. Cells hold weights as they are."""
        sums = met(cells, r, "r").select("cell", "i", "j", "w", "first", "second").mapInArrow(times, "at int, part binary")
        rows = new.withColumn("part", F.lit(None).cast("binary")).unionByName(sums, allowMissingColumns=True)
        return staged(rows.select("at", "part", *kinds).repartition("at").sortWithinPartitions("at").mapInArrow(added, state_kind))

    def started(only: str | None = None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, d, chance in zip(batch.column("at"), batch.column("d"), batch.column("chance"), strict=True):
                    t, r = np.sqrt(d.values.to_numpy())[:, None] / root, chance.values.to_numpy().reshape(block, -1).T
                    zero = np.zeros(r.shape)
                    found = {"t": t, "x": zero, "r": r / (t * root) if only else r, "p": zero, "ax": zero, "ap": zero}
                    names = [only] if only else list(kinds)
                    yield pa.record_batch([pa.array([at.as_py()], pa.int32()), *[_bytes([found[c]]) for c in names]], names=["at", *names])

        return run

    def both(df: DataFrame, run) -> DataFrame:
        return heard(df.mapInArrow(run(), "at int, " + ", ".join(f"{c} binary" for c in kinds)), df.mapInArrow(run("r"), "at int, r binary"))

    # Values by hash of the node, so that they are the same in every attempt of a task.
    chance = F.flatten(F.array(*[F.expr(f"transform(nodes, v -> xxhash64({k}, v) / {2**63}D)") for k in range(block)]))
    state = both(blocks.select("at", "d", chance.alias("chance")), started)
    for turn in range(rounds + 1):
        gram, inner, trivial = _totals(state, block)
        # The second eigenpair's residual is the first of r.
        if turn and (gram[block, block] <= tolerance * tolerance or n <= 2) or turn == rounds:
            break
        c, values, late = _best(gram, inner, trivial, block)

        def stepped(only: str | None = None, c=c, values=values, late=late, trivial=trivial):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at, t, *parts in zip(batch.column("at"), *[batch.column(k) for k in ("t", *_PARTS)], strict=True):
                        t, parts = _floats(t, 1), [_floats(v, block) for v in parts]
                        s, a = np.hstack(parts[:3]), np.hstack(parts[3:])
                        # What is trivial in the new vectors goes.
                        x, ax = s @ c - t * (trivial @ c), a @ c - t * (trivial @ c)
                        found = {"t": t, "x": x, "r": ax - x * values, "ax": ax}
                        if only:
                            found["r"] = found["r"] / (t * root)
                        else:
                            found |= {"p": s @ late - t * (trivial @ late), "ap": a @ late - t * (trivial @ late)}
                        names = [only] if only else list(kinds)
                        yield pa.record_batch([pa.array([at.as_py()], pa.int32()), *[_bytes([found[k]]) for k in names]], names=["at", *names])

            return run

        state = both(state.where("at >= 0"), stepped)
    cells.unpersist()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, d, x in zip(batch.column("nodes"), batch.column("d"), batch.column("x"), strict=True):
                yield pa.record_batch([nodes.values, pa.array(_floats(x, block)[:, 0] / np.sqrt(d.values.to_numpy()))], names=["node", "fiedler"])

    signs = staged(blocks.join(state.where("at >= 0").select("at", "x"), "at").select("nodes", "d", "x").mapInArrow(told, f"node {node}, fiedler double"))
    first = signs.orderBy("node").first().fiedler
    return signs.withColumn("fiedler", F.col("fiedler") * F.lit(-1.0 if first > 0 else 1.0))
