"""Near-duplicate vectors by an exact metric range join (operator 11).

Vectors of equal components are one class.  Classes are scaled to length 1, so
that cosine >= t means a distance of at most r = sqrt(2 - 2t).  Pivots, drawn
from a bounded sample and more than 2r apart, partition them: a vector's cell
is that of its nearest pivot, and a cell's rings of width r part it further by
the distance to the pivot.  A vector is copied to another ring only if the
triangle inequality allows a partner there: the ring must meet the distances
within r of its own, and its distance to the border between the two cells must
be at most r.  Only rings after its own are visited, so each pair meets once.

Rings are dealt as blocks against blocks, whose sizes are bounded, and each is
joined independently by matrix products in double precision.  A block pair
gives, for each vector with links, their number and one edge of a spanning
forest: links are counted, never listed.  Where vectors lie evenly in many
dimensions no metric bound prunes, and the join costs the square; that is so
for every exact method, and the blocks keep memory bounded even then.

Defined results: vectors that are null, empty or all zero, or hold null or
non-finite components, link with nothing and are their own component.  Vectors
of different lengths don't link.  Repeated rows, and rows that share vec_id,
are vectors of their own.  A row without vec_id links like others; component_id
is the smallest vec_id that is not null (null if there is none), and such a
row is not kept.  Long vectors make the sample smaller, which is bounded in
bytes.  Ties with the threshold link.  An empty table gives no rows.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import Scratch, materialize
from veritrail.llm.components import components

#: Members of a block; a task holds two blocks.
BLOCK = 8_192
#: At most so many pivots, drawn from a sample of so many vectors and bytes.
MAX_PIVOTS, SAMPLE, SAMPLE_BYTES = 4_096, 16_384, 1 << 26
#: Rows of a matrix product made at a time.
STRIPE = 512
#: What rounding may add to a distance; bounds are wider by so much, and no link hangs on it.
SLACK = 1e-6

_MIN_LONG, _MAX_LONG = -(1 << 63), (1 << 63) - 1


def _usable(v: Column) -> Column:
    """Whether a vector has a direction: finite components, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _sixteen(x: Column) -> Column:
    return F.lpad(F.hex(x), 16, "0")


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of length 1, filled up with zeros to ``width``, and their lengths before that."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        out = flat.reshape(len(sizes), width)
    else:
        out = np.zeros((len(sizes), width))
        out[np.arange(width)[None] < sizes[:, None]] = flat
    out = out / np.abs(out).max(axis=1, keepdims=True, initial=1e-300)
    return out / np.linalg.norm(out, axis=1, keepdims=True), sizes


def choose_pivots(sample: np.ndarray, wanted: int, apart: float) -> np.ndarray:
    """Up to ``wanted`` rows of the sample, in its order, each more than ``apart`` from those before: a dense group gets one."""
    chosen: list[int] = []
    near = np.full(len(sample), np.inf)
    while len(chosen) < wanted and (near > apart).any():
        chosen.append(int(np.argmax(near > apart)))
        near = np.minimum(near, np.sqrt(np.maximum(2 - 2 * sample @ sample[chosen[-1]], 0)))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def _place(pivots: np.ndarray, r: float):
    """Arrow batches of (…, v) with the nearest pivot and the ring around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _matrix(batch.column("v"), pivots.shape[1])
            cell, ring = np.empty(len(x), np.int32), np.empty(len(x), np.int32)
            for k in range(0, len(x), STRIPE):
                d = _distances(x[k : k + STRIPE], pivots)
                cell[k : k + STRIPE] = d.argmin(1)
                ring[k : k + STRIPE] = d.min(1) // r
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(ring)], names=[*batch.schema.names, "cell", "ring"])

    return run


def _visit(pivots: np.ndarray, r: float, units: np.ndarray):
    """Arrow batches of (…, v, cell, ring) with the units (cell, ring), numbered in order, where partners may be: its own and later ones."""
    between = _distances(pivots, pivots)
    at, ring_of = units[:, 0], units[:, 1]
    number = {tuple(u): k for k, u in enumerate(units.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _matrix(batch.column("v"), pivots.shape[1])
            cell, ring = batch.column("cell").to_numpy(), batch.column("ring").to_numpy()
            own = np.array([number[u] for u in zip(cell.tolist(), ring.tolist())], dtype=np.int32)
            parts: list[np.ndarray] = []
            for k in range(0, len(x), STRIPE):
                d, c = _distances(x[k : k + STRIPE], pivots), cell[k : k + STRIPE]
                home = d[np.arange(len(c)), c]
                gap = np.maximum(between[c], SLACK)
                border = (d**2 - home[:, None] ** 2) / (2 * gap) <= r + SLACK
                border[np.arange(len(c)), c] = True
                low, high = d - r - SLACK, d + r + SLACK
                meets = border[:, at] & (low[:, at] < (ring_of + 1) * r) & (high[:, at] >= ring_of * r) & (np.arange(len(units)) >= own[k : k + STRIPE, None])
                meets[np.arange(len(c)), own[k : k + STRIPE]] = True
                parts += [np.flatnonzero(m).astype(np.int32) for m in meets]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            visits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))
            keep = [batch.column(n) for n in ("node", "copies", "v")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(own), visits], names=["node", "copies", "v", "own", "units"])

    return run


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and columns of a two-sided graph, -1 for those without links."""
    rows, columns = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    for start in np.flatnonzero(linked.any(1)):
        if rows[start] < 0:
            rows[start], front = start, np.array([start])
            while len(front):
                new = np.flatnonzero(linked[front].any(0) & (columns < 0))
                columns[new] = start
                front = np.flatnonzero(linked[:, new].any(1) & (rows < 0))
                rows[front] = start
    return rows, columns


def _join_blocks(threshold: float):
    """Rows of one block pair to (node, links, other): linked vectors with their counts, and an edge to the least node of their component here."""
    out = pa.schema([("node", pa.string()), ("links", pa.int64()), ("other", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        none = out.empty_table()
        at_home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        if at_home.all() or not at_home.any():
            return none
        vectors = table.column("v").combine_chunks()
        x, sizes = _matrix(vectors, int(vectors.value_lengths().to_numpy(zero_copy_only=False).max()))
        nodes, rank = np.unique(np.array(table.column("node").to_pylist()), return_inverse=True)
        copies = table.column("copies").to_numpy()
        own = table.column("is_own").to_numpy(zero_copy_only=False).astype(bool)
        h, v = np.flatnonzero(at_home), np.flatnonzero(~at_home)
        links = np.zeros(len(rank), np.int64)
        linked = np.zeros((len(v), len(h)), bool)
        for k in range(0, len(v), STRIPE):
            some = v[k : k + STRIPE]
            cosine = x[some] @ x[h].T
            close = cosine >= threshold - 1e-9
            for a, b in np.argwhere(close & (cosine < threshold + 1e-9)):  # at the threshold itself, from unscaled sums
                p, q = (np.asarray(vectors[int(i)].as_py(), np.float64) for i in (some[a], h[b]))
                close[a, b] = len(p) == len(q) and math.fsum(p * q) / (math.sqrt(math.fsum(p * p)) * math.sqrt(math.fsum(q * q))) >= threshold
            close &= sizes[some][:, None] == sizes[h]
            # In its own ring a pair is met from both sides; a node is also met by itself.
            close &= ~own[some][:, None] | (rank[some][:, None] < rank[h])
            linked[k : k + STRIPE] = close
            links[some] = close @ copies[h]
            links[h] += copies[some] @ close
        if not linked.any():
            return none
        group = np.full(len(rank), -1)
        group[v], group[h] = _forest(linked)
        has = np.flatnonzero(links > 0)
        least = np.full(len(v), len(nodes), np.int64)
        np.minimum.at(least, group[has], rank[has])
        head = least[group[has]]
        other = [None if a == b else nodes[b] for a, b in zip(rank[has].tolist(), head.tolist())]
        return pa.table([pa.array(nodes[rank[has]].tolist(), pa.string()), pa.array(links[has]), pa.array(other, pa.string())], schema=out)

    return run


def _links(nodes: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """(node, links, other) for all linked pairs of classes, over block pairs."""
    r = math.sqrt(max(2 - 2 * threshold, 0)) + SLACK
    shape = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    wanted = min(MAX_PIVOTS, max(1, 2 * shape.n // BLOCK))
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * shape.width)))
    drawn = nodes.select("v").orderBy(F.xxhash64("node", F.lit("pivot"))).limit(size).toArrow()
    vectors = drawn.column("v").combine_chunks()
    pivots = choose_pivots(_matrix(vectors, shape.width)[0], wanted, 2 * r)
    element = nodes.schema["v"].dataType.simpleString()
    homes = scratch.keep(nodes.select("node", "copies", "v").mapInArrow(_place(pivots, r), f"node string, copies long, v {element}, cell int, ring int"), "cells")
    # One row a ring of a pivot: at most MAX_PIVOTS * (2 / r + 1) of them, whatever the input.
    counts = homes.groupBy("cell", "ring").count().orderBy("cell", "ring").collect()
    units = np.array([(c.cell, c.ring) for c in counts], dtype=np.int64)
    visits = scratch.keep(homes.mapInArrow(_visit(pivots, r, units), f"node string, copies long, v {element}, own int, units array<int>"), "visits")
    came = {row.unit: row["count"] for row in visits.select(F.explode("units").alias("unit")).groupBy("unit").count().collect()}
    blocks = [(k, max(1, -(-c["count"] // BLOCK)), max(1, -(-came.get(k, 0) // BLOCK))) for k, c in enumerate(counts)]
    blocks = F.broadcast(nodes.sparkSession.createDataFrame(blocks, "unit int, home_blocks int, visit_blocks int"))
    spread, other_spread = F.xxhash64("node"), F.xxhash64("node", F.lit("visit"))
    home = visits.select("node", "copies", "v", F.col("own").alias("unit"), F.lit(True).alias("home"), F.lit(True).alias("is_own")).join(blocks, "unit")
    home = home.withColumn("hb", F.pmod(spread, "home_blocks").cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("visit_blocks") - 1)))
    away = visits.select("node", "copies", "v", "own", F.explode("units").alias("unit")).select("node", "copies", "v", "unit", F.lit(False).alias("home"), (F.col("own") == F.col("unit")).alias("is_own")).join(blocks, "unit")
    away = away.withColumn("vb", F.pmod(other_spread, "visit_blocks").cast("int")).withColumn("hb", F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)))
    columns = ["unit", "hb", "vb", "home", "is_own", "node", "copies", "v"]
    met = home.select(columns).unionAll(away.select(columns))
    return met.groupBy("unit", "hb", "vb").applyInArrow(_join_blocks(threshold), "node string, links long, other string")


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding); ``threshold`` from 0 to 1."""
    double = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), double.alias("v")).withColumn("ok", _usable(F.col("v")))
    h1, h2 = F.xxhash64(F.lit(1), "v"), F.xxhash64(F.lit(2), "v")
    with Scratch(vectors.sparkSession) as scratch:
        rows = scratch.keep(rows.select("vec_id", F.when(F.col("ok"), F.col("v")).alias("v"), F.when(F.col("ok"), h1).alias("h1"), F.when(F.col("ok"), h2).alias("h2")), "vectors")
        classes = rows.where(F.col("v").isNotNull()).groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
        # Nodes sort like their smallest vec_id, those without one last.
        node = F.concat(_sixteen(F.coalesce("id", F.lit(_MAX_LONG)).bitwiseXOR(F.lit(_MIN_LONG))), F.when(F.col("id").isNull(), "1").otherwise("0"), _sixteen(F.col("h1")), _sixteen(F.col("h2")))
        nodes = scratch.keep(classes.withColumn("node", node), "classes")
        found = nodes.select("h1", "h2", "node", "id", (F.col("copies") - 1).alias("n_links"), F.col("id").alias("component_id"))
        if nodes.limit(1).count():
            met = scratch.keep(_links(nodes, scratch, threshold), "links")
            links = met.groupBy("node").agg(F.sum("links").alias("links"))
            stars = components(met.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
            first_id = F.when(F.substring("component", 17, 1) == "0", (F.conv(F.substring("component", 1, 16), 16, 10).cast("decimal(20,0)") + F.lit(_MIN_LONG).cast("decimal(20,0)")).cast("long"))
            stars = stars.select("node", first_id.alias("least"), F.lit(True).alias("in_star"))
            found = nodes.join(links.hint("merge"), "node", "left").join(stars.hint("merge"), "node", "left")
            found = found.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("in_star"), F.col("least")).otherwise(F.col("id")).alias("component_id"))
            found = scratch.keep(found, "found")
        else:
            found = found.select("h1", "h2", "n_links", "component_id")
        out = rows.select("vec_id", "h1", "h2").join(found.hint("merge"), ["h1", "h2"], "left")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
        return materialize(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "near-vectors")


def op11_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every vector: vec_id, n_links, component_id, kept."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
