"""Near-duplicate embeddings by Euclidean p-stable hashing.

Normalised vectors are hashed by floor((a.v + b) / w) with Gaussian a. A bucket is the combination of several such hashes;
every vector is in one bucket of each of several tables. `plan` sets the number of hashes from the number of vectors (so
that unrelated vectors seldom share a bucket) and the number of tables from the recall wanted at the threshold itself;
closer pairs are found more surely.

Equal vectors are one node with a multiplicity. Buckets of more than `BLOCK` nodes are cut into blocks, and every pair of
blocks is a unit of work of its own. Inside a unit, 128 random sign bits first drop vectors without a possible partner,
so whole vectors are only sent where a link is likely; then cosines are taken exactly, in double precision. Pairs are
counted where they are found, in the first table they share, and never written: a unit returns a number of links per node
and fewer edges than it has nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.llm.common import arrow_map, components, run_bounds, whole_runs
from twinseek.session import materialize

COSINE = 0.95
# Chance to find a pair whose cosine is exactly the threshold.
RECALL = 0.997
WIDTH = 2.0
# Unrelated vectors that may share a bucket with a vector, on average.
STRANGERS = 2.0
BLOCK = 1000
SEED = 20240
SKETCH_BITS = 128


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one hash of two vectors at this Euclidean distance is equal."""
    c = width / distance
    normal = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


@dataclass(frozen=True)
class HashPlan:
    hashes: int
    tables: int
    width: float = WIDTH
    seed: int = SEED
    cosine: float = COSINE

    def projections(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Directions and offsets of all hashes, and directions of the sign bits."""
        rng = np.random.default_rng([self.seed, dim])
        n = self.hashes * self.tables
        return rng.normal(size=(dim, n)), rng.uniform(0, self.width, n), rng.normal(size=(dim, SKETCH_BITS))

    def sketch_limit(self) -> int:
        """Sign bits that may differ: eight standard deviations above what the threshold gives."""
        p = math.acos(max(-1.0, min(1.0, self.cosine))) / math.pi
        return math.ceil(SKETCH_BITS * p + 8 * math.sqrt(SKETCH_BITS * p * (1 - p)))


def plan(vectors: int, cosine: float = COSINE, recall: float = RECALL) -> HashPlan:
    """Hashes and tables for this many vectors; unrelated ones are taken to be orthogonal."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    hashes = max(8, math.ceil(math.log(max(2.0, vectors / STRANGERS)) / -math.log(far)))
    return HashPlan(hashes, math.ceil(math.log(1 - recall) / math.log(1 - near**hashes)), cosine=cosine)


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _valid(c: str) -> Column:
    """Not null, not empty, without null, NaN or infinite components, and not all zero."""
    odd = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(c).isNotNull() & ~odd & F.exists(c, lambda x: x != 0)


def _hashed(nodes: DataFrame, how: HashPlan) -> DataFrame:
    """(node, dim, keys, s0, s1): the bucket in each table, and the sign bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for batch in batches:
            rows = batch.column(1).to_pylist()
            dims = np.array([len(r) for r in rows])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                v = normalised(np.array([rows[i] for i in at], np.float64))
                if dim not in made:
                    made[dim] = how.projections(dim)
                directions, offsets, signs = made[dim]
                cells = np.floor((v @ directions + offsets) / how.width).astype(np.int64).view(np.uint64)
                cells = cells.reshape(len(at), how.tables, how.hashes)
                key = np.full((len(at), how.tables), 0x9E3779B97F4A7C15, np.uint64)
                for i in range(how.hashes):
                    key = (key ^ cells[:, :, i]) * np.uint64(0xFF51AFD7ED558CCD)
                    key ^= key >> np.uint64(32)
                keys = key.astype(np.uint32).view(np.int32)
                bits = np.packbits((v @ signs) > 0, axis=1).view("<i8")
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(at) + 1, dtype=np.int32) * how.tables), pa.array(np.ascontiguousarray(keys).ravel())
                )
                cols = [batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), lists]
                cols += [pa.array(np.ascontiguousarray(bits[:, i])) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "dim", "keys", "s0", "s1"])

    return arrow_map(nodes.select("node", "embedding"), run, "node long, dim int, keys array<int>, s0 long, s1 long")


_UNIT = ["dim", "t", "key", "i", "j"]


def _units(hashed: DataFrame, block: int) -> DataFrame:
    """(dim, t, key, i, j, own, node, s0, s1): members of every bucket of two nodes or more, listed for each pair of blocks they are in."""
    listed = hashed.select("node", "dim", "s0", "s1", F.posexplode("keys").alias("t", "key"))
    shared = listed.groupBy("dim", "t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = listed.join(shared, ["dim", "t", "key"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = members.withColumn("own", F.pmod(F.xxhash64("node", "t"), blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return members.select(
        "dim", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "s0", "s1"
    )


def _runs(table: pa.Table) -> Iterator[tuple[int, int]]:
    at = run_bounds(*[table.column(c).to_numpy() for c in range(len(_UNIT))])
    sizes = np.diff(at)
    yield from zip(at[:-1][sizes > 1].tolist(), at[1:][sizes > 1].tolist(), strict=True)


def _possible(units: DataFrame, how: HashPlan) -> DataFrame:
    """The members of a unit that have a possible partner in it, by their sign bits."""
    limit = how.sketch_limit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, list(range(len(_UNIT)))):
            own = table.column(5).to_numpy()
            across = table.column(3).to_numpy() != table.column(4).to_numpy()
            s = [table.column(c).to_numpy().view(np.uint64) for c in (7, 8)]
            keep = np.zeros(len(own), bool)
            for a, b in _runs(table):
                far = sum(np.bitwise_count(x[a:b, None] ^ x[None, a:b]) for x in s)
                near = far <= limit
                if across[a]:
                    near &= own[a:b, None] != own[None, a:b]
                else:
                    np.fill_diagonal(near, False)
                keep[a:b] = near.any(axis=1)
            yield from table.select(range(7)).filter(pa.array(keep)).combine_chunks().to_batches()

    dealt = units.repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    return arrow_map(dealt, run, "dim int, t int, key int, i int, j int, own int, node long")


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the symmetric matrix joins."""
    edges: list[tuple[int, int]] = []
    unseen = near.any(axis=1)
    while unseen.any():
        stack = [int(np.argmax(unseen))]
        unseen[stack[0]] = False
        while stack:
            x = stack.pop()
            found = np.flatnonzero(near[x] & unseen)
            unseen[found] = False
            edges += [(x, int(y)) for y in found]
            stack += found.tolist()
    return edges


def _linked(possible: DataFrame, payload: DataFrame, how: HashPlan) -> DataFrame:
    """(a, b, links): rows with links say how many vectors node `a` is newly linked with; the others are edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, list(range(len(_UNIT)))):
            own, node, copies = (table.column(c).to_numpy() for c in (5, 6, 7))
            across = table.column(3).to_numpy() != table.column(4).to_numpy()
            number = table.column(1).to_numpy()
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in _runs(table):
                part = table.slice(a, b - a)
                v = normalised(np.array(part.column(9).to_pylist(), np.float64))
                keys = np.array(part.column(8).to_pylist(), np.int32)
                near = v @ v.T >= how.cosine
                near &= near.T
                np.fill_diagonal(near, False)
                if across[a]:
                    near &= own[a:b, None] != own[None, a:b]
                for t in range(int(number[a])):  # pairs that met in an earlier table are counted there
                    if not near.any():
                        break
                    near &= keys[:, None, t] != keys[None, :, t]
                links = near @ copies[a:b]
                some = np.flatnonzero(links)
                edges = np.array(_forest(near), np.int64).reshape(-1, 2)
                out[0] += [node[a:b][some], node[a:b][edges[:, 0]]]
                out[1] += [np.full(len(some), -1), node[a:b][edges[:, 1]]]
                out[2] += [links[some], np.zeros(len(edges), np.int64)]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["a", "b", "links"])

    rows = possible.join(payload, "node").select(*_UNIT, "own", "node", "copies", "keys", "embedding")
    dealt = rows.repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    return arrow_map(dealt, run, "a long, b long, links long")


def embedding_groups(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept.

    Vectors with a cosine of `cosine` or more are linked, whatever other columns say. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, and so do rows with a null vec_id (their component_id is null).
    Vectors of different length link with nothing of each other. Repeated rows count like any other rows.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"))
    usable = F.col("vec_id").isNotNull() & _valid("embedding")
    good = rows.filter(usable)
    nodes = good.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    how = plan(nodes.count(), cosine, recall)
    hashed = materialize(_hashed(nodes, how), "vector-hashes")
    possible = _possible(_units(hashed, block), how)
    payload = nodes.select("node", "copies", "embedding").join(hashed.select("node", "keys"), "node")
    linked = materialize(_linked(possible, payload, how), "vector-links")
    roots = components(linked.filter("b >= 0").select("a", "b"), "vector")
    links = linked.filter("b < 0").groupBy("a").agg(F.sum("links").alias("links"))
    found = nodes.join(links.withColumnRenamed("a", "node"), "node", "left").join(roots, "node", "left")
    found = found.select("embedding", "low", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    low = found.groupBy("root").agg(F.min("low").alias("component_id"))
    found = found.join(low, "root").select("embedding", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.join(found, "embedding").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
