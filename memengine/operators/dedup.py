"""Near-duplicate pairs, nearest neighbours, clusters and merges of memories."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memengine.functions.scalars import unit
from memengine.operators import graph
from memengine.operators.retrieval import topk_by


#: Vectors in a block; two blocks are compared by one matrix product.
BLOCK_ROWS = 1024


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, parts, part, ids, values, marks: the rows (keys, id, u, marks) of a group, cut by the id's hash into blocks of about BLOCK_ROWS, as flat arrays."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys, F.ceil(F.col("n") / BLOCK_ROWS).alias("parts"))
    dealt = rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    held = dealt.groupBy(*keys, "parts", "part").agg(F.collect_list(F.struct("id", "u", "marks")).alias("rows"))
    return held.select(*keys, "parts", "part", F.col("rows.id").alias("ids"), F.flatten("rows.u").alias("values"), F.flatten("rows.marks").alias("marks"))


def _matrix(column: pa.Array, at: int, rows: int) -> np.ndarray:
    start, end = column.offsets[at].as_py(), column.offsets[at + 1].as_py()
    return column.values.slice(start, end - start).to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first of the n nodes that each one reaches over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        np.minimum.at(low, label, low.copy())
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def _within(rows: DataFrame, keys: list[str], threshold: float, best: tuple[int, int] | None = None, duplicate: float | None = None) -> DataFrame:
    """(agent_id, a, b, similarity), a < b, of all rows of a group at or above the threshold; a pair that agrees in an earlier mark belongs to another group.

    best (pairs, digits): two blocks give only so many pairs, the first by similarity, rounded, then a, b: enough for the same first pairs of each agent.

    duplicate: instead of the pairs (agent_id, id, root, links, duplicates): each row that has pairs in two blocks, a row that it reaches by them, how many vectors it
    pairs with, and how many of them from that similarity on; the last mark is then how many equal vectors a row stands for.  That is no more than the blocks' rows.

    A block meets itself where it lies; blocks of large groups are dealt by pairs of blocks, so that no task has a whole group."""
    blocks = _blocks(rows, keys)
    alone = blocks.select("agent_id", *[F.col(c).alias(f"{c}_{side}") for side in "xy" for c in ("ids", "values", "marks")], F.lit(True).alias("same"), "table")
    large = blocks.where("parts > 1")
    sides = [
        large.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in ("ids", "values", "marks")], F.col("part").alias(side), F.explode(others).alias(other))
        for side, other, others in (("x", "y", F.sequence(F.col("part") + 1, F.col("parts"))), ("y", "x", F.sequence(F.lit(-1), F.col("part") - 1)))
    ]  # the sequences end one off, as an empty one can't be written; those keys meet nothing
    apart = sides[0].join(sides[1], [*keys, "x", "y"]).select(*[c for c in alone.columns if c not in ("same", "table")], F.lit(False).alias("same"), "table")

    def folded(agents: pa.Array, r: int, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, alike: np.ndarray, of_x: np.ndarray, of_y: np.ndarray) -> pa.RecordBatch:
        ids, nodes = np.unique(np.concatenate([x, y]), return_inverse=True)
        a, b = nodes[i], nodes[len(x) + j]
        links, duplicates = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for here, weight in ((a, of_y[j]), (b, of_x[i])):
            np.add.at(links, here, weight)
            np.add.at(duplicates, here, weight * alike)
        kept, root = np.flatnonzero(links), _roots(len(ids), a, b)
        agent = pa.array([agents[r].as_py()] * len(kept), agents.type)
        return pa.RecordBatch.from_pydict({"agent_id": agent, "id": ids[kept], "root": ids[root[kept]], "links": links[kept], "duplicates": duplicates[kept]})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {c: batch.column(batch.schema.names.index(c)) for c in batch.schema.names}
            for r in range(batch.num_rows):
                x, y = (own[f"ids_{s}"][r].values.to_numpy(zero_copy_only=False) for s in "xy")
                u, v = (_matrix(own[f"values_{s}"], r, len(ids)) for s, ids in (("x", x), ("y", y)))
                product = u @ v.T
                if best:
                    product = np.round(product, best[1])
                i, j = np.nonzero(product >= threshold)
                keep = x[i] < y[j] if own["same"][r].as_py() else x[i] != y[j]
                i, j = i[keep], j[keep]
                table = own["table"][r].as_py()
                if table and len(i):
                    first, second = (_matrix(own[f"marks_{s}"], r, len(ids)) for s, ids in (("x", x), ("y", y)))
                    fresh = ~(first[i, :table] == second[j, :table]).any(axis=1)
                    i, j = i[fresh], j[fresh]
                if best and len(i) > best[0]:
                    s = product[i, j]
                    near = s >= np.partition(s, len(s) - best[0])[len(s) - best[0]]
                    i, j = i[near], j[near]
                    first = np.lexsort((np.maximum(x[i], y[j]), np.minimum(x[i], y[j]), -product[i, j]))[: best[0]]
                    i, j = i[first], j[first]
                if duplicate is not None:
                    if len(i):
                        yield folded(own["agent_id"], r, x, y, i, j, product[i, j] >= duplicate, *(_matrix(own[f"marks_{s}"], r, len(ids))[:, -1] for s, ids in (("x", x), ("y", y))))
                    continue
                agent = pa.array([own["agent_id"][r].as_py()] * len(i), batch.schema.field("agent_id").type)
                yield pa.RecordBatch.from_pydict({"agent_id": agent, "a": np.minimum(x[i], y[j]), "b": np.maximum(x[i], y[j]), "similarity": product[i, j]})

    kind = rows.schema["agent_id"].dataType.simpleString()
    return alone.unionByName(apart).mapInArrow(compare, f"agent_id {kind}, " + ("a long, b long, similarity double" if duplicate is None else "id long, root long, links long, duplicates long"))


def _units(vectors: DataFrame) -> DataFrame:
    more = ["weight"] if "weight" in vectors.columns else []
    return vectors.select("agent_id", F.col("id").cast("long").alias("id"), unit(F.col("embedding")).alias("u"), *more).where("u IS NOT NULL AND agent_id IS NOT NULL").withColumn("dims", F.size("u"))


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(agent_id, a, b, similarity), a < b, within an agent, at or above the threshold: exact, by comparing all of an agent's vectors of like size in blocks.

    Its work is the square of an agent's vectors; hashed_pairs compares far fewer."""
    rows = _units(vectors).withColumns({"marks": F.array().cast("array<bigint>"), "table": F.lit(0)})
    return _within(rows, ["agent_id", "dims", "table"], threshold)


def tables_for(threshold: float, recall: float, n: int) -> tuple[int, int]:
    """(bits of a key, tables) that find a pair right at the threshold with that probability, at the least work for n vectors.

    Vectors at right angles meet in less than a twelfth of the cases, all tables together; (0, 1), one bucket for all, where no 256 tables reach that."""
    agree = 1 - math.acos(threshold) / math.pi
    best = None
    for bits in range(1, 25):
        tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(agree**bits))))
        work = tables * n * (10 + n / 2 / 2**bits)
        if tables <= min(256, 2**bits / 12) and (best is None or work < best[0]):
            best = (work, bits, tables)
    return (best[1], best[2]) if best else (0, 1)


def hashed(vectors: DataFrame, bits: int, tables: int, seed: int = 7) -> DataFrame:
    """(agent_id, dims, table, bucket, id, u, marks): each vector under one bucket of each table; vectors share a bucket with the chance that so many random planes don't part them.

    Where vectors have a weight it is a last mark, behind those of the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.schema.names.index("u")
            marks = []
            for u in batch.column(at):
                u = u.values.to_numpy(zero_copy_only=False)
                if len(u) not in planes:
                    planes[len(u)] = np.random.Generator(np.random.PCG64([seed, len(u)])).normal(size=(tables * bits, len(u)))
                marks.append((planes[len(u)] @ u > 0).reshape(tables, bits) @ (1 << np.arange(bits, dtype=np.int64)))
            yield batch.append_column("marks", pa.array([m.tolist() for m in marks], pa.list_(pa.int64())))

    rows = _units(vectors)
    kind = rows.schema["agent_id"].dataType.simpleString()
    weighed = "weight" in rows.columns
    marked = rows.mapInArrow(run, f"agent_id {kind}, id long, u array<double>, {'weight long, ' if weighed else ''}dims int, marks array<bigint>")
    return marked.select("agent_id", "dims", F.posexplode("marks").alias("table", "bucket"), "id", "u", F.array_append("marks", F.col("weight")).alias("marks") if weighed else "marks")


def hashed_pairs(vectors: DataFrame, threshold: float, recall: float = 0.95, seed: int = 7, least: float | None = None, best: tuple[int, int] | None = None) -> DataFrame:
    """similar_pairs by tables of random hyperplanes: every pair given is exact, and a pair at the threshold is found with the probability `recall`, a closer one surer.

    A vector is compared within its bucket of each table only; full buckets are cut into blocks, none is capped.  similar_pairs is the exact way.
    least, best: of the pairs found only those from a higher bound on, and of those an agent's first ones at least (see _within), for callers that want no others."""
    most = vectors.groupBy("agent_id").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(threshold, recall, most)
    return _within(hashed(vectors, bits, tables, seed), ["agent_id", "dims", "table", "bucket"], max(threshold, least or threshold), best)


def hashed_links(vectors: DataFrame, threshold: float, duplicate: float = 0.92, recall: float = 0.95, seed: int = 7) -> DataFrame:
    """(agent_id, id, class_id, links, duplicates): for each vector the smallest id that it reaches by the pairs of hashed_pairs, its own included, and how many pairs it has, and has from `duplicate` on.

    Equal vectors of an agent are compared as one and counted for all, and two blocks give their rows' counts and components instead of their pairs, so what is
    moved and written grows with the vectors, not with the pairs.  Ids are one agent's; vectors that are empty, zero or without an agent have no links."""
    held, fine, sets = _sets(vectors)
    most = sets.groupBy("agent_id").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(threshold, recall, most)
    rows = hashed(sets, bits, tables, seed)
    return _linked(held, fine, sets, _within(rows, ["agent_id", "dims", "table", "bucket"], threshold, duplicate=duplicate))


def _sets(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vectors, written; those that can be compared; and their sets of equal ones of an agent (agent_id, high, low, id, weight, embedding), known by 128 bits: the first id and how many they are."""
    bits = [F.xxhash64("embedding").alias("high"), F.xxhash64(F.lit(1), "embedding").alias("low")]
    held = graph.written(vectors.select("agent_id", F.col("id").cast("long").alias("id"), "embedding", *bits), "vectors")
    fine = held.where(unit(F.col("embedding")).isNotNull() & F.col("agent_id").isNotNull())
    return held, fine, graph.written(fine.groupBy("agent_id", "high", "low").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")), "sets")


def _linked(held: DataFrame, fine: DataFrame, sets: DataFrame, met: DataFrame) -> DataFrame:
    """(agent_id, id, class_id, links, duplicates) of all vectors, from what sets have met: (agent_id, id, root, links, duplicates)."""
    met = graph.written(met, "links")
    counts = met.groupBy("id").agg(F.sum("links").alias("links"), F.sum("duplicates").alias("duplicates"))
    reached = graph.components(met.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst")))
    classes = sets.withColumnRenamed("id", "first").select("agent_id", "high", "low", "first", "weight")
    members = fine.select("agent_id", "id", "high", "low").join(classes, ["agent_id", "high", "low"]).select("id", "first", "weight")
    found = members.join(counts.withColumnRenamed("id", "first"), "first", "left").join(reached.withColumnRenamed("id", "first"), "first", "left")
    same = lambda c: F.coalesce(c, F.lit(0)) + F.col("weight") - 1
    return held.select("agent_id", "id").join(found.select("id", F.coalesce("component", "first").alias("class_id"), same("links").alias("links"), same("duplicates").alias("duplicates")), "id", "left").select(
        "agent_id", "id", F.coalesce("class_id", "id").alias("class_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("links", "duplicates")]
    )


#: Vectors of an agent in a part of the grid.
GRID_ROWS = 1 << 15


def _grid(rows: DataFrame, run: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run for each two parts of an agent's rows (agent_id, id, embedding, ...), and for each part with itself, the key's last two being equal then.

    An agent's rows are cut by hash into parts of about GRID_ROWS; a row is sent once for each part, and a task holds two parts and a tile of their similarities."""
    sizes = rows.groupBy("agent_id").agg(F.ceil(F.count("*") / GRID_ROWS).alias("parts")).where("parts > 1")  # never more than there are parts
    dealt = rows.join(F.broadcast(sizes), "agent_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: F.struct(F.least(own, i).alias("x"), F.greatest(own, i).alias("y"), (i < own).alias("second")))
    sent = dealt.withColumn("cell", F.explode(cells)).select(*rows.columns, "cell.*")

    def parted(key: tuple, cell: pa.Table) -> pa.Table:
        return run(key, cell.filter(pc.invert(cell["second"])), cell.filter(cell["second"]))

    return sent.groupBy("agent_id", "x", "y").applyInArrow(parted, schema)


def _by_size(key: tuple, first: pa.Table, second: pa.Table) -> Iterator[tuple[pa.Table, pa.Table, bool]]:
    """Two parts' vectors of like size, by id, and whether they are the same."""
    same = key[1].as_py() == key[2].as_py()
    for dims in pc.unique(pc.list_value_length(first["embedding"])).to_pylist():
        x, y = (t.filter(pc.equal(pc.list_value_length(t["embedding"]), dims)).sort_by("id") for t in (first, first if same else second))
        if x.num_rows and y.num_rows:
            yield x, y, same


def _tiles(x: pa.Table, y: pa.Table, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity) of the rows of x and y at or above the threshold, each two once, a tile at a time."""
    u, v = (pc.list_flatten(t["embedding"]).to_numpy().astype(np.float64).reshape(t.num_rows, -1) for t in (x, y))
    u, v = (m / np.sqrt((m * m).sum(axis=1))[:, None] for m in (u, v))
    at = 0
    while at < len(u):
        low = at if same else 0
        step = max(1, TILE // (len(v) - low))
        product = u[at : at + step] @ v[low:].T
        i, j = np.divmod(np.flatnonzero(product.ravel() >= threshold), product.shape[1])
        if same:
            i, j = i[j > i], j[j > i]
        if len(i):
            yield i + at, j + low, product[i, j]
        at += step


def links(vectors: DataFrame, threshold: float, duplicate: float = 0.92) -> DataFrame:
    """hashed_links, but exact: all of an agent's different vectors are compared, in a grid of parts (see _grid).

    Its work is their square, at a few nanoseconds each two; what it moves is each vector once for each GRID_ROWS of its agent, which is less than the many tables of hashed_links up to millions of an agent."""

    def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        nodes, at = np.unique(np.concatenate([label[a], label[b]]), return_inverse=True)
        to = np.arange(len(label))
        to[nodes] = nodes[_roots(len(nodes), at[: len(a)], at[len(a) :])]
        return to[label]

    def run(key: tuple, first: pa.Table, second: pa.Table) -> pa.Table:
        found = []
        for x, y, same in _by_size(key, first, second):
            n = x.num_rows + (0 if same else y.num_rows)
            more = 0 if same else x.num_rows
            ids, weight = (np.concatenate([t[c].to_numpy() for t in ((x,) if same else (x, y))]) for c in ("id", "weight"))
            counts, label = np.zeros((2, n), np.int64), np.arange(n)
            for i, j, s in _tiles(x, y, same, threshold):
                j = j + more
                for c, a, b in ((counts[0], i, j), (counts[1], i[s >= duplicate], j[s >= duplicate])):
                    c += np.bincount(a, weight[b], n).astype(np.int64)
                    c += np.bincount(b, weight[a], n).astype(np.int64)
                label = joined(label, i, j)
            kept = np.flatnonzero(counts[0])
            found.append(pa.table({"agent_id": pa.array([key[0].as_py()] * len(kept), first.schema.field("agent_id").type), "id": ids[kept], "root": ids[label[kept]], "links": counts[0][kept], "duplicates": counts[1][kept]}))
        return pa.concat_tables(found) if found else pa.table({"agent_id": first["agent_id"][:0], **{c: np.zeros(0, np.int64) for c in ("id", "root", "links", "duplicates")}})

    held, fine, sets = _sets(vectors)
    kind = sets.schema["agent_id"].dataType.simpleString()
    return _linked(held, fine, sets, _grid(sets.drop("high", "low"), run, f"agent_id {kind}, id long, root long, links long, duplicates long"))


def first_pairs(vectors: DataFrame, threshold: float, most: int, digits: int = 6) -> DataFrame:
    """(agent_id, a, b, similarity), a < b: of an agent's pairs at or above the threshold, similarities rounded, the first `most` by similarity, a and b at least: exact.

    Each two parts of an agent's vectors (see _grid) give no more than that, so copies make no others."""

    def run(key: tuple, first: pa.Table, second: pa.Table) -> pa.Table:
        found = []
        for x, y, same in _by_size(key, first, second):
            names = [t["id"].to_numpy() for t in (x, y)]
            a, b, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for i, j, fresh in _tiles(x, y, same, threshold - 10.0**-digits):
                fresh, p, q = np.round(fresh, digits), names[0][i], names[1][j]
                low, high = np.minimum(p, q), np.maximum(p, q)
                good = (fresh >= threshold) & (low < high)
                if len(s) == most:
                    good &= (fresh > s[-1]) | ((fresh == s[-1]) & ((low < a[-1]) | ((low == a[-1]) & (high < b[-1]))))
                a, b, s = np.append(a, low[good]), np.append(b, high[good]), np.append(s, fresh[good])
                order = np.lexsort((b, a, -s))[:most]
                a, b, s = a[order], b[order], s[order]
            found.append(pa.table({"agent_id": pa.array([key[0].as_py()] * len(s), first.schema.field("agent_id").type), "a": a, "b": b, "similarity": s}))
        return pa.concat_tables(found) if found else pa.table({"agent_id": first["agent_id"][:0], "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "similarity": np.zeros(0)})

    rows = vectors.select("agent_id", F.col("id").cast("long").alias("id"), "embedding").where(unit(F.col("embedding")).isNotNull() & F.col("agent_id").isNotNull())
    return _grid(rows, run, f"agent_id {rows.schema['agent_id'].dataType.simpleString()}, a long, b long, similarity double")


def labelled(pairs: DataFrame, duplicate: float = 0.92, related: float = 0.85) -> DataFrame:
    kind = F.when(F.col("similarity") >= duplicate, "duplicate").when(F.col("similarity") >= related, "review").otherwise("related")
    return pairs.withColumn("label", kind)


def knn_edges(vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, similarity) for each row's k nearest of the same agent at or above the threshold, kept as a < b: those are the nearest pairs of all."""
    pairs = similar_pairs(vectors, threshold)
    both = pairs.select("a", "b", "similarity").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(F.col("r") <= k)
    return ranked.where("a < b").select("a", "b", "similarity")


def centroids(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, n, dim, mean): the mean of each dimension over (cluster, id), pre-aggregated by the tasks."""
    rows = members.join(vectors, "id").select("cluster", "id", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))


def unit_centroids(means: DataFrame) -> DataFrame:
    """(cluster, dim, mean) at length one; a cluster has one row for each dimension."""
    size = F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(Window.partitionBy("cluster")))
    return means.select("cluster", "dim", (F.col("mean") / size).alias("mean"))


def merged(pairs: DataFrame, memories: DataFrame) -> DataFrame:
    """For each pair the winner (no lower confidence; the first of equals), and the merged headline, context, importance and confidence."""
    both = pairs.join(memories.alias("x"), F.col("a") == F.col("x.id")).join(memories.alias("y"), F.col("b") == F.col("y.id"))
    first = F.coalesce("x.confidence", F.lit(0.5)) >= F.coalesce("y.confidence", F.lit(0.5))
    won, lost = (lambda c: F.when(first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))), (lambda c: F.when(first, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")))
    value = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0.5))
    head, other = F.coalesce(won("headline"), F.lit("")), F.coalesce(lost("headline"), F.lit(""))
    text, more = F.coalesce(won("context"), F.lit("")), F.coalesce(lost("context"), F.lit(""))
    return both.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("winner"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("loser"),
        F.when((head != other) & (F.coalesce(lost("importance"), F.lit(0.0)) >= 0.6), F.concat(head, F.lit(" (also: "), other, F.lit(")"))).otherwise(head).alias("headline"),
        F.when(text == "", more).when((more == "") | (text == more), text).otherwise(F.concat(text, F.lit("\n---\n"), more)).alias("context"),
        F.greatest(value("x", "importance"), value("y", "importance")).alias("importance"),
        F.least(F.lit(0.99), (value("x", "confidence") + value("y", "confidence")) / 2 + 0.1).alias("confidence"),
    )


#: Queries, and vectors, that one task compares at most; similarities in a tile of them; what rounding may take from one.
NEAREST_ROWS, TILE, SLACK = 16384, 1 << 22, 1e-12


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = NEAREST_ROWS, agents: str = "all") -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar vectors (id, embedding) of each query (query_id, embedding); a vector with the query's own id is left out.

    agents: "all", or "own" and "other": then both have agent_id, and only vectors of the query's agent, or of other agents, are its neighbours.
    Queries and vectors (an agent's, for "own") are cut into blocks by hash; each pair of blocks is one group of a cogroup, which keeps each query's k best, and
    one merge follows.  So a task's memory is that of two blocks and a tile, whatever the number of queries, and the work is all queries times all vectors."""
    scoped = agents != "all"
    group = F.xxhash64("agent_id") if agents == "own" else F.lit(0).cast("long")
    side = lambda df, c: df.select(group.alias("g"), F.col(c).alias(c), unit(F.col("embedding")).alias("u"), *([F.col("agent_id").alias("agent_id")] if scoped else [])).where("u IS NOT NULL")
    asked, rows = side(queries, "query_id"), side(vectors, "id")
    # only groups of several blocks are listed: never more than there are blocks
    parts = lambda df, c: F.broadcast(df.groupBy("g").agg(F.ceil(F.count("*") / block).alias(c)).where(F.col(c) > 1))
    x, y = parts(asked, "xs"), parts(rows, "ys")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(c, F.lit(1)) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(n, F.lit(1)))
    sent = asked.join(x, "g", "left").join(y, "g", "left").withColumn("x", own("query_id", "xs")).withColumn("y", every("ys")).drop("xs", "ys")
    held = rows.join(x, "g", "left").join(y, "g", "left").withColumn("x", every("xs")).withColumn("y", own("id", "ys")).drop("xs", "ys")
    key, kind = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    out = sent.groupBy("g", "x", "y").cogroup(held.groupBy("g", "x", "y")).applyInArrow(_nearest(k, agents), f"query_id {key}, id {kind}, similarity double")
    return topk_by(out, ["query_id"], [F.desc("similarity"), F.col("id")], k)


def _nearest(k: int, agents: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        for dims in pc.unique(pc.list_value_length(asked["u"])).to_pylist():
            q, v = (t.filter(pc.equal(pc.list_value_length(t["u"]), dims)) for t in (asked, rows))
            v = v.take(pc.sort_indices(v["id"]))
            i, j, s = _best(q, v, k, agents)
            found.append(pa.table({"query_id": q["query_id"].take(i), "id": v["id"].take(j), "similarity": s}))
        return pa.concat_tables(found) if found else pa.table({"query_id": asked["query_id"], "id": rows["id"][:0], "similarity": np.zeros(0)})

    return run


def _rows(table: pa.Table) -> np.ndarray:
    return pc.list_flatten(table["u"]).to_numpy().reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1))


def _best(asked: pa.Table, rows: pa.Table, k: int, agents: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity): the k best rows, which are ordered by id, of each query.

    Tiles of products find what may belong to them; its similarities are summed anew, in an order that doesn't depend on the tile, so that equal vectors tie."""
    q, v = _rows(asked), _rows(rows)
    names, ids = asked["query_id"].to_numpy(), rows["id"].to_numpy()
    first = last = np.zeros(len(q), np.int64)
    if names.dtype.kind == ids.dtype.kind:
        first, last = (np.searchsorted(ids, names, side) for side in ("left", "right"))
    if agents != "all":
        codes = pc.dictionary_encode(pa.chunked_array([*asked["agent_id"].chunks, *rows["agent_id"].chunks], asked["agent_id"].type), null_encoding="encode").combine_chunks().indices.to_numpy()
        mine, theirs = codes[: len(q)], codes[len(q) :]
    floor = np.full(len(q), -np.inf)
    i, j, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    fresh: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, TILE // max(1, len(q)))
    for at in range(0, len(v), step):
        near = q @ v[at : at + step].T
        for o in range(int((last - first).max(initial=0))):
            own = np.flatnonzero((first + o < last) & (first + o >= at) & (first + o < at + near.shape[1]))
            near[own, first[own] + o - at] = -np.inf
        if agents != "all":
            same = mine[:, None] == theirs[None, at : at + step]
            near[~same if agents == "own" else same] = -np.inf
        bar = floor
        if np.isneginf(floor).any() and near.shape[1] > k:
            bar = np.maximum(floor, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k])
        a, b = np.nonzero((near >= bar[:, None] - SLACK) & (near > -np.inf))
        fresh.append((a, b + at))
        if sum(len(a) for a, _ in fresh) < len(q) * k / 2 and at + step < len(v):
            continue
        a, b = (np.concatenate(c) for c in zip(*fresh, strict=True))
        fresh = []
        exact = [(q[a[n : n + 65536]] * v[b[n : n + 65536]]).sum(axis=1) for n in range(0, len(a), 65536)]
        i, j, s = np.concatenate([i, a]), np.concatenate([j, b]), np.concatenate([s, *exact])
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        place = np.arange(len(i)) - np.repeat(starts, np.diff(starts, append=len(i)))
        floor[i[place == k - 1]] = s[place == k - 1]
        i, j, s = i[place < k], j[place < k], s[place < k]
    return i, j, s


def unscanned_neighbours(vectors: DataFrame, scanned: DataFrame, queued: DataFrame, k: int = 5, threshold: float = 0.82) -> DataFrame:
    """(agent_id, a, b, similarity): pairs to queue: rows (agent_id, id, embedding) that aren't in scanned (id) yet, and those of their agent's k nearest above the threshold.

    Only new rows are compared, with all rows; pairs that are queued (a, b, in any order) already don't come again."""
    fresh = vectors.join(scanned.select("id").distinct(), "id", "left_anti")
    near = nearest(vectors, fresh.select(F.col("id").alias("query_id"), "embedding", "agent_id"), k, agents="own").where(F.col("similarity") > threshold)
    pairs = near.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    known = queued.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti").join(vectors.select(F.col("id").alias("a"), "agent_id"), "a").select("agent_id", "a", "b", "similarity")
