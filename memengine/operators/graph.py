"""Graph operators over edge tables: neighbourhoods, paths, components, provenance.

Loops run over written checkpoints, and each step is a join on the edge key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; only a session in one process (local tests) gets a temporary one where it names none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="memengine-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, computed once; by: a column, its last, whose values have files of their own."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def hops(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, hop): nodes within depth steps of start (id), with the fewest steps; visited nodes leave the frontier."""
    # an edge that comes twice leads to the same nodes, which are made distinct, so the whole graph needn't be
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = _cut(start.select("id", F.lit(0).alias("hop")).distinct())
    frontier = seen.select("id")
    for hop in range(1, depth + 1):
        step = both.join(frontier.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        fresh = _cut(step.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hop")))
        if fresh.isEmpty():
            break
        seen, frontier = _cut(seen.union(fresh)), fresh.select("id")
    return seen


def subgraph(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(src, dst, hop): edges met within depth steps; an edge has the hop of its nearer end plus one."""
    near = hops(edges, start, depth - 1) if depth > 1 else start.select("id", F.lit(0).alias("hop"))
    a = edges.join(near.withColumnRenamed("id", "src"), "src").select("src", "dst", "hop")
    b = edges.join(near.withColumnRenamed("id", "dst"), "dst").select("src", "dst", "hop")
    return a.union(b).groupBy("src", "dst").agg((F.min("hop") + 1).alias("hop"))


def shortest_paths(edges: DataFrame, start: DataFrame, depth: int = 6) -> DataFrame:
    """(id, path): a shortest directed path from start (id) to each node within depth steps; of several the first as text.

    One path is kept for each node reached, so a level has no more rows than there are nodes."""
    seen = _cut(start.select("id", F.array(F.col("id").cast("string")).alias("path")).distinct())
    frontier = seen
    for _ in range(min(depth, 6)):
        step = edges.select("src", "dst").join(frontier.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), F.array_append("path", F.col("dst").cast("string")).alias("path"))
        best = step.groupBy("id").agg(F.min_by("path", F.array_join("path", ">")).alias("path"))
        frontier = _cut(best.join(seen.select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = _cut(seen.union(frontier))
    return seen


def provenance(parents: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """(root, id, depth, truncated): what each start (id) derives from over edges (id, parent), each ancestor once, at its least depth; truncated: it has parents beyond the depth."""
    edges = parents.select("id", "parent").distinct()
    seen = _cut(start.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select("root", "id").join(edges, "id").select("root", F.col("parent").alias("id")).distinct()
        frontier = _cut(step.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = _cut(seen.union(frontier))
    more = edges.select("id").distinct().withColumn("has", F.lit(True))
    return seen.join(more, "id", "left").select("root", "id", "depth", F.coalesce(F.col("has") & (F.col("depth") == depth), F.lit(False)).alias("truncated"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest node that each node of an edge reaches, by minimum labels with pointer jumping."""
    both = _cut(undirected(edges))
    labels = _cut(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).select(F.col("src").alias("id"), "label"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("label").alias("low"))
        step = labels.join(near.withColumnRenamed("src", "id"), "id").select("id", F.least("label", "low").alias("label"))
        jump = _cut(step)
        new = _cut(jump.join(jump.select(F.col("id").alias("label"), F.col("label").alias("far")), "label").select("id", F.least("label", "far").alias("label")))
        if new.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old").isEmpty():
            return new.withColumnRenamed("label", "component")
        labels = new


def co_occurrence(index: DataFrame, k: int) -> DataFrame:
    """(id, other, shared): for each memory the k others that share most entities, of equals the smaller ids; index is (entity, id), each pair once.

    The memories of an entity aren't paired.  Who shares two entities or more is found by the memories' own pairs of entities, a few each; who shares but one
    can be among the first k only as one of the k smallest other ids of that entity, so an entity gives its k + 1 smallest to each of its memories."""
    from pyspark.sql import Window

    index = index.where("entity IS NOT NULL AND id IS NOT NULL").select("entity", "id")
    both = index.join(index.withColumnRenamed("entity", "second"), "id").where("entity < second")
    met = Window.partitionBy("entity", "second").orderBy("id")
    often = _cut(both.withColumns({"before": F.lag("id").over(met), "after": F.lead("id").over(met)}).where("before IS NOT NULL OR after IS NOT NULL").select("entity", "second", "id"))
    pairs = often.join(often.withColumnRenamed("id", "other"), ["entity", "second"]).where("id <> other").groupBy("id", "other").agg(F.count("*").alias("n"))
    # s shared entities make s * (s - 1) / 2 pairs of them
    many = pairs.select("id", "other", F.round((1 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("long").alias("shared"))
    best = many.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "other"))).where(F.col("r") <= k)
    best = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "other", "shared"))).alias("best"))

    least = index.withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy("id"))).where(F.col("r") <= k + 1)
    near = index.join(least.groupBy("entity").agg(F.collect_list("id").alias("near")), "entity").select("id", "near")
    ones = near.repartition("id").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("ones"))
    none = F.array().cast(best.schema["best"].dataType)
    known = ones.join(best, "id", "left").withColumn("best", F.coalesce("best", none)).withColumn("rest", F.slice(F.array_except("ones", F.array_append("best.other", F.col("id"))), 1, k))
    kept = lambda other, shared: F.struct(other.alias("other"), shared.alias("shared"))
    first = F.slice(F.concat(F.transform("best", lambda x: kept(x["other"], x["shared"])), F.transform("rest", lambda x: kept(x, F.lit(1).cast("long")))), 1, k)
    return known.select("id", F.explode(first).alias("x")).select("id", "x.other", "x.shared")
