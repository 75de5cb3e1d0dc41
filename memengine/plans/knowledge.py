"""Queries of consensus, threads, secrets, graphs and vectors' clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from memengine.operators import consensus, dedup, graph, secrets, threads
from memengine.plans.base import query
from memengine.sources.tables import VECTORS_SQL, scan, vectors

_CANDIDATES = "d AS (SELECT source AS cluster, lang AS agent, text FROM documents)"


def _candidates(spark, sf_dir):
    return scan(spark, sf_dir, "documents").select(F.col("source").alias("cluster"), F.col("lang").alias("agent"), "text")


@query(f"WITH {_CANDIDATES}, a AS (SELECT cluster, list_sort(list(DISTINCT agent)) AS a FROM d WHERE agent IS NOT NULL GROUP BY cluster) SELECT cluster, array_to_string(list_slice(a, 1, 3), ',') AS agents, len(a) >= 2 AS eligible FROM a")
def chosen_agents(spark, sf_dir):
    return consensus.chosen_agents(_candidates(spark, sf_dir).where("agent IS NOT NULL")).withColumn("agents", F.array_join("agents", ","))


_CLAIMS = """c AS (SELECT cluster, agent, rtrim(regexp_replace(lower(trim(unnest(string_split(regexp_replace(trim(text), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))), ' ' || chr(9) || chr(10) || chr(13))), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '.!?,;:') AS claim FROM d),
n AS (SELECT cluster, count(DISTINCT agent) AS agents FROM d GROUP BY 1)"""


@query(f"""WITH {_CANDIDATES}, {_CLAIMS}, v AS (SELECT cluster, claim FROM c JOIN n USING (cluster) WHERE claim <> '' GROUP BY cluster, claim, agents HAVING count(DISTINCT agent) >= (agents + 1) // 2), k AS (SELECT cluster, agent, count(*) AS retained FROM (SELECT DISTINCT cluster, agent, claim FROM c) JOIN v USING (cluster, claim) GROUP BY ALL),
t AS (SELECT cluster, agent, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM d GROUP BY ALL) SELECT cluster, agent, coalesce(retained, 0) AS retained, tokens, CAST(row_number() OVER (PARTITION BY cluster ORDER BY coalesce(retained, 0) DESC, tokens DESC, agent) AS INTEGER) AS r FROM t LEFT JOIN k USING (cluster, agent)""")
def consensus_rank(spark, sf_dir):
    return consensus.ranked_candidates(_candidates(spark, sf_dir))


@query(f"""WITH {_CANDIDATES}, {_CLAIMS}, s AS (SELECT cluster, claim, list_sort(list(DISTINCT agent)) AS sup FROM c WHERE claim <> '' GROUP BY ALL), e AS (SELECT cluster, list_sort(list(DISTINCT agent)) AS every FROM d GROUP BY 1)
SELECT cluster, md5(claim) AS claim_md5, array_to_string(sup, ',') AS supporters, array_to_string(list_filter(every, lambda x: NOT list_contains(sup, x)), ',') AS dissenters FROM s JOIN e USING (cluster) WHERE len(sup) < (len(every) + 1) // 2""")
def disagreements(spark, sf_dir):
    out = consensus.disagreement(_candidates(spark, sf_dir))
    return out.select("cluster", F.md5(F.col("claim").cast("binary")).alias("claim_md5"), F.array_join("supporters", ",").alias("supporters"), F.array_join("dissenters", ",").alias("dissenters"))


@query("""WITH s AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))) AS sources, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR)) FILTER (WHERE l_linenumber % 2 = 0)) AS listed, 'see [src:' || CAST(min(l_suppkey) AS VARCHAR) || '] and [src:' || CAST(min(l_partkey) AS VARCHAR) || ']' AS text FROM lineitem GROUP BY 1),
c AS (SELECT *, list_distinct(list_concat(regexp_extract_all(text, '\\[src:([0-9a-f-]+)\\]', 1), coalesce(listed, []))) AS cited FROM s)
SELECT id, CAST(len(cited) AS INTEGER) AS cited, CAST(len(list_filter(cited, lambda x: NOT list_contains(sources, x))) AS INTEGER) AS unknown, len(cited) > 0 AND len(list_filter(cited, lambda x: NOT list_contains(sources, x))) = 0 AS valid, round(len(list_filter(cited, lambda x: list_contains(sources, x))) / len(sources), 6) AS confidence, substr(sha256(array_to_string(sources, ',')), 1, 16) AS cluster FROM c""")
def citations(spark, sf_dir):
    part, li = F.col("l_partkey").cast("string"), scan(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("see [src:"), F.min("l_suppkey").cast("string"), F.lit("] and [src:"), F.min("l_partkey").cast("string"), F.lit("]"))
    s = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(part)).alias("sources"), F.array_sort(F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, part))).alias("listed"), text.alias("text"))
    out = consensus.citation_check(s)
    return out.select("id", F.size("cited").alias("cited"), F.size("unknown").alias("unknown"), "valid", F.round("confidence", 6).alias("confidence"), consensus.cluster_id(F.col("sources")).alias("cluster"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS source FROM lineitem), l AS (SELECT id, count(*) AS n FROM s WHERE source NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY id) SELECT DISTINCT s.id, coalesce(n, 0) AS "left", n IS NULL AS degenerate FROM s LEFT JOIN l USING (id)""")
def resynthesis_sources(spark, sf_dir):
    s = scan(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("source_ids"))
    return consensus.resynthesis_sources(s, scan(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id")))


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations WHERE role IN ('user', 'assistant')), g AS (SELECT conv_id, p // 2 AS pair, max(text) FILTER (WHERE role = 'user') AS human, max(text) FILTER (WHERE role = 'assistant') AS reply, count(*) AS n FROM x GROUP BY 1, 2)
SELECT conv_id, pair, human, reply FROM g WHERE n = 2 AND length(human) >= 20 AND reply IS NOT NULL AND NOT (length(human) < 15 AND length(reply) < 30) AND NOT starts_with(human, '[system') AND NOT starts_with(human, '<system')""")
def stride_pairs(spark, sf_dir):
    return threads.worth_keeping(threads.stride_pairs(scan(spark, sf_dir, "conversations")))


@query("""WITH t AS (SELECT o_custkey AS owner, o_orderkey AS thread, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT t.owner, t.thread, p.thread AS prior FROM t LEFT JOIN t p ON p.owner = t.owner AND p.r = CASE WHEN t.r = 1 THEN 2 ELSE 1 END""")
def prior_threads(spark, sf_dir):
    return threads.prior_thread(scan(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("thread"), F.col("o_orderdate").alias("last_seen")))


@query("""WITH RECURSIVE c AS (SELECT l_orderkey AS thread, CAST(l_linenumber AS BIGINT) AS seq, CAST(floor(l_quantity) AS BIGINT) AS tokens, l_returnflag = 'R' AS preserved, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_linenumber, floor(l_quantity)) AS r FROM lineitem),
f AS (SELECT DISTINCT thread, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, false AS taken FROM c UNION ALL
 SELECT thread, c.r, used + CASE WHEN ok THEN tokens ELSE 0 END, n + CASE WHEN ok THEN 1 ELSE 0 END, ok FROM (SELECT f.thread, f.used, f.n, c.r, c.tokens, c.preserved OR (f.used + c.tokens <= 80 AND f.n < 4) AS ok FROM f JOIN c ON c.thread = f.thread AND c.r = f.r + 1) c)
SELECT c.thread, seq, tokens, preserved FROM f JOIN c ON c.thread = f.thread AND c.r = f.r WHERE taken AND n <= 4""")
def resumed_checkpoints(spark, sf_dir):
    c = scan(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("thread"), F.col("l_linenumber").alias("seq"), F.floor("l_quantity").alias("tokens"), (F.col("l_returnflag") == "R").alias("preserved"))
    return threads.resumed(c, 80, 4)


@query("WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) SELECT conv_id, turn FROM t WHERE r <= 4")
def thread_tails(spark, sf_dir):
    return threads.last_n(scan(spark, sf_dir, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r > 1")
def known_content(spark, sf_dir):
    """Rows whose content's hash an earlier row has."""
    d = scan(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    return d.join(first, "h").where("doc_id > first").select("doc_id")


@query()
def secret_scan(spark, sf_dir):
    return secrets.scanned(scan(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query()
def redacted_texts(spark, sf_dir):
    d = scan(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return secrets.without_secrets(d).select("id", F.sha2(F.col("text").cast("binary"), 256).alias("clean_sha256"))


_EDGES = "e AS (SELECT DISTINCT l_partkey AS src, -1 - l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'R' UNION SELECT DISTINCT -1 - l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A')"


@query(f"""WITH RECURSIVE {_EDGES}, h AS (SELECT CAST(7 AS BIGINT) AS id, 0 AS d UNION SELECT e.dst, d + 1 FROM h JOIN e ON e.src = h.id WHERE d < 3), m AS (SELECT id, min(d) AS d FROM h GROUP BY id),
p AS (SELECT id, d, CAST(id AS VARCHAR) AS path FROM m WHERE d = 0 UNION ALL SELECT m.id, m.d, p.path || '>' || CAST(m.id AS VARCHAR) FROM p JOIN e ON e.src = p.id JOIN m ON m.id = e.dst AND m.d = p.d + 1)
SELECT id, min(path) AS path FROM p GROUP BY id""")
def shortest_paths(spark, sf_dir):
    li = scan(spark, sf_dir, "lineitem")
    s = F.col("l_suppkey")
    e = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("src"), (-1 - s).alias("dst")).union(li.where("l_returnflag = 'A'").select(-1 - s, "l_partkey")).distinct()
    return graph.shortest_paths(e, spark.range(7, 8), 3).withColumn("path", F.array_join("path", ">"))


@query("""WITH RECURSIVE e AS (SELECT l_orderkey AS id, min(l_partkey) AS parent FROM lineitem GROUP BY 1), h AS (SELECT o_orderkey AS root, o_orderkey AS id, 0 AS d FROM orders WHERE o_totalprice > 400000 UNION SELECT root, parent, d + 1 FROM h JOIN e USING (id) WHERE d < 3)
SELECT root, id, min(d) AS depth, min(d) = 3 AND id IN (SELECT id FROM e) AS truncated FROM h GROUP BY root, id""")
def provenance(spark, sf_dir):
    e = scan(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_partkey").alias("parent"))
    return graph.provenance(e, scan(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("id")), 3)


@query("SELECT l_partkey AS entity, count(DISTINCT l_orderkey) AS mention_count, max(l_shipdate) AS last_seen FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 GROUP BY 1 ORDER BY mention_count DESC, last_seen DESC, entity LIMIT 50")
def listed_entities(spark, sf_dir):
    small = scan(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    n = scan(spark, sf_dir, "lineitem").join(small, "l_partkey").groupBy(F.col("l_partkey").alias("entity")).agg(F.count_distinct("l_orderkey").alias("mention_count"), F.max("l_shipdate").alias("last_seen"))
    return n.orderBy(F.desc("mention_count"), F.desc("last_seen"), "entity").limit(50)


@query("SELECT o_orderkey, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = 77 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def entity_memories(spark, sf_dir):
    hits = scan(spark, sf_dir, "lineitem").where("l_partkey = 77").select(F.col("l_orderkey").alias("o_orderkey"))
    return hits.join(scan(spark, sf_dir, "orders"), "o_orderkey").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, max(l_discount) AS strength FROM lineitem GROUP BY 1, 2) SELECT dst, strength FROM e WHERE src = 77 ORDER BY strength DESC, dst LIMIT 20")
def related(spark, sf_dir):
    """One hop outgoing, the strongest first."""
    e = scan(spark, sf_dir, "lineitem").where("l_partkey = 77").groupBy(F.col("l_suppkey").alias("dst")).agg(F.max("l_discount").alias("strength"))
    return e.orderBy(F.desc("strength"), "dst").limit(20)


@query(f"""WITH {VECTORS_SQL}, r AS (SELECT agent_id AS cluster, unnest(generate_series(0, len(embedding) - 1)) AS dim, unnest(embedding) AS x FROM vectors), m AS (SELECT cluster, dim, avg(x) AS m FROM r GROUP BY ALL) SELECT cluster, CAST(dim AS INTEGER) AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY cluster)), 6) AS mean FROM m""")
def unit_centroids(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return dedup.unit_centroids(dedup.centroids(v.drop("agent_id"), v.select("id", F.col("agent_id").alias("cluster")))).withColumn("mean", F.round("mean", 6))
