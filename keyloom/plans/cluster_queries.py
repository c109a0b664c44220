"""Clustering and principal components. Embeddings and the count matrix are the inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import cluster, linkage, pca, ranking
from ..session import checkpoint
from . import relations as r
from .registry import query, rounded

S = r.SAMPLES


def _embeddings(spark, d):
    e = r.table(spark, d, "embeddings")
    return checkpoint(e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label"))


def _profiles(spark, d, power=False):
    return cluster.prepare(r.counts(spark, d), "gene", S, power)


def _checked(feats, labels, key):
    """What must hold of a clustering, from its labels: (rows, clusters, by_size, settled). ``settled``: all but one row in a hundred are nearest
    to the mean of their own cluster, which a converged k-means has up to its tolerance."""
    labels = checkpoint(labels)
    means, _, _ = cluster._cluster_sums(feats, labels, key)
    near = F.array_min(F.array(*[F.struct(arrays.total(F.zip_with("features", F.array(*[F.lit(float(x)) for x in m["m"]]), lambda x, y: (x - y) * (x - y))).alias("d"),
                                          F.lit(m["cluster"]).alias("c")) for m in means]))["c"]
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("clusters"),
                      F.max(F.struct("n", (-F.col("cluster")).alias("c")))["c"].alias("__first")).select(
        "rows", "clusters", (F.col("__first") == 0).alias("by_size"))
    settled = feats.join(labels, key).agg((F.avg((near == F.col("cluster")).cast("int")) >= 0.99).alias("settled"))
    return shape.withColumn("settled", F.lit(settled.first()["settled"]))


@query("kmeans_embeddings", "SELECT count(*)::BIGINT AS rows, 10::BIGINT AS clusters, true AS by_size, true AS settled FROM embeddings")
def _(spark, d):
    e = _embeddings(spark, d)
    return _checked(e, cluster.kmeans(e, "vec_id", 10, seed=1), "vec_id")


@query("kmeans_power_transformed", f"WITH {r.COUNTS} SELECT count(*)::BIGINT AS rows, 4::BIGINT AS clusters, true AS by_size, true AS settled FROM counts")
def _(spark, d):
    p = _profiles(spark, d, True)
    return _checked(p, cluster.kmeans(p, "gene", 4, seed=1), "gene")


@query("kmedoids_profiles", f"WITH {r.COUNTS} SELECT count(*)::BIGINT AS rows, 4::BIGINT AS clusters, true AS by_size, true AS nearest, true AS settled FROM counts")
def _(spark, d):
    """All rows are with their nearest medoid, and no member of a cluster has a lower total distance than its medoid."""
    p = _profiles(spark, d)
    medoids = cluster.fit_kmedoids(p, "gene", 4, metric="pearson", seed=1)
    assigned = checkpoint(cluster._assign(p, "gene", medoids, "pearson"))
    labels = cluster.sort_clusters(assigned.select("gene", "cluster"), "gene")
    best = cluster.medoids_of(assigned, "gene", "pearson")
    own = assigned.filter(F.col("dist") <= 1e-12).groupBy("cluster").agg(F.min("gene").alias("gene"))
    shape = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("clusters"), (F.max(F.struct("n", (-F.col("cluster")).alias("c")))["c"] == 0).alias("by_size"))
    total = assigned.groupBy("cluster").agg(F.sum("dist").alias("total")).join(best.select("cluster", "cost"), "cluster").agg(
        F.bool_and(F.col("total") <= F.col("cost") * (1 + 1e-9) + 1e-9).alias("ok")).first()["ok"]
    return shape.select("rows", "clusters", "by_size", F.lit(own.count() == 4).alias("nearest"), F.lit(total).alias("settled"))


@query("hierarchical_profiles", f"WITH {r.COUNTS} SELECT count(*)::BIGINT AS rows, 5::BIGINT AS clusters, true AS by_size FROM counts")
def _(spark, d):
    p = _profiles(spark, d)
    return _checked(p, cluster.hierarchical(p, "gene", 5, seed=1), "gene").drop("settled")


def _components(links: str) -> str:
    """Clusters as connected components of ``links`` (a, b): the smallest label of a neighbour is taken until none moves."""
    return f"""links AS MATERIALIZED ({links}), comp(gene, component) USING KEY (gene) AS (SELECT gene, gene FROM core UNION
  SELECT l.a, min(c.component) FROM comp c JOIN links l ON l.b = c.gene JOIN recurring.comp o ON o.gene = l.a WHERE c.component < o.component GROUP BY l.a)"""


_PROFILE = f"""profile AS MATERIALIZED (SELECT gene, [{", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in S)}] AS p FROM counts)"""


def _numbered(least: int) -> str:
    return f"""sized AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component DESC) - 1 AS cluster FROM comp GROUP BY component HAVING count(*) >= {least})
  SELECT profile.gene, coalesce(cluster, -1)::INTEGER AS cluster FROM profile LEFT JOIN comp ON comp.gene = profile.gene LEFT JOIN sized USING (component)"""


@query("single_linkage_threshold", f"""WITH RECURSIVE {r.COUNTS}, {_PROFILE}, core AS (SELECT gene FROM profile),
  {_components("SELECT x.gene AS a, y.gene AS b FROM profile x JOIN profile y ON x.gene <> y.gene AND list_distance(x.p, y.p) <= 0.8")}, {_numbered(1)}""")
def _(spark, d):
    return cluster.hierarchical(_profiles(spark, d), "gene", distance_threshold=0.8)


@query("density_clusters", f"""WITH RECURSIVE {r.COUNTS}, {_PROFILE},
  near AS MATERIALIZED (SELECT x.gene AS a, y.gene AS b FROM profile x JOIN profile y ON list_distance(x.p, y.p) <= 0.9), core AS (SELECT a AS gene FROM near GROUP BY a HAVING count(*) >= 5),
  {_components("SELECT a, b FROM near WHERE a <> b AND a IN (FROM core) AND b IN (FROM core)")}, {_numbered(10)}""")
def _(spark, d):
    return cluster.density_clusters(_profiles(spark, d), "gene", 0.9, min_samples=5, min_cluster_size=10)


@query("density_clusters_manhattan", f"""WITH RECURSIVE {r.COUNTS}, {_PROFILE},
  near AS MATERIALIZED (SELECT x.gene AS a, y.gene AS b FROM profile x JOIN profile y ON list_sum(list_transform(list_zip(x.p, y.p), lambda t: abs(t[1] - t[2]))) <= 1.7),
  core AS (SELECT a AS gene FROM near GROUP BY a HAVING count(*) >= 4), {_components("SELECT a, b FROM near WHERE a <> b AND a IN (FROM core) AND b IN (FROM core)")}, {_numbered(5)}""")
def _(spark, d):
    return cluster.density_clusters(_profiles(spark, d), "gene", 1.7, min_samples=4, min_cluster_size=5, metric="manhattan")


# Prim: the recursive table holds for each row its lightest edge to the tree so far, of equal ones that of the smaller genes; each step takes the
# row at the lightest edge and updates the others.
def _prim(core: str = "0.0::DOUBLE") -> str:
    weight = "greatest(list_distance(x.p, c.p), x.core, c.core)"
    return f"""cored AS MATERIALIZED (SELECT gene, p, {core} AS core FROM profile), prim(gene, w, near, done) USING KEY (gene) AS (
  SELECT gene, CASE WHEN gene = (SELECT min(gene) FROM cored) THEN -1.0::DOUBLE ELSE 1e300 END, NULL::BIGINT, false FROM cored UNION
  (WITH cur AS (SELECT r.gene, r.w, r.near, o.p, o.core FROM recurring.prim r JOIN cored o USING (gene) WHERE NOT r.done ORDER BY r.w, least(r.gene, r.near), greatest(r.gene, r.near) LIMIT 1)
   SELECT gene, w, near, true FROM cur UNION ALL
   SELECT x.gene, {weight}, c.gene, false FROM cored x JOIN recurring.prim r ON r.gene = x.gene, cur c WHERE NOT r.done AND x.gene <> c.gene AND ({weight} < r.w OR
     ({weight} = r.w AND (least(x.gene, c.gene), greatest(x.gene, c.gene)) < (least(x.gene, r.near), greatest(x.gene, r.near)))))),
  tree AS MATERIALIZED (SELECT least(gene, near) AS a, greatest(gene, near) AS b, w, row_number() OVER (ORDER BY w, least(gene, near), greatest(gene, near)) AS n FROM prim WHERE near IS NOT NULL)"""


@query("single_linkage_tree", f"WITH RECURSIVE {r.COUNTS}, {_PROFILE}, {_prim()} SELECT n AS merge, round(w, 9) AS distance FROM tree")
def _(spark, d):
    return rounded(cluster.dendrogram(_profiles(spark, d), "gene").select("merge", "distance"), digits=9)


def _cut(k: int) -> str:
    return f"""links{k} AS MATERIALIZED (SELECT a, b FROM tree WHERE n <= (SELECT count(*) FROM profile) - {k} UNION ALL SELECT b, a FROM tree WHERE n <= (SELECT count(*) FROM profile) - {k}),
  comp{k}(gene, component) USING KEY (gene) AS (SELECT gene, gene FROM profile UNION
    SELECT l.a, min(c.component) FROM comp{k} c JOIN links{k} l ON l.b = c.gene JOIN recurring.comp{k} o ON o.gene = l.a WHERE c.component < o.component GROUP BY l.a),
  sized{k} AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component DESC) - 1 AS cluster FROM comp{k} GROUP BY component)"""


@query("hierarchical_single_k", f"WITH RECURSIVE {r.COUNTS}, {_PROFILE}, {_prim()}, {_cut(2)}, {_cut(5)}, {_cut(20)} " + " UNION ALL ".join(
    f"SELECT {k}::INTEGER AS k, gene, cluster::INTEGER AS cluster FROM comp{k} JOIN sized{k} USING (component)" for k in (2, 5, 20)))
def _(spark, d):
    """Single linkage into 2, 5 and 20 clusters, from one tree."""
    points = cluster._points(_profiles(spark, d), "gene")
    tree = linkage.minimum_spanning_tree(points)
    parts = [cluster.number_clusters(linkage.cut_into(points, tree, k).select(F.col("node").alias("gene"), F.col("component").alias("cluster")), "gene").select(
        F.lit(k).alias("k"), "gene", "cluster") for k in (2, 5, 20)]
    return parts[0].union(parts[1]).union(parts[2])


# Density hierarchy with at least 8 rows a cluster, 4 other rows a neighbourhood: all merges of the tree, one a step (rows of the table: a gene with
# its component and last merge, or with a negative id a merge); clusters of the condensed tree by going down; their choice by going up.
_HIERARCHY = f"""{_prim("(SELECT list_sort(list(list_distance(o.p, profile.p)))[5] FROM profile o)")},
  kr(id, comp, top, size, w, l, r, ls, rs, step) USING KEY (id) AS (
    SELECT gene, gene, NULL::BIGINT, 1::BIGINT, 0.0::DOUBLE, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM profile UNION
    (WITH m AS (SELECT e.n AS s, e.w, x.comp AS ca, y.comp AS cb, x.top AS ta, y.top AS tb, x.size AS sa, y.size AS sb FROM (SELECT max(step) + 1 AS s FROM kr) cur
       JOIN tree e ON e.n = cur.s JOIN recurring.kr x ON x.id = e.a JOIN recurring.kr y ON y.id = e.b)
     SELECT o.id, m.ca, m.s, m.sa + m.sb, 0.0::DOUBLE, NULL, NULL, 0, 0, m.s FROM recurring.kr o, m WHERE o.id >= 0 AND o.comp IN (m.ca, m.cb) UNION ALL
     SELECT -m.s, NULL, m.s, m.sa + m.sb, m.w, m.ta, m.tb, m.sa, m.sb, m.s FROM m)),
  merged AS MATERIALIZED (SELECT -id AS merge, w, 1 / w AS density, l, r, size, least(ls, rs) AS small, ls >= 8 AND rs >= 8 AS splits FROM kr WHERE id < 0),
  large AS MATERIALIZED (SELECT * FROM merged WHERE size >= 8),
  down(merge, chain, parent, born) AS (SELECT merge, merge, NULL::BIGINT, 0.0::DOUBLE FROM large WHERE merge = (SELECT max(merge) FROM large) UNION ALL
    SELECT c.merge, CASE WHEN p.splits THEN c.merge ELSE d.chain END, CASE WHEN p.splits THEN d.chain ELSE d.parent END, CASE WHEN p.splits THEN p.density ELSE d.born END
    FROM down d JOIN large p ON p.merge = d.merge JOIN large c ON c.merge IN (p.l, p.r)),
  chains AS MATERIALIZED (SELECT chain, any_value(parent) AS parent, any_value(born) AS born, max(density) AS ends,
    sum(density * CASE WHEN merge = low THEN size ELSE small END) - max(size) * any_value(born) AS stability, any_value(low) AS low
    FROM (SELECT *, min(merge) OVER (PARTITION BY chain) AS low FROM down JOIN large USING (merge)) GROUP BY chain),
  turns AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY low) AS t FROM chains),
  up(chain, parent, best, takes, t) USING KEY (chain) AS (SELECT NULL::BIGINT, NULL::BIGINT, 0.0::DOUBLE, false, 0::BIGINT UNION
    SELECT c.chain, c.parent, CASE WHEN c.parent IS NOT NULL AND c.stability >= c.below THEN c.stability ELSE c.below END, c.parent IS NOT NULL AND c.stability >= c.below, c.t
    FROM (SELECT turns.*, coalesce((SELECT sum(k.best) FROM recurring.up k WHERE k.parent = turns.chain), 0) AS below FROM turns JOIN (SELECT max(t) + 1 AS t FROM up) cur USING (t)) c),
  named(chain, cluster) AS (SELECT chain, NULL::BIGINT FROM up WHERE parent IS NULL AND chain IS NOT NULL UNION ALL
    SELECT c.chain, coalesce(n.cluster, CASE WHEN c.takes THEN c.chain END) FROM named n JOIN up c ON c.parent = n.chain),
  above AS MATERIALIZED (SELECT unnest([l, r]) AS top, merge, size FROM merged),
  first AS MATERIALIZED (SELECT e.gene, min(e.n) AS merge FROM (SELECT a AS gene, n FROM tree UNION ALL SELECT b, n FROM tree) e GROUP BY e.gene),
  climb(gene, merge) AS (SELECT gene, merge FROM first UNION ALL SELECT c.gene, a.merge FROM climb c JOIN merged m USING (merge) JOIN above a ON a.top = c.merge WHERE m.size < 8),
  leaves AS (SELECT c.gene, m.merge, m.density FROM climb c JOIN merged m USING (merge) WHERE m.size >= 8)"""


@query("density_hierarchy", f"""WITH RECURSIVE {r.COUNTS}, {_PROFILE}, {_HIERARCHY},
  placed AS (SELECT gene, cluster, least(density, ends) / ends AS probability FROM leaves JOIN down USING (merge) JOIN named USING (chain) LEFT JOIN (SELECT chain AS cluster, ends FROM chains) USING (cluster)),
  sized AS (SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, min(low) DESC) - 1 AS number FROM placed JOIN (SELECT chain AS cluster, low FROM chains) USING (cluster) GROUP BY cluster)
  SELECT gene, coalesce(number, -1)::INTEGER AS cluster, round(coalesce(probability, 0), 6) AS probability FROM profile LEFT JOIN placed USING (gene) LEFT JOIN sized USING (cluster)""")
def _(spark, d):
    return rounded(cluster.hdbscan(_profiles(spark, d), "gene", min_cluster_size=8, min_samples=4, probabilities=True))


@query("cluster_sizes_by_label", """SELECT (row_number() OVER (ORDER BY count(*) DESC, label DESC) - 1)::INTEGER AS cluster, count(*)::BIGINT AS n FROM embeddings GROUP BY label""")
def _(spark, d):
    labels = r.table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    return cluster.sort_clusters(labels, "vec_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


_EMB = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings)"


@query("calinski_harabasz_score", f"""WITH {_EMB}, m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM e GROUP BY 1, 2), g AS (SELECT i, avg(x) AS g FROM e GROUP BY 1),
  w AS (SELECT sum((x-m)^2) AS w FROM e JOIN m USING (label, i)), b AS (SELECT sum(n*(m-g)^2) AS b FROM m JOIN g USING (i)), c AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings)
  SELECT round(b*(n-k)/(w*(k-1)),6) AS score FROM w, b, c""")
def _(spark, d):
    e = _embeddings(spark, d)
    score = cluster.calinski_harabasz(e, e.select("vec_id", F.col("label").alias("cluster")), "vec_id")
    return rounded(e.agg(F.lit(score).alias("score")))


@query("davies_bouldin_score", f"""WITH {_EMB}, m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2),
  dist AS (SELECT vec_id, label, sqrt(sum((x-m)^2)) AS dd FROM e JOIN m USING (label, i) GROUP BY 1, 2), s AS (SELECT label, avg(dd) AS s FROM dist GROUP BY 1),
  p AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m-b.m)^2)) AS dm FROM m a JOIN m b USING (i) WHERE a.label <> b.label GROUP BY 1, 2),
  q AS (SELECT a, max((sa.s+sb.s)/dm) AS mx FROM p JOIN s sa ON sa.label = a JOIN s sb ON sb.label = b GROUP BY 1) SELECT round(avg(mx),6) AS score FROM q""")
def _(spark, d):
    e = _embeddings(spark, d)
    score = cluster.davies_bouldin(e, e.select("vec_id", F.col("label").alias("cluster")), "vec_id")
    return rounded(e.agg(F.lit(score).alias("score")))


@query("bic_score", f"""WITH {_EMB}, m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2), c AS (SELECT label, count(DISTINCT vec_id)::DOUBLE AS n, sum((x-m)^2) AS ss FROM e JOIN m USING (label, i) GROUP BY 1),
  t AS (SELECT sum(n) AS t, count(*) AS k FROM c) SELECT round(sum(n*(ln(n)-ln(t)-32*ln(2*pi()*ss/(n-1))-(n-1)/2)) - (any_value(k)-1+64*any_value(k)+1)/2.0::DOUBLE*ln(any_value(t)),4) AS score FROM c, t""")
def _(spark, d):
    e = _embeddings(spark, d)
    score = cluster.bic(e, e.select("vec_id", F.col("label").alias("cluster")), "vec_id")
    return rounded(e.agg(F.lit(score).alias("score")), digits=4)


@query("silhouette_by_k", f"WITH {r.COUNTS} SELECT unnest(range(2, least(20, (SELECT count(*) FROM counts) // 4) + 1))::INTEGER AS k, true AS in_range, true AS best_is_highest, 1::BIGINT AS chosen")
def _(spark, d):
    scores = checkpoint(cluster.score_k(_profiles(spark, d), "gene", "silhouette", n_init=1, seed=1))
    top = scores.agg(F.max("score").alias("top"), F.sum(F.col("best").cast("long")).alias("chosen")).first()
    return scores.select("k", F.col("score").between(-1, 1).alias("in_range"), ((F.col("score") == top["top"]) == F.col("best")).alias("best_is_highest"),
                         F.lit(top["chosen"]).cast("long").alias("chosen"))


@query("gap_statistic", "SELECT unnest([1, 2, 3])::INTEGER AS k, true AS rule, 1::BIGINT AS chosen")
def _(spark, d):
    """The chosen K against the rule, worked out from the returned gaps and errors."""
    gaps = checkpoint(cluster.gap_statistic(r.event_counts(spark, d), "gene", r.EVENT_SAMPLES, 3, 2, seed=1))
    after = gaps.select((F.col("k") - 1).alias("k"), F.col("gap").alias("g1"), F.col("error").alias("e1"))
    good = gaps.join(after, "k", "left").withColumn("good", F.coalesce((F.col("k") > 1) & (F.col("gap") >= F.col("g1") - F.col("e1")), F.lit(False)))
    first = good.agg(F.coalesce(F.min(F.when(F.col("good"), F.col("k"))), F.max("k")).alias("first"), F.sum(F.col("best").cast("long")).alias("chosen")).first()
    return good.select("k", ((F.col("k") == first["first"]) == F.col("best")).alias("rule"), F.lit(first["chosen"]).cast("long").alias("chosen"))


def _solutions(spark, d):
    """Three groupings of parts that need no fitting: brand, type and size band."""
    part = r.table(spark, d, "part")
    size = F.floor(F.col("p_size") / 10).cast("string")
    return part.select(F.col("p_partkey").alias("gene"), F.inline(F.array(
        *[F.struct(F.lit(i).alias("solution"), c.alias("cluster")) for i, c in enumerate((F.col("p_brand"), F.col("p_type"), size))])))


_SOL = """sol AS (SELECT p_partkey AS gene, 0 AS solution, '0:' || p_brand AS c FROM part UNION ALL SELECT p_partkey, 1, '1:' || p_type FROM part
  UNION ALL SELECT p_partkey, 2, '2:' || CAST(CAST(floor(p_size/10) AS BIGINT) AS VARCHAR) FROM part)"""


@query("cluster_similarity", f"""WITH {_SOL}, ov AS (SELECT x.c AS a, y.c AS b, count(*) AS n, sum(3) AS mm FROM sol x JOIN sol y USING (gene) GROUP BY 1, 2),
  joint AS (SELECT p.a, q.a AS b, sum(p.n*q.n) AS j FROM ov p JOIN ov q ON p.b = q.b WHERE p.a < q.a GROUP BY 1, 2), sz AS (SELECT c, count(*) AS n FROM sol GROUP BY 1)
  SELECT joint.a, joint.b, round((j - coalesce(mm,0) + 3*coalesce(ov.n,0))/(3.0::DOUBLE*sa.n*sb.n),8) AS similarity FROM joint LEFT JOIN ov ON ov.a = joint.a AND ov.b = joint.b
  JOIN sz sa ON sa.c = joint.a JOIN sz sb ON sb.c = joint.b""")
def _(spark, d):
    return rounded(cluster.cluster_similarity(_solutions(spark, d), "gene"), digits=8)


@query("evidence_for_pairs", f"""WITH {_SOL}, pairs AS (SELECT DISTINCT p_partkey AS a, p_partkey + 25 AS b FROM part), s AS (SELECT a, b, count(*) AS n FROM pairs JOIN sol x ON x.gene = a
  JOIN sol y ON y.gene = b AND y.c = x.c GROUP BY 1, 2) SELECT a, b, round(coalesce(n,0)/3.0::DOUBLE,6) AS evidence FROM pairs LEFT JOIN s USING (a, b)""")
def _(spark, d):
    pairs = r.table(spark, d, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 25).alias("b"))
    return rounded(cluster.evidence_for_pairs(_solutions(spark, d), pairs, "gene"))


# five groupings of parts: brand, type, size (small sizes in none), and both words of the name
_FIVE = """five AS MATERIALIZED (SELECT p_partkey AS gene, p_brand AS s0, p_type AS s1, CASE WHEN p_size >= 10 THEN p_size END AS s2, split_part(p_name, ' ', 1) AS s3, split_part(p_name, ' ', 2) AS s4 FROM part)"""
_SAME = " + ".join(f"coalesce((x.s{i} = y.s{i})::INT, 0)" for i in range(5))


@query("consensus_features", f"""WITH RECURSIVE {_FIVE}, core AS (SELECT gene FROM five WHERE {" + ".join(f"(s{i} IS NOT NULL)::INT" for i in range(5))} >= 4),
  {_components(f"SELECT x.gene AS a, y.gene AS b FROM five x JOIN five y ON x.gene <> y.gene AND {_SAME} >= 4")},
  sized AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component DESC) - 1 AS cluster FROM comp GROUP BY component HAVING count(*) >= 2)
  SELECT gene, coalesce(cluster, -1)::INTEGER AS cluster FROM five LEFT JOIN comp USING (gene) LEFT JOIN sized USING (component)""")
def _(spark, d):
    """Parts that agree in four groupings of five, and what they are linked to."""
    part = r.table(spark, d, "part")
    word = F.split("p_name", " ")
    columns = (F.col("p_brand"), F.col("p_type"), F.when(F.col("p_size") >= 10, F.col("p_size").cast("string")), word[0], F.get(word, F.lit(1)))
    solutions = part.select(F.col("p_partkey").alias("gene"), F.inline(F.array(
        *[F.struct(F.lit(i).alias("solution"), c.alias("cluster")) for i, c in enumerate(columns)]))).filter("cluster IS NOT NULL")
    return cluster.consensus(solutions, "gene", 0.8, min_cluster_size=2, by="feature")


@query("consensus_clusters", f"WITH {r.COUNTS} SELECT count(*)::BIGINT AS rows, true AS large_enough, true AS by_size FROM counts")
def _(spark, d):
    setups = cluster.expand_setups([{"method": "kmeans", "n_clusters": [2, 3]}, {"method": "hierarchical", "n_clusters": 3},
                                    {"method": "hdbscan", "eps": 0.9, "min_samples": 5, "min_cluster_size": 10}], [False])
    solutions = cluster.run_setups(r.matrix(spark, d), "gene", setups, [S])
    sizes = cluster.consensus(solutions, "gene", 0.5, min_cluster_size=5).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("cluster") >= 0
    return sizes.agg(F.sum("n").alias("rows"), F.bool_and(~named | (F.col("n") >= 5)).alias("large_enough"), F.coalesce(
        F.max(F.when(named, F.struct("n", (-F.col("cluster")).alias("c"))))["c"] == 0, F.lit(True)).alias("by_size"))


@query("cluster_profiles", f"""WITH {_EMB} SELECT label AS cluster, 'd' || i AS sample, round(avg(x),6)+0.0 AS mean, round(stddev_samp(x),6) AS std FROM e GROUP BY 1, 2""")
def _(spark, d):
    e = _embeddings(spark, d)
    labels = e.select("vec_id", F.col("label").alias("cluster"))
    return rounded(cluster.cluster_profiles(e, labels, "vec_id", [f"d{i}" for i in range(64)]))


@query("cluster_projection", f"""WITH {r.COUNTS} SELECT count(*)::BIGINT AS rows, 3::BIGINT AS clusters, true AS uncorrelated, true AS first_is_widest, true AS inside FROM counts""")
def _(spark, d):
    """Both axes are uncorrelated, the first is the widest, and neither is wider than all six standardised samples together."""
    p = _profiles(spark, d)
    out = cluster.clustered_projection(p, cluster.kmeans(p, "gene", 3), "gene")
    return out.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("cluster").alias("clusters"), (F.abs(F.corr("pc1", "pc2")) < 1e-6).alias("uncorrelated"),
                   (F.var_pop("pc1") >= F.var_pop("pc2")).alias("first_is_widest"), (F.var_pop("pc1") + F.var_pop("pc2") <= 6 + 1e-9).alias("inside"))


@query("clustergram", f"""WITH {r.COUNTS}, l AS (SELECT gene, {", ".join(f"log2({c}+1) AS {c}" for c in S)} FROM counts), m AS (SELECT *, ({"+".join(S)})/6 AS m FROM l),
  s AS (SELECT *, sqrt(({"+".join(f"({c}-m)^2" for c in S)})/5) AS s FROM m) SELECT gene, {", ".join(f"round(({c}-m)/s,6)+0.0 AS {c}" for c in S)} FROM s""")
def _(spark, d):
    return rounded(cluster.clustergram(r.counts(spark, d), "gene", S, True))


# --- principal components ------------------------------------------------------------------------------------------------------

_Z = f"""z AS (SELECT gene, {", ".join(f"CASE WHEN s > 0 THEN ({c}-m)/s ELSE 0 END AS {c}" for c in S)} FROM (SELECT *, sqrt(({"+".join(f"({c}-m)^2" for c in S)})/6) AS s FROM
  (SELECT *, ({"+".join(S)})/6 AS m FROM counts)))"""


@query("pca_gram_matrix", f"WITH {r.COUNTS}, {_Z} SELECT " + ", ".join(f"round(sum({a}*{b}),4)+0.0 AS {a}_{b}" for i, a in enumerate(S) for b in S[i:]) + " FROM z")
def _(spark, d):
    rows = checkpoint(pca.standardized_rows(r.counts(spark, d), "gene", S, False))
    g = pca.gram_matrix(rows, len(S))
    out = rows.agg(*[F.lit(float(g[i, j])).alias(f"{a}_{S[j]}") for i, a in enumerate(S) for j in range(i, len(S))])
    return rounded(out, digits=4)


@query("pca_scores", f"WITH {r.COUNTS}, {_Z} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a}*{b}),4)+0.0 AS product FROM z" for i, a in enumerate(S) for b in S[i:]))
def _(spark, d):
    """Scores in all components have the inner products of the standardised samples."""
    t = pca.PCA(r.counts(spark, d), "gene", S, False).scores(6)
    left, right = (t.select(F.col("sample").alias(n), F.array(*[f"PC{i}" for i in range(1, 7)]).alias(f"s{n}")) for n in "ab")
    pairs = left.withColumn("j", F.lit(1)).join(right.withColumn("j", F.lit(1)), "j")
    order = F.create_map(*[F.lit(x) for i, s in enumerate(S) for x in (s, i)])
    return rounded(pairs.filter(F.element_at(order, F.col("a")) <= F.element_at(order, F.col("b"))).select(
        "a", "b", arrays.total(F.zip_with("sa", "sb", lambda x, y: x * y)).alias("product")), digits=4)


_GRAM = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, sum({a}*{b}) AS g FROM z" for a in S for b in S)


@query("pca_explained_variance", f"""WITH {r.COUNTS}, {_Z}, g AS ({_GRAM}) SELECT 6::BIGINT AS components, 100.0::DOUBLE AS total,
  round(10000 * sum(g*g) / sum(CASE WHEN a = b THEN g END)^2, 6) AS squares, true AS falls FROM g""")
def _(spark, d):
    """Shares add up to 100, and their squares to those of the Gram matrix."""
    e = pca.PCA(r.counts(spark, d), "gene", S, False).explained()
    return rounded(e.agg(F.count(F.lit(1)).alias("components"), F.sum("percent").alias("total"), F.sum(F.col("percent") * F.col("percent")).alias("squares"),
                         (F.corr("component", "percent") < 0).alias("falls")))


@query("sort_by_principal_component", f"WITH {r.COUNTS} SELECT count(*)::BIGINT AS rows, 1.0::DOUBLE AS length, true AS ascending FROM counts")
def _(spark, d):
    """Loadings are a unit vector and rise from row to row of the sorted table."""
    m = r.matrix(spark, d)
    weights = pca.PCA(m, "gene", S, False).loadings([1])
    ordered = pca.sort_by_principal_component(m, "gene", S, 1, power_transform=False).select("gene").withColumn("place", F.monotonically_increasing_id())
    rows = checkpoint(ordered).join(weights, "gene")
    ranked = ranking.row_numbers(rows, [], ["PC1", "gene"], "n").select("place", "n")
    placed = ranking.row_numbers(ranked, [], ["place"], "m")
    size = rows.agg(F.sum(F.col("PC1") * F.col("PC1"))).first()[0]
    return rounded(placed.agg(F.count(F.lit(1)).alias("rows"), F.lit(size).alias("length"), F.bool_and(F.col("n") == F.col("m")).alias("ascending")))


@query("split_by_principal_components", f"""WITH {r.COUNTS} SELECT unnest([1, 1, 2, 2])::INTEGER AS component, unnest(['top', 'bottom', 'top', 'bottom']) AS side,
  floor(0.1 * (SELECT count(*) FROM counts) * 0.5)::BIGINT AS n, true AS extreme""")
def _(spark, d):
    """No row left out is more extreme than one that was picked."""
    m = r.matrix(spark, d)
    picked = checkpoint(pca.split_by_principal_components(m, "gene", S, (1, 2), 0.1).select("gene", "component", "side"))
    weights = checkpoint(pca.PCA(m, "gene", S).loadings((1, 2)).select("gene", F.inline(F.array(*[
        F.struct(F.lit(c).alias("component"), F.lit(s).alias("side"), (F.col(f"PC{c}") * (1 if s == "top" else -1)).alias("w")) for c in (1, 2) for s in ("top", "bottom")]))))
    rows = weights.join(picked.withColumn("in", F.lit(True)), ["gene", "component", "side"], "left")
    return rows.groupBy("component", "side").agg(F.count("in").alias("n"), (F.min(F.when(F.col("in"), F.col("w"))) >= F.max(
        F.when(F.col("in").isNull(), F.col("w")))).alias("extreme"))
