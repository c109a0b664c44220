"""Readers, writers, pipelines and plug-ins: files are written from the bundled tables and read back by the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrichment, sets
from ..session import shared_path
from ..sources import annotations as ann
from ..sources import reads as sam
from ..sources import tables as files
from ..table import CountTable, FeatureSet, FeatureTable, RankedSet
from . import chain
from . import relations as r
from .registry import query, rounded

S = r.SAMPLES


def _written(df, name, header=True, sep="\t"):
    """The path of ``df`` as delimited text, a folder of part files."""
    path = shared_path(df.sparkSession, name)
    df.write.option("header", header).option("sep", sep).option("emptyValue", "").csv(path)
    return path


def _lines(df, name, end="\n"):
    path = shared_path(df.sparkSession, name)
    df.write.option("lineSep", end).text(path)
    return path


# --- tables ------------------------------------------------------------------------------------------------------------

def _messy(spark, d):
    part = r.table(spark, d, "part")
    size = F.when(F.col("p_size") % 5 == 0, "NA").when(F.col("p_size") % 5 == 1, " nan ").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string")))
    return part.select(F.col("p_partkey").cast("string").alias("gene"), F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("brand"),
                       size.alias("size"), F.when(F.col("p_size") > 25, "").otherwise(F.col("p_retailprice").cast("string")).alias("price"))


_MESSY = """SELECT p_partkey::BIGINT AS gene, p_brand AS brand, CASE WHEN p_size % 5 > 1 THEN p_size END::BIGINT AS size,
  CASE WHEN p_size <= 25 THEN p_retailprice END::DOUBLE AS price FROM part"""


@query("load_csv", _MESSY)
def _(spark, d):
    return files.load_table(spark, _written(_messy(spark, d), "parts.csv", sep=","))


@query("load_sniffed_text", _MESSY)
def _(spark, d):
    return files.load_table(spark, _written(_messy(spark, d), "parts.txt", sep=";"))


@query("load_missing_cells", f"SELECT count(*)::BIGINT AS rows, count(size)::BIGINT AS sizes, count(price)::BIGINT AS prices, count(DISTINCT brand)::BIGINT AS brands FROM ({_MESSY})")
def _(spark, d):
    t = files.load_table(spark, _written(_messy(spark, d), "parts.tsv"))
    return t.agg(F.count(F.lit(1)).alias("rows"), F.count("size").alias("sizes"), F.count("price").alias("prices"), F.countDistinct("brand").alias("brands"))


@query("load_parquet_index", "SELECT p_partkey AS key, p_size AS size FROM part")
def _(spark, d):
    path = shared_path(spark, "parts.parquet")
    r.table(spark, d, "part").select(F.col("p_size").alias("size"), F.col("p_partkey").alias("__index_level_0__")).write.parquet(path)
    return files.load_table(spark, path)


@query("load_drop_columns", f"SELECT gene, size FROM ({_MESSY})")
def _(spark, d):
    return files.load_table(spark, _written(_messy(spark, d), "parts.csv", sep=","), ["brand", " price"])


@query("save_table_round_trip", f"WITH {r.COUNTS} SELECT gene, {', '.join(S)} FROM counts")
def _(spark, d):
    c = r.counts(spark, d)
    text = files.load_table(spark, files.save_table(c, shared_path(spark, "counts.tsv"), "_saved"))
    stored = files.load_table(spark, files.save_table(c, shared_path(spark, "counts.parquet")))
    same = text.select("gene", *[F.col(s).cast("double").alias(s) for s in S])
    return stored.join(same, ["gene", *S])


def _count_folder(spark, d, header):
    counts, folder = r.matrix(spark, d), shared_path(spark, "counts")
    for s in S:
        rows = counts.select(F.col("gene").cast("string").alias("gene"), F.col(s).cast("long").alias("n"))
        if not header:
            extra = counts.agg(F.lit("__no_feature").alias("gene"), F.sum(F.col(s)).cast("long").alias("n"))
            rows = rows.union(extra)
        rows.write.option("header", header).option("sep", "\t").csv(f"{folder}/{s}.txt")
    return folder


@query("read_count_folder", f"WITH {r.COUNTS} SELECT gene::VARCHAR AS key, {', '.join(S)} FROM counts")
def _(spark, d):
    return files.read_count_folder(spark, _count_folder(spark, d, True))


@query("read_htseq_folder", f"""WITH {r.COUNTS} SELECT false AS special, gene::VARCHAR AS key, {', '.join(S)} FROM counts
  UNION ALL SELECT true, '__no_feature', {', '.join(f'sum({s})' for s in S)} FROM counts""")
def _(spark, d):
    features, special = files.read_htseq_folder(spark, _count_folder(spark, d, False))
    return features.select(F.lit(False).alias("special"), "*").union(special.select(F.lit(True), "*"))


@query("read_abundance_folder", f"""WITH {r.COUNTS} SELECT gene::VARCHAR AS target_id, {', '.join(f"{s} AS n_{s}" for s in S)}, {', '.join(f"{s} / 2 AS t_{s}" for s in S)} FROM counts""")
def _(spark, d):
    counts, folder = r.matrix(spark, d), shared_path(spark, "quant")
    for s in S:
        counts.select(F.col("gene").alias("target_id"), F.lit(100).alias("length"), F.lit(90.0).alias("eff_length"), F.col(s).alias("est_counts"),
                      (F.col(s) / 2).alias("tpm")).write.option("header", True).option("sep", "\t").csv(f"{folder}/{s}/abundance.tsv")
    n, t = files.read_abundance_folder(spark, folder)
    return n.select("target_id", *[F.col(s).alias(f"n_{s}") for s in S]).join(t.select("target_id", *[F.col(s).alias(f"t_{s}") for s in S]), "target_id")


@query("rename_count_output", f"WITH {r.COUNTS} SELECT gene, a_f AS first, a_o AS second, 'x' AS kind, sum(a_f) OVER () AS first_total FROM counts")
def _(spark, d):
    c = r.matrix(spark, d).select("gene", "a_f", "a_o")
    stats_table = c.agg(F.lit(1).alias("i"), F.lit("x").alias("kind"), F.sum("a_f").alias("p"), F.sum("a_o").alias("q"))
    named, annotation, totals = files.rename_count_output(c, c.select(F.lit(0).alias("i"), "gene"), stats_table.select("i", "kind", "p", "q"), ["first", "second"])
    return named.join(annotation, "gene").join(F.broadcast(totals.select("kind", F.col("first").alias("first_total"))))


@query("write_id_list", f"WITH {r.COUNTS} SELECT gene::VARCHAR AS value FROM counts")
def _(spark, d):
    path = shared_path(spark, "ids.txt")
    files.write_id_list(r.counts(spark, d), "gene", path)
    return spark.read.text(path)


@query("table_from_dataframe", f"WITH {r.COUNTS} SELECT gene, a_f FROM counts WHERE a_f > 100")
def _(spark, d):
    return FeatureTable.from_dataframe(r.counts(spark, d).select("gene", "a_f"), "gene").number_filters("a_f", "gt", 100).df


# --- ontologies, annotations, pathways -------------------------------------------------------------------------------------

def _obo(spark, d):
    n = r.table(spark, d, "nation")
    go = lambda c, base: F.concat(F.lit("GO:"), F.lpad((c + base).cast("string"), 7, "0"))
    nations = n.select(F.concat(
        F.lit("[Term]\nid: "), go(F.col("n_nationkey"), 100), F.lit("\nname: "), "n_name", F.lit("\nnamespace: trade\nalt_id: "), go(F.col("n_nationkey"), 900),
        F.lit("\nis_a: "), go(F.col("n_regionkey"), 10), F.lit(" ! region\nrelationship: part_of "), go(F.lit(0), 1),
        F.when(F.col("n_nationkey") % 7 == 3, "\nis_obsolete: true").otherwise("")).alias("value"))
    regions = r.table(spark, d, "region").select(F.concat(F.lit("[Term]\nid: "), go(F.col("r_regionkey"), 10), F.lit("\nname: "), "r_name", F.lit("\nnamespace: trade")).alias("value"))
    return ann.read_obo(spark, _lines(nations.union(regions), "trade.obo", "\n\n"))


_GO = "'GO:' || lpad(({})::VARCHAR, 7, '0')"
_LIVE = "(SELECT * FROM nation WHERE n_nationkey % 7 <> 3)"


@query("read_obo_terms", f"""SELECT {_GO.format('n_nationkey+100')} AS term, n_name AS name, 'trade' AS namespace FROM {_LIVE}
  UNION ALL SELECT {_GO.format('r_regionkey+10')}, r_name, 'trade' FROM region""")
def _(spark, d):
    return _obo(spark, d)[0]


@query("read_obo_edges", f"""SELECT {_GO.format('n_nationkey+100')} AS child, {_GO.format('n_regionkey+10')} AS parent, 'is_a' AS rel FROM {_LIVE}
  UNION ALL SELECT {_GO.format('n_nationkey+100')}, 'GO:0000001', 'part_of' FROM {_LIVE}""")
def _(spark, d):
    return _obo(spark, d)[1]


@query("read_obo_alternatives", f"SELECT {_GO.format('n_nationkey+900')} AS alt_id, {_GO.format('n_nationkey+100')} AS term FROM {_LIVE}")
def _(spark, d):
    return _obo(spark, d)[2]


def _annotation_rows(spark, d):
    li = r.table(spark, d, "lineitem")
    pick = lambda column, *names: F.get(F.array(*[F.lit(n) for n in names]), F.pmod(F.col(column), F.lit(len(names))).cast("int"))
    return li.select(F.col("l_suppkey").cast("string").alias("annotation_class"), F.col("l_partkey").cast("string").alias("bioentity_internal_id"),
                     pick("l_suppkey", "WB", "UniProt", "Other").alias("source"), pick("l_linenumber", "P", "F", "C").alias("aspect"),
                     pick("l_orderkey", "IDA", "IEA", "ISS", "TAS").alias("evidence_type"),
                     F.when(F.col("l_quantity") < 5, "not").when(F.col("l_quantity") < 10, "contributes_to").alias("qualifier"), "l_orderkey")


_ANN = """ann AS (SELECT l_suppkey::VARCHAR AS term, l_partkey::VARCHAR AS key, ['WB','UniProt','Other'][l_suppkey % 3 + 1] AS source, ['P','F','C'][l_linenumber % 3 + 1] AS aspect,
  ['IDA','IEA','ISS','TAS'][l_orderkey % 4 + 1] AS evidence_type, CASE WHEN l_quantity < 5 THEN 'not' WHEN l_quantity < 10 THEN 'contributes_to' END AS qualifier FROM lineitem)"""


@query("read_annotation_responses", f"WITH {_ANN} SELECT source, aspect, count(*)::BIGINT AS n, count(DISTINCT term)::BIGINT AS terms, count(qualifier)::BIGINT AS qualified FROM ann GROUP BY 1, 2")
def _(spark, d):
    docs = _annotation_rows(spark, d)
    page = docs.groupBy("l_orderkey").agg(F.collect_list(F.struct(*docs.columns[:-1])).alias("docs"))  # an order has seven lines at most
    responses = page.select(F.to_json(F.struct(F.struct("docs").alias("response"))).alias("value"))
    return ann.parse_annotation_responses(responses).groupBy("source", "aspect").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("terms"), F.count("qualifier").alias("qualified"))


@query("select_annotations", f"""WITH {_ANN} SELECT term, key, count(*)::BIGINT AS n FROM ann WHERE aspect IN ('P', 'C') AND evidence_type IN ('IDA', 'ISS', 'TAS')
  AND source <> 'Other' AND coalesce(qualifier, '') <> 'not' GROUP BY 1, 2""")
def _(spark, d):
    rows = _annotation_rows(spark, d).withColumnsRenamed({"annotation_class": "term", "bioentity_internal_id": "key"})
    kept = ann.select_annotations(rows, ["biological process", "C"], excluded_evidence="electronic", excluded_databases=["Other"])
    return kept.groupBy("term", "key").agg(F.count(F.lit(1)).alias("n"))


@query("read_pathway_entries", "SELECT DISTINCT 'P' || s_nationkey AS pathway, 'org:' || s_suppkey AS key FROM supplier")
def _(spark, d):
    entry = r.table(spark, d, "supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 16).alias("part")).agg(F.concat_ws("\n            ", F.collect_list(
        F.concat(F.col("s_suppkey").cast("string"), F.lit("  name; "), "s_name"))).alias("genes"))
    text = entry.select(F.concat(F.lit("       P"), F.col("s_nationkey").cast("string"), F.lit("  Pathway\nNAME        n\nGENE        "), "genes", F.lit("\nCOMPOUND    C1\n///\n")).alias("value"))
    return ann.read_pathway_entries(spark, _lines(text, "pathways", "ENTRY"), "org")


@query("read_pathway_names", "SELECT 'P' || n_nationkey AS pathway, n_name AS name FROM nation")
def _(spark, d):
    n = r.table(spark, d, "nation")
    return ann.read_pathway_names(spark, _written(n.select(F.concat(F.lit("path:P"), "n_nationkey").alias("a"), "n_name"), "names.tsv", False))


@query("read_compound_names", "SELECT 'C' || n_nationkey AS compound, n_name AS name FROM nation")
def _(spark, d):
    n = r.table(spark, d, "nation")
    return ann.read_compound_names(spark, _written(n.select(F.concat(F.lit("cpd:C"), "n_nationkey").alias("a"), F.concat("n_name", F.lit("; other"))), "compounds.tsv", False))


@query("read_kgml_nodes", """SELECT s_suppkey AS entry, s_name AS name, 'gene' AS kind, ['g' || s_suppkey, 'h' || s_suppkey] AS members FROM supplier""")
def _(spark, d):
    return _kgml(spark, d)[0].select("entry", "name", "kind", "members")


@query("read_kgml_edges", """SELECT s_suppkey AS source, (s_suppkey * 7 % 10 + 1)::BIGINT AS target, CASE s_nationkey % 3 WHEN 0 THEN 'activation' WHEN 1 THEN 'inhibition' ELSE 'unknown' END AS relation,
  CASE s_nationkey % 3 WHEN 0 THEN '-->' WHEN 1 THEN '--|' ELSE '?' END AS symbol FROM supplier""")
def _(spark, d):
    return _kgml(spark, d)[1]


def _kgml(spark, d):
    s = r.table(spark, d, "supplier")
    i = F.col("s_suppkey").cast("string")
    entry = F.format_string('<entry id="%s" name="g%s h%s" type="gene"><graphics name="%s, more"/></entry>', i, i, i, "s_name")
    kind = F.get(F.array(F.lit('<subtype name="activation" value="--&gt;"/>'), F.lit('<subtype name="inhibition" value="--|"/>'), F.lit("")), (F.col("s_nationkey") % 3).cast("int"))
    relation = F.format_string('<relation entry1="%s" entry2="%s" type="PPrel">%s</relation>', i, (F.col("s_suppkey") * 7 % 10 + 1).cast("string"), kind)
    path = shared_path(spark, "pathways")
    part = (F.col("s_suppkey") % (s.count() // 16 + 1)).alias("part")
    documents = s.select(part, F.concat(entry, relation).alias("x")).groupBy("part").agg(F.concat(
        F.lit("<pathway>"), F.array_join(F.collect_list("x"), ""), F.lit("</pathway>")).alias("value"))  # about 16 entries each
    documents.repartition("part").write.partitionBy("part").text(path)
    return ann.read_pathway_graph(spark, path)


@query("read_id_mapping", "SELECT p_partkey::VARCHAR AS from_id, p_brand AS to_id, CASE WHEN p_size % 4 = 0 THEN 0.0 ELSE p_size END::DOUBLE AS score FROM part")
def _(spark, d):
    p = r.table(spark, d, "part").select(F.col("p_partkey").alias("From"), F.col("p_brand").alias("Entry"),
                                         F.when(F.col("p_size") % 4 == 0, "none").otherwise(F.col("p_size").cast("string")).alias("Annotation"))
    return ann.read_id_mapping(spark, _written(p, "map.tsv"))


@query("read_protein_orthologs", "SELECT p_partkey::VARCHAR AS from_id, p_brand AS to_id, p_size::DOUBLE AS score FROM part WHERE p_size % 3 = 1")
def _(spark, d):
    p = r.table(spark, d, "part").select(F.col("p_partkey").alias("protid1"), F.col("p_brand").alias("protid2"), F.col("p_size").alias("CS"), (F.col("p_size") % 3).alias("taxid2"))
    return ann.read_protein_orthologs(spark, _written(p, "orthologs.tsv"), 1)


@query("read_ortholog_groups", "SELECT ['one-to-one', 'one-to-many'][p_size % 2 + 1] AS type, [p_brand, p_type] AS orthologs, [p_partkey::VARCHAR] AS inparalogs FROM part")
def _(spark, d):
    p = r.table(spark, d, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "one-to-one").otherwise("one-to-many").alias("type")
    rows = p.select(kind, F.array("p_brand", "p_type").alias("orthologs"), F.array(F.col("p_partkey").cast("string")).alias("inparalogs"))
    return ann.read_ortholog_groups(spark, _lines(rows.select(F.to_json(F.struct("*")).alias("value")), "groups.json"))


# --- reads ------------------------------------------------------------------------------------------------------------------

def _mates(spark, d):
    li = r.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("sample"), F.concat_ws(":", *[F.col(c).cast("int").cast("string") for c in (
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")]).alias("read_id"), F.col("l_quantity").cast("int").alias("n"))
    one = li.select("sample", F.concat("read_id", F.lit("/1")).alias("read_id"), F.repeat(F.lit("A"), F.col("n")).alias("seq"), F.repeat(F.lit("I"), F.col("n")).alias("qual"))
    two = li.select("sample", F.concat("read_id", F.lit("/2")).alias("read_id"), F.repeat(F.lit("C"), F.col("n") + 1).alias("seq"), F.repeat(F.lit("H"), F.col("n") + 1).alias("qual"))
    return one, two


_PAIRS = "m AS (SELECT DISTINCT l_returnflag AS sample, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_quantity::INTEGER AS read_id, l_quantity::INTEGER AS n FROM lineitem)"


@query("fastq_to_sam_paired", f"WITH {_PAIRS} SELECT sample, read_id AS qname, 77 AS flag, repeat('A', n) AS seq, repeat('I', n) AS qual FROM m UNION ALL SELECT sample, read_id, 141, repeat('C', n+1), repeat('H', n+1) FROM m")
def _(spark, d):
    return sam.fastq_to_sam_paired(*[m.distinct() for m in _mates(spark, d)]).select("sample", "qname", "flag", "seq", "qual")


@query("sam_to_fastq_paired", f"WITH {_PAIRS} SELECT 1 AS mate, sample, read_id, repeat('A', n) AS seq, repeat('I', n) AS qual FROM m UNION ALL SELECT 2, sample, read_id, repeat('C', n+1), repeat('H', n+1) FROM m")
def _(spark, d):
    first, second = sam.sam_to_fastq_paired(sam.fastq_to_sam_paired(*[m.distinct() for m in _mates(spark, d)]))
    return first.select(F.lit(1).alias("mate"), "*").union(second.select(F.lit(2), "*"))


@query("read_pipeline", """SELECT l_returnflag AS sample, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_quantity::INTEGER || '/1' AS read_id, repeat('A', l_quantity::INTEGER) AS seq, repeat('I', l_quantity::INTEGER) AS qual
  FROM lineitem WHERE l_quantity::INTEGER BETWEEN 20 AND 40""")
def _(spark, d):
    steps = chain.ReadPipeline().add_function("trim_quality", cutoff=20).add_function("filter_length", minimum=20, maximum=40)
    return steps.apply_to(_mates(spark, d)[0])[0]


# --- sets, pipelines, plug-ins -------------------------------------------------------------------------------------------------

@query("intersection_of_nonempty_sets", f"WITH {r.COUNTS} SELECT gene FROM counts WHERE a_f > 100 AND a_o > 100")
def _(spark, d):
    c = r.matrix(spark, d)
    return sets.intersection_nonempty([c.filter("a_f > 100").select("gene"), c.filter("a_f < 0").select("gene"), c.filter("a_o > 100").select("gene")], "gene")


@query("ranked_set_algebra", f"WITH {r.COUNTS} SELECT gene FROM counts WHERE a_f > 100 AND a_o <= 100")
def _(spark, d):
    c = r.matrix(spark, d)
    ranked = RankedSet(c.filter("a_f > 100").select("gene", F.col("a_f").alias("rank")), "gene")
    return ranked.difference(FeatureSet(c.filter("a_o > 100").select("gene"), "gene")).df.select("gene")


_PIPE = f"WITH {r.COUNTS} SELECT gene, {', '.join(f'round({s} * 1e6 / sum({s}) OVER (), 6) AS {s}' for s in S)} FROM counts"


def _pipeline():
    return chain.Pipeline("CountTable").add_function("normalize_to_rpm").add_function("filter_low_reads", threshold=600, n_samples=2)


@query("table_pipeline", f"SELECT * FROM ({_PIPE}) WHERE {' + '.join(f'({s} >= 600)::INTEGER' for s in S)} >= 2")
def _(spark, d):
    result = _pipeline().apply_to(CountTable(r.matrix(spark, d), "gene"))
    return rounded((result[0] if isinstance(result, tuple) else result).df)


@query("imported_pipeline", f"SELECT * FROM ({_PIPE}) WHERE {' + '.join(f'({s} >= 600)::INTEGER' for s in S)} >= 2")
def _(spark, d):
    result = chain.Pipeline.import_pipeline(_pipeline().export_pipeline()).apply_to(CountTable(r.matrix(spark, d), "gene"))
    return rounded((result[0] if isinstance(result, tuple) else result).df)


def _share(population: int, draws: int, successes: int, hits: int) -> float:
    return 1 - hits / draws if draws else 1.0


@query("enrichment_plugged_test", f"""WITH {r.COUNTS}, {r.ATTRIBUTES}, {r.TARGETS}, bg AS (SELECT DISTINCT gene FROM attrs), t AS (SELECT DISTINCT set_id, gene FROM targets WHERE gene IN (FROM bg)),
  z AS (SELECT set_id, count(*) AS draws FROM t GROUP BY 1), h AS (SELECT set_id, attribute, count(*) AS hits FROM t JOIN (SELECT DISTINCT * FROM attrs) USING (gene) GROUP BY 1, 2)
  SELECT set_id, attribute AS name, round(1 - coalesce(hits, 0) / draws::DOUBLE, 6) AS pval FROM (SELECT DISTINCT attribute FROM attrs) CROSS JOIN z LEFT JOIN h USING (set_id, attribute)""")
def _(spark, d):
    enrichment.register_test("share_outside", _share)
    return rounded(enrichment.enrichment(r.attributes(spark, d), r.target_sets(spark, d), "gene", test="share_outside").select("set_id", "name", "pval"))
