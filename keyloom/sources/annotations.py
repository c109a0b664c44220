"""Ontology, annotation, pathway and ID-mapping files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Evidence codes by group, and aspect codes, as published by the Gene Ontology.
EVIDENCE_GROUPS = {
    "experimental": ("EXP", "HDA", "HEP", "HGI", "HMP", "HTP", "IDA", "IEP", "IGI", "IMP", "IPI"),
    "phylogenetic": ("IBA", "IBD", "IKR", "IRD"),
    "computational": ("IGC", "ISA", "ISM", "ISO", "ISS", "RCA"),
    "author": ("NAS", "TAS"),
    "curator": ("IC", "ND"),
    "electronic": ("IEA",),
}
ASPECTS = {"biological_process": "P", "molecular_function": "F", "cellular_component": "C"}
QUALIFIERS = ("not", "contributes_to", "colocalizes_with")
GO_ID = r"GO:[0-9]{7}"


# --- ontology ---------------------------------------------------------------------------------------------------

def parse_stanzas(stanzas: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """OBO term stanzas (one per row) to nodes (term, name, namespace), edges (child, parent, rel) and
    alternatives (alt_id, term). Obsolete terms are dropped."""
    text = F.col(value)

    def field(tag: str) -> Column:
        found = F.regexp_extract(text, rf"(?m)^{tag}: *(.*?) *$", 1)
        return F.when(found != "", found)

    terms = stanzas.filter(text.rlike(r"(?m)^\s*\[Term\]") & ~text.rlike(r"(?m)^is_obsolete: true")).select(
        F.regexp_extract(text, rf"(?m)^id: *({GO_ID})", 1).alias("term"), field("name").alias("name"),
        field("namespace").alias("namespace"), text.alias("__text")).filter("term <> ''")
    body = F.col("__text")
    is_a = F.transform(F.regexp_extract_all(body, F.lit(rf"(?m)^is_a: .*?({GO_ID})"), F.lit(1)),
                       lambda p: F.struct(p.alias("parent"), F.lit("is_a").alias("rel")))
    pattern = F.lit(rf"(?m)^relationship: (\S+) .*?({GO_ID})")
    other = F.transform(F.arrays_zip(F.regexp_extract_all(body, pattern, F.lit(2)).alias("p"),
                                     F.regexp_extract_all(body, pattern, F.lit(1)).alias("r")),
                        lambda e: F.struct(e["p"].alias("parent"), e["r"].alias("rel")))
    edges = terms.select(F.col("term").alias("child"), F.inline(F.concat(is_a, other)))
    alternatives = terms.select(
        F.explode(F.regexp_extract_all(body, F.lit(rf"(?m)^alt_id: .*?({GO_ID})"), F.lit(1))).alias("alt_id"), "term")
    return terms.drop("__text"), edges, alternatives


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_stanzas(spark.read.option("lineSep", "\n\n").text(path))


# --- gene annotations -----------------------------------------------------------------------------------------------

def read_annotation_responses(spark: SparkSession, path: str) -> DataFrame:
    """Saved search responses (``response.docs[]``), one per file, to (term, key, source, aspect, evidence_type, qualifier)."""
    return parse_annotation_responses(spark.read.option("wholetext", True).text(path))


def parse_annotation_responses(texts: DataFrame, value: str = "value") -> DataFrame:
    """One response per row, so that a response split into many is read by many tasks."""
    fields = "annotation_class:string,bioentity_internal_id:string,source:string,aspect:string,evidence_type:string,qualifier:string"
    docs = texts.select(F.from_json(value, f"response struct<docs:array<struct<{fields}>>>").alias("r")).select(F.inline("r.response.docs"))
    return docs.withColumnsRenamed({"annotation_class": "term", "bioentity_internal_id": "key"})


def evidence_codes(types: str | Iterable[str] | None) -> list[str]:
    """Group names (such as ``experimental``) expand to codes; ``any`` is every code."""
    if types is None:
        return []
    if types == "any":
        return [code for codes in EVIDENCE_GROUPS.values() for code in codes]
    names = [types] if isinstance(types, str) else list(types)
    return [code for name in names for code in EVIDENCE_GROUPS.get(name.lower(), (name,))]


def aspect_codes(aspects: str | Iterable[str]) -> list[str]:
    if aspects == "any":
        return list(ASPECTS.values())
    names = [aspects] if isinstance(aspects, str) else list(aspects)
    return [ASPECTS.get(name.lower().replace(" ", "_"), name) for name in names]


def select_annotations(annotations: DataFrame, aspects: str | Iterable[str] = "any",
                       evidence: str | Iterable[str] = "any", excluded_evidence: str | Iterable[str] | None = None,
                       databases: str | Iterable[str] = "any", excluded_databases: Iterable[str] = (),
                       qualifiers: str | Iterable[str] = "any", excluded_qualifiers: Iterable[str] = ("not",)) -> DataFrame:
    """Filter (aspect, evidence_type, source, qualifier) rows; each criterion has an exclude list."""
    keep = F.col("aspect").isin(aspect_codes(aspects)) & F.col("evidence_type").isin(evidence_codes(evidence))
    excluded = evidence_codes(excluded_evidence)
    if excluded:
        keep = keep & ~F.col("evidence_type").isin(excluded)
    for column, wanted, banned in (("source", databases, excluded_databases),
                                   ("qualifier", qualifiers, excluded_qualifiers)):
        if wanted != "any":
            keep = keep & F.col(column).isin([wanted] if isinstance(wanted, str) else list(wanted))
        banned = [banned] if isinstance(banned, str) else list(banned or ())
        if banned:
            keep = keep & ~F.coalesce(F.col(column).isin(banned), F.lit(False))
    return annotations.filter(keep)


# --- pathways ---------------------------------------------------------------------------------------------------------

def parse_pathway_entries(entries: DataFrame, organism: str, value: str = "value") -> DataFrame:
    """Flat-file entries (text after ``ENTRY``, one per row) to (pathway, key). Genes are read from the ``GENE``
    line up to the next section."""
    text = F.col(value)
    section = F.regexp_extract(text, r"(?ms)^GENE(.*?)(?=^\S|\z)", 1)
    lines = F.filter(F.transform(F.split(section, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return (entries.select(F.regexp_extract(text, r"^\s*(\S+)", 1).alias("pathway"), F.explode(lines).alias("line"))
            .select("pathway", F.concat(F.lit(f"{organism}:"), F.substring_index("line", " ", 1)).alias("key")).distinct())


def read_pathway_entries(spark: SparkSession, path: str, organism: str) -> DataFrame:
    entries = spark.read.option("lineSep", "ENTRY").text(path).filter(F.trim("value") != "")
    return parse_pathway_entries(entries, organism)


def read_pathway_names(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("sep", "\t").schema("pathway string, name string").csv(path)
    return raw.select(F.regexp_replace("pathway", "^path:", "").alias("pathway"), "name")


def read_compound_names(spark: SparkSession, path: str) -> DataFrame:
    """Tab table of compound codes and their names (main name first): (compound, name)."""
    raw = spark.read.option("sep", "\t").schema("compound string, names string").csv(path)
    return raw.select(F.regexp_replace("compound", "^(cpd|gl):", "").alias("compound"), F.substring_index("names", ";", 1).alias("name"))


def read_pathway_graph(spark: SparkSession, path: str, compounds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """KGML: nodes (entry, name, kind, members[], components[]) and edges (source, target, relation, symbol).

    A relation through a compound becomes two edges, a relation without subtypes is named after its type, and a reaction leads from
    its substrates to the enzyme and on to its products.
    """
    def rows(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    entries = rows("entry", "_id long, _name string, _type string, graphics struct<_name:string>, component array<struct<_id:long>>")
    members = F.transform(F.split("_name", " "), lambda m: F.regexp_replace(m, "^(cpd|gl):", ""))
    nodes = entries.select(F.col("_id").alias("entry"), F.substring_index(F.coalesce("graphics._name", "_name"), ",", 1).alias("name"),
                           F.col("_type").alias("kind"), members.alias("members"), F.col("component._id").alias("components"))
    if compounds is not None:
        main = compounds.select(F.col("compound").alias("__code"), F.col("name").alias("__name"))
        nodes = nodes.withColumn("__code", F.when(F.col("kind") == "compound", F.get("members", F.lit(0)))).join(main, "__code", "left").select(
            "entry", F.coalesce("__name", "name").alias("name"), "kind", "members", "components")

    def edge(source, target, relation, symbol):
        return F.struct(source.cast("long").alias("source"), target.cast("long").alias("target"), relation.alias("relation"),
                        symbol.alias("symbol"))

    rel = rows("relation", "_entry1 long, _entry2 long, _type string, subtype array<struct<_name:string,_value:string>>")
    a, b, arrow = F.col("_entry1"), F.col("_entry2"), F.lit("->")
    bare = F.when(F.col("_type") == "PCrel", "compound").when(F.col("_type") == "maplink", "missing interaction").otherwise("unknown")
    plain = F.array(edge(a, b, bare, F.when(bare == "unknown", "?").otherwise("->")))
    typed = F.flatten(F.transform("subtype", lambda x: F.when(
        x["_name"] == "compound", F.array(edge(a, x["_value"].try_cast("long"), x["_name"], arrow), edge(x["_value"].try_cast("long"), b, x["_name"], arrow))
    ).otherwise(F.array(edge(a, b, x["_name"], x["_value"])))))
    relations = rel.select(F.inline(F.when(F.size("subtype") > 0, typed).otherwise(plain)))
    rea = rows("reaction", "_id long, _type string, substrate array<struct<_id:long>>, product array<struct<_id:long>>")
    enzyme, both = F.col("_id"), F.col("_type") == "reversible"
    name = F.when(both, "reversible reaction").otherwise("irreversible reaction")
    symbol = F.when(both, "<->").otherwise("->")
    reactions = rea.select(F.inline(F.concat(
        F.transform("substrate", lambda x: edge(x["_id"], enzyme, name, symbol)), F.transform("product", lambda x: edge(enzyme, x["_id"], name, symbol)))))
    return nodes, relations.unionByName(reactions)


# --- ID mappings ------------------------------------------------------------------------------------------------------

def read_id_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Tab table ``From, Entry|To, Annotation`` to (from_id, to_id, score)."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    score = F.coalesce(F.col("Annotation").try_cast("double"), F.lit(0.0)) if "Annotation" in raw.columns else F.lit(0.0)
    return raw.select(F.col(raw.columns[0]).alias("from_id"), F.col(raw.columns[1]).alias("to_id"), score.alias("score"))


def read_protein_orthologs(spark: SparkSession, path: str, target_taxon: int) -> DataFrame:
    """Tab table ``protid1, protid2, CS, taxid2`` limited to one taxon: (from_id, to_id, score)."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    return raw.filter(F.col("taxid2").cast("long") == target_taxon).select(
        F.col("protid1").alias("from_id"), F.col("protid2").alias("to_id"), F.col("CS").cast("double").alias("score"))


def read_ortholog_groups(spark: SparkSession, path: str) -> DataFrame:
    """JSON to (type, orthologs[], inparalogs[]). A file is one response with the records in ``data[]``, or has a record in each line."""
    record = "type:string,orthologs:array<string>,inparalogs:array<string>"
    lines = spark.read.schema(f"data array<struct<{record}>>, type string, orthologs array<string>, inparalogs array<string>, _corrupt_record string").json(path)
    single = lines.filter(F.col("data").isNull() & (F.col("type").isNotNull() | F.col("orthologs").isNotNull())).select(
        "type", "orthologs", "inparalogs")
    whole = spark.read.option("multiLine", True).schema(f"data array<struct<{record}>>").json(path).select(F.inline("data"))
    return single.unionByName(whole)
