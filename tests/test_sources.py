import gzip
import io
import json

import pytest
from pyspark.sql import functions as F

from keyloom.operators import attributes, genome, mapping
from keyloom.plans.chain import Pipeline, ReadPipeline
from keyloom.sources import annotations, fastq, genome as genome_source, reads as sam, tables
from keyloom.table import CountTable, FeatureTable
from conftest import rows


def test_csv_cleaning_types_and_order(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("﻿,name,n,x\ng1, a ,1,1.5\ng2,NA,2,nan\ng3,,3,NaN\n")
    df = tables.load_table(spark, str(f), keep_order=True)
    assert df.columns[:4] == ["key", "name", "n", "x"]
    assert dict(df.dtypes)["n"] == "bigint" and dict(df.dtypes)["x"] == "double"
    got = rows(df.drop("_row"))
    assert got == {"g1": ("a", 1, 1.5), "g2": (None, 2, None), "g3": (None, 3, None)}
    t = FeatureTable(df, "key", ["_row"])
    assert [r["key"] for r in t.head(2).collect()] == ["g1", "g2"] and [r["key"] for r in t.tail(1).collect()] == ["g3"]
    with pytest.raises(IndexError):
        tables.load_table(spark, str(f), "missing")
    with pytest.raises(ValueError):
        tables.load_table(spark, str(tmp_path / "x.json"))


def test_text_separator_is_sniffed_and_round_trips(spark, tmp_path):
    f = tmp_path / "t.txt"
    f.write_text("gene;a;b\nx;1;2\ny;3;4\n")
    df = tables.load_table(spark, str(f), "b")
    assert rows(df) == {"x": (1,), "y": (3,)}
    for suffix in ("csv", "tsv", "parquet"):
        folder = tables.save_table(df, str(tmp_path / f"out.{suffix}"), "_x")
        assert folder.endswith(f"out_x.{suffix}")
        assert rows(tables.load_table(spark, folder)) == {"x": (1,), "y": (3,)}


def test_count_folders(spark, tmp_path):
    htseq = tmp_path / "htseq"
    htseq.mkdir()
    for s, base in (("s1", 1), ("s2", 10)):
        (htseq / f"{s}.txt").write_text(f"g1\t{base}\ng2\t{base + 1}\n__no_feature\t{base + 2}\n__ambiguous\t0\n")
    counted, special = tables.read_htseq_folder(spark, str(htseq))
    assert rows(counted) == {"g1": (1.0, 10.0), "g2": (2.0, 11.0)}
    assert rows(special)["__no_feature"] == (3.0, 12.0)
    rpm = CountTable.from_folder_htseqcount(spark, str(htseq), norm_to_rpm=True)
    assert rows(rpm.df)["g1"][0] == pytest.approx(1 / 6 * 1e6)
    quant = tmp_path / "quant"
    for s, n in (("a", 5), ("b", 7)):
        (quant / s).mkdir(parents=True)
        (quant / s / "abundance.tsv").write_text(f"target_id\tlength\teff_length\test_counts\ttpm\nt1\t100\t90\t{n}\t{n * 2}\n")
    est, tpm = tables.read_abundance_folder(spark, str(quant))
    assert rows(est) == {"t1": (5.0, 7.0)} and rows(tpm) == {"t1": (10.0, 14.0)}


GTF = """#!comment
chr1\tsrc\tgene\t1\t100\t.\t+\t.\tgene_id "G1"; gene_version "3"; gene_name "abc-1"; gene_biotype "protein_coding"; tag "x"; tag "y";
chr1\tsrc\ttranscript\t1\t100\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr1\tsrc\texon\t1\t10\t.\t+\t.\ttranscript_id "T1";
chr1\tsrc\texon\t5\t20\t.\t+\t.\ttranscript_id "T1";
chr1\tsrc\ttranscript\t1\t100\t.\t+\t.\tgene_id "G1"; transcript_id "T2";
chr1\tsrc\texon\t8\t9\t.\t+\t.\ttranscript_id "T2";
broken line
"""


def test_gtf_maps_and_lengths(spark, tmp_path):
    f = tmp_path / "a.gtf"
    f.write_text(GTF)
    ann = genome_source.read_annotation(spark, str(f))
    assert ann.count() == 6
    assert ann.filter("feature = 'gene'").first()["attrs"]["tag"] == "y"
    assert rows(genome.gene_attribute_map(ann, "gene_biotype", use_version=True)) == {"G1.3": ("protein_coding",)}
    assert rows(genome.transcripts_to_genes(ann)) == {"T1": ("G1",), "T2": ("G1",)}
    table = spark.createDataFrame([("abc-1",), ("zzz",)], "gene string")
    assert rows(genome.biotype_map(ann, table, "gene")) == {"abc-1": ("protein_coding",)}
    for method, want in (("mean", 14.0), ("max", 26.0), ("min", 2.0), ("median", 14.0), ("geometric_mean", 52 ** 0.5)):
        assert rows(genome.feature_lengths(ann, "gene", method))["G1"][0] == pytest.approx(want)
    assert rows(genome.feature_lengths(ann, "gene", "merged_exons"))["G1"][0] == 20


def test_gff3_parents_are_lists(spark, tmp_path):
    f = tmp_path / "a.gff3"
    f.write_text("##gff-version 3\nc\ts\tmRNA\t1\t9\t.\t+\t.\tID=T1;Parent=G1\nc\ts\tmRNA\t1\t9\t.\t+\t.\tID=T2;Parent=G1\n"
                 "c\ts\texon\t1\t9\t.\t+\t.\tParent=T1,T2\n")
    ann = genome_source.read_annotation(spark, str(f))
    assert rows(genome.feature_lengths(ann, "transcript")) == {"T1": (9,), "T2": (9,)}


def test_union_lengths_against_brute_force(spark):
    import random
    rng = random.Random(5)
    data = [(g, s := rng.randint(0, 300), s + rng.randint(0, 90)) for g in "ab" for _ in range(60)]
    want = {g: (len({p for k, s, e in data if k == g for p in range(s, e + 1)}),) for g in "ab"}
    df = spark.createDataFrame(data, "g string, start int, end int")
    for tile in (7, 64, 4096):
        assert rows(genome.union_lengths(df, ["g"], tile=tile)) == want


def test_obo(spark, tmp_path):
    f = tmp_path / "o.obo"
    f.write_text("format-version: 1.2\n\n[Term]\nid: GO:0000001\nname: root\nnamespace: ns\n\n[Term]\nid: GO:0000002\nname: leaf\n"
                 "namespace: ns\nalt_id: GO:0000009\nis_a: GO:0000001 ! root\nrelationship: part_of GO:0000001 ! root\n\n"
                 "[Term]\nid: GO:0000003\nname: gone\nis_obsolete: true\n")
    nodes, edges, alt = annotations.read_obo(spark, str(f))
    assert rows(nodes) == {"GO:0000001": ("root", "ns"), "GO:0000002": ("leaf", "ns")}
    assert {tuple(r) for r in edges.collect()} == {("GO:0000002", "GO:0000001", "is_a"), ("GO:0000002", "GO:0000001", "part_of")}
    assert rows(alt) == {"GO:0000009": ("GO:0000002",)}


def test_annotation_selection(spark, tmp_path):
    f = tmp_path / "r.json"
    f.write_text(json.dumps({"response": {"docs": [{"source": "WB", "bioentity_internal_id": "g1", "annotation_class": "GO:1"}]}}))
    assert annotations.read_annotation_responses(spark, str(f)).select("key", "term").first() == ("g1", "GO:1")
    df = spark.createDataFrame([("1", "P", "IDA", "WB", None), ("2", "F", "IDA", "WB", None), ("3", "P", "IEA", "WB", None),
                                ("4", "P", "IDA", "X", "not"), ("5", "P", "EXP", "X", None)],
                               "id string, aspect string, evidence_type string, source string, qualifier string")

    def pick(**kw):
        return sorted(r["id"] for r in annotations.select_annotations(df, **kw).collect())
    assert pick() == ["1", "2", "3", "5"]
    assert pick(aspects="biological process", evidence="experimental") == ["1", "5"]
    assert pick(excluded_evidence="electronic", databases="WB") == ["1", "2"]
    assert pick(excluded_databases=["WB"], excluded_qualifiers=()) == ["4", "5"]


def test_pathway_files(spark, tmp_path):
    f = tmp_path / "k.txt"
    f.write_text("ENTRY       cel1   Pathway\nNAME  x\nGENE        G_1  a; b\n            G_2  c\nCOMPOUND    C1\nENTRY       cel2   Pathway\nGENE        G_3  d\n")
    got = {tuple(r) for r in annotations.read_pathway_entries(spark, str(f), "cel").collect()}
    assert got == {("cel1", "cel:G_1"), ("cel1", "cel:G_2"), ("cel2", "cel:G_3")}
    x = tmp_path / "k.xml"
    x.write_text('<?xml version="1.0"?>\n<pathway name="p"><entry id="1" name="h:1 h:2" type="gene"><graphics name="A, A2"/></entry>'
                 '<entry id="2" name="h:3" type="gene"><graphics name="B"/></entry><entry id="3" name="cpd:C1" type="compound"><graphics name="C1"/></entry>'
                 '<relation entry1="1" entry2="2" type="PPrel"><subtype name="activation" value="--&gt;"/></relation>'
                 '<relation entry1="1" entry2="2" type="ECrel"><subtype name="compound" value="3"/></relation>'
                 '<relation entry1="2" entry2="1" type="maplink"></relation>'
                 '<reaction id="2" type="reversible"><substrate id="3"/><product id="1"/></reaction></pathway>')
    names = tmp_path / "c.txt"
    names.write_text("cpd:C1\tWater; H2O\n")
    nodes, edges = annotations.read_pathway_graph(spark, str(x), annotations.read_compound_names(spark, str(names)))
    assert {r["entry"]: (r["name"], r["members"]) for r in nodes.collect()} == {1: ("A", ["h:1", "h:2"]), 2: ("B", ["h:3"]), 3: ("Water", ["C1"])}
    assert {tuple(r) for r in edges.collect()} == {
        (1, 2, "activation", "-->"), (1, 3, "compound", "->"), (3, 2, "compound", "->"), (2, 1, "missing interaction", "->"),
        (3, 2, "reversible reaction", "<->"), (2, 1, "reversible reaction", "<->")}


def test_mapping_files_and_policies(spark, tmp_path):
    f = tmp_path / "m.tsv"
    f.write_text("From\tEntry\tAnnotation\na\tx\t2.0\na\ty\t5.0\nb\tz\t\n")
    assert rows(mapping.best_mapping(annotations.read_id_mapping(spark, str(f)))) == {"a": ("y",), "b": ("z",)}
    g = tmp_path / "o.json"
    g.write_text(json.dumps({"data": [{"type": "One-to-Many", "orthologs": ["x", "y"], "inparalogs": ["a"]},
                                      {"type": "Many-to-One", "orthologs": ["z"], "inparalogs": ["b", "c"]}]}))
    one, many = mapping.orthologs_from_groups(annotations.read_ortholog_groups(spark, str(g)), "last")
    assert rows(one) == {"a": ("y",), "b": ("z",), "c": ("z",)} and many.count() == 4
    cand = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "from_id string, to_id string, order int")
    assert rows(mapping.resolve(cand, "none")) == {"b": ("z",)}
    assert rows(mapping.resolve(cand, "random", seed=1))["b"] == ("z",)
    df = spark.createDataFrame([("a", 1), ("q", 2)], "gene string, v int")
    assert sorted(r[0] for r in mapping.apply_map(df, "gene", mapping.resolve(cand)).collect()) == ["q", "x"]
    assert sorted(r[0] for r in mapping.apply_map(df, "gene", mapping.resolve(cand), True).collect()) == ["x"]


def test_attribute_tables(spark):
    df = spark.createDataFrame([("g1", 1.0, float("nan")), ("g2", None, 2.0)], "gene string, a double, b double")
    long = attributes.attributes_to_long(df, "gene")
    assert {tuple(r) for r in long.collect()} == {("a", "g1"), ("b", "g2")}
    assert attributes.select_attributes(long, [1]).first()["attribute"] == "b"
    for bad in (["c"], [-1]):
        with pytest.raises(ValueError):
            attributes.select_attributes(long, bad)


def test_fastq_and_sam_files(spark, tmp_path):
    folder = tmp_path / "fq"
    folder.mkdir()
    (folder / "s1.fastq").write_text("@r1 x\nACGTN\n+\nIIIII\n@r2\nGG\n+\n@@\n")
    with gzip.open(folder / "s2.fastq.gz", "wt") as g:
        g.write("@r1\nTTTT\n+\nIIII\n")
    reads = sam.read_fastq(spark, str(folder))
    assert {tuple(r) for r in reads.collect()} == {("s1", "r1", "ACGTN", "IIIII"), ("s1", "r2", "GG", "@@"), ("s2", "r1", "TTTT", "IIII")}
    sam.write_fastq(reads, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 12
    aligned = sam.fastq_to_sam_single(reads)
    sam.write_sam(aligned, str(tmp_path / "sam"))
    back = sam.parse_sam(spark.read.text(str(tmp_path / "sam")).select("sample", "value"))
    assert {tuple(r) for r in sam.sam_to_fastq_single(back).collect()} == {tuple(r) for r in reads.collect()}
    both = sam.fastq_to_sam_paired(reads, reads)
    first, second = sam.sam_to_fastq_paired(both)
    assert first.count() == second.count() == 3 and {r["flag"] for r in both.collect()} == {77, 141}


def test_fastq_byte_ranges_read_every_record_once(spark, tmp_path):
    """Ranges of every size, so that starts fall on each byte of a record; quality lines may begin with @ or +."""
    whole = [(f"r{i}", "ACGT"[i % 4] * (i % 5), "@+I@"[i % 4] * (i % 5)) for i in range(40)]
    body = "".join(f"@{a} x\n{b}\n+\n{c}\n" for a, b, c in whole).encode()
    for data in (body, body.replace(b"\n", b"\r\n"), body[:-1], body + b"\n\n"):
        for step in range(1, 60):
            got = []
            for start in range(0, len(data), step):
                stream = io.BytesIO(data)
                stream.seek(max(start - 1, 0))
                at = start + len(stream.readline()) - 1 if start else 0
                got += [(h[1:].split()[0].decode(), s.decode(), q.decode()) for h, s, q in fastq.records(iter(stream.readline, b""), at, start + step)]
            assert got == whole
    folder = tmp_path / "fq"
    folder.mkdir()
    (folder / "a.b.fq").write_bytes(body)
    (folder / "empty.fastq").write_bytes(b"")
    (folder / "notes.txt").write_bytes(body)
    read = sam.read_fastq(spark, str(folder), split_bytes=37)
    assert sorted(tuple(r) for r in read.collect()) == sorted(("a", *w) for w in whole)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and read.rdd.getNumPartitions() == -(-len(body) // 37)
    sam.write_fastq(read, str(tmp_path / "out"), compress=True)
    assert sorted(tuple(r) for r in sam.read_fastq(spark, str(tmp_path / "out")).collect()) == sorted(("a", *w) for w in whole)
    (tmp_path / "none").mkdir()
    assert sam.read_fastq(spark, str(tmp_path / "none")).collect() == []


def test_pipelines(spark, counts, tmp_path):
    p = Pipeline(CountTable).add_function("filter_low_reads", threshold=10).add_function("normalize_to_rpm").add_function(
        "describe").add_function("split_by_reads", 1000)
    with pytest.raises(AttributeError):
        p.add_function("no_such_method")
    path = str(tmp_path / "p.json")
    p.export_pipeline(path)
    assert Pipeline.import_pipeline(path) == p and len(p) == 4
    t = CountTable(counts, "gene")
    (high, low), outputs = p.apply_to(t)
    by_hand = t.filter_low_reads(10).normalize_to_rpm().split_by_reads(1000)
    assert high.equals(by_hand[0]) and low.equals(by_hand[1]) and list(outputs) == ["describe_1"]
    assert len(p.remove_last_function()) == 3
    reads = spark.createDataFrame([("s", "r", "NNACGTAC", "IIIIIII#")], "sample string, read_id string, seq string, qual string")
    out, side = ReadPipeline().add_function("trim_quality").add_function("trim_n").apply_to(reads)
    assert out.first()["seq"] == "ACGTA" and side == []


def test_small_byte_ranges_share_tasks(tmp_path):
    """Thousands of ranges are dealt to few tasks, each byte once and in order; large ranges keep a task each, and tasks grow to ``task_bytes`` only."""
    path = tmp_path / "many.fastq"
    path.write_bytes(b"".join(b"@r%d\nACGT\n+\nIIII\n" % i for i in range(5000)))
    size = path.stat().st_size
    reader = fastq.FastqReader(f"file://{path}", 37)
    tasks = reader.partitions()
    assert fastq.LEAST_TASKS <= len(tasks) <= fastq.LEAST_TASKS + 2
    spans = [(r.start, r.end) for t in tasks for r in t.ranges]
    assert spans == [(at, min(at + 37, size)) for at in range(0, size, 37)]
    assert [v for t in tasks for b in reader.read(t) for v in b.column("read_id").to_pylist()] == [f"r{i}" for i in range(5000)]
    wide = [fastq.ByteRange("x", None, 100 * i, 100 * i + 100) for i in range(9)]
    assert [len(t.ranges) for t in fastq.dealt(wide, 2, 200)] == [2, 2, 2, 2, 1] and [len(t.ranges) for t in fastq.dealt(wide, 20, 1000)] == [1] * 9
