"""Sequencing reads (FASTQ) and alignments (SAM text) as DataFrames, and conversions between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import row_numbers
from .fastq import FASTQ_SUFFIXES, read_fastq

# File suffixes that count as alignments.
ALIGNMENT_SUFFIXES = (".sam",)
# The mandatory SAM fields and the flag bits.
SAM_FIELDS = (("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "long"), ("mapq", "int"),
              ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("seq", "string"),
              ("qual", "string"))
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800


def has_bit(flag: str | Column, bit: int) -> Column:
    col = F.col(flag) if isinstance(flag, str) else flag
    return col.bitwiseAND(F.lit(bit)) != 0


def sample_name(path: Column) -> Column:
    """File name without folder and without any of its suffixes."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^/]*)?$", 1)


def common_name(first: str | Column, second: str | Column) -> Column:
    """Shared name of the two files of a pair: the first name without its mate number."""
    return F.regexp_replace(first, r"[_.\-]?[rR]?1(?=[^0-9]*$)", "")


def reverse_complement(seq: str | Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


# --- FASTQ ---------------------------------------------------------------------------------------------------------

def assemble_fastq(lines: DataFrame) -> DataFrame:
    """Lines (sample, _row, value) to (sample, read_id, seq, qual). For lines that are already a table; files are read
    by ``read_fastq``. Lines are numbered with the distributed row numbers."""
    numbered = row_numbers(lines.select("sample", "_row", "value"), ["sample"], ["_row"], "n")
    record = F.floor((F.col("n") - 1) / 4)
    part = F.pmod(F.col("n") - 1, F.lit(4))
    rows = numbered.groupBy("sample", record.alias("record")).agg(
        *[F.max(F.when(part == i, F.col("value"))).alias(c) for i, c in ((0, "head"), (1, "seq"), (3, "qual"))])
    return rows.select("sample", F.regexp_extract("head", r"^@(\S+)", 1).alias("read_id"), "seq", "qual")


def fastq_lines(reads: DataFrame) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id")), F.col("seq"), F.lit("+"), F.col("qual"))


def write_fastq(reads: DataFrame, path: str, compress: bool = False) -> None:
    """One folder per sample."""
    out = reads.select("sample", fastq_lines(reads).alias("value")).write.mode("overwrite").partitionBy("sample")
    (out.option("compression", "gzip") if compress else out).text(path)


# --- SAM -----------------------------------------------------------------------------------------------------------------

def parse_sam(lines: DataFrame, value: str = "value") -> DataFrame:
    """Alignment lines to typed columns plus a tag map; header lines are skipped. Other columns of ``lines`` stay."""
    rest = [c for c in lines.columns if c != value]
    rows = lines.filter(~F.col(value).startswith("@") & (F.col(value) != "")).select(*rest, F.split(value, "\t").alias("p"))
    typed = [F.get("p", F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(SAM_FIELDS)]
    tags = F.map_from_entries(F.transform(F.slice("p", F.lit(12), F.greatest(F.size("p") - 11, F.lit(0))),
                                          lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(6), F.length(t)))))
    return rows.filter(F.size("p") >= 11).select(*rest, *typed, tags.alias("tags"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", "*.sam").text(path)
    return parse_sam(raw.select(sample_name(F.col("_metadata.file_path")).alias("sample"), "value"))


def sam_lines(alignments: DataFrame) -> Column:
    tags = F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.when(e["value"].rlike(r"^-?\d+$"), F.lit(":i:"))
                                                                 .otherwise(F.lit(":Z:")), e["value"]))
    return F.concat_ws("\t", *[F.col(name).cast("string") for name, _ in SAM_FIELDS], tags)


def write_sam(alignments: DataFrame, path: str) -> None:
    alignments.select("sample", sam_lines(alignments).alias("value")).write.mode("overwrite").partitionBy("sample").text(path)


# --- conversions -----------------------------------------------------------------------------------------------------------

def _unmapped(flag: int) -> list[Column]:
    fixed = {"flag": F.lit(flag), "rname": F.lit("*"), "pos": F.lit(0).cast("long"), "mapq": F.lit(0), "cigar": F.lit("*"),
             "rnext": F.lit("*"), "pnext": F.lit(0).cast("long"), "tlen": F.lit(0).cast("long")}
    return [c.alias(n) for n, c in fixed.items()]


def fastq_to_sam_single(reads: DataFrame) -> DataFrame:
    return reads.select("sample", F.col("read_id").alias("qname"), *_unmapped(UNMAPPED), "seq", "qual",
                        F.create_map().cast("map<string,string>").alias("tags"))


def pair_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """R1 and R2 reads joined by sample and read ID (a trailing /1 or /2 is ignored)."""
    def side(df: DataFrame, n: int) -> DataFrame:
        ident = F.regexp_replace("read_id", r"/[12]$", "")
        return df.select("sample", ident.alias("read_id"), F.col("seq").alias(f"seq{n}"), F.col("qual").alias(f"qual{n}"))
    return side(first, 1).join(side(second, 2), ["sample", "read_id"])


def fastq_to_sam_paired(first: DataFrame, second: DataFrame) -> DataFrame:
    pairs = pair_mates(first, second)
    base = PAIRED | UNMAPPED | MATE_UNMAPPED

    def mate(n: int, bit: int) -> DataFrame:
        return pairs.select("sample", F.col("read_id").alias("qname"), *_unmapped(base | bit), F.col(f"seq{n}").alias("seq"),
                            F.col(f"qual{n}").alias("qual"), F.create_map().cast("map<string,string>").alias("tags"))
    return mate(1, FIRST).unionByName(mate(2, SECOND))


def _as_reads(alignments: DataFrame, re_reverse: bool, include_non_primary: bool) -> DataFrame:
    rows = alignments if include_non_primary else alignments.filter(~has_bit("flag", SECONDARY | SUPPLEMENTARY))
    back = has_bit("flag", REVERSE) & F.lit(re_reverse)
    return rows.select("sample", F.col("qname").alias("read_id"), "flag",
                       F.when(back, reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"),
                       F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def sam_to_fastq_single(alignments: DataFrame, re_reverse: bool = True, include_non_primary: bool = False) -> DataFrame:
    return _as_reads(alignments, re_reverse, include_non_primary).drop("flag")


def sam_to_fastq_paired(alignments: DataFrame, re_reverse: bool = True,
                        include_non_primary: bool = False) -> tuple[DataFrame, DataFrame]:
    rows = _as_reads(alignments, re_reverse, include_non_primary)
    return tuple(rows.filter(has_bit("flag", bit)).drop("flag") for bit in (FIRST, SECOND))
