"""Reads and alignments. Lines of the documents play reads, line items play alignments, suppliers play exons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reads
from ..sources import reads as sam
from ..session import checkpoint, shared_path, spread, stored
from . import relations as r
from .registry import query

_FROM, _TO = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTNACGTACGTA"
_LINES = f"""ln AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
  rd AS (SELECT lang AS sample, doc_id || ':' || i AS read_id, translate(regexp_replace(lower(t), '[^a-z]', '', 'g'), '{_FROM}', '{_TO}') AS seq,
  translate(regexp_replace(lower(t), '[^a-z]', '', 'g'), '{_FROM}', 'IIIIIHHHHHGGGGGFFFFF######') AS qual FROM ln)"""


def _reads(spark, d):
    docs = spread(r.table(spark, d, "documents").select("doc_id", "lang", "text"))
    lines = docs.select(F.col("lang").alias("sample"), "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    letters = F.regexp_replace(F.lower("t"), "[^a-z]", "")
    return lines.select("sample", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("read_id"),
                        F.translate(letters, _FROM, _TO).alias("seq"),
                        F.translate(letters, _FROM, "IIIIIHHHHHGGGGGFFFFF######").alias("qual"))


@query("fastq_round_trip", f"WITH {_LINES} SELECT sample, read_id, seq, qual FROM rd")
def _(spark, d):
    rows = _reads(spark, d)
    lines = rows.select("sample", F.posexplode(F.split(sam.fastq_lines(rows), "\n", -1)).alias("n", "value"), "read_id").select(
        "sample", F.struct("read_id", "n").alias("_row"), "value")
    return sam.assemble_fastq(lines)


@query("fastq_files_round_trip", f"WITH {_LINES} SELECT sample, read_id, seq, qual FROM rd")
def _(spark, d):
    """Written as one folder of files for each sample, and read back by byte ranges of 64 kB."""
    path = shared_path(spark, "fastq")
    sam.write_fastq(_reads(spark, d), path)
    return sam.read_fastq(spark, path, split_bytes=64 << 10)


@query("fastq_to_sam_single", f"""WITH {_LINES} SELECT sample, read_id || chr(9) || '4' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || '*' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0'
  || chr(9) || seq || chr(9) || qual AS line FROM rd""")
def _(spark, d):
    rows = sam.fastq_to_sam_single(_reads(spark, d))
    return rows.select("sample", sam.sam_lines(rows).alias("line"))


@query("trim_n_flanks", f"""WITH {_LINES}, k AS (SELECT *, regexp_replace(seq, '^N+', '') AS a FROM rd) SELECT sample, read_id, regexp_replace(a, 'N+$', '') AS seq,
  substr(qual, len(seq)-len(a)+1, len(regexp_replace(a, 'N+$', ''))) AS qual FROM k""")
def _(spark, d):
    return reads.trim_n(_reads(spark, d))


@query("trim_exact_adapter", f"""WITH {_LINES} SELECT sample, read_id, CASE WHEN instr(seq,'ACGTA') > 0 THEN substr(seq,1,instr(seq,'ACGTA')-1) ELSE seq END AS seq,
  CASE WHEN instr(seq,'ACGTA') > 0 THEN substr(qual,1,instr(seq,'ACGTA')-1) ELSE qual END AS qual, instr(seq,'ACGTA') > 0 AS trimmed FROM rd""")
def _(spark, d):
    return reads.trim_exact_three_prime(_reads(spark, d), "ACGTA")


@query("trim_quality", f"""WITH {_LINES}, q AS (SELECT sample, read_id, i, sum(20-(ascii(substr(qual, (len(qual)-i+1)::INT, 1))-33)) OVER (PARTITION BY sample, read_id ORDER BY i) AS s
  FROM (SELECT sample, read_id, qual, unnest(range(1, len(qual)+1)) AS i FROM rd)), st AS (SELECT sample, read_id, min(CASE WHEN s < 0 THEN i END) AS stop FROM q GROUP BY 1, 2),
  c AS (SELECT sample, read_id, min(i) AS cut FROM (SELECT q.*, max(s) OVER (PARTITION BY sample, read_id) AS top FROM q JOIN st USING (sample, read_id) WHERE stop IS NULL OR i < stop)
    WHERE s = top AND top > 0 GROUP BY 1, 2)
  SELECT sample, read_id, substr(seq, 1, (len(qual)-coalesce(cut,0))::INT) AS seq, substr(qual, 1, (len(qual)-coalesce(cut,0))::INT) AS qual FROM rd LEFT JOIN c USING (sample, read_id)""")
def _(spark, d):
    return reads.trim_quality(_reads(spark, d), 20)


_BARE = "regexp_replace(regexp_replace({0}, '^N+', ''), 'N+$', '')"


@query("trim_adapters_single_end", f"""WITH {_LINES}, k AS (SELECT sample, read_id, substr(seq, 1, instr(seq, 'ACGTACC') - 1) AS s, qual FROM rd WHERE instr(seq, 'ACGTACC') > 0)
  SELECT sample, read_id, {_BARE.format('s')} AS seq, substr(qual, len(s) - len(regexp_replace(s, '^N+', '')) + 1, len({_BARE.format('s')})) AS qual FROM k WHERE len({_BARE.format('s')}) >= 5""")
def _(spark, d):
    """All reads are trimmed with errors allowed; those that hold the whole adapter must be cut where it starts."""
    every = _reads(spark, d)
    whole = every.filter(F.col("seq").contains("ACGTACC")).select("sample", "read_id")
    return reads.trim_single_end(every, three_prime=["ACGTACC"], quality_trimming=None, minimum_length=5).join(whole, ["sample", "read_id"], "left_semi")


def _cut(seq: str, adapter: str) -> str:
    """Bases to keep before the first whole match of the adapter, or before the longest match of its beginning with the end of the read."""
    ends = "".join(f" WHEN right({seq}, {k}) = '{adapter[:k]}' THEN len({seq}) - {k}" for k in range(len(adapter) - 1, 2, -1))
    return f"(CASE WHEN instr({seq}, '{adapter}') > 0 THEN instr({seq}, '{adapter}') - 1{ends} ELSE len({seq}) END)"


@query("trim_adapters_exact", f"""WITH {_LINES}, k AS (SELECT *, {_cut('seq', 'ACGTACC')} AS k FROM rd) SELECT sample, read_id, substr(seq, 1, k) AS seq, substr(qual, 1, k) AS qual
  FROM k WHERE k < len(seq) AND k >= 5""")
def _(spark, d):
    return reads.trim_single_end(_reads(spark, d), three_prime=["ACGTACC"], quality_trimming=None, trim_ns=False, minimum_length=5, error_tolerance=0.0, allow_indels=False)


@query("trim_adapters_paired_end", f"""WITH {_LINES}, m AS (SELECT sample, read_id, seq, translate(reverse(seq), 'ACGT', 'TGCA') AS back FROM rd),
  k AS (SELECT sample, read_id, {_BARE.format("substr(seq, 1, instr(seq, 'ACGTACC') - 1)")} AS seq1, {_BARE.format("substr(back, 1, instr(back, 'GTACGTT') - 1)")} AS seq2
    FROM m WHERE instr(seq, 'ACGTACC') > 0 AND instr(back, 'GTACGTT') > 0)
  SELECT * FROM k WHERE len(seq1) >= 10 AND len(seq2) >= 10""")
def _(spark, d):
    """All pairs are trimmed with errors allowed; those whose mates both hold their adapter must be cut where it starts."""
    first = _reads(spark, d)
    second = first.select("sample", "read_id", sam.reverse_complement("seq").alias("seq"), F.reverse("qual").alias("qual"))
    whole = first.filter(F.col("seq").contains("ACGTACC") & sam.reverse_complement("seq").contains("GTACGTT")).select("sample", "read_id")
    cut = reads.trim_paired_end(first, second, (["ACGTACC"], ["GTACGTT"]), quality_trimming=None, discard_untrimmed=False, pair_filter="any")
    return cut.join(whole, ["sample", "read_id"], "left_semi").select("sample", "read_id", "seq1", "seq2")


@query("filter_read_length", f"WITH {_LINES} SELECT sample, read_id, seq, qual FROM rd WHERE len(seq) BETWEEN 10 AND 60")
def _(spark, d):
    return reads.filter_length(_reads(spark, d), 10, 60)


@query("pair_mates", f"""WITH {_LINES} SELECT sample, read_id, seq AS seq1, qual AS qual1, translate(reverse(seq),'ACGT','TGCA') AS seq2, reverse(qual) AS qual2 FROM rd""")
def _(spark, d):
    first = _reads(spark, d)
    second = first.select("sample", F.concat("read_id", F.lit("/2")).alias("read_id"), sam.reverse_complement("seq").alias("seq"),
                          F.reverse("qual").alias("qual"))
    return sam.pair_mates(first.withColumn("read_id", F.concat("read_id", F.lit("/1"))), second)


# --- alignments -----------------------------------------------------------------------------------------------------------

_DAY = "date_diff('day', DATE '1990-01-01', l_shipdate::DATE)"
_ALN = f"""aln AS (SELECT l_returnflag AS sample, l_orderkey || ':' || l_linenumber || ':' || l_partkey AS qname,
  (CASE WHEN l_suppkey % 2 = 0 THEN 16 ELSE 0 END + CASE WHEN l_discount > 0.095 THEN 256 ELSE 0 END)::INTEGER AS flag, l_linestatus AS rname,
  {_DAY} AS pos, (l_tax*1000)::INTEGER AS mapq, l_quantity::INT AS len, CASE WHEN l_linenumber > 5 THEN 2 ELSE 1 END AS nh FROM lineitem)"""


def _alignments(spark, d):
    """Alignment lines as text, so that the parser is part of the query."""
    li = spread(r.table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    flag = F.when(F.col("l_suppkey") % 2 == 0, 16).otherwise(0) + F.when(F.col("l_discount") > 0.095, 256).otherwise(0)
    n = F.col("l_quantity").cast("int")
    fields = [F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]), flag.cast("string"),
              F.col("l_linestatus"), F.datediff("l_shipdate", F.lit("1990-01-01")).cast("string"),
              F.round(F.col("l_tax") * 1000).cast("int").cast("string"), F.concat(n.cast("string"), F.lit("M")), F.lit("*"), F.lit("0"),
              F.lit("0"), F.repeat(F.lit("A"), n), F.repeat(F.lit("I"), n),
              F.concat(F.lit("NH:i:"), F.when(F.col("l_linenumber") > 5, "2").otherwise("1"))]
    return sam.parse_sam(li.select(F.col("l_returnflag").alias("sample"), F.concat_ws("\t", *fields).alias("value")))


@query("sam_parse", f"""WITH {_ALN} SELECT sample, rname, count(*)::BIGINT AS n, sum(pos)::BIGINT AS pos, sum(mapq)::BIGINT AS mapq, sum(len)::BIGINT AS bases, sum(nh)::BIGINT AS nh FROM aln GROUP BY 1, 2""")
def _(spark, d):
    return _alignments(spark, d).groupBy("sample", "rname").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"), F.sum("mapq").alias("mapq"), F.sum(F.length("seq")).alias("bases"),
        F.sum(F.col("tags")["NH"].cast("int")).alias("nh"))


@query("sam_to_fastq_single", f"WITH {_ALN} SELECT sample, qname AS read_id, repeat(CASE WHEN flag & 16 > 0 THEN 'T' ELSE 'A' END, len) AS seq, repeat('I', len) AS qual FROM aln WHERE flag & 256 = 0")
def _(spark, d):
    return sam.sam_to_fastq_single(_alignments(spark, d))


@query("sort_alignments", f"WITH {_ALN} SELECT sample, qname, rname, pos::BIGINT AS pos FROM aln")
def _(spark, d):
    return reads.sort_alignments(_alignments(spark, d)).select("sample", "qname", "rname", "pos")


@query("validate_alignments", f"""WITH {_ALN} SELECT sample, rule, count(*)::BIGINT AS "count" FROM (SELECT sample, 'MISMATCH_READ_LENGTH_AND_CIGAR' AS rule FROM aln WHERE len > 40
  UNION ALL SELECT sample, 'INVALID_FLAG_FIRST_OF_PAIR' FROM aln WHERE len % 7 = 0) GROUP BY 1, 2""")
def _(spark, d):
    broken = _alignments(spark, d).withColumns({
        "cigar": F.when(F.length("seq") > 40, F.concat((F.length("seq") + 1).cast("string"), F.lit("M"))).otherwise(F.col("cigar")),
        "flag": F.when(F.length("seq") % 7 == 0, F.col("flag").bitwiseOR(F.lit(sam.FIRST))).otherwise(F.col("flag"))})
    return reads.validate_alignments(broken)


_DUP = f"""WITH {_ALN}, a AS (SELECT *, CASE WHEN flag & 16 > 0 THEN pos+len-1 ELSE pos END AS p5 FROM aln), k AS (SELECT *, CASE WHEN flag & 256 = 0 THEN
  row_number() OVER (PARTITION BY sample, rname, p5, (flag & 16), (flag & 256) ORDER BY len*40 DESC, qname DESC, flag DESC, pos DESC, (len || 'M') DESC) END AS rn FROM a) """


@query("mark_duplicates", _DUP + "SELECT sample, coalesce(rn > 1, false) AS duplicate, count(*)::BIGINT AS n FROM k GROUP BY 1, 2")
def _(spark, d):
    return reads.find_duplicates(_stored(spark, d)).groupBy("sample", "duplicate").agg(F.count(F.lit(1)).alias("n"))


def _typed(spark, d):
    """The same alignments as typed columns, without the detour over text."""
    li = spread(r.table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    n = F.col("l_quantity").cast("int")
    flag = F.when(F.col("l_suppkey") % 2 == 0, 16).otherwise(0) + F.when(F.col("l_discount") > 0.095, 256).otherwise(0)
    return li.select(
        F.col("l_returnflag").alias("sample"), F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("qname"),
        flag.alias("flag"), F.col("l_linestatus").alias("rname"), F.datediff("l_shipdate", F.lit("1990-01-01")).cast("long").alias("pos"),
        F.round(F.col("l_tax") * 1000).cast("int").alias("mapq"), F.concat(n.cast("string"), F.lit("M")).alias("cigar"), F.lit("*").alias("rnext"),
        F.lit(0).cast("long").alias("pnext"), F.lit(0).cast("long").alias("tlen"), F.repeat(F.lit("A"), n).alias("seq"),
        F.repeat(F.lit("I"), n).alias("qual"), F.create_map(F.lit("NH"), F.when(F.col("l_linenumber") > 5, "2").otherwise("1")).alias("tags"))


def _stored(spark, d):
    """Stored for operators that need all columns in several passes."""
    return checkpoint(_typed(spark, d))


def _paired(spark, d):
    """Two mates for each line item: the forward one as above, the reverse one 10 to 70 bases on."""
    one = _typed(spark, d).filter(F.col("flag").bitwiseAND(F.lit(256)) == 0)
    first = one.withColumn("flag", F.lit(sam.PAIRED | sam.FIRST)).withColumn("seq", F.substring("seq", 1, 20)).withColumn("qual", F.substring("qual", 1, 20))
    second = one.withColumn("flag", F.lit(sam.PAIRED | sam.SECOND | sam.REVERSE)).withColumn("pos", F.col("pos") + 10 * F.split("qname", ":")[1].cast("long"))
    return stored(first.withColumn("cigar", F.lit("20M")).unionByName(second))


@query("mark_duplicates_paired", f"""WITH {_ALN}, f AS (SELECT *, row_number() OVER (PARTITION BY sample, rname, pos, pos + 10*split_part(qname, ':', 2)::BIGINT + len - 1
  ORDER BY least(len, 20)*40 + len*40 DESC, qname DESC) AS rn FROM aln WHERE flag & 256 = 0), m AS (SELECT sample, rn FROM f UNION ALL SELECT sample, rn FROM f)
  SELECT sample, rn > 1 AS duplicate, count(*)::BIGINT AS n FROM m GROUP BY 1, 2""")
def _(spark, d):
    return reads.find_duplicates(_paired(spark, d)).groupBy("sample", "duplicate").agg(F.count(F.lit(1)).alias("n"))


@query("remove_duplicates", _DUP + "SELECT sample, rname, count(*)::BIGINT AS n, sum(len)::BIGINT AS bases FROM k WHERE rn IS NULL OR rn = 1 GROUP BY 1, 2")
def _(spark, d):
    return reads.find_duplicates(_stored(spark, d), "remove_all").groupBy("sample", "rname").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("bases"))


# alignments start at the first of a month; names carry one of four tiles and two pixel numbers below 1000
_OPTICAL = """f AS MATERIALIZED (SELECT row_number() OVER () AS id, l_returnflag AS sample, l_linestatus AS rname, date_diff('month', DATE '1990-01-01', l_shipdate) AS place, l_suppkey % 4 AS tile,
    l_partkey * 37 % 1000 AS x, l_orderkey * 13 % 1000 AS y, l_orderkey || '-' || l_linenumber AS name, l_quantity::INT AS len FROM lineitem),
  k AS MATERIALIZED (SELECT *, 'M:1:F:1:' || tile || ':' || x || ':' || y || ':' || name AS qname FROM f),
  links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.sample = b.sample AND a.rname = b.rname AND a.place = b.place AND a.tile = b.tile AND a.id <> b.id
    AND abs(a.x - b.x) <= 30 AND abs(a.y - b.y) <= 30),
  chain(id, component) USING KEY (id) AS (SELECT id, id FROM k UNION
    SELECT l.a, min(c.component) FROM chain c JOIN links l ON l.b = c.id JOIN recurring.chain o ON o.id = l.a WHERE c.component < o.component GROUP BY l.a)"""


@query("optical_duplicates", f"""WITH RECURSIVE {_OPTICAL} SELECT qname, row_number() OVER (PARTITION BY sample, rname, place ORDER BY len DESC, qname DESC) > 1 AS duplicate,
  row_number() OVER (PARTITION BY component ORDER BY len DESC, qname DESC) > 1 AS optical FROM k JOIN chain USING (id)""")
def _(spark, d):
    li = spread(r.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"))
    n = F.col("l_quantity").cast("int")
    parts = [F.lit("M:1:F:1"), F.col("l_suppkey") % 4, F.col("l_partkey") * 37 % 1000, F.col("l_orderkey") * 13 % 1000, F.concat_ws("-", "l_orderkey", "l_linenumber")]
    rows = li.select(F.col("l_returnflag").alias("sample"), F.concat_ws(":", *[p.cast("string") for p in parts]).alias("qname"), F.lit(0).alias("flag"),
                     F.col("l_linestatus").alias("rname"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("pos"),
                     F.concat(n.cast("string"), F.lit("M")).alias("cigar"), F.repeat(F.lit("I"), n).alias("qual"))
    return reads.find_duplicates(stored(rows), optical_distance=30).select("qname", "duplicate", "optical")


_EXONS = """ex AS (SELECT s_suppkey AS gene, CASE WHEN s_nationkey % 2 = 0 THEN 'F' ELSE 'O' END AS rname, (1500 + (s_suppkey*37) % 3000)::BIGINT AS s,
  (1500 + (s_suppkey*37) % 3000 + 15)::BIGINT AS e, CASE WHEN s_nationkey % 3 = 0 THEN '-' ELSE '+' END AS strand FROM supplier)"""


def _exons(spark, d):
    start = (1500 + F.pmod(F.col("s_suppkey") * 37, F.lit(3000))).cast("long")
    return r.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("gene"), F.when(F.col("s_nationkey") % 2 == 0, "F").otherwise("O").alias("rname"),
        start.alias("start"), (start + 15).alias("end"), F.when(F.col("s_nationkey") % 3 == 0, "-").otherwise("+").alias("strand"))


_HITS = f"""WITH {_ALN}, {_EXONS}, u AS (SELECT DISTINCT * FROM aln), h AS (SELECT u.*, gene FROM u JOIN ex ON ex.rname = u.rname AND pos <= e AND s <= pos+len-1 WHERE flag & 256 = 0),
  c AS (SELECT sample, qname, flag, rname, pos, len, count(*) AS genes FROM h GROUP BY ALL)"""


def _pivot(value):
    return ", ".join(f"coalesce(sum(CASE WHEN sample='{s}' THEN {value} END),0)::DOUBLE AS \"{s}\"" for s in "ANR")


@query("count_features", f"""{_HITS} SELECT ex.gene, {_pivot('w')} FROM (SELECT DISTINCT gene FROM ex) ex LEFT JOIN
  (SELECT gene, h.sample, 1 AS w FROM h JOIN c USING (sample, qname, flag, rname, pos, len) WHERE genes = 1) k USING (gene) GROUP BY 1""")
def _(spark, d):
    aln = _typed(spark, d)
    return reads.count_features(aln, _exons(spark, d), ["A", "N", "R"], bin_size=64)[0]


@query("count_features_fractional", f"""{_HITS.replace("s <= pos+len-1", "s <= pos+len-1 AND ex.strand = CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END AND mapq >= 20")} SELECT ex.gene,
  {", ".join(f"round(coalesce(sum(CASE WHEN sample='{s}' THEN w END),0)::DOUBLE,6) AS {s}" for s in "ANR")} FROM (SELECT DISTINCT gene FROM ex) ex LEFT JOIN
  (SELECT gene, h.sample, 1.0::DOUBLE/(nh*genes) AS w FROM h JOIN c USING (sample, qname, flag, rname, pos, len)) k USING (gene) GROUP BY 1""")
def _(spark, d):
    from .registry import rounded
    return rounded(reads.count_features(_typed(spark, d), _exons(spark, d), ["A", "N", "R"], stranded="forward", min_mapping_quality=20,
                                        count_multi_overlapping=True, count_fractionally=True, bin_size=64)[0])


@query("count_features_status", f"""{_HITS}, st AS (SELECT u.sample, CASE WHEN flag & 256 > 0 THEN 'Unassigned_Secondary' WHEN genes IS NULL THEN 'Unassigned_NoFeatures'
  WHEN genes > 1 THEN 'Unassigned_Ambiguity' ELSE 'Assigned' END AS status FROM u LEFT JOIN c USING (sample, qname, flag, rname, pos, len))
  SELECT status, {", ".join(f"sum(CASE WHEN sample='{s}' THEN 1 ELSE 0 END)::BIGINT AS {s}" for s in "ANR")} FROM st GROUP BY 1""")
def _(spark, d):
    return reads.count_features(_typed(spark, d), _exons(spark, d), ["A", "N", "R"], bin_size=64)[1]


@query("count_fragments_paired", f"""WITH {_ALN}, {_EXONS}, h AS (SELECT sample, split_part(qname, ':', 1) AS q, gene FROM aln JOIN ex ON ex.rname = aln.rname AND pos <= e AND s <= pos+len-1
  WHERE flag & 256 = 0), c AS (SELECT sample, q, count(DISTINCT gene) AS genes, any_value(gene) AS gene FROM h GROUP BY 1, 2)
  SELECT ex.gene, {_pivot('w')} FROM (SELECT DISTINCT gene FROM ex) ex LEFT JOIN (SELECT gene, sample, 1 AS w FROM c WHERE genes = 1) k USING (gene) GROUP BY 1""")
def _(spark, d):
    aln = _typed(spark, d)
    paired = aln.withColumns({"flag": F.col("flag").bitwiseOR(F.lit(sam.PAIRED)).bitwiseOR(
        F.when(F.col("mapq") % 20 == 0, F.lit(sam.FIRST)).otherwise(F.lit(sam.SECOND))),
        "qname": F.substring_index("qname", ":", 1)})
    return reads.count_features(paired, _exons(spark, d), ["A", "N", "R"], paired=True, bin_size=64)[0]
