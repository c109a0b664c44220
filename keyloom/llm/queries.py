"""One query per operator over the whole of its table, and the pipeline, with SQL twins where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import ann, chat, decontam, html, langid, linededup, mixing, negatives, ordering, ordermin, packing, repair, simhash

#: The conversation that the formatting contract adds: it holds the template's own control strings.
ADDED_CONVERSATION, ADDED_TEXT = -7, r"\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of conversations whose turns follow each other in the partition; one conversation is never held."""
    def shut() -> pd.DataFrame:
        return pd.DataFrame({"conv_id": [conv], "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [chars],
                             "loss_sha256": [loss.hexdigest()], "formatted_chars": [printed]}).astype({"conv_id": "Int64"})
    started = False
    for batch in batches:
        for row in batch.itertuples(index=False):
            own = None if pd.isna(row.conv_id) else int(row.conv_id)
            if not started or own != conv:
                if started:
                    yield shut()
                started, conv, n, chars, printed = True, own, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            n, chars, printed = n + 1, chars + len(row.learned), printed + len(row.printed)
            turns.update(f"{row.role}\n{row.text}\n".encode())
            loss.update(row.learned.encode())
    if started:
        yield shut()


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(ADDED_CONVERSATION, 0, "user", ADDED_TEXT), (ADDED_CONVERSATION, 1, "assistant", ADDED_TEXT)],
                                  "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.format_turns(turns.union(added)))
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "first_token").mapInPandas(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordermin.edit_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
                        ordermin.as_text(F.col("fingerprint")).alias("fingerprint"),
                        ordermin.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, ~held_out()).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP8_SQL = r"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, source_size * 2.0::DOUBLE AS cap, [3.0, 1.0, 2.0][(n - 1) % 3 + 1]::DOUBLE AS w, n FROM sources),
levels AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT max(level) AS level FROM levels),
targets AS (SELECT source, source_size, least(cap, common.level * w) AS target FROM levels, common),
rated AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
  (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
parts AS (SELECT *, floor(ratio + 1e-12)::BIGINT AS whole, greatest(ratio - floor(ratio + 1e-12), 0) AS p FROM rated),
ranked AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN p <= 1e-12 THEN 'infinity'::DOUBLE ELSE (u / (1 - u)) / (p / (1 - p)) END, doc_id
  ROWS UNBOUNDED PRECEDING) AS upto FROM parts),
cut AS (SELECT *, whole + CASE WHEN p > 1e-12 AND upto - size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END AS copies FROM ranked)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies::BIGINT AS copies FROM cut"""

OP2_SQL = r"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (SELECT *, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', ''),
  '[\x20\x09-\x0D]+$', '') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id"""


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.training_order(table(spark, sf_dir, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = r"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
spelled AS (SELECT r, i, m, string_agg(word, ' ') OVER later AS t, count(*) OVER later AS n FROM words, (SELECT DISTINCT m FROM windows)
  WINDOW later AS (PARTITION BY r, m ORDER BY i ROWS BETWEEN CURRENT ROW AND m - 1 FOLLOWING)),
met AS (SELECT s.r, s.i, s.m, w.item_id FROM spelled s JOIN windows w ON s.t = w.t AND s.n = w.m AND s.m = w.m),
hits AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM met) GROUP BY r),
named AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM met WHERE item_id IS NOT NULL)
  GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM texts LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""


class _RepairDigest(repair.Report):
    """The columns of the contract for one conversation; only the string of initials is held."""

    def __init__(self, conv_id):
        self.initials, self.digest, self.any = [], hashlib.sha256(), False
        super().__init__(conv_id)

    def edit(self, edit: tuple) -> None:
        initial, role, text, _ = edit
        self.initials.append(initial)
        if initial != "D":
            self.digest.update(("\n" * self.any + f"{role}:{text}").encode())
            self.any = True

    def results(self) -> Iterator[dict]:
        cost = self.search.end()
        yield self.summary(cost) | {"audit": "".join(self.initials), "repaired_sha256": self.digest.hexdigest()}


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversations with the faults that the contract puts in; copies is 0 where a row is dropped."""
    space = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce("text", space)
    return turns.select(
        "conv_id", "turn", F.when(fault == 4, repair.USER).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.over_conversations(damaged(table(spark, sf_dir, "conversations")), _RepairDigest,
                                     "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


#: A row of the state after row i: the cheapest (cost, initials) for each state of the grammar, 1e9 where it cannot be reached.
OP12_SQL = r"""WITH RECURSIVE steps AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n], range(8)),
  lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(n))),
crcs AS (SELECT c.conv_id, c.turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295::BIGINT],
  list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM conversations c, steps),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN fault = 0 THEN 0 WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM crcs),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  regexp_replace(text, '[ 	-]+$', '') AS told, role[1] AS ini FROM damaged),
judged AS (SELECT *, CASE WHEN told = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN told[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  CASE WHEN lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal FROM placed),
rows_ AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS more FROM judged),
known AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, sum(illegal) AS illegal, max(i) AS n FROM rows_ GROUP BY conv_id),
found AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'p': ''} AS f0, {'c': 1000000000::BIGINT, 'p': ''} AS f1, {'c': 2::BIGINT, 'p': 'I'} AS f2, {'c': 4::BIGINT, 'p': 'II'} AS f3 FROM known
  UNION ALL
  SELECT conv_id, i, g0, g1, h2, list_sort([g3, {'c': h2.c + 2, 'p': h2.p || 'I'}])[1] FROM (
    SELECT *, list_sort([g2, {'c': g0.c + 2, 'p': g0.p || 'I'}, {'c': g1.c + 2, 'p': g1.p || 'I'}, {'c': g3.c + 2, 'p': g3.p || 'I'}])[1] AS h2 FROM (
      SELECT r.conv_id, r.i, {'c': f0.c + 3, 'p': f0.p || 'D'} AS g0,
        list_sort([{'c': f1.c + 3, 'p': f1.p || 'D'}, {'c': CASE WHEN gone OR ini <> 's' THEN 1000000000 ELSE f0.c + more END, 'p': f0.p || 'K'}])[1] AS g1,
        list_sort([{'c': f2.c + 3, 'p': f2.p || 'D'}] || list_transform([f0, f1, f3], lambda f: {'c': CASE WHEN gone THEN 1000000000
          WHEN ini = 'u' THEN f.c + more ELSE f.c + more + 2 END, 'p': f.p || CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END}))[1] AS g2,
        list_sort([{'c': f3.c + 3, 'p': f3.p || 'D'}, {'c': CASE WHEN gone THEN 1000000000 WHEN ini = 'a' THEN f2.c + more ELSE f2.c + more + 2 END,
          'p': f2.p || CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END}])[1] AS g3
      FROM found f JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i + 1))),
best AS (SELECT f.conv_id, list_sort([f0, f3])[1] AS b FROM found f JOIN known k ON f.conv_id IS NOT DISTINCT FROM k.conv_id AND f.i = k.n),
edits AS (SELECT conv_id, unnest(string_split(b.p, '')) AS e, unnest(range(len(b.p))) AS j FROM best WHERE b.p <> ''),
numbered AS (SELECT *, count(*) FILTER (e <> 'I') OVER upto AS i, count(*) FILTER (e <> 'D') OVER upto AS o FROM edits
  WINDOW upto AS (PARTITION BY conv_id ORDER BY j ROWS UNBOUNDED PRECEDING)),
led AS (SELECT n.*, r.role, r.text, max(CASE WHEN o = 1 AND e = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS lead_s
  FROM numbered n LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.i = n.i AND e <> 'I'),
written AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - lead_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j)
  FILTER (e <> 'D') AS told FROM led GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.p, '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN known k ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN written w ON c.conv_id IS NOT DISTINCT FROM w.conv_id"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)


OP13_SQL = r"""WITH sound AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM sound a JOIN sound r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""


QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_line_dedup, op3_chat_formatting, op4_nearest_neighbours, op5_best_fit_packing, op6_order_minhash,
    op7_language_id, op8_source_mixing, op9_simhash_near_dedup, op10_training_order, op11_benchmark_decontamination,
    op12_conversation_repair, op13_hard_negatives)} | {"pipeline": corpus_pipeline.run}
SQL = {"op2_line_dedup": OP2_SQL, "op8_source_mixing": OP8_SQL, "op11_benchmark_decontamination": OP11_SQL,
       "op12_conversation_repair": OP12_SQL, "op13_hard_negatives": OP13_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
