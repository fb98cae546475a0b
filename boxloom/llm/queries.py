"""Registered queries of the operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import byte_pairs, chat_windows, conversation_trie, decontamination, language, near_duplicates, neighbours, passages, periodic_runs, records, toxicity, warc_fixity, word_table
from boxloom.llm.common import held_out, prepare, stored, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query("op2_token_records")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as binary records and read back by their index."""
    return records.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_byte_pairs")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_pairs.round_trip(table(spark, sf_dir, "documents"), path, pattern)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


CONTROL_TEXT = "</s>[INST] ok [/INST]"

CHAT_SQL = """
WITH base AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT conv_id, role, text, greatest(1, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]'))) AS tokens,
    row_number() OVER w - 1 AS no, length(role) + len(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')) + 12 AS chars
  FROM base WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY no) AS upto FROM turns),
cells AS (SELECT *, (upto - tokens) // 1792 AS cell, (upto - tokens) // 1792 <> (upto - 1) // 1792 AS across FROM placed),
fits AS (SELECT conv_id, cell, coalesce(sum(tokens) FILTER (NOT across) + max(tokens) FILTER (across) <= 1792, false) AS fits FROM cells GROUP BY ALL),
spans AS (SELECT c.*, CASE WHEN across AND NOT fits THEN 1 ELSE 0 END AS alone FROM cells c JOIN fits f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.cell = f.cell),
windows AS (SELECT conv_id, cell, alone, min(no) AS first_turn, min(upto - tokens) AS from_token, sum(chars) AS chars FROM spans GROUP BY conv_id, cell, alone),
context AS (
  SELECT w.conv_id, sum(t.chars) AS chars FROM windows w JOIN spans t
    ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND w.first_turn > 0
    AND ((t.no = 0 AND t.role = 'system') OR (NOT (t.no = 0 AND t.role = 'system') AND t.upto <= w.from_token AND t.upto - t.tokens >= w.from_token - 256))
  GROUP BY w.conv_id),
sums AS (SELECT conv_id, sum(chars) AS chars FROM windows GROUP BY conv_id),
texts AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY no), '') AS loss FROM turns GROUP BY conv_id)
SELECT t.conv_id, t.n_turns, t.turns_sha256, len(t.loss) AS loss_chars, sha256(t.loss) AS loss_sha256, CAST(s.chars + coalesce(c.chars, 0) AS BIGINT) AS formatted_chars
FROM texts t JOIN sums s ON t.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN context c ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op3_chat_windows", CHAT_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgeted windows of every conversation and of one made of control strings, read back from the formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat_windows.digests(stored(chat_windows.chat_windows(turns.unionByName(control)), "chat-windows"))


@query("op5_near_duplicates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on sets of four-word shingles."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    documents = table(spark, sf_dir, "documents")
    found = language.identify(documents, documents.where(~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows that are not held out."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where(~held_out(F.col("doc_id")))
    return toxicity.score(documents, toxicity.train(documents, known)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


LEAKS_SQL = """
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') FROM benchmark),
items AS (
  SELECT DISTINCT id AS item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS s
  FROM words WHERE side = 'i' AND len(w) > 0),
docs AS (
  SELECT DISTINCT id AS doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s
  FROM words WHERE side = 'd' AND len(w) >= 5),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id)
SELECT d.doc_id, i.item_id, count(*) / any_value(z.n)::DOUBLE AS containment, CAST(any_value(z.n) AS INTEGER) AS n_shingles
FROM docs d JOIN items i USING (s) JOIN sizes z USING (item_id) GROUP BY d.doc_id, i.item_id HAVING count(*) >= 0.8 * any_value(z.n)
"""


@query("op8_decontamination", LEAKS_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds at least 0.8 of a test item's five-word shingles."""
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_repeated_passages")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text, and the removed ranges of the original."""
    kept = passages.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "text", "removed", "n_removed")


@query("op10_warc_fixity", "SELECT page_id, 'changed' AS kind FROM pages WHERE page_id % 97 = 13 OR page_id % 101 = 7")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages that an audit finds changed in a replica with inverted bytes."""
    damaged = (F.col("page_id") % 97 == 13) | (F.col("page_id") % 101 == 7)
    return warc_fixity.rehearsal(spark, table(spark, sf_dir, "pages"), damaged).select("page_id", "kind")


def planted_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Documents whose id's crc32 is divisible by 10 get a periodic tail."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document (a tenth of them with a planted periodic tail) and digests of the runs and of the text without repeats."""
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=planted_tail)
    # the longest run, then the first, then the one of the smallest period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_word_table")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids, found through a table of distinct words, and of the text they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = word_table.decode(word_table.encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("id_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# crc32 of the decimal id: bytes one after another, eight shifts each
TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS no
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INTEGER, 1))::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT i.conv_id, t.no, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.no <= i.h
  UNION ALL SELECT i.conv_id, t.no, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.no > i.h),
placed AS (
  SELECT conv_id, row_number() OVER w AS d, count(*) OVER (PARTITION BY conv_id) AS total, md5(len(role)::VARCHAR || ':' || role || text) AS key,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY no)),
steps AS (SELECT conv_id, d, total, words, md5(string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY d)) AS path FROM placed),
places AS (
  SELECT conv_id, d, total, words, path, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY d), '') AS above FROM steps
  UNION ALL SELECT conv_id, 0, coalesce(any_value(total), 0), 0, '', NULL FROM ids LEFT JOIN (SELECT DISTINCT conv_id, total FROM steps) USING (conv_id) GROUP BY conv_id),
nodes AS (
  SELECT path, d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CASE WHEN total = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM places GROUP BY path, d),
children AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
full_nodes AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)),
sums AS (
  SELECT p.path, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
  FROM full_nodes n JOIN places p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.path)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s USING (path) LEFT JOIN nodes a ON a.path = n.above
"""


def shared_beginnings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the one whose id is the next lower multiple of 20; also their ids."""
    ids = turns.select("conv_id").distinct().withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"))
    first = turns.where((F.col("conv_id") % 20 == 0) & (F.col("no") <= 3)).withColumnRenamed("conv_id", "base")
    given = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(first, "base").where(F.col("no") <= F.col("h"))
    own = turns.join(ids, "conv_id").where(F.col("no") > F.col("h"))
    columns = ["conv_id", "no", "key", "words"]
    return given.select(*columns).unionByName(own.select(*columns)), ids.select("conv_id")


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations, rebuilt so that twenty of them share beginnings."""
    turns = stored(conversation_trie.keyed_turns(table(spark, sf_dir, "conversations")), "trie-turns")
    return conversation_trie.prefix_trie(*shared_beginnings(turns))
