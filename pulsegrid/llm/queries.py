"""The operators as queries over whole tables, and the same in DuckDB SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm import (
    contamination, exact_dedup, html_text, line_dedup, merkle, packing, prefix_trie, secrets, shingle_join, substring_dedup, token_files, topk, toxicity,
)
from pulsegrid.llm.common import Scratch, ship

TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_substrings(table(spark, sf_dir, "documents"), span=400).drop("kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").path("files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end_id=1)
    return token_files.read_token_files(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", F.col("secret").cast("int").alias("secret"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract_main_text(table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return contamination.report_contamination(table(spark, sf_dir, "documents"), benchmark)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.delete_repeated_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), 2048, end_id=0)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, scale=64.0)


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.similar_documents(table(spark, sf_dir, "documents"), size=4, percent=85)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    proofs, root = merkle.write_manifest(table(spark, sf_dir, "documents"), tamper=("n_chars", tampered))
    root = F.lit(root.hex() if root else None).cast("string")
    return proofs.select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    return prefix_trie.prefix_trie(prefix_trie.branched(turns, F.col("conv_id") - F.col("conv_id") % 5, shared, longest=8))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_token_files": op3_token_files,
    "op4_secret_scan": op4_secret_scan,
    "op5_html_text": op5_html_text,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_shingle_join": op10_shingle_join,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_prefix_trie": op13_prefix_trie,
}

_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# What line dedup leaves of the texts of a table `{source}`: doc_id, n_lines, n_removed, text. Of all runs of enough words the shortest from
# each line on and the shortest up to each line are compared; every line of a maximal repeated run lies in one of them that lies in the run.
LINES_LEFT_SQL = """
  lines AS (
    SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n
    FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {source} WHERE text <> ''))),
  solid AS (
    SELECT *, row_number() OVER w AS s, sum(n) OVER w AS c FROM lines WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  long AS (
    SELECT a.doc_id, a.s, b.s AS e FROM solid a JOIN solid b
    ON a.doc_id = b.doc_id AND b.s >= a.s AND b.c - a.c + a.n >= {words}),
  ends AS (SELECT doc_id, s, min(e) AS e FROM long GROUP BY 1, 2 UNION SELECT doc_id, max(s), e FROM long GROUP BY doc_id, e),
  lists AS (SELECT doc_id, list(line ORDER BY s) AS l FROM solid GROUP BY doc_id),
  contents AS (SELECT doc_id, s, e, array_to_string(l[s:e], chr(10)) AS content FROM ends JOIN lists USING (doc_id)),
  later AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s, e) AS k FROM contents) WHERE k > 1),
  gone AS (SELECT DISTINCT x.doc_id, x.i FROM solid x JOIN later y ON x.doc_id = y.doc_id AND x.s BETWEEN y.s AND y.e),
  kept AS (
    SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
    FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)"""

# CRC-32 of the decimal digits of a number, bit by bit: a byte enters, then eight shifts.
_CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(
  [[ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(CAST({} AS VARCHAR), '')])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""


def _leaf_sql(n_chars: str) -> str:
    values = ["doc_id", "source", "lang", n_chars, "text"]
    parts = [f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values]
    return f"sha256({' || '.join(parts)})"


ORACLE: dict[str, str] = {
    "op11_exact_dedup": """
WITH docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
groups AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM docs GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM docs JOIN groups USING (t)""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, {_leaf_sql('n_chars')} AS leaf,
         CASE WHEN {_CRC32_SQL.format('doc_id')} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS tampered,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos
  FROM documents),
levels(tree, depth, l) AS (
  SELECT tree, 0, list(leaf ORDER BY pos) FROM leaves GROUP BY tree
  UNION ALL
  SELECT tree, depth + 1, [sha256(array_to_string(l[2 * i + 1:2 * i + 2], '')) for i in range((len(l) + 1) // 2)] FROM levels WHERE len(l) > 1),
subroots AS (SELECT tree, l[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM levels WHERE len(l) = 1),
top(depth, l) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM subroots
  UNION ALL
  SELECT depth + 1, [sha256(array_to_string(l[2 * i + 1:2 * i + 2], '')) for i in range((len(l) + 1) // 2)] FROM top WHERE len(l) > 1),
whole AS (SELECT l[1] AS root FROM top WHERE len(l) = 1),
steps AS (
  SELECT tree, depth, depth AS step, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS h, len(l) AS n FROM levels WHERE len(l) > 1
  UNION ALL
  SELECT s.tree, t.depth, 1000 + t.depth, generate_subscripts(t.l, 1) - 1, unnest(t.l), len(t.l) FROM subroots s, top t WHERE len(t.l) > 1),
heights AS (SELECT tree, max(depth) AS high FROM levels GROUP BY tree),
fold(doc_id, tree, step, pos, h, siblings) AS (
  SELECT doc_id, tree, CASE WHEN high = 0 THEN 1000 ELSE 0 END, CASE WHEN high = 0 THEN s.pos ELSE l.pos END, tampered, ''
  FROM leaves l JOIN heights USING (tree) JOIN subroots s USING (tree)
  UNION ALL
  SELECT f.doc_id, f.tree, CASE WHEN f.step + 1 = t.high THEN 1000 ELSE f.step + 1 END,
         CASE WHEN f.step + 1 = t.high THEN r.pos ELSE f.pos // 2 END,
         sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END), f.siblings || coalesce(s.h, '')
  FROM fold f JOIN heights t ON f.tree = t.tree JOIN subroots r ON r.tree = f.tree
  JOIN (SELECT DISTINCT tree, step FROM steps) o ON o.tree = f.tree AND o.step = f.step
  LEFT JOIN steps s ON s.tree = f.tree AND s.step = f.step AND s.i = xor(f.pos, 1)),
ends AS (SELECT doc_id, tree, arg_max(h, step) AS folded_root, arg_max(siblings, step) AS siblings FROM fold GROUP BY doc_id, tree)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (tree) JOIN ends USING (doc_id, tree), whole""",
    "op13_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32_SQL.format('conv_id')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, t.i AS d, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= h
  UNION ALL
  SELECT c.conv_id, least(h, coalesce(n, 0)) + t.i - h, t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > h
  LEFT JOIN (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id) b ON b.conv_id = c.base),
sequences AS (
  SELECT conv_id, d, strlen(text) AS n_bytes,
         string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d) AS path
  FROM rebuilt),
prefixes AS (
  SELECT conv_id, 0 AS d, 0 AS n_bytes, '' AS path FROM convs UNION ALL SELECT conv_id, d, n_bytes, sha256(path) FROM sequences),
lengths AS (SELECT conv_id, max(d) AS len FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT path, min(d) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, min(n_bytes) AS n_bytes,
         sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (len = d), '')) AS ends_sha256
  FROM prefixes p JOIN lengths l ON l.conv_id = p.conv_id GROUP BY path),
parents AS (
  SELECT n.path, m.path AS parent, m.conv_id AS parent_conv_id FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d = n.depth - 1
  JOIN nodes m ON m.path = p.path),
children AS (SELECT parent AS path, count(*) AS n FROM parents GROUP BY parent),
below AS (
  SELECT p.path, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.n_bytes) AS saved
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.depth LEFT JOIN children c ON c.path = n.path GROUP BY p.path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(c.n, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM nodes n LEFT JOIN parents USING (path) LEFT JOIN children c ON c.path = n.path JOIN below b ON b.path = n.path""",
    "op7_line_dedup": f"""
WITH {LINES_LEFT_SQL.format(source="documents", words=line_dedup.WORDS)}
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept k USING (doc_id)""",
    "op6_decontamination": f"""
WITH items AS (
  SELECT item_id, w, len(w) AS n, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark)
  WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS key
  FROM (SELECT *, unnest(range(1, n - size + 2)) AS i FROM items)),
docs AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS_SQL} AS w FROM documents)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, i, d.size, array_to_string(w[i:i + d.size - 1], ' ') AS key
  FROM (SELECT r, w, s.size, unnest(range(1, greatest(n - s.size + 2, 1))) AS i FROM docs, sizes s) d),
hits AS (SELECT r, i, p.size, item_id FROM places p JOIN windows w ON p.key = w.key AND p.size = w.size),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS j FROM hits) GROUP BY r),
names AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN names USING (r)""",
    "op10_shingle_join": """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * k >= 85 * (s.n + t.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id""",
    "op9_exact_top_k": """
WITH parts AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS j, unnest(embedding) AS x FROM embeddings WHERE vec_id IS NOT NULL),
bad AS (SELECT DISTINCT vec_id FROM parts WHERE x IS NULL OR isnan(x) OR isinf(x)),
whole AS (
  SELECT vec_id, j, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM parts WHERE vec_id NOT IN (FROM bad)),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.v * c.v) AS score
  FROM whole q JOIN whole c ON q.j = c.j AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 20""",
}
