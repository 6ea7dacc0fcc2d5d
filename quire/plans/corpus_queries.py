"""Driver queries over ``documents``: tokenize, split, offsets, budget, blocks, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.arrays import array_sum, count_where, crop_context, positional_checksum
from quire.operators.offsets import stream_offsets, token_budget
from quire.operators.pack import pack_blocks
from quire.operators.report import corpus_report
from quire.operators.sample import sample_windows
from quire.operators.split import assign_split
from quire.operators.tokenize import ByteTokenizer, detokenize_col, token_count, tokenize
from quire.plans.corpus import corpus_blocks_report, tokenized_corpus
from quire.plans.registry import query, table

# Fixed parameters of the driver queries.
BLOCK = 512
BUDGET = 1_000_000
N_WINDOWS = 64
WORLD = 2
BATCH = 4
SEED = 1337

# DuckDB: documents with the same hash split and byte-token counts.
DOCS_CTE = """
d AS (
  SELECT doc_id, text,
         CASE WHEN ('0x' || substr(md5('1337:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT
                   / 4294967296.0 < 0.01 THEN 'val' ELSE 'train' END AS split,
         CAST(strlen(text) + 1 AS BIGINT) AS n_tokens
  FROM documents)"""

# DuckDB: byte tokens (+ end-of-text 256) of every document, with stream offsets.
TOKENS_CTE = DOCS_CTE + """,
o AS (
  SELECT doc_id, split, n_tokens,
         list_transform(regexp_extract_all(hex(encode(text)), '..'),
                        lambda x: ('0x' || x)::INTEGER) || [256] AS toks,
         sum(n_tokens) OVER (PARTITION BY split ORDER BY doc_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS start,
         sum(n_tokens) OVER (PARTITION BY split) AS total
  FROM d),
t AS (
  SELECT split, total, start + i AS pos, tok
  FROM (SELECT split, total, start, unnest(toks) AS tok,
               unnest(range(len(toks))) AS i FROM o))"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("corpus_report", oracle=f"""
WITH {DOCS_CTE.strip()}
SELECT split, count(*)::BIGINT AS n_docs, sum(n_tokens)::BIGINT AS n_tokens,
       sum(list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'),
                                   lambda x: ('0x' || x)::INTEGER)) + 256)::BIGINT AS token_sum,
       round(sum(n_tokens) * 2 / 1073741824.0, 6) AS gib,
       (sum(sum(n_tokens)) OVER ())::BIGINT AS total_tokens
FROM d GROUP BY split""")
def q_corpus_report(spark, sf_dir):
    """Tokenize every document, route, report per split."""
    docs = assign_split(tokenize(_docs(spark, sf_dir).select("doc_id", "text"), "text"))
    rep = corpus_report(docs, extra={"token_sum": F.sum(array_sum("tokens"))})
    return rep.select(
        "split", F.col("n_docs").cast("bigint").alias("n_docs"),
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.col("token_sum").cast("bigint").alias("token_sum"), "gib",
        F.col("total_tokens").cast("bigint").alias("total_tokens"))


@query("token_budget", oracle=f"""
WITH {DOCS_CTE.strip()}
SELECT doc_id, split, n_tokens, budget_start FROM (
  SELECT doc_id, split, n_tokens,
         (sum(n_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          - n_tokens)::BIGINT AS budget_start
  FROM d)
WHERE budget_start < {BUDGET} OR budget_start = 0""")
def q_token_budget(spark, sf_dir):
    """Documents kept by a 1,000,000-token budget in doc_id order."""
    docs = assign_split(_docs(spark, sf_dir).select("doc_id", "text"))
    docs = docs.select("doc_id", "split",
                       token_count(F.col("text")).cast("bigint").alias("n_tokens"))
    return token_budget(docs, BUDGET, "doc_id")


@query("stream_offsets", oracle=f"""
WITH {DOCS_CTE.strip()}
SELECT doc_id, split, n_tokens,
       (sum(n_tokens) OVER (PARTITION BY split ORDER BY doc_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens)::BIGINT
         AS start
FROM d""")
def q_stream_offsets(spark, sf_dir):
    """Offset of every document in its split's token stream."""
    docs = assign_split(_docs(spark, sf_dir).select("doc_id", "text"))
    docs = docs.select("doc_id", "split",
                       token_count(F.col("text")).cast("bigint").alias("n_tokens"))
    return stream_offsets(docs, "doc_id")


@query("stream_offsets_text_key", oracle=f"""
WITH {DOCS_CTE.strip()}
SELECT 'https://example.org/' || doc_id AS url, split,
       (sum(n_tokens) OVER (PARTITION BY split ORDER BY 'https://example.org/' || doc_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens)::BIGINT
         AS start
FROM d""")
def q_stream_offsets_text_key(spark, sf_dir):
    """W1 in the order of a string key (ids of web corpora are URLs or hashes)."""
    docs = assign_split(_docs(spark, sf_dir).select("doc_id", "text"))
    docs = docs.select(F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"),
                       "split", token_count(F.col("text")).cast("bigint").alias("n_tokens"))
    return stream_offsets(docs, "url").select("url", "split", "start")


_MIXED_URL = ("CASE CAST(substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS INTEGER) "
              "WHEN 1 THEN 'http' ELSE 'https' END || '://' || substr(md5('host' || doc_id), 1, 2) "
              "|| '.example.org/' || doc_id")


@query("stream_offsets_mixed_urls", oracle=f"""
WITH {DOCS_CTE.strip()},
u AS (SELECT {_MIXED_URL} AS url, split, n_tokens FROM d)
SELECT url, split, (sum(n_tokens) OVER (PARTITION BY split ORDER BY url
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens)::BIGINT AS start
FROM u""")
def q_stream_offsets_mixed_urls(spark, sf_dir):
    """W1 in URL order over both schemes and many hosts: buckets follow the whole key."""
    docs = assign_split(_docs(spark, sf_dir).select("doc_id", "text"))
    host = F.substring(F.md5(F.concat(F.lit("host"), F.col("doc_id").cast("string"))), 1, 2)
    scheme = F.when(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8", "http") \
        .otherwise("https")
    url = F.concat(scheme, F.lit("://"), host, F.lit(".example.org/"),
                   F.col("doc_id").cast("string"))
    docs = docs.select(url.alias("url"), "split",
                       token_count(F.col("text")).cast("bigint").alias("n_tokens"))
    return stream_offsets(docs, "url").select("url", "split", "start")


@query("pack_blocks", oracle=f"""
WITH {TOKENS_CTE.strip()},
c AS (
  SELECT split, total, pos // {BLOCK} AS block_id, pos % {BLOCK} AS j, tok FROM t
  UNION ALL
  SELECT split, total, pos // {BLOCK} - 1, {BLOCK}, tok FROM t WHERE pos % {BLOCK} = 0 AND pos > 0)
SELECT split, block_id::BIGINT AS block_id, (block_id * {BLOCK})::BIGINT AS start,
       count(*)::BIGINT AS n_tokens,
       sum(CASE WHEN tok = 256 THEN 1 ELSE 0 END)::BIGINT AS n_eot,
       sum(tok * (j + 1))::BIGINT AS checksum
FROM c WHERE block_id * {BLOCK} + {BLOCK + 1} <= total
GROUP BY split, block_id""")
def q_pack_blocks(spark, sf_dir):
    """Every full 513-token block of each split stream, fingerprinted."""
    toks = tokenized_corpus(_docs(spark, sf_dir))
    blocks = pack_blocks(toks, BLOCK, method="local")
    return blocks.select(
        "split", F.col("block_id").cast("bigint").alias("block_id"),
        F.col("start").cast("bigint").alias("start"),
        F.size("tokens").cast("bigint").alias("n_tokens"),
        count_where("tokens", lambda x: x == 256).cast("bigint").alias("n_eot"),
        positional_checksum("tokens").alias("checksum"))


@query("corpus_blocks", oracle=f"""
WITH {DOCS_CTE.strip()},
s AS (SELECT split, count(*)::BIGINT AS n_docs, sum(n_tokens)::BIGINT AS n_tokens FROM d GROUP BY split)
SELECT split, n_docs, n_tokens, ((n_tokens - 1) // {BLOCK})::BIGINT AS n_blocks FROM s""")
def q_corpus_blocks(spark, sf_dir):
    """Flagship: per split documents, tokens and full 512-blocks."""
    return corpus_blocks_report(_docs(spark, sf_dir), BLOCK)


@query("sample_windows", oracle=f"""
WITH {TOKENS_CTE.strip()},
n AS (SELECT max(total) AS total FROM o WHERE split = 'train'),
w AS (
  SELECT r.rank::BIGINT AS rank, s.sample_id::BIGINT AS sample_id,
         (s.sample_id // {BATCH})::BIGINT AS batch_id,
         (('0x' || substr(md5(CAST({SEED} + r.rank AS VARCHAR) || ':' || CAST(s.sample_id AS VARCHAR)),
                          1, 15))::BIGINT % (n.total - {BLOCK} - 1))::BIGINT AS start
  FROM range({WORLD}) r(rank), range({N_WINDOWS}) s(sample_id), n)
SELECT w.rank, w.sample_id, w.batch_id, w.start,
       sum(CASE WHEN t.pos < w.start + {BLOCK} THEN t.tok * (t.pos - w.start + 1) ELSE 0 END)::BIGINT
         AS x_checksum,
       sum(CASE WHEN t.pos > w.start THEN t.tok * (t.pos - w.start) ELSE 0 END)::BIGINT
         AS y_checksum
FROM w JOIN t ON t.split = 'train' AND t.pos BETWEEN w.start AND w.start + {BLOCK}
GROUP BY w.rank, w.sample_id, w.batch_id, w.start""")
def q_sample_windows(spark, sf_dir):
    """64 random 512-windows per rank (2 ranks) from the train stream."""
    docs = _docs(spark, sf_dir)
    offs = tokenized_corpus(docs, with_tokens=False, keep_text=False)
    win = sample_windows(offs.where(F.col("split") == "train"), N_WINDOWS, BLOCK, seed=SEED,
                         world_size=WORLD, batch_size=BATCH, text_source=docs)
    return win.select(
        F.col("rank").cast("bigint").alias("rank"), "sample_id", "batch_id", "start",
        positional_checksum("x").alias("x_checksum"),
        positional_checksum("y").alias("y_checksum"))


@query("crop_context", oracle=f"""
WITH b AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'),
                                lambda x: ('0x' || x)::INTEGER) AS toks FROM documents),
c AS (SELECT doc_id, toks[greatest(len(toks) - {BLOCK} + 1, 1):] AS k FROM b)
SELECT doc_id, len(k)::BIGINT AS n_tokens,
       list_sum(list_transform(range(len(k)), lambda i: k[i + 1] * (i + 1)))::BIGINT AS checksum
FROM c""")
def q_crop_context(spark, sf_dir):
    """The last 512 byte tokens of every document."""
    docs = tokenize(_docs(spark, sf_dir).select("doc_id", "text"), add_eot=False)
    k = crop_context("tokens", BLOCK)
    return docs.select("doc_id", F.size(k).cast("bigint").alias("n_tokens"),
                       positional_checksum(k).alias("checksum"))


@query("detokenize", oracle="""
SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS n_tokens, true AS roundtrip_ok FROM documents""")
def q_detokenize(spark, sf_dir):
    """Decode the tokens (with end-of-text) back to text."""
    docs = tokenize(_docs(spark, sf_dir).select("doc_id", "text"))
    dec = detokenize_col(F.col("tokens"), ByteTokenizer())
    return docs.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                       (dec == F.concat(F.col("text"), F.lit("<|endoftext|>"))).alias("roundtrip_ok"))
