"""Driver queries for the ``tokenbin`` sink and source: write the streams, read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.sft import sft_sequences
from quire.plans.corpus import tokenized_corpus
from quire.plans.corpus_queries import BUDGET, DOCS_CTE, TOKENS_CTE
from quire.plans.registry import query, table
from quire.plans.sft_queries import EXAMPLES_CTE, KEYS, _examples
from quire.session import scratch_path
from quire.operators.ngram import eval_loss, score_windows
from quire.operators.sample import windows_from_files
from quire.plans import model_queries as mq
from quire.plans.corpus_queries import BATCH, BLOCK, N_WINDOWS, SEED, WORLD
from quire.plans.prepare import PRETRAIN_MAX_TOKENS, continue_corpus, prepare_corpus
from quire.functions.arrays import positional_checksum
from quire.plans.registry import ORACLES
from quire.sources.tokenbin import read_token_meta, read_token_range, read_token_splits, \
    read_token_stream, write_sft_bins, write_token_stream

SPLITS = ("train", "val")
# Every term of the checksum is taken modulo this prime, so the sums stay far from 2^63.
PRIME = 1_000_003


def _stream_stats(df, split, value_shift=0, prefix=""):
    """Per-split totals of a read-back stream ``(offset, tokens)``."""
    # exploded, the arithmetic is compiled; over arrays it would be interpreted, token by token
    tok = F.col("tok").cast("bigint")
    return df.select("offset", F.posexplode("tokens").alias("i", "tok")).select(
        F.lit(split).alias("split"), tok.alias("s"),
        ((tok + value_shift) * ((F.col("offset") + F.col("i") + 1) % PRIME) % PRIME).alias("w")
    ).groupBy("split").agg(
        F.count("s").cast("bigint").alias(f"{prefix}n_tokens"),
        F.sum("s").cast("bigint").alias(f"{prefix}token_sum"),
        F.sum("w").cast("bigint").alias(f"{prefix}checksum"))


@query("tokenbin_roundtrip", oracle=f"""
WITH {TOKENS_CTE.strip()}
SELECT split, count(*)::BIGINT AS n_tokens, sum(tok)::BIGINT AS token_sum,
       sum(tok * ((pos + 1) % {PRIME}) % {PRIME})::BIGINT AS checksum
FROM t GROUP BY split""")
def q_tokenbin_roundtrip(spark, sf_dir):
    """Write each split as uint16 part files, read back, fingerprint."""
    toks = tokenized_corpus(table(spark, sf_dir, "documents"))
    root = scratch_path(spark, "tokenbin")
    # offsets come partitioned by (split, order bucket): write without a shuffle
    write_token_stream(toks, root, route_col="split", vocab_size=257, eot_id=256,
                       repartition=False)
    out = None
    for split in SPLITS:
        s = _stream_stats(read_token_stream(spark, f"{root}/{split}"), split)
        out = s if out is None else out.unionByName(s)
    return out


@query("sft_bins_roundtrip", oracle=f"""
WITH {EXAMPLES_CTE.strip()},
o AS (
  SELECT split, seq, prompt_len,
         sum(len(seq)) OVER (PARTITION BY split ORDER BY conv_id, turn
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len(seq) AS start
  FROM f),
t AS (
  SELECT split, start + i AS pos, seq[i + 1] AS tok,
         CASE WHEN i < len(seq) - 1 AND i + 1 >= prompt_len THEN seq[i + 2] ELSE -1 END AS lab
  FROM (SELECT *, unnest(range(len(seq))) AS i FROM o))
SELECT split, count(*)::BIGINT AS n_tokens, sum(tok)::BIGINT AS token_sum,
       sum(tok * ((pos + 1) % {PRIME}) % {PRIME})::BIGINT AS checksum,
       count(*)::BIGINT AS lab_n_tokens, sum(lab)::BIGINT AS lab_token_sum,
       sum((lab + 1) * ((pos + 1) % {PRIME}) % {PRIME})::BIGINT AS lab_checksum
FROM t GROUP BY split""")
def q_sft_bins_roundtrip(spark, sf_dir):
    """K2 S3: aligned uint16 tokens and int32 labels per split, written and read back."""
    seqs = sft_sequences(_examples(spark, sf_dir), key_cols=KEYS,
                         quantile_source=table(spark, sf_dir, "conversations"))
    root = scratch_path(spark, "sftbin")
    write_sft_bins(seqs, root, route_col="split", repartition=False)
    out = None
    for split in SPLITS:
        t = _stream_stats(read_token_stream(spark, f"{root}/tokens/{split}", "uint16"), split)
        lab = _stream_stats(read_token_stream(spark, f"{root}/labels/{split}", "int32"), split,
                            value_shift=1, prefix="lab_")
        s = t.join(lab, "split")
        out = s if out is None else out.unionByName(s)
    return out


def _prepared_sql(budget):
    return f"""
WITH {DOCS_CTE.strip()},
k AS (
  SELECT * FROM (SELECT *, sum(n_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING
                                               AND CURRENT ROW) - n_tokens AS before FROM d)
  WHERE before < {budget} OR before = 0),
o AS (
  SELECT split, list_transform(regexp_extract_all(hex(encode(text)), '..'),
                               lambda x: ('0x' || x)::INTEGER) || [256] AS toks,
         sum(n_tokens) OVER (PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING
                             AND CURRENT ROW) - n_tokens AS start FROM k),
t AS (SELECT split, start + i AS pos, tok
      FROM (SELECT split, start, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM o))
SELECT split, count(*)::BIGINT AS n_tokens, sum(tok)::BIGINT AS token_sum,
       sum(tok * ((pos + 1) % {PRIME}) % {PRIME})::BIGINT AS checksum,
       257 AS vocab_size, 256 AS eot_id, count(*)::BIGINT AS meta_tokens
FROM t GROUP BY split"""


def _prepared_stats(spark, root):
    """Fingerprint and sidecar of both streams that ``prepare_corpus`` wrote to ``root``."""
    out = None
    for split in SPLITS:
        meta = read_token_meta(spark, f"{root}/{split}").select(
            F.lit(split).alias("split"), "vocab_size", "eot_id", F.col("n_tokens").alias("meta_tokens"))
        s = _stream_stats(read_token_stream(spark, f"{root}/{split}"), split).join(meta, "split")
        out = s if out is None else out.unionByName(s)
    return out


@query("prepare_corpus", oracle=_prepared_sql(BUDGET))
def q_prepare_corpus(spark, sf_dir):
    """P7 W1 K1 S3 S4 end to end: budget, offsets and token files, read back with their sidecar."""
    root = scratch_path(spark, "prepared")
    prepare_corpus(table(spark, sf_dir, "documents"), root, max_tokens=BUDGET)
    return _prepared_stats(spark, root)


@query("prepare_corpus_whole", oracle=_prepared_sql(PRETRAIN_MAX_TOKENS))
def q_prepare_corpus_whole(spark, sf_dir):
    """P7 W1 K1 S3 S4 end to end under the operator's own budget, which keeps every document here."""
    root = scratch_path(spark, "prepared-whole")
    prepare_corpus(table(spark, sf_dir, "documents"), root)
    return _prepared_stats(spark, root)


def _token_files(spark, sf_dir):
    """The corpus written as train and val token files; their folder."""
    root = scratch_path(spark, "tokenbin")
    write_token_stream(tokenized_corpus(table(spark, sf_dir, "documents")), root,
                       route_col="split", vocab_size=257, eot_id=256, repartition=False)
    return root


@query("sample_windows_files", oracle=ORACLES["sample_windows"])
def q_sample_windows_files(spark, sf_dir):
    """W3 W4 W5 over S3: the drawn windows' bytes read straight from the token files."""
    win = windows_from_files(spark, f"{_token_files(spark, sf_dir)}/train", N_WINDOWS, BLOCK,
                             seed=SEED, world_size=WORLD, batch_size=BATCH)
    return win.select(F.col("rank").cast("bigint").alias("rank"), "sample_id", "batch_id", "start",
                      positional_checksum("x").alias("x_checksum"),
                      positional_checksum("y").alias("y_checksum"))


@query("window_eval_loss_files", oracle=ORACLES["window_eval_loss"])
def q_window_eval_loss_files(spark, sf_dir):
    """M1 A4 over S3: both splits' evaluation windows read from the token files."""
    root = _token_files(spark, sf_dir)
    counts = mq._train_counts(spark, sf_dir)
    wins = None
    for split in SPLITS:
        w = windows_from_files(spark, f"{root}/{split}", mq.EVAL_BATCHES * mq.BATCH, mq.BLOCK,
                               seed=1337, batch_size=mq.BATCH).withColumn("split", F.lit(split))
        wins = w if wins is None else wins.unionByName(w)
    scored = score_windows(counts, wins, mq.V, ["split", "batch_id", "sample_id"])
    return eval_loss(scored).select("split", "n_batches", F.round("loss", 9).alias("loss"))


# A stretch of the train stream that begins and ends inside rows of the scan.
RANGE_FIRST, RANGE_END, RANGE_ROW = 100_003, 300_007, 4_096


@query("tokenbin_range", oracle=f"""
WITH {TOKENS_CTE.strip()}
SELECT count(*)::BIGINT AS n_tokens, sum(tok)::BIGINT AS token_sum,
       sum(tok * ((pos + 1) % {PRIME}) % {PRIME})::BIGINT AS checksum
FROM t WHERE split = 'train' AND pos >= {RANGE_FIRST} AND pos < {RANGE_END}""")
def q_tokenbin_range(spark, sf_dir):
    """S3: one stretch of the train stream, its bounds pushed into the scan."""
    root = _token_files(spark, sf_dir)
    rows = read_token_range(spark, f"{root}/train", RANGE_FIRST, RANGE_END, RANGE_ROW)
    return _stream_stats(rows, "train").drop("split")


@query("tokenbin_splits", oracle=ORACLES["tokenbin_roundtrip"])
def q_tokenbin_splits(spark, sf_dir):
    """S3: a prepared folder read as one data set, which needs both its splits."""
    rows = read_token_splits(spark, _token_files(spark, sf_dir))
    out = None
    for split in SPLITS:
        s = _stream_stats(rows.where(F.col("split") == split), split)
        out = s if out is None else out.unionByName(s)
    return out


@query("prepare_corpus_continued", oracle=_prepared_sql(PRETRAIN_MAX_TOKENS))
def q_prepare_corpus_continued(spark, sf_dir):
    """P7 W1 K1 in two runs: half the ids first, then the whole table, of which the rest is new."""
    root = scratch_path(spark, "continued")
    docs = table(spark, sf_dir, "documents")
    middle = docs.agg(F.expr("CAST(avg(doc_id) AS BIGINT)")).first()[0]
    continue_corpus(docs.where(F.col("doc_id") <= F.lit(middle)), root)
    continue_corpus(docs, root)
    return _prepared_stats(spark, root)
