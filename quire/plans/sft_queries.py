"""Driver queries over ``conversations``: instruction pairs, prompts, SFT tokens and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.arrays import count_where, positional_checksum
from quire.functions.text import EOT_TEXT, PY_WHITESPACE_CLASS, extract_response, format_prompt, \
    inference_prompt, py_strip
from quire.operators.pack import pack_blocks
from quire.operators.report import GIB, LABEL_BYTES, TOKEN_BYTES
from quire.operators.sft import build_sft, sft_sequences
from quire.plans.registry import query, table
from quire.sources.corpus import conversations_to_instructions

BLOCK = 512
SFT_BUDGET = 200_000
KEYS = ["conv_id", "turn"]

_WS = PY_WHITESPACE_CLASS


def _strip_sql(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{_WS}+|{_WS}+$', '', 'g')"


def _bytes_sql(x: str) -> str:
    return (f"list_transform(regexp_extract_all(hex(encode({x})), '..'), "
            f"lambda b: ('0x' || b)::INTEGER)")


PAIRS_CTE = """
p AS (
  SELECT conv_id, turn, text AS instruction, nxt_text AS output, nxt2_text AS following FROM (
    SELECT conv_id, turn, role, text,
           lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt_role,
           lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt_text,
           lead(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt2_text
    FROM conversations)
  WHERE role = 'user' AND nxt_role = 'assistant')"""

NL = "chr(10)"
EXAMPLES_CTE = PAIRS_CTE + f""",
e AS (
  SELECT conv_id, turn,
         '### Instruction:' || {NL} || {_strip_sql('instruction')} || {NL} || {NL}
           || '### Response:' || {NL} AS prompt,
         {_strip_sql('output')} AS response,
         CASE WHEN ('0x' || substr(md5('1337:' || CAST(conv_id AS VARCHAR) || ':'
                                       || CAST(turn AS VARCHAR)), 1, 8))::BIGINT
                   / 4294967296.0 < 0.01 THEN 'val' ELSE 'train' END AS split
  FROM p),
f AS (
  SELECT conv_id, turn, split, len(pt)::BIGINT AS prompt_len, pt || ot || [256] AS seq
  FROM (SELECT *, {_bytes_sql('prompt')} AS pt, {_bytes_sql('response')} AS ot FROM e))"""


def _examples(spark, sf_dir, following=False):
    conv = table(spark, sf_dir, "conversations")
    return conversations_to_instructions(conv, with_following_text=following)


@query("format_prompt", oracle=f"""
WITH {EXAMPLES_CTE.strip()}
SELECT conv_id, turn, prompt, response FROM e""")
def q_format_prompt(spark, sf_dir):
    """User->assistant pairs as instruction prompts and stripped responses."""
    from quire.functions.text import format_prompt

    ex = _examples(spark, sf_dir)
    return ex.select("conv_id", "turn", format_prompt(F.col("instruction"), F.col("input")).alias("prompt"),
                     py_strip(F.col("output")).alias("response"))


@query("format_prompt_input", oracle=f"""
WITH t AS (
  SELECT conv_id, turn, text AS instruction,
         CASE WHEN role_before = 'system' THEN text_before END AS input
  FROM (SELECT conv_id, turn, role, text,
               lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS role_before,
               lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS text_before
        FROM conversations)
  WHERE role = 'user'),
s AS (SELECT conv_id, turn, {_strip_sql('instruction')} AS i, {_strip_sql('input')} AS x FROM t)
SELECT conv_id, turn,
       '### Instruction:' || {NL} || i
       || CASE WHEN x <> '' THEN {NL} || {NL} || '### Input:' || {NL} || x ELSE '' END
       || {NL} || {NL} || '### Response:' || {NL} AS prompt
FROM s""")
def q_format_prompt_input(spark, sf_dir):
    """User turns as instructions, the system turn right before as their input."""
    from quire.functions.text import format_prompt
    from quire.operators.neighbors import row_index, with_neighbours

    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = with_neighbours(row_index(conv, ["conv_id"], ["turn"]), ["conv_id"],
                            F.col("role") == "user",
                            {"before": (-1, F.col("role") == "system")}, ["text"])
    return turns.select(
        "conv_id", "turn", format_prompt(F.col("text"), F.col("before.text")).alias("prompt"))


@query("build_sft", oracle=f"""
WITH {EXAMPLES_CTE.strip()}
SELECT conv_id, turn, split, prompt_len, len(seq)::BIGINT AS n_tokens,
       (len(seq) - prompt_len)::BIGINT AS n_labeled,
       list_sum(list_transform(range(prompt_len, len(seq)), lambda m: seq[m + 1] * m))::BIGINT
         AS label_checksum,
       list_sum(list_transform(range(len(seq)), lambda m: seq[m + 1] * (m + 1)))::BIGINT
         AS token_checksum
FROM f""")
def q_build_sft(spark, sf_dir):
    """Prompt ++ response ++ eot tokens with response-only shifted labels."""
    sft = build_sft(_examples(spark, sf_dir), key_cols=KEYS)
    return sft.select(
        "conv_id", "turn", "split", F.col("prompt_len").cast("bigint").alias("prompt_len"),
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        count_where("labels", lambda x: x != -1).cast("bigint").alias("n_labeled"),
        F.aggregate(F.transform("labels", lambda x, i: F.when(x != -1, x.cast("bigint") * (i + 1))
                                .otherwise(F.lit(0).cast("bigint"))),
                    F.lit(0).cast("bigint"), lambda a, v: a + v).alias("label_checksum"),
        positional_checksum("tokens").alias("token_checksum"))


@query("sft_report", oracle=f"""
WITH {EXAMPLES_CTE.strip()},
b AS (
  SELECT split, len(seq) AS n, len(seq) - prompt_len AS n_lab,
         sum(len(seq)) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           - len(seq) AS budget_start
  FROM f)
SELECT split, count(*)::BIGINT AS n_examples, sum(n)::BIGINT AS n_tokens,
       sum(n_lab)::BIGINT AS n_labeled,
       round(sum(n) * {TOKEN_BYTES} / {GIB}, 9) AS tokens_gib,
       round(sum(n) * {LABEL_BYTES} / {GIB}, 9) AS labels_gib
FROM b WHERE budget_start < {SFT_BUDGET} OR budget_start = 0
GROUP BY split""")
def q_sft_report(spark, sf_dir):
    """SFT examples under a 200,000-token budget, per split sizes."""
    kept = sft_sequences(_examples(spark, sf_dir), key_cols=KEYS, max_tokens=SFT_BUDGET,
                         quantile_source=table(spark, sf_dir, "conversations"))
    return kept.groupBy("split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_examples"),
        F.sum("n_tokens").cast("bigint").alias("n_tokens"),
        F.sum(count_where("labels", lambda x: x != -1)).cast("bigint").alias("n_labeled"),
        F.round(F.sum("n_tokens") * TOKEN_BYTES / GIB, 9).alias("tokens_gib"),
        F.round(F.sum("n_tokens") * LABEL_BYTES / GIB, 9).alias("labels_gib"))


@query("extract_response", oracle=f"""
WITH {PAIRS_CTE.strip()},
g AS (
  SELECT conv_id, turn, '### Instruction:' || {NL} || instruction || {NL} || {NL}
           || '### Response:' || {NL} AS prompt,
         CASE WHEN following IS NULL THEN output
              ELSE output || '{EOT_TEXT}' || following END AS continuation
  FROM p)
SELECT conv_id, turn,
       {_strip_sql("split_part(substr(prompt || continuation, length(prompt) + 1), '" + EOT_TEXT + "', 1)")}
         AS response
FROM g""")
def q_extract_response(spark, sf_dir):
    """Generated text = prompt ++ answer [++ marker ++ next turn]; recover the answer."""
    ex = _examples(spark, sf_dir, following=True)
    prompt = inference_prompt(F.col("instruction"))
    cont = F.when(F.col("following").isNull(), F.col("output")).otherwise(
        F.concat(F.col("output"), F.lit(EOT_TEXT), F.col("following")))
    g = ex.select("conv_id", "turn", prompt.alias("prompt"),
                  F.concat(prompt, cont).alias("full_text"))
    return g.select("conv_id", "turn", extract_response(F.col("full_text"), F.col("prompt")).alias("response"))


@query("pack_sft_blocks", oracle=f"""
WITH {EXAMPLES_CTE.strip()},
o AS (
  SELECT split, seq, prompt_len,
         sum(len(seq)) OVER (PARTITION BY split ORDER BY conv_id, turn
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len(seq) AS start,
         sum(len(seq)) OVER (PARTITION BY split) AS total
  FROM f),
t AS (
  SELECT split, total, start + i AS pos, seq[i + 1] AS tok,
         CASE WHEN i < len(seq) - 1 AND i + 1 >= prompt_len THEN seq[i + 2] ELSE -1 END AS lab
  FROM (SELECT *, unnest(range(len(seq))) AS i FROM o))
SELECT split, (pos // {BLOCK})::BIGINT AS block_id,
       sum(CASE WHEN lab <> -1 THEN 1 ELSE 0 END)::BIGINT AS n_labeled,
       sum(tok * (pos % {BLOCK} + 1))::BIGINT AS x_checksum,
       sum((lab + 1) * (pos % {BLOCK} + 1))::BIGINT AS y_checksum
FROM t WHERE (pos // {BLOCK}) * {BLOCK} + {BLOCK} <= total
GROUP BY split, pos // {BLOCK}""")
def q_pack_sft_blocks(spark, sf_dir):
    """512-blocks of the SFT stream with aligned (already shifted) labels."""
    seqs = sft_sequences(_examples(spark, sf_dir), key_cols=KEYS,
                         quantile_source=table(spark, sf_dir, "conversations"))
    blocks = pack_blocks(seqs, BLOCK, labels_col="labels", method="local")
    return blocks.select(
        "split", F.col("block_id").cast("bigint").alias("block_id"),
        count_where("labels", lambda x: x != -1).cast("bigint").alias("n_labeled"),
        positional_checksum("tokens").alias("x_checksum"),
        positional_checksum(F.transform("labels", lambda x: x + 1)).alias("y_checksum"))


@query("sft_hot_conversation", oracle=f"""
WITH {EXAMPLES_CTE.strip()},
h AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS conv_id,
             CASE WHEN conv_id % 3 = 0 THEN conv_id * 1000 + turn ELSE turn END AS turn,
             len(seq)::BIGINT AS n_tokens FROM f)
SELECT conv_id, turn, n_tokens,
       (sum(n_tokens) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        - n_tokens)::BIGINT AS start
FROM h""")
def q_sft_hot_conversation(spark, sf_dir):
    """W1 P8 over ``(conv_id, turn)`` where one conversation holds a third of the examples."""
    from quire.operators.offsets import stream_offsets
    from quire.operators.tokenize import token_count

    ex = _examples(spark, sf_dir)
    hot = F.col("conv_id") % 3 == 0
    n = (token_count(format_prompt(F.col("instruction"), F.col("input")), add_eot=False)
         + token_count(py_strip(F.col("output")))).cast("bigint")
    rows = ex.select(F.when(hot, 0).otherwise(F.col("conv_id")).cast("bigint").alias("conv_id"),
                     F.when(hot, F.col("conv_id") * 1000 + F.col("turn"))
                     .otherwise(F.col("turn")).cast("bigint").alias("turn"), n.alias("n_tokens"))
    return stream_offsets(rows, ["conv_id", "turn"], split_col=None)
