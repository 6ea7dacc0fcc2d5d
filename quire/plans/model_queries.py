"""Driver queries for the model side: bigram fit/eval, masked NLL, sampling, generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.arrays import positional_checksum
from quire.functions.sampling import masked_nll, with_sampled_token
from quire.functions.text import EOT_TEXT, extract_response, inference_prompt
from quire.operators.backoff import (DISCOUNT, backoff_eval_loss, continuation_counts, gram_counts,
                                     suffix_counts)
from quire.operators.generate import bigram_model, generate
from quire.operators.ngram import eval_loss, fit_ngram, ngram_eval_loss, score_windows
from quire.operators.sample import sample_windows
from quire.operators.split import assign_split
from quire.operators.stepwise import bigram_draws, generate_by_steps, seen_draws
from quire.operators.tokenize import ByteTokenizer, detokenize_col, tokenize
from quire.plans.corpus import tokenized_corpus
from quire.plans.corpus_queries import DOCS_CTE, TOKENS_CTE
from quire.plans.registry import ORACLES, query, table
from quire.plans.sft_queries import _strip_sql
from quire.session import materialize
from quire.sources.corpus import conversations_to_instructions

V = ByteTokenizer.vocab_size
EOT = ByteTokenizer.eot_id
GEN_SEED = 1234
TEMPERATURE = 0.7
TOP_K = 200
MAX_NEW = 200
# Fixed value: batches per split of one evaluation.
EVAL_BATCHES = 200
BATCH = 4
BLOCK = 512

PAIRS_SQL = DOCS_CTE + """,
tk AS (
  SELECT split, list_transform(regexp_extract_all(hex(encode(text)), '..'),
                               lambda x: ('0x' || x)::INTEGER) || [256] AS toks FROM d),
pr AS (
  SELECT split, toks[i] AS prev, toks[i + 1] AS nxt
  FROM (SELECT split, toks, unnest(range(1, len(toks))) AS i FROM tk)),
pc AS (SELECT split, prev, nxt, count(*) AS m FROM pr GROUP BY split, prev, nxt),
tr AS (SELECT prev, nxt, m AS c FROM pc WHERE split = 'train'),
tt AS (SELECT prev, sum(c) AS t FROM tr GROUP BY prev)"""


def _train_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_split(docs).where(F.col("split") == "train")


def _train_counts(spark, sf_dir):
    """Bigram counts of the train split, tokenized inside the counting pass."""
    return fit_ngram(_train_docs(spark, sf_dir), text_col="text")


@query("ngram_counts", oracle=f"""
WITH {PAIRS_SQL.strip()}
SELECT prev, nxt AS next, c::BIGINT AS cnt FROM tr""")
def q_ngram_counts(spark, sf_dir):
    """M2: bigram counts over the train split's byte tokens."""
    return _train_counts(spark, sf_dir)


@query("ngram_eval_loss", oracle=f"""
WITH {PAIRS_SQL.strip()}
SELECT pc.split, sum(m)::BIGINT AS n_pairs,
       round(-sum(m * ln((coalesce(c, 0) + 1) / (coalesce(t, 0) + {V}.0))) / sum(m), 9) AS loss
FROM pc LEFT JOIN tr ON pc.prev = tr.prev AND pc.nxt = tr.nxt
        LEFT JOIN tt ON pc.prev = tt.prev
GROUP BY pc.split""")
def q_ngram_eval_loss(spark, sf_dir):
    """M1 A5: token-level NLL of each split under the train bigram model."""
    docs = assign_split(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = fit_ngram(docs.where(F.col("split") == "train"), text_col="text")
    out = ngram_eval_loss(counts, docs, V, ["split"], text_col="text")
    return out.select("split", "n_pairs", F.round("loss", 9).alias("loss"))


@query("window_eval_loss", oracle=f"""
WITH {TOKENS_CTE.strip()},
pr AS (
  SELECT split, toks[i] AS prev, toks[i + 1] AS nxt
  FROM (SELECT split, toks, unnest(range(1, len(toks))) AS i FROM o)),
tr AS (SELECT prev, nxt, count(*) AS c FROM pr WHERE split = 'train' GROUP BY prev, nxt),
tt AS (SELECT prev, sum(c) AS t FROM tr GROUP BY prev),
n AS (SELECT split, max(total) AS total FROM o GROUP BY split),
w AS (
  SELECT n.split, s.sample_id, s.sample_id // {BATCH} AS batch_id,
         ('0x' || substr(md5('1337:' || CAST(s.sample_id AS VARCHAR)), 1, 15))::BIGINT
           % (n.total - {BLOCK} - 1) AS start
  FROM n, range({EVAL_BATCHES * BATCH}) s(sample_id)),
x AS (
  SELECT w.split, w.batch_id, w.sample_id, t.pos - w.start AS i, t.tok
  FROM w JOIN t ON t.split = w.split AND t.pos BETWEEN w.start AND w.start + {BLOCK}),
xy AS (
  SELECT a.split, a.batch_id, a.tok AS prev, b.tok AS nxt
  FROM x a JOIN x b ON a.split = b.split AND a.sample_id = b.sample_id AND b.i = a.i + 1),
bl AS (
  SELECT split, batch_id, avg(-ln((coalesce(c, 0) + 1) / (coalesce(t, 0) + {V}.0))) AS batch_loss
  FROM xy LEFT JOIN tr ON xy.prev = tr.prev AND xy.nxt = tr.nxt
          LEFT JOIN tt ON xy.prev = tt.prev
  GROUP BY split, batch_id)
SELECT split, count(*)::BIGINT AS n_batches, round(avg(batch_loss), 9) AS loss
FROM bl GROUP BY split""")
def q_window_eval_loss(spark, sf_dir):
    """Eval loss as a mean over sampled batches of per-batch mean NLL."""
    docs = table(spark, sf_dir, "documents")
    offs = tokenized_corpus(docs, with_tokens=False, keep_text=False)
    counts = _train_counts(spark, sf_dir)
    scored = []
    for split in ("train", "val"):
        w = sample_windows(offs.where(F.col("split") == split), EVAL_BATCHES * BATCH, BLOCK,
                           seed=1337, batch_size=BATCH, text_source=docs) \
            .withColumn("split", F.lit(split))
        scored.append(score_windows(counts, w, V, ["split", "batch_id", "sample_id"]))
    out = eval_loss(scored[0].unionByName(scored[1]))
    return out.select("split", "n_batches", F.round("loss", 9).alias("loss"))


@query("masked_nll", oracle="""
WITH z AS (
  SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label END AS target,
         embedding::DOUBLE[] AS l FROM embeddings),
s AS (SELECT *, list_max(l) AS mx FROM z)
SELECT vec_id, target,
       CASE WHEN target = -1 THEN NULL
            ELSE round(mx + ln(list_sum(list_transform(l, lambda x: exp(x - mx)))) - l[target + 1], 9)
       END AS nll
FROM s""")
def q_masked_nll(spark, sf_dir):
    """Cross-entropy of the 64-wide embedding as logits; label 0 -> ignored."""
    e = table(spark, sf_dir, "embeddings")
    target = F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label"))
    return e.select("vec_id", target.alias("target"),
                    F.round(masked_nll(F.col("embedding"), target), 9).alias("nll"))


@query("sample_token", oracle=f"""
WITH z AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / {TEMPERATURE}) AS z FROM embeddings),
k AS (SELECT vec_id, z, list_max(z) AS mx,
             list_sort(z, 'DESC')[least(10, len(z))] AS thr FROM z),
w AS (SELECT vec_id, list_transform(z, lambda x: CASE WHEN x >= thr THEN exp(x - mx) ELSE 0.0 END) AS w
      FROM k),
c AS (SELECT vec_id, w, list_transform(range(1, len(w) + 1), lambda i: list_sum(w[1:i])) AS cum,
             ('0x' || substr(md5('{GEN_SEED}:' || CAST(vec_id AS VARCHAR) || ':0'), 1, 8))::BIGINT
               / 4294967296.0 AS u
      FROM w)
SELECT vec_id, (list_position(list_transform(cum, lambda x: x > u * cum[len(cum)]), true) - 1)::INTEGER
  AS token
FROM c""")
def q_sample_token(spark, sf_dir):
    """Temperature 0.7, top-10 (ties kept), softmax, hash-uniform multinomial draw."""
    e = table(spark, sf_dir, "embeddings")
    return with_sampled_token(e.select("vec_id", "embedding"), "embedding", "vec_id", "token",
                              seed=GEN_SEED, step=0, temperature=TEMPERATURE, top_k=10) \
        .select("vec_id", "token")


def _prompts(spark, sf_dir):
    pairs = conversations_to_instructions(table(spark, sf_dir, "conversations"))
    p = pairs.select("conv_id", "turn", inference_prompt(F.col("instruction")).alias("prompt"))
    p = p.withColumn("row_key", F.concat_ws("-", "conv_id", "turn"))
    return tokenize(p, "prompt", add_eot=False, on_special="raise", out_col="prompt_tokens",
                    len_col=None)


@query("generate_greedy", oracle=f"""
WITH RECURSIVE {PAIRS_SQL.strip()},
best AS MATERIALIZED (
  SELECT prev, nxt FROM (
    SELECT prev, nxt, row_number() OVER (PARTITION BY prev ORDER BY c DESC, nxt) AS r FROM tr)
  WHERE r = 1),
pp AS MATERIALIZED (
  SELECT conv_id, turn FROM (
    SELECT conv_id, turn, role,
           lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt_role FROM conversations)
  WHERE role = 'user' AND nxt_role = 'assistant'),
g(conv_id, turn, step, tok) AS (
  SELECT conv_id, turn, 0, 10 FROM pp
  UNION ALL
  SELECT g.conv_id, g.turn, g.step + 1, coalesce(b.nxt, 0)
  FROM g LEFT JOIN best b ON b.prev = g.tok
  WHERE g.step < {MAX_NEW} AND (g.step = 0 OR g.tok <> {EOT}))
SELECT conv_id, turn, count(*) FILTER (WHERE step > 0)::BIGINT AS n_new,
       coalesce(sum(tok * step) FILTER (WHERE step > 0), 0)::BIGINT AS checksum
FROM g GROUP BY conv_id, turn""")
def q_generate_greedy(spark, sf_dir):
    """G5 G6 (greedy): arg-max continuation (lowest id on ties) until end-of-text or 200."""
    model = bigram_model(_train_counts(spark, sf_dir), V, keep=1)
    g = generate(_prompts(spark, sf_dir), model, "row_key", max_new_tokens=MAX_NEW,
                 stop_id=EOT, greedy=True)
    return g.select("conv_id", "turn", F.size("generated").cast("bigint").alias("n_new"),
                    positional_checksum("generated").alias("checksum"))


@query("generate_sampled", oracle=f"""
WITH RECURSIVE {PAIRS_SQL.strip()},
ids AS (SELECT range AS id FROM range({V})),
lp AS (
  SELECT p.id AS prev, q.id AS nxt,
         ln((coalesce(tr.c, 0) + 1.0) / (coalesce(tt.t, 0) + {V})) / {TEMPERATURE} AS z
  FROM ids p CROSS JOIN ids q
       LEFT JOIN tr ON tr.prev = p.id AND tr.nxt = q.id
       LEFT JOIN tt ON tt.prev = p.id),
zl AS (SELECT prev, list(z ORDER BY nxt) AS zs FROM lp GROUP BY prev),
wl AS (SELECT prev, zs, list_max(zs) AS mx, list_sort(zs, 'DESC')[least({TOP_K}, {V})] AS thr FROM zl),
cw AS (SELECT prev, list_transform(zs, lambda x: CASE WHEN x >= thr THEN exp(x - mx) ELSE 0.0 END) AS w
       FROM wl),
cc AS (SELECT prev, list_transform(range(1, {V} + 1), lambda i: list_sum(w[1:i])) AS cum FROM cw),
pp AS (
  SELECT conv_id, turn FROM (
    SELECT conv_id, turn, role,
           lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt_role FROM conversations)
  WHERE role = 'user' AND nxt_role = 'assistant'),
g(conv_id, turn, step, tok) AS (
  SELECT conv_id, turn, 0, 10 FROM pp
  UNION ALL
  SELECT g.conv_id, g.turn, g.step + 1,
         list_position(list_transform(cc.cum, lambda x: x > u * cc.cum[{V}]), true) - 1
  FROM (SELECT *, ('0x' || substr(md5('{GEN_SEED}:' || CAST(conv_id AS VARCHAR) || '-'
                                      || CAST(turn AS VARCHAR) || ':' || CAST(step AS VARCHAR)),
                                  1, 8))::BIGINT / 4294967296.0 AS u
        FROM g) g
       JOIN cc ON cc.prev = g.tok
  WHERE g.step < {MAX_NEW} AND (g.step = 0 OR g.tok <> {EOT}))
SELECT conv_id, turn, count(*) FILTER (WHERE step > 0)::BIGINT AS n_new,
       coalesce(sum(tok * step) FILTER (WHERE step > 0), 0)::BIGINT AS checksum
FROM g GROUP BY conv_id, turn""")
def q_generate_sampled(spark, sf_dir):
    """Sampled continuation (T=0.7, top-200, hash uniforms) until end-of-text or 200."""
    model = bigram_model(_train_counts(spark, sf_dir), V, keep=TOP_K)
    g = generate(_prompts(spark, sf_dir), model, "row_key", max_new_tokens=MAX_NEW,
                 temperature=TEMPERATURE, top_k=TOP_K, stop_id=EOT, seed=GEN_SEED)
    return g.select("conv_id", "turn", F.size("generated").cast("bigint").alias("n_new"),
                    positional_checksum("generated").alias("checksum"))


# UTF-8 in upper-case hex: whole characters, and the longest beginnings of characters cut short.
_NEXT = "[89AB][0-9A-F]"
_WHOLE = "|".join((
    "[0-7][0-9A-F]", f"(?:C[2-9A-F]|D[0-9A-F]){_NEXT}", f"E0[AB][0-9A-F]{_NEXT}",
    f"E[1-9A-CEF]{_NEXT}{_NEXT}", f"ED[89][0-9A-F]{_NEXT}", f"F0[9AB][0-9A-F]{_NEXT}{_NEXT}",
    f"F[1-3]{_NEXT}{_NEXT}{_NEXT}", f"F48[0-9A-F]{_NEXT}{_NEXT}"))
_BROKEN = "|".join((
    "E0[AB][0-9A-F]", f"E[1-9A-CEF]{_NEXT}", "ED[89][0-9A-F]", f"F0[9AB][0-9A-F](?:{_NEXT})?",
    f"F[1-3]{_NEXT}(?:{_NEXT})?", f"F48[0-9A-F](?:{_NEXT})?", "[0-9A-F]{2}"))


def _response_sql():
    """The replayed ids as text: bytes up to end-of-text, broken UTF-8 as U+FFFD, stripped."""
    replay = ORACLES["generate_sampled"].rsplit("SELECT conv_id, turn, count(*)", 1)[0]
    text = _strip_sql(f"split_part(whole, '{EOT_TEXT}', 1)")
    return f"""{replay},
h AS (
  SELECT conv_id, turn, count(*) FILTER (WHERE step > 0)::BIGINT AS n_new,
         coalesce(string_agg(printf('%02X', tok), '' ORDER BY step)
                  FILTER (WHERE step > 0 AND tok <> {EOT}), '') AS bytes
  FROM g GROUP BY conv_id, turn),
w AS (
  SELECT conv_id, turn, n_new, decode(unhex(array_to_string(list_transform(
           regexp_extract_all(bytes, '{_WHOLE}|{_BROKEN}'),
           lambda x: CASE WHEN regexp_full_match(x, '{_WHOLE}') THEN x ELSE 'EFBFBD' END), '')))
         AS whole FROM h)
SELECT conv_id, turn, n_new, {text} AS response FROM w"""


@query("generate", oracle=_response_sql())
def q_generate(spark, sf_dir):
    """Sample 200 tokens (T=0.7, top-200) from the bigram model per prompt."""
    model = bigram_model(_train_counts(spark, sf_dir), V, keep=TOP_K)
    g = generate(_prompts(spark, sf_dir), model, "row_key", max_new_tokens=MAX_NEW,
                 temperature=TEMPERATURE, top_k=TOP_K, stop_id=EOT, seed=GEN_SEED)
    full = detokenize_col(F.concat("prompt_tokens", "generated"))
    return g.select("conv_id", "turn", F.size("generated").cast("bigint").alias("n_new"),
                    extract_response(full, F.col("prompt")).alias("response"))


# Ids generated per prompt where every step is a distributed join.
STEPS = 24


def _sampled_sql(keep, new):
    """The oracle of sampled generation with another top-k and length."""
    sql = ORACLES["generate_sampled"]
    return sql.replace(f"least({TOP_K}, {V})", f"least({keep}, {V})").replace(
        f"g.step < {MAX_NEW} ", f"g.step < {new} ")


@query("generate_distributed", oracle=_sampled_sql(V, STEPS))
def q_generate_distributed(spark, sf_dir):
    """Sampled continuation over the whole vocabulary from a model that stays a table."""
    draws = bigram_draws(_train_counts(spark, sf_dir), V, TEMPERATURE)
    g = generate_by_steps(_prompts(spark, sf_dir), "row_key", [(1, draws)], V,
                          max_new_tokens=STEPS, stop_id=EOT, seed=GEN_SEED)
    return g.select("conv_id", "turn", F.size("generated").cast("bigint").alias("n_new"),
                    positional_checksum("generated").alias("checksum"))


# Ids of an n-gram.
ORDER = 3

TRIGRAMS_SQL = DOCS_CTE + f""",
tk AS (
  SELECT split, [{V}, {V}] || list_transform(regexp_extract_all(hex(encode(text)), '..'),
                               lambda x: ('0x' || x)::INTEGER) || [{EOT}] AS toks FROM d),
tg AS (
  SELECT split, toks[i] AS a, toks[i + 1] AS b, toks[i + 2] AS w
  FROM (SELECT split, toks, unnest(range(1, len(toks) - 1)) AS i FROM tk)),
tc AS (SELECT split, a, b, w, count(*) AS m FROM tg GROUP BY ALL),
c3 AS (SELECT a, b, w, m AS c FROM tc WHERE split = 'train')"""


@query("backoff_eval_loss", oracle=f"""
WITH {TRIGRAMS_SQL.strip()},
c2 AS (SELECT b, w, count(*) AS c FROM c3 GROUP BY b, w),
c1 AS (SELECT w, count(*) AS c FROM c2 GROUP BY w),
t3 AS (SELECT a, b, sum(c) AS t, count(*) AS k FROM c3 GROUP BY a, b),
t2 AS (SELECT b, sum(c) AS t, count(*) AS k FROM c2 GROUP BY b),
t1 AS (SELECT sum(c) AS t, count(*) AS k FROM c1),
p1 AS (
  SELECT tc.*, greatest(coalesce(c1.c, 0) - {DISCOUNT}, 0) / t1.t
               + {DISCOUNT} * t1.k / t1.t / {V} AS p
  FROM tc LEFT JOIN c1 USING (w), t1),
p2 AS (
  SELECT p1.* EXCLUDE p, CASE WHEN t2.t IS NULL THEN p
           ELSE greatest(coalesce(c2.c, 0) - {DISCOUNT}, 0) / t2.t + {DISCOUNT} * t2.k / t2.t * p
         END AS p
  FROM p1 LEFT JOIN c2 USING (b, w) LEFT JOIN t2 USING (b)),
p3 AS (
  SELECT p2.* EXCLUDE p, CASE WHEN t3.t IS NULL THEN p
           ELSE greatest(coalesce(c3.c, 0) - {DISCOUNT}, 0) / t3.t + {DISCOUNT} * t3.k / t3.t * p
         END AS p
  FROM p2 LEFT JOIN c3 USING (a, b, w) LEFT JOIN t3 USING (a, b))
SELECT split, sum(m)::BIGINT AS n_tokens, round(-sum(m * ln(p)) / sum(m), 9) AS loss
FROM p3 GROUP BY split""")
def q_backoff_eval_loss(spark, sf_dir):
    """M1 M2: loss of each split under the train split's discounted trigrams."""
    docs = assign_split(table(spark, sf_dir, "documents").select("doc_id", "text"))
    grams = materialize(gram_counts(docs, ORDER, V, group_cols=["split"], text_col="text"), "grams")
    counts = continuation_counts(grams.where(F.col("split") == "train"), ORDER, V)
    out = backoff_eval_loss(counts, grams, V, ["split"])
    return out.select("split", "n_tokens", F.round("loss", 9).alias("loss"))


@query("continue_text", oracle=f"""
WITH RECURSIVE {TRIGRAMS_SQL.strip()},
r2 AS (SELECT a, b, list(w ORDER BY w) AS ids, list(e ORDER BY w) AS ends, max(e) AS whole FROM (
  SELECT a, b, w, sum(c::DOUBLE) OVER (PARTITION BY a, b ORDER BY w) AS e FROM c3) GROUP BY a, b),
r1 AS (SELECT b, list(w ORDER BY w) AS ids, list(e ORDER BY w) AS ends, max(e) AS whole FROM (
  SELECT b, w, sum(sum(c::DOUBLE)) OVER (PARTITION BY b ORDER BY w) AS e FROM c3 GROUP BY b, w)
  GROUP BY b),
r0 AS (SELECT list(w ORDER BY w) AS ids, list(e ORDER BY w) AS ends, max(e) AS whole FROM (
  SELECT w, sum(sum(c::DOUBLE)) OVER (ORDER BY w) AS e FROM c3 GROUP BY w)),
pp AS (
  SELECT conv_id, turn, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                       lambda x: ('0x' || x)::INTEGER) AS t
  FROM conversations WHERE role = 'user'),
g(conv_id, turn, step, y, x, tok) AS (
  SELECT conv_id, turn, 0, CASE WHEN len(t) > 1 THEN t[-2] END,
         CASE WHEN len(t) > 0 THEN t[-1] END, NULL::INTEGER FROM pp
  UNION ALL
  SELECT conv_id, turn, step + 1, x, tok, tok FROM (
    SELECT conv_id, turn, step, x,
           ids[len(list_filter(ends, lambda e: e <= u * whole)) + 1] AS tok
    FROM (
      SELECT g.*, coalesce(r2.ids, r1.ids, r0.ids) AS ids, coalesce(r2.ends, r1.ends, r0.ends) AS ends,
             coalesce(r2.whole, r1.whole, r0.whole) AS whole,
             ('0x' || substr(md5('{GEN_SEED}:' || CAST(conv_id AS VARCHAR) || '-'
                                 || CAST(turn AS VARCHAR) || ':' || CAST(step AS VARCHAR)),
                             1, 8))::BIGINT / 4294967296.0 AS u
      FROM g LEFT JOIN r2 ON r2.a = g.y AND r2.b = g.x LEFT JOIN r1 ON r1.b = g.x, r0
      WHERE g.step < {STEPS} AND (g.step = 0 OR g.tok <> {EOT}))))
SELECT conv_id, turn, count(*) FILTER (WHERE step > 0)::BIGINT AS n_new,
       coalesce(sum(tok * step) FILTER (WHERE step > 0), 0)::BIGINT AS checksum
FROM g GROUP BY conv_id, turn""")
def q_continue_text(spark, sf_dir):
    """Every user turn continued from the longest suffix of up to two ids that was seen."""
    grams = materialize(gram_counts(_train_docs(spark, sf_dir), ORDER, V, text_col="text"), "grams")
    draws = [(n, seen_draws(c, V)) for n, c in suffix_counts(grams, ORDER, V).items()]
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(
        "conv_id", "turn", "text", F.concat_ws("-", "conv_id", "turn").alias("row_key"))
    prompts = tokenize(turns, "text", add_eot=False, out_col="prompt_tokens", len_col=None)
    g = generate_by_steps(prompts, "row_key", draws, V, max_new_tokens=STEPS, stop_id=EOT,
                          seed=GEN_SEED)
    return g.select("conv_id", "turn", F.size("generated").cast("bigint").alias("n_new"),
                    positional_checksum("generated").alias("checksum"))
