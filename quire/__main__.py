"""Command line for the preparation and generation jobs.

    python -m quire prepare-corpus --input docs.parquet --output out/ [--max-tokens N]
    python -m quire prepare-sft --input instructions.parquet --output out/ [--conversations]
    python -m quire generate --prompts prompts.parquet --train docs.parquet --output gen/
    python -m quire early-stop --evals run_eval/ --patience 5 --output summary/

Inputs are any Spark-readable table (``--format``, default parquet); outputs
go to shared storage.  Token files are ``tokenbin`` directories.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F


def _read(spark, path, fmt):
    return spark.read.format(fmt).load(path)


def _tokenizer(args):
    from quire.operators.tokenize import BpeTokenizer, ByteTokenizer

    return BpeTokenizer(args.bpe_ranks) if getattr(args, "bpe_ranks", None) else ByteTokenizer()


def cmd_prepare_corpus(spark, args):
    from quire.plans.prepare import prepare_corpus
    from quire.sources.corpus import read_corpus

    docs = read_corpus(spark, args.input, args.text_col, args.id_col, args.format)
    rep = prepare_corpus(docs, args.output, _tokenizer(args),
                         max_tokens=args.max_tokens or None, fraction=args.val_fraction,
                         seed=args.seed)
    rep.show(truncate=False)


def cmd_prepare_sft(spark, args):
    from quire.plans.prepare import prepare_sft
    from quire.sources.corpus import conversations_to_instructions, normalize_instructions

    src = _read(spark, args.input, args.format)
    if args.conversations:
        ex, keys = conversations_to_instructions(src), ["conv_id", "turn"]
    else:
        ex, keys = normalize_instructions(src, args.id_col), ["ex_id"]
    rep = prepare_sft(ex, args.output, _tokenizer(args), max_tokens=args.max_tokens,
                      fraction=args.val_fraction, seed=args.seed, key_cols=keys)
    rep.show(truncate=False)


def cmd_generate(spark, args):
    from quire.functions.text import extract_response, inference_prompt
    from quire.operators.generate import bigram_model, generate
    from quire.operators.ngram import fit_ngram
    from quire.operators.tokenize import ByteTokenizer, detokenize_col, tokenize

    tok = ByteTokenizer()
    counts = fit_ngram(_read(spark, args.train, args.format), text_col=args.text_col)
    model = bigram_model(counts, tok.vocab_size, keep=args.top_k)
    p = _read(spark, args.prompts, args.format)
    p = p.select(F.col(args.id_col).alias("prompt_id"),
                 inference_prompt(F.col(args.instruction_col)).alias("prompt"))
    p = tokenize(p, "prompt", tok, add_eot=False, on_special="raise", out_col="prompt_tokens",
                 len_col=None)
    g = generate(p, model, "prompt_id", max_new_tokens=args.max_new_tokens,
                 temperature=args.temperature, top_k=args.top_k, stop_id=tok.eot_id,
                 seed=args.seed)
    full = detokenize_col(F.concat("prompt_tokens", "generated"), tok)
    g.select("prompt_id", "prompt", extract_response(full, F.col("prompt")).alias("response")) \
        .write.mode("overwrite").parquet(args.output)


def cmd_early_stop(spark, args):
    from quire.operators.runlog import early_stop, mark_improvements, read_run_log

    ev = read_run_log(spark, args.evals, "eval")
    early_stop(ev, args.patience).write.mode("overwrite").parquet(args.output)


def main(argv=None):
    ap = argparse.ArgumentParser(prog="quire")
    sub = ap.add_subparsers(dest="cmd", required=True)

    def common(p):
        p.add_argument("--format", default="parquet")
        p.add_argument("--seed", type=int, default=1337)

    p = sub.add_parser("prepare-corpus")
    common(p)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--text-col", default="text")
    p.add_argument("--id-col", default="doc_id")
    p.add_argument("--max-tokens", type=int, default=7_000_000_000)
    p.add_argument("--val-fraction", type=float, default=0.01)
    p.add_argument("--bpe-ranks")
    p.set_defaults(fn=cmd_prepare_corpus)

    p = sub.add_parser("prepare-sft")
    common(p)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--id-col", default="ex_id")
    p.add_argument("--conversations", action="store_true")
    p.add_argument("--max-tokens", type=int, default=0)
    p.add_argument("--val-fraction", type=float, default=0.01)
    p.add_argument("--bpe-ranks")
    p.set_defaults(fn=cmd_prepare_sft)

    p = sub.add_parser("generate")
    common(p)
    p.add_argument("--prompts", required=True)
    p.add_argument("--train", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--id-col", default="prompt_id")
    p.add_argument("--instruction-col", default="instruction")
    p.add_argument("--text-col", default="text")
    p.add_argument("--max-new-tokens", type=int, default=200)
    p.add_argument("--temperature", type=float, default=0.7)
    p.add_argument("--top-k", type=int, default=200)
    p.set_defaults(fn=cmd_generate, seed=1234)

    p = sub.add_parser("early-stop")
    common(p)
    p.add_argument("--evals", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--patience", type=int, default=5)
    p.set_defaults(fn=cmd_early_stop)

    args = ap.parse_args(argv)
    from quire.session import get_spark, ship_package

    spark = get_spark()
    ship_package(spark)
    args.fn(spark, args)


if __name__ == "__main__":
    sys.exit(main())
