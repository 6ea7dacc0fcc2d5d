"""quire - a token-corpus engine on Spark.

Top-level names are loaded lazily (PEP 562), so Python workers that unpickle
one operator do not import the whole package.
"""

from __future__ import annotations

import importlib

_API = {
    # sources / sinks
    "read_corpus": "quire.sources.corpus",
    "read_instructions": "quire.sources.corpus",
    "conversations_to_instructions": "quire.sources.corpus",
    "read_token_stream": "quire.sources.tokenbin",
    "write_token_stream": "quire.sources.tokenbin",
    "write_sft_bins": "quire.sources.tokenbin",
    "read_token_meta": "quire.sources.tokenbin",
    # operators
    "ByteTokenizer": "quire.operators.tokenize",
    "BpeTokenizer": "quire.operators.tokenize",
    "tokenize": "quire.operators.tokenize",
    "detokenize_col": "quire.operators.tokenize",
    "assign_split": "quire.operators.split",
    "prefix_aggregate": "quire.operators.scan",
    "stream_offsets": "quire.operators.offsets",
    "token_budget": "quire.operators.offsets",
    "pack_blocks": "quire.operators.pack",
    "sample_windows": "quire.operators.sample",
    "build_sft": "quire.operators.sft",
    "sft_sequences": "quire.operators.sft",
    "fit_ngram": "quire.operators.ngram",
    "ngram_eval_loss": "quire.operators.ngram",
    "score_windows": "quire.operators.ngram",
    "score_with_model": "quire.operators.ngram",
    "eval_loss": "quire.operators.ngram",
    "generate": "quire.operators.generate",
    "bigram_model": "quire.operators.generate",
    "corpus_report": "quire.operators.report",
    "observe_tokens": "quire.operators.report",
    "run_plan": "quire.operators.report",
    "param_summary": "quire.operators.report",
    "mark_improvements": "quire.operators.runlog",
    "early_stop": "quire.operators.runlog",
    "checkpoints": "quire.operators.runlog",
    "step_time": "quire.operators.runlog",
    "ema": "quire.operators.runlog",
    "step_loss": "quire.operators.runlog",
    "write_run_log": "quire.operators.runlog",
    # jobs and streams
    "prepare_corpus": "quire.plans.prepare",
    "prepare_sft": "quire.plans.prepare",
    "stream_tokenize": "quire.streaming.ingest",
    "stream_budget": "quire.streaming.ingest",
    "stream_early_stop": "quire.streaming.early_stop",
    "get_spark": "quire.session",
}

__all__ = sorted(_API)


def __getattr__(name: str):
    if name in _API:
        return getattr(importlib.import_module(_API[name]), name)
    raise AttributeError(f"module 'quire' has no attribute {name!r}")
