"""Tokenization with a pluggable tokenizer.

The tokenizer runs inside Arrow-batched UDFs (``arrow_udf``): one Arrow batch
in, one ``list<int32>`` array out, no per-row Python for the byte codec (the
UTF-8 buffer of the batch *is* the token array).  A tokenizer object is
pickled into the UDF closure; heavy state (BPE ranks) is loaded once per
Python worker and cached.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import EOT_TEXT
from quire.session import bound_batches, ship_package

# Texts that go to a Python worker at a time.
TEXTS_PER_BATCH = 1000
TOKENS_TYPE = T.ArrayType(T.IntegerType(), containsNull=False)


def _string_buffers(text: pa.Array):
    """(offsets int64 relative to 0, uint8 data) of a (large_)string array; nulls -> ''."""
    if text.null_count:
        text = pc.fill_null(text, "")
    if not (pa.types.is_string(text.type) or pa.types.is_large_string(text.type)):
        text = text.cast(pa.string())
    off_dtype = np.int64 if pa.types.is_large_string(text.type) else np.int32
    bufs = text.buffers()
    offs = np.frombuffer(bufs[1], dtype=off_dtype)[text.offset: text.offset + len(text) + 1]
    offs = offs.astype(np.int64)
    data = (np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None
            else np.zeros(0, np.uint8))
    return offs - offs[0], data[offs[0]: offs[-1]]


class Tokenizer:
    """Plug-in interface.  Subclasses implement ``encode_ordinary``/``decode``."""

    eot_id: int
    vocab_size: int
    name: str = "tokenizer"

    def encode_arrow(self, text: pa.Array, add_eot: bool, on_special: str) -> pa.Array:
        out = []
        eot = [self.eot_id] if add_eot else []
        for s in text.to_pylist():
            s = s or ""
            if on_special == "raise" and EOT_TEXT in s:
                raise ValueError(f"special token text {EOT_TEXT!r} found in input")
            out.append(self.encode_ordinary(s) + eot)
        return pa.array(out, type=pa.list_(pa.int32()))

    def decode_arrow(self, tokens: pa.Array) -> pa.Array:
        return pa.array([None if t is None else self.decode(t) for t in tokens.to_pylist()],
                        type=pa.string())

    def length_expr(self, text: Column, add_eot: bool) -> Column | None:
        """Exact token count as a JVM expression, when the codec allows it."""
        return None

    def encode_ordinary(self, s: str) -> list[int]:  # pragma: no cover - interface
        raise NotImplementedError

    def decode(self, ids: list[int]) -> str:  # pragma: no cover - interface
        raise NotImplementedError


class ByteTokenizer(Tokenizer):
    """UTF-8 bytes as ids 0..255, end-of-text = 256 (vocabulary 257)."""

    name = "bytes"
    eot_id = 256
    vocab_size = 257

    def encode_arrow(self, text, add_eot, on_special):
        if on_special == "raise":
            hit = pc.any(pc.match_substring(text, EOT_TEXT)).as_py()
            if hit:
                raise ValueError(f"special token text {EOT_TEXT!r} found in input")
        rel, data = _string_buffers(text)
        vals = data.astype(np.int32)
        if add_eot:
            vals = np.insert(vals, rel[1:], self.eot_id)
            rel = rel + np.arange(len(rel), dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(rel.astype(np.int32)), pa.array(vals))

    def length_expr(self, text, add_eot):
        n = F.octet_length(F.coalesce(text, F.lit("")))
        return n + 1 if add_eot else n

    def encode_ordinary(self, s):
        return list(s.encode("utf-8"))

    def decode(self, ids):
        eot = EOT_TEXT.encode("utf-8")
        return b"".join(eot if i == self.eot_id else bytes((i,)) for i in ids).decode(
            "utf-8", errors="replace")

    def decode_arrow(self, tokens):
        out = []
        eot = EOT_TEXT.encode("utf-8")
        offs = tokens.offsets.to_numpy()
        offs = offs - offs[0]
        vals = tokens.flatten().to_numpy(zero_copy_only=False)
        valid = tokens.is_valid().to_numpy(zero_copy_only=False)
        for r in range(len(tokens)):
            if not valid[r]:
                out.append(None)
                continue
            seg = vals[offs[r]: offs[r + 1]]
            is_eot = seg == self.eot_id
            if is_eot.any():
                b = b"".join(eot if i == self.eot_id else bytes((int(i),)) for i in seg)
            else:
                b = seg.astype(np.uint8).tobytes()
            out.append(b.decode("utf-8", errors="replace"))
        return pa.array(out, type=pa.string())


@functools.lru_cache(maxsize=4)
def _load_bpe(rank_path: str, pat_str: str, eot_text: str):
    import tiktoken  # imported on the worker

    ranks = {}
    with open(rank_path, "rb") as fh:
        for line in fh:
            if line.strip():
                tok, rank = line.split()
                ranks[base64.b64decode(tok)] = int(rank)
    return tiktoken.Encoding(name=f"bpe:{rank_path}", pat_str=pat_str,
                             mergeable_ranks=ranks,
                             special_tokens={eot_text: len(ranks)})


class BpeTokenizer(Tokenizer):
    """Byte-pair encoding from a user-supplied rank file (tiktoken format).

    ``rank_path`` must be readable from every executor (shared storage); the
    ranks are loaded once per Python worker.  End-of-text id = number of ranks.
    """

    name = "bpe"
    # Fixed value: the GPT-2 pre-tokenisation pattern.
    GPT2_PATTERN = (r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

    def __init__(self, rank_path: str, pat_str: str | None = None):
        self.rank_path = rank_path
        self.pat_str = pat_str or self.GPT2_PATTERN
        enc = self._enc()
        self.eot_id = enc.eot_token
        self.vocab_size = enc.n_vocab

    def _enc(self):
        return _load_bpe(self.rank_path, self.pat_str, EOT_TEXT)

    def encode_arrow(self, text, add_eot, on_special):
        enc = self._enc()
        texts = [s or "" for s in text.to_pylist()]
        if on_special == "raise":
            ids = [enc.encode(s, allowed_special=set(), disallowed_special="all") for s in texts]
        else:
            ids = enc.encode_ordinary_batch(texts)
        if add_eot:
            ids = [x + [self.eot_id] for x in ids]
        return pa.array(ids, type=pa.list_(pa.int32()))

    def encode_ordinary(self, s):
        return self._enc().encode_ordinary(s)

    def decode(self, ids):
        return self._enc().decode(list(ids))


def token_udf(tokenizer: Tokenizer, add_eot: bool = True, on_special: str = "ordinary"):
    ship_package()
    spark = SparkSession.getActiveSession()
    if spark is not None:
        bound_batches(spark, TEXTS_PER_BATCH)

    @F.arrow_udf(TOKENS_TYPE)
    def _encode(text: pa.Array) -> pa.Array:
        return tokenizer.encode_arrow(text, add_eot, on_special)

    return _encode


def tokenize(df: DataFrame, text_col: str = "text", tokenizer: Tokenizer | None = None,
             add_eot: bool = True, on_special: str = "ordinary",
             out_col: str = "tokens", len_col: str | None = "n_tokens") -> DataFrame:
    """Add ``tokens ARRAY<INT>`` (and ``n_tokens``).

    ``on_special='ordinary'`` encodes special-token text as plain text (corpus
    preparation); ``'raise'`` fails on it (inference prompts).
    """
    tok = tokenizer or ByteTokenizer()
    bound_batches(df.sparkSession, TEXTS_PER_BATCH)
    out = df.withColumn(out_col, token_udf(tok, add_eot, on_special)(F.col(text_col)))
    if len_col:
        out = out.withColumn(len_col, F.size(out_col))
    return out


def token_count(text: Column, tokenizer: Tokenizer | None = None, add_eot: bool = True) -> Column:
    """Exact token count; JVM-only for the byte codec, else through the UDF."""
    tok = tokenizer or ByteTokenizer()
    expr = tok.length_expr(text, add_eot)
    if expr is not None:
        return expr.cast("int")
    return F.size(token_udf(tok, add_eot)(text))


def detokenize_col(tokens: Column, tokenizer: Tokenizer | None = None) -> Column:
    """T5: ids -> text (invalid UTF-8 becomes U+FFFD, like the codec's decode)."""
    tok = tokenizer or ByteTokenizer()
    ship_package()

    @F.arrow_udf(T.StringType())
    def _decode(t: pa.Array) -> pa.Array:
        return tok.decode_arrow(t)

    return _decode(tokens)
