"""ST1 into K1: a document stream written straight into token files, each epoch once.

Every micro-batch is one epoch of one writer.  Its documents go behind those of the
epochs before, in key order, and both streams' manifests name the epoch when they
publish it.  A replayed epoch finds itself named and adds nothing; one that had been
published for one split only is completed for the other.  There is no ledger beside the
files: how far a stream has come is what its manifest says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.offsets import stream_offsets
from quire.operators.split import assign_split
from quire.operators.tokenize import ByteTokenizer, Tokenizer, token_count, tokenize
from quire.session import ship_package
from quire.sources.tokenbin import stream_state, write_token_stream

SPLITS = ("train", "val")


class TokenFileSink:
    """The ``foreachBatch`` function that appends a micro-batch to ``path/train`` and ``path/val``."""

    def __init__(self, path: str, writer: str = "stream", order_by: str = "doc_id",
                 text_col: str = "text", tokenizer: Tokenizer | None = None):
        self.path, self.writer = path.rstrip("/"), writer
        self.order_by, self.text_col = order_by, text_col
        self.tokenizer = tokenizer or ByteTokenizer()

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        states = [stream_state(f"{self.path}/{s}") for s in SPLITS]
        if all(s is not None and s["epochs"].get(self.writer, -1) >= epoch for s in states):
            return
        base = F.lit(0).cast("bigint")
        for split, state in zip(SPLITS, states):
            base = F.when(F.col("split") == split,
                          F.lit(state["n_tokens"] if state else 0)).otherwise(base)
        batch.persist()
        try:
            docs = assign_split(batch.select(self.order_by, self.text_col), self.order_by)
            docs = docs.withColumn("n_tokens", token_count(F.col(self.text_col), self.tokenizer))
            placed = stream_offsets(docs, self.order_by, quantile_source=batch).withColumn(
                "start", F.col("start") + base)
            tokens = tokenize(placed, self.text_col, self.tokenizer, len_col=None)
            write_token_stream(tokens, self.path, route_col="split", routes=SPLITS,
                               vocab_size=self.tokenizer.vocab_size,
                               eot_id=self.tokenizer.eot_id, repartition=False, mode="append",
                               epoch=f"{self.writer}:{epoch}")
        finally:
            batch.unpersist()


def stream_token_files(stream: DataFrame, path: str, checkpoint: str, writer: str = "stream",
                       order_by: str = "doc_id", text_col: str = "text",
                       tokenizer: Tokenizer | None = None):
    """Start the ingest of ``stream`` into token files; returns the streaming query.

    ``checkpoint`` and ``path`` belong together: epochs are numbered by the checkpoint.
    Several streams may feed one path in turn, each under a ``writer`` name of its own.
    """
    ship_package(stream.sparkSession)
    sink = TokenFileSink(path, writer, order_by, text_col, tokenizer)
    return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
