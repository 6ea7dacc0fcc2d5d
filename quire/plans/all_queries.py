"""Import every query module so that the registry is complete."""

from quire.plans import corpus_queries  # noqa: F401
from quire.plans import sft_queries  # noqa: F401
from quire.plans import model_queries  # noqa: F401
from quire.plans import runlog_queries  # noqa: F401
from quire.plans import io_queries  # noqa: F401
from quire.plans import stream_queries  # noqa: F401
