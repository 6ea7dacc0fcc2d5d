"""ST3: live early stopping per run with ``applyInPandasWithState``.

State per run: best loss and its iteration, patience, stop iteration, the last
iteration folded and row counts.  Each micro-batch's rows of a run are sorted by
iteration and folded in NumPy (running minimum, last improvement), then one
summary row per touched run is emitted (update mode; the latest row per run is
the answer).  A row whose iteration is not past the last one folded, or past the
stop, comes too late: it is counted in ``n_late`` and otherwise ignored, so the
answer equals the batch form's on a log that arrives in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from quire.operators.runlog import INITIAL_BEST

OUTPUT_SCHEMA = ("run_id long, stop_iter long, n_evals long, best_val double, best_iter long, "
                 "n_seen long, n_late long")
STATE_SCHEMA = ("best double, best_iter long, patience long, stop_iter long, last_iter long, "
                "n_seen long, n_evals long, n_late long")
# No iteration is as small: nothing folded, no best, no stop yet.
NONE = -(2 ** 62)


def _fold(vals: np.ndarray, iters: np.ndarray, best: float, best_iter: int, patience: int,
          limit: int):
    """Fold a run's new evaluations; returns updated state, the stop iteration and rows used."""
    n = len(vals)
    filled = np.where(np.isnan(vals), np.inf, vals)  # a missing loss never improves
    prev_min = np.minimum.accumulate(np.concatenate([[best], filled]))[:-1]
    improved = filled < prev_min
    idx = np.arange(n)
    last_imp = np.maximum.accumulate(np.where(improved, idx, -1))
    pat = np.where(last_imp >= 0, idx - last_imp, patience + idx + 1)
    hits = np.flatnonzero(pat >= limit) if limit > 0 else []
    upto = int(hits[0]) + 1 if len(hits) else n
    imp = np.flatnonzero(improved[:upto])
    if len(imp):
        best, best_iter = float(vals[imp[-1]]), int(iters[imp[-1]])
    stop = int(iters[upto - 1]) if len(hits) else NONE
    return best, best_iter, int(pat[upto - 1]), stop, upto


def early_stop_state_fn(limit: int, iter_col: str, val_col: str):
    def fn(key, pdfs, state):
        best, best_iter, patience, stop_iter, last_iter, n_seen, n_evals, n_late = (
            state.get if state.exists else (INITIAL_BEST, NONE, 0, NONE, NONE, 0, 0, 0))
        parts = [(p[iter_col].to_numpy(dtype=np.int64), p[val_col].to_numpy(dtype=np.float64))
                 for p in pdfs]
        iters = np.concatenate([i for i, _ in parts])
        vals = np.concatenate([v for _, v in parts])
        n_seen += len(iters)
        order = np.argsort(iters, kind="stable")
        iters, vals = iters[order], vals[order]
        fresh = iters > last_iter
        fresh[1:] &= iters[1:] > iters[:-1]
        if stop_iter != NONE:
            fresh[:] = False
        n_late += int(len(iters) - fresh.sum())
        iters, vals = iters[fresh], vals[fresh]
        if len(iters):
            best, best_iter, patience, stop_iter, used = _fold(vals, iters, best, best_iter,
                                                               patience, limit)
            last_iter = int(iters[used - 1])
            n_evals += used
            n_late += len(iters) - used
        state.update((best, best_iter, patience, stop_iter, last_iter, n_seen, n_evals, n_late))
        yield pd.DataFrame({
            "run_id": [int(key[0])], "stop_iter": [None if stop_iter == NONE else stop_iter],
            "n_evals": [n_evals], "best_val": [None if best_iter == NONE else best],
            "best_iter": [None if best_iter == NONE else best_iter],
            "n_seen": [n_seen], "n_late": [n_late]})

    return fn


def stream_early_stop(stream: DataFrame, limit: int, run_col: str = "run_id",
                      iter_col: str = "iter", val_col: str = "val_loss") -> DataFrame:
    """Streaming DataFrame of per-run summaries ``(run_id, stop_iter, n_evals, best_val, ...)``.

    A micro-batch bounds what is held of one run at a time: its iterations and losses.
    """
    from quire.session import ship_package

    ship_package(stream.sparkSession)
    fn = early_stop_state_fn(limit, iter_col, val_col)
    return stream.select(run_col, iter_col, val_col).groupBy(run_col).applyInPandasWithState(
        fn, OUTPUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)
