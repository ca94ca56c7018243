"""Run a user's model or judge over a table, with errors as data."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .model_process import ModelProcesses

OUTCOME = "raw_prediction string, error_kind string, error_message string, retriable boolean, latency_ms double, input_tokens long, output_tokens long, model_version string"


class InvalidOutput(Exception):
    """Raised by a model whose output is no prediction; the text is kept."""


#: pandas types that can hold nulls.
NULLABLE = {"retriable": "boolean", "relevant": "boolean", "unsupported": "boolean", "input_tokens": "Int64", "output_tokens": "Int64", "latency_ms": "Float64", "score": "Float64"}


def _typed(rows: list[dict], names: list[str], ids: pd.Series) -> pd.DataFrame:
    out = {ids.name: ids.reset_index(drop=True)}
    for n in names:
        out[n] = pd.Series([r.get(n) for r in rows], dtype=NULLABLE.get(n, "object"))
    return pd.DataFrame(out)


def run_model(df: DataFrame, make_model: Callable[[], Callable[[dict], dict]], id_col: str, input_cols: list[str], time_limit: float | None = None, processes: int = 1, retries: int = 0) -> DataFrame:
    """Call a model on each row: (id_col and OUTCOME).

    make_model runs once for each partition and gives a function from a row's inputs to a dict with raw_prediction and
    optional accounting. InvalidOutput keeps the raw text; a TimeoutError or any other exception becomes a typed error.
    A failing row never fails its task. With time_limit (seconds, above 0), calls run in up to processes processes a task,
    each with a model of its own: a call that takes longer is killed and a timeout, a call whose process dies is an
    adapter_error (ProcessDied), and either is called up to retries times more. A killed process is replaced by a new one.
    """
    if time_limit is not None and (time_limit <= 0 or processes < 1 or retries < 0):
        raise ValueError("time_limit must be above 0, processes at least 1, retries not negative")
    names = [f.split()[0] for f in OUTCOME.split(", ")]
    schema = StructType([df.schema[id_col], *StructType.fromDDL(OUTCOME).fields])

    def call(model: Callable[[dict], dict], row: dict) -> dict:
        start = time.perf_counter()
        try:
            out = dict(model(row))
        except InvalidOutput as e:
            out = {"raw_prediction": str(e)}
        except TimeoutError as e:
            out = {"error_kind": "timeout", "error_message": type(e).__name__, "retriable": True}
        except Exception as e:  # an adapter's failure is data here
            out = {"error_kind": "adapter_error", "error_message": type(e).__name__, "retriable": False}
        return {"latency_ms": (time.perf_counter() - start) * 1000} | out

    def make_call() -> Callable[[dict], dict]:
        model = make_model()
        return lambda row: call(model, row)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = make_call()
        for batch in batches:
            yield _typed([answer(r) for r in batch[input_cols].to_dict("records")], names, batch[id_col])

    modules = [m for m in (__name__, getattr(make_model, "__module__", None)) if m and m != "__main__"]

    def run_limited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late = {"error_kind": "timeout", "error_message": "TimeoutError", "retriable": True, "latency_ms": time_limit * 1000}
        lost = {"error_kind": "adapter_error", "error_message": "ProcessDied", "retriable": True}
        with ModelProcesses(make_call, time_limit, processes, modules) as pool:
            for batch in batches:
                yield _typed(pool.answers(batch[input_cols].to_dict("records"), late, lost, retries), names, batch[id_col])

    return df.select(*dict.fromkeys([id_col, *input_cols])).mapInPandas(run if time_limit is None else run_limited, schema)


JUDGMENT = "status string, relevant boolean, unsupported boolean, score double, error_kind string"


def run_judge(requests: DataFrame, make_judge: Callable[[], Callable[[dict], dict]], id_col: str, input_cols: list[str]) -> DataFrame:
    """Call a judge on each request: status ok with a judgment, or error with its kind and no judgment."""
    names = [f.split()[0] for f in JUDGMENT.split(", ")]
    schema = StructType([requests.schema[id_col], *StructType.fromDDL(JUDGMENT).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make_judge()
        for batch in batches:
            rows = []
            for r in batch[input_cols].to_dict("records"):
                try:
                    got = judge(r)
                    if not 0 <= got["score"] <= 1:
                        raise ValueError("score")
                    rows.append({"status": "ok", "relevant": bool(got["relevant"]), "unsupported": bool(got["unsupported"]), "score": float(got["score"])})
                except Exception as e:
                    rows.append({"status": "error", "error_kind": type(e).__name__})
            yield _typed(rows, names, batch[id_col])

    return requests.select(*dict.fromkeys([id_col, *input_cols])).mapInPandas(run, schema)


def judge_requests(items: DataFrame, id_col: str, text_col: str, evidence_col: str) -> DataFrame:
    """Scored items with at least one evidence entry, as a judge sees them."""
    return items.where((F.col("status") == "scored") & (F.size(evidence_col) > 0)).select(id_col, F.col(text_col).alias("source_text"), F.col(evidence_col).alias("evidence"))
