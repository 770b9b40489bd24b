"""Calling a text generator supplied by the caller.

The generator is any function from a prompt to a text; no client ships here.
Only the prompt column crosses into Python, in Arrow batches. A call that
raises fails its own row and nothing else.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOME = "response string, error string, seconds double"
# Characters of prompts and responses handed on at a time.
BATCH_CHARS = 4 << 20
EMPTY_RESPONSE = "Failed to generate simplified content"


def generated(prompt: Column, generate: Callable[[str], str]) -> Column:
    """Struct of the response, the error and the seconds taken; NULL prompts are skipped."""

    def call(text: str | None) -> tuple[str | None, str | None, float | None]:
        if text is None:
            return None, None, None
        start = time.perf_counter()
        try:
            response, error = generate(text), None
            if not response:
                response, error = None, EMPTY_RESPONSE
        except Exception as failure:  # noqa: BLE001 - any failure stays with its row
            response, error = None, str(failure) or type(failure).__name__
        return response, error, time.perf_counter() - start

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["response", "error", "seconds"]).astype(
            {"response": object, "error": object, "seconds": "float64"}
        )

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # A batch may hold thousands of long texts: responses go back in pieces.
        for prompts in batches:
            rows, chars = [], 0
            for prompt in prompts:
                rows.append(call(prompt))
                chars += len(prompt or "") + len(rows[-1][0] or "")
                if chars >= BATCH_CHARS:
                    yield frame(rows)
                    rows, chars = [], 0
            if rows:
                yield frame(rows)

    # Non-deterministic, so that no rewrite of the plan calls it twice.
    return F.pandas_udf(run, OUTCOME).asNondeterministic()(prompt)
