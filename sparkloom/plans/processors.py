"""External processors as batch functions with a checked contract: each row is abstained from, completed, excluded or failed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

# Outcomes of a processor.
OUTCOMES = ["abstained", "completed", "excluded", "failed"]
RESULT = "outcome string, proposal string, reasons array<string>"


class ContractError(ValueError):
    """A processor that doesn't declare itself rightly."""


@dataclass(frozen=True)
class Processor:
    """``run`` takes a batch of ``inputs`` and returns a frame of outcome, proposal (JSON or null) and reasons, a row for each of it, in
    its order. Results that break the contract count as failed, with the reason; an exception fails its batch, not the job."""

    name: str
    version: str
    inputs: tuple[str, ...]
    run: Callable[[pd.DataFrame], pd.DataFrame] = field(compare=False)

    def __post_init__(self):
        if not self.name or not self.version or not self.inputs:
            raise ContractError("a processor needs a name, a version and inputs")


def _checked(result: object, size: int) -> list[tuple[str, str | None, list[str]]]:
    failed = lambda why: [("failed", None, [why])] * size
    if not isinstance(result, pd.DataFrame) or not {"outcome", "proposal", "reasons"} <= set(result.columns):
        return failed("no_result_columns")
    if len(result) != size:
        return failed("result_count_differs")
    out = []
    for outcome, proposal, reasons in zip(result["outcome"], result["proposal"], result["reasons"]):
        why = None
        if outcome not in OUTCOMES:
            why = "unknown_outcome"
        elif isinstance(proposal, str):
            try:
                why = None if isinstance(json.loads(proposal), dict) else "proposal_is_no_object"
            except ValueError:
                why = "proposal_is_no_json"
        elif outcome == "completed":
            why = "completed_without_proposal"
        out.append(("failed", None, [why]) if why else (outcome, proposal if isinstance(proposal, str) else None, list(reasons) if reasons is not None else []))
    return out


def process(df: DataFrame, key: str, processor: Processor, batch: int = 1000) -> DataFrame:
    """(key, processor, version, outcome, proposal, reasons) of every row, in batches of at most ``batch`` that the processor sees whole."""
    if missing := [c for c in processor.inputs if c not in df.columns]:
        raise ContractError(f"{processor.name} needs columns that are not there: {missing}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch].reset_index(drop=True)
                try:
                    rows = _checked(processor.run(part[list(processor.inputs)]), len(part))
                except Exception as e:  # noqa: BLE001
                    rows = [("failed", None, [type(e).__name__])] * len(part)
                yield pd.DataFrame({key: part[key], "processor": processor.name, "version": processor.version, "outcome": [r[0] for r in rows], "proposal": [r[1] for r in rows], "reasons": [r[2] for r in rows]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *[c for c in processor.inputs if c != key]).mapInPandas(run, f"{key} {kind}, processor string, version string, {RESULT}")
