"""What this engine answers, what it assumes, and where it stops, as one table of statements."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .limits import Limits

CONTRACT = {
    "engine": {
        "name": "cairnfold",
        "reads and writes": Limits().trace_format,
        "runs on": "Spark DataFrames; every answer is a table, and so is every failure",
    },
    "questions": {
        "is this trace sound": "operators/validate.py: each rule is a query, the first failing record of a trace is named with its code",
        "what did a consumer know": "operators/fold.py follows a stream delivery by delivery, operators/relational.py says the same in closed form where nothing conflicts",
        "what would it have known": "operators/faults.py delivers the same envelopes with some dropped, repeated or moved",
        "does the difference matter": "operators/compare.py sets the two views side by side, or says why they cannot be compared",
    },
    "assumptions": {
        "order": "a trace is one file and its records are ordered; nothing is assumed across traces",
        "trust": "whether a stream began empty is decided outside the trace",
        "limits": "limits are part of the answers: the same trace under other limits is another question",
    },
    "edges": {
        "one process": "there is no network protocol and no server; a trace is read, not requested",
        "whole schedules": "a failing schedule is reported as it is, not cut down to a smaller one that still fails",
        "views only": "keys are compared, the cached values behind them are never seen",
    },
}


def statements() -> list[tuple[str, int, str]]:
    return [(section, n, f"{name}: {text}") for section, told in CONTRACT.items() for n, (name, text) in enumerate(told.items())]


def as_text() -> str:
    return "\n".join(f"[{section}] {text}" for section, _, text in statements())


def as_json() -> str:
    return json.dumps(CONTRACT, indent=2)


def as_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(statements(), "section string, place int, statement string")
