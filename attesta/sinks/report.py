"""The report of a run as a set of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.findings import coverage_gaps, substantive
from ..operators.work import ledger


def report_frames(findings: DataFrame, units: DataFrame, stats: DataFrame, priced_calls: DataFrame) -> dict[str, DataFrame]:
    """Summary, findings by verdict, gaps, failures and spend, each a table of its own.

    Findings keep every column of their contract in its order, then count, verdict, votes and all problems.
    """
    about = ("_corroborations", "_verdict", "_verdict_votes", "_problems")
    shown = findings.select(*substantive(findings), *(c for c in about if c in findings.columns))
    verdict = F.coalesce("_verdict", F.lit("unverified"))
    by_verdict = {
        "verified": verdict == "supported",
        "unverified": ~verdict.isin("supported", "refuted"),
        "refuted": verdict == "refuted",
    }
    return {name: shown.filter(test) for name, test in by_verdict.items()} | {
        "summary": stats,
        "gaps": coverage_gaps(units),
        "failures": units.filter(~is_blank(F.col("error"))).select("unit_key", "error"),
        "spend_by_model": ledger(priced_calls),
    }


def write_report(frames: dict[str, DataFrame], path: str) -> None:
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


