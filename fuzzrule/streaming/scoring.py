"""Rule-base scoring on Structured Streaming input.

Scoring is a per-row projection (index lookup, scaling, labels) plus the
Arrow-batched rule UDF, with no aggregation and no state, so the same
``RuleModel.transform`` plan runs unchanged on a ``readStream`` source in
append mode.  Learning stays a batch job: it needs global min/max, class
counts and rule pruning over the whole training table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def score_stream(model, stream: DataFrame, keep: list[str] | None = None,
                 method: str | None = None, shifted: bool | None = None,
                 out: str = "prediction") -> DataFrame:
    """Append ``out`` (and ``rule_id``/``md``) to every micro-batch row."""
    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming DataFrame; use model.transform")
    cols = list(stream.columns) if keep is None else keep
    scored = model.transform(stream, keep=cols, method=method, shifted=shifted, out=out)
    return scored.select(*cols, out, "rule_id", "md")


def write_scores(scored: DataFrame, path: str, checkpoint: str | None = None,
                 fmt: str = "parquet", trigger: dict | None = None):
    """Start an append-mode file sink.  The progress checkpoint defaults to
    ``_progress`` below the output path, so a restarted stream finds it."""
    if checkpoint is None:
        checkpoint = f"{path.rstrip('/')}/_progress"
    w = (scored.writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", path))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
