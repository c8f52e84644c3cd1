"""Scoring of streaming DataFrames with a learned rule base."""

from fuzzrule.streaming.scoring import score_stream, write_scores

__all__ = ["score_stream", "write_scores"]
