"""Run parameters of the rule learner.

One frozen dataclass replaces the mutable parameter bag of the original
job.  The overloaded "rate" of the original is split in three
(feature-selection share, precision threshold, GM step), each defaulting
to the same value so a single ``rate`` still reproduces old runs.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

_INFERENCE_ALIASES = {
    "winning": "winning",
    "winning-rule": "winning",
    "winning_rule": "winning",
    "aggregation": "aggregation",
    "class_aggregation": "aggregation",
    "class_aggrigation": "aggregation",  # fixed value: spelt so by old runs
}


@dataclass(frozen=True)
class RuleParams:
    n_labels: int = 3                  # linguistic labels per variable
    inference: str = "winning"         # "winning" | "aggregation"
    use_rw: bool = True                # multiply matching degree by rule weight
    use_filtering: bool = False        # minimum support filter on cell rules
    filtering_ths: int = -1            # -1 = automatic floor((N-1)/#cells)
    tuning: bool = False               # prototype-shifted memberships when scoring
    use_fs: bool = False               # MDLP + mRMR feature selection
    rate: float = 0.25                 # default for the three rates below
    fs_rate: float | None = None       # share of features kept by mRMR
    precision_rate: float | None = None  # precision threshold in rule selection
    step_rate: float | None = None     # threshold step of GM-guided selection
    min_length: int = 1
    max_length: int = 3
    rank_by: str = "class"             # "class" | "class_length"
    selection: str = "precision"       # "precision" | "gm"
    prototype: str = "second"          # "second" (as stored) | "first" (winner mean)
    no_fire: str = "majority"          # tuned winning rule when nothing fires
    block_rules: int = 50_000          # rules broadcast together when scoring
    tie_eps: float = 1e-9              # |RW| below this is a class tie
    persist_input: bool = True         # cache the narrow feature table (else re-scan)
    mdlp_max_bins: int = 10

    def __post_init__(self):
        if self.n_labels < 2:
            raise ValueError("n_labels must be at least 2")
        inf = _INFERENCE_ALIASES.get(self.inference)
        if inf is None:
            raise ValueError(f"unknown inference method {self.inference!r}")
        object.__setattr__(self, "inference", inf)
        if self.block_rules < 1:
            raise ValueError("block_rules must be at least 1")
        if not 1 <= self.min_length <= self.max_length:
            raise ValueError("need 1 <= min_length <= max_length")
        for name, allowed in (("rank_by", {"class", "class_length"}),
                              ("selection", {"precision", "gm"}),
                              ("prototype", {"second", "first"}),
                              ("no_fire", {"majority", "first_rule"})):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {sorted(allowed)}")

    @property
    def fs(self) -> float:
        return self.rate if self.fs_rate is None else self.fs_rate

    @property
    def precision(self) -> float:
        return self.rate if self.precision_rate is None else self.precision_rate

    @property
    def step(self) -> float:
        return self.rate if self.step_rate is None else self.step_rate

    def to_dict(self) -> dict:
        return asdict(self)


def params_from_args(args: list[str]) -> RuleParams:
    """Build parameters from the positional command line of the original job:
    ``dir name fold ext n_labels method useRW useFilter ths tuning useFS rate``.
    Only the modelling arguments are used; paths are resolved by the caller."""
    return RuleParams(
        n_labels=int(args[4]),
        inference=args[5],
        use_rw=args[6].lower() == "true",
        use_filtering=args[7].lower() == "true",
        filtering_ths=int(args[8]),
        tuning=args[9].lower() == "true",
        use_fs=args[10].lower() == "true",
        rate=float(args[11]),
    )
