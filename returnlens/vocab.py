"""Shared vocabulary: every literal that is part of a result lives here or next to its operator."""

from __future__ import annotations

# Confidence ladder, best first.
CONFIDENCE_LADDER = ["High", "Medium-High", "Medium", "Low-Medium", "Low"]

# Position of each driver in a run.
DRIVER_RANK = {
    "market": 0,
    "sector": 1,
    "peer": 2,
    "style": 3,
    "macro": 4,
    "positioning": 5,
    "event": 6,
    "unexplained_residual": 99,
}

# Order in which a chart lists its drivers.
CHART_DRIVERS = [
    "market",
    "sector",
    "industry",
    "peer",
    "style",
    "macro",
    "positioning",
    "event",
    "unexplained_residual",
]

# Driver and name of the row that closes a run.
RESIDUAL_DRIVER = "unexplained_residual"
RESIDUAL_NAME = "Unexplained residual"

# The five daily factors and the driver each one reports under.
FIVE_FACTORS = ["Mkt-RF", "SMB", "HML", "RMW", "CMA"]
FIVE_FACTOR_DRIVER = {
    "Mkt-RF": "market",
    "SMB": "style",
    "HML": "style",
    "RMW": "style",
    "CMA": "style",
}

# Contribution stages.
PRODUCTION = "production"
EVIDENCE_ONLY = "evidence_only"

CADENCES = ["daily", "weekly", "monthly"]

# Version strings stored with a run, per methodology.
METHODOLOGIES = {
    "legacy": ("factor-baseline-v0", "mvp_expanded_v0"),
    "residual_safety_v1": (
        "factor-baseline-residual-safety-v1",
        "mvp_expanded_residual_safety_v1",
    ),
    "hierarchical_market_first_v1": (
        "factor-baseline-hierarchical-market-v1",
        "mvp_expanded_hierarchical_market_v1",
    ),
}

# Smallest move with shares, largest usable contribution, condition number that lowers confidence.
SHARE_THRESHOLD_BPS = 25.0
MAX_ABS_BPS = 100_000.0
COLLINEAR_CONDITION = 30.0

RUN_KEY = ["security_id", "cadence", "window_start", "window_end"]
