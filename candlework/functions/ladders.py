"""Bucket ladders: which state a value is in. Edges are fixed values of the data model."""

from __future__ import annotations

#: name -> ((comparison, edge, code), ...), code above all edges
LADDERS = {
    "signed_pct": ((("<=", -8, "shock_dn"), ("<=", -5, "dn_5_8"), ("<=", -3, "dn_3_5"), ("<=", -1, "dn_1_3"), ("<", 1, "flat"), ("<", 3, "up_1_3"), ("<", 5, "up_3_5"), ("<", 8, "up_5_8")), "shock_up"),
    "distance": ((("<=", -10, "far_dn"), ("<=", -5, "dn_5_10"), ("<=", -1.5, "dn_1_5"), ("<", 1.5, "near"), ("<", 5, "up_1_5"), ("<", 10, "up_5_10")), "far_up"),
    "relative": ((("<=", -2, "rel_shock_dn"), ("<=", -1, "rel_dn"), ("<=", -0.3, "rel_soft_dn"), ("<", 0.3, "rel_near"), ("<", 1, "rel_soft_up"), ("<", 2, "rel_up")), "rel_shock_up"),
    "ratio": ((("<", 0.7, "very_low"), ("<", 0.9, "low"), ("<", 1.1, "normal"), ("<", 1.4, "high"), ("<", 1.8, "very_high")), "extreme"),
    "fraction": ((("<", 0.15, "very_low"), ("<", 0.35, "low"), ("<", 0.65, "mid"), ("<", 0.85, "high")), "very_high"),
    "close_position": ((("<", 0.15, "near_low"), ("<", 0.35, "lower_band"), ("<", 0.65, "middle"), ("<", 0.85, "upper_band")), "near_high"),
    "streak": ((("<=", -4, "down_4p"), ("<=", -2, "down_2_3"), ("<=", -1, "down_1"), ("<=", 0, "flat"), ("<=", 1, "up_1"), ("<=", 3, "up_2_3")), "up_4p"),
    "positive_5": ((("<=", 1, "weak"), ("<=", 2, "soft_weak"), ("<=", 3, "soft_strong")), "strong"),
    "positive_10": ((("<=", 3, "weak"), ("<=", 5, "neutral"), ("<=", 7, "strong")), "very_strong"),
    "drawdown": ((("<=", -15, "dd_15p"), ("<=", -10, "dd_10_15"), ("<=", -6, "dd_6_10"), ("<=", -3, "dd_3_6"), ("<=", -1, "dd_1_3")), "near_high"),
    "rebound": ((("<", 1, "near_low"), ("<", 3, "reb_1_3"), ("<", 6, "reb_3_6"), ("<", 10, "reb_6_10"), ("<", 15, "reb_10_15")), "reb_15p"),
    "rsi": ((("<", 20, "oversold"), ("<", 35, "low"), ("<", 50, "neutral_low"), ("<", 65, "neutral_high"), ("<", 80, "high")), "overbought"),
    "weekday": ((("<=", 0, "mon"), ("<=", 1, "tue"), ("<=", 2, "wed"), ("<=", 3, "thu"), ("<=", 4, "fri")), "unknown"),
    # the option engine's own edges for these two
    "option_signed_pct": ((("<=", -6, "shock_dn"), ("<=", -3, "dn_3_6"), ("<=", -1, "dn_1_3"), ("<", 1, "flat"), ("<", 3, "up_1_3"), ("<", 6, "up_3_6")), "shock_up"),
    "option_distance": ((("<=", -8, "far_dn"), ("<=", -4, "dn_4_8"), ("<=", -1, "dn_1_4"), ("<", 1, "near"), ("<", 4, "up_1_4"), ("<", 8, "up_4_8")), "far_up"),
}


def codes(ladder: str) -> list[str]:
    steps, top = LADDERS[ladder]
    return [code for _, _, code in steps] + [top]


def position(ladder: str, x: str) -> str:
    """The step of a value, from 0: how many edges it has passed. Null if it is undefined."""
    steps, _ = LADDERS[ladder]
    return "(" + " + ".join(f"CAST({x} {'>' if op == '<=' else '>='} {edge} AS INT)" for op, edge, _ in steps) + ")"


def code(ladder: str, x: str) -> str:
    steps, top = LADDERS[ladder]
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} {op} {edge} THEN '{name}'" for op, edge, name in steps) + f" ELSE '{top}' END"


def decode(ladder: str, step: str) -> str:
    return f"CASE {step} " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(codes(ladder))) + " END"
