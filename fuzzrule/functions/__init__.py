from fuzzrule.functions.membership import (antecedent_factor, label_col, label_np,
                                           matching_degree, membership_table_np, round_at,
                                           triangle_cols, trimf_col, trimf_np)
from fuzzrule.functions.partition import centre, cut_points, triangle, triangles, width

__all__ = [
    "antecedent_factor", "centre", "cut_points", "label_col", "label_np", "matching_degree",
    "membership_table_np", "round_at", "triangle", "triangle_cols", "triangles", "trimf_col",
    "trimf_np", "width",
]
