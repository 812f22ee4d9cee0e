"""Schemas, column contracts, feature sets and split bounds of the two-table event log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

_KINDS = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType()}


def _struct(spec: str) -> StructType:
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (f.split(":") for f in spec.split())])


FACT_SCHEMA = _struct("lineID:long day:int pid:long adFlag:int availability:int competitorPrice:double click:int basket:int order:int price:double revenue:double")
DIM_SCHEMA = _struct("pid:long manufacturer:long group:string content:string unit:string pharmForm:string genericProduct:int salesIndex:int category:int campaignIndex:string rrp:double")
SEGMENT_SCHEMA = _struct("pid:long pid_segment:string")

#: Feature families; fixed values. The feature sets below are made from them.
FAMILIES: dict[str, tuple[str, ...]] = {
    "price_absolute": ("price", "rrp", "competitorPrice", "competitorPrice_missing"),
    "price_relative": ("price_diff", "price_discount", "competitorPrice_discount", "price_discount_diff", "is_lower_price", "is_discount", "is_greater_discount", "price_diff_bin", "discount_bin"),
    "per_unit": ("rrp_per_unit", "price_per_unit", "competitorPrice_per_unit"),
    "time": ("day", "day_7", "day_14", "day_30"),
    "campaign_ad": ("adFlag", "campaignIndex_norm", "has_campaign", "salesIndex"),
    "product_master": ("genericProduct", "category_norm", "pharmForm_norm", "manufacturer_freq", "group12", "group34", "availability"),
    "pack_structure": ("is_multipack", "pack_n", "pack_size", "pack_total_size"),
    "conditional_cumulative": ("pid_total_events", "click_time", "basket_time", "order_time", "num_pid_order"),
    "conditional_aggregation": ("group12_order", "group34_order", "week_order"),
    "conditional_oof": ("pid_prob", "availability_likelihood", "day_7_likelihood", "day_7_qty_mean_oof"),
    "conditional_segment": ("pid_segment",),
}
BINNED = ("price_diff_bin", "discount_bin")
#: Columns of the safe matrices and of the export feature sets by stage, in their order; fixed values.
_SAFE = [
    "day", "day_7", "day_14", "day_30", "adFlag", "availability",
    "price", "rrp", "competitorPrice", "competitorPrice_missing", "genericProduct", "salesIndex",
    "category_norm", "pharmForm_norm", "campaignIndex_norm", "has_campaign", "manufacturer_freq", "group12",
    "group34", "is_multipack", "pack_n", "pack_size", "pack_total_size", "price_diff",
    "price_discount", "competitorPrice_discount", "price_discount_diff", "is_lower_price", "is_discount", "is_greater_discount",
    "rrp_per_unit", "price_per_unit", "competitorPrice_per_unit", "price_diff_bin", "discount_bin",
]
_CLS_EXPORT = [
    "day", "day_7", "day_14", "day_30", "adFlag", "availability",
    "price", "competitorPrice", "salesIndex", "category_norm", "pharmForm_norm", "has_campaign",
    "group12", "group34", "is_greater_discount", "price_per_unit", "price_diff_bin", "discount_bin",
    "pid_total_events", "click_time", "basket_time", "order_time", "group12_order", "group34_order",
    "pid_prob", "availability_likelihood", "day_7_likelihood", "pid_segment",
]
_REG_EXPORT = [
    "day", "day_7", "day_14", "day_30", "price", "competitorPrice",
    "genericProduct", "salesIndex", "category_norm", "pharmForm_norm", "campaignIndex_norm", "manufacturer_freq",
    "group34", "is_multipack", "price_diff", "price_discount", "price_diff_bin", "discount_bin",
    "pid_total_events", "click_time", "basket_time", "order_time", "group12_order", "group34_order",
    "pid_prob", "pid_segment",
]
_MAPPED = ["pharmform_group", "pharmform_missing_flag", "pharmform_unmapped_flag"]


def _without(columns: Sequence[str], *dropped: str) -> list[str]:
    return [c for c in columns if c not in dropped]


def _conditional(stage: str) -> list[str]:
    cumulative = _without(FAMILIES["conditional_cumulative"], *(["num_pid_order"] if stage == "reg" else []))
    encoded = _without(FAMILIES["conditional_oof"], "day_7_qty_mean_oof" if stage == "cls" else "day_7_likelihood")
    return [*cumulative, *FAMILIES["conditional_aggregation"], *encoded, *FAMILIES["conditional_segment"]]


FEATURE_SETS: dict[str, list[str]] = {
    "cls_base_safe": _without(_SAFE, *BINNED),
    "cls_expanded_safe": list(_SAFE),
    "reg_base_safe": _without(_SAFE, *BINNED),
    "reg_expanded_safe": list(_SAFE),
    "cls_conditional": _conditional("cls"),
    "reg_conditional": _conditional("reg"),
    "cls_final": _CLS_EXPORT,
    "reg_final": _REG_EXPORT,
    "cls_final_no_groups": _without(_CLS_EXPORT, "group12", "group34"),
    "reg_final_no_group34": _without(_REG_EXPORT, "group34"),
    "cls_pharmform_v0": _without(_CLS_EXPORT, "pharmForm_norm"),
    "cls_pharmform_v1": list(_CLS_EXPORT),
    "cls_pharmform_v2": _without(_CLS_EXPORT, "pharmForm_norm") + _MAPPED,
    "cls_pharmform_v3": _CLS_EXPORT + _MAPPED,
}
_NEVER = ("revenue", "lineID", "click", "basket", "quantity", "quantity_class", "qty_suspicious", "order", "q_raw", "pid_likelihood")
#: Columns that no model gets: scope and reason; fixed features and scopes.
DROPPED = (
    ("revenue", "CLS+REG", "price times quantity"),
    ("click", "CLS", "a click excludes an order"),
    ("basket", "CLS", "a basket excludes an order"),
    ("lineID", "CLS+REG", "identifier"),
    ("quantity", "CLS", "made from the target"),
    ("quantity_class", "CLS+REG-input", "made from the target"),
    ("qty_suspicious", "CLS+REG", "mark of a check"),
    ("pid_likelihood", "CLS+REG", "same as pid_prob"),
    ("num_pid_order", "REG", "sums the target"),
    ("order", "REG", "constant in the second stage"),
)
#: Features that pruning leaves out, by reason and stages; fixed values.
PRUNED: dict[tuple[str, tuple[str, ...]], tuple[str, ...]] = {
    ("redundant", ("cls", "reg")): ("is_lower_price", "rrp", "rrp_per_unit", "competitorPrice_per_unit", "num_pid_order"),
    ("near-zero variance", ("cls", "reg")): ("competitorPrice_missing", "pack_n", "is_discount"),
    ("near-zero variance", ("reg",)): ("availability",),
    ("weak", ("cls",)): (
        "genericProduct", "manufacturer_freq", "is_multipack", "pack_size", "pack_total_size", "price_diff",
        "price_discount", "competitorPrice_discount", "price_discount_diff", "campaignIndex_norm", "week_order",
    ),
    ("weak", ("reg",)): (
        "adFlag", "has_campaign", "group12", "pack_size", "pack_total_size", "competitorPrice_discount", "price_discount_diff", "is_greater_discount", "price_per_unit",
        "week_order", "availability_likelihood", "day_7_qty_mean_oof",
    ),
}
FORBIDDEN = {"cls": (*_NEVER, "day_7_qty_mean_oof"), "reg": (*_NEVER, "num_pid_order", "day_7_likelihood")}
TEXT_IN_EXPORTS = ("pid_segment", "category_norm", "campaignIndex_norm", "pharmForm_norm", "pharmform_group", "group12")
EXPORT_PREFIX = {"category_norm": "C_"}


@dataclass(frozen=True)
class Config:
    """Everything that a run depends on besides its data; there are no module globals to set."""

    train_days: tuple[int, int] = (26, 70)
    test_days: tuple[int, int] = (71, 81)
    validation_days: tuple[int, int] = (82, 92)
    sample_fraction: float = 0.30
    seed: int = 42
    bins: int = 20
    cold_start_probability: float = 0.5
    cold_start_quantity: float = 1.0
    #: The dimension is broadcast up to this many bytes: its rows, counted, times the width of a row.
    broadcast_bytes: int = 16 << 20
    paths: dict[str, str] = field(default_factory=dict)


#: The day intervals that the exploratory reports use instead.
EXPLORATION_DAYS = {"train": (1, 70), "validation": (71, 81), "test": (82, 92)}


def feature_set(name: str) -> list[str]:
    """A copy of a feature list."""
    if name not in FEATURE_SETS:
        raise KeyError(f"unknown feature set {name!r}; there are {', '.join(sorted(FEATURE_SETS))}")
    return list(FEATURE_SETS[name])


def family_of(feature: str) -> str:
    return next((f for f, members in FAMILIES.items() if feature in members), "other")


def require_columns(have: Sequence[str], wanted: Sequence[str], context: str) -> None:
    if missing := [c for c in wanted if c not in have]:
        raise ValueError(f"{context}: columns are missing: {', '.join(missing)}")


def no_forbidden(features: Sequence[str], stage: str, context: str = "") -> None:
    if bad := [c for c in features if c in FORBIDDEN[stage]]:
        raise ValueError(f"{context or stage}: features leak the target: {', '.join(bad)}")


def no_duplicates(features: Sequence[str], context: str = "") -> None:
    if double := sorted({c for c in features if list(features).count(c) > 1}):
        raise ValueError(f"{context}: features appear twice: {', '.join(double)}")


def same_columns(frames: dict[str, Sequence[str]], context: str = "") -> None:
    """All frames have the same columns in the same order."""
    first = next(iter(frames.values()), ())
    if different := [n for n, c in frames.items() if list(c) != list(first)]:
        raise ValueError(f"{context}: columns differ in {', '.join(different)}")


for _name, _columns in FEATURE_SETS.items():
    no_duplicates(_columns, _name)
