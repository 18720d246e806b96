"""Column types of the domain's tables, and what is known of each field at forecast time."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

DISCOUNTS = tuple(f"type_{i}_discount" for i in range(7))
CATEGORIES = tuple(f"L{i}_category_name_en" for i in range(1, 5))
CALENDAR_FLAGS = ("holiday", "shops_closed", "winter_school_holidays", "school_holidays")


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_D, _I, _S, _DATE, _B = T.DoubleType(), T.IntegerType(), T.StringType(), T.DateType(), T.ByteType()

SALES_TRAIN = _struct(
    ("unique_id", _I), ("date", _DATE), ("warehouse", _S), ("total_orders", _D), ("sales", _D), ("sell_price_main", _D), ("availability", _D),
    *[(c, _D) for c in DISCOUNTS],
)
SALES_TEST = _struct(
    ("unique_id", _I), ("date", _DATE), ("warehouse", _S), ("total_orders", _D), ("sell_price_main", _D), *[(c, _D) for c in DISCOUNTS]
)
INVENTORY = _struct(("unique_id", _I), ("product_unique_id", _I), ("name", _S), *[(c, _S) for c in CATEGORIES], ("warehouse", _S))
CALENDAR = _struct(("date", _DATE), ("holiday_name", _S), *[(c, _B) for c in CALENDAR_FLAGS], ("warehouse", _S))
TEST_WEIGHTS = _struct(("unique_id", _I), ("weight", _D))
SOLUTION = _struct(("id", _S), ("sales_hat", _D))
RESULTS = _struct(
    ("timestamp", _S), ("git_hash", _S), ("stage", _S), ("change_description", _S), ("local_wmae", _D), ("local_wape", _D), ("local_bias", _D),
    ("runtime_minutes", _D), ("kept", _S), ("notes", _S),
)

SCHEMAS = {
    "sales_train": SALES_TRAIN,
    "sales_test": SALES_TEST,
    "inventory": INVENTORY,
    "calendar": CALENDAR,
    "test_weights": TEST_WEIGHTS,
    "solution": SOLUTION,
    "results": RESULTS,
}


class Availability(Enum):
    """When a field may be used for a forecast."""

    STATIC = "static metadata"
    KNOWN = "known future"
    HISTORY = "historical only"
    TARGET = "target"
    EVALUATION = "evaluation only"
    OUTPUT = "output only"


FIELDS: dict[str, Availability] = {
    **dict.fromkeys(("unique_id", "product_unique_id", "name", "warehouse", *CATEGORIES), Availability.STATIC),
    **dict.fromkeys(("date", "horizon_day", "holiday_name", *CALENDAR_FLAGS, "sell_price_main", *DISCOUNTS), Availability.KNOWN),
    **dict.fromkeys(("total_orders", "availability"), Availability.HISTORY),
    "sales": Availability.TARGET,
    "weight": Availability.EVALUATION,
    **dict.fromkeys(("id", "sales_hat"), Availability.OUTPUT),
}


class Role(Enum):
    """What a feature is made of."""

    STATIC = "static metadata"
    CALENDAR = "calendar"
    PRICE = "price and discounts"
    DEMAND = "past demand"


#: Roles of the request's fields and their calendar parts; every other feature comes from past demand.
ROLES: dict[str, Role] = {
    **{c: Role.STATIC for c, a in FIELDS.items() if a is Availability.STATIC},
    **dict.fromkeys(("horizon_day", "day_of_week", "iso_week", "month", "weekend_flag", *CALENDAR_FLAGS), Role.CALENDAR),
    **dict.fromkeys(("sell_price_main", *DISCOUNTS), Role.PRICE),
}
