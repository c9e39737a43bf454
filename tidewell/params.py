"""Every knob of the five analyses, with its usual value."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class FilterSpec:
    """A row filter: ``kind`` amount (``<``, ``>``, ``==`` a number) or format (``==``, ``!=`` a list)."""

    kind: str
    operator: str
    value: float | tuple[str, ...]

    def __post_init__(self):
        allowed = {"amount": ("<", ">", "=="), "format": ("==", "!=")}
        if self.operator not in allowed.get(self.kind, ()):
            raise ValueError(f"no filter {self.kind} {self.operator}")
        if self.kind == "format":
            value = (self.value,) if isinstance(self.value, str) else tuple(self.value or ())
            if not value:
                raise ValueError("a format filter needs at least one format")
            object.__setattr__(self, "value", value)


@dataclass(frozen=True)
class AggSpec:
    """An aggregate over ``amount_paid``: kind max, min, sum, avg or count; ``group`` a key or none."""

    kind: str
    group: str | None = None

    GROUPS = {
        "origin_bank": ("from_bank",), "origin_account": ("from_bank", "from_account"), "dest_bank": ("to_bank",),
        "dest_account": ("to_bank", "to_account"), "format": ("payment_format",),
    }

    def __post_init__(self):
        if self.kind not in ("max", "min", "sum", "avg", "count"):
            raise ValueError(f"no aggregate {self.kind}")
        if self.group is None and self.kind != "count":
            raise ValueError("only a count may go without a group")
        if self.group is not None and self.group not in self.GROUPS:
            raise ValueError(f"no group {self.group}")

    @property
    def keys(self) -> tuple[str, ...]:
        return self.GROUPS[self.group] if self.group else ()


@dataclass(frozen=True)
class QueryParams:
    usd: str = "US Dollar"
    small_amount: float = 50.0
    window1: tuple[str, str] = ("2022/09/01", "2022/09/06")
    window2: tuple[str, str] = ("2022/09/06", "2022/09/15")
    multiplier: float = 0.01
    threshold: int = 5
    exclude_cycles: bool = False
    formats: tuple[str, ...] = ("Wire", "ACH")
    micro_amount: float = 1.0
    tenant_cols: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.threshold <= 0:
            raise ValueError("the threshold must be above 0")
        for lo, hi in (self.window1, self.window2):
            if not lo or not hi:
                raise ValueError("a window needs both of its ends")

    @classmethod
    def from_mapping(cls, values: dict) -> QueryParams:
        """From a mapping, as read from a configuration file; unknown names are errors."""
        known = {f.name for f in fields(cls)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


#: The parameters for the driver's tables, whose events lie in 2024.
SAMPLE = QueryParams(window1=("2024/01/01", "2024/01/06"), window2=("2024/01/06", "2024/01/15"), formats=("view", "click"))
