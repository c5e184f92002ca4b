"""Models built from a declarative spec: mappings say what each raw column means, the spec says
which fact, dimensions and marts to build. Specs are small, so they are walked on the driver; the
data only ever flows through the DataFrames they describe.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from martloom.functions import cleaning as C

# How roles and detected types route a column.
MEASURE_ROLES = ("measure_column", "metric_candidate")
NUMERIC_TYPES = ("integer", "decimal")
LABEL_ROLES = ("dimension", "date_time", "identifier")


@dataclass(frozen=True)
class Mapping:
    raw_name: str
    name: str
    role: str
    detected_type: str = "string"

    @property
    def kind(self) -> str:
        """``number`` beats ``date`` beats ``text``."""
        if self.role in MEASURE_ROLES or self.detected_type in NUMERIC_TYPES:
            return "number"
        if self.role == "date_time" or self.detected_type == "date":
            return "date"
        return "text"


@dataclass(frozen=True)
class Dimension:
    name: str
    key: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Mart:
    name: str
    grain: str
    dimensions: tuple[str, ...]
    metrics: tuple[str, ...]


@dataclass(frozen=True)
class ModelSpec:
    fact: str
    keys: tuple[str, ...]
    measures: tuple[str, ...]
    dates: tuple[str, ...]
    dimensions: tuple[Dimension, ...]
    marts: tuple[Mart, ...]
    degenerate: tuple[str, ...] = field(default=())
    grain: str = ""

    def month_columns(self) -> list[str]:
        return [f"{day}_month" for day in self.dates]

    def fact_columns(self) -> list[str]:
        wanted = [
            *self.keys, *(d.key for d in self.dimensions), *self.degenerate, *self.dates,
            *self.month_columns(), *self.measures,
        ]
        return list(dict.fromkeys(wanted))

    def owner_of(self, column: str) -> Dimension | None:
        """The first dimension, in spec order, that lists the column."""
        return next((d for d in self.dimensions if column in d.columns), None)

    def catalog(self) -> dict[str, dict[str, object]]:
        return {
            m.name: {"grain": m.grain, "dimensions": list(m.dimensions), "metrics": list(m.metrics)}
            for m in self.marts
        }


def to_mappings(rows: Iterable[Row]) -> list[Mapping]:
    """Effective mapping rows of one dataset as mappings, in the order of their columns."""
    ordered = sorted(rows, key=lambda r: r["column_index"])
    return [Mapping(r["raw_column_name"], r["name"], r["role"], r["detected_type"]) for r in ordered]


def to_spec(row: Row) -> ModelSpec:
    """One accepted proposal row as a spec. Fields that only marts mention join the fact as degenerate dimensions."""
    loose = [f for m in row["marts"] for f in m["dimensions"] if f not in row["candidates"]]
    return ModelSpec(
        fact=row["fact_name"], grain=row["fact_grain"], keys=tuple(row["fact_keys"]), measures=tuple(row["fact_measures"]),
        dates=tuple(row["fact_date_columns"]),
        degenerate=tuple(dict.fromkeys([*row["fact_degenerate_dimensions"], *loose])),
        dimensions=tuple(Dimension(d["name"], d["key_column"], tuple(d["columns"])) for d in row["dimensions"]),
        marts=tuple(Mart(m["name"], m["grain"], tuple(m["dimensions"]), tuple(m["metrics"])) for m in row["marts"]),
    )


def route_kind(role, detected_type):
    """Column form of ``Mapping.kind`` for a table of mappings."""
    return (
        F.when(role.isin(*MEASURE_ROLES) | detected_type.isin(*NUMERIC_TYPES), "number")
        .when((role == "date_time") | (detected_type == "date"), "date")
        .otherwise("text")
    )


def staged(raw: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """Only mapped columns, renamed, with blanks as NULL."""
    return raw.select(*(C.clean_text(F.col(m.raw_name)).alias(m.name) for m in mappings))


def intermediate(staging: DataFrame, mappings: list[Mapping], spec: ModelSpec) -> DataFrame:
    casts = {"number": C.clean_money, "date": C.clean_date, "text": C.clean_text}
    typed = staging.select(*(casts[m.kind](F.col(m.name)).alias(m.name) for m in mappings))
    return typed.withColumns({f"{day}_month": C.month_of(F.col(day)) for day in spec.dates})


def fact(inter: DataFrame, spec: ModelSpec) -> DataFrame:
    return inter.select(*spec.fact_columns())


def dimension(inter: DataFrame, dim: Dimension) -> DataFrame:
    return inter.filter(F.col(dim.key).isNotNull()).select(*dim.columns).distinct()


def mart(facts: DataFrame, dimensions: dict[str, DataFrame], spec: ModelSpec, wanted: Mart) -> DataFrame:
    """Sum the metrics by the mart's dimensions.

    A dimension table is joined only for columns the fact lacks. Rows are summed by join key and
    fact-held columns first, so joins see one row per key rather than one per fact row.
    """
    held = set(spec.fact_columns())
    direct = [c for c in wanted.dimensions if c in held]
    looked_up: dict[str, list[str]] = {}
    for column in wanted.dimensions:
        owner = None if column in held else spec.owner_of(column)
        if owner is not None:
            looked_up.setdefault(owner.name, []).append(column)
    owners = [d for d in spec.dimensions if d.name in looked_up]
    keys = [d.key for d in owners]
    group = list(dict.fromkeys([*keys, *direct]))
    rows = facts.groupBy(*group).agg(*(F.try_sum(m).alias(m) for m in wanted.metrics))
    for dim in owners:
        # Whole dimension rows take part: attribute variants the mart does not show still fan out.
        key = f"__{dim.name}_key"
        side = dimensions[dim.name].select(
            F.col(dim.key).alias(key), *(F.col(c).alias(f"__{c}") for c in looked_up[dim.name])
        )
        rows = rows.join(side, rows[dim.key] == side[key], "left").drop(key)
    shown = [
        F.col(c) if c in held else F.col(f"__{c}").alias(c)
        for c in wanted.dimensions
        if c in held or spec.owner_of(c)
    ]
    names = [c for c in wanted.dimensions if c in held or spec.owner_of(c)]
    sums = [F.col(m).alias(f"__sum_{m}") for m in wanted.metrics]
    return rows.select(*shown, *sums).groupBy(*names).agg(
        *(F.try_sum(f"__sum_{m}").alias(m) for m in wanted.metrics)
    )


def build_models(raw: DataFrame, mappings: list[Mapping], spec: ModelSpec) -> dict[str, DataFrame]:
    """Every model of the spec by name, lazily."""
    staging = staged(raw, mappings)
    inter = intermediate(staging, mappings, spec)
    facts = fact(inter, spec)
    dims = {d.name: dimension(inter, d) for d in spec.dimensions}
    marts = {m.name: mart(facts, dims, spec, m) for m in spec.marts}
    return {"staging": staging, "intermediate": inter, spec.fact: facts, **dims, **marts}


def transformable(mappings: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Whether each dataset maps at least one measure and one label column."""
    has = lambda roles: F.max(F.col("role").isin(*roles))
    return mappings.groupBy(key).agg(
        (has(MEASURE_ROLES) & has(LABEL_ROLES)).alias("transformable")
    )
