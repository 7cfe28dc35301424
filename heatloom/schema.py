"""Schemas, feature sets, column roles and run configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

READING = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("datetime", T.TimestampType(), False),
        T.StructField("diff", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

HOLIDAY = T.StructType(
    [
        T.StructField("state", T.StringType()),
        T.StructField("start", T.DateType()),
        T.StructField("end", T.DateType()),
        T.StructField("type", T.StringType()),
    ]
)

# Types a stored feature frame is cast to when it is read again (fixed values).
FEATURE_TYPES = {
    "heated_area": "double",
    "anzahlwhg": "bigint",
    "building_height": "double",
    "storeys_above_ground": "bigint",
    "ground_surface": "double",
    "tsun": "double",
}

# Thresholds per resolution (fixed values).
FLAT_LINE_LIMIT = {"day": 90, "hour": 90 * 24}
SPLIT_GAP = {"day": 7, "hour": 24}
RECONNECT_GAP = {"day": 1, "hour": 3}
MASKING_VALUE = -99.0
N_CLUSTERS = 3
DEFAULT_TYP = "Mehrfamilienhaus"
LAG = {"day": 7, "hour": 72}

# Feature groups (fixed values).
CATEGORICAL = ["typ", "primary_energy"]
BINARY = ["weekend", "holiday"]
CYCLIC = ["weekday", "day_of_month"]
BUILDING = ["daily_avg", "heated_area", "anzahlwhg", "typ", "primary_energy"]
BUILDING_NO_APARTMENT = ["daily_avg", "heated_area", "typ", "primary_energy"]
DISTRICT = ["ground_surface", "building_height", "storeys_above_ground", "heated_area"]
WEATHER_DAILY = ["hum_avg", "hum_min", "hum_max", "tavg", "tmin", "tmax", "prcp", "wdir", "wspd", "wpgt", "pres", "tsun"]
WEATHER_HOURLY = ["temp", "dwpt", "rhum", "coco", "prcp", "snow", "wdir", "wspd", "wpgt", "pres", "tsun"]
WEATHER_SIGNIFICANT = ["tmax", "tsun", "wpgt", "hum_avg"]
TIME = BINARY + CYCLIC
CONTINUOUS = [
    "prcp", "snow", "wdir", "wspd", "wpgt", "pres", "tsun", "daily_avg", "heated_area", "heated_area_lod",
    "anzahlwhg", "ground_surface", "building_height", "storeys_above_ground",
]
CONTINUOUS_RES = {
    "day": ["hum_avg", "hum_min", "hum_max", "tavg", "tmin", "tmax"],
    "hour": ["temp", "dwpt", "rhum", "coco"],
}
FEATURES = {
    res: ["diff"] + CATEGORICAL + CONTINUOUS + BINARY + CYCLIC + extra for res, extra in CONTINUOUS_RES.items()
}

# Numbered feature sets (fixed values).
FEATURE_SETS = {
    1: ["diff"],
    2: ["diff"] + WEATHER_DAILY,
    3: ["diff"] + WEATHER_DAILY,
    4: ["diff"] + WEATHER_SIGNIFICANT,
    5: ["diff"] + WEATHER_SIGNIFICANT,
    6: ["diff"] + WEATHER_SIGNIFICANT + BUILDING,
    7: ["diff"] + WEATHER_DAILY + BUILDING + TIME,
    8: ["diff"] + WEATHER_DAILY + TIME + ["daily_avg"],
    9: ["diff"] + WEATHER_DAILY + BUILDING + ["weekend"],
    10: ["diff"] + WEATHER_DAILY + TIME + BUILDING_NO_APARTMENT,
    11: ["diff"] + WEATHER_DAILY + TIME + DISTRICT,
    12: ["diff"],
    13: ["diff"] + WEATHER_DAILY + TIME + BUILDING_NO_APARTMENT,
    14: ["diff"] + WEATHER_DAILY + TIME + ["primary_energy"],
    15: ["diff"] + WEATHER_HOURLY + TIME + BUILDING_NO_APARTMENT,
    16: ["diff"] + WEATHER_HOURLY + TIME + ["primary_energy"],
}


def feature_columns(code: int) -> list[str]:
    """Columns of a numbered feature set in name order."""
    if code not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {code}")
    return sorted(FEATURE_SETS[code])


def required_features(dataset: str, res: str, requested: list[str]) -> list[str]:
    """Which columns must be present in a row, per dataset variant."""
    if dataset == "meta":
        return feature_columns(8)
    if dataset == "building":
        return feature_columns(10 if res == "day" else 15)
    if dataset in ("all", "missing_data_90"):
        return sorted(requested)
    raise ValueError(f"unknown dataset variant {dataset!r}")


# ---- column roles ---------------------------------------------------------------------------------------------

TYPES = ("real", "categorical", "date")
ROLES = ("target", "observed", "known", "static", "id", "time")


@dataclass(frozen=True)
class Role:
    """One column of a role-declared dataset."""

    name: str
    type: str
    role: str


def _roles(id: Role, time: Role, target: str, **inputs: list[str]) -> list[Role]:
    """Id, time and target column plus inputs grouped as ``<role>_<type>=[names]``."""
    out = [id, time, Role(target, "real", "target")]
    for group, names in inputs.items():
        role, kind = group.split("_")
        out += [Role(name, kind, role) for name in names]
    return out


_METER = (Role("id", "categorical", "id"), Role("datetime", "date", "time"), "diff")
_DAILY_WEATHER = [
    "tavg", "tmin", "tmax", "hum_avg", "hum_min", "hum_max", "prcp", "snow", "wspd", "wdir", "wpgt", "pres", "tsun",
]
_HOURLY_WEATHER = ["temp", "dwpt", "rhum", "coco", "prcp", "snow", "wspd", "wdir", "wpgt", "pres", "tsun"]
_CYCLES = ["weekday_sin", "weekday_cos", "day_of_month_sin", "day_of_month_cos"]
_ENERGY = ["primary_energy_district heating", "primary_energy_gas"]
_TYPS = ["typ_0", "typ_1", "typ_2", "typ_4"]

# Role declarations of the supported datasets (fixed values).
COLUMN_ROLES: dict[str, list[Role]] = {
    "heat_daily": _roles(
        *_METER,
        observed_real=_DAILY_WEATHER,
        known_real=[*_CYCLES, "daily_avg"],
        known_categorical=["weekend", "holiday"],
        static_real=["heated_area"],
        static_categorical=_ENERGY + _TYPS,
    ),
    "heat_hourly": _roles(
        *_METER,
        observed_real=_HOURLY_WEATHER,
        known_real=[*_CYCLES, "daily_avg"],
        known_categorical=["weekend", "holiday"],
        static_real=["heated_area"],
        static_categorical=_ENERGY + _TYPS,
    ),
    "heat_no_building": _roles(
        *_METER,
        observed_real=_DAILY_WEATHER,
        known_real=_CYCLES,
        known_categorical=["weekend", "holiday"],
        static_categorical=_ENERGY,
    ),
    "heat_target_only": _roles(*_METER),
    "volatility": _roles(
        Role("Symbol", "categorical", "id"),
        Role("date", "date", "time"),
        "log_vol",
        observed_real=["open_to_close"],
        known_real=["days_from_start"],
        known_categorical=["day_of_week", "day_of_month", "week_of_year", "month"],
        static_categorical=["Region"],
    ),
    "electricity": _roles(
        Role("id", "real", "id"),
        Role("hours_from_start", "real", "time"),
        "power_usage",
        known_real=["hour", "day_of_week", "hours_from_start"],
        static_categorical=["categorical_id"],
    ),
}


def check_roles(definition: list[Role]) -> list[Role]:
    """A definition has known types and roles, exactly one id and exactly one time column."""
    for r in definition:
        if r.type not in TYPES or r.role not in ROLES:
            raise ValueError(f"bad role declaration {r}")
    for role in ("id", "time"):
        n = sum(r.role == role for r in definition)
        if n != 1:
            raise ValueError(f"exactly one {role} column is required, found {n}")
    return definition


def column_roles(definition: list[Role]) -> list[Role]:
    """Definition in model order: id, time, then real inputs, then categorical inputs."""
    check_roles(definition)
    inputs = [r for r in definition if r.role not in ("id", "time")]
    return (
        [r for r in definition if r.role == "id"]
        + [r for r in definition if r.role == "time"]
        + [r for r in inputs if r.type == "real"]
        + [r for r in inputs if r.type == "categorical"]
    )


def columns_of(definition: list[Role], type: str | None = None, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of the columns of one type, without the excluded roles."""
    return [r.name for r in definition if (type is None or r.type == type) and r.role not in exclude]


def column_with_role(definition: list[Role], role: str) -> str:
    """The single column with a role."""
    names = [r.name for r in definition if r.role == role]
    if len(names) != 1:
        raise ValueError(f"expected one {role} column, found {names}")
    return names[0]


# ---- run configuration ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RunConfig:
    """What a training frame is built from."""

    res: str = "day"
    feature_code: int = 12
    feature_list: tuple[str, ...] | None = None
    dataset: str = "all"
    energy: str = "all"
    n_in: int = 7
    n_out: int = 7
    n_future: int = 7
    lag_in: int | None = None
    lag_out: int | None = None
    split: str = "time"
    train_per: float = 0.8
    remove_per: float = 0.0
    split_date: str = "2024-01-30"
    scaler: str = "standard"
    scale_mode: str = "individual"
    excluded_ids: tuple[str, ...] = field(default=())
    seed: int = 42

    def __post_init__(self):
        for name in ("lag_in", "lag_out"):
            if getattr(self, name) is None:
                object.__setattr__(self, name, LAG[self.res])
        if self.lag_in < self.n_in or self.lag_out < self.n_out:
            raise ValueError("lags must cover the window")
        if self.lag_out < self.n_future:
            raise ValueError("n_future can not be larger than lag_out")

    @property
    def features(self) -> list[str]:
        return sorted(self.feature_list) if self.feature_list else feature_columns(self.feature_code)

