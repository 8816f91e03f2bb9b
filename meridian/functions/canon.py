"""The canonical form: axes, levels, variables, layers and sources, and tables made of them.

Names, units, ranges and counts are the data contract; they are fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 0.25
N_LAT, N_LON = 721, 1440
#: Pressure levels in hPa, in contract order.
LEVELS = (50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 850, 925, 1000)
#: Variables by kind.
INGESTED = ("2t", "10u", "10v", "msl", "2d", "tcwv", "tcc", "100u", "100v", "sp", "lcc", "mcc", "hcc", "skt", "stl1", "swvl1", "ci", "sd")
OUTPUT_ONLY = ("i10fg", "blh", "uvb_1h", "ssrd_1h", "ttr_1h", "tp_1h", "sf_1h")
ATMOS = ("t", "u", "v", "q", "z")
STATIC = ("lsm", "z_surf", "slt")
STORED = INGESTED + OUTPUT_ONLY
SERIES = ("2t", "10u", "10v", "msl", "tp_1h", "tcc", "2d", "i10fg")
#: Variable -> SI unit, lowest and highest physical value.
VARIABLES: dict[str, tuple[str, float, float]] = {
    "2t": ("K", 180.0, 340.0),
    "10u": ("m s-1", -120.0, 120.0),
    "10v": ("m s-1", -120.0, 120.0),
    "msl": ("Pa", 87000.0, 108500.0),
    "2d": ("K", 150.0, 320.0),
    "tcwv": ("kg m-2", 0.0, 120.0),
    "tcc": ("1", 0.0, 1.0),
    "100u": ("m s-1", -150.0, 150.0),
    "100v": ("m s-1", -150.0, 150.0),
    "sp": ("Pa", 30000.0, 110000.0),
    "lcc": ("1", 0.0, 1.0),
    "mcc": ("1", 0.0, 1.0),
    "hcc": ("1", 0.0, 1.0),
    "skt": ("K", 170.0, 355.0),
    "stl1": ("K", 200.0, 350.0),
    "swvl1": ("m3 m-3", 0.0, 1.0),
    "ci": ("1", 0.0, 1.0),
    "sd": ("m", 0.0, 20.0),
    "insolation": ("W m-2", 0.0, 1500.0),
    "i10fg": ("m s-1", 0.0, 150.0),
    "blh": ("m", 0.0, 10000.0),
    "uvb_1h": ("J m-2", 0.0, 5.0e5),
    "ssrd_1h": ("J m-2", 0.0, 5.0e6),
    "ttr_1h": ("J m-2", -2.0e6, 0.0),
    "tp_1h": ("m", 0.0, 0.5),
    "sf_1h": ("m", 0.0, 0.2),
    "t": ("K", 150.0, 350.0),
    "u": ("m s-1", -150.0, 150.0),
    "v": ("m s-1", -150.0, 150.0),
    "q": ("kg kg-1", 0.0, 0.05),
    "z": ("m2 s-2", -15000.0, 350000.0),
    "z_surf": ("m2 s-2", -6000.0, 90000.0),
    "lsm": ("1", 0.0, 1.0),
    "slt": ("1", 0.0, 7.0),
    "tp": ("m", 0.0, 1.0),
}
#: Layer -> surface variables, level variables, step in hours, steps.
LAYERS: dict[str, tuple[tuple[str, ...], tuple[str, ...], int, int]] = {
    "coarse": (STORED, ATMOS, 6, 40),
    "hourly": (SERIES, (), 1, 72),
    "analysis": (INGESTED, ATMOS, 6, 2),
    "points": (SERIES, (), 6, 40),
    "previous": (SERIES, (), 6, 40),
}
LAYER_BY_STEP = {6: "coarse", 1: "hourly"}
#: Where data may come from.
SOURCES = ("forecast", "ifs-analysis", "gfs-analysis", "era5t", "era5-final", "climatology")
#: Provider -> provider's name -> canonical name.
NAMES: dict[str, dict[str, str]] = {
    "ifs-analysis": {
        "t2m": "2t", "u10": "10u", "v10": "10v", "msl": "msl", "d2m": "2d", "tcwv": "tcwv", "tcc": "tcc", "u100": "100u", "v100": "100v",
        "sp": "sp", "lcc": "lcc", "mcc": "mcc", "hcc": "hcc", "skt": "skt", "sot": "stl1", "vsw": "swvl1", "sd": "sd", "t": "t", "u": "u",
        "v": "v", "q": "q", "z": "z", "tp": "tp", "lsm": "lsm", "slt": "slt",
    },
    "gfs-analysis": {
        "t2m": "2t", "u10": "10u", "v10": "10v", "prmsl": "msl", "t": "t", "u": "u", "v": "v", "q": "q", "gh": "z", "tp": "tp", "lsm": "lsm",
        "orog": "z_surf", "slt": "slt",
    },
    "era5": {
        "2m_temperature": "2t", "10m_u_component_of_wind": "10u", "10m_v_component_of_wind": "10v", "mean_sea_level_pressure": "msl",
        "2m_dewpoint_temperature": "2d", "total_column_water_vapour": "tcwv", "total_cloud_cover": "tcc", "100m_u_component_of_wind": "100u",
        "100m_v_component_of_wind": "100v", "surface_pressure": "sp", "low_cloud_cover": "lcc", "medium_cloud_cover": "mcc",
        "high_cloud_cover": "hcc", "skin_temperature": "skt", "soil_temperature_level_1": "stl1", "volumetric_soil_water_layer_1": "swvl1",
        "sea_ice_cover": "ci", "snow_depth": "sd", "temperature": "t", "u_component_of_wind": "u", "v_component_of_wind": "v",
        "specific_humidity": "q", "geopotential": "z",
    },
}
#: Provider and variable -> factor to SI.
SCALES = {("gfs-analysis", "z"): 9.80665, ("gfs-analysis", "z_surf"): 9.80665, ("gfs-analysis", "tp"): 1e-3}
#: Fields that come from another stream than the usual one, and from the re-analysis.
DEFAULT_STREAM = "ifs/0p25/oper"
STREAMS = {x: "aifs-single/0p25/oper" for x in ("lcc", "mcc", "hcc")}
REANALYSIS_STREAM, REANALYSIS_LAG_DAYS, PERSISTED = "reanalysis-era5-single-levels", 5, ("ci",)
#: Variable -> parameter and level in a provider's index, where they differ.
INDEX_NAMES = {"stl1": ("sot", "1"), "swvl1": ("vsw", "1"), "z_surf": ("z", "")}
#: Human unit, scale and offset by variable; labels by SI unit; digits by unit.
HUMAN = {
    "2t": ("degC", 1.0, -273.15), "2d": ("degC", 1.0, -273.15), "skt": ("degC", 1.0, -273.15), "stl1": ("degC", 1.0, -273.15),
    "msl": ("hPa", 0.01, 0.0), "sp": ("hPa", 0.01, 0.0), "tp_1h": ("mm", 1000.0, 0.0), "sf_1h": ("mm", 1000.0, 0.0), "tp": ("mm", 1000.0, 0.0),
    "tcc": ("%", 100.0, 0.0), "lcc": ("%", 100.0, 0.0), "mcc": ("%", 100.0, 0.0), "hcc": ("%", 100.0, 0.0), "ci": ("%", 100.0, 0.0),
}
LABELS = {"m s-1": "m/s"}
DIGITS = {"degC": 1, "K": 1, "hPa": 1, "Pa": 0, "m/s": 1, "m s-1": 1, "mm": 2, "%": 1}
OTHER_DIGITS = 3
#: Other names of variables.
ALIASES = {"t2m": "2t", "d2m": "2d"}
#: Limits of an answer.
MAX_POINTS, MAX_STEPS = 50_000, 500


def variables(spark: SparkSession) -> DataFrame:
    kind = lambda x: "atmos" if x in ATMOS else "static" if x in STATIC else "surface"
    rows = [(k, kind(k), u, lo, hi) for k, (u, lo, hi) in VARIABLES.items()]
    return spark.createDataFrame(rows, "variable string, kind string, units string, lo double, hi double")


def layers(spark: SparkSession) -> DataFrame:
    rows = [(name, v, v in atmos, step, steps) for name, (surface, atmos, step, steps) in LAYERS.items() for v in surface + atmos]
    return spark.createDataFrame(rows, "layer string, variable string, on_levels boolean, step_hours int, steps int")


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LEVELS)), "level_i int, level int")


def names(spark: SparkSession) -> DataFrame:
    rows = [(s, p, v) for s, table in NAMES.items() for p, v in table.items()]
    return spark.createDataFrame(rows, "source string, provider_name string, variable string")


def scales(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, v, f) for (s, v), f in SCALES.items()], "source string, variable string, factor double")


def catalog(spark: SparkSession) -> DataFrame:
    """Public and canonical field names with inputs, units, conversion and digits."""
    digits = lambda unit: DIGITS.get(unit, OTHER_DIGITS)
    rows = []
    for asked, variable in [(v, v) for v in VARIABLES] + list(ALIASES.items()):
        si = VARIABLES[variable][0]
        human, scale, offset = HUMAN.get(variable, (LABELS.get(si, si), 1.0, 0.0))
        rows.append((asked, asked, [variable], si, human, scale, offset, digits(si), digits(human)))
    rows += [(x, "wind_speed", ["10u", "10v"], "m s-1", "m/s", 1.0, 0.0, 1, 1) for x in ("wind", "wind_speed")]
    schema = "asked string, name string, inputs array<string>, unit_si string, unit_human string, scale double, offset double, digits_si int, digits_human int"
    return spark.createDataFrame(rows, schema)


def axis_lat(spark: SparkSession) -> DataFrame:
    return spark.range(N_LAT).select(F.col("id").cast("int").alias("lat_i"), (90 - F.col("id") * STEP).alias("lat"))


def axis_lon(spark: SparkSession) -> DataFrame:
    return spark.range(N_LON).select(F.col("id").cast("int").alias("lon_i"), (-180 + F.col("id") * STEP).alias("lon"))
