"""The whole analyses: winter water temperature, spawning catch, recruitment windows.

Each function is one stage on DataFrames; ``site`` names the columns that tell
lakes apart, so that many lakes are processed side by side. A site's daily
tables have one row per date, so the calendar bounds every window used here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwin.functions import columns as fn
from seasonwin.operators import aggregate, joins, models, ordered, rows, scan
from seasonwin.operators.models import AdditiveModel, BySmooth, Linear, RandomIntercept, Smooth, Tensor

# Codes, names and thresholds of the analysis.
LATITUDE = 46.06413190
SEX_CODES = {"Male": [1, "Male", "M"], "Female": [2, "Female", "F"], "Unknown": [3, "Unknown", "U"]}
STATIONS = [
    "EAGLE RIVER, WI US", "MINOCQUA, WI US", "PHELPS, WI US", "RAINBOW RSVR LK TOMAHAWK, WI US", "REST LAKE, WI US",
]
SPURIOUS_YEAR, SPURIOUS_ABOVE = 2006, 3.7
FIRST_SEASON = 1956
PERIODS = [(1958, 1983, "past"), (1984, 2002, "mid")]
LAST_PERIOD = "present"
GEAR, MONTHS, EXCLUDED_YEAR, ICE_RECORDS_AFTER = 2, (3, 5), 1948, 1955
NEAR_DAYS, PAD_DAYS = 15, 20
DOY_KNOTS = (80, 150)
ROLLING_ROWS, MAX_GAP = 21, 2
RECRUIT_BEFORE = 2021
RANGE, EXCLUDE, REPEATS = (120, -150), (10, -150), 100
WATER_BODY = 2339900


# ------------------------------------------------------------------ weather


def station_means(weather: DataFrame, stations: Sequence[str] = STATIONS, site: Sequence[str] = ()) -> DataFrame:
    """Daily means over the chosen stations."""
    return aggregate.daily_means(
        weather.where(F.col("NAME").isin(list(stations))), "DATE",
        dict(meanPrecip="PRCP", meanSnow="SNOW", meanMaxTemp="TMAX", meanMinTemp="TMIN", meanWind="WDMV"),
        {"meanTemp": ("meanMaxTemp", "meanMinTemp")}, ("N", "PRCP"), site,
    )


def station_coverage(weather: DataFrame, stations: Sequence[str] = STATIONS, after: int = 1946) -> DataFrame:
    chosen = weather.where(F.col("NAME").isin(list(stations)) & (F.year("DATE") > after))
    return aggregate.coverage(chosen, ["STATION", "NAME", "LATITUDE", "LONGITUDE"], "PRCP")


# --------------------------------------------------- winter water temperature


def winter_features(winter: DataFrame, ice: DataFrame, site: Sequence[str] = ()) -> DataFrame:
    """Under-ice days of the observed lake with everything the model needs.

    ``winter`` has ``sampledate, IceYear, WaterTemp, avg_air_temp``; ``ice`` has
    ``iceoff_year, IceOnDate, IceOffDate``.
    """
    keys, order = [*site, "IceYear"], ["sampledate"]
    spans = ice.select(*site, F.col("iceoff_year").alias("IceYear"), "IceOnDate", "IceOffDate")
    joined = joins.join_on(winter, spans, keys, "left")
    iced = joined.where(fn.flag_between("sampledate", "IceOnDate", "IceOffDate", 1, 1) == "ice")
    spurious = (F.col("WaterTemp") > SPURIOUS_ABOVE) & (F.col("IceYear") == SPURIOUS_YEAR)
    clean = iced.withColumn("WaterTemp", fn.null_where("WaterTemp", spurious))
    filled = ordered.interpolate_linear(clean, ["WaterTemp", "avg_air_temp"], keys, order)
    counted = ordered.count_both(filled, keys, order, "DaysFrozen", "fromThaw")
    warm = counted.withColumn("AboveFreezing", fn.hinge("avg_air_temp"))
    warm = ordered.running_sum(warm, "AboveFreezing", keys, order, "cumAboveFreezing")
    warm = ordered.running_sum(warm, "avg_air_temp", keys, order, "cumTemp")
    warm = ordered.rolling_agg(warm, "avg_air_temp", ROLLING_ROWS, keys, order, "threeweektemp")
    warm = ordered.rolling_agg(warm, "AboveFreezing", ROLLING_ROWS, keys, order, "threeweekwarm")
    return ordered.first_in_group(warm, "WaterTemp", keys, order, "day1temp")


def fit_water_model(features: DataFrame, k: int = 10) -> AdditiveModel:
    smooths = ["avg_air_temp", "cumAboveFreezing", "fromThaw", "threeweektemp", "threeweekwarm"]
    return models.fit_additive(features, "WaterTemp", [*[Smooth(x, k) for x in smooths], Linear("day1temp")])


def lake_features(temps: DataFrame, stations: DataFrame, site: Sequence[str] = ()) -> DataFrame:
    """Daily table of the modelled lake: filled temperatures and ice features.

    ``temps`` has ``Date, Year, LowAirTempC, HighAirTempC, WaterTempC_AM, WaterTempC_PM``.
    """
    air, water = ["LowAirTempC", "HighAirTempC"], ["WaterTempC_AM", "WaterTempC_PM"]
    on = {**{s: s for s in site}, "Date": "DATE"}
    filled = joins.fill_from(temps, stations, on, {"LowAirTempC": "meanMinTemp", "HighAirTempC": "meanMaxTemp"})
    filled = ordered.interpolate_linear(filled, air + water, site, ["Date"], max_gap=MAX_GAP)
    daily = filled.withColumns({
        "DOY": fn.day_of_year("Date"),
        "Photoperiod": fn.daylength(LATITUDE, fn.day_of_year("Date")),
        "iceyear": fn.season_year("Date"),
        "MeanWaterTemp": fn.row_mean(*water),
        "MeanAirTemp": fn.row_mean(*air),
    }).withColumns({
        "temp_iced": fn.flag_positive("MeanWaterTemp"),
        "AboveFreezing": fn.hinge("MeanAirTemp"),
    })
    year, state, order = [*site, "iceyear"], [*site, "iceyear", "temp_iced"], ["Date"]
    daily = ordered.rolling_agg(daily, "MeanAirTemp", ROLLING_ROWS, year, order, "threeweektemp")
    daily = ordered.rolling_agg(daily, "AboveFreezing", ROLLING_ROWS, year, order, "threeweekwarm")
    daily = ordered.count_down(daily, state, order, "_left")
    daily = daily.withColumn(
        "fromThaw", fn.if_known("temp_iced", F.col("temp_iced") == "Open", F.lit(0), F.col("_left"))
    ).drop("_left")
    daily = ordered.running_sum(daily, "AboveFreezing", state, order, "cumAboveFreezing")
    daily = ordered.value_before_peak(daily, "MeanWaterTemp", "fromThaw", year, order, "day1temp")
    first = F.col("iceyear") > FIRST_SEASON
    return daily.withColumn("day1temp", F.when(first, F.col("day1temp")))


def predict_water(features: DataFrame, model: AdditiveModel) -> DataFrame:
    """Observed temperature when the lake is open, the model's under ice."""
    scored = models.score(features.withColumn("avg_air_temp", F.col("MeanAirTemp")), model)
    return scored.withColumn("PredWaterTemp", fn.prefer_observed("MeanWaterTemp", "fit")).drop("fit", "avg_air_temp")


# -------------------------------------------------------------------- catch


def clean_catch(catch: DataFrame) -> DataFrame:
    """One row per fish with its sex and length."""
    labelled = catch.withColumn("Sex", fn.recode("Sex", SEX_CODES))
    fish = rows.uncount(labelled, "Count")
    return fish.withColumn("Length", F.coalesce("Length", "TLbin"))


def daily_catch(fish: DataFrame, site: Sequence[str] = ()) -> DataFrame:
    """Fish and females per day of the spring survey."""
    chosen = fish.where(
        (F.col("CorrGear") == GEAR) & F.col("Month").between(*MONTHS) & (F.col("Year") != EXCLUDED_YEAR)
    )
    return aggregate.group_counts(chosen, [*site, "Year", "DOY", "Date"], F.col("Sex") == "Female")


def select_catch(daily: DataFrame, site: Sequence[str] = ()) -> DataFrame:
    """Days near each year's mean day since ice records began, with the day centred."""
    keys = [*site, "Year"]
    near = rows.filter_near_group_mean(daily.where(F.col("Year") > ICE_RECORDS_AFTER), keys, "DOY", NEAR_DAYS)
    return ordered.center(near, "DOY", keys, "scDOY")


def catch_terms(kind: str = "GI") -> list:
    """Seasonal curve: global (G), plus yearly deviations sharing a penalty (GS) or not (GI)."""
    low, high = DOY_KNOTS
    curve = Smooth("DOY", 7 if kind == "G" else 6, cyclic=True, low=low, high=high)
    yearly = {"G": [], "GS": [BySmooth(curve, "Year", shared=True)], "GI": [BySmooth(curve, "Year")]}[kind]
    return [curve, *yearly, RandomIntercept("Year")]


def fit_catch_model(selected: DataFrame, kind: str = "GI", family: str = models.QUASIPOISSON) -> AdditiveModel:
    return models.fit_additive(selected, "Females", catch_terms(kind), family)


def catch_predictions(selected: DataFrame, model: AdditiveModel, pad: int = PAD_DAYS) -> DataFrame:
    """Fitted catch and its error for every day around each year's survey."""
    spine = rows.expand_seq(selected, ["Year"], F.min("DOY") - pad, F.max("DOY") + pad, "DOY")
    return models.score(spine, model, se=True)


def spawn_days(selected: DataFrame, model: AdditiveModel) -> DataFrame:
    """Spawning day per year: the surveyed day of the highest fitted catch, with its 95 % span.

    Days before or after the survey do not count, since no catch holds the curve there.
    """
    fitted = catch_predictions(selected, model, pad=0)
    return models.phenology_peak(fitted, ["Year"], "DOY", "fit").withColumnRenamed("peak", "SpawnDOY")


def environment(water: DataFrame, stations: DataFrame, site: Sequence[str] = ()) -> DataFrame:
    """Daily water temperature, degree days, day length and precipitation."""
    days = water.select(*site, "Date", "PredWaterTemp", "Photoperiod").withColumns({
        "GDD0": fn.hinge("PredWaterTemp"), "GDD5": fn.hinge("PredWaterTemp", 5.0, inclusive=True),
    })
    on = {**{s: s for s in site}, "Date": "DATE"}
    return joins.join_on(days, stations.select(*site, "DATE", "meanPrecip"), on)


def catch_environment(selected: DataFrame, env: DataFrame, site: Sequence[str] = ()) -> DataFrame:
    return rows.drop_missing(joins.join_on(selected, env, [*site, "Date"], "left"), ["PredWaterTemp"])


def fit_environment_model(joined: DataFrame) -> AdditiveModel:
    water, light, rain = Smooth("PredWaterTemp", 6), Smooth("Photoperiod", 10), Smooth("meanPrecip", 10)
    terms = [water, light, rain, Tensor(Smooth("Photoperiod", 5), Smooth("PredWaterTemp", 5)), RandomIntercept("Year")]
    return models.fit_additive(joined, "Females", terms, models.POISSON)


# -------------------------------------------------------------- recruitment


def recruit_dates(samples: DataFrame, water_body: int = WATER_BODY) -> DataFrame:
    return aggregate.mean_date(samples.where(F.col("MWBC") == water_body), ["YEAR"], "DATE")


def recruit_events(stock: DataFrame, spawn: DataFrame) -> DataFrame:
    """One event per year: log recruits per spawner at the spawning date."""
    ratio = stock.withColumn("y", fn.log_ratio("Age0PE", "AdultPE"))
    joined = joins.join_on(ratio, spawn, ["Year"], "left")
    known = rows.drop_missing(joined, ["SpawnDOY"]).where(F.col("Year") < RECRUIT_BEFORE)
    return known.select(
        F.col("Year").alias("event_id"), fn.date_from_doy("Year", "SpawnDOY").alias("bdate"), "y",
        fn.bucket_ranges("Year", PERIODS, LAST_PERIOD).alias("period"),
    )


def drivers(env: DataFrame) -> DataFrame:
    """The two driver series of the scan in long form, complete by day."""
    pair = F.explode(F.array(
        F.struct(F.lit("GDD0").alias("variable"), F.col("GDD0").alias("value")),
        F.struct(F.lit("Precip").alias("variable"), F.col("meanPrecip").alias("value")),
    ))
    long = env.select(F.col("Date").alias("date"), pair.alias("_p")).select("date", "_p.*").where("value is not null")
    return scan.complete_series(long)


def recruit_windows(events: DataFrame, series: DataFrame, by_period: bool = False) -> DataFrame:
    """The scan over all windows from 120 days before to 150 days after spawning."""
    return scan.scan_windows(events, series, *RANGE, EXCLUDE, group=["period"] if by_period else [])
