"""The whole analyses on synthetic inputs with the declared schemas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seasonwin.operators import scan
from seasonwin.plans import lake
from seasonwin.session import pin

START = dt.date(1958, 1, 1)


@pytest.fixture(scope="module")
def lakes(spark):
    rng = np.random.default_rng(6)
    days = pd.date_range(START, "1963-12-31")
    doy = days.dayofyear.to_numpy()
    air = -12 * np.cos(2 * np.pi * (doy - 20) / 365) + 2 + rng.normal(scale=3, size=len(days))
    water = np.maximum(-11 * np.cos(2 * np.pi * (doy - 35) / 365) + 7 + rng.normal(scale=0.3, size=len(days)), 0.0)
    temps = pd.DataFrame({
        "Date": days.date, "Year": days.year, "LowAirTempC": air - 4, "HighAirTempC": air + 4,
        "WaterTempC_AM": water, "WaterTempC_PM": water,
    })
    temps.loc[rng.choice(len(temps), 60, replace=False), "LowAirTempC"] = np.nan
    temps.loc[500:501, ["WaterTempC_AM", "WaterTempC_PM"]] = np.nan
    frame = spark.createDataFrame(temps.astype(object).where(temps.notna(), None), (
        "Date date, Year int, LowAirTempC double, HighAirTempC double, WaterTempC_AM double, WaterTempC_PM double"))
    weather = []
    for name, shift in (("PHELPS, WI US", -1.0), ("MINOCQUA, WI US", 1.0), ("ELSEWHERE", 50.0)):
        for i, day in enumerate(days):
            rain = None if (i + int(shift)) % 13 == 0 else float(rng.gamma(0.5, 4))
            weather.append((name, day.date(), rain, float(air[i] + 4 + shift), float(air[i] - 4 + shift)))
    station = spark.createDataFrame(weather, "NAME string, DATE date, PRCP double, TMAX double, TMIN double").withColumns(
        {"SNOW": F.lit(0.0), "WDMV": F.lit(None).cast("double")})
    return frame, station, temps, pin(lake.station_means(station), "stations")


@pytest.fixture(scope="module")
def winter(spark):
    rng = np.random.default_rng(7)
    rows, ice = [], []
    for year in range(2000, 2007):
        on, off = dt.date(year - 1, 12, 10), dt.date(year, 4, 5)
        ice.append((year, on, off))
        day = dt.date(year - 1, 12, 1)
        while day < dt.date(year, 4, 20):
            t = (day - on).days
            air = -8 + 0.1 * t + float(rng.normal(scale=3))
            water = None if rng.random() < 0.05 else 1.0 + 0.02 * t + 0.03 * max(air, 0) + float(rng.normal(scale=0.05))
            if year == 2006 and t == 40:
                water = 9.0
            rows.append((day, year, water, air))
            day += dt.timedelta(1)
    w = spark.createDataFrame(rows, "sampledate date, IceYear int, WaterTemp double, avg_air_temp double")
    i = spark.createDataFrame(ice, "iceoff_year int, IceOnDate date, IceOffDate date")
    return w, i


def test_station_means_leave_other_stations_out(lakes):
    _, station, _, means = lakes
    got = means.toPandas().set_index("DATE")
    raw = station.toPandas()
    raw = raw[raw.NAME != "ELSEWHERE"].groupby("DATE")
    assert got["meanPrecip"].sort_index().to_numpy() == pytest.approx(raw.PRCP.mean().to_numpy(), nan_ok=True)
    assert (got["N"].sort_index().to_numpy() == raw.PRCP.count().to_numpy()).all()


@pytest.fixture(scope="module")
def features(winter):
    return pin(lake.winter_features(*winter), "winter")


def test_winter_features(winter, features):
    got = features.toPandas().sort_values(["IceYear", "sampledate"])
    assert got["sampledate"].min() == dt.date(1999, 12, 9)
    for year, part in got.groupby("IceYear"):
        n = len(part)
        assert list(part["DaysFrozen"]) == list(range(1, n + 1))
        assert list(part["fromThaw"]) == list(range(n, 0, -1))
        warm = part["avg_air_temp"].clip(lower=0)
        assert part["cumAboveFreezing"].to_numpy() == pytest.approx(warm.cumsum().to_numpy())
        rolled = part["avg_air_temp"].rolling(21, min_periods=1).sum()
        assert part["threeweektemp"].to_numpy() == pytest.approx(rolled.to_numpy(), abs=1e-9)
        assert part["day1temp"].nunique(dropna=False) == 1
    assert got["WaterTemp"].max() < 6


def test_water_temperature_of_the_other_lake(lakes, features):
    frame, _, temps, means = lakes
    model = lake.fit_water_model(features, k=6)
    assert 1 - model.deviance / model.null_deviance > 0.9
    table = pin(lake.lake_features(frame, means), "lake")
    got = table.toPandas().sort_values("Date").reset_index(drop=True)
    assert len(got) == len(temps) and got["LowAirTempC"].notna().all()
    assert got["MeanWaterTemp"].notna().all()
    season = got["Year"] + (pd.to_datetime(got["Date"]).dt.month >= 7)
    assert (season == got["iceyear"]).all()
    for year, part in got.groupby("iceyear"):
        iced = part[part["temp_iced"] == "Ice"]
        assert list(iced["fromThaw"]) == list(range(len(iced), 0, -1))
        assert (part.loc[part["temp_iced"] == "Open", "fromThaw"] == 0).all()
        if len(iced) and iced.index[0] > part.index[0]:
            assert part["day1temp"].iloc[0] == pytest.approx(got["MeanWaterTemp"].loc[iced.index[0] - 1])
    pred = lake.predict_water(table, model).toPandas()
    seen = pred["MeanWaterTemp"] > 0
    assert (pred.loc[seen, "PredWaterTemp"] == pred.loc[seen, "MeanWaterTemp"]).all()
    known = ~seen & pred["day1temp"].notna()
    assert known.sum() > 300 and pred.loc[known, "PredWaterTemp"].between(-5, 10).all()


@pytest.fixture(scope="module")
def catch(spark):
    rng = np.random.default_rng(8)
    rows = []
    for year in range(1957, 1963):
        peak = 105 + int(rng.integers(-5, 6))
        for doy in list(range(92, 121)) + [60]:
            date = dt.date(year, 1, 1) + dt.timedelta(doy - 1)
            mean = 60 * np.exp(-((doy - peak) / 5.0) ** 2) + 2
            for code, share in (("2", 0.5), ("Male", 0.4), ("U", 0.1), ("??", 0.05)):
                rows.append((code, date, int(rng.poisson(mean * share)), None if doy % 2 else 40.0, 41.0, 2,
                             date.month, year, doy))
    return spark.createDataFrame(
        rows, "Sex string, Date date, Count int, Length double, TLbin double, CorrGear int, Month int, Year int, DOY int")


def test_catch_to_spawning_day(spark, catch):
    fish = lake.clean_catch(catch)
    total = catch.agg(F.sum("Count")).first()[0]
    assert fish.count() == total and fish.where("Length is null").count() == 0
    daily = lake.daily_catch(fish)
    selected = pin(lake.select_catch(daily), "catch")
    assert selected.where("DOY = 60").count() == 0
    assert abs(selected.agg(F.sum("scDOY")).first()[0]) < 60
    fits = {kind: lake.fit_catch_model(selected, kind) for kind in ("G", "GS", "GI")}
    assert fits["GI"].deviance < fits["G"].deviance and fits["GS"].deviance < fits["G"].deviance
    spawn = lake.spawn_days(selected, fits["GI"]).toPandas()
    spine = lake.catch_predictions(selected, fits["GI"]).toPandas()
    ends = selected.toPandas().groupby("Year")["DOY"].agg(["min", "max"])
    assert len(spine) == (ends["max"] - ends["min"] + 41).sum() and (spine["fit"] > 0).all() and (spine["se"] >= 0).all()
    best = selected.toPandas().groupby("Year")["Females"].agg(lambda v: v.idxmax())
    seen = selected.toPandas().loc[best].set_index("Year")["DOY"]
    assert (spawn.set_index("Year")["SpawnDOY"] - seen).abs().max() <= 6
    assert ((spawn["lower"] <= spawn["SpawnDOY"]) & (spawn["SpawnDOY"] <= spawn["upper"])).all()


def test_environment_model_and_recruitment(spark, lakes, catch):
    frame, _, _, means = lakes
    water = lake.lake_features(frame, means).withColumn("PredWaterTemp", F.col("MeanWaterTemp"))
    env = pin(lake.environment(water, means), "env")
    row = env.where("PredWaterTemp > 0 and PredWaterTemp < 5").first()
    assert row["GDD0"] == row["PredWaterTemp"] and row["GDD5"] == 0.0
    selected = lake.select_catch(lake.daily_catch(lake.clean_catch(catch)))
    joined = pin(lake.catch_environment(selected, env), "joined")
    model = lake.fit_environment_model(joined)
    assert model.deviance < model.null_deviance
    assert set(model.slices) == {
        "s(PredWaterTemp)", "s(Photoperiod)", "s(meanPrecip)", "ti(Photoperiod,PredWaterTemp)", "re(Year)"}

    stock = spark.createDataFrame([(y, 100.0 + 7 * y % 13, 50.0) for y in range(1956, 1965)], "Year int, Age0PE double, AdultPE double")
    spawn = spark.createDataFrame([(y, 100 + y % 7) for y in range(1957, 1964)], "Year int, SpawnDOY int")
    events = lake.recruit_events(stock, spawn)
    got = {r["event_id"]: r for r in events.collect()}
    assert sorted(got) == list(range(1957, 1964))
    assert got[1957]["period"] == "present" and got[1958]["period"] == "past"
    assert got[1960]["bdate"] == dt.date(1959, 12, 31) + dt.timedelta(100)
    series = pin(lake.drivers(env), "drivers")
    fits = lake.recruit_windows(events, series)
    counts = {(r["variable"], r["stat"], r["func"]): r["count"] for r in fits.groupBy(*scan.COMBO).count().collect()}
    assert len(counts) == 8 and set(counts.values()) == {34_191}
    assert {r["n"] for r in fits.select("n").distinct().collect()} == {5}
