"""Delimited and Parquet tables with declared schemas.

Readers never infer a schema unless asked to, since inference is one more pass
over the files. Unreadable dates, ``NA`` texts and NaN all arrive as NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonwin.functions.columns import nan_to_null

DATE_FORMAT = "M/d/y"
NA_TEXT = "NA"


def schema_of(**types: str) -> T.StructType:
    """``schema_of(Year="int", Date="date")``, all columns nullable."""
    return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in types.items()))


# The column names and types of the input tables.
STATION_DAILY = dict(
    STATION="string", NAME="string", LATITUDE="double", LONGITUDE="double", ELEVATION="double",
    DATE="date", AWND="double", MDWM="double", PRCP="double", SNOW="double", SNWD="double",
    TAVG="double", TMAX="double", TMIN="double", TSUN="double", WDMV="double",
)
CATCH = dict(
    Sex="string", Date="date", Count="int", Length="double", TLbin="double", CorrGear="int",
    Month="int", Year="int", DOY="int",
)
ICE_YEARS = dict(Year="int", IceOn="date", IceOff="date", IceDuration="int")
LAKE_ICE = dict(
    iceon_year="int", iceon_month="int", iceon_day="int", IceOnDate="date",
    iceoff_year="int", iceoff_month="int", iceoff_day="int", IceOffDate="date",
    duration="int", season="string", froze="string", latitude="double", longitude="double",
    lakename="string", lakecode="string", lakeorriver="string", country="string",
)
WINTER_TEMPS = {"sampledate": "date", "IceYear": "int", "WaterTemp": "double", "avg_air_temp": "double"}
LAKE_TEMPS = {
    "Date": "date", "Notes": "string", "Year": "int", "Month": "string", "LowAirTempC": "double",
    "HighAirTempC": "double", "WaterTempC.AM": "double", "WaterTempC.PM": "double",
}
STOCK_RECRUIT = dict(Year="int", Age0PE="double", AdultPE="double")
RECRUIT_DATES = dict(MWBC="int", DATE="date", YEAR="int")


def read_table(
    spark: SparkSession,
    path: str,
    schema: dict[str, str] | T.StructType | None = None,
    sep: str = ",",
    date_format: str = DATE_FORMAT,
    infer: bool = False,
) -> DataFrame:
    """A delimited file with a header.

    With ``infer`` (one more pass: small files only) columns that ``schema``
    doesn't name are inferred and the others have the types named, in the order of the file.
    """
    if schema is None and not infer:
        raise ValueError("name the columns' types, or ask for them to be inferred")
    named = schema_of(**schema) if isinstance(schema, dict) else schema
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("dateFormat", date_format)
        .option("nullValue", NA_TEXT)
        .option("mode", "PERMISSIVE")
    )
    if infer:
        found = reader.option("inferSchema", True).csv(path).schema
        types = {f.name: f for f in named.fields} if named else {}
        if unknown := types.keys() - set(found.names):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        named = T.StructType([types.get(f.name, f) for f in found.fields])
        reader = reader.option("inferSchema", False)
    reader = reader.schema(named)
    return clean_missing(reader.csv(path))


def plain_names(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores, as the analyses write them."""
    return df.toDF(*(n.replace(".", "_") for n in df.columns))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def clean_missing(df: DataFrame) -> DataFrame:
    """NaN, empty and ``NA`` texts become NULL, once, at the source."""
    fixed = {}
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            fixed[field.name] = nan_to_null(c)
        elif isinstance(field.dataType, T.StringType):
            fixed[field.name] = F.when(~F.trim(c).isin("", NA_TEXT), c)
    return df.select([fixed.get(n, F.col(f"`{n}`")).alias(n) for n in df.columns])


def write_table(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    date_format: str = DATE_FORMAT,
    sep: str = ",",
    partition_by: list[str] | None = None,
    mode: str = "overwrite",
) -> None:
    """Write Parquet, or CSV with header, quoting and an explicit date format."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer = (
            writer.option("header", True)
            .option("sep", sep)
            .option("dateFormat", date_format)
            .option("nullValue", NA_TEXT)
        )
    writer.format(format).save(path)
