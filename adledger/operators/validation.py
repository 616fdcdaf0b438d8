"""Field rules, consistency rules, historical outliers and crawl quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger import lexicon as lx
from adledger.functions.text import blank_to_null, first_group, strip
from adledger.operators.scan import values_at

_FLAGS = "array<struct<field:string,severity:string,code:string,message:string>>"


def _flag(code: str, *values: Column) -> Column:
    field, severity, template = lx.VALIDATION[code]
    pieces = template.split("{}")
    message = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        message += [value.cast("string"), F.lit(piece)]
    return F.struct(
        F.lit(field).alias("field"), F.lit(severity).alias("severity"),
        F.lit(code).alias("code"), F.concat(*message).alias("message"),
    )


def _range_checks(name: str, value: Column, floor: int, ceiling: int, low_ok: Column) -> Column:
    """The first failing rule among negative, zero, low and high."""
    return (
        F.when(value < 0, _flag(f"{name}_negative", value))
        .when(value == 0, _flag(f"{name}_zero"))
        .when((value < floor) & ~low_ok, _flag(f"{name}_very_low", value))
        .when(value > ceiling, _flag(f"{name}_very_high", value))
    )


def validation_flags() -> Column:
    """All field and cross-field findings of one listing, in rule order."""
    price, km, hp = F.col("price_eur"), F.col("mileage_km"), F.col("power_hp")
    no = F.lit(False)
    year = first_group(F.col("first_registration"), r"(?U)\b(20\d\d)").try_cast("int")
    engine = F.coalesce(blank_to_null(F.col("engine")), blank_to_null(F.col("probable_engine")))
    trim = blank_to_null(F.col("trim"))
    mismatch = F.lit(None)
    for code, allowed in lx.ENGINE_TRIMS.items():
        mismatch = F.when(
            (engine == code) & ~trim.isin(allowed),
            _flag("engine_trim_mismatch", engine, trim, F.lit(", ".join(sorted(allowed)))),
        ).otherwise(mismatch)
    found = [
        _range_checks("price", price, lx.PRICE_FLOOR, lx.PRICE_CEILING,
                      F.col("price_label").isNotNull()),
        F.when(price.isNull(), _flag("price_missing")),
        _range_checks("mileage", km, lx.MILEAGE_FLOOR, lx.MILEAGE_CEILING, no),
        F.when(km.isNull(), _flag("mileage_missing")),
        _range_checks("power", hp, lx.POWER_FLOOR, lx.POWER_CEILING, no),
        F.when(~year.between(*lx.REGISTRATION_YEARS), _flag("year_out_of_range", year)),
        mismatch,
        F.when(trim.isNull(), _flag("trim_missing")),
        F.when(blank_to_null(F.col("body_style")).isNull(), _flag("body_style_missing")),
        F.when(
            price.isNull() & blank_to_null(strip(F.col("price_label"))).isNull(),
            _flag("price_fully_missing"),
        ),
    ]
    return F.array_compact(F.array(*found)).cast(_FLAGS)


def index_quartiles(history: DataFrame, column: str) -> DataFrame:
    """One row ``n, q1, q3``: the sorted values at positions n//4 and 3n//4."""
    return values_at(history, column, {"q1": lambda n: F.floor(n / 4), "q3": lambda n: F.floor(3 * n / 4)})


def historical_flags(price_range: Column, mileage_range: Column) -> Column:
    """Outlier findings against the quartiles of the stored listings (structs n, q1, q3)."""
    def limits(r: Column) -> tuple[Column, Column, Column, Column]:
        iqr = r["q3"] - r["q1"]
        spread = lx.OUTLIER_IQR_FACTOR * iqr
        return r["n"] >= lx.OUTLIER_MIN_POPULATION, iqr, r["q1"] - spread, r["q3"] + spread

    price, km = F.col("price_eur"), F.col("mileage_km")
    enough_p, iqr_p, low_p, high_p = limits(price_range)
    enough_m, iqr_m, _, high_m = limits(mileage_range)
    found = [
        F.when(
            enough_p & (price < low_p),
            _flag("price_below_historical_range", price, price_range["q1"], iqr_p),
        ).when(
            enough_p & (price > high_p),
            _flag("price_above_historical_range", price, price_range["q3"], iqr_p),
        ),
        F.when(
            enough_m & (km > high_m),
            _flag("mileage_above_historical_range", km, mileage_range["q3"], iqr_m),
        ),
    ]
    return F.array_compact(F.array(*found)).cast(_FLAGS)


def with_historical_flags(listings: DataFrame, history: DataFrame) -> DataFrame:
    """Append outlier findings; the quartiles are computed once, as scalar subqueries."""
    def packed(column: str) -> Column:
        return index_quartiles(history, column).select(F.struct("n", "q1", "q3")).scalar()

    return listings.withColumns(
        {"_price": packed("price_eur"), "_mileage": packed("mileage_km")}
    ).withColumn(
        "validation_flags",
        F.concat(
            F.coalesce(F.col("validation_flags"), F.array().cast(_FLAGS)),
            historical_flags(F.col("_price"), F.col("_mileage")),
        ),
    ).drop("_price", "_mileage")


def crawl_quality(
    listings: DataFrame, *, min_total: int = lx.QUALITY_MIN_TOTAL,
    min_by_source: dict[str, int] | None = None,
) -> DataFrame:
    """One row per missed minimum: ``scope, actual, expected``; silent sources count as 0."""
    spark = listings.sparkSession
    minimums = dict(lx.QUALITY_MIN_BY_SOURCE if min_by_source is None else min_by_source)
    counts = listings.groupBy(
        F.coalesce(blank_to_null(F.col("source")), F.lit("unknown")).alias("scope")
    ).agg(F.count("*").alias("actual"))
    total = listings.agg(F.count("*").alias("actual")).select(
        F.lit("total").alias("scope"), "actual", F.lit(min_total).cast("bigint").alias("expected")
    )
    wanted = spark.createDataFrame(list(minimums.items()), "scope string, expected bigint")
    by_source = wanted.join(counts, "scope", "left").select(
        "scope", F.coalesce("actual", F.lit(0)).alias("actual"), "expected"
    )
    return total.unionByName(by_source).filter("actual < expected")


def quality_message() -> Column:
    """Warning text for a row of :func:`crawl_quality`."""
    return F.when(
        F.col("scope") == "total",
        F.format_string(
            "Crawler quality: only %d total listings parsed; expected at least %d",
            "actual", "expected"),
    ).otherwise(F.format_string(
        "Crawler quality: only %d %s listings parsed; expected at least %d",
        "actual", "scope", "expected"))


