"""Rules that read typed facts out of ad text.

Each function takes the text column (never null) and gives one typed column.
Rules named ``*_lower`` / ``*_upper`` expect the text already lower- or
upper-cased, so that one projection can share the case folding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adledger import lexicon as lx
from adledger.functions.text import (
    case, contains_any, digits, first_group, let, scan, strip, within,
)


def price_eur(text: Column) -> Column:
    """First number with a currency mark; else the first bare one away from 'km'."""
    hits = F.filter(
        F.transform(
            scan(text, lx.PRICE_SCAN, groups=2, left=20, right=15, shortest=4),
            lambda m: F.struct(
                digits(m["g1"]).alias("value"),
                (m["g2"] != "").alias("marked"),
                (F.lower(m["left"]).rlike(lx.KM_WORD) | F.lower(m["right"]).rlike(lx.KM_WORD))
                .alias("near_km"),
            ),
        ),
        lambda m: m["value"].between(*lx.PRICE_RANGE) & (m["marked"] | ~m["near_km"]),
    )
    return let(hits, lambda h: F.coalesce(
        F.get(F.filter(h, lambda m: m["marked"]), F.lit(0)), F.get(h, F.lit(0))
    ))["value"]


def price_label_lower(lower: Column) -> Column:
    return case([
        (lower.contains("verschenken"), lx.LABEL_FREE),
        (lower.rlike(lx.NEGOTIABLE_WORD) | lower.contains("verhandlungsbasis"),
         lx.LABEL_NEGOTIABLE),
        (lower.contains("auf anfrage"), lx.LABEL_ON_REQUEST),
    ])


def mileage_km(text: Column) -> Column:
    return within(digits(first_group(text, lx.MILEAGE)), (0, lx.MILEAGE_LIMIT))


def power_hp(text: Column) -> Column:
    return within(digits(first_group(text, lx.POWER_HP)), lx.POWER_HP_RANGE)


def power_kw(text: Column) -> Column:
    return within(digits(first_group(text, lx.POWER_KW)), lx.POWER_KW_RANGE)


def model_year(text: Column) -> Column:
    return within(digits(first_group(text, lx.MODEL_YEAR)), lx.MODEL_YEAR_RANGE)


def first_registration(text: Column) -> Column:
    """First month/year of a production year not belonging to an inspection date."""
    dated = F.filter(
        scan(text, lx.MONTH_YEAR, groups=2, left=18, right=0, shortest=6),
        lambda m: ~contains_any(F.lower(m["left"]), lx.INSPECTION_WORDS)
        & m["g2"].try_cast("int").between(*lx.PRODUCTION_YEARS),
    )
    first = F.get(
        F.transform(dated, lambda m: F.concat(m["g2"], F.lit("-"), F.lpad(m["g1"], 2, "0"))),
        F.lit(0),
    )
    return F.coalesce(first, F.concat(first_group(text, lx.PRODUCTION_YEAR), F.lit("-01")))


def tuv_until(text: Column) -> Column:
    return F.concat(
        first_group(text, lx.INSPECTION, 2),
        F.lit("-"),
        F.lpad(first_group(text, lx.INSPECTION, 1), 2, "0"),
    )


def engine_upper(upper: Column) -> Column:
    codes = [(upper.contains(code), code) for code in lx.ENGINE_CODES]
    credible_zr1 = (
        upper.contains("ZR1")
        & ~contains_any(upper, ["CABRIO", "CONVERTIBLE"])
        & ~upper.rlike(lx.ZR1_ACCESSORY)
    )
    return case(codes + [
        (upper.rlike(lx.ENGINE_70), "LS7"),
        (credible_zr1, "LS9"),
        (upper.rlike(lx.ENGINE_62), "LS3"),
        (upper.rlike(lx.ENGINE_60), "LS2"),
    ])


def probable_engine(hp: Column) -> Column:
    return case([(hp.between(lo, hi), code) for lo, hi, code, _ in lx.POWER_BANDS])


def probable_engine_confidence(hp: Column) -> Column:
    out = F.lit(None).cast("double")
    for lo, hi, _, confidence in lx.POWER_BANDS:
        out = F.when(hp.between(lo, hi), F.lit(confidence)).otherwise(out)
    return out


def stock_hp(engine: Column) -> Column:
    out = F.lit(None).cast("int")
    for code, hp in lx.STOCK_HP.items():
        out = F.when(engine == code, F.lit(hp)).otherwise(out)
    return out


def specific_trim_upper(upper: Column) -> Column:
    return case([(contains_any(upper, words), trim) for trim, words in lx.TRIM_WORDS])


def trim_upper(title_upper: Column, text_upper: Column) -> Column:
    """Title evidence first (specific, then Base), then the whole text."""
    return F.coalesce(
        specific_trim_upper(title_upper),
        F.when(contains_any(title_upper, [lx.MODEL_WORD, lx.GENERATION]), F.lit("Base")),
        specific_trim_upper(text_upper),
        F.when(text_upper.contains(lx.MODEL_WORD), F.lit("Base")),
    )


def transmission_lower(lower: Column) -> Column:
    return case([
        (contains_any(lower, lx.MANUAL_WORDS) | lower.rlike(lx.MANUAL_WORD), "manual"),
        (contains_any(lower, lx.AUTOMATIC_WORDS), "automatic"),
    ])


def body_style_lower(lower: Column) -> Column:
    return case([(contains_any(lower, words), style) for style, words in lx.BODY_WORDS])


def displacement_cc_lower(lower: Column) -> Column:
    litres = F.replace(first_group(lower, lx.DISPLACEMENT), F.lit(","), F.lit("."))
    known = F.create_map(*[F.lit(v) for pair in lx.DISPLACEMENT_CC.items() for v in pair])
    return F.when(lower.rlike(lx.SUPERCHARGED_62), F.lit(lx.SUPERCHARGED_CC)).otherwise(
        F.try_element_at(known, litres)
    )


def drivetrain_lower(lower: Column) -> Column:
    return case([(contains_any(lower, words), drive) for drive, words in lx.DRIVE_WORDS])


def condition_lower(lower: Column) -> Column:
    """Stated vehicle condition; a value with digits or accident words is skipped."""
    def usable(value: Column) -> Column:
        fits = F.length(value).between(2, 40)
        plain = ~value.rlike(r"(?U)\d") & ~value.contains("unfall")
        capitalized = F.concat(F.upper(F.left(value, F.lit(1))), F.substr(value, F.lit(2)))
        return F.when(fits & plain, capitalized)

    return F.coalesce(
        *[let(strip(first_group(lower, p)), usable) for p in lx.CONDITION_PATTERNS]
    )


def owners_count_lower(lower: Column) -> Column:
    labelled = first_group(lower, lx.OWNERS_LABELLED)
    stated = F.coalesce(labelled, first_group(lower, lx.OWNERS_HAND))
    return within(stated.try_cast("int"), lx.OWNERS_RANGE)


def service_history_lower(lower: Column) -> Column:
    return F.when(contains_any(lower, lx.NO_SERVICE_WORDS), F.lit(False)).when(
        contains_any(lower, lx.SERVICE_WORDS), F.lit(True)
    )


def warranty_lower(lower: Column) -> Column:
    return F.when(contains_any(lower, lx.NO_WARRANTY_WORDS), F.lit(False)).when(
        contains_any(lower, lx.WARRANTY_WORDS), F.lit(True)
    )


def equipment_lower(lower: Column) -> dict[str, Column]:
    """The seven equipment facts; each is true or unknown, never false."""
    conditions = {
        "magnetic_ride": contains_any(lower, lx.MAGNETIC_RIDE_WORDS),
        "active_exhaust": contains_any(lower, lx.ACTIVE_EXHAUST_WORDS),
        "head_up_display": contains_any(lower, lx.HEAD_UP_WORDS)
        & ~lower.contains(lx.HEAD_UP_BLOCKER),
        "navigation": contains_any(lower, lx.NAVIGATION_WORDS),
        "bose_audio": lower.contains(lx.BOSE_WORD) & ~lower.contains(lx.BOSE_BLOCKER),
        "leather_interior": contains_any(lower, lx.LEATHER_WORDS)
        & (~lower.contains(lx.LEATHER_BLOCKER) | contains_any(lower, lx.LEATHER_SEAT_WORDS)),
        "heated_seats": contains_any(lower, lx.HEATED_SEAT_WORDS),
    }
    return {name: F.when(condition, F.lit(True)) for name, condition in conditions.items()}


def vin(text: Column, *, allow_zero: bool = False) -> Column:
    """First 17-character token; zeros are excluded unless ``allow_zero``."""
    pattern = lx.VIN_WITH_ZERO if allow_zero else lx.VIN
    return F.upper(first_group(text, pattern, 0))


def accident_status_lower(lower: Column) -> Column:
    return (
        F.when(contains_any(lower, lx.ACCIDENT_WORDS), F.lit("unfall"))
        .when(lower.contains(lx.ACCIDENT_FREE_WORD), F.lit("unfallfrei"))
        .otherwise(F.lit(lx.UNKNOWN_ACCIDENT))
    )


def risk_flags_lower(lower: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(contains_any(lower, words), F.lit(flag)) for flag, words in lx.RISK_WORDS])
    )


def is_candidate(title: Column, text: Column) -> Column:
    """Does the ad offer this model generation? Trim names alone are no evidence."""
    both = F.concat_ws(" ", title, text)
    upper = F.upper(both)
    names_generation = both.rlike(lx.GENERATION_TOKEN)
    return (
        ~title.rlike(lx.WANTED_TITLE)
        & (upper.contains(lx.MODEL_WORD) | names_generation)
        & ~both.rlike(lx.LATER_GENERATION)
        & ~both.rlike(lx.LATER_ENGINE)
        & (
            names_generation
            | upper.rlike(lx.PRODUCTION_YEAR)
            | contains_any(upper, lx.ENGINE_CODES)
        )
    )
