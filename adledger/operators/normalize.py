"""Extracted cards -> typed listings, as a few chained projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger import lexicon as lx
from adledger import schema
from adledger.functions import extract as x
from adledger.functions import identity
from adledger.functions.text import (
    blank_to_null, join_present, squash, strip, text_or_empty,
)
from adledger.operators.scoring import score
from adledger.operators.validation import validation_flags


def with_price(df: DataFrame) -> DataFrame:
    """Add ``price_eur`` and ``price_label``: the price field decides; only if it says
    nothing at all, the whole text. Each text is scanned once."""
    silent = F.col("_own_price").isNull() & F.col("_own_label").isNull()
    return df.withColumns({
        "_own_price": x.price_eur(F.col("price_text")),
        "_own_label": x.price_label_lower(F.lower("price_text")),
    }).withColumn("_text_price", F.when(silent, x.price_eur(F.col("combined")))).withColumns({
        "price_eur": F.coalesce("_own_price", "_text_price"),
        "price_label": F.when(
            silent & F.col("_text_price").isNull(), x.price_label_lower(F.lower("combined"))
        ).otherwise(F.col("_own_label")),
    }).drop("_own_price", "_own_label", "_text_price")


def _slug(value: Column) -> Column:
    return F.replace(F.lower(value), F.lit(" "), F.lit("_"))


def infer(df: DataFrame) -> DataFrame:
    """Domain inferences over ``engine, trim, transmission, body_style``.

    The engine settles the trim, the trim settles gearbox and body. Every step
    that changes something leaves a note; contradicted evidence leaves a conflict.
    """
    implied = F.when(F.col("engine") == "LS7", F.lit("Z06")).when(
        F.col("engine") == "LS9", F.lit("ZR1")
    )
    trim_off = implied.isNotNull() & ~F.col("trim").eqNullSafe(implied)
    df = df.withColumns({
        "_n1": F.when(trim_off, F.concat(F.col("engine"), F.lit(" → "), implied)),
        "_c1": F.when(
            trim_off & F.col("trim").isNotNull(),
            F.concat(F.lit("conflict_"), F.lower("engine"), F.lit("_trim_"), _slug(F.col("trim"))),
        ),
        "trim": F.coalesce(implied, F.col("trim")),
    })
    track = F.coalesce(F.col("trim").isin("Z06", "ZR1"), F.lit(False))
    low_trim = F.lower("trim")
    gear_off = track & ~F.col("transmission").eqNullSafe(F.lit("manual"))
    body_off = track & ~F.col("body_style").eqNullSafe(F.lit("Coupé"))
    targa = ~track & F.coalesce(F.col("body_style").isin("Coupé", "Targa"), F.lit(False))
    notes = [
        F.col("_n1"),
        F.when(gear_off, F.concat("trim", F.lit(" → Schalter"))),
        F.when(body_off, F.concat("trim", F.lit(" → Coupé"))),
        F.when(targa, F.lit("Coupé/Coupe → Targa")),
    ]
    conflicts = [
        F.col("_c1"),
        F.when(gear_off, F.concat(
            F.lit("conflict_"), low_trim, F.lit("_transmission_"), F.col("transmission"))),
        F.when(body_off, F.concat(
            F.lit("conflict_"), low_trim, F.lit("_body_"), F.lower("body_style"))),
    ]
    return df.withColumns({
        "inference_notes": F.array_distinct(F.array_compact(F.array(*notes))),
        "conflict_flags": F.array_distinct(F.array_compact(F.array(*conflicts))),
        "transmission": F.when(track, F.lit("manual")).otherwise(F.col("transmission")),
        "body_style": F.when(track, F.lit("Coupé")).when(targa, F.lit("Targa")).otherwise(
            F.col("body_style")
        ),
    }).drop("_n1", "_c1")


def model_name(trim: Column, body_style: Column) -> Column:
    variant = F.when((trim == "Base") & body_style.isNotNull(), body_style).otherwise(trim)
    return F.concat_ws(" ", F.lit(lx.MODEL_NAME), variant)


def damage_columns(risks: Column, accident: Column, combined_lower: Column) -> dict[str, Column]:
    damaged = F.array_contains(risks, "damage_reported")
    told = F.filter(risks, lambda f: f.isin("damage_reported", "accident_reported"))
    imported = F.array_contains(risks, "salvage_import_possible") & combined_lower.contains("import")
    return {
        "damage": F.when(damaged, F.array_join(told, "; ")),
        "has_damage": F.when(damaged, F.lit(True)).when(accident == "unfallfrei", F.lit(False)),
        "origin_country": F.when(imported, F.lit("US")),
        "origin_confidence": F.when(imported, F.lit(0.7)),
    }


def power_columns() -> dict[str, Column]:
    """Estimate, notes and confidence from ``engine``, ``probable_engine``, ``power_hp``."""
    engine, hp = F.col("engine"), F.col("power_hp")
    shown = F.coalesce(engine, F.col("probable_engine"))
    estimate = F.when(hp.isNull(), x.stock_hp(shown))
    return {
        "estimated_power_hp": estimate,
        "power_note": F.when(
            estimate.isNotNull(),
            F.concat(F.lit("Motor "), shown, F.lit(" → Leistung ca. "), estimate.cast("string"),
                     F.lit(" PS geschätzt")),
        ),
        "engine_confidence": F.when(engine.isNotNull(), F.lit(1.0)).otherwise(
            x.probable_engine_confidence(hp)
        ),
        "engine_note": F.when(
            engine.isNotNull(), F.lit("Motorcode explizit im Inserat erkannt")
        ).when(
            F.col("probable_engine").isNotNull(),
            F.concat(F.lit("Leistung "), hp.cast("string"), F.lit(" PS → wahrscheinlich "),
                     F.col("probable_engine")),
        ),
    }


def normalize_listings(
    cards: DataFrame, *, scoring: dict | None = None, allow_zero_vin: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One listing per card that offers the model; other cards are dropped.

    No expression here can throw on bad text, so one odd card never fails a run.
    ``keep`` names columns of ``cards`` (such as ``pos``) to carry along.
    """
    text = {
        c: text_or_empty(F.col(c))
        for c in ("title", "description", "price_text", "location_raw")
    }
    folded = cards.select(
        "source", "source_listing_id", identity.canonical_url(F.col("url")).alias("url"),
        text["title"].alias("title"), text["description"].alias("description"),
        text["price_text"].alias("price_text"), "location_raw", "image_urls", *keep,
        join_present(*text.values()).alias("combined"),
    ).filter(x.is_candidate(F.col("title"), F.col("combined"))).withColumns({
        "_lower": F.lower("combined"), "_upper": F.upper("combined"),
        "_title_lower": F.lower("title"), "_title_upper": F.upper("title"),
    })
    combined, lower, upper = F.col("combined"), F.col("_lower"), F.col("_upper")
    facts = with_price(folded).withColumns({
        "mileage_km": x.mileage_km(combined),
        "engine": x.engine_upper(upper),
        "power_hp": x.power_hp(combined),
        "trim": x.trim_upper(F.col("_title_upper"), upper),
        "transmission": x.transmission_lower(lower),
        "body_style": F.coalesce(
            x.body_style_lower(F.col("_title_lower")), x.body_style_lower(lower)
        ),
        "first_registration": x.first_registration(combined),
        "tuv_until": x.tuv_until(combined),
        "accident_status": x.accident_status_lower(lower),
        "risk_flags": x.risk_flags_lower(lower),
        "vin": x.vin(combined, allow_zero=allow_zero_vin),
        "model_year": x.model_year(combined),
        "power_kw": x.power_kw(combined),
        "displacement_cc": x.displacement_cc_lower(lower),
        "drivetrain": x.drivetrain_lower(lower),
        "condition": x.condition_lower(lower),
        "owners_count": x.owners_count_lower(lower),
        "service_history": x.service_history_lower(lower),
        "warranty": x.warranty_lower(lower),
        **x.equipment_lower(lower),
    }).withColumn(
        "probable_engine",
        F.when(F.col("engine").isNull(), x.probable_engine(F.col("power_hp"))),
    )
    typed = infer(facts).withColumns({
        **power_columns(),
        **damage_columns(F.col("risk_flags"), F.col("accident_status"), lower),
        "id": identity.stable_id(F.col("source"), F.col("source_listing_id"), F.col("url")),
        "title": squash(F.col("title")),
        "description_text": blank_to_null(squash(F.col("description"))),
        "model": model_name(F.col("trim"), F.col("body_style")),
        "location_country": F.when(blank_to_null(F.col("location_raw")).isNotNull(), F.lit("DE")),
        "location_raw": blank_to_null(strip(F.col("location_raw"))),
        "image_urls": F.array_distinct(
            F.coalesce(F.col("image_urls"), F.array().cast("array<string>"))
        ),
    })
    listings = schema.conform(typed, keep=keep)
    return listings.withColumns(
        {"validation_flags": validation_flags(), "score": score(scoring)}
    )
