"""Display strings for feeds, and small value helpers of the ranking page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adledger import lexicon as lx
from adledger.functions.text import blank_to_null


def _thousands(value: Column, unit: str) -> Column:
    grouped = F.replace(F.format_number(value, 0), F.lit(","), F.lit("."))
    return F.coalesce(F.concat(grouped, F.lit(unit)), F.lit(lx.NOT_AVAILABLE))


def format_eur(value: Column) -> Column:
    return _thousands(value, " €")


def format_km(value: Column) -> Column:
    return _thousands(value, " km")


def or_na(value: Column) -> Column:
    return F.coalesce(blank_to_null(value), F.lit(lx.NOT_AVAILABLE))


def percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def price_display() -> Column:
    label = blank_to_null(F.col("price_label"))
    return F.when(
        F.col("price_eur").isNotNull(), F.concat_ws(" ", format_eur(F.col("price_eur")), label)
    ).otherwise(or_na(label))


def power_display() -> Column:
    return F.coalesce(
        F.concat(F.col("power_hp").cast("string"), F.lit(" PS")),
        F.concat(F.lit("ca. "), F.col("estimated_power_hp").cast("string"), F.lit(" PS")),
        F.lit(lx.NOT_AVAILABLE),
    )


def engine_display() -> Column:
    confidence = F.concat(F.lit(" ("), percent(F.col("engine_confidence")), F.lit(")"))
    return F.coalesce(
        blank_to_null(F.col("engine")),
        F.concat(
            F.lit("wahrscheinlich "), blank_to_null(F.col("probable_engine")),
            F.coalesce(confidence, F.lit("")),
        ),
        F.lit(lx.NOT_AVAILABLE),
    )


def engine_note_display() -> Column:
    return F.when(
        blank_to_null(F.col("engine")).isNull(), blank_to_null(F.col("engine_note"))
    )


def variant_display() -> Column:
    trim, body = blank_to_null(F.col("trim")), blank_to_null(F.col("body_style"))
    return (
        F.when(trim != "Base", F.concat_ws(" ", trim, body))
        .when(body.isNotNull(), F.concat(F.lit("C6 "), body))
        .otherwise(or_na(trim))
    )


def transmission_display() -> Column:
    gear = F.col("transmission")
    return (
        F.when(gear == "manual", F.lit("Schalter"))
        .when(gear == "automatic", F.lit("Automatik"))
        .otherwise(or_na(gear))
    )


def ai_summary_display() -> Column:
    """Provider, confidence and notes; null when the record was not enriched."""
    ai = F.col("ai_enrichment")
    head = F.concat(
        F.coalesce(blank_to_null(ai["provider"]), F.lit("AI")),
        F.coalesce(
            F.concat(F.lit(" ("), percent(ai["confidence"]), F.lit(")")), F.lit("")
        ),
    )
    notes = blank_to_null(ai["notes"])
    return F.when(
        ai.isNotNull(), F.when(notes.isNotNull(), F.concat(head, F.lit(": "), notes)).otherwise(head)
    )


def price_per_1000_km() -> Column:
    price, km = F.nullif(F.col("price_eur"), F.lit(0)), F.nullif(F.col("mileage_km"), F.lit(0))
    return F.bround(price / km * 1000, 0).cast("int")


def item_year() -> Column:
    """Model year, else the year of first registration."""
    prefix = F.regexp_extract(F.left(F.col("first_registration"), F.lit(4)), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(
        F.col("model_year"),
        F.when(F.length("first_registration") >= 4, prefix.try_cast("int")),
    )


def accident_norm() -> Column:
    status = F.lower(F.coalesce(F.col("accident_status"), F.lit("")))
    return (
        F.when(F.col("has_damage"), F.lit(0.0))
        .when(~F.col("has_damage"), F.lit(1.0))
        .when(status == "unfallfrei", F.lit(1.0))
        .when(status.isin("", lx.UNKNOWN_ACCIDENT), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def eu_spec_norm() -> Column:
    return (
        F.when(F.col("eu_spec"), F.lit(1.0))
        .when(~F.col("eu_spec"), F.lit(0.0))
        .otherwise(F.lit(0.5))
    )


def markdown_block() -> Column:
    """One listing of the ranked text feed (expects a ``rank`` column)."""
    def listed(prefix: str, name: str) -> Column:
        items = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return F.when(F.size(items) > 0, F.concat(F.lit(prefix), F.array_join(items, ", ")))

    def optional(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), blank_to_null(value))

    def line(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), value)

    first_image = F.get(F.col("image_urls"), F.lit(0))
    parts = [
        F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), F.col("title"),
                 F.lit(" — "), price_display()),
        F.lit(""),
        F.concat(F.lit("!["), F.col("title"), F.lit("]("), first_image, F.lit(")\n")),
        line("- Quelle: ", F.col("source")),
        F.concat(F.lit("- Score: "), F.col("score").cast("string"), F.lit("/100")),
        F.concat(F.lit("- Variante/Motor: "), variant_display(), F.lit(" / "), engine_display()),
        line("- PS: ", power_display()),
        line("- Getriebe: ", transmission_display()),
        line("- Karosserie: ", or_na(F.col("body_style"))),
        optional("- Motor-Hinweis: ", engine_note_display()),
        optional("- PS-Hinweis: ", F.col("power_note")),
        listed("- Vermutungen: ", "inference_notes"),
        listed("- Konflikte: ", "conflict_flags"),
        listed("- Ausstattung (AI): ", "equipment"),
        listed("- Visuelle Hinweise (AI): ", "visual_flags"),
        line("- AI-Auswertung: ", ai_summary_display()),
        line("- Kilometer: ", format_km(F.col("mileage_km"))),
        line("- EZ: ", or_na(F.col("first_registration"))),
        line("- TÜV/HU: ", or_na(F.col("tuv_until"))),
        line("- Standort: ", or_na(F.col("location_raw"))),
        line("- Unfallstatus: ",
             F.coalesce(blank_to_null(F.col("accident_status")), F.lit(lx.UNKNOWN_ACCIDENT))),
        line("- Änderung: ",
             F.coalesce(blank_to_null(F.col("change_type")), F.lit(lx.UNKNOWN_ACCIDENT))),
        F.coalesce(listed("- Risiko-Flags: ", "risk_flags"), F.lit("- Risiko-Flags: keine")),
        line("- Link: ", F.col("url")),
        F.lit(""),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), "\n")
