"""Table schemas and the repairs applied when a stored record is read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adledger import lexicon as lx

STRINGS = T.ArrayType(T.StringType())

FLAG = T.StructType([
    T.StructField("field", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("message", T.StringType()),
])

ENRICHMENT_RESULT = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("exterior_color", T.StringType()),
    T.StructField("interior_color", T.StringType()),
    T.StructField("transmission", T.StringType()),
    T.StructField("body_style", T.StringType()),
    T.StructField("eu_spec", T.BooleanType()),
    T.StructField("equipment", STRINGS),
    T.StructField("visual_flags", STRINGS),
    T.StructField("risk_flags", STRINGS),
    T.StructField("notes", T.StringType()),
    T.StructField("evidence", T.MapType(T.StringType(), T.StringType())),
])

ENRICHMENT = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("notes", T.StringType()),
    T.StructField("evidence", T.MapType(T.StringType(), T.StringType())),
    T.StructField("fields", T.StructType([
        T.StructField("exterior_color", T.StringType()),
        T.StructField("interior_color", T.StringType()),
        T.StructField("transmission", T.StringType()),
        T.StructField("body_style", T.StringType()),
        T.StructField("eu_spec", T.BooleanType()),
        T.StructField("equipment", STRINGS),
        T.StructField("visual_flags", STRINGS),
        T.StructField("risk_flags", STRINGS),
    ])),
])


def _fields(type_: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(name, type_) for name in names]


_LISTING = {
    f.name: f
    for f in (
        _fields(
            T.StringType(), "id", "source", "source_listing_id", "url", "title", "generation",
            "model", "price_label", "engine", "probable_engine", "engine_note", "power_note",
            "trim", "first_registration", "tuv_until", "transmission", "body_style",
            "exterior_color", "interior_color", "accident_status", "damage", "location_raw",
            "location_country", "origin_country", "seller_type", "vin", "description_text",
            "drivetrain", "condition", "change_type", "cluster_id",
        )
        + _fields(
            T.IntegerType(), "price_eur", "mileage_km", "power_hp", "estimated_power_hp",
            "model_year", "power_kw", "displacement_cc", "owners_count", "score",
            "previous_price_eur",
        )
        + _fields(T.DoubleType(), "engine_confidence", "origin_confidence")
        + _fields(
            T.BooleanType(), "eu_spec", "has_damage", "service_history", "warranty",
            "magnetic_ride", "active_exhaust", "head_up_display", "navigation", "bose_audio",
            "leather_interior", "heated_seats", "hidden",
        )
        + _fields(
            STRINGS, "equipment", "visual_flags", "image_urls", "risk_flags", "inference_notes",
            "conflict_flags",
        )
        + _fields(T.ArrayType(FLAG), "validation_flags")
        + _fields(ENRICHMENT, "ai_enrichment")
    )
}
LISTING = T.StructType(list(_LISTING.values()))
EDITABLE_FIELDS = sorted(set(_LISTING) - set(lx.PROTECTED_FIELDS))

# one captured page per row: the input contract of the extraction job
PAGE = T.StructType(
    _fields(T.StringType(), "source", "url")
    + _fields(T.TimestampType(), "fetched_at")
    + _fields(T.IntegerType(), "http_status")
    + _fields(T.StringType(), "location_header", "server_header", "body")
)

# extracted card, before normalization
CARD = T.StructType(
    _fields(
        T.StringType(), "source", "source_listing_id", "url", "title", "description",
        "price_text", "location_raw",
    )
    + _fields(STRINGS, "image_urls")
)

_DEFAULTS = {"generation": lx.GENERATION, "accident_status": lx.UNKNOWN_ACCIDENT,
             "change_type": "new", "score": 0, "hidden": False}
_DOMAINS = {"trim": lx.TRIMS, "transmission": lx.TRANSMISSIONS, "body_style": lx.BODY_STYLES}


def default_for(name: str) -> Column:
    """Value a listing column takes when the input does not carry it."""
    type_ = _LISTING[name].dataType
    if name in _DEFAULTS:
        return F.lit(_DEFAULTS[name]).cast(type_)
    if isinstance(type_, T.ArrayType):
        return F.array().cast(type_)
    return F.lit(None).cast(type_)


def conform(df: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` onto the listing schema, adding absent columns as defaults.

    ``keep`` names further columns (such as ``pos``) to carry along.
    """
    have = set(df.columns)
    columns = [
        (F.col(f.name).cast(f.dataType) if f.name in have else default_for(f.name)).alias(f.name)
        for f in LISTING
    ]
    return df.select(*columns, *keep)


def repair(df: DataFrame) -> DataFrame:
    """Repair a record as read: null lists become empty, bad enum values null."""
    fixes = {
        f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType))
        for f in LISTING if isinstance(f.dataType, T.ArrayType) and f.name in df.columns
    }
    fixes |= {
        name: F.when(F.col(name).isin(domain), F.col(name))
        for name, domain in _DOMAINS.items() if name in df.columns
    }
    fixes |= {
        name: F.coalesce(F.col(name), default_for(name))
        for name in _DEFAULTS if name in df.columns
    }
    return df.withColumns(fixes)


def to_payload(columns: list[str]) -> Column:
    """Record as JSON with its keys in sorted order."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def from_payload(df: DataFrame, column: str = "payload_json") -> DataFrame:
    """Read JSON payloads back into listing columns; unreadable ones give null ids."""
    parsed = df.withColumn("_record", F.from_json(column, LISTING, {"mode": "PERMISSIVE"}))
    rest = [c for c in df.columns if c != column and c not in _LISTING]
    return repair(parsed.select("_record.*", *rest))
