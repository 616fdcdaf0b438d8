"""Provider hook: build its input, run it per partition, merge its result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adledger import lexicon as lx
from adledger import schema
from adledger.functions.text import squash

_RESULT = T.StructType([
    T.StructField("id", T.StringType()), *schema.ENRICHMENT_RESULT.fields,
    T.StructField("error", T.StringType()),
])


def enrichment_input(listings: DataFrame, *, max_images: int | None = None) -> DataFrame:
    """What a provider sees: texts, the images (the first ``max_images`` if given) and the non-empty known fields."""
    def text(name: str) -> Column:
        column = F.col(name)
        if name == "risk_flags":
            return F.when(F.size(column) > 0, F.to_json(column))
        return column.cast("string")

    pairs = [x for name in lx.KNOWN_FIELDS for x in (F.lit(name), text(name))]
    return listings.select(
        F.col("id").alias("listing_id"), "source", "title", "url",
        F.col("description_text").alias("description"),
        (F.col("image_urls") if max_images is None else F.slice("image_urls", 1, max_images)).alias("image_urls"),
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("known_fields"),
    )


def call_provider(inputs: DataFrame, make_provider: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """Run a user's provider over Arrow batches, one instance per task.

    ``make_provider()`` returns a function from one input record to one result
    record. A failing record yields a row with ``error`` instead of failing the job, and so do
    all records of a task in which the provider cannot start.
    """
    names = [f.name for f in _RESULT]

    def started() -> Callable[[dict], dict]:
        try:
            return make_provider()
        except Exception as exc:  # a provider may raise anything
            why = f"provider did not start: {exc}"

        def refuse(record: dict) -> dict:
            raise RuntimeError(why)

        return refuse

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = started()
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                try:
                    result = {**provider(record), "error": None}
                except Exception as exc:  # a provider may raise anything
                    result = {"error": str(exc)}
                result["id"] = record["listing_id"]
                rows.append([result.get(n) for n in names])
            yield pd.DataFrame(rows, columns=names).astype(object)

    return inputs.mapInPandas(run, _RESULT)


def provider_warnings(results: DataFrame) -> DataFrame:
    """(scope, message) for each kind of error of a provider, with the number of records."""
    return results.filter("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n")).select(
        F.lit("AI enrichment").alias("scope"), F.concat("error", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("message"))


def merge_unique(existing: Column, additions: Column) -> Column:
    """Append additions not yet present, ignoring case and white space."""
    empty = F.array().cast("array<string>")
    clean = F.filter(F.transform(F.coalesce(additions, empty), squash), lambda a: a != "")

    def step(merged: Column, item: Column) -> Column:
        present = F.exists(merged, lambda m: F.lower(m) == F.lower(item))
        return F.when(present, merged).otherwise(F.array_append(merged, item))

    return F.aggregate(clean, F.coalesce(existing, empty), step)


def merge_results(listings: DataFrame, results: DataFrame) -> DataFrame:
    """Fill missing scalars, extend lists, keep provenance; parser values stay."""
    fields = F.struct(*[
        F.col(f"_r_{c}").alias(c)
        for c in ("exterior_color", "interior_color", "transmission", "body_style", "eu_spec",
                  "equipment", "visual_flags", "risk_flags")
    ])
    renamed = results.filter("error IS NULL").select(
        "id", F.lit(True).alias("_hit"),
        *[F.col(f.name).alias(f"_r_{f.name}") for f in schema.ENRICHMENT_RESULT],
    )
    joined = listings.join(renamed, "id", "left")
    changes = {
        c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.col(f"_r_{c}"), F.lit("")), F.col(c))
        for c in ("exterior_color", "interior_color", "transmission")
    }
    changes["eu_spec"] = F.coalesce("eu_spec", "_r_eu_spec")
    for c in ("equipment", "visual_flags", "risk_flags"):
        changes[c] = F.when(F.col("_hit"), merge_unique(F.col(c), F.col(f"_r_{c}"))).otherwise(
            F.col(c)
        )
    provenance = F.struct(
        F.col("_r_provider").alias("provider"), F.col("_r_confidence").alias("confidence"),
        F.col("_r_notes").alias("notes"), F.col("_r_evidence").alias("evidence"),
        fields.alias("fields"),
    )
    changes["ai_enrichment"] = F.when(F.col("_hit"), provenance).otherwise(F.col("ai_enrichment"))
    return joined.withColumns(changes).select(*listings.columns)
