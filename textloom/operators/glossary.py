"""Business glossaries from JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.arrays import let
from textloom.functions.variants import last_key_wins
from textloom.operators.lookup import lookup_join

def is_glossary(text: Column) -> Column:
    """True for a JSON object whose values are lists of objects with both term keys.

    An object without categories is valid. In DataFrames built under ``last_key_wins``, as by
    ``flag_glossaries``, the last of repeated keys counts; else they make the text invalid.
    """
    return let(F.try_parse_json(text), _is_valid)


def _is_valid(parsed: Column) -> Column:

    def is_term(item: Column) -> Column:
        return (
            F.schema_of_variant(item).startswith("OBJECT")
            & F.try_variant_get(item, "$.name", "variant").isNotNull()
            & F.try_variant_get(item, "$.shortDescription", "variant").isNotNull()
        )

    def is_category(terms: Column) -> Column:
        items = F.try_variant_get(terms, "$", "array<variant>")
        return F.schema_of_variant(terms).startswith("ARRAY") & F.coalesce(F.forall(items, is_term), F.lit(False))

    categories = F.map_values(F.try_variant_get(parsed, "$", "map<string,variant>"))
    valid = F.schema_of_variant(parsed).startswith("OBJECT") & F.forall(categories, is_category)
    return F.coalesce(valid, F.lit(False))


def flag_glossaries(df: DataFrame, text: str = "text", out: str = "valid") -> DataFrame:
    """Add whether each text is a glossary."""
    with last_key_wins(df.sparkSession):
        return df.withColumn(out, is_glossary(F.col(text)))


def glossary_terms(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``terms(key, category_no, category, term_no, name, shortDescription)`` of valid texts.

    A text is parsed once; its categories stand where they first appear, with the terms of their last value.
    """
    with last_key_wins(df.sparkSession):
        parsed = df.select(key, F.try_parse_json(text).alias("_parsed"), F.json_object_keys(F.col(text)).alias("_keys"))
        valid = parsed.where(F.coalesce(_is_valid(F.col("_parsed")), F.lit(False)))
        lists = F.try_variant_get(F.col("_parsed"), "$", "map<string,array<map<string,variant>>>")
        each = valid.select(key, lists.alias("_lists"), F.posexplode(F.array_distinct("_keys")).alias("category_no", "category"))
        terms = each.select(
            key, "category_no", "category", F.posexplode(F.try_element_at("_lists", F.col("category"))).alias("term_no", "_term")
        )

        def value(name: str) -> Column:
            return F.try_variant_get(F.try_element_at("_term", F.lit(name)), "$", "string").alias(name)

        return terms.select(key, "category_no", "category", "term_no", value("name"), value("shortDescription"))


def glossary_id(name: Column) -> Column:
    """Id of a new glossary, the same on every run."""
    return F.concat(F.lit("glossary-"), F.md5(name.cast("binary")))


def get_or_create(categories: DataFrame, existing: DataFrame) -> DataFrame:
    """``glossaries(id, name, description, status, created)`` for every category name.

    ``categories`` has a column category, ``existing`` has id and name. A known name keeps its
    first id, every other name is created once.
    """
    names = categories.select(F.col("category").alias("name")).distinct()
    first = existing.groupBy("name").agg(F.min("id").alias("_known"))
    joined = names.join(first, "name", "left")
    created = F.col("_known").isNull()
    return joined.select(
        F.coalesce("_known", glossary_id(F.col("name"))).alias("id"),
        "name",
        F.when(created, F.concat(F.lit("Glossary for "), "name")).alias("description"),
        F.when(created, "ENABLED").alias("status"),
        created.alias("created"),
    )


def place_terms(terms: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append to the catalog: each term with the id of its glossary.

    Ids of new glossaries follow from their names, so the terms only meet the existing ones.
    """
    first = existing.groupBy(F.col("name").alias("category")).agg(F.min("id").alias("_known"))
    return lookup_join(terms, first, ["category"]).select(
        F.coalesce("_known", glossary_id(F.col("category"))).alias("glossary_id"),
        "category",
        "name",
        "shortDescription",
        F.lit("ENABLED").alias("status"),
    )
