"""Known names (people, organizations, addresses) found through a gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.functions.arrays import let
from textloom.functions.privacy import replace_names
from textloom.functions.text import bare, ngrams, words
from textloom.operators.lookup import MAX_INLINE_ROWS, lookup_join, rows_if_small

NAMES_TYPE = "array<struct<name:string,type:string>>"


def find_names(
    df: DataFrame,
    gazetteer: DataFrame,
    text: str = "text",
    out: str = "names",
    max_inline: int = MAX_INLINE_ROWS,
    max_broadcast: int | None = None,
) -> DataFrame:
    """Add the names of ``gazetteer(name, type)`` that occur in each text, by first appearance.

    Names match whole words, both without punctuation at their ends; a name with several types has the
    smallest. A small gazetteer becomes hash sets inside the plan and the stage needs no shuffle.
    Otherwise the distinct n-grams of each text are joined with it, broadcast or salted by its
    size, and come back by the digest of the text. Only n-grams as long as some name are
    made. NULL and empty texts have no names.
    """
    plain = bare(F.array_join(words(F.col("name")), " "))
    names = gazetteer.select(plain.alias("name"), "type").where("name <> ''")
    names = names.groupBy("name").agg(F.min("type").alias("type"))
    lengths = [r["n"] for r in names.select(F.size(words(F.col("name"))).alias("n")).distinct().collect()] or [1]
    rows = rows_if_small(names, max_inline)
    grams = ngrams(F.coalesce(F.col(text), F.lit("")), lengths)
    if rows is not None:
        by_type: dict[str, list[str]] = {}
        for row in rows:
            if row["type"] is not None:
                by_type.setdefault(row["type"], []).append(row["name"])

        def kind(name):
            found = F.lit(None).cast("string")
            for type_name, members in sorted(by_type.items()):
                found = F.when(name.isin(members), type_name).otherwise(found)
            return found

        known = [row["name"] for row in rows]
        hits = F.array_distinct(F.filter(grams, lambda g: g.isin(known)))
        typed = F.transform(hits, lambda g: F.struct(g.alias("name"), kind(g).alias("type")))
        return df.withColumn(out, typed.cast(NAMES_TYPE))

    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_digest")
    occurring = df.select(digest, F.posexplode(F.array_distinct(grams)).alias("_pos", "name")).distinct()
    limit = {} if max_broadcast is None else {"max_rows": max_broadcast}
    hits = lookup_join(occurring, names, ["name"], "inner", **limit)
    per_text = hits.groupBy("_digest").agg(
        F.sort_array(F.collect_list(F.struct("_pos", "name", "type"))).alias("_hits")
    )
    found = F.transform("_hits", lambda h: F.struct(h["name"].alias("name"), h["type"].alias("type")))
    return (
        df.withColumn("_digest", digest)
        .join(per_text, "_digest", "left")
        .withColumn(out, F.coalesce(found, F.array()).cast(NAMES_TYPE))
        .drop("_hits", "_digest")
    )


def anonymize(
    df: DataFrame, names: str = "names", text: str = "text", replacement: str = "[Customer]", in_order: bool = False
) -> DataFrame:
    """Replace every organization found in a text, everywhere in that text."""
    organizations = F.transform(F.filter(names, lambda n: n["type"] == "ORG"), lambda n: n["name"])
    replaced = let(organizations, lambda o: replace_names(F.col(text), o, replacement, in_order))
    return df.withColumn(text, F.when(F.size(names) > 0, replaced).otherwise(F.col(text)))
