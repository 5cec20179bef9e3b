"""Tags from a model's answers, one answer text per image.

The counts of an answer are merged within its own row, so this step never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailtally.functions.tags import answer_counts, count_text, tag_json
from trailtally.functions.text import capitalize_first, normalise_animal

# Animals counted under another name.
MERGED_ANIMALS = {"buck": "deer"}


def _as_tags(rows: DataFrame) -> DataFrame:
    return rows.select(
        "image_id",
        "type",
        "name",
        "count",
        "display",
        tag_json(F.col("type"), F.col("name"), F.col("count_text"), F.col("display")).alias("tag_json"),
    )


def _merged_name(animal: Column) -> Column:
    name = normalise_animal(animal)
    merged = F.create_map(*[F.lit(x) for pair in MERGED_ANIMALS.items() for x in pair])
    return F.coalesce(F.try_element_at(merged, name), name)


def tag_counts_from_analysis(answers: DataFrame) -> DataFrame:
    """Animal tags (image_id, type, name, count, display, tag_json) of answers (image_id, answer).

    Names lose their plural ``s``, counts of one animal are added up, and bucks are deer.
    Answers that are not a JSON object of counts give no rows.
    """
    entries = F.transform(
        answer_counts(F.col("answer")),
        lambda e: F.struct(
            _merged_name(e["animal"]).alias("name"), e["n"].alias("n"), e["exact"].alias("exact")
        ),
    )

    def merge(name: Column) -> Column:
        own = F.filter(F.col("entries"), lambda e: e["name"] == name)
        return F.struct(
            name.alias("name"),
            F.aggregate(own, F.lit(0.0), lambda total, e: total + e["n"]).alias("count"),
            # NULL as soon as one of the counts is a fraction.
            F.aggregate(
                own, F.lit(0).cast("decimal(38,0)"), lambda total, e: (total + e["exact"]).cast("decimal(38,0)")
            ).alias("exact"),
        )

    names = F.array_distinct(F.transform("entries", lambda e: e["name"]))
    merged = answers.select("image_id", entries.alias("entries")).select(
        "image_id", F.inline(F.transform(names, merge))
    )
    number = count_text(F.col("count"), F.col("exact"))
    return _as_tags(merged.select(
        "image_id",
        F.lit("animal").alias("type"),
        "name",
        "count",
        number.alias("count_text"),
        F.concat(capitalize_first(F.col("name")), F.lit(" "), number).alias("display"),
    ))


def tags_unmerged(answers: DataFrame) -> DataFrame:
    """Variant rule: one tag per entry, display as answered, and a ``buck`` tag beside each deer."""
    entries = answers.select("image_id", F.inline(answer_counts(F.col("answer"))))
    number = count_text(F.col("n"), F.col("exact"))
    name = F.lower("animal")

    def tag(tag_name: Column, count: Column, text: Column, display: Column) -> Column:
        return F.struct(
            F.lit("animal").alias("type"),
            tag_name.alias("name"),
            count.alias("count"),
            text.alias("count_text"),
            display.alias("display"),
        )

    own = tag(name, F.col("n"), number, F.concat(F.col("animal"), F.lit(" "), number))
    buck = tag(F.lit("buck"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit("Buck"))
    both = F.when(name == "deer", F.array(own, buck)).otherwise(F.array(own))
    return _as_tags(entries.select("image_id", F.inline(both)))
