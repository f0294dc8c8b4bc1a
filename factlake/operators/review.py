"""Evidence sets for reviews: the units that hold the passages a review cites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators.joins import name_words
from factlake.operators.packing import fold_in_order


def evidence_units(catalog: DataFrame) -> DataFrame:
    """(unit, precedence, at, words): each unit of a catalog of (evidence_id, unit, precedence, at, content) with its best precedence, first place and distinct words."""
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list(name_words(F.coalesce("content", F.lit("")))))))
    return catalog.groupBy("unit").agg(F.min("precedence").alias("precedence"), F.min("at").alias("at"), words.alias("words"))


def seeded_units(seeds: DataFrame, catalog: DataFrame) -> DataFrame:
    """(review, unit, seeds): the units that hold seeds of a review, with their ids in order; ids that the catalog lacks are under the null unit."""
    wanted = seeds.select("review", "evidence_id").where("review is not null and evidence_id is not null").distinct()
    return wanted.join(catalog.select("evidence_id", "unit").where("unit is not null").groupBy("evidence_id").agg(F.min("unit").alias("unit")), "evidence_id", "left").groupBy("review", "unit").agg(F.array_sort(F.collect_list("evidence_id")).alias("seeds"))


def without_near_copies(ranked: DataFrame, keys: list[str], order: list, most: int, least: float = 0.8) -> DataFrame:
    """(keys, unit, place): the first ``most`` rows of each key in order, without those whose words repeat those of a row kept before.

    Two rows repeat each other where the Jaccard of their word sets reaches ``least``; a row without
    words repeats none. Rows of a key are streamed, only the kept words are held.
    """
    kinds = dict(ranked.dtypes)
    at, words, unit = [ranked.columns.index(k) for k in keys], ranked.columns.index("words"), ranked.columns.index("unit")

    def step(kept, row):
        kept = kept or []
        mine = set(row[words])
        if len(kept) == most or mine and any(len(mine & k) >= least * len(mine | k) - 1e-9 for k in kept):
            return kept, []
        kept.append(mine)
        return kept, [(*(row[k] for k in at), row[unit], len(kept))]

    return fold_in_order(ranked, keys, order, step, None, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"unit {kinds['unit']}", "place int"]))


def review_evidence(seeds: DataFrame, catalog: DataFrame, most: int = 2, least: float = 0.8) -> DataFrame:
    """(review, units, unknown_ids) for every review that cites anything.

    ``units`` are (place, unit, seeds): the units that hold most of a review's passages come first,
    then those of the better precedence, then in reading order; near copies count once and ``most``
    are shown. Cited ids that the catalog lacks are kept apart. Repeated citations count once, null
    ids and reviews are left out, an id that stands in several units counts for the least, and catalog
    rows without a unit are as if they were missing.
    """
    seeded = seeded_units(seeds, catalog)
    ranked = seeded.where("unit is not null").select("review", "unit", F.size("seeds").alias("n")).join(evidence_units(catalog), "unit")
    kept = without_near_copies(ranked.select("review", "unit", "n", "precedence", "at", "words"), ["review"], [F.desc("n"), F.asc("precedence"), F.asc("at"), F.asc("unit")], most, least)
    placed = kept.join(seeded, ["review", "unit"])
    shown = placed.groupBy("review").agg(F.array_sort(F.collect_list(F.struct("place", "unit", "seeds"))).alias("units"))
    unknown = seeded.where("unit is null").select("review", F.col("seeds").alias("unknown_ids"))
    return shown.join(unknown, "review", "full_outer")
