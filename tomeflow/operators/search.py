"""Catalog search: what matches, what may be seen, and one page of it with its nested details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import title_from_path
from .primitives import offset_page, ordered_collect, text_contains, union_all

MOST_QUERY = 200


def matching_works(query: str, titles: DataFrame, locations: DataFrame, contributors: DataFrame, identifiers: DataFrame, tags: DataFrame, denied_roots: DataFrame | None = None) -> DataFrame:
    """(work_id) that match in any of five ways: display title, path, observed contributor, identifier key or value, tag.

    Each relation has work_id and the texts it is searched by; the arms are a union, so each is one filtered scan.
    titles: the titles shown, provisional where there is no other. locations and contributors have the root_id they come
    from; denied_roots (root_id): what the user may not see, so that no work is found by it. None: an unrestricted user.
    """
    if len(query) > MOST_QUERY:
        raise ValueError(f"a query has at most {MOST_QUERY} characters")
    if denied_roots is not None:
        locations, contributors = (df.join(denied_roots.select("root_id"), "root_id", "left_anti") for df in (locations, contributors))
    arms = [
        titles.where(text_contains(F.col("title"), query)),
        locations.where(text_contains(F.col("path"), query)),
        contributors.where(text_contains(F.col("value"), query)),
        identifiers.where(text_contains(F.col("key"), query) | text_contains(F.col("value"), query)),
        tags.where(text_contains(F.col("name"), query)),
    ]
    return union_all(*[a.select("work_id") for a in arms]).distinct()


def display_titles(works: DataFrame, display: DataFrame) -> DataFrame:
    """works with title and provisional: the display value, or the provisional title. A conflict counts as a value for `provisional`, as it outranks observations."""
    titles = display.where("subject_type = 'WORK' and field = 'title'").select(F.col("subject_id").alias("_id"), F.col("value").alias("_value"))
    joined = works.join(titles, F.col("work_id").cast("string") == F.col("_id"), "left")
    return joined.withColumn("title", F.coalesce("_value", "provisional_title")).withColumn("provisional", F.col("_id").isNull()).drop("_id", "_value")


def provisional_title(path: str = "path"):
    return title_from_path(F.col(path))


def search(works: DataFrame, visible: DataFrame, matches: DataFrame, page: int, size: int, contributors: DataFrame, assets: DataFrame) -> DataFrame:
    """One page of visible matching works, by title and id, with their contributors and assets in order.

    works: work_id, title, provisional. Details are gathered for the page's works only.
    """
    hits = works.join(visible.select("work_id"), "work_id", "left_semi").join(matches, "work_id", "left_semi")
    chosen = offset_page(hits, [F.col("title").asc_nulls_last(), F.col("work_id")], page, size)
    people = contributors.join(chosen.select("work_id"), "work_id", "left_semi").groupBy("work_id").agg(ordered_collect(["ordinal", "contributor_id"], ["contributor_id", "role", "ordinal"]).alias("contributors"))
    files = assets.join(chosen.select("work_id"), "work_id", "left_semi").groupBy("work_id").agg(ordered_collect(["asset_id"], ["asset_id", "format", "byte_size"]).alias("assets"))
    return chosen.join(people, "work_id", "left").join(files, "work_id", "left")


def total(works: DataFrame, visible: DataFrame, matches: DataFrame) -> DataFrame:
    """(total) of what search() pages through; the visibility filter stands below the count."""
    return works.join(visible.select("work_id"), "work_id", "left_semi").join(matches, "work_id", "left_semi").agg(F.count("*").alias("total"))


def work_availability(assets: DataFrame, locations: DataFrame) -> DataFrame:
    return locations.join(assets, "asset_id").groupBy("work_id", "edition_id", "asset_id", "format", "byte_size", "derivation", "content_hash").agg(F.bool_or(F.col("availability") == "AVAILABLE").alias("available"))
