"""Visibility. Each rule is a relation computed once for all users that are asked about, never a call per row.

denies: (user_id, root_id). locations: (asset_id, root_id, availability). assets: (asset_id, edition_id, work_id,
format). edges: (child, parent) of derivation; lineage: their closure (start, ancestor). users: (user_id).

Users meet roots, which are few, and then what stands on the roots that they may see, by equi-joins; denied lineage is
subtracted. users None asks for an unrestricted caller, who sees all: no deny is looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .primitives import closure, union_all


def lineage(edges: DataFrame) -> DataFrame:
    return closure(edges, "child", "parent")


def _denied_assets(locations: DataFrame, denies: DataFrame) -> DataFrame:
    """(user_id, asset_id): assets with any location on a root denied to the user."""
    return locations.select("asset_id", "root_id").distinct().join(denies, "root_id").select("user_id", "asset_id").distinct()


def denied_by_lineage(locations: DataFrame, denies: DataFrame, closed: DataFrame) -> DataFrame:
    """(user_id, asset_id): assets that derive from an asset on a denied root."""
    return closed.join(_denied_assets(locations, denies), F.col("ancestor") == F.col("asset_id")).select("user_id", F.col("start").alias("asset_id")).distinct()


def _on_allowed_roots(users: DataFrame, placed: DataFrame, denies: DataFrame, root: str = "root_id") -> DataFrame:
    """placed for each user who isn't denied its root. Placed without a root are seen by all."""
    roots = placed.select(F.col(root).alias("root_id")).distinct()
    allowed = accessible_roots(users, roots, denies).withColumnRenamed("root_id", "_root")
    return placed.join(allowed, F.col(root).eqNullSafe(F.col("_root"))).drop("_root")


def visible_assets(users: DataFrame | None, assets: DataFrame, locations: DataFrame, denies: DataFrame, closed: DataFrame, formats: list[str] | None = None, available: bool = True) -> DataFrame:
    """(user_id, asset_id, work_id): a location on a root that isn't denied, and no denied ancestor. Without users: (asset_id, work_id)."""
    places = locations.where("availability = 'AVAILABLE'") if available else locations
    wanted = assets.where(F.col("format").isin(*formats)) if formats else assets
    places = places.select("asset_id", "root_id").distinct().join(wanted.select("asset_id", "work_id"), "asset_id")
    if users is None:
        return places.select("asset_id", "work_id").distinct()
    return _on_allowed_roots(users, places, denies).select("user_id", "asset_id", "work_id").distinct().join(denied_by_lineage(locations, denies, closed), ["user_id", "asset_id"], "left_anti")


def visible_works(users: DataFrame | None, works: DataFrame, assets: DataFrame, locations: DataFrame, denies: DataFrame, closed: DataFrame, formats: list[str] | None = None, unmerged: bool = True) -> DataFrame:
    """(user_id, work_id). Catalog search asks for unmerged works and formats, personal lists for neither."""
    found = visible_assets(users, assets, locations, denies, closed, formats).drop("asset_id").distinct()
    return found.join(works.where("merged_into_id is null").select("work_id"), "work_id", "left_semi") if unmerged else found


def visible_requests(requests: DataFrame, assets: DataFrame, locations: DataFrame, denies: DataFrame, closed: DataFrame) -> DataFrame:
    """The requests (user_id, work_id), each once, whose work the user sees, merged or not: visible_works() for these pairs only.

    Starts from the requests, so what is joined grows with them and not with users times works.
    """
    asked = requests.select("user_id", "work_id").distinct().join(assets.select("work_id", "asset_id"), "work_id")
    placed = asked.join(locations.where("availability = 'AVAILABLE'").select("asset_id", "root_id").distinct(), "asset_id")
    allowed = placed.join(denies.select("user_id", "root_id"), ["user_id", "root_id"], "left_anti").select("user_id", "work_id", "asset_id").distinct()
    above = allowed.join(closed.select(F.col("start").alias("asset_id"), "ancestor"), "asset_id").select("user_id", "asset_id", "ancestor")
    roots = locations.select(F.col("asset_id").alias("ancestor"), "root_id").distinct()
    denied = above.join(roots, "ancestor").join(denies.select("user_id", "root_id"), ["user_id", "root_id"], "left_semi").select("user_id", "asset_id").distinct()
    return allowed.join(denied, ["user_id", "asset_id"], "left_anti").select("user_id", "work_id").distinct()


def curation_visible(users: DataFrame, assets: DataFrame, works: DataFrame, links: DataFrame, locations: DataFrame, denies: DataFrame, closed: DataFrame) -> DataFrame:
    """(user_id, subject_type, subject_id) of works, editions, assets and contributors that a user may curate."""
    seen = visible_assets(users, assets, locations, denies, closed)
    with_edition = seen.join(assets.select("asset_id", "edition_id"), "asset_id")
    of_work = seen.select("user_id", "work_id").distinct()

    def part(kind: str, df: DataFrame, column: str) -> DataFrame:
        return df.select("user_id", F.lit(kind).alias("subject_type"), F.col(column).cast("string").alias("subject_id")).distinct()

    return union_all(
        part("WORK", of_work.join(works.where("merged_into_id is null").select("work_id"), "work_id", "left_semi"), "work_id"),
        part("EDITION", with_edition, "edition_id"),
        part("ASSET", seen, "asset_id"),
        part("CONTRIBUTOR", of_work.join(links.select("work_id", "contributor_id"), "work_id"), "contributor_id"),
    )


def recovery_visible(users: DataFrame, assets: DataFrame, locations: DataFrame, denies: DataFrame) -> DataFrame:
    """(user_id, work_id): stricter: an available location, and none of the work's assets anywhere on a denied root; lineage doesn't count.

    The result has a row for each user and work, but for the denied; what is denied is found by the roots.
    """
    of_work = locations.join(assets.select("asset_id", "work_id"), "asset_id").groupBy("work_id", "root_id").agg(F.bool_or(F.col("availability") == "AVAILABLE").alias("available"))
    works = of_work.groupBy("work_id").agg(F.bool_or("available").alias("available")).where("available").select("work_id")
    denied = of_work.join(denies, "root_id").select("user_id", "work_id").distinct()
    return users.crossJoin(works).join(denied, ["user_id", "work_id"], "left_anti")


def content_locations(users: DataFrame, assets: DataFrame, locations: DataFrame, denies: DataFrame, closed: DataFrame) -> DataFrame:
    """(user_id, asset_id, root_id, path, availability): where to read an asset from: available places first, then by path."""
    from .primitives import first_per_group

    allowed = _on_allowed_roots(users, locations.select("asset_id", "root_id", "path", "availability"), denies)
    allowed = allowed.join(denied_by_lineage(locations, denies, closed), ["user_id", "asset_id"], "left_anti")
    return first_per_group(allowed, ["user_id", "asset_id"], [(F.col("availability") != "AVAILABLE").cast("int"), F.col("path")])


def cover_visible(users: DataFrame, covers: DataFrame, locations: DataFrame, denies: DataFrame, closed: DataFrame) -> DataFrame:
    """(user_id, cover_id): covers (cover_id, source_asset_id, managed_root_id) on a root that isn't denied, whose source isn't denied itself nor by lineage."""
    reflexive = closed.unionByName(covers.select(F.col("source_asset_id").alias("start"), F.col("source_asset_id").alias("ancestor"))).distinct()
    bad = denied_by_lineage(locations, denies, reflexive)
    return (
        _on_allowed_roots(users, covers, denies, "managed_root_id")
        .join(bad.select(F.col("user_id").alias("_u"), F.col("asset_id").alias("_a")), (F.col("user_id") == F.col("_u")) & (F.col("source_asset_id") == F.col("_a")), "left_anti")
        .select("user_id", "cover_id")
    )


def conversion_visible(users: DataFrame, jobs: DataFrame, denies: DataFrame) -> DataFrame:
    """(user_id, job_id): jobs (job_id, source_root_id, output_root_id) of which neither root is denied."""
    on_source = _on_allowed_roots(users, jobs, denies, "source_root_id")
    return on_source.join(denies.select("user_id", F.col("root_id").alias("output_root_id")), ["user_id", "output_root_id"], "left_anti").select("user_id", "job_id")


def accessible_roots(users: DataFrame, roots: DataFrame, denies: DataFrame) -> DataFrame:
    return users.crossJoin(roots.select("root_id")).join(denies, ["user_id", "root_id"], "left_anti")
