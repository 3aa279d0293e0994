"""A library of works, editions and contributors made of the driver's orders: parts are works, order lines editions, suppliers contributors, customers users.

As in mapping.py both sides define each relation in the same words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.merging import MOVES, SUBJECTS
from ..operators.primitives import dealt, position, released, union_all
from .mapping import CTES, DriverCatalog


class Library:
    """What several tables are made of is written when it is first needed: lines, links, read states and favourites."""

    def __init__(self, c: DriverCatalog):
        self.c = c

    @cached_property
    def line(self) -> DataFrame:
        """(edition_id, work_id, contributor_id)"""
        lines = self.c.table("lineitem")
        keyed = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edition_id"), "l_partkey", "l_suppkey")
        return released(dealt(keyed, lines.count(), "edition_id").groupBy("edition_id").agg(F.min("l_partkey").alias("work_id"), F.min("l_suppkey").alias("contributor_id")), "lines")

    @cached_property
    def _rows(self) -> int:
        return self.line.count()

    @cached_property
    def _ordered(self) -> DataFrame:
        """The lines with their order's user and date."""
        orders = self.c.table("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("completed_at"))
        return dealt(self.line.withColumn("o_orderkey", F.expr("edition_id div 10")), self._rows, "o_orderkey").join(orders, "o_orderkey")

    @cached_property
    def read(self) -> DataFrame:
        """(user_id, work_id, completed_edition_id, completed_at)"""
        lines = dealt(self._ordered.select("user_id", "work_id", "edition_id", "completed_at"), self._rows, "user_id", "work_id").groupBy("user_id", "work_id")
        return released(lines.agg(F.when(F.col("user_id") % 2 == 0, F.min("edition_id")).alias("completed_edition_id"), F.min("completed_at").alias("completed_at")), "reads")

    @cached_property
    def link(self) -> DataFrame:
        """(work_id, contributor_id, role, ordinal)"""
        role = F.when(F.col("contributor_id") % 2 == 1, "AUTHOR").otherwise("EDITOR").alias("role")
        links = dealt(self.line.select("work_id", "contributor_id", role), self._rows, "work_id", "role").distinct()
        return released(links.select("*", position(["work_id", "role"], [F.col("contributor_id")]).alias("ordinal")), "links")

    @cached_property
    def favorite(self) -> DataFrame:
        """(user_id, contributor_id)"""
        return released(dealt(self._ordered.select("user_id", "contributor_id"), self._rows, "user_id", "contributor_id").distinct(), "favorites")

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in self._made}

    def of(self, subject_type: str) -> dict[str, DataFrame]:
        """The tables that merges of a type look at."""
        names = [SUBJECTS[subject_type][0], *(m.table for m in MOVES[subject_type]), "metadata_curated_override"]
        return {name: self.table(name) for name in names}

    def table(self, name: str) -> DataFrame:
        return self._made[name]()

    @cached_property
    def _made(self) -> dict[str, Callable[[], DataFrame]]:
        c = self.c
        one, none = F.lit(1).cast("bigint").alias("version"), F.lit(None).cast("bigint").alias("merged_into_id")
        edition = F.col("edition_id")
        supplier = c.table("supplier").select(F.col("s_suppkey").alias("contributor_id"), F.lower("s_name").alias("name"))

        def second() -> DataFrame:
            return self.line.where((edition % 2 == 0) & (F.col("contributor_id") != 1)).select("edition_id", F.lit(1).cast("bigint").alias("contributor_id"), F.lit("AUTHOR").alias("role"), F.lit(1).alias("ordinal"))

        def observed() -> DataFrame:
            parts = [("WORK", c.table("part"), "p_partkey"), ("EDITION", self.line.where(edition % 2 == 0), "edition_id"), ("CONTRIBUTOR", supplier, "contributor_id")]
            return union_all(*[df.select(F.lit(kind).alias("subject_type"), F.col(column).alias("subject_id")) for kind, df, column in parts])

        return {
            "work": lambda: c.table("part").select(F.col("p_partkey").alias("work_id"), one, none),
            "edition": lambda: self.line.select("edition_id", "work_id", one, none),
            "contributor": lambda: supplier.select("contributor_id", one, none),
            "asset": lambda: self.line.select("edition_id", F.explode(F.when(edition % 10 == 1, F.array(edition, -edition)).otherwise(F.array(edition))).alias("asset_id"), one),
            "work_contributor": lambda: self.link,
            "edition_contributor": lambda: self.line.select("edition_id", "contributor_id", F.lit("AUTHOR").alias("role"), F.lit(0).alias("ordinal")).unionByName(second()),
            "edition_identifier": lambda: self.line.select("edition_id", F.inline(F.array(
                F.struct(edition.alias("identifier_id"), F.lit("isbn").alias("scheme"), (edition % 3).cast("string").alias("observed_value")),
                F.struct((-edition).alias("identifier_id"), F.lit("asin").alias("scheme"), (edition % 2).cast("string").alias("observed_value")),
            ))),
            "work_tag": lambda: c.tag.select("work_id", F.col("name").alias("tag_id")),
            "user_work_read_state": lambda: self.read.select("*", one),
            "personal_collection_work": lambda: self.read.select(F.col("user_id").alias("collection_id"), "work_id", F.when(F.col("user_id") % 3 != 0, (F.col("work_id") % 50).cast("int")).alias("position"), F.col("completed_at").alias("added_at")),
            "cover_job": lambda: self.line.where(edition % 10 == 1).select(edition.alias("cover_job_id"), "work_id"),
            "cover_derivative": lambda: self.line.where(edition % 10 == 2).select(edition.alias("cover_id"), "work_id"),
            "work_cover_preference": lambda: self.line.where("work_id % 3 <> 0").groupBy("work_id").agg(F.min("edition_id").alias("source_asset_id")).select("*", F.lit(1).cast("bigint").alias("actor_user_id"), F.lit("r").alias("reason"), one, F.lit("2024-01-01").cast("date").alias("updated_at")),
            "contributor_alias": lambda: supplier.select("contributor_id", F.inline(F.array(F.struct((F.col("contributor_id") * 2).alias("alias_id"), F.lit("same").alias("normalized_alias")), F.struct((F.col("contributor_id") * 2 + 1).alias("alias_id"), F.col("name").alias("normalized_alias"))))),
            "user_contributor_favorite": lambda: self.favorite,
            "metadata_observation": lambda: observed(),
            "metadata_curated_override": lambda: c.table("labels").select(
                F.col("doc_id").alias("override_id"), F.lit("WORK").alias("subject_type"), F.col("doc_id").alias("subject_id"), F.lit("title").alias("field_name"), F.lit("PRESENT").alias("value_state"), F.col("quality").cast("string").alias("curated_value"),
                F.lit(1).alias("override_version"), F.lit(None).cast("bigint").alias("supersedes_override_id"), F.lit(None).cast("bigint").alias("undo_of_override_id"), F.lit(True).alias("active"),
            ),
        }

    def merges(self, subject_type: str) -> DataFrame:
        """(operation_id, survivor_id, source_id): every tenth work, and contributor, into the one before; of a work's editions the second into the first, the fourth into the third."""
        if subject_type == "EDITION":
            of_work = Window.partitionBy("work_id").orderBy("edition_id")
            nth = dealt(self.line.select("edition_id", "work_id"), self._rows, "work_id").where("work_id is not null")
            nth = nth.select(F.col("edition_id").alias("source_id"), F.lag("edition_id").over(of_work).alias("survivor_id"), position(["work_id"], [F.col("edition_id")]).alias("nth")).where("nth % 2 = 1")
            return nth.select(F.col("source_id").alias("operation_id"), "survivor_id", "source_id")
        name = {"WORK": "work", "CONTRIBUTOR": "contributor"}[subject_type]
        source = F.col(f"{name}_id")
        return self.table(name).where(source % 10 == 2).select(source.alias("operation_id"), (source - 1).alias("survivor_id"), source.alias("source_id"))


CTES |= {
    "lib_line": "SELECT l_orderkey * 10 + l_linenumber AS edition_id, min(l_partkey) AS work_id, min(l_suppkey) AS contributor_id FROM lineitem GROUP BY 1",
    "lib_read": """SELECT o_custkey AS user_id, work_id, CASE WHEN o_custkey % 2 = 0 THEN min(edition_id) END AS completed_edition_id, min(o_orderdate) AS completed_at
        FROM lib_line JOIN orders ON o_orderkey = edition_id // 10 GROUP BY 1, 2""",
    "lib_work_contributor": """SELECT *, CAST(row_number() OVER (PARTITION BY work_id, role ORDER BY contributor_id) - 1 AS INTEGER) AS ordinal FROM (
        SELECT DISTINCT work_id, contributor_id, CASE WHEN contributor_id % 2 = 1 THEN 'AUTHOR' ELSE 'EDITOR' END AS role FROM lib_line)""",
    "lib_edition_contributor": """SELECT edition_id, contributor_id, 'AUTHOR' AS role, 0 AS ordinal FROM lib_line
        UNION ALL SELECT edition_id, 1, 'AUTHOR', 1 FROM lib_line WHERE edition_id % 2 = 0 AND contributor_id <> 1""",
    "lib_identifier": "SELECT edition_id, edition_id AS id, 'isbn' AS scheme, CAST(edition_id % 3 AS VARCHAR) AS value FROM lib_line UNION ALL SELECT edition_id, -edition_id, 'asin', CAST(edition_id % 2 AS VARCHAR) FROM lib_line",
    "lib_collection": "SELECT user_id AS collection_id, work_id, CASE WHEN user_id % 3 <> 0 THEN CAST(work_id % 50 AS INTEGER) END AS position FROM lib_read",
    "lib_favorite": "SELECT DISTINCT o_custkey AS user_id, contributor_id FROM lib_line JOIN orders ON o_orderkey = edition_id // 10",
    "lib_preference": "SELECT work_id, min(edition_id) AS source_asset_id FROM lib_line WHERE work_id % 3 <> 0 GROUP BY 1",
    "lib_alias": "SELECT s_suppkey AS contributor_id, s_suppkey * 2 AS id, 'same' AS alias FROM supplier UNION ALL SELECT s_suppkey, s_suppkey * 2 + 1, lower(s_name) FROM supplier",
    "lib_edition_merge": """SELECT a.edition_id AS survivor_id, b.edition_id AS source_id FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY edition_id) AS nth FROM lib_line) a
        JOIN (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY edition_id) AS nth FROM lib_line) b ON a.work_id = b.work_id AND b.nth = a.nth + 1 AND a.nth % 2 = 1""",
    # what work 10k + 2 becomes, by relation
    "merged_work": """SELECT 'edition' AS relation, CASE WHEN work_id % 10 = 2 THEN work_id - 1 ELSE work_id END AS owner, CAST(edition_id AS VARCHAR) AS key, CAST(NULL AS INTEGER) AS place, CASE WHEN work_id % 10 = 2 THEN 2 ELSE 1 END AS version FROM lib_line
        UNION ALL SELECT 'work_contributor', CASE WHEN goes THEN work_id - 1 ELSE work_id END, contributor_id || ':' || role,
            CASE WHEN goes THEN coalesce((SELECT max(s.ordinal) + 1 FROM lib_work_contributor s WHERE s.work_id = l.work_id - 1 AND s.role = l.role), 0) + row_number() OVER (PARTITION BY work_id, role, goes ORDER BY ordinal) - 1 ELSE ordinal END, NULL
            FROM (SELECT *, work_id % 10 = 2 AND NOT EXISTS (SELECT 1 FROM lib_work_contributor s WHERE s.work_id = w.work_id - 1 AND s.contributor_id = w.contributor_id AND s.role = w.role) AS goes FROM lib_work_contributor w) l
        UNION ALL SELECT 'work_tag', CASE WHEN work_id % 10 = 2 AND NOT EXISTS (SELECT 1 FROM tag s WHERE s.work_id = t.work_id - 1 AND s.name = t.name) THEN work_id - 1 ELSE work_id END, name, NULL, NULL FROM tag t
        UNION ALL SELECT 'user_work_read_state', CASE WHEN work_id % 10 = 2 AND NOT EXISTS (SELECT 1 FROM lib_read s WHERE s.work_id = r.work_id - 1 AND s.user_id = r.user_id) THEN work_id - 1 ELSE work_id END, CAST(user_id AS VARCHAR), NULL, 1 FROM lib_read r
        UNION ALL SELECT 'personal_collection_work', CASE WHEN work_id % 10 = 2 AND NOT EXISTS (SELECT 1 FROM lib_collection s WHERE s.work_id = p.work_id - 1 AND s.collection_id = p.collection_id)
            AND (position IS NULL OR NOT EXISTS (SELECT 1 FROM lib_collection s WHERE s.collection_id = p.collection_id AND s.position = p.position AND s.work_id <> p.work_id)) THEN work_id - 1 ELSE work_id END, CAST(collection_id AS VARCHAR), position, NULL FROM lib_collection p
        UNION ALL SELECT 'cover_job', CASE WHEN work_id % 10 = 2 THEN work_id - 1 ELSE work_id END, CAST(edition_id AS VARCHAR), NULL, NULL FROM lib_line WHERE edition_id % 10 = 1
        UNION ALL SELECT 'cover_derivative', CASE WHEN work_id % 10 = 2 THEN work_id - 1 ELSE work_id END, CAST(edition_id AS VARCHAR), NULL, NULL FROM lib_line WHERE edition_id % 10 = 2
        UNION ALL SELECT 'work_cover_preference', CASE WHEN work_id % 10 = 2 AND NOT EXISTS (SELECT 1 FROM lib_preference s WHERE s.work_id = p.work_id - 1) THEN work_id - 1 ELSE work_id END, CAST(source_asset_id AS VARCHAR), NULL, 1 FROM lib_preference p
        UNION ALL SELECT 'work', p_partkey, CASE WHEN p_partkey % 10 = 2 THEN CAST(p_partkey - 1 AS VARCHAR) END, NULL, CASE WHEN p_partkey % 10 IN (1, 2) THEN 2 ELSE 1 END FROM part""",
    "merged_edition": """SELECT 'asset' AS relation, coalesce(survivor_id, edition_id) AS owner, CAST(asset_id AS VARCHAR) AS key, CAST(NULL AS INTEGER) AS place, CASE WHEN survivor_id IS NULL THEN 1 ELSE 2 END AS version
            FROM (SELECT edition_id, edition_id AS asset_id FROM lib_line UNION ALL SELECT edition_id, -edition_id FROM lib_line WHERE edition_id % 10 = 1) LEFT JOIN lib_edition_merge ON source_id = edition_id
        UNION ALL SELECT 'edition_contributor', CASE WHEN goes THEN survivor_id ELSE edition_id END, contributor_id || ':' || role,
            CASE WHEN goes THEN (SELECT max(s.ordinal) + 1 FROM lib_edition_contributor s WHERE s.edition_id = l.survivor_id AND s.role = l.role) + row_number() OVER (PARTITION BY edition_id, role, goes ORDER BY ordinal) - 1 ELSE ordinal END, NULL
            FROM (SELECT e.*, survivor_id, survivor_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lib_edition_contributor s WHERE s.edition_id = survivor_id AND s.contributor_id = e.contributor_id AND s.role = e.role) AS goes
                FROM lib_edition_contributor e LEFT JOIN lib_edition_merge ON source_id = edition_id) l
        UNION ALL SELECT 'edition_identifier', CASE WHEN survivor_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lib_identifier s WHERE s.edition_id = survivor_id AND s.scheme = i.scheme AND s.value = i.value) THEN survivor_id ELSE edition_id END, CAST(id AS VARCHAR), NULL, NULL
            FROM lib_identifier i LEFT JOIN lib_edition_merge ON source_id = edition_id
        UNION ALL SELECT 'user_work_read_state', coalesce(survivor_id, completed_edition_id), user_id || ':' || work_id, NULL, 1 FROM lib_read LEFT JOIN lib_edition_merge ON source_id = completed_edition_id
        UNION ALL SELECT 'edition', edition_id, CAST(m.survivor_id AS VARCHAR), NULL, CASE WHEN m.survivor_id IS NOT NULL OR s.source_id IS NOT NULL THEN 2 ELSE 1 END
            FROM lib_line LEFT JOIN lib_edition_merge m ON m.source_id = edition_id LEFT JOIN lib_edition_merge s ON s.survivor_id = edition_id""",
    "merged_contributor": """SELECT 'contributor_alias' AS relation, CASE WHEN contributor_id % 10 = 2 AND NOT EXISTS (SELECT 1 FROM lib_alias s WHERE s.contributor_id = a.contributor_id - 1 AND s.alias = a.alias) THEN contributor_id - 1 ELSE contributor_id END AS owner, CAST(id AS VARCHAR) AS key, CAST(NULL AS INTEGER) AS place, CAST(NULL AS BIGINT) AS version FROM lib_alias a
        UNION ALL SELECT 'work_contributor', CASE WHEN goes THEN contributor_id - 1 ELSE contributor_id END, work_id || ':' || role,
            CASE WHEN goes THEN (SELECT max(s.ordinal) FROM lib_work_contributor s WHERE s.work_id = l.work_id AND s.role = l.role) + row_number() OVER (PARTITION BY work_id, role, goes ORDER BY contributor_id) ELSE ordinal END, NULL
            FROM (SELECT *, contributor_id % 10 = 2 AND NOT EXISTS (SELECT 1 FROM lib_work_contributor s WHERE s.work_id = w.work_id AND s.contributor_id = w.contributor_id - 1 AND s.role = w.role) AS goes FROM lib_work_contributor w) l
        UNION ALL SELECT 'edition_contributor', CASE WHEN goes THEN contributor_id - 1 ELSE contributor_id END, edition_id || ':' || role,
            CASE WHEN goes THEN (SELECT max(s.ordinal) FROM lib_edition_contributor s WHERE s.edition_id = l.edition_id AND s.role = l.role) + row_number() OVER (PARTITION BY edition_id, role, goes ORDER BY contributor_id) ELSE ordinal END, NULL
            FROM (SELECT *, contributor_id % 10 = 2 AND NOT EXISTS (SELECT 1 FROM lib_edition_contributor s WHERE s.edition_id = e.edition_id AND s.contributor_id = e.contributor_id - 1 AND s.role = e.role) AS goes FROM lib_edition_contributor e) l
        UNION ALL SELECT 'user_contributor_favorite', CASE WHEN contributor_id % 10 = 2 AND NOT EXISTS (SELECT 1 FROM lib_favorite s WHERE s.user_id = f.user_id AND s.contributor_id = f.contributor_id - 1) THEN contributor_id - 1 ELSE contributor_id END, CAST(user_id AS VARCHAR), NULL, NULL FROM lib_favorite f
        UNION ALL SELECT 'contributor', s_suppkey, CASE WHEN s_suppkey % 10 = 2 THEN CAST(s_suppkey - 1 AS VARCHAR) END, NULL, CASE WHEN s_suppkey % 10 IN (1, 2) THEN 2 ELSE 1 END FROM supplier""",
}


def listed(tables: dict[str, DataFrame], subject_type: str) -> DataFrame:
    """(relation, owner, key, place, version) of all rows that name subjects of a type, and of the subjects, whose key is what they were merged into."""
    parts = []
    for m in MOVES[subject_type]:
        df = tables[m.table]
        place = next((F.col(c).cast("int") for c in ("ordinal", "position") if c in df.columns), F.lit(None).cast("int"))
        version = F.col("version").cast("long") if "version" in df.columns else F.lit(None).cast("long")
        parts.append(df.select(F.lit(m.table).alias("relation"), F.col(m.owner).alias("owner"), F.concat_ws(":", *(F.col(k).cast("string") for k in m.key)).alias("key"), place.alias("place"), version.alias("version")))
    table, own = SUBJECTS[subject_type]
    subjects = tables[table].select(F.lit(table).alias("relation"), F.col(own).alias("owner"), F.col("merged_into_id").cast("string").alias("key"), F.lit(None).cast("int").alias("place"), F.col("version").cast("long").alias("version"))
    return union_all(*parts, subjects)


#: listed() of tables that a merge and its undo have gone over.
CTES |= {
    "undone_work": """SELECT 'edition' AS relation, work_id AS owner, CAST(edition_id AS VARCHAR) AS key, CAST(NULL AS INTEGER) AS place, CASE WHEN work_id % 10 = 2 THEN 3 ELSE 1 END AS version FROM lib_line
        UNION ALL SELECT 'work_contributor', work_id, contributor_id || ':' || role, ordinal, NULL FROM lib_work_contributor UNION ALL SELECT 'work_tag', work_id, name, NULL, NULL FROM tag
        UNION ALL SELECT 'user_work_read_state', work_id, CAST(user_id AS VARCHAR), NULL, 1 FROM lib_read UNION ALL SELECT 'personal_collection_work', work_id, CAST(collection_id AS VARCHAR), position, NULL FROM lib_collection
        UNION ALL SELECT 'cover_job', work_id, CAST(edition_id AS VARCHAR), NULL, NULL FROM lib_line WHERE edition_id % 10 = 1 UNION ALL SELECT 'cover_derivative', work_id, CAST(edition_id AS VARCHAR), NULL, NULL FROM lib_line WHERE edition_id % 10 = 2
        UNION ALL SELECT 'work_cover_preference', work_id, CAST(source_asset_id AS VARCHAR), NULL, 1 FROM lib_preference UNION ALL SELECT 'work', p_partkey, NULL, NULL, 1 FROM part""",
    "undone_edition": """SELECT 'asset' AS relation, edition_id AS owner, CAST(asset_id AS VARCHAR) AS key, CAST(NULL AS INTEGER) AS place, CASE WHEN edition_id IN (SELECT source_id FROM lib_edition_merge) THEN 2 ELSE 1 END AS version
            FROM (SELECT edition_id, edition_id AS asset_id FROM lib_line UNION ALL SELECT edition_id, -edition_id FROM lib_line WHERE edition_id % 10 = 1)
        UNION ALL SELECT 'edition_contributor', edition_id, contributor_id || ':' || role, ordinal, NULL FROM lib_edition_contributor UNION ALL SELECT 'edition_identifier', edition_id, CAST(id AS VARCHAR), NULL, NULL FROM lib_identifier
        UNION ALL SELECT 'user_work_read_state', completed_edition_id, user_id || ':' || work_id, NULL, 1 FROM lib_read UNION ALL SELECT 'edition', edition_id, NULL, NULL, 1 FROM lib_line""",
    "undone_contributor": """SELECT 'contributor_alias' AS relation, contributor_id AS owner, CAST(id AS VARCHAR) AS key, CAST(NULL AS INTEGER) AS place, CAST(NULL AS BIGINT) AS version FROM lib_alias
        UNION ALL SELECT 'work_contributor', contributor_id, work_id || ':' || role, ordinal, NULL FROM lib_work_contributor UNION ALL SELECT 'edition_contributor', contributor_id, edition_id || ':' || role, ordinal, NULL FROM lib_edition_contributor
        UNION ALL SELECT 'user_contributor_favorite', contributor_id, CAST(user_id AS VARCHAR), NULL, NULL FROM lib_favorite UNION ALL SELECT 'contributor', s_suppkey, NULL, NULL, 1 FROM supplier""",
}
