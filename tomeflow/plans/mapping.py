"""The driver's tables seen as a catalog: once as DataFrames, once as DuckDB CTEs for the oracle.

Integers stand for ids. Dates are constants. Both sides define each relation in the same words.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.authz import lineage
from ..operators.primitives import dealt, position
from ..schemas import FORMATS

T1, T2, T3 = "2026-01-01 00:00:00", "2026-01-02 00:00:00", "2026-01-03 00:00:00"


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp")


class DriverCatalog:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def asset(self) -> DataFrame:
        i = F.col("doc_id")
        return self.documents.select(
            i.alias("asset_id"),
            F.expr("doc_id div 2").alias("edition_id"),
            F.expr("doc_id div 4").alias("work_id"),
            F.element_at(F.array(*map(F.lit, FORMATS)), (i % 6 + 1).cast("int")).alias("format"),
            F.col("n_chars").alias("byte_size"),
            F.when((i % 8).isin(3, 6, 7), "DERIVED").otherwise("ORIGINAL").alias("derivation"),
        )

    @cached_property
    def asset_with_hash(self) -> DataFrame:
        return self.asset.join(self.documents.select(F.col("doc_id").alias("asset_id"), F.sha2("text", 256).alias("content_hash")), "asset_id")

    @cached_property
    def location(self) -> DataFrame:
        i = F.col("doc_id")
        return self.documents.select(
            i.alias("asset_id"),
            F.col("source").alias("root_id"),
            F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), i.cast("string"), F.lit(".txt")).alias("path"),
            F.when(i % 11 == 0, "MISSING").when(i % 11 == 1, "UNAVAILABLE").otherwise("AVAILABLE").alias("availability"),
            F.col("n_chars").alias("byte_size"),
        )

    @cached_property
    def edge(self) -> DataFrame:
        i = F.col("doc_id")
        return self.documents.where((i % 8).isin(3, 6, 7)).select(i.alias("child"), (i - F.when(i % 8 == 6, 2).otherwise(1)).alias("parent"))

    @cached_property
    def lineage(self) -> DataFrame:
        return lineage(self.edge)

    @cached_property
    def root(self) -> DataFrame:
        return self.documents.select(F.col("source").alias("root_id")).distinct()

    @cached_property
    def users(self) -> DataFrame:
        return self.spark.range(10).withColumnRenamed("id", "user_id")

    @cached_property
    def deny(self) -> DataFrame:
        customers = self.table("customer").where(F.col("c_custkey").between(1, 9)).select(F.col("c_custkey").alias("user_id"))
        number = F.substring("root_id", 4, 10).cast("bigint")
        return customers.join(self.root, (F.col("user_id") * 7 + number) % 5 == 0)

    @cached_property
    def work(self) -> DataFrame:
        first = self.asset.groupBy("work_id").agg(F.min("asset_id").alias("first"))
        return first.select(
            "work_id",
            F.concat(F.lit("doc-"), F.col("first").cast("string"), F.lit(".txt")).alias("provisional_title"),
            F.when(F.col("work_id") % 10 == 9, F.col("work_id") - 1).alias("merged_into_id"),
            F.lit(1).cast("bigint").alias("version"),
        )

    @cached_property
    def title_observation(self) -> DataFrame:
        i = F.col("doc_id")
        line = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60)
        again = F.when(i % 7 == 0, F.concat(line, F.lit(" II"))).when(i % 5 == 0, F.concat(line, F.lit("  ")))
        sets = F.array_compact(
            F.array(
                F.struct(line.alias("value"), F.concat(F.lit("t1-"), i.cast("string")).alias("observation_id"), at(T1).alias("observed_at")),
                F.when(again.isNotNull(), F.struct(again.alias("value"), F.concat(F.lit("t2-"), i.cast("string")).alias("observation_id"), at(T2).alias("observed_at"))),
            )
        )
        return self.documents.select(F.lit("ASSET").alias("subject_type"), i.alias("subject_id"), F.lit("title").alias("field"), F.inline(sets)).withColumn("state", F.lit("PRESENT"))

    @cached_property
    def language_observation(self) -> DataFrame:
        i = F.col("doc_id")
        return self.documents.select(
            F.lit("WORK").alias("subject_type"),
            F.expr("doc_id div 4").alias("subject_id"),
            F.lit("language").alias("field"),
            F.when(i % 13 == 0, "English").otherwise(F.col("lang")).alias("value"),
            F.concat(F.lit("l-"), i.cast("string")).alias("observation_id"),
            at(T1).alias("observed_at"),
            F.lit("PRESENT").alias("state"),
        )

    @cached_property
    def isbn_observation(self) -> DataFrame:
        i = F.col("doc_id")
        body = F.concat(F.lit("978"), F.lpad(i.cast("string"), 9, "0"))

        def with_digit(code):
            total = F.aggregate(F.zip_with(F.split(code, ""), F.array(*[F.lit(w) for w in [1, 3] * 6]), lambda d, w: d.cast("int") * w), F.lit(0), lambda t, v: t + v)
            return F.concat(code, ((10 - total % 10 + F.when(i % 3 == 0, 1).otherwise(0)) % 10).cast("string"))

        return self.documents.select(
            F.lit("ASSET").alias("subject_type"),
            i.alias("subject_id"),
            F.lit("identifier:isbn13").alias("field"),
            F.get(F.transform(F.array(body), with_digit), F.lit(0)).alias("value"),
            F.concat(F.lit("i-"), i.cast("string")).alias("observation_id"),
            at(T1).alias("observed_at"),
            F.lit("PRESENT").alias("state"),
        )

    @cached_property
    def observation(self) -> DataFrame:
        return self.title_observation.unionByName(self.language_observation).unionByName(self.isbn_observation)

    @cached_property
    def override(self) -> DataFrame:
        labels = self.table("labels").where("toxic = 1 or quality = 1")
        present = F.col("toxic") != 1
        return labels.select(
            F.lit("ASSET").alias("subject_type"),
            F.col("doc_id").alias("subject_id"),
            F.lit("title").alias("field"),
            F.when(present, "PRESENT").otherwise("ABSENT").alias("state"),
            F.when(present, F.concat(F.lit("Curated "), F.col("doc_id").cast("string"))).alias("value"),
            F.lit(1).cast("bigint").alias("version"),
            F.lit(True).alias("active"),
            at(T3).alias("decided_at"),
        )

    @cached_property
    def contributor(self) -> DataFrame:
        """(work_id, contributor_id, ordinal) from parts and their suppliers."""
        lines = self.table("lineitem")
        named = lines.select(F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("contributor_id"), "l_linenumber")
        pairs = dealt(named, lines.count(), "work_id").groupBy("work_id", "contributor_id").agg(F.min("l_linenumber").alias("line"))
        return pairs.select("work_id", "contributor_id", position(["work_id"], [F.col("line"), F.col("contributor_id")]).cast("bigint").alias("ordinal"))

    @cached_property
    def tag(self) -> DataFrame:
        part = self.table("part")
        return part.select(F.col("p_partkey").alias("work_id"), F.explode(F.array("p_type", "p_brand")).alias("name"))

    @cached_property
    def outcome(self) -> DataFrame:
        """(job_id, path, state, at, sequence) from events."""
        state = F.when(F.col("event_type") == "click", "PROCESSED").when(F.col("event_type") == "purchase", "SKIPPED").when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "DEFERRED").otherwise("DISCOVERED")
        return self.table("events").select(F.col("user_id").alias("job_id"), F.col("props").alias("path"), state.alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("sequence"))

    @cached_property
    def task(self) -> DataFrame:
        state = F.when(F.col("event_type") == "view", "QUEUED").when(F.col("event_type") == "signup", "RUNNING").when(F.col("event_type") == "purchase", "SUCCEEDED").when(F.col("event_type") == "error", "FAILED").otherwise("CANCELLED")
        return self.table("events").select(
            F.col("event_id").alias("task_id"),
            (F.col("user_id") % 5).alias("root_id"),
            F.col("user_id").alias("job_id"),
            F.col("props").alias("path"),
            state.alias("state"),
            (F.col("event_id") % 4).alias("attempts"),
            (F.col("ts") + F.expr("interval 1 minute")).alias("lease_until"),
            F.col("event_id").alias("sequence"),
        )

    @cached_property
    def turn(self) -> DataFrame:
        """Edges from each conversation turn to the one before."""
        turns = self.table("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("child"), "turn").where("turn > 0")
        return turns.select("child", (F.col("child") - 1).alias("parent"))

    @cached_property
    def member(self) -> DataFrame:
        """(collection_id, work_id, position, added_at) from customers' orders."""
        orders = self.table("orders").select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("work_id"), F.col("o_orderdate").alias("added_at"))
        return orders.withColumn("position", position(["collection_id"], [F.col("added_at"), F.col("work_id")]))


#: The same relations for DuckDB.
CTES = {
    "asset": """SELECT doc_id AS asset_id, doc_id // 2 AS edition_id, doc_id // 4 AS work_id,
        CASE doc_id % 6 WHEN 0 THEN 'EPUB' WHEN 1 THEN 'FB2' WHEN 2 THEN 'MOBI' WHEN 3 THEN 'PDF' WHEN 4 THEN 'DOCX' ELSE 'DJVU' END AS format,
        n_chars AS byte_size, CASE WHEN doc_id % 8 IN (3, 6, 7) THEN 'DERIVED' ELSE 'ORIGINAL' END AS derivation, sha256(text) AS content_hash FROM documents""",
    "location": """SELECT doc_id AS asset_id, source AS root_id, source || '/' || lang || '/doc-' || doc_id || '.txt' AS path,
        CASE doc_id % 11 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS availability, n_chars AS byte_size FROM documents""",
    "edge": "SELECT doc_id AS child, doc_id - CASE WHEN doc_id % 8 = 6 THEN 2 ELSE 1 END AS parent FROM documents WHERE doc_id % 8 IN (3, 6, 7)",
    "lineage": "SELECT child AS start, parent AS ancestor FROM edge UNION SELECT l.start, e.parent FROM lineage l JOIN edge e ON l.ancestor = e.child",
    "root": "SELECT DISTINCT source AS root_id FROM documents",
    "users": "SELECT range AS user_id FROM range(10)",
    "deny": "SELECT c_custkey AS user_id, root_id FROM customer JOIN root ON (c_custkey * 7 + CAST(substr(root_id, 4) AS BIGINT)) % 5 = 0 WHERE c_custkey BETWEEN 1 AND 9",
    "work": "SELECT work_id, 'doc-' || min(asset_id) || '.txt' AS provisional_title, CASE WHEN work_id % 10 = 9 THEN work_id - 1 END AS merged_into_id FROM asset GROUP BY work_id",
    "title_obs": """SELECT 'ASSET' AS subject_type, doc_id AS subject_id, 'title' AS field, substr(split_part(text, chr(10), 1), 1, 60) AS value, 't1-' || doc_id AS observation_id, 1 AS t FROM documents
        UNION ALL SELECT 'ASSET', doc_id, 'title', substr(split_part(text, chr(10), 1), 1, 60) || CASE WHEN doc_id % 7 = 0 THEN ' II' ELSE '  ' END, 't2-' || doc_id, 2 FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""",
    "lang_obs": "SELECT 'WORK' AS subject_type, doc_id // 4 AS subject_id, 'language' AS field, CASE WHEN doc_id % 13 = 0 THEN 'English' ELSE lang END AS value, 'l-' || doc_id AS observation_id, 1 AS t FROM documents",
    "isbn_obs": """SELECT 'ASSET' AS subject_type, doc_id AS subject_id, 'identifier:isbn13' AS field,
        body || CAST((10 - list_sum([CAST(substr(body, k, 1) AS INTEGER) * CASE WHEN k % 2 = 1 THEN 1 ELSE 3 END FOR k IN range(1, 13)]) % 10 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) % 10 AS INTEGER) AS value,
        'i-' || doc_id AS observation_id, 1 AS t FROM (SELECT doc_id, '978' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS body FROM documents)""",
    "obs": "SELECT * FROM title_obs UNION ALL SELECT * FROM lang_obs UNION ALL SELECT * FROM isbn_obs",
    # what the normaliser makes of these observations
    "fact": """SELECT *, CASE WHEN field = 'title' THEN nullif(trim(regexp_replace(value, '\\s+', ' ', 'g')), '')
            WHEN field = 'language' THEN CASE WHEN regexp_full_match(lower(value), '[a-z]{2,3}') THEN lower(value) END
            WHEN (list_sum([CAST(substr(value, k, 1) AS INTEGER) * CASE WHEN k % 2 = 1 THEN 1 ELSE 3 END FOR k IN range(1, 14)]) % 10) = 0 THEN value END AS norm FROM obs""",
    "latest_fact": "SELECT subject_type, subject_id, field, norm, arg_max(observation_id, (t, observation_id)) AS latest FROM fact GROUP BY ALL",
    "resolved": """SELECT subject_type, subject_id, field, CASE count(norm) WHEN 0 THEN 'ABSENT' WHEN 1 THEN 'PRESENT' ELSE 'CONFLICT' END AS outcome,
        CASE WHEN count(norm) = 1 THEN max(norm) END AS value,
        CASE WHEN count(norm) > 1 THEN string_agg(latest, ',' ORDER BY norm) FILTER (WHERE norm IS NOT NULL) END AS alternatives FROM latest_fact GROUP BY ALL""",
    "override_": """SELECT 'ASSET' AS subject_type, doc_id AS subject_id, 'title' AS field, CASE WHEN toxic = 1 THEN 'ABSENT' ELSE 'PRESENT' END AS state,
        CASE WHEN toxic <> 1 THEN 'Curated ' || doc_id END AS value FROM labels WHERE toxic = 1 OR quality = 1""",
    "display": """SELECT DISTINCT ON (subject_type, subject_id, field) subject_type, subject_id, field, value, source FROM (
        SELECT subject_type, subject_id, field, value, 'CURATED' AS source, 1 AS rank, 0 AS t, '' AS id FROM override_
        UNION ALL SELECT subject_type, subject_id, field, value, 'RESOLVED', 2, 0, '' FROM resolved
        UNION ALL SELECT subject_type, subject_id, field, value, 'OBSERVED', 3, t, observation_id FROM obs)
        ORDER BY subject_type, subject_id, field, rank, t DESC, id DESC""",
    "contributor": """SELECT work_id, contributor_id, row_number() OVER (PARTITION BY work_id ORDER BY line, contributor_id) - 1 AS ordinal FROM (
        SELECT l_partkey AS work_id, l_suppkey AS contributor_id, min(l_linenumber) AS line FROM lineitem GROUP BY ALL)""",
    "tag": "SELECT p_partkey AS work_id, p_type AS name FROM part UNION ALL SELECT p_partkey, p_brand FROM part",
    "outcome": """SELECT user_id AS job_id, props AS path, CASE event_type WHEN 'click' THEN 'PROCESSED' WHEN 'purchase' THEN 'SKIPPED' WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'DEFERRED' ELSE 'DISCOVERED' END AS state,
        ts AS moment, event_id AS sequence FROM events""",
    "final_outcome": "SELECT DISTINCT ON (job_id, path) * FROM outcome ORDER BY job_id, path, moment DESC, sequence DESC",
    "task": """SELECT event_id AS task_id, user_id % 5 AS root_id, user_id AS job_id, props AS path,
        CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'signup' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' ELSE 'CANCELLED' END AS state,
        event_id % 4 AS attempts, ts + INTERVAL 1 MINUTE AS lease_until, event_id AS sequence FROM events""",
    "turn_": "SELECT conv_id * 100 + turn AS child, conv_id * 100 + turn - 1 AS parent FROM conversations WHERE turn > 0",
    "turn_lineage": "SELECT child AS start, parent AS ancestor FROM turn_ UNION SELECT l.start, e.parent FROM turn_lineage l JOIN turn_ e ON l.ancestor = e.child",
    "member": "SELECT o_custkey AS collection_id, o_orderkey AS work_id, o_orderdate AS added_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders",
    # of an extracted batch: each second file, of which each second one has grown
    "batch_file": """SELECT *, asset_id % 4 = 0 AS fresh, root_id || '|' || path AS place, root_id || '|' || path || '|' || (byte_size + CASE WHEN asset_id % 4 = 0 THEN 1 ELSE 0 END) || '|1767398400000000' AS key FROM location WHERE asset_id % 2 = 0""",
    # folds of commands, one after the other
    "lease_event": """SELECT user_id * 8 + event_id % 8 AS task_id, row_number() OVER (PARTITION BY user_id * 8 + event_id % 8 ORDER BY event_id) AS n, 't' || event_id // 8 % 2 AS token, ts AS moment,
        CASE WHEN event_type = 'view' OR event_type = 'signup' AND event_id % 3 <> 0 THEN 'CLAIM' WHEN event_type = 'signup' THEN 'CANCEL' WHEN event_type = 'click' THEN 'HEARTBEAT' WHEN event_type = 'purchase' THEN 'COMPLETE' ELSE 'FAIL' END AS kind FROM events""",
    "lease_state": """SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS n, 'QUEUED' AS state, CAST(NULL AS VARCHAR) AS token, 0 AS attempts, CAST(NULL AS TIMESTAMP) AS heartbeat, false AS cancelled FROM lease_event
        UNION ALL SELECT s.task_id, e.n, CASE WHEN e.kind = 'CLAIM' AND s.state = 'QUEUED' THEN 'RUNNING' WHEN e.kind IN ('COMPLETE', 'FAIL') AND s.state = 'RUNNING' AND s.token = e.token THEN CASE WHEN e.kind = 'FAIL' THEN 'FAILED' WHEN s.cancelled THEN 'CANCELLED' ELSE 'SUCCEEDED' END
                WHEN e.kind = 'CANCEL' AND s.state = 'QUEUED' THEN 'CANCELLED' ELSE s.state END,
            CASE WHEN e.kind = 'CLAIM' AND s.state = 'QUEUED' THEN e.token ELSE s.token END, s.attempts + CASE WHEN e.kind = 'CLAIM' AND s.state = 'QUEUED' THEN 1 ELSE 0 END,
            CASE WHEN e.kind = 'CLAIM' AND s.state = 'QUEUED' OR e.kind = 'HEARTBEAT' AND s.state = 'RUNNING' AND s.token = e.token THEN e.moment ELSE s.heartbeat END, s.cancelled OR e.kind = 'CANCEL' AND s.state = 'RUNNING'
            FROM lease_state s JOIN lease_event e ON e.task_id = s.task_id AND e.n = s.n + 1""",
    "edit_event": """SELECT user_id * 4 + event_id % 4 AS subject_id, row_number() OVER (PARTITION BY user_id * 4 + event_id % 4 ORDER BY event_id) AS n, event_type NOT IN ('purchase', 'click', 'view') AS undo, event_type || event_id AS value FROM events""",
    "edit_state": """SELECT DISTINCT subject_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS vals, CAST([] AS INTEGER[]) AS priors, -1 AS cur, 0 AS conflicts FROM edit_event
        UNION ALL SELECT s.subject_id, e.n, CASE WHEN e.undo THEN CASE WHEN s.cur >= 0 AND s.priors[s.cur + 1] >= 0 THEN list_append(s.vals, s.vals[s.priors[s.cur + 1] + 1]) ELSE s.vals END ELSE list_append(s.vals, e.value) END,
            CASE WHEN NOT e.undo OR s.cur >= 0 AND s.priors[s.cur + 1] >= 0 THEN list_append(s.priors, s.cur) ELSE s.priors END, CASE WHEN NOT e.undo OR s.cur >= 0 AND s.priors[s.cur + 1] >= 0 THEN CAST(len(s.vals) AS INTEGER) ELSE -1 END,
            s.conflicts + CASE WHEN e.undo AND s.cur < 0 THEN 1 ELSE 0 END FROM edit_state s JOIN edit_event e ON e.subject_id = s.subject_id AND e.n = s.n + 1""",
    # visibility
    "denied_asset": "SELECT DISTINCT user_id, asset_id FROM location JOIN deny USING (root_id)",
    "denied_lineage": "SELECT DISTINCT user_id, start AS asset_id FROM lineage JOIN denied_asset ON ancestor = asset_id",
    "visible_asset": """SELECT DISTINCT u.user_id, a.asset_id, a.work_id FROM users u, location l JOIN asset a USING (asset_id) WHERE l.availability = 'AVAILABLE'
        AND NOT EXISTS (SELECT 1 FROM deny d WHERE d.user_id = u.user_id AND d.root_id = l.root_id)
        AND NOT EXISTS (SELECT 1 FROM denied_lineage d WHERE d.user_id = u.user_id AND d.asset_id = a.asset_id)""",
}


def oracle(sql: str) -> str:
    """sql with the CTEs that it needs, found by name."""
    import re

    needed: list[str] = []

    def add(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                needed.append(name)
                add(CTES[name])

    add(sql)
    chosen = [n for n in CTES if n in needed]
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in chosen)
    return f"WITH RECURSIVE {ctes} {sql}" if chosen else sql
