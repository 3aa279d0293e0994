"""Versions of tables, stored views and merges against plain loops over small random catalogs."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import evidence, merging, snapshots, views


def test_tables_change_together(spark, tmp_path):
    at = str(tmp_path)
    a, b = spark.range(3), spark.range(5)
    assert snapshots.replaced_all({"a": a, "b": b}, at) == 1
    assert snapshots.replaced_all({"b": a}, at, expected=1) == 2
    version, tables = snapshots.current_all(spark, at)
    assert version == 2 and {k: v.count() for k, v in tables.items()} == {"a": 3, "b": 3}
    assert snapshots.current_all(spark, at, 1)[1]["b"].count() == 5
    with pytest.raises(snapshots.VersionConflict):
        snapshots.replaced_all({"a": b}, at, expected=1)
    with pytest.raises(snapshots.VersionConflict):
        snapshots.published(spark, at, 2, {"a": "other"})
    assert snapshots.current_all(spark, at)[1]["a"].count() == 3


def test_one_of_two_writers_wins(spark, tmp_path):
    at = str(tmp_path)
    snapshots.replaced(spark.range(1), at)

    def write(n):
        try:
            return snapshots.replaced_all({"data": spark.range(n)}, at, expected=1), n
        except snapshots.VersionConflict:
            return None, n

    with ThreadPoolExecutor(4) as pool:
        won = [n for version, n in pool.map(write, range(2, 6)) if version]
    assert len(won) == 1 and snapshots.current(spark, at).count() == won[0]


def test_writers_that_append_keep_keys_apart(spark, tmp_path):
    at = str(tmp_path)

    def add(k):
        return snapshots.appended(spark.createDataFrame([(i, k) for i in range(k, k + 10)], "i long, k long"), at, ["i"], [F.col("k")])

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(4)))
    rows = snapshots.grown(spark, at, spark.createDataFrame([], "i long, k long")).collect()
    assert sorted(r.i for r in rows) == list(range(13))


@pytest.mark.parametrize("seed", range(1))
def test_refreshed_views_equal_a_full_computation(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(views, "BUCKETS", 5)
    r, start = random.Random(seed), datetime(2024, 1, 1)
    values = {"title": ["A", "A ", "B", " "], "language": ["en", "EN", "de", "?!"], "identifier:isbn13": ["9780306406157", "978-0306406157", "1"], "other": ["x"]}
    store, observed, overrides = views.Views(spark, str(tmp_path)), [], []
    for batch in range(4):
        fresh = [("ASSET", r.randrange(6), f := r.choice(list(values)), r.choice(values[f]), f"o{batch}-{i}", start + timedelta(days=r.randrange(9)), r.choice(["PRESENT", "PRESENT", "ABSENT"])) for i in range(8 if batch else 30)]
        decided = [("ASSET", r.randrange(6), "title", s := r.choice(["PRESENT", "ABSENT"]), "C" if s == "PRESENT" else None, batch + 1, r.random() < 0.7, start + timedelta(days=20 + batch))]
        observed += fresh
        overrides += decided
        store.observe(spark.createDataFrame(fresh + fresh[:2], views.OBSERVATION.format(id="long")))
        if batch != 2:
            store.override(spark.createDataFrame(decided, views.OVERRIDE.format(id="long")))
        else:
            overrides.pop()
        touched = store.refresh(F.lit(start + timedelta(days=batch)))
        assert 0 < touched <= len(fresh) + 1
        everything = spark.createDataFrame(observed, views.OBSERVATION.format(id="long"))
        whole = evidence.resolved(evidence.facts(everything))
        key = ("subject_type", "subject_id", "field", "outcome", "value")
        assert sorted(map(repr, store.resolved().where("active").select(*key).collect())) == sorted(map(repr, whole.select(*key).collect()))
        last = {o[1]: o for o in overrides}
        resolution = whole.select("*", F.lit(1).cast("long").alias("version"), F.lit(True).alias("active"), F.lit(start).alias("resolved_at"))
        shown = evidence.displayed(spark.createDataFrame(list(last.values()), views.OVERRIDE.format(id="long")), resolution, everything)
        columns = ("subject_type", "subject_id", "field", "value", "source")
        assert sorted(map(repr, store.display().select(*columns).collect())) == sorted(map(repr, shown.select(*columns).collect()))
    assert store.refresh(F.lit(start)) == 0


# --- merges: the rules in loops, one merge after the other -------------------------------------------------------

SCHEMAS = {
    "work": "work_id long, version long, merged_into_id long",
    "edition": "edition_id long, work_id long, version long, merged_into_id long",
    "contributor": "contributor_id long, version long, merged_into_id long",
    "asset": "asset_id long, edition_id long, version long",
    "work_contributor": "work_id long, contributor_id long, role string, ordinal int",
    "edition_contributor": "edition_id long, contributor_id long, role string, ordinal int",
    "edition_identifier": "identifier_id long, edition_id long, scheme string, observed_value string",
    "work_tag": "work_id long, tag_id long",
    "user_work_read_state": "user_id long, work_id long, completed_edition_id long, completed_at date, version long",
    "personal_collection_work": "collection_id long, work_id long, position int, added_at date",
    "cover_job": "cover_job_id long, work_id long",
    "cover_derivative": "cover_id long, work_id long",
    "work_cover_preference": "work_id long, source_asset_id long, actor_user_id long, reason string, version long, updated_at date",
    "contributor_alias": "alias_id long, contributor_id long, normalized_alias string",
    "user_contributor_favorite": "user_id long, contributor_id long",
    "metadata_curated_override": "override_id long, subject_type string, subject_id long, field_name string, value_state string, curated_value string, override_version int, supersedes_override_id long, undo_of_override_id long, active boolean",
}


def made(seed):
    r, day = random.Random(seed), date(2024, 1, 1)
    works, editions, people = range(1, 9), range(11, 31), range(41, 49)
    of = {e: r.choice(works) for e in editions}

    def links(owners):
        rows = []
        for o in owners:
            for role in ("AUTHOR", "EDITOR"):
                rows += [(o, c, role, i + r.choice((0, 0, 2))) for i, c in enumerate(r.sample(people, r.randrange(4)))]
        return rows

    pairs = {(u, w) for u in range(5) for w in works if r.random() < 0.6}
    rows = {
        "work": [(w, 1, None) for w in works], "edition": [(e, w, 1, None) for e, w in of.items()], "contributor": [(c, 1, None) for c in people],
        "asset": [(100 + i, r.choice(editions), 1) for i in range(30)], "work_contributor": links(works), "edition_contributor": links(editions),
        "edition_identifier": [(200 + i, r.choice(editions), r.choice("st"), r.choice("ab")) for i in range(40)], "work_tag": list({(r.choice(works), r.randrange(5)) for _ in range(25)}),
        "user_work_read_state": [(u, w, r.choice([None, *[e for e in editions if of[e] == w]]), day, 1) for u, w in sorted(pairs)],
        "personal_collection_work": [(u, w, r.choice([None, r.randrange(6)]), day) for u, w in sorted(pairs)], "cover_job": [(300 + i, r.choice(works)) for i in range(8)],
        "cover_derivative": [(400 + i, r.choice(works)) for i in range(8)], "work_cover_preference": [(w, 100 + w, 1, "r", 1, day) for w in works if r.random() < 0.6],
        "contributor_alias": [(500 + i, r.choice(people), r.choice("xyz")) for i in range(20)], "user_contributor_favorite": list({(r.randrange(5), r.choice(people)) for _ in range(20)}),
        "metadata_curated_override": [(600, "WORK", 1, "title", "PRESENT", "v", 1, None, None, True)],
    }
    subjects = {"WORK": list(works), "EDITION": list(editions), "CONTRIBUTOR": list(people)}
    merges = {}
    for kind, ids in subjects.items():
        r.shuffle(ids)
        merges[kind] = [(i, a, b) for i, (a, b) in enumerate(zip(ids[::2], ids[1::2], strict=False)) if i < 3]
    return {name: [dict(zip([c.split()[0] for c in SCHEMAS[name].split(", ")], row, strict=True)) for row in found] for name, found in rows.items()}, merges


def frames(spark, rows):
    return {name: spark.createDataFrame([tuple(x.values()) for x in found], SCHEMAS[name]) for name, found in rows.items()}


def as_rows(tables):
    return {name: sorted(repr(tuple(x)) for x in df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]).collect()) for name, df in tables.items()}


def as_sorted(rows):
    return {name: sorted(repr(tuple(x.values())) for x in found) for name, found in rows.items()}


def merge_one(t, kind, survivor, source):
    def all_of(name, column, bump=False):
        for x in t[name]:
            if x[column] == source:
                x[column] = survivor
                if bump:
                    x["version"] += 1

    def unless(name, column, *keys, may=lambda x: True):
        go = [x for x in t[name] if x[column] == source and not any(y[column] == survivor and all(y[k] == x[k] for k in keys) for y in t[name]) and may(x)]
        for x in go:
            x[column] = survivor

    def subject_links(name, column):
        for x in sorted((x for x in t[name] if x[column] == source), key=lambda x: (x["role"], x["ordinal"], x["contributor_id"])):
            there = [y for y in t[name] if y[column] == survivor and y["role"] == x["role"]]
            if not any(y["contributor_id"] == x["contributor_id"] for y in there):
                x["ordinal"], x[column] = max((y["ordinal"] + 1 for y in there), default=0), survivor

    def person_links(name, column):
        for x in sorted((x for x in t[name] if x["contributor_id"] == source), key=lambda x: (x[column], x["role"], x["ordinal"])):
            there = [y for y in t[name] if y[column] == x[column] and y["role"] == x["role"]]
            if not any(y["contributor_id"] == survivor for y in there):
                x["ordinal"], x["contributor_id"] = max(y["ordinal"] + 1 for y in there), survivor

    if kind == "WORK":
        all_of("edition", "work_id", True)
        subject_links("work_contributor", "work_id")
        unless("work_tag", "work_id", "tag_id")
        unless("user_work_read_state", "work_id", "user_id")
        members = t["personal_collection_work"]
        unless("personal_collection_work", "work_id", "collection_id", may=lambda x: x["position"] is None or not any(y["collection_id"] == x["collection_id"] and y["position"] == x["position"] and y["work_id"] != x["work_id"] for y in members))
        all_of("cover_job", "work_id")
        all_of("cover_derivative", "work_id")
        unless("work_cover_preference", "work_id")
    elif kind == "EDITION":
        all_of("asset", "edition_id", True)
        subject_links("edition_contributor", "edition_id")
        unless("edition_identifier", "edition_id", "scheme", "observed_value")
        all_of("user_work_read_state", "completed_edition_id")
    else:
        unless("contributor_alias", "contributor_id", "normalized_alias")
        person_links("work_contributor", "work_id")
        person_links("edition_contributor", "edition_id")
        unless("user_contributor_favorite", "contributor_id", "user_id")
    table, own = merging.SUBJECTS[kind]
    for x in t[table]:
        if x[own] in (survivor, source):
            x["version"] += 1
        if x[own] == source:
            x["merged_into_id"] = survivor


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("kind", list(merging.SUBJECTS))
def test_a_batch_merges_as_single_merges_do(spark, kind, seed):
    rows, merges = made(seed)
    tables = frames(spark, rows)
    before = as_sorted(rows)
    operations = spark.createDataFrame(merges[kind], "operation_id long, survivor_id long, source_id long")
    after, images = merging.applied(tables, kind, operations)
    for _, survivor, source in merges[kind]:
        merge_one(rows, kind, survivor, source)
    assert as_rows(after) == as_sorted(rows) != before

    applied = operations.withColumn("status", F.lit("APPLIED"))
    assert {x.reason for x in merging.undo_previews(after, kind, applied, images).collect()} == {None}
    undone = as_rows(after | merging.undone(after, kind, operations, images))
    moved = {"WORK": "edition", "EDITION": "asset"}.get(kind)
    assert {k: v for k, v in undone.items() if k != moved} == {k: v for k, v in before.items() if k != moved}
    if moved:  # these come back with a version of their own
        place = "work_id" if kind == "WORK" else "edition_id"
        raised = {x[f"{moved}_id"]: x["version"] for x in rows[moved]}
        sources = {s for _, _, s in merges[kind]}
        first, _ = made(seed)
        wanted = [x | {"version": raised[x[f"{moved}_id"]] + (kind == "WORK" and x[place] in sources)} for x in first[moved]]
        assert undone[moved] == as_sorted({moved: wanted})[moved]


def test_undo_is_refused_after_any_change(spark):
    rows, merges = made(7)
    operations = spark.createDataFrame([(*m, "APPLIED") for m in merges["WORK"]], "operation_id long, survivor_id long, source_id long, status string")
    after, images = merging.applied(frames(spark, rows), "WORK", operations)
    (first, survivor, _), (second, _, source), (third, *_) = merges["WORK"]
    changed = after | {
        "work": after["work"].withColumn("version", F.col("version") + (F.col("work_id") == survivor).cast("int")),
        "metadata_curated_override": after["metadata_curated_override"].withColumn("subject_id", F.lit(source).cast("long")),
    }
    found = {x.operation_id: x.reason for x in merging.undo_previews(changed, "WORK", operations, images).collect()}
    assert found == {first: "CHANGED", second: "CHANGED", third: "CHANGED" if 1 in merges["WORK"][2] else None}
    done = operations.withColumn("status", F.lit("UNDONE"))
    assert {x.reason for x in merging.undo_previews(changed, "WORK", done, images).collect()} == {"UNDONE"}


def test_merges_that_share_a_subject_are_refused(spark):
    works = spark.createDataFrame([(i, 1, None) for i in range(1, 6)], "work_id long, version long, merged_into_id long")
    requests = spark.createDataFrame([(1, 1, 2, 1, 1, "r", "a"), (2, 2, 3, 1, 1, "r", "b"), (3, 4, 5, 1, 1, "r", "c")], "operation_id long, survivor_id long, source_id long, survivor_version long, source_version long, reason string, idempotency_key string")
    none = spark.createDataFrame([], "subject_type string, idempotency_key string, survivor_id long, source_id long")
    found = merging.checked({"work": works}, "WORK", requests, works.select(F.col("work_id").alias("subject_id")), none).collect()
    assert {x.operation_id: x.problem for x in found} == {1: "OVERLAPS", 2: "OVERLAPS", 3: None}


def test_a_merge_is_published_as_one_version(spark, tmp_path):
    rows, merges = made(2)
    at, operations = str(tmp_path), spark.createDataFrame(merges["WORK"], "operation_id long, survivor_id long, source_id long")
    snapshots.replaced_all(frames(spark, rows), at)
    version, tables = snapshots.current_all(spark, at)
    after, images = merging.applied(tables, "WORK", operations)
    assert snapshots.replaced_all({k: after[k] for k in merging.merged(tables, "WORK", operations)} | {"merge_image": images}, at, expected=version) == 2
    now, tables = snapshots.current_all(spark, at)
    restored = merging.undone(tables, "WORK", operations, tables["merge_image"])
    assert snapshots.replaced_all(restored, at, expected=now) == 3
    found = as_rows({k: v for k, v in snapshots.current_all(spark, at)[1].items() if k in SCHEMAS and k != "edition"})
    assert found == {k: v for k, v in as_sorted(rows).items() if k != "edition"}
