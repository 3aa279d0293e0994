"""Catalog operators on made-up cases that the driver's tables don't hold."""

import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import curation, evidence, primitives, queue
from tomeflow.sources import parsers

NOW = datetime(2024, 1, 30)


def single_claims(tasks, jobs, schedule, share, n, most):
    """n claims, one after the other, in plain Python: what fair_claims() says at once."""
    tasks, schedule, out = {t["task_id"]: dict(t) for t in tasks}, {s["root_id"]: dict(s) for s in schedule}, []
    live = {j["job_id"] for j in jobs if j["state"] == "RUNNING" and not j["cancel_requested"]}

    def can(t):
        return t["job_id"] in live and (t["state"] == "QUEUED" or t["state"] == "RUNNING" and t["lease_until"] < NOW)

    for turn in range(n):
        waiting = {t["root_id"] for t in tasks.values() if can(t)}
        running = {r: sum(t["root_id"] == r and t["state"] == "RUNNING" and t["lease_until"] >= NOW for t in tasks.values()) for r in waiting}
        roots = [s for s in schedule.values() if s["root_id"] in waiting and (len(waiting) <= 1 or running[s["root_id"]] < share)]
        if not roots:
            break
        root = min(roots, key=lambda s: (s["last_claimed_at"] is not None, s["last_claimed_at"] or NOW, s["claim_sequence"], s["root_id"]))
        root |= {"last_claimed_at": NOW, "claim_sequence": root["claim_sequence"] + 1}
        task = min((t for t in tasks.values() if can(t) and t["root_id"] == root["root_id"]), key=lambda t: (t["sequence"], t["task_id"]))
        if task["attempts"] >= most:
            task |= {"state": "FAILED", "lease_until": None}
            out.append((task["task_id"], root["root_id"], turn, "EXHAUSTED"))
        else:
            task |= {"state": "RUNNING", "lease_until": NOW + timedelta(minutes=5), "attempts": task["attempts"] + 1}
            out.append((task["task_id"], root["root_id"], turn, "CLAIMED"))
    return out, tasks, schedule


@pytest.mark.parametrize("seed", range(6))
def test_a_batch_claims_as_single_claims_do(spark, seed):
    r = random.Random(seed)
    roots = range(r.choice((1, 2, 4)))
    tasks = [
        {"task_id": i, "root_id": r.choice(roots), "job_id": r.randrange(4), "state": r.choice(("QUEUED", "QUEUED", "RUNNING", "SUCCEEDED")), "attempts": r.randrange(4), "lease_until": NOW + timedelta(minutes=r.choice((-9, 9))), "sequence": r.randrange(30)}
        for i in range(r.choice((12, 40)))
    ]
    jobs = [{"job_id": j, "state": "RUNNING" if j else "SUCCEEDED", "cancel_requested": j == 1 and seed % 2 == 0} for j in range(4)]
    schedule = [{"root_id": k, "last_claimed_at": None if r.random() < 0.4 else NOW - timedelta(minutes=r.randrange(50)), "claim_sequence": r.randrange(3)} for k in roots if k or seed != 5]
    share, n = r.choice((1, 3, 6)), r.choice((5, 30))
    expected, after, served = single_claims(tasks, jobs, schedule, share, n, 3)

    def df(rows, schema):
        return spark.createDataFrame([tuple(x.values()) for x in rows], schema)

    given = df(tasks, "task_id long, root_id long, job_id long, state string, attempts int, lease_until timestamp, sequence long")
    plan = df(schedule, "root_id long, last_claimed_at timestamp, claim_sequence long")
    claims = queue.fair_claims(given, df(jobs, "job_id long, state string, cancel_requested boolean"), plan, F.lit(NOW), share, n, 3).cache()
    assert sorted(map(tuple, claims.collect()), key=lambda x: x[2]) == expected
    states = {x.task_id: (x.state, x.attempts, x.lease_until) for x in queue.claimed(given, claims, F.lit(NOW), F.lit(NOW + timedelta(minutes=5))).collect()}
    assert states == {i: (t["state"], t["attempts"], t["lease_until"]) for i, t in after.items()}
    assert {x.root_id: (x.last_claimed_at, x.claim_sequence) for x in queue.rescheduled(plan, claims, F.lit(NOW)).collect()} == {k: (s["last_claimed_at"], s["claim_sequence"]) for k, s in served.items()}


def test_too_many_tags_and_aliases_are_refused(spark):
    def tags(names):
        return spark.createDataFrame([(names,)], "names array<string>").select(curation.normalized_tags(F.col("names")).alias("n")).first().n

    assert tags([" A  b", "A b", "a b"]) == ["A b", "a b"] and len(tags([f"t{i}" for i in range(50)])) == 50
    for bad in ([f"t{i}" for i in range(51)], ["x" * 101], [" "], [None]):
        with pytest.raises(Exception, match="tags"):
            tags(bad)
    none = spark.createDataFrame([], "contributor_id long, name string, normalized_name string, origin string, version long")
    people = spark.createDataFrame([(1, "A", "a")], "contributor_id long, display_name string, normalized_name string")
    many = spark.createDataFrame([(1, "A", [f"a{i}" for i in range(101)])], "contributor_id long, display_name string, aliases array<string>")
    with pytest.raises(Exception, match="aliases"):
        curation.renamed_contributors(people, none, many)[1].collect()


def test_contributors_keep_their_observed_places(spark):
    rows = [(1, "contributor", "Ann", 3, 1), (1, "contributor:editor", "ann", 0, 1), (1, "contributor", "Bob  B", 3, 2), (2, "contributor", "Ann", 0, 1)]
    seen = spark.createDataFrame([(w, f, v, o, NOW + timedelta(days=d), f"{w}{o}{d}") for w, f, v, o, d in rows], "work_id long, field string, value string, ordinal int, observed_at timestamp, observation_id string")
    aliases = spark.createDataFrame([(2, "ann", "c7")], "work_id long, normalized_name string, contributor_id string")
    links, fresh = evidence.linked_contributors(seen, aliases)
    found = {(x.work_id, x.role, x.ordinal): (x.contributor_id, x.version) for x in links.collect()}
    names = {x.contributor_id: x.display_name for x in fresh.collect()}
    assert set(found) == {(1, "AUTHOR", 3), (1, "EDITOR", 0), (2, "AUTHOR", 0)}
    assert names[found[1, "AUTHOR", 3][0]] == "Bob B" and found[1, "AUTHOR", 3][1] == 2
    assert names[found[1, "EDITOR", 0][0]] == "ann" and found[2, "AUTHOR", 0] == ("c7", 1)


def test_places_over_the_whole_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).withColumn("v", F.when(F.col("v") % 10 > 0, F.col("v")))
    found = primitives.global_places(df, [F.col("v").asc_nulls_last()]).collect()
    assert sorted(r.place for r in found) == list(range(1, 1001))
    by = sorted(found, key=lambda r: r.place)
    assert [r.v for r in by[:900]] == sorted(r.v for r in found if r.v is not None) and all(r.v is None for r in by[900:])


def test_cyclic_lineage_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "child long, parent long")
    found = {tuple(r) for r in primitives.closure(edges, "child", "parent").collect()}
    assert found == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3)}


def test_damaged_archives_are_findings(tmp_path):
    at = str(tmp_path / "a.epub")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", "<c>" + "".join(map(str, range(5000))) + "</c>")
    data = bytearray(open(at, "rb").read())
    for k in range(120, 400):
        data[k] ^= 0x5A
    open(at, "wb").write(data)
    record, code, text, _ = parsers.parse(at, "EPUB")
    assert record is None and code == "MALFORMED" and text
    assert parsers.epub_violations(at)


def test_docx_names(tmp_path):
    at = str(tmp_path / "a.docx")
    core = '<p xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:cp="urn:x"><dc:title> T  t</dc:title><dc:creator>Ann</dc:creator><dc:identifier>i 1</dc:identifier><cp:lastModifiedBy>Bob</cp:lastModifiedBy><cp:revision>3</cp:revision></p>'
    with zipfile.ZipFile(at, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", "<d/>")
        z.writestr("docProps/core.xml", core)
        z.writestr("docProps/custom.xml", '<p><property name="Shelf"> A  1</property><property name="Empty"/></p>')
    record = parsers.parse(at, "DOCX")[0]
    assert (record["title"], record["contributors"], record["identifiers"]) == ("T t", ["Ann"], {"docx-core": "i 1"})
    assert record["extra"] == {"docx:core:title": ["T t"], "docx:core:creator": ["Ann"], "docx:core:identifier": ["i 1"], "docx:core:last-modified-by": ["Bob"], "docx:custom": ["Shelf=A 1"]}


def chunk(name, body):
    return name + len(body).to_bytes(4, "big") + body + b"\0" * (len(body) % 2)


def test_djvu_names(tmp_path):
    info = (100).to_bytes(2, "big") + (200).to_bytes(2, "big") + b"\0\0" + (300).to_bytes(2, "little") + b"\0\0"
    page = b"DJVU" + chunk(b"INFO", info) + chunk(b"ANTa", b'(metadata (title "A  t") (author "Ann") (note "n\\"1") (note "2"))') + chunk(b"TXTz", b"xx")
    directory = b"\x81" + (2).to_bytes(2, "big") + b"rest"
    at = tmp_path / "a.djvu"
    at.write_bytes(b"AT&T" + chunk(b"FORM", b"DJVM" + chunk(b"DIRM", directory) + chunk(b"FORM", page) + chunk(b"FORM", b"DJVU" + chunk(b"INFO", info))))
    record, code, text, read = parsers.parse(str(at), "DJVU")
    assert code is None, text
    assert (record["title"], record["contributors"]) == ("A t", ["Ann"])
    assert record["extra"] == {
        "djvu:page-count": ["2"], "djvu:component-count": ["2"], "djvu:first-page-width": ["100"], "djvu:first-page-height": ["200"], "djvu:first-page-dpi": ["300"],
        "djvu:compressed-metadata": ["present-not-decoded"], "djvu:metadata:title": ["A t"], "djvu:metadata:author": ["Ann"], "djvu:metadata:note": ['n"1', "2"],
    }


def test_fb2_takes_the_first_identifiers(tmp_path):
    at = tmp_path / "a.fb2"
    at.write_text("<FictionBook><description><title-info><book-title>S</book-title></title-info><document-info><id>one</id><id>two</id></document-info><publish-info><isbn>1</isbn><isbn>2</isbn></publish-info></description></FictionBook>")
    assert parsers.parse(str(at), "FB2")[0]["identifiers"] == {"fb2-document-id": "one", "isbn": "1"}
