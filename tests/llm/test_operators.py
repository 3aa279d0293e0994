"""The training-data operators against brute force, and on nulls, empty and very long texts, repeated rows, empty tables and extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeflow.llm import flac, html, jaccard, language, mixing, packing, quality, sharding, syncmers, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `component` string, slot int, size string"


def make(spark, rows):
    """rows: (doc_id, text, source); the columns that clash with results hold rubbish."""
    return spark.createDataFrame([(i, t, "en" if i is not None and i % 2 else None, s, None, "x", 9, "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    base = " ".join(f"w{i % 97}x{i % 13}" for i in range(300))
    near = base.replace("w5x5", "edited", 1)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "a"), (5, "ONE", "b"), (6, "one two", "b"),
        (7, base, "a"), (8, base.upper(), "a"), (9, near, "a"), (10, base[:800], "c"), (11, "é ß 漢字 🙂  x", "c"),
        (12, "long word " * 40_000, "a"), (13, "Seven words\nstand here, on\ntwo lines.", None), (7, base, "a"), (None, base, "a"), (14, "<|endoftext|> x", "c"),
    ]


@pytest.fixture(scope="session")
def docs(spark, odd):
    return make(spark, odd).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def components(rows, n, num, den):
    sets = [shingles(t, n) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


def test_jaccard_odd_rows(spark, docs, odd, none, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    found = jaccard.joined(spark.read.parquet(str(tmp_path / "d")), 3, 90, 100).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in found) == components(odd, 3, 90, 100)
    none.write.parquet(str(tmp_path / "n"))
    assert jaccard.joined(spark.read.parquet(str(tmp_path / "n"))).count() == 0


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (5, 80, 100), (2, 60, 100)])
def test_jaccard_equals_brute_force(spark, tmp_path, n, num, den):
    rng = np.random.default_rng(n)
    rows = []
    for group in range(30):
        words = [f"v{x}" for x in rng.integers(0, 60, rng.integers(3, 120))]
        for _ in range(rng.integers(1, 9)):
            own = list(words)
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(0, len(own))] = f"e{rng.integers(0, 40)}"
            rows.append((len(rows), " ".join(own), "s"))
    make(spark, rows).write.parquet(str(tmp_path / "d"))
    found = jaccard.joined(spark.read.parquet(str(tmp_path / "d")), n, num, den).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in found) == components(rows, n, num, den)


def test_deduplicated_decides_by_row(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcd")
    rows = [(None, a), (1, a), (2, a), (2, b), (None, c), (None, c), (3, d), (3, d), (4, ""), (4, ""), (None, ""), (None, a + " end")]
    found = jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, [(1, a), (2, b), (None, c), (3, d), (4, ""), (None, "")]))


def test_flac_round_trip(docs, odd, none):
    for r in flac.digested(docs).where("doc_id is not null").collect():
        raw = (next(t for i, t, _ in odd if i == r.doc_id) or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert flac.digested(none).count() == 0


def test_flac_streams():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 192 * 9, np.uint8).tobytes(), bytes(192 * 5), (np.sin(np.arange(192 * 40) / 9) * 90 + 128).astype(np.uint8).tobytes()]
    media = flac.encode_many(payloads)
    assert [(x.astype(np.int8).view(np.uint8) ^ 128).tobytes() for x in flac.decode_many(media)] == payloads
    assert len(media[2]) < len(payloads[2]) and len(media[1]) < 200
    points = flac.metadata(media[2])
    for sample, offset, _ in points["seek"]:
        assert media[2][points["first_frame"] + offset] == 0xFF and sample % 192 == 0
    for at in (len(media[2]) // 2, len(media[2]) - 1):
        damaged = bytearray(media[2])
        damaged[at] ^= 0x10
        with pytest.raises(flac.FlacError):
            flac.decode_many([bytes(damaged)])


def test_flac_pcm_blocks(spark):
    good = flac.encode_many([bytes(range(192)) * 30])[0]
    rows = flac.pcm_blocks(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no")), (3, None)], "id long, media binary"), ["id"]).collect()
    own = sorted((r for r in rows if r.id == 1), key=lambda r: r.block)
    assert [r.first_sample for r in own] == [0, 4608] and sum(r.n_samples for r in own) == 5760
    assert all(r.error for r in rows if r.id != 1) and b"".join(r.pcm for r in own) == bytes(range(192)) * 30


class FlacWriter:
    """Frames by hand: bits one after the other, CRCs added."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""
        return self

    def rice(self, r, k):
        u = 2 * r if r >= 0 else -2 * r - 1
        self.bits += "0" * (u >> k) + "1"
        return self.put(u, k)

    def bytes(self):
        return bytes(int(self.bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(self.bits), 8))


def crc(data, bits, poly):
    r = 0
    for byte in data:
        r ^= byte << (bits - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly if r >> (bits - 1) & 1 else r << 1) & ((1 << bits) - 1)
    return r.to_bytes(bits // 8, "big")


def frame(first, n, channels, body, variable=True):
    head = FlacWriter().put(0x7FFC, 15).put(variable, 1).put(7, 4).put(0, 4).put(channels, 4).put(0, 3).put(0, 1)
    coded = [first] if first < 128 else [0xC0 | first >> 6, 0x80 | first & 63]
    head = head.bytes() + bytes(coded) + (n - 1).to_bytes(2, "big")
    data = head + crc(head, 8, 0x07) + body.bytes()
    return data + crc(data, 16, 0x8005)


def stream(frames, samples, channels, bits):
    """samples: rows of ints, one a moment."""
    raw = b"".join(v.to_bytes(bits // 8, "little", signed=True) for moment in samples for v in moment)
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC\x80\x00\x00\x22" + info + b"".join(frames)


def test_flac_reads_hand_made_frames():
    """16 bits, blocks of changing sizes: a linear predictor of order 3 with partitions and an escape, wasted bits with a fixed one of order 4, wide Rice parameters."""
    rng = np.random.default_rng(8)
    x = [int(v) for v in rng.integers(-900, 900, 24)]
    c, shift = (5, -3, 2), 2
    r = [x[t] - ((c[0] * x[t - 1] + c[1] * x[t - 2] + c[2] * x[t - 3]) >> shift) for t in range(3, 24)]
    body = FlacWriter().put(0, 1).put(34, 6).put(0, 1)
    for v in x[:3]:
        body.put(v, 16)
    body.put(4 - 1, 4).put(shift, 5)
    for v in c:
        body.put(v, 4)
    body.put(0, 2).put(1, 4).put(9, 4)  # two partitions of 12
    for v in r[:9]:
        body.rice(v, 9)
    body.put(15, 4).put(14, 5)  # the other as it stands, in 14 bits
    for v in r[9:]:
        body.put(v, 14)
    y = [4 * int(v) for v in rng.integers(-300, 300, 16)]
    z = [v >> 2 for v in y]
    q = [z[t] - 4 * z[t - 1] + 6 * z[t - 2] - 4 * z[t - 3] + z[t - 4] for t in range(4, 16)]
    second = FlacWriter().put(0, 1).put(12, 6).put(1, 1).put(1, 2)  # two wasted bits
    for v in z[:4]:
        second.put(v, 14)
    second.put(1, 2).put(0, 4).put(7, 5)
    for v in q:
        second.rice(v, 7)
    media = stream([frame(0, 24, 0, body), frame(24, 16, 0, second)], [(v,) for v in x + y], 1, 16)
    assert flac.decode_many([media])[0].tolist() == x + y
    blocks = list(flac.blocks_of(flac.decode_many([media])[0], 16, 16))
    assert [(at, n) for at, n, _ in blocks] == [(0, 16), (16, 16), (32, 8)]
    assert np.frombuffer(b"".join(p for _, _, p in blocks), "<i2").tolist() == x + y


@pytest.mark.parametrize("mode", [1, 8, 9, 10])
def test_flac_reads_two_channels(mode):
    left, right = ([int(v) for v in np.random.default_rng(k).integers(-30_000, 30_000, 16)] for k in (1, 2))
    side = [a - b for a, b in zip(left, right, strict=True)]
    pair = {1: (left, right), 8: (left, side), 9: (side, right), 10: ([(a + b) >> 1 for a, b in zip(left, right, strict=True)], side)}[mode]
    body = FlacWriter()
    for k, channel in enumerate(pair):
        body.put(0, 1).put(1, 6).put(0, 1)
        for v in channel:
            body.put(v, 16 + (mode in (8, 10) and k == 1 or mode == 9 and k == 0))
    media = stream([frame(0, 16, mode, body)], list(zip(left, right, strict=True)), 2, 16)
    assert flac.decode_many([media])[0].tolist() == [list(m) for m in zip(left, right, strict=True)]
    damaged = media[:-5] + bytes([media[-5] ^ 1]) + media[-4:]
    with pytest.raises(flac.FlacError):
        flac.decode_many([damaged])


def targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight, full = {n: weights[i % 3] for i, n in enumerate(names)}, {}
    left, free = 1.5 * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[n] for n in free)
        over = [n for n in free if level * weight[n] > 2 * sizes[n]]
        if not over:
            return full | {n: level * weight[n] for n in free}
        full |= {n: 2 * sizes[n] for n in over}
        left, free = left - sum(2 * sizes[n] for n in over), free - set(over)
    return full


def brute_mix(rows, weight):
    """rows: (id, size, source) -> {id: copies}, {id: expected}; the whole draw in plain loops, ids distinct."""
    sizes = defaultdict(int)
    for _, n, source in rows:
        sizes[source] += n
    copies, expected = {i: 0 for i, *_ in rows}, {i: 0.0 for i, *_ in rows}
    for source, target in targets(sizes).items():
        own = [(i, n, 2.0 ** (np.floor(8 * np.log2(weight(i, n)) + 0.5) / 8)) for i, n, s in rows if s == source and n]
        low, high = 0.0, 1e9
        for _ in range(200):  # c by bisection
            c = (low + high) / 2
            low, high = (c, high) if sum(n * min(2, c * w) for _, n, w in own) < target else (low, c)
        ranked, gap = [], target
        for i, n, w in own:
            e = expected[i] = min(2.0, high * w)
            e = round(e, 9)
            copies[i] = int(e)
            gap -= int(e) * n
            u = (int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            if 0 < (chance := e - int(e)):
                ranked.append((u / (1 - u) / max(chance / (1 - chance), 1e-300), i, n))
        ranked.sort()
        after, most = -1, float("inf")
        for _ in range(mixing.ROUNDS):
            for at in range(after + 1, len(ranked)):
                _, i, n = ranked[at]
                if n > most:
                    continue
                if n > gap:
                    break
                copies[i] += 1
                gap -= n
                after = at
            most = gap
    return copies, expected


def test_mixing(spark, docs, odd, none):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 5}" if i % 11 else None) for i in range(2000)]
    for given in (rows, odd):
        found = mixing.mixed(make(spark, given)).collect()
        sizes, taken = defaultdict(int), defaultdict(int)
        for _, text, source in given:
            sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        for r in found:
            assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
            taken[r.source] += r.taken
        expected = targets(sizes)
        assert all(abs(r.target - expected[r.source]) < 1e-6 for r in found) and len(found) == len(given)
        if given is rows:
            assert all(abs(taken[s] - expected[s]) <= 40 for s in sizes)
            again = mixing.mixed(make(spark, given).repartition(7)).collect()
            assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)
            copies, chances = brute_mix([(i, 1 + i * 7 % 40, s) for i, _, s in given], lambda i, n: np.log2(n + 1.0))
            assert {r.doc_id: r.copies for r in found} == copies
            assert all(abs(r.expected - chances[r.doc_id]) < 1e-6 for r in found) and len({round(r.expected % 1, 3) for r in found}) > 10
            assert sorted(r.doc_id for r in mixing.mixed_documents(make(spark, given)).collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    assert mixing.mixed(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns


def test_mixing_equals_brute_force(spark):
    """The whole draw over the documents of sf0.001."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in docs.collect()]
    assert {r.doc_id: r.copies for r in mixing.mixed(docs).collect()} == brute_mix(given, lambda i, n: np.log2(n + 1.0))[0]


def test_mixing_cuts_large_sources(spark, monkeypatch):
    """Many rows of one id and text, and ranges cut down to few rows: near the target all the same."""
    monkeypatch.setattr(mixing, "SORTED", 8)
    rows = [(i if i % 3 else 7, "w " * (1 + i * 7 % 40 if i % 3 else 5), "s" if i % 4 else "t") for i in range(6000)]
    found = mixing.mixed(make(spark, rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(found) == 2 and all(abs(r.taken - r.target) <= 10 for r in found)


def test_pareto_inclusion_meets_its_chances(spark):
    """Over many draws (ids differ, all else is alike) documents of each weight are taken as often as expected."""
    draws = [(d * 1000 + k, "w " * 10, f"{d:03d}", float(1 + k % 4)) for d in range(60) for k in range(80)]
    docs = spark.createDataFrame(draws, "doc_id long, text string, source string, heavy double")
    found = mixing.mixed(docs, weights=(1,), share=0.9, weight="heavy").groupBy((F.col("doc_id") % 4).alias("k")).agg(F.avg("copies").alias("taken"), F.avg("expected").alias("expected")).collect()
    assert len(found) == 4 and len({round(r.expected, 3) for r in found}) == 4
    assert all(abs(r.taken - r.expected) < 0.04 for r in found)


def test_sharding(docs, odd, none, spark):
    found = sharding.sharded(docs).collect()
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert len(found) == len(odd) and all(sorted(v) == list(range(len(v))) for v in by.values())
    many = sharding.sharded(make(spark, [(i, "x" * (i * 37 % 500), "s") for i in range(20_000)]))
    loads = [r["sum(size)"] for r in many.groupBy("shard").sum("size").collect()]
    assert len(loads) == 16 and max(loads) < 1.01 * min(loads)
    assert sharding.sharded(none).count() == 0
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sharding_rebalances_few_bytes(spark):
    loads = spark.range(1000).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % 7 + 1).alias("bytes"))
    first = sharding.rebalanced(sharding.first_map(spark, 8, 1000), loads, 8)
    more = sharding.rebalanced(first, loads, 9)
    before, after = ({r.virtual_slot: r.shard for r in m.collect()} for m in (first, more))
    size = {r.virtual_slot: r.bytes for r in loads.collect()}
    moved = sum(size[s] for s in after if after[s] != before[s])
    assert after.keys() == before.keys() and moved < sum(size.values()) / 9 * 1.1 and set(after.values()) == set(range(9))
    assert {r.version for r in more.collect()} == {3}


def brute_shards(rows, shards=16, slots=4096):
    """rows: (id, text), ids distinct -> {id: (size, crc, shard, slot, virtual slot)}, in plain loops."""
    own = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), int(hashlib.md5(("null" if t is None else t).encode()).hexdigest()[:8], 16) % slots) for i, t in rows}
    load = defaultdict(int)
    for size, _, v in own.values():
        load[v] += size
    mean, loads, at, moving = sum(load.values()) / shards, [0] * shards, {}, []
    kept = [0] * shards
    for v in sorted(load, key=lambda v: (-load[v], v)):  # what a shard of version 1 keeps
        kept[v % shards] += load[v]
        if kept[v % shards] <= max(mean, load[v]):
            at[v] = v % shards
            loads[v % shards] += load[v]
        else:
            moving.append(v)
    for v in moving:
        to = loads.index(min(loads))
        at[v], loads[to] = to, loads[to] + load[v]
    found, following = {}, [0] * shards
    for i in sorted(own, key=lambda i: (own[i][2], i)):
        size, crc, v = own[i]
        found[i] = (size, crc, at[v], following[at[v]], v)
        following[at[v]] += 1
    return found


def test_sharding_equals_brute_force(spark):
    """The whole result on sf0.001."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot, r.virtual_slot) for r in sharding.sharded(docs).collect()}
    assert found == brute_shards([(r.doc_id, r.text) for r in docs.collect()])


def test_sharding_edits_the_stored_map(spark, tmp_path):
    """A second load of documents goes by the stored map: versions stay, few bytes move, records keep their slots."""
    at = str(tmp_path / "map")
    texts = [(i, "x" * (i * 37 % 500), "s") for i in range(9000)]
    sharding.stored(sharding.first_map(spark, 16), at)
    first = {r.doc_id: r for r in sharding.sharded(make(spark, texts[:6000]), map_at=at).collect()}
    second = {r.doc_id: r for r in sharding.sharded(make(spark, texts), map_at=at).collect()}
    assert {r.map_version for r in first.values()} == {2} and {r.map_version for r in second.values()} == {3}
    assert sorted(r.version for r in spark.read.parquet(at).select("version").distinct().collect()) == [1, 2, 3]
    assert all(first[i].virtual_slot == second[i].virtual_slot for i in first)
    assert sum(first[i].size for i in first if first[i].shard != second[i].shard) < 0.1 * sum(r.size for r in first.values())


def test_sharding_spreads_one_id(spark):
    """A third of the rows without an id, another third with one id: shards are near equal all the same."""
    rows = [((None, 5, i)[i % 3], "y" * 50 if i % 2 else "z" * (i % 90), "s") for i in range(30_000)]
    found = sharding.sharded(make(spark, rows)).groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    sizes = [r["size"] for r in found]
    assert len(found) == 16 and max(sizes) < 1.02 * min(sizes) and all(r.last == r.n - 1 for r in found)


def test_packing(docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    rows = packing.packed(docs.dropDuplicates(["doc_id"])).collect()
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    texts = {i: t for i, t, _ in odd}
    assert pieces.keys() == texts.keys()
    for i, own in pieces.items():
        ids, at = np.array(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for p in sorted(own, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.packed(none).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_are_those_of_the_library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(public_tokenizers.path(name)), packing.Tokens(public_tokenizers.path(name))
    texts = ["", " a  b\n\n c", "<|endoftext|> x", "x<|endoftext|><|startoftext|>y", "é ß 漢字 🙂  x\t", "don't I'LL we've 1234 #$%", "\u00a0\u3000 z", "long word " * 500]
    for text in texts:
        assert own.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing_gathers_close_documents(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = np.random.default_rng(2)
    common = ["".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(40)]
    topics = [["".join(chr(97 + x) for x in rng.integers(0, 26, 9)) for _ in range(5)] for _ in range(300)]
    texts = [" ".join([*rng.choice(common, 20), *rng.choice(topics[i % 300], 10)]) for i in range(2400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(8, "doc_id")
    tokens = packing.Tokens(path)
    ids = packing.tokenised(docs, path).cache()
    corpus = packing.counted(ids, tokens)
    assert corpus.n == 2400 and corpus.df.max() <= 2400
    blocks = defaultdict(set)
    rows = packing.gathered(ids, corpus, tokens.dtype).collect()
    for place, r in enumerate(rows):
        blocks[r.doc_id % 300].add(place // 300)
    assert sorted(r.doc_id for r in rows) == list(range(2400))
    assert np.mean([len(b) for b in blocks.values()]) < 3  # each topic's 8 documents come from 8 partitions


def brute_bm25(given, seed, df, n, mean):
    expected = np.zeros(len(given))
    for term in set(given[seed].tolist()):
        idf = np.log((n - df[term] + 0.5) / (df[term] + 0.5))
        for j, d in enumerate(given):
            tf = int((d == term).sum())
            if idf > 0:
                expected[j] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return expected


def test_bm25_scores():
    rng = np.random.default_rng(3)
    given = [rng.integers(0, 50, rng.integers(1, 60)).astype("<u4") for _ in range(40)]
    mean = np.mean([len(d) for d in given])
    df = np.array([sum(t in d for d in given) for t in range(50)])
    index = packing.Index(given, packing.Corpus(40, mean, df).idf, mean)
    for seed in (0, 7, 39):
        expected = brute_bm25(given, seed, df, 40, mean)
        assert np.allclose(index.scores(seed), expected, rtol=1e-5)
        unused = np.arange(40) % 3 > 0
        found = list(index.best(seed, unused))
        assert sorted(found) == np.flatnonzero(unused).tolist() and (np.diff(expected[found]) < 1e-4).all()


def test_windows_hold_the_best_unused_neighbours():
    """Each window against brute force: after its seed come the unused documents by BM25 score."""
    rng = np.random.default_rng(5)
    topics = [rng.integers(0, 400, 30) for _ in range(12)]
    given = [rng.choice(np.concatenate([topics[i % 12], rng.integers(0, 400, 10)]), rng.integers(20, 90)).astype("<u4") for i in range(150)]
    df, mean = np.array([sum(t in d for d in given) for t in range(400)]), np.mean([len(d) for d in given])
    units = [packing.Unit(i, d, 0) for i, d in enumerate(given)]
    sequences, left = packing.packed_shard(units, packing.Corpus(150, mean, df).idf, mean, 256)
    unused = set(range(150))
    for sequence in sequences:
        assert sum(n for _, _, n in sequence) == 256
        seed = sequence[0][0].doc_id
        unused.discard(seed)
        score = brute_bm25(given, seed, df, 150, mean)
        for u, start, n in sequence[1:]:
            assert start == 0 and score[u.doc_id] >= max(score[j] for j in unused) - 1e-3
            unused.discard(u.doc_id)
    assert unused == {u.doc_id for u in left} - {s[-1][0].doc_id for s in sequences[-1:]}


def test_syncmers(docs, odd, none, spark):
    unique = sorted({i: t or "" for i, t, _ in odd if i is not None}.items())
    found = {r.doc_id: r for r in syncmers.fingerprinted(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    for k, (i, text) in enumerate(unique):
        after, r = unique[(k + 1) % len(unique)][1], found[i]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, other, following = (syncmers.fingerprints([x])[0] for x in (text, edited, after))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (syncmers.as_string(own), syncmers.as_string(other))
        assert (r.near_edited, r.near_next) == (syncmers.likeness(own, other), syncmers.likeness(own, following))
    assert syncmers.fingerprinted(none).count() == 0


def test_syncmers_are_closed_and_context_free():
    text = "".join(chr(97 + x) for x in np.random.default_rng(5).integers(0, 26, 400))

    def hashed(x, n):
        return int(syncmers.mix64(syncmers._mers(np.array([ord(c) + 1 for c in x], np.uint64), n))[0])

    expected = set()
    for i in range(len(text) - syncmers.K + 1):
        mer = text[i : i + syncmers.K]
        inner = [hashed(mer[j : j + syncmers.S], syncmers.S) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            expected.add(hashed(mer, syncmers.K) >> 32)
    assert set(syncmers.fingerprints([text])[0].anchors.tolist()) == set(sorted(expected)[: syncmers.KEPT])
    long = "".join(chr(97 + x) for x in np.random.default_rng(6).integers(0, 26, 60_000))
    kept = syncmers.fingerprints([long])[0].anchors
    assert len(kept) > 5 * syncmers.KEPT and kept.max() < (1 << 32) // syncmers.SAMPLED
    passage = long[20_000:26_000]
    other = "".join(chr(97 + x) for x in np.random.default_rng(7).integers(0, 26, 40_000)) + passage
    assert syncmers.likeness(*syncmers.fingerprints([long, other])) > 0.03  # 6,000 of 100,000 characters are shared
    assert syncmers.likeness(*syncmers.fingerprints([text, text[:300] + "x" * 100])) > 0.6


def test_html(spark):
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a>menu</a></nav><div class='box'>Site &amp; motto</div><article><h1>Head</h1><p>One&nbsp;<b>two</b>\n three<p>four %d<div class='ad'>buy</div></article><div class='comments'>no</div><footer>f</footer></body></html>"
    rows = [(i, "http://h/%d" % i, page % i, "x") for i in range(6)] + [(6, None, None, "x"), (7, "u", "", "x"), (7, "u", "", "x"), (8, "http://other/", "plain &lt;text", "x"), (9, "http://o", "<p>cut <b", "x")]
    found = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    texts = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert [texts[i] for i in range(6)] == [f"Head One two three four {i}" for i in range(6)]
    assert (texts[6], texts[7], texts[8], texts[9]) == ("", "", "plain <text", "cut")
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_is_found_without_marks(spark):
    body = "<body><div><span>Our site</span><span>since 1990</span></div><div><p>story %d</p></div></body>"
    rows = [(i, f"http://h/{i}", body % i) for i in range(8)]
    found = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in found) == [f"story {i}" for i in range(8)]


def test_skeletons_are_template_without_lists(spark):
    """Bare divs whose text differs from page to page: only their recurring place outside the densest part tells menus and footers."""
    page = "<body><div><div><a href='/%d'>menu %d</a></div></div><div><div>Story %d</div><div>%s</div></div><div>Seen by %d people</div></body>"
    rows = [(i, f"http://h/{i}", page % (i, i, i, f"long text {i} " * 20, i)) for i in range(12)]
    rows += [(100 + i, "http://small/", page % (i, i, i, f"long text {i} " * 20, i)) for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html.extracted(pages, lists=False).collect()}
    assert all(found[i] == f"Story {i} " + " ".join([f"long text {i}"] * 20) for i in range(12))
    assert found[100].startswith("menu 0 Story 0")  # too few pages to tell


def test_template_decides_on_whole_table(spark):
    """Over all pages of sf0.01, with the lists off: the template alone changes every text, to what the lists give too."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    both, alone, none = ({r.page_id: r.text for r in html.extracted(pages, **k).collect()} for k in ({}, {"lists": False}, {"lists": False, "least": 1 << 30}))
    hosts = Counter(re.sub(r"^[^/]*//([^/]*).*", r"\1", r.url) for r in pages.collect())
    judged = [r.page_id for r in pages.collect() if hosts[re.sub(r"^[^/]*//([^/]*).*", r"\1", r.url)] >= 8]
    assert len(judged) > 20 and all(alone[i] != none[i] for i in judged)
    assert np.mean([alone[i] == both[i] for i in judged]) > 0.95


def test_very_long_page(spark):
    long = "<html><body><nav>menu</nav><article>" + "<p>many words here</p>" * 60_000 + "</article></body></html>"
    pages = [(10_000, "http://h/1", long), (10_001, None, None)]
    found = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == {10_000: " ".join(["many words here"] * 60_000), 10_001: ""}


def test_copies_of_a_page_are_no_template(spark):
    pages = ["<body><div><p>Only page %s</p><ul><li>text %s</li></ul></div></body>" % (k, k) for k in "abcde"]
    rows = [(i, "http://h/%d" % i, pages[max(0, i - 7)]) for i in range(12)]
    found = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {i: "Only page {0} text {0}".format("abcde"[max(0, i - 7)]) for i, _, _ in rows}


def test_template_of_a_part_of_a_large_host(spark):
    box = "<div class='x'>Members of this part</div>"
    rows = [(i, "http://h/%d" % i, "<body>%s<article><p>Text %d</p>%s</article></body>" % (box if i % 3 == 0 else "", i, box if i % 3 == 0 else "")) for i in range(120)]
    found = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {i: "Text %d" % i for i in range(120)}


@pytest.fixture(scope="session")
def labelled(spark):
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(900):
        toxic, good = i % 5 == 0, i % 3 != 0
        words = [f"word{x}" for x in rng.integers(0, 200, 60)]
        if toxic:
            words[7] = "nastyword"
        text = ". ".join(" ".join(words[j : j + 12]).capitalize() for j in range(0, 60, 12)) + "." if good else "\n".join("$$ " * 9 + "12345 12345 12345" for _ in range(5)) + (" nastyword" if toxic else "")
        rows.append((i, text, "s"))
        labels.append((i, int(good), int(toxic)))
    return make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, docs, odd, none, labelled, operator, label):
    given, labels = labelled
    model = operator.fitted(given, labels)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [r for r in operator.scored(given, model).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.predicted == int(r.score >= operator.THRESHOLD) and 0 <= r.score <= 1 for r in held)
    scored = operator.scored(docs, model).collect()
    assert len(scored) == len(odd) and all(0 <= r.score <= 1 for r in scored)
    assert operator.scored(none, model).count() == 0
    untaught = operator.fitted(given, labels.where("false"))
    assert operator.scored(docs, untaught).count() == len(odd)


def test_quality_learns_from_whole_documents(spark):
    rng = np.random.default_rng(11)

    def lines(n, junk):
        return "\n".join(" ".join(rng.choice(["#$%", "&&", "x9x9", "=="] if junk else ["The", "river", "runs", "slowly", "there"], 8)) + ("" if junk else ".") for _ in range(n))

    texts = [lines(600, False) + "\n" + lines(600, i % 2 == 1) for i in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(24)], "doc_id long, quality int")
    found = quality.fitted(docs, labels).score(texts) >= 0.5
    assert found.tolist() == [i % 2 == 0 for i in range(24)]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    logit, transition = rng.normal(size=4), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(4)
    for code in range(16):
        y = [code >> k & 1 for k in range(4)]
        p = np.exp(sum(logit[k] * y[k] for k in range(4)) + sum(transition[y[k], y[k + 1]] for k in range(3)))
        total += p
        good += p * np.array(y)
    assert np.allclose(quality.marginals(logit, np.array([0, 4]), transition)[0], good / total)


def test_factorization_machine_sums_pairs():
    rng = np.random.default_rng(4)
    m = toxicity.FactorizationMachine({}, 0.3, rng.normal(size=5), rng.normal(size=(5, toxicity.FACTORS)))
    expected = 0.3 + m.weights[[0, 2, 4]].sum() + sum(m.factors[a] @ m.factors[b] for a, b in combinations((0, 2, 4), 2))
    assert np.allclose(m.logits(np.array([0, 2, 4]), np.array([0, 3, 3])), [expected, 0.3])


def test_language(spark, docs, odd, none):
    texts = {"en": "the cat and the other thing with which they were", "de": "der Hund und das andere nicht mit welchem sie waren"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(texts[lang].split())), lang) for i in range(200) for lang in (("en", "de")[i % 2],)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fitted(given)
    assert all(r.lang_pred == rows[r.doc_id][2] for r in language.identified(given, model).collect())
    found = language.identified(docs, model).collect()
    assert len(found) == len(odd) and {r.doc_id: r.lang_pred for r in found}[1] == "und" == {r.doc_id: r.lang_pred for r in found}[3]
    assert language.identified(none, model).count() == 0
    assert {r.lang_pred for r in language.identified(given, language.fitted(none)).collect()} == {"und"}


def test_jaccard_equals_its_sql(spark):
    import duckdb

    from tomeflow.llm import queries

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    found = queries.op1_ngram_jaccard_join(spark, "/root/testdata/sf0.001").select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(queries.ORACLES["op1_ngram_jaccard_join"]).fetchall())


def test_pairs_decide_where_a_linear_model_fails(spark):
    """a with b and c with d are toxic, a with d and c with b aren't: no sum of four weights says so."""
    rng = np.random.default_rng(12)
    kinds = [("alba", "brom", 1)] * 200 + [("cero", "dulo", 1)] * 200 + [("alba", "dulo", 0)] * 100 + [("cero", "brom", 0)] * 100 + [("", "", 0)] * 400
    rows, labels, terms = [], [], []
    for i, (x, y, toxic) in enumerate(kinds):
        rows.append((i, " ".join(rng.permutation([x, y, *(f"w{v}" for v in rng.integers(0, 50, 8))]))))
        labels.append((i, toxic))
        terms.append([w in (x, y) for w in ("alba", "brom", "cero", "dulo")])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fitted(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [r for r in toxicity.scored(docs, model).collect() if r.held_out]
    assert len(held) > 200 and np.mean([r.predicted == labels[r.doc_id][1] for r in held]) > 0.98
    x, y, w = np.hstack([np.array(terms, float), np.ones((len(terms), 1))]), np.array([v for _, v in labels]), np.zeros(5)
    for _ in range(500):
        w += 0.5 * x.T @ (y - 1 / (1 + np.exp(-x @ w))) / len(y) * 5
    assert max(np.mean((x @ w > t) == y) for t in np.linspace(-9, 9, 200)) < 0.92


def labelled_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), {r.doc_id: r.text or "" for r in docs.collect()}


def test_toxicity_equals_brute_force(spark):
    """Every score of sf0.001 again, by loops over words and pairs of terms, from the fitted numbers."""
    docs, labels, texts = labelled_tables(spark)
    m = toxicity.fitted(docs, labels)
    for r in toxicity.scored(docs, m).collect():
        known = {m.slots[s] for token in texts[r.doc_id].lower().split() for s in toxicity.term_slots(token) if s in m.slots}
        logit = m.bias + sum(m.weights[k] for k in known) + sum(float(m.factors[a] @ m.factors[b]) for a, b in combinations(sorted(known), 2))
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(logit, -35, 35)))) < 1e-9 and r.predicted == int(r.score >= 0.7)


def brute_line(line):
    """A line's features, by loops over its characters and words."""
    letters = [c for c in line]
    upper = sum(c.isupper() for c in letters)
    lower = sum(c.isalpha() and not c.isupper() for c in letters)
    digit = sum(c.isdigit() and not c.isalpha() for c in letters)
    space = sum(c.isspace() for c in letters)
    symbol = len(letters) - upper - lower - digit - space
    words = line.split()

    def is_symbol(c):
        return not (c.isalpha() or c.isupper() or c.isdigit() or c.isspace())

    n, size = max(len(words), 1), max(len(letters), 1)
    return [
        np.log1p(len(letters)) / 5, upper / max(upper + lower, 1), symbol / size, digit / size, space / size,
        sum(len(w) == 1 and is_symbol(w) for w in words) / n, sum(len(w) > 1 and is_symbol(w[-1]) and is_symbol(w[-2]) for w in words) / n,
        sum(a == b for a, b in zip(words[1:], words, strict=False)) / n, 1 - len(set(words)) / n, min((len(letters) - space) / n, 40) / 10,
        float(letters[-1] in ".!?\u2026\u3002"), float(letters[0].isupper()), np.log1p(len(words)) / 5,
    ]


def test_quality_equals_brute_force(spark):
    """Every score of sf0.001 again: features by loops, marginals by forward and backward sums of one chain, from the fitted numbers."""
    docs, labels, texts = labelled_tables(spark)
    m = quality.fitted(docs, labels)
    w, t = m.field.emission, m.field.transition
    for r in quality.scored(docs, m).collect():
        lines = [x for x in texts[r.doc_id].split("\n") if x.split()]
        f = [(np.array(brute_line(x)) - m.field.centre) / m.field.scale for x in lines]
        none = np.zeros(quality.OWN)
        e = [float(np.concatenate([f[i], f[i - 1] if i else none, f[i + 1] if i + 1 < len(f) else none, [1]]) @ w) for i in range(len(f))]
        forward, backward = [[0.0, e[0]]], [[0.0, 0.0]]
        for x in e[1:]:
            forward.append([np.logaddexp(forward[-1][0] + t[0, k], forward[-1][1] + t[1, k]) + k * x for k in (0, 1)])
        for x in e[:0:-1]:
            backward.insert(0, [np.logaddexp(t[k, 0] + backward[0][0], t[k, 1] + x + backward[0][1]) for k in (0, 1)])
        good = [1 / (1 + np.exp(forward[i][0] + backward[i][0] - forward[i][1] - backward[i][1])) for i in range(len(e))]
        share = np.average(good, weights=[len(x) for x in lines])
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(m.field.slope * share + m.field.offset, -35, 35)))) < 1e-6


def test_blank_texts_are_of_low_quality(spark, labelled):
    given, labels = labelled
    for model in (quality.fitted(given, labels), quality.fitted(given, labels.where("false"))):
        assert (model.score([None, "", " \n\t\n"]) < 0.5).all()


def test_language_equals_brute_force(spark):
    """Every prediction of sf0.001 again: counts of whole n-grams in dicts, without hashing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()

    def grams(text):
        clean = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        clean = re.sub(" +", " ", clean).lstrip()
        return [clean[i : i + n] for n in language.ORDERS for i in range(len(clean) - n + 1)]

    counts, n = defaultdict(Counter), Counter()
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts[r.lang].update(grams(r.text))
            n[r.lang] += 1
    totals = {k: sum(v.values()) + 0.5 * language.DIMS for k, v in counts.items()}
    found = {r.doc_id: r for r in language.identified(docs, language.fitted(docs)).collect()}
    for r in rows:
        own = grams(r.text)
        score = {k: sum(np.log((counts[k][g] + 0.5) / totals[k]) for g in own) + np.log(n[k] / sum(n.values())) for k in counts}
        top = sorted(score.values())[-2:]
        if top[1] - top[0] > 0.5:  # hashing moves close calls
            assert found[r.doc_id].lang_pred == max(score, key=score.get)


def test_rare_ideographs_are_letters():
    from tomeflow.llm.common import LOWER, char_classes

    assert char_classes(np.array([0x30000, 0x31350], np.uint32)).tolist() == [LOWER, LOWER]
