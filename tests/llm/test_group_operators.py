"""SimHash, decontamination, embeddings, WARC, components and the pipeline: cases and brute force."""

import gzip
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickbasin.llm import balls, common, decontaminate, embeddings, pii, quality, queries, simhash, tokens, warc


def classes(n, pairs):
    """Smallest reachable member of each of range(n)."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(500 + k, 501 + k) for k in range(60)] + [(700, 700 + k) for k in range(1, 50)]
    df = spark.createDataFrame([*pairs, *pairs[:5], (None, 3), (9, 9)], "a long, b long")
    want = classes(800, pairs)
    got = {r.id: r.component for r in common.connected_components(df).collect()}
    assert got == {x: want[x] for p in pairs for x in p if p[0] != p[1]}
    assert common.connected_components(df.limit(0)).count() == 0


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(8)
    texts = ["", " \n", "one", "one Two", "A b c", "É ß\x0bü\x85x y", "x " * 100_000] + [" ".join(rng.choice("the a of Tree ÄPFEL x1".split()) for _ in range(rng.randint(1, 60))) for _ in range(100)]
    for t in texts:
        assert simhash.fingerprint(t) & (2**64 - 1) == slow_fingerprint(t)


def test_buckets_find_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (30, 2)).astype(np.uint64), axis=1) for b in base]))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= simhash.DISTANCE
    want = classes(len(fps), list(zip(*np.nonzero(near), strict=True)))
    assert simhash.bucket_components(fps).tolist() == want


def test_bucket_masks():
    """Each pair at two bits or fewer shares a bucket of every kind of split, and the last ones hold 256 fingerprints at most."""
    masks = np.array(simhash.MASKS).view(np.uint64)
    bits = np.bitwise_count(masks)
    assert len(masks) == 258 and set(bits[:6]) == {32} and set(bits[6:42]) == {48} and set(bits[42:]) == {56}
    for a, b in itertools.combinations_with_replacement(range(64), 2):
        change = np.uint64((1 << a) | (1 << b))
        shared = [k for k in range(6) if not masks[k] & change]
        assert shared
        for level in (6, 42):
            for k in shared:
                assert any(not masks[6 * k + 6 + j] & change for j in range(6)) and all(masks[k] & masks[6 * k + 6 + j] == masks[k] for j in range(6))
            shared = [6 * k + 6 + j for k in shared for j in range(6) if not masks[6 * k + 6 + j] & change]


def test_hot_bucket_of_fingerprints(spark):
    """200,000 fingerprints that share a pair of quarters: split to bounded buckets, all links kept, in bounded time."""
    rng = np.random.default_rng(6)
    low = rng.choice(1 << 32, 200_000, replace=False).astype(np.uint64)
    fps = low | np.uint64(0x1234_5678 << 32)
    df = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64), "rep": np.arange(len(fps))}))
    began = time.perf_counter()
    rows, _ = common.written(simhash.split_buckets(df), "t")
    assert rows.groupBy("kind", "part").count().agg(F.max("count")).first()[0] <= simhash.LARGE_BUCKET
    links = {(r.a, r.b) for r in rows.repartition(8, "kind", "part").mapInPandas(simhash.bucket_links, "a long, b long").collect()}
    assert time.perf_counter() - began < 120
    index = {int(x): k for k, x in enumerate(low)}
    flips = [1 << a | 1 << b for a in range(32) for b in range(a + 1)]
    pairs = {(k, index[int(low[k]) ^ f]) for k in range(0, 200_000, 40) for f in flips if int(low[k]) ^ f in index}
    root = classes(len(fps), links)
    assert len(pairs) > 20 and all(root[a] == root[b] for a, b in pairs)


@pytest.mark.parametrize("small", [False, True])
def test_simhash_against_brute_force(spark, monkeypatch, small):
    if small:  # every bucket of more than two is split, twice
        monkeypatch.setattr(simhash, "LARGE_BUCKET", 2)
    rng = random.Random(21)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(40):
        text = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 5)):
            copy = list(text)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, "same same"), (903, "same same"), (903, "same same")]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, fp string, rep int")
    assert len(rows) > 100
    prints = [slow_fingerprint(t or "") for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 2]
    want = {rows[k][0]: rows[c][0] for k, c in enumerate(classes(len(rows), pairs))}
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    assert sorted(r.fingerprint for r in got) == sorted(f"{p:016x}" for p in prints)


def test_simhash_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (None, "lone text of null id"), (7, "one text here"), (7, "quite another text there")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted([(None, 3), (5, 3), (3, 3), (None, None), (7, 7), (7, 7)], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df).count() == 5


def test_simhash_very_long_texts(spark):
    """Texts of megabytes, and a word of a megabyte, have the fingerprint of the whole and meet their near copies."""
    rng = random.Random(77)
    words = [f"w{rng.randrange(50_000)}" for _ in range(150_000)]
    near = [*words[:-1], "changed"]
    texts = [" ".join(words), "\n".join(words), " ".join(near), "x" * 1_000_000, " ".join(reversed(words))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert [got[k][0] for k in (0, 2, 3)] == [f"{slow_fingerprint(texts[k]):016x}" for k in (0, 2, 3)]
    assert got[0] == got[1] and got[3][1] == 3 and got[4][1] == 4
    apart = (int(got[0][0], 16) ^ int(got[2][0], 16)).bit_count()
    assert (got[2][1] == 0) == (apart <= 2)


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("together", [8192, 6])
def test_near_copies_against_brute_force(spark, monkeypatch, together):
    """Pairs well above the similarity link, pairs well below do not; copies of a base link through it."""
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rng = random.Random(31)
    words = [f"w{k}" for k in range(2000)]
    texts = []
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4]) * len(base) // 150):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(900, None, "c"), (901, " ", "c"), (None, texts[0], "c"), (0, texts[0], "c")], "doc_id long, text string, gone string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    like = {(a, b): jaccard(texts[a], texts[b]) for a in range(len(texts)) for b in range(a)}
    sure = classes(len(texts), [p for p, j in like.items() if j >= 0.86])
    most = classes(len(texts), [p for p, j in like.items() if j >= 0.7])
    assert all(got[a] == got[b] for (a, b), j in like.items() if sure[a] == sure[b]) and all(most[a] == most[b] for a, b in like if got[a] == got[b])
    assert got[901] == 900 and got[None] == got[0]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([*{k for k, v in got.items() if k == v and k is not None}, None, 0], key=repr)


def test_near_copies_share_a_band():
    """Of pairs at the similarity itself nearly all share a band, and the fingerprints measure it."""
    rng = random.Random(2)
    met, bits = 0, []
    for _ in range(150):
        common_part = [f"c{rng.random()}" for _ in range(400)]
        a, b = (" ".join([*common_part, *(f"o{rng.random()}" for _ in range(49))]) for _ in range(2))
        assert 0.79 < jaccard(a, b) < 0.81
        (f, keys), (g, others) = simhash.long_fingerprint(a), simhash.long_fingerprint(b)
        met += bool(set(keys.tolist()) & set(others.tolist()))
        bits.append(bin(int.from_bytes(f) ^ int.from_bytes(g)).count("1"))
    assert met >= 147 and abs(np.mean(bits) - simhash.most_bits()) < 4


def test_near_copies_by_any_texts_keys(spark, monkeypatch):
    """Texts of one fingerprint and different keys: each one's keys find links."""
    size = simhash.LONG // 8

    def made(text):
        import numpy as np

        group, _, number = text.partition(" ")
        base = bytearray(size)
        base[0] = {"a": 0, "b": 1, "c": 3, "far": 0}[group]
        if group == "far":
            base[:] = bytes([255]) * len(base)
        return bytes(base), np.array([int(x) for x in number.split(",")] * 4, dtype=np.int64)

    monkeypatch.setattr(simhash, "long_fingerprint", made)
    texts = ["a 1,2,3", "a 4,5,6", "a 7,8,9", "b 9,10,11", "c 5,20,21", "far 1,4,9", "a 4,5,6"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 0}


def test_near_copies_recall_by_similarity():
    """Share of single pairs that share a band and are measured as near enough, by their similarity."""
    rng = random.Random(12)
    found = {}
    for own, place in ((26, 0.88), (37, 0.84), (49, 0.8), (70, 0.74), (100, 0.67)):
        hits = 0
        for _ in range(120):
            common_part = [f"c{rng.random()}" for _ in range(400)]
            a, b = (" ".join([*common_part, *(f"o{rng.random()}" for _ in range(own))]) for _ in range(2))
            (f, keys), (g, others) = simhash.long_fingerprint(a), simhash.long_fingerprint(b)
            near = bin(int.from_bytes(f) ^ int.from_bytes(g)).count("1") <= simhash.most_bits()
            hits += near and bool(set(keys.tolist()) & set(others.tolist()))
        found[place] = hits / 120
    assert found[0.88] >= 0.97 and found[0.84] >= 0.8 and 0.3 < found[0.8] < 0.7 and found[0.74] < 0.2 and found[0.67] == 0


def agreement(doc, item):
    """Largest agreement of a stretch of the item over all shifts."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    d, b = cut(doc), cut(item)
    w = min(len(b), decontaminate.STRETCH)
    best = 0
    for shift in range(-len(b) + 1, len(d)):
        same = [0 <= shift + j < len(d) and d[shift + j] == b[j] for j in range(len(b))]
        best = max(best, max(sum(same[k : k + w]) for k in range(len(b) - w + 1)))
    return best, w


def test_decontamination_against_brute_force(spark):
    rng = random.Random(17)
    words = [f"w{k}" for k in range(500)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([6, 9, 15, 30, 45])))) for k in range(12)] + [(50, "too short"), (51, None), (52, ""), (60, None), (70, "one two three"), (71, "w9"), (72, "two of four words")]
    items[15] = (60, items[3][1].upper() + "!")  # equal tokens: named by item 3
    docs = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if k % 2:
            passage = items[rng.randrange(12)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                passage[rng.randrange(len(passage))] = rng.choice(words)
            cut = rng.randint(0, len(text))
            text[cut:cut] = passage[rng.choice([0, 0, 3]) :]
        docs.append((k, " ".join(text)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[1][1]), (None, items[2][1]), (103, "x, " * 30_000 + items[4][1].replace(" ", " - "))]
    docs += [(110, "Too short!"), (111, "it is too short"), (112, "w9"), (113, "w9 w9"), (114, "and one, two three"), (115, "one two or three"), (116, "two of four words more"), (117, "two of four word")]
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, item_id int, tokens string")
    bench = spark.createDataFrame([(*b, 2) for b in items], "item_id long, text string, id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    want = {(103, 4)}
    for doc, text in docs:
        for item, b in items:
            n = len((b or "").split())
            if item == 60 or not n or len((text or "").split()) > 10_000:
                continue
            if n < 3:
                if (text or "").lower().strip("!") == b:
                    want.add((doc, item))
                continue
            have, of = agreement(text, b)
            if have >= math.ceil(0.8 * of):
                want.add((doc, item))
    assert got == want and {(110, 50), (112, 71), (114, 70), (116, 72), (102, 0), (102, 1), (None, 2)} <= want
    kept = decontaminate.decontaminate(df.unionByName(df.limit(0)), bench)
    assert kept.columns == df.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, (d for d, _ in docs if d not in {d for d, _ in got})))
    mixed = spark.createDataFrame([(None, items[2][1]), (None, "a clean text"), (7, items[2][1]), (7, "another clean text")], "doc_id long, text string")
    assert sorted(r.text for r in decontaminate.decontaminate(mixed, bench).collect()) == ["a clean text", "another clean text"]
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0 and decontaminate.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_decontamination_keeps_clashing_columns(spark):
    passage = "eight words of one passage that is held"
    names = ["gone", "key", "gone_id", "gone_hash", "hit", "tokens", "Gone_", "text_hash", "of", "item_id", "n"]
    df = spark.createDataFrame([(1, passage, *"abcdefghijk"), (2, "clean text", *"bcdefghijkl"), (2, "clean text", *"bcdefghijkl"), (3, None, *[None] * 11)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in df.where("doc_id > 1").collect())
    assert [r.doc_id for r in decontaminate.contaminated(df, bench).collect()] == [1]


def test_decontamination_of_repetitive_texts(spark):
    """One token 20,000 times against an item of 100 of it, and a long period: every shift is verified once."""
    bench = spark.createDataFrame([(1, "x " * 100), (2, "a b c " * 40), (3, "x " * 15 + "y " * 15)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 20_000), (2, "a b c " * 5_000), (3, "x " * 10_000 + "y " * 10_000), (4, "x y " * 300)], "doc_id long, text string")
    decontaminate.contaminated(docs.limit(1), bench.limit(1)).collect()  # compiles
    began = time.perf_counter()
    got = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect())
    assert time.perf_counter() - began < 20
    assert got == [(1, 1, 20, 20, 0), (2, 2, 20, 20, 0), (3, 1, 20, 20, 0), (3, 3, 20, 20, 9985)]


def test_seeds_hit_every_admitted_overlap():
    """For each length, every choice of as many replaced tokens as the share admits leaves a seed untouched."""
    for n in range(1, decontaminate.STRETCH + 1):
        replaced = n - math.ceil(n * decontaminate.SHARE)
        places = [sum(1 << k for k, c in enumerate(seed) if c == "1") << at for seed in decontaminate.seeds_for(n) for at in range(n - len(seed) + 1)]
        for gone in itertools.combinations(range(n), replaced):
            bits = sum(1 << k for k in gone)
            assert any(not bits & p for p in places), (n, gone)


def test_decontamination_of_short_items(spark):
    words = [f"u{k}" for k in range(60)]
    items = [(1, words[:7], (3,)), (2, words[10:20], (4, 5)), (3, words[20:35], (4, 7, 10)), (4, words[40:52], (2, 6)), (5, words[52:56], ()), (6, words[56:59], ())]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w, _ in items], "item_id long, text string")
    docs = []
    for k, w, gone in items:
        near = ["new" if j in gone else x for j, x in enumerate(w)]
        far = ["new" if j in (*gone, len(w) - 1) else x for j, x in enumerate(w)]
        docs += [(k, "before it " + " ".join(near) + " and after"), (100 + k, "before it " + " ".join(far) + " and after")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.matched, r.stretch, r.position) for r in got) == [(k, k, len(w) - len(g), len(w), 2) for k, w, g in items]


def test_decontamination_is_native(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = decontaminate.contaminated(df, df.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def brute_links(rows):
    """n_links and components of (id, vector, label)."""
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            (_, v, l1), (_, w, l2) = rows[a], rows[b]
            if l1 is None or l1 != l2 or embeddings.usable(v, False) is None or embeddings.usable(w, False) is None or len(v) != len(w):
                continue
            x, y = np.array(v, dtype=np.float64), np.array(w, dtype=np.float64)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                pairs.append((a, b))
    n = [0] * len(rows)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    return n, classes(len(rows), pairs)


def vectors(rng, groups, dim=32):
    out = []
    for g in range(groups):
        center = rng.standard_normal(dim)
        spread = rng.choice([0.0, 0.02, 0.15, 0.3])
        for _ in range(int(rng.integers(1, 12))):
            out.append(((center + spread * rng.standard_normal(dim)) * rng.uniform(0.5, 3)).astype(np.float32).astype(float).tolist())
    return out


@pytest.mark.parametrize("cell", [8192, 200])
def test_embeddings_against_brute_force(spark, monkeypatch, cell):
    """With a small cell the top levels deal the classes to many cells, and recall is measured."""
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "LEAF", 24)
    rng = np.random.default_rng(3)
    vs = vectors(rng, 70)
    rows = [(k, v, int(k % 2 == 0 or k > 200)) for k, v in enumerate(vs)]
    rows += [(len(rows) + k, vs[0], 1) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    n, component = brute_links(rows)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    links = sum(got[k].n_links for k in range(len(rows)))
    assert all(got[k].n_links <= n[k] for k in range(len(rows))) and links >= (0.99 if cell > 1000 else 0.9) * sum(n)
    if cell > 1000:
        assert [got[k].component_id for k in range(len(rows))] == component
    assert all(got[k].kept == (got[k].component_id == k) for k in range(len(rows)))


def test_dense_groups_keep_all_links(spark, monkeypatch):
    """Groups of near copies far larger than a cell: exact links, balls, rims around them and other balls near."""
    monkeypatch.setattr(embeddings, "CELL", 85)
    monkeypatch.setattr(embeddings, "LEAF", 40)
    monkeypatch.setattr(balls, "BLOCK", 16)
    rng = np.random.default_rng(12)
    center = rng.standard_normal(32)
    other = center + 0.35 * rng.standard_normal(32)
    vs = [center + 0.03 * rng.standard_normal(32) for _ in range(150)] + [other + 0.05 * rng.standard_normal(32) for _ in range(90)]
    vs += [center + s * rng.standard_normal(32) for s in (0.2, 0.3, 0.4, 0.5) for _ in range(12)] + [rng.standard_normal(32) for _ in range(60)]
    rows = [(k, v.astype(np.float32).astype(float).tolist(), 1) for k, v in enumerate(vs)]
    rows += [(1000, rows[0][1], 1), (1001, rows[-1][1], 1), *[(2000 + k, r[1], 2) for k, r in enumerate(rows[:20])]]
    n, component = brute_links(rows)
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[r[0]].n_links <= n[k] for k, r in enumerate(rows))
    assert all(got[rows[k][0]].n_links == n[k] for k in range(150)) and sum(r.n_links for r in got.values()) >= 0.97 * sum(n)
    assert all(got[rows[k][0]].component_id == rows[component[k]][0] for k in range(240))


def test_embedding_cases(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0]
    rows = [(1, one, 1), (2, [2.0, 0.0], 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 0.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (2, [2.0, 0.0], 1), (None, one, 1), (12, [1e30, 1e28], 1), (13, [-1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, key string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=repr)
    assert len(got) == len(rows)
    by_id = {g[0]: g[1:] for g in got if g[0] not in (2, None)}
    assert by_id[1] == (3, 1, True) and by_id[12] == (3, 1, False) and [g for g in got if g[0] == 2] == [(2, 3, 1, False)] * 2
    assert all(by_id[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11, 13))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_doubles(spark):
    """Components beyond 32-bit floats count, and rows of a null id count links but are none."""
    rows = [(1, [1e300, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1e-60, 0.0], 1), (4, [1e300, 1e300], 1), (5, [0.0, 5e-324], 1), (6, [0.0, 7.0], 1), (None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [3.0, -3.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect() if r.vec_id}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), 5: (1, 5, True), 6: (1, 5, False)}
    nulls = [(r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect() if r.vec_id is None]
    assert sorted(nulls) == [(0, None, False), (3, None, False), (3, None, False)]


def test_recall_beyond_a_cell(spark):
    """Production constants, labels larger than a cell: small groups around the threshold, and a loose group of two cells' size."""
    rng = np.random.default_rng(8)
    noise = lambda n: rng.standard_normal((n, 64)) / 8
    small = np.concatenate([noise(1) + 0.25 * noise(8) for _ in range(1500)])
    loose = np.concatenate([noise(1) + 0.23 * noise(12_000), noise(3000)])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(27_000), "embedding": np.concatenate([small, loose]).astype(np.float32).tolist(), "label": [1] * 12_000 + [2] * 15_000}), "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicates(df).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    for x, found in ((small, got[:12_000]), (loose, got[12_000:])):
        unit = x.astype(np.float32).astype(float)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        want = np.concatenate([(unit[k : k + 1000] @ unit.T >= embeddings.THRESHOLD).sum(axis=1) - 1 for k in range(0, len(unit), 1000)])
        assert (found <= want + 1).all() and found.sum() > 0.97 * want.sum() > 10_000


@pytest.mark.parametrize("size, noise, others", [(4000, 0.055, 0), (8000, 0.055, 0), (6000, 0.23, 2000)])
def test_cells_of_one_group_are_whole(size, noise, others):
    """A cell that is mostly one tight or loose group, at the production constants."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal(64) / 8 + noise * rng.standard_normal((size, 64)) / 8, rng.standard_normal((others, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sum(int((unit[k : k + 1000] @ unit.T >= embeddings.THRESHOLD).sum()) for k in range(0, len(unit), 1000)) - len(unit)
    assert want > size * size / 2 and abs(int(embeddings.compare_cell(unit).sum()) - want) <= 4  # a pair may lie on the threshold to the last bit


def test_first_shared_cell_counts_every_pair():
    """Of two overlapping cells of one dense group the first counts the shared pairs, so no linked row is left without links."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal(64) / 8 + 0.055 * rng.standard_normal((3000, 64)) / 8
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = np.zeros(3000, dtype=np.int64)
    first, second = np.arange(2400), np.arange(600, 3000)
    links[first] += embeddings.compare_cell(unit[first]).sum(axis=1)
    later = embeddings.compare_cell(unit[second])
    later[np.ix_(second < 2400, second < 2400)] = False
    links[second] += later.sum(axis=1)
    assert set(links[:600]) == set(links[2400:]) == {2399} and set(links[600:2400]) == {2999}


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é€ long enough to be revisited " + "x" * 100
    pages = [(3, "http://a/3", long), (1, "http://a/1\r\nX: y", long), (2, None, long), (4, "http://a/4", "short"), (5, "http://a/5", "short"), (6, "u", None), (7, "u", ""), (8, "u", "tricky\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "y" * 100), (9, "u", "z" * 99), (10, "u", "z" * 99), (11, "u", "z" * 100), (12, "u", "z" * 100)]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(pages)
    for page, _, text in pages:
        data = (text or "").encode()
        same = [p for p, _, t in pages if t == text and len(data) >= 100]
        first = min(same, default=page)
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got[page].record_type, got[page].refers_to) == (("response", None) if page == first else ("revisit", first))
    path = f"file://{tmp_path}/w"
    warc.archive(df, path)
    back = {r.page_id: r for r in warc.read_archives(spark, path, payloads=True).collect()}
    assert all(r.ok for r in back.values()) and back[8].html == pages[7][2] and back[1].html == long and back[3].html == "" and back[2].stored_bytes == 0
    assert back[1].url == "http://a/1%0D%0AX: y" and back[2].url is None
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_repeated_and_null_ids(spark):
    text = "t" * 120
    df = spark.createDataFrame([(1, "u", text), (1, "v", text), (None, "w", text), (2, "x", text)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.url) for r in warc.round_trip(df).collect()), key=repr)
    assert got == sorted([(1, "response", None, "u"), (1, "revisit", 1, "v"), (None, "response", None, "w"), (2, "revisit", 1, "x")], key=repr)


def test_warc_files(spark, tmp_path, monkeypatch):
    """A gzip member for each record, bounded files, a payload longer than a member, ids that are no numbers, hot repeated rows."""
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "MEMBER", 1 << 20)
    long = "".join(chr(0x4E00 + k % 5000) for k in range(900_000))
    rows = [("p1", "u", long), ("p2", "u", long), ("p3", "u", "x" * 5000), *[("hot", "u", "h" * 300)] * 500, *[(f"q{k}", "u", "s" * (k + 100)) for k in range(60)], (None, "u", "n" * 200), (None, "u", "n" * 200)]
    monkeypatch.setattr(warc, "COPIES", 64)
    df = spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/w"
    warc.archive(df, path)
    back = warc.read_archives(spark, path, payloads=True, id_type="string").collect()
    assert len(back) == len(rows) and all(r.ok for r in back)
    assert [r.record_type for r in back if r.page_id == "hot"].count("response") == 1 and {r.refers_to for r in back if r.page_id == "hot"} == {None, "hot"}
    assert [(r.record_type, r.refers_to, r.html == long) for r in sorted(back, key=lambda r: str(r.page_id)) if r.page_id in ("p1", "p2")] == [("response", None, True), ("revisit", "p1", False)]
    names = set()
    for file in tmp_path.rglob("part-*"):
        data, members = file.read_bytes(), 0
        rest = data
        while rest:
            inflate = zlib.decompressobj(31)
            inflate.decompress(rest)
            assert inflate.eof
            rest, members = inflate.unused_data, members + 1
        found = list(warc.records(data))
        assert members == len(found) or len(found) == 1
        assert len(gzip.decompress(data)) <= 40_000 or len(found) == 1
        names |= {h["WARC-Record-ID"] for h, _ in found}
    assert len(names) == len(rows)
    referred = {h["WARC-Refers-To"] for file in tmp_path.rglob("part-*") for h, _ in warc.records(file.read_bytes()) if "WARC-Refers-To" in h}
    assert len(referred) == 2 and referred <= names


def test_warc_headers():
    data = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    assert list(warc.parse(bytearray(data))) == [({"WARC-Type": "x", "Content-Length": "4"}, b"ab\r\n")]
    for bad, why in ((b"junk\r\n\r\n", "no record"), (data[:-1], "cut off"), (data[:-2] + b"xx", "no end")):
        with pytest.raises(ValueError, match=why):
            list(warc.parse(bytearray(bad)))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(gzip.compress(data)[:-3]))


def damaged(path, change):
    """Rewrites the archives under a folder, each record passed through change(heads, block)."""
    for file in path.rglob("part-*"):
        out = b""
        for heads, block in list(warc.records(file.read_bytes())):
            made = change(dict(heads), block)
            if made:
                heads, block = made
                text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads.items()) + "\r\n"
                out += gzip.compress(text.encode() + block + b"\r\n\r\n")
        file.write_bytes(out)
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)


@pytest.mark.parametrize("kind", ["none", "payload", "length", "lost response", "revisit's claim"])
def test_warc_reading_verifies(spark, tmp_path, kind):
    """A changed payload or length, a response that is not there and a revisit that claims another payload are found."""
    df = spark.createDataFrame([(k, "http://a/x", "same " * 50 if k % 3 else f"own {k} " * 40) for k in range(12)], "page_id long, url string, html string")
    warc.archive(df, f"file://{tmp_path}/a")

    def change(heads, block):
        own, response = heads["Page-ID"] == "1", heads["WARC-Type"] == "response"
        if own and kind == "payload":
            block = block.replace(b"same", b"SAME", 1)
        if own and kind == "length":
            block = block.replace(b"Content-Length: 250", b"Content-Length: 251")
        if heads["Page-ID"] == "4" and kind == "revisit's claim":
            heads["WARC-Payload-Digest"] = "sha256:" + "0" * 64
        return None if own and response and kind == "lost response" else (heads, block)

    damaged(tmp_path / "a", change)
    rows = warc.resolved_records(spark, f"file://{tmp_path}/a")
    if kind == "none":
        got = {r.page_id: (r.digest, r.payload_bytes, r.record_type, r.refers_to) for r in rows.collect()}
        want = {r.page_id: (hashlib.sha256(r.html.encode()).hexdigest(), len(r.html), *(("revisit", 1) if r.page_id % 3 and r.page_id != 1 else ("response", None))) for r in df.collect()}
        assert got == want
    else:
        with pytest.raises(Exception, match="does not hold or find its payload"):
            rows.collect()


def test_queries_are_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert queries.queries().keys() <= __spark_entry__.queries().keys()


def test_pipeline_against_brute_force(spark):
    """Every stage on its predecessor's rows, against a plain version of the stage."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "pii", "best-fit packing"]
    stage = dict(corpus_pipeline.STAGES)
    good, _ = common.written(stage[names[0]](spark, docs, folder), "t")
    model = quality.train(docs, labels)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.score(docs, model).where("keep").collect()}
    rows = {r.doc_id: r.text for r in good.collect()}
    one, _ = common.written(stage[names[1]](spark, good, folder), "t")
    left = {r.doc_id for r in one.collect()}
    like = {(a, b): jaccard(rows[a], rows[b]) for a in rows for b in rows if b < a and set(rows[a].split()) & set(rows[b].split())}
    ids = sorted(rows)
    place = {k: n for n, k in enumerate(ids)}
    sure, most = (classes(len(ids), [(place[a], place[b]) for (a, b), j in like.items() if j >= least]) for least in (0.86, 0.7))
    assert len({sure[place[k]] for k in left}) == len(left) >= len(set(most)) and all(ids[r] in left for r in set(most))
    clean, _ = common.written(stage[names[2]](spark, one, folder), "t")
    items = [r.text for r in bench.collect()]
    padded = lambda t: " " + " ".join(w for w in re.split(r"[\W_]+", t.lower()) if w) + " "
    held = {r.doc_id for r in one.collect() if any(padded(i) in padded(r.text) for i in items)}
    left = {r.doc_id for r in clean.collect()}
    assert held and not held & left and len(left) >= one.count() - len(held) - 2
    safe, _ = common.written(stage[names[3]](spark, clean, folder), "t")
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in safe.collect():
        assert r.text == pii.redacted(before[r.doc_id], pii.spans_of(before[r.doc_id])[1]) and r.n_chars == len(r.text)
    assert all(d.columns == docs.columns for d in (good, one, clean, safe))
    packed = stage[names[4]](spark, safe, folder).collect()
    want = {r.doc_id: r.n_tokens for r in tokens.count_tokens(safe, queries.VOCABULARY).collect()}
    texts, total = {r.doc_id: r.text for r in safe.collect()}, {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        assert r.text == texts[r.doc_id][r.start : r.end]
    assert total == want
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in packed) == sorted((r.doc_id, r.piece, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect())


def test_pipeline_of_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and clashing names go through every stage; so do empty tables."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60).withColumns({c: F.lit("clash") for c in ("key", "fp", "gone", "piece", "bin_id", "p_good", "spans")})
    sample = docs.first().asDict()
    odd = [sample | {"doc_id": None}, sample | {"doc_id": None, "text": None}, sample | {"doc_id": 10**6, "text": None, "lang": None, "source": None, "n_chars": None}, sample | {"doc_id": 10**6 + 1, "text": ""}, sample | {"doc_id": 10**6 + 2, "text": "word " * 200_000}, sample, sample]
    docs = docs.unionByName(spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in odd], docs.schema))
    for now in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            columns = now.columns
            now, _ = common.written(stage(spark, now, folder), "odd")
            assert now.columns == columns or name == "best-fit packing"
    assert now.count() == 0
