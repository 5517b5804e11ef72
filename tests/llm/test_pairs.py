"""SimHash groups, native fingerprints and line dedup against brute force, with odd rows."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import line_spread, native_simhash, simhash_bk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 9, "k") for i, t, s in rows], DOCS)


def brute(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(p, 42) >> b & 1 for p in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def test_groups(spark):
    r = random.Random(1)
    base = [" ".join(r.choice("abcdefgh") * 3 + str(r.randint(0, 50)) for _ in range(300)) for _ in range(6)]
    rows = [(i, t, "s") for i, t in enumerate(base)] + [(10 + i, t[:-8] + " changed", "s") for i, t in enumerate(base)] + [(30, "", "s"), (31, None, "s"), (32, "A b", "s"), (33, "a B", "s"), (None, base[0], "s"), (34, base[1], "s"), (34, base[1], "s")]
    got = simhash_bk.group(docs(spark, rows)).collect()
    prints = [brute(t) for _, t, _ in rows]
    want = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            a = todo.pop()
            for b in range(len(rows)):
                if b not in seen and bin(prints[a] ^ prints[b]).count("1") <= 3:
                    seen.add(b)
                    todo.append(b)
        want.append((i, f"{prints[k]:016x}", min(rows[b][0] for b in seen if rows[b][0] is not None)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([tuple(g) for g in got], key=key) == sorted(want, key=key)
    assert simhash_bk.group(docs(spark, [])).count() == 0


def test_tree_and_links():
    r = np.random.default_rng(2)
    points = np.unique(np.concatenate([r.integers(0, 1 << 63, 50, dtype=np.uint64), np.uint64(5) ^ (np.uint64(1) << r.integers(0, 8, 60).astype(np.uint64))]))
    r.shuffle(points)
    tree = simhash_bk.BKTree(points)
    q, p = tree.within(points, 3)
    want = {(a, b) for a in range(len(points)) for b in range(len(points)) if int(points[a] ^ points[b]).bit_count() <= 3}
    assert set(zip(q.tolist(), p.tolist())) == want
    again = simhash_bk.BKTree.built(tree.points, *tree.edges())
    assert np.array_equal(again.child, tree.child)
    for parent, slot in zip(*np.nonzero(tree.child >= 0)):  # an edge is the distance to the parent
        assert int(points[parent] ^ points[tree.child[parent, slot]]).bit_count() == slot


@pytest.mark.parametrize("room", [32 << 20, 1])
def test_large_shards(spark, monkeypatch, room):
    """Pieces of one shard meet each other, as broadcast trees or shuffled: a chain of one-bit steps stays one component."""
    monkeypatch.setattr(simhash_bk, "PIECE_ROWS", 8)
    monkeypatch.setattr(simhash_bk, "BROADCAST_BYTES", room)
    chain, fp = [], 0
    for k in range(60):
        chain.append(fp)
        fp ^= 1 << k
    nodes = spark.createDataFrame([(k, f) for k, f in enumerate(chain)], "node long, fp long")
    labels = simhash_bk.components(simhash_bk.find_links(nodes, ["fp"]))
    assert {r["label"] for r in labels.collect()} == {0} and labels.count() == 60


def test_keep_one(spark):
    r = random.Random(3)
    base = [" ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(200)) for _ in range(5)]
    near = [t.split() for t in base]
    for w in near:
        w[50] = "zzz"
    rows = [(i, t, "s") for i, t in enumerate(base)] + [(100 + i, " ".join(w), "s") for i, w in enumerate(near)] + [(50, base[0], "s"), (50, base[0], "s"), (60, None, "s"), (61, "", "s"), (2, "another text of the id " * 9, "s"), (None, base[0], "s"), (None, "only rows without an id have this text", "s"), (None, "only rows without an id have this text", "s")]
    kept = simhash_bk.keep_one(docs(spark, rows))
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 0, 1, 2, 2, 3, 4, 60]
    assert sorted(kept.columns) == sorted(docs(spark, rows).columns)
    assert simhash_bk.keep_one(docs(spark, [])).count() == 0


def test_native(spark):
    rows = [(3, "The cat sat on the mat", "s"), (1, "", "s"), (None, "x", "s"), (7, None, "s"), (9, "Zoë  ran\tfar away today", "s"), (9, "Zoë  ran\tfar away today", "s"), (5, "word " * 5000, "s")]
    out = native_simhash.edited(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    order = sorted(((-(1 << 63) if i is None else i, t or "") for i, t, _ in rows))
    import hashlib

    want = []
    for k, (i, t) in enumerate(order):
        nxt, c = order[(k + 1) % len(order)][1], len(t) // 4
        want.append((None if i == -(1 << 63) else i, len(t), hashlib.sha256((t[: len(t) - c] + nxt[:c]).encode()).hexdigest()))
    key = lambda x: (x[0] is not None, x[0] or 0, x[2])
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out], key=key) == sorted(want, key=key)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert len({r["fingerprint"] for r in out if r["doc_id"] == 9}) == 1
    assert native_simhash.edited(docs(spark, [])).count() == 0


@pytest.mark.parametrize("blocks", [4, 5, 6, 7])
def test_native_tables(spark, blocks):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = list({*base, 0, 1, 3, 7, 15, 1 << 62, (1 << 62) | 5, 1 << 63, *[f ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) ^ (1 << r.randrange(64)) * r.randrange(2) for f in base]})
    signed = lambda f: f - (f >> 63 << 64)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = sorted((x["query"], x["fp"], x["bits"]) for x in native_simhash.within(df, df, blocks=blocks).collect())
    assert got == sorted((signed(a), signed(b), (a ^ b).bit_count()) for a in fps for b in fps if (a ^ b).bit_count() <= 3)
    assert [native_simhash._blocks(n, 3) for n in (100, 1 << 20, 1 << 21, 1 << 30, 1 << 40)] == [4, 4, 5, 6, 7]


def native_print(text):
    """The fingerprint by Spark's XXH64 of neighbouring words, one by one: the hash of one is the seed of the next."""
    words = (text or "").translate({k: k + 32 for k in range(65, 91)}).encode().split()
    two = lambda a, b: xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) if b is not None else xxhash.xxh64_intdigest(a, 42)
    hashes = [two(a, b) for a, b in zip(words, [*words[1:], None])]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_native_fingerprints(spark):
    r = random.Random(8)
    base = [" ".join(r.choices(["Alpha", "beta", "Zoë", "delta", "eta", "x"], k=r.randint(0, 60))) for _ in range(25)]
    rows = [(i * 5, t, "s") for i, t in enumerate(base)] + [(i * 5 + 1, t + " x", "s") for i, t in enumerate(base)]
    out = {x["doc_id"]: x for x in native_simhash.edited(docs(spark, rows)).collect()}
    order = sorted(rows)
    prints = {native_print(t) for _, t, _ in rows}
    for k, (i, t, _) in enumerate(order):
        after, c = order[(k + 1) % len(order)][1], len(t) // 4
        own, new = native_print(t), native_print(t[: len(t) - c] + after[:c])
        same = lambda a, b: 1 - (a ^ b).bit_count() / 64
        assert (out[i]["fingerprint"], out[i]["edited_fingerprint"]) == (f"{own:016x}", f"{new:016x}"), t
        assert out[i]["near_edited"] == same(own, new) and out[i]["near_next"] == same(own, native_print(after))
        assert out[i]["near_texts"] == (sum((own ^ p).bit_count() <= 3 for p in prints) if i % 20 == 0 else None)


@pytest.mark.parametrize("sites", [3, 40])
def test_lines(spark, sites):
    shared, other = "a line that many sites share", "a line that two sites have in common"
    rows = [(i, f"{shared}\nown text of document {i}\n{other if i < 2 else ''}", f"s{i}") for i in range(sites)]
    rows += [(900, shared, None), (None, shared, "s1"), (901, None, "s1"), (902, "", "s1"), (903, "short\nshort", "s2"), (0, f"{shared}\nsecond row of the id", "s0")]
    out = line_spread.clean(docs(spark, rows))
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (0, rows[0][1]) in got and (1, f"own text of document 1\n{other}") in got and (900, "") in got and (None, "") in got
    assert (901, None) in got and (902, "") in got and (903, "short\nshort") in got and (0, f"{shared}\nsecond row of the id") in got
    assert out.count() == len(rows) and set(docs(spark, rows).columns) <= set(out.columns)
    assert line_spread.clean(docs(spark, [])).count() == 0


def test_lines_spread_over_two_stay(spark):
    rows = [(i, "a line on two sites only, not more", f"s{i % 2}") for i in range(10)]
    assert line_spread.clean(docs(spark, rows)).where(F.length("text") == 0).count() == 0


def _jaccard(a, b):
    x, y = (set(zip(*[t.split()[k:] for k in range(5)])) for t in (a, b))
    return len(x & y) / len(x | y)


def test_keep_one_finds_all_near_copies(spark):
    """Cut, extended and scattered edits of short and long texts, against brute force."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    rows, want = [], []
    for i, n in enumerate([30, 45, 60, 80, 120, 200, 320, 700] * 6):
        base = [word() for _ in range(n)]
        kind = i // 8 % 3
        if kind == 0:
            other = base[: n - n * 17 // 100]
        elif kind == 1:
            other = base + [word() for _ in range(n * 17 // 100)]
        else:
            other = [*base]
            for at in range(10, n, 60):
                other[at] = word()
        a, b = " ".join(base), " ".join(other)
        rows += [(i, a, "s"), (1000 + i, b, "s")]
        want += [i] if _jaccard(a, b) >= 0.8 else [i, 1000 + i]
    assert len(want) < 60
    assert sorted(r["doc_id"] for r in simhash_bk.keep_one(docs(spark, rows)).collect()) == sorted(want)


def test_keep_one_judges_by_jaccard(spark):
    """Texts below a similarity of 0.8 stay, and groups are those of brute force when one bucket mixes both kinds."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    texts = []
    for n in (100, 400):
        base = [word() for _ in range(n)]
        for share in range(2, 14):
            for _ in range(3):
                other = [*base]
                for at in r.sample(range(n), max(1, n * share // 400)):
                    other[at] = word()
                texts.append(" ".join(other))
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _jaccard(texts[i], texts[j]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    first = {g: group.index(g) for g in group}
    assert 4 < len(first) < len(texts) - 4
    kept = simhash_bk.keep_one(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values())


def test_keep_one_searches_by_simhash(spark):
    """Near copies are found within the radius of their SimHashes, and by no other path: at radius 0 edited texts stay."""
    r = random.Random(9)
    base = [["".join(r.choices("abcdefghij", k=4)) for _ in range(150)] for _ in range(4)]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(base)] + [(10 + 4 * k + i, " ".join([*w[: 40 * k], "zzz", *w[40 * k + 1 :]]), "s") for i, w in enumerate(base) for k in (1, 2, 3)]
    prints = {simhash_bk.vote(simhash_bk.shingle_set(t)) for _, t, _ in rows}
    assert len(prints) > 12
    assert simhash_bk.keep_one(docs(spark, rows), radius=0).count() == len(prints)
    assert sorted(x["doc_id"] for x in simhash_bk.keep_one(docs(spark, rows)).collect()) == [0, 1, 2, 3]


def test_near_radius_covers_the_similarity():
    """Pairs of similarity 0.8 to 0.85, with shingles added, taken away or replaced, are within the radius."""
    r, far = np.random.default_rng(10), 0
    for n in (4, 5, 8, 9, 16, 50, 300):
        for k in range(600):
            less, more = (n // 5, 0) if k % 2 else (n // 9, n // 9)
            h = r.integers(0, 1 << 64, n + max(more, n == 4), dtype=np.uint64)
            a, b = h[:n], (h[less:] if n > 4 else h)
            shared = len(np.intersect1d(a, b))
            assert 5 * shared >= 4 * (len(a) + len(b) - shared)
            far += (simhash_bk.vote(a) ^ simhash_bk.vote(b)).bit_count() > simhash_bk.NEAR_RADIUS
    assert far <= 2


def test_trees_of_many_shards():
    r = np.random.default_rng(11)
    sizes = [1, 2, 7, 60, 1, 300]
    points = np.concatenate([r.integers(0, 1 << 64, 4, dtype=np.uint64)[r.integers(0, 4, n)] ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)) for n in sizes])
    shard = np.repeat(np.arange(len(sizes)), sizes)
    roots = np.repeat(np.cumsum(sizes) - sizes, sizes)
    for radius in (0, 3, 24, 64):
        q, p, d = simhash_bk.BKTree(points, roots).near(points, roots, radius)
        far = np.bitwise_count(points[:, None] ^ points[None, :])
        want = np.argwhere((far <= radius) & (shard[:, None] == shard[None, :]))
        assert sorted(zip(q.tolist(), p.tolist())) == [tuple(x) for x in want.tolist()] and np.array_equal(d, far[q, p])


def test_components_in_one_task(spark):
    r = random.Random(12)
    links = spark.createDataFrame([(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(250)], "a long, b long")
    far, near = (sorted(map(tuple, simhash_bk.components(links, n).collect())) for n in (0, 1 << 20))
    assert far == near and len(far) > 100
    assert simhash_bk.components(links.limit(0), 1 << 20).count() == 0
