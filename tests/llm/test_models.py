"""The toxicity model and the context mixer."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import context_mix, toxicity


def made(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(r.randint(3, 90))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["idiot", "scum"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_gradients():
    m = toxicity.Model({w: k + 1 for k, w in enumerate("abcd")})
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(0)
    words, ids, mask, y = ["a", "b", "zz", "c"], r.integers(0, 4, (3, toxicity.WINDOW)), np.ones((3, toxicity.WINDOW), bool), np.array([1, 0, 1])
    mask[1, 20:], mask[2] = False, False

    def loss():
        p = 1 / (1 + np.exp(-m.forward(m.project(words)[ids], mask)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in m.gradients(words, ids, mask, y).items():
        flat, at = m.p[k].reshape(-1), int(np.abs(np.asarray(g)).argmax())
        old = flat[at]
        flat[at] = old + 1e-3
        up = loss()
        flat[at] = old - 1e-3
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-3 - np.asarray(g).reshape(-1)[at]) < 1e-4, k


def test_toxicity(spark):
    rows = made(400)
    model = toxicity.train([t for _, t, _ in rows[:300]], [y for _, _, y in rows[:300]])
    df = spark.createDataFrame([(i, t, "c0", 1.0) for i, t, _ in rows[300:]] + [(None, "", "x", 0.0), (5, None, "x", 0.0), (5, "a idiot b " + "word " * 3000, "x", 0.0)], "doc_id long, text string, c0 string, s double")
    out = toxicity.score(df, model).collect()
    right = [(r["__toxicity"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in out if r["c0"] == "c0"]
    assert np.mean(right) > 0.95 and len(out) == 103 and all(0 <= r["__toxicity"] <= 1 for r in out)
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.Scorer(toxicity.train(["a", "b"], [0, 0])).scores(["x", None])[0] < 1e-9


def test_fit_leaves_held_out_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in made(40)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    kept = labels.where(~toxicity.held_out()).where("doc_id is not null").select("doc_id").distinct()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in kept.collect())
    assert toxicity.fit(docs, labels, 50) is not None


def test_query_on_held_out_rows(spark):
    """The registered query tells held-out toxic rows from others, and is never shown their labels."""
    from foliant.llm import queries

    sf = "/root/testdata/sf0.01"
    out = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null"), "doc_id").where("held_out").select("predicted", "toxic", "score").collect()
    right = [r["predicted"] == r["toxic"] for r in out]
    toxic = [r["predicted"] for r in out if r["toxic"] == 1]
    assert len(out) > 20 and len(toxic) > 3 and np.mean(right) >= 0.9 and np.mean(toxic) >= 0.7
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) for r in out)


def test_windows():
    assert toxicity.windows(0).tolist() == [0] and toxicity.windows(32).tolist() == [0]
    assert all(set(range(n)) <= {k for a in toxicity.windows(n) for k in range(a, a + toxicity.WINDOW)} for n in range(1, 150))


def test_huffman():
    codes = context_mix.huffman([5, 1, 1, 3])
    assert len(set(codes)) == 4 and len(codes[0]) == 1 and abs(sum(2.0 ** -len(c) for c in codes) - 1) < 1e-12


def _learned(spark, rows):
    return context_mix.learn(spark.createDataFrame(rows, "doc_id long, text string"))


def _trains(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def mix(x):
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
    return x ^ x >> 32


def word_hash(w):
    if not w:
        return mix(1)
    places = (mix(((p & 63) << 8 | b) + 0x9E3779B97F4A7C15) * (2 * (p >> 6) + 1) for p, b in enumerate(w))
    return mix((sum(places) + len(w)) % 2**64)


class Slow:
    """Scores one bit at a time, from counts of its own and a learned mixer."""

    def __init__(self, rows, model):
        self.model, self.train = model, [context_mix.tokens(t) for i, t in rows if _trains(i)]
        self.counts = [Counter() for _ in range(3)]
        for toks in self.train:
            for i, w in enumerate(toks):
                for k in range(3):
                    self.counts[k][self.context(toks, i, k) + (w,)] += 1
        self.seen = [Counter() for _ in range(3)]
        for k in range(3):
            for key, n in self.counts[k].items():
                self.seen[k][key[:-1]] += n
        letters = [0] * 256
        for (w,) in self.counts[0]:
            for b in w + b"\n":
                letters[b] += 1
        self.codes = context_mix.huffman([max(1, n) for n in letters])
        self.nodes = {}
        for code in self.codes:
            for k in range(len(code)):
                self.nodes.setdefault(code[:k], len(self.nodes))

    @staticmethod
    def context(toks, i, k):
        return tuple(toks[j] if j >= 0 else None for j in range(i - k, i))

    @staticmethod
    def probability(m, slots, extra, gate):
        x = [math.log((m.total[k][s][1] + context_mix.DELTA) / (m.total[k][s][0] + context_mix.DELTA)) for k, s in enumerate(slots)] + extra
        logit = min(12.0, max(-12.0, sum(a * b for a, b in zip(x, m.weights[gate]))))
        cell = round((logit + 12) * (context_mix.MAP_STEPS - 1) / 24)
        centre = 1 / (1 + math.exp(-(-12 + 24 * cell / (context_mix.MAP_STEPS - 1))))
        no, yes = m.map[gate][cell]
        return (logit + math.log((yes + 4 * centre) / (no + 4 * (1 - centre)))) / 2

    def spelling(self, word):
        cost = 0.0
        data = word + b"\n"
        for pos, byte in enumerate(data):
            hashed, of = 0, []
            for k in range(1, max(context_mix.BYTE_ORDERS) + 1):
                hashed = (hashed * 0x100000001B3 + (data[pos - k] + 1 if pos >= k else 0) + k) % 2**64
                if k in context_mix.BYTE_ORDERS:
                    of.append(hashed)
            for k, bit in enumerate(self.codes[byte]):
                slots = []
                for h in of:
                    h = (h + self.nodes[self.codes[byte][:k]] * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 % 2**64
                    slots.append((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> 64 - context_mix.BYTE_BITS)
                z = self.probability(self.model.bytes, slots, [0.5], min(pos, context_mix.GATES - 1))
                cost += math.log1p(math.exp(-z if bit == "1" else z))
        return cost

    def cost(self, text):
        toks, levels, cost = context_mix.tokens(text), [], 0.0
        told, bins, mine = [[0, 0] for _ in range(4)], Counter(), Counter()
        log2 = lambda n: min(15, (n + 1).bit_length() - 1)
        for i, w in enumerate(toks):
            seen = [self.seen[k][self.context(toks, i, k)] for k in (1, 2)]
            have = [self.counts[k][self.context(toks, i, k) + (w,)] for k in (1, 2)]
            c0, total = self.counts[0][(w,)], self.seen[0][()]
            level = next((2 - k for k in (2, 1) if have[k - 1]), 2 if mine[w] else 3 if c0 else 4)
            past = [levels[-k] if len(levels) >= k else 5 for k in (1, 2, 3, 4)]
            sizes, at = [log2(s) for s in seen], log2(i)
            before = (mix(word_hash(toks[i - 1])) if i else 0) >> 64 - context_mix.SLOTS_BITS
            for lev in range(min(level, 3) + 1):
                if (lev < 2 and not seen[1 - lev]) or (lev == 2 and not i):
                    continue
                gate = sizes[1 - lev] if lev < 2 else at
                slots = [gate * 49 + past[0] * 7 + past[1], before, (sizes[1] * 16 + sizes[0]) * 16 + at, ((past[0] * 7 + past[1]) * 7 + past[2]) * 7 + past[3]]
                n, yes = told[lev]
                z = self.probability(self.model.levels[lev], slots, [math.log((yes + 1) / (n - yes + 1)) * min(1, n / 16), 0.5], gate)
                place = (lev, min(7, max(0, int(z + 4))))
                p = (bins[place, 1] + 24 / (1 + math.exp(-z))) / (bins[place, 0] + bins[place, 1] + 24)
                bit = int(level == lev)
                cost -= math.log(p if bit else 1 - p)
                told[lev] = [n + 1, yes + bit]
                bins[place, bit] += 1
            if level < 4:
                cost -= math.log([have[1] / max(1, seen[1]), have[0] / max(1, seen[0]), mine[w] / max(1, i), c0 / max(1, total)][level])
            else:
                cost += self.spelling(w)
            levels.append(level)
            mine[w] += 1
        return cost


def test_score_against_single_bits(spark):
    rows = [(i, t) for i, t, _ in made(80)] + [(200 + i, f"the same passage stands in many texts of number {i} . " * 2) for i in range(12)] + [(300, None), (301, "Zoë ÀÉ \x0b x"), (None, "abcd")]
    learned = _learned(spark, rows)
    slow = Slow(rows, learned.model)
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in context_mix.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert math.isclose(got[i, len(context_mix.tokens(t))], -slow.cost(t) / math.log(10), rel_tol=1e-5, abs_tol=1e-5), (i, t)


def test_next_tokens_add_up_to_at_most_one(spark):
    rows = [(i, t) for i, t, _ in made(40)]
    slow = Slow(rows, _learned(spark, rows).model)
    every = [w for (w,) in slow.counts[0]]
    for start in ("", "abcd ", rows[0][1][:20] + " "):
        first = slow.cost(start)
        # the cost of a text one token longer, less what both share; the end mark's own cost is put back
        shared = first - _last(slow, start)
        assert sum(math.exp(-(slow.cost(start + w.decode()) - _last(slow, start + w.decode()) - shared)) for w in every if w) <= 1 + 1e-9


def _last(slow, text):
    """The cost of the end mark alone."""
    toks = context_mix.tokens(text)
    whole, end = slow.cost(text), 0.0
    tokens, context_mix.tokens = context_mix.tokens, lambda t: toks[:-1]
    try:
        end = whole - slow.cost(text)
    finally:
        context_mix.tokens = tokens
    return end


def test_held_out_texts_beat_the_base(spark, sf):
    out = context_mix.score(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_counts_do_not_depend_on_partitions(spark, monkeypatch):
    """More chunks and more shards change no count."""
    df = spark.createDataFrame([(i, t) for i, t, _ in made(60)], "doc_id long, text string")
    told = []
    for parts, size in ((1, 8 << 20), (5, 2000)):
        monkeypatch.setattr(context_mix, "CHUNK_BYTES", size)
        monkeypatch.setattr(context_mix, "SHARD_BYTES", size)
        learned = context_mix.learn(df.repartition(parts))
        chunks, counts = learned.chunks.collect(), []
        for row in chunks:
            t = context_mix.tokens_of(row.asDict())
            words, contexts = context_mix.known_counts(t, context_mix.answers_of(learned.folder, row["chunk"]), learned.shards)
            for k, i in enumerate(row["doc_ids"]):
                own = slice(t.starts[k], t.starts[k] + row["lengths"][k])
                counts.append((i, words[t.ids[own]].tolist(), *(c[own].tolist() for c in contexts)))
        told.append((learned.corpus, sorted(counts)))
        assert len(chunks) >= parts and learned.shards >= parts
    assert told[0] == told[1]


def test_tokens_are_kept():
    texts = ["The cat\x0bsat\ton  THE mat", "", None, "é É " + "x" * 200 + " " + "x" * 201, " a", "the cat " * 90_000, "y" * (3 << 20) + " z"]
    t = context_mix.Tokens.of(texts)
    again = context_mix.Tokens.unpack(*t.pack())
    for own in (t, again):
        told = [own.words[k] for k in own.ids.tolist()]
        assert told == [w for x in texts for w in context_mix.tokens(x)]
        assert own.starts.tolist() == np.cumsum([0] + [len(context_mix.tokens(x)) for x in texts])[:-1].tolist()
        assert own.hashes[:50].tolist() == [word_hash(w) for w in own.words[:50]] and len(set(own.hashes.tolist())) == len(own.words)
    assert t.bytes.tolist() == [len((x or "").encode()) for x in texts]


def test_counts_beyond_32_bits():
    big = np.array([3, 5 * 10**9], dtype=np.int64)
    assert context_mix._wide(context_mix._small(big)).tolist() == big.tolist()


def test_base_score(spark):
    rows = [(i, t) for i, t, _ in made(60)] + [(61, None), (62, ""), (None, "aaaa Aaaa"), (5, "again"), (5, "again"), (63, "x" * 5000 + " y" * 500)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, chunk int")
    got = context_mix.score(df).collect()
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    c = Counter(w for i, t in rows if train(i) for w in context_mix.tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, not train(i), len(context_mix.tokens(t)), sum(c[w] > 0 for w in context_mix.tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in context_mix.tokens(t)), 6)) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    assert context_mix.score(df.where(F.lit(False))).count() == 0


def test_small_table_trains_the_mixer(spark):
    m = _learned(spark, [(i, t) for i, t, _ in made(60)]).model
    assert all(np.abs(x.weights - context_mix.START_WEIGHT).max() > 1e-3 for x in (m.levels[1], m.levels[3], m.bytes))


def test_every_training_bit_is_learned(spark):
    rows = [(i, t) for i, t, _ in made(60)]
    m = _learned(spark, rows).model
    n = sum(len(context_mix.tokens(t)) for i, t in rows if _trains(i))
    firsts = sum(1 for i, _ in rows if _trains(i))
    assert m.levels[2].seen == n - firsts and 0 < m.levels[1].seen <= n  # here no word of a pair is told by the words before
    for x in m.learners():
        assert all(abs(x.total[k].sum() - x.seen) < 1e-6 for k in range(len(x.total))) and abs(x.map.sum() - x.seen) < 1e-6


def test_training_holds_a_word_once(monkeypatch):
    """The driver trains beside its JVM: a million occurrences of 50 words must not be a million strings."""
    monkeypatch.setattr(toxicity, "EPOCHS", 0)
    monkeypatch.setattr(toxicity, "STEPS", 0)
    r = random.Random(20)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(50)]
    texts = [" ".join(r.choices(words, k=4000)) for _ in range(250)]
    tracemalloc.start()
    toxicity.train(texts, [k % 2 for k in range(len(texts))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6, peak
