"""Near-duplicates, repeated passages, components, quality and the pipeline against brute force."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rowscout.llm import quality, simhash, suffixes, vectors
from rowscout.llm.components import components
from rowscout.llm.frames import even_keys, hash_slots, pick


class Sets:
    """Plain union-find whose roots are the least members."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_pick_finds_columns_among_clashing_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "A int, a int, b int").toDF("DOC_ID", "doc_id", "doc_Id")
    assert pick(df, doc_id="long").collect() == [(2,)]
    assert pick(df.toDF("x", "x", "DOC_ID"), doc_id="long").collect() == [(3,)]
    with pytest.raises(ValueError):
        pick(df, other="long")


@pytest.mark.parametrize("n", [1, 2, 7, 50, 211])
def test_even_keys(spark, n):
    keys = even_keys(n)
    assert sorted(hash_slots(keys, n).tolist()) == list(range(n))
    for slots in (1, 6, 13, 300):
        dealt = np.bincount(hash_slots(even_keys(n, slots), slots), minlength=slots)
        assert dealt.sum() == n == len(set(even_keys(n, slots))) and dealt.max() - dealt.min() <= 1
    got = spark.createDataFrame([(k,) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(n)).alias("s")).collect()
    assert sorted(r.s for r in got) == list(range(n))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(60)] + [(7, 7), (None, 3)]
    want = Sets()
    for a, b in edges:
        if a is not None:
            want.join(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: want.find(n) for n in want.up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hs = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprint():
    for t in ("", "  \n", "One", "one two", "A b C d É é", "x y z w  v\tu", "w " * 500):
        assert simhash.fingerprint(simhash.shingle_hashes(t)) == slow_fingerprint(t)


def test_bit_sliced_comparison_equals_popcount():
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([centers ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(12)] + [centers]))
    group = np.sort(rng.integers(0, 30, len(fps)))
    for radius in (0, 1, 3, 6):
        want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
        i, j = simhash.small_links(fps[:, None], group, radius)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
        got, all_ = Sets(), Sets()
        for a, b in zip(*simhash.forest(fps[:, None], radius), strict=True):
            got.join(a, b)
        for a in range(len(fps)):
            for b in range(a):
                if int(fps[a] ^ fps[b]).bit_count() <= radius:
                    all_.join(a, b)
        assert all(got.find(x) == all_.find(x) for x in range(len(fps)))


def near_texts(seed=6, n=140):
    """Texts with exact copies and copies that differ by a word or two."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(200)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = rng.choice(out).split()
            for _ in range(rng.randrange(3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
        else:
            out.append(" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 30, 200]))))
    return out


@pytest.mark.parametrize("tile", [2, 2048])
def test_simhash_operator(spark, tile):
    texts = near_texts()
    rows = [(i * 3, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[5], "x", 1), (9, None, "x", 1), (9, texts[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int").repartition(5)
    fps = [slow_fingerprint(t or "") for _, t, *_ in rows]
    want = Sets()
    for a in range(len(rows)):
        want.find(a)
        for b in range(a):
            if int(fps[a] ^ fps[b]).bit_count() <= 3:
                want.join(a, b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[want.find(k)] = min(r[0], least.get(want.find(k), r[0]))
    expected = sorted((r[0] if r[0] is not None else -1, f"{fps[k]:016x}", least.get(want.find(k))) for k, r in enumerate(rows))
    got = simhash.near_duplicates(docs, tile=tile).select("doc_id", simhash.hex16("fp").alias("f"), "component_id").collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.f, r.component_id) for r in got) == expected
    assert len(least) < len(rows) * 0.8  # there is something to link
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {}
    for k, r in enumerate(rows):  # one row of each group, of the least id
        groups.setdefault(want.find(k), []).append(r[0])
    assert sorted(r[0] for r in kept.collect()) == sorted(min(x for x in g if x is not None) for g in groups.values())
    assert simhash.near_duplicates(docs.where("false")).count() == 0 and simhash.keep_one(docs.where("false")).count() == 0


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b c d e f", "x")] * 3 + [(None, "a b c d e f", "y")] * 2 + [(None, "g h i j k l", "z")] * 4 + [(2, "m n o p", "u"), (2, "m n o p", "v"), (2, "q r s t", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for options in ({}, {"width": 5, "similarity": 0.8}):
        got = [(r.doc_id, r.text) for r in simhash.keep_one(docs, **options).collect()]
        assert sorted(got, key=str) == sorted([(1, "a b c d e f"), (None, "g h i j k l"), (2, "m n o p"), (2, "q r s t")], key=str)


@pytest.mark.parametrize("choose", [1, 2, 3, 4])
def test_pigeonhole_loses_no_pair(spark, choose):
    rng = np.random.default_rng(choose)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64)
    rows = [(int(x), k) for k, x in enumerate(np.r_[base, near].view(np.int64).tolist())]
    met = {}
    dealt = simhash.pigeonhole(spark.createDataFrame(rows, "fp long, node long"), 3, choose)
    for r in dealt.collect():
        met.setdefault(r.bucket, set()).add(r.node)
    pairs = {(a, b) for g in met.values() for a in g for b in g if a < b}
    assert all((k, k + len(base)) in pairs for k in range(len(base))) and dealt.count() == len(rows) * math.comb(3 + choose, choose)
    assert [simhash.blocks_for(n, 3, 2048) for n in (0, 1 << 27, 1 << 30, 1 << 40, 1 << 60)] == [1, 1, 2, 3, 4]


def jaccard(a, b):
    a, b = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_long_bit_sliced_comparison():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, (6, 8), dtype=np.uint64)
    fps = np.concatenate([base ^ (rng.integers(0, 1 << 63, (6, 8), dtype=np.uint64) & rng.integers(0, 1 << 63, (6, 8), dtype=np.uint64) & rng.integers(0, 1 << 63, (6, 8), dtype=np.uint64)) for _ in range(25)])
    group = np.sort(rng.integers(0, 5, len(fps)))
    far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    for radius in (60, 86, 120):
        want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and far[i, j] <= radius}
        i, j = simhash.small_links(fps, group, radius)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
        trees = Sets()
        for a, b in zip(*np.nonzero(np.triu(far <= radius, 1)), strict=True):
            trees.join(int(a), int(b))
        got = dict(zip(*reversed(simhash.forest(fps, radius)), strict=True))
        assert all(trees.find(x) == trees.find(got.get(x, x)) == got.get(x, x) for x in range(len(fps)))


def test_groups_are_compared_together(monkeypatch):
    """Groups of some hundred rows, as bands have them at several GB, cost a comparison for each distance between rows, not one
    for each row, and near copies among them are not compared again once they are joined."""
    rng = np.random.default_rng(17)
    fps = rng.integers(0, 1 << 63, (12 * 130, 8), dtype=np.uint64)
    group = np.sort(rng.integers(0, 12, len(fps)))
    near = rng.permutation(len(fps))
    for k in range(0, 240, 2):  # pairs and chains
        fps[near[k + 1]] = fps[near[k]] ^ (np.uint64(1) << rng.integers(0, 64, 8).astype(np.uint64))
    crowd = np.flatnonzero(group == 7)[::2]
    fps[crowd] = fps[crowd[0]] ^ (np.uint64(1) << rng.integers(0, 64, (len(crowd), 8)).astype(np.uint64))
    nodes = np.arange(len(fps)) * 3
    want = set()
    for g in range(12):
        at = np.flatnonzero(group == g)
        want |= {(int(nodes[at[i]]), int(nodes[at[j]])) for i, j in zip(*simhash.forest(fps[at], 110), strict=True)}
    calls, within = [], simhash.within
    monkeypatch.setattr(simhash, "within", lambda *a, **k: calls.append(1) or within(*a, **k))
    raw = pa.array([x.tobytes() for x in fps], pa.binary())
    rows = pa.RecordBatch.from_arrays([pa.array(group), raw, pa.array(nodes)], ["grp", "fp", "node"])
    batches = [rows.slice(k, 1000) for k in range(0, len(fps), 1000)]
    got = [x for b in simhash.links_of_groups(iter(batches), 110) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert set(got) == want and len(got) == len(want) > 20
    assert len(calls) <= 2 * np.bincount(group).max()  # before: one for each row


def test_similarity_links_what_is_alike(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    texts, family = [], []
    for k in range(60):
        base = rng.choices(words, k=rng.choice([120, 300, 700]))
        texts.append(" ".join(base))
        family.append(k)
        for share in (0.0, 0.004, 0.012, 0.02, 0.15):
            t = [rng.choice(words) if rng.random() < share else w for w in base]
            texts.append(" ".join(t))
            family.append(k)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, width=5, similarity=0.8).collect()}
    assert all(family[d] == family[c] for d, c in got.items())  # nothing unlike is linked
    near = [(a, b) for a in range(len(texts)) for b in range(a) if family[a] == family[b] and jaccard(texts[a], texts[b]) >= 0.82]
    assert len(near) > 300 and sum(got[a] == got[b] for a, b in near) / len(near) > 0.98
    apart = [6 * k + 5 for k in range(60) if max(jaccard(texts[6 * k + 5], texts[6 * k + j]) for j in range(5)) < 0.6]
    assert len(apart) > 30 and all(got[a] == a for a in apart)


def test_jaccard_forest():
    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 63, (8, 40), dtype=np.uint64)
    sets = [np.unique(np.r_[b[: rng.integers(30, 41)], rng.integers(0, 1 << 63, rng.integers(0, 8), dtype=np.uint64)]) for b in base for _ in range(12)] + [np.empty(0, np.uint64)]
    alike = lambda a, b: len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b))) >= 0.8
    got, want = Sets(), Sets()
    for a, b in zip(*simhash.jaccard_forest(sets, 0.8), strict=True):
        got.join(a, b)
    for a in range(len(sets)):
        for b in range(a):
            if alike(sets[a], sets[b]):
                want.join(a, b)
    assert all(got.find(x) == want.find(x) for x in range(len(sets)))


@pytest.mark.parametrize("tile", [3, 2048])
def test_similarity_is_exact_around_the_threshold(spark, tile):
    rng = random.Random(14)
    word = iter(f"w{i}" for i in range(10**7))
    texts, pairs = [], []

    def pair(n, cut, drop=0):
        """n words and a copy with a word replaced at each place of cut, without the last drop words."""
        a = [next(word) for _ in range(n)]
        b = [next(word) if i in cut else w for i, w in enumerate(a)][: n - drop]
        pairs.append((len(texts), len(texts) + 1))
        texts.extend((" ".join(a), " ".join(b)))

    for _ in range(40):
        pair(9, (), 1)  # 4 of 5 shingles
        pair(49, (), 9)  # 36 of 45: 0.8
        pair(49, (), 10)  # 35 of 45
        for n, most in ((184, 7), (424, 14), (904, 30)):
            for k in range(most // 2, most):
                pair(n, {4 + 6 * i for i in range(k)})
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, width=5, similarity=0.8, tile=tile).collect()}
    exact = {p: jaccard(texts[p[0]], texts[p[1]]) for p in pairs}
    at, under = [p for p in pairs if 0.8 <= exact[p] <= 0.82], [p for p in pairs if 0.7 <= exact[p] < 0.8]
    assert len(at) > 120 and len(under) > 200
    assert sum(got[a] == got[b] for a, b in at) / len(at) > 0.99
    assert all(got[a] == got[b] for a, b in pairs if exact[a, b] >= 0.8 and len(texts[b].split()) <= 44)  # short: none is missed
    assert all(got[a] == a and got[b] == b for a, b in under)
    assert len(got) == len(texts)


# Vectors


def planted_vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            out.append(out[rng.integers(len(out))] + rng.normal(size=d) * rng.choice([0, 0.03, 0.06, 0.08]))
        else:
            out.append(rng.normal(size=d))
    return np.array(out, np.float32)


@pytest.mark.parametrize("cell_rows,d", [(10, 24), (40, 8), (8192, 24)])
def test_vectors(spark, cell_rows, d):
    x = planted_vectors(7, 300, d)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * d, [float("nan")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [float("inf")] * d, [1.0] * (d + 1)]
    rows += [(1000 + k, v, 2) for k, v in enumerate(odd)] + [(None, x[0].tolist(), 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, VEC_ID_2 int")
    got = {r.vec_id: r for r in vectors.near_duplicate_vectors(df, cell_rows=cell_rows).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    hit = y @ y.T >= 0.9
    want = Sets()
    for i in range(len(x)):
        want.find(i)
        for j in np.flatnonzero(hit[i]):
            want.join(i, int(j))
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (hit[i].sum() - 1, want.find(i), want.find(i) == i), i
    for k in range(len(odd)):
        assert (got[1000 + k].n_links, got[1000 + k].component_id, got[1000 + k].kept) == (0, 1000 + k, True)
    assert got[None].n_links == 0 and len(got) == len(rows)
    assert hit.sum() > 2 * len(x)


def test_vectors_of_one_id_and_of_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    rows = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(df).collect())
    assert rows == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]
    assert vectors.near_duplicate_vectors(df.where("false")).count() == 0


def test_vectors_of_several_widths(spark):
    rows = [(k, [1.0, float(k % 2), 0.0]) for k in range(6)] + [(10 + k, [1.0, 2.0 + k % 2 * 9]) for k in range(4)] + [(20, [1.0]), (21, [-1.0]), (22, []), (23, None)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[k][:2] for k in range(6)] == [(2, k % 2) for k in range(6)]
    assert [got[10 + k][1] for k in range(4)] == [10, 10, 10, 10] and got[20] == (0, 20, True) and got[21] == (0, 21, True) and got[22] == (0, 22, True) == (0, 22, got[23][2])


def test_many_cells_are_fitted_in_two_levels():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    centers = vectors.spherical_kmeans(x, 1100, rounds=2)
    assert 1000 < len(centers) < 1200 and np.allclose(np.linalg.norm(centers, axis=1), 1)
    home, near = vectors.visits(x[:3000], centers, 0.9)
    dots = x[:3000] @ x[:3000].T
    a, b = np.nonzero(np.triu(dots >= 0.9, 1))
    assert len(a) > 100 and ((home[a] == home[b]) | near[a, home[b]] | near[b, home[a]]).all()


def test_visits_lose_no_pair():
    rng = np.random.default_rng(8)
    x = planted_vectors(9, 400, 12).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    centers = vectors.spherical_kmeans(x, 20)
    home, near = vectors.visits(x, centers, 0.9)
    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True):
        assert home[i] == home[j] or near[i, home[j]] or near[j, home[i]]
    assert near.mean() < 0.9 and rng is not None


# Suffixes


def slow_cut(docs, length):
    owner = {}
    for d, t in docs:
        if d is not None:
            for s in range(len(t) - length + 1):
                g = t[s : s + length]
                owner[g] = min(owner.get(g, d), d)
    out = []
    for d, t in docs:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1) if d is not None else ():
            if owner[t[s : s + length]] < d:
                gone[s : s + length] = True
        edge = np.diff(np.r_[0, gone.astype(int), 0])
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)).tolist(), strict=True))
        out.append((d if d is not None else -1, bytes(np.frombuffer(t, np.uint8)[~gone]), int(gone.sum()), spans))
    return sorted(out)


def repeated_docs(seed, n=60, alphabet="ab cé"):
    rng = random.Random(seed)
    parts = ["".join(rng.choices(alphabet, k=rng.choice([20, 60, 300]))) for _ in range(8)]
    out = []
    for d in range(n):
        t = "".join(rng.choice(parts)[rng.randrange(20) :] + "".join(rng.choices("xyz ", k=rng.randrange(20))) for _ in range(rng.randrange(5)))
        out.append((d, "z" * rng.randrange(200) if rng.random() < 0.1 else t))
    return out


@pytest.mark.parametrize("often", [2, 2000])
def test_suffix_operator(spark, monkeypatch, often):
    docs = repeated_docs(10) + [(None, "a" * 300), (5, "b c" * 100), (5, "b c" * 100), (70, None), (71, "common line, " * 30)]
    rows = [(d, t, 1, "q") for d, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, KEPT string").repartition(6)
    monkeypatch.setattr(suffixes, "OFTEN", often)
    got = suffixes.cut_repeats(df).collect()
    mine = sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.kept), r.n_removed, [(s.start, s.length) for s in r.spans]) for r in got)
    assert mine == slow_cut([(d, (t or "").encode()) for d, t in docs], 50)
    assert sum(r.n_removed for r in got) > 1000


def local_cut(docs, length, q, parts=3):
    """The passes without Spark."""
    import pyarrow as pa
    import pyarrow.compute as pc

    keys = np.arange(parts)
    of = {p: suffixes.Part(pa.table({"i": [d for k, (d, _) in enumerate(docs) if k % parts == p], "t": [t for k, (_, t) in enumerate(docs) if k % parts == p]}), 0, 1) for p in range(parts)}
    only = lambda t, c, v: t.filter(pc.equal(t[c], v))
    a = pa.concat_tables([suffixes.anchors_of_part(x, p, length, q, keys) for p, x in of.items()])
    r = pa.concat_tables([suffixes.repeated_anchors(only(a, "bucket", b)) for b in set(a["bucket"].to_pylist())] or [suffixes.table([], suffixes.ANSWERS)])
    s = pa.concat_tables([suffixes.runs_of_part(x, p, only(r, "pid", p), length, q, keys) for p, x in of.items()])
    c = pa.concat_tables([suffixes.covered_ranges(only(s, "bucket", b), length, q) for b in set(s["bucket"].to_pylist())] or [suffixes.table([], suffixes.REPLIES)])
    out = []
    for p, x in of.items():
        kept, removed, spans = suffixes.cut_part(x, only(c, "pid", p), length)
        out += [(d, k, n, [(e["start"], e["length"]) for e in sp]) for d, k, n, sp in zip(x.ids.tolist(), kept, removed, spans.to_pylist(), strict=True)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_suffix_passes(monkeypatch, seed):
    monkeypatch.setattr(suffixes, "CHUNK", 400)
    monkeypatch.setattr(suffixes, "REFINE_ROWS", (3, 4096)[seed % 4 // 2])
    monkeypatch.setattr(suffixes, "OFTEN", (2, 2000)[seed % 2])
    length, q = ((50, 24), (20, 8), (64, 32))[seed % 3]
    docs = repeated_docs(100 + seed, 40, ("ab ", "abcdefgh ", "a")[seed % 3])
    assert local_cut(docs, length, q) == slow_cut([(d, t.encode()) for d, t in docs], length)


@pytest.mark.parametrize("often", [2, 2000])
def test_runs_in_small_portions(monkeypatch, often):
    monkeypatch.setattr(suffixes, "PORTION_ROWS", 5)
    monkeypatch.setattr(suffixes, "OFTEN", often)
    docs = repeated_docs(300, 40)
    assert local_cut(docs, 50, 24) == slow_cut([(d, t.encode()) for d, t in docs], 50)


def test_copies_of_often_seen_strings_take_little_memory():
    """A part with a large group of copies, all of whose anchors are often seen: every string of it is a row of its own."""
    text = "".join(random.Random(3).choices("abcdefgh ", k=1000))
    part = suffixes.Part(pa.table({"i": list(range(500)), "t": [text] * 500}), 0, 1)
    one = np.arange(1)
    wanted = suffixes.repeated_anchors(suffixes.anchors_of_part(part, 0, 50, 24, one))
    wanted = pa.table([wanted.column("pid"), wanted.column("bucket"), wanted.column("often"), wanted.column("payload")], names=["pid", "bucket", "payload", "often"])
    tracemalloc.start()
    got = suffixes.runs_of_part(part, 0, wanted, 50, 24, one)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6  # of 475 500 rows of 80 bytes
    settled = [np.frombuffer(p, "<u4").reshape(3, -1) for b, p in zip(got.column("bucket").to_pylist(), got.column("payload").to_pylist(), strict=True) if b < 0]
    assert len(settled) == 1 and (settled[0].T == [[d, 0, 951] for d in range(1, 500)]).all()


def test_all_that_goes_comes_from_the_refinement(monkeypatch):
    docs = repeated_docs(200, 40)
    monkeypatch.setattr(suffixes, "OFTEN", 5)
    assert sum(n for _, _, n, _ in local_cut(docs, 50, 24)) > 1000
    classes = suffixes.string_classes
    monkeypatch.setattr(suffixes, "string_classes", lambda *a: tuple(x[:0] for x in classes(*a)))  # no final buckets
    assert sum(n for _, _, n, _ in local_cut(docs, 50, 24)) == 0


@pytest.mark.parametrize("seed", range(6))
def test_refinement_sorts_strings_into_classes(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(50, 78, 300)
    rows = np.zeros((300, 80), np.uint8)
    base = rng.integers(97, 97 + (2, 3, 20)[seed % 3], (6, 79), dtype=np.uint8)
    for k, n in enumerate(size):
        at = rng.integers(0, 80 - n)
        rows[k, :n] = base[rng.integers(6)][at : at + n]
        if rng.random() < 0.3:
            rows[k, rng.integers(n)] = 33
    rows[:, -1] = size
    anchor = np.sort(rng.integers(0, 3, 300))
    row, start, name = suffixes.string_classes(rows, size, anchor, 50)
    of = {}
    for r, a, x in zip(row.tolist(), start.tolist(), name.tolist(), strict=True):
        assert of.setdefault((int(anchor[r]), rows[r, a : a + 50].tobytes()), x) == x
    assert len(set(of.values())) == len(of) < len(row)


def test_without_repeats_keeps_rows_and_columns(spark):
    text = "é" * 40 + "tail"  # 84 bytes
    rows = [(1, "en", text, 44), (2, None, "x" + text, 45), (3, "en", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, n_chars long")
    got = {r.doc_id: r for r in suffixes.without_repeats(df).collect()}
    assert got[1].text == text and got[2].text == "x" and got[2].n_chars == 1 and got[3].text is None and got[2].lang is None
    assert suffixes.without_repeats(df).columns == df.columns and suffixes.without_repeats(df.where("false")).count() == 0


# Quality


def test_quality_on_held_out_labels(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "lid")
    got = quality.classify(docs, train)
    assert got.count() == docs.count()
    held = got.join(test, F.col("doc_id") == F.col("lid"))
    r = held.agg(
        F.avg(((F.col("p_quality") >= 0.5) == (F.col("quality") == 1)).cast("int")).alias("q"),
        F.avg(((F.col("p_toxic") >= 0.5) == (F.col("toxic") == 1)).cast("int")).alias("t"),
        F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("keep").cast("int"))).alias("kept"),
        F.avg(F.when(F.col("toxic") == 1, F.col("keep").cast("int"))).alias("toxic_kept"),
    ).first()
    assert r.q > 0.99 and r.t > 0.97 and r.kept > 0.985 and r.toxic_kept < 0.03, r


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "a", 3.0, -3.0)] * 50 + [("big", "b", 3.0, -3.0)] * 50 + [("bad", "a", -3.0, -3.0)] * 40 + [("tiny", "a", -3.0, -3.0), (None, None, 3.0, -3.0)]
    got = {(r.host, r.path): r for r in quality.site_shifts(spark.createDataFrame(rows, "host string, path string, z_quality double, z_toxic double")).collect()}
    assert got["bad", "a"].host_quality < got["tiny", "a"].host_quality < got["big", "a"].host_quality
    assert len(got) == 5 and got["bad", "a"].shift_quality < 0 < got["big", "a"].shift_quality


def plain_sites(rows):
    """Posteriors of sites, step by step in plain numbers. rows: host, path, evidence (log odds) of each document."""
    hosts, paths = {}, {}
    for h, p, z in rows:
        for table, key in ((hosts, h), (paths, (h, p))):
            n, s = table.get(key, (0, 0.0))
            table[key] = (n + 1, s + 1 / (1 + math.exp(-z)))
    total, good = len(rows), sum(s for _, s in hosts.values())
    m = (good + 0.5) / (total + 1)

    def strength(between, noise):
        return min(max(m * (1 - m) / max(between / total - noise / len(paths), 1e-6) - 1, 4.0), 1e5)

    rate = {h: s / n for h, (n, s) in hosts.items()}
    k_host = strength(sum(n * (rate[h] - m) ** 2 for (h, _), (n, _) in paths.items()), sum(m * (1 - m) / hosts[h][0] for h, _ in paths))
    k_path = strength(sum(n * (s / n - rate[h]) ** 2 for (h, _), (n, s) in paths.items()), sum(m * (1 - m) / n for n, _ in paths.values()))
    out = {}
    for (h, p), (n, s) in paths.items():
        host = (k_host * m + hosts[h][1]) / (k_host + hosts[h][0])
        path = (k_path * host + s) / (k_path + n)
        out[h, p] = (host, path, math.log(path / (1 - path)) - math.log(m / (1 - m)), n)
    return out


@pytest.mark.parametrize("case", ["many", "one site", "null sites", "ties", "one document"])
def test_posteriors_equal_plain_numbers(spark, case):
    rng = random.Random(case)
    if case == "many":
        rows = [(f"h{rng.randrange(9)}", f"p{rng.randrange(4)}", rng.gauss(0, 3), rng.gauss(-2, 2)) for _ in range(600)] + [("big", "p", 4.0, -6.0)] * 300
    elif case == "one site":
        rows = [("h", "p", rng.gauss(1, 2), rng.gauss(-3, 1)) for _ in range(50)]
    elif case == "null sites":
        rows = [(rng.choice([None, "h"]), rng.choice([None, "p"]), rng.gauss(0, 2), rng.gauss(0, 2)) for _ in range(80)]
    elif case == "ties":
        rows = [(h, p, 0.0, 0.0) for h in "ab" for p in "cd" for _ in range(5)]
    else:
        rows = [("h", "p", 2.0, -2.0)]
    got = quality.site_shifts(spark.createDataFrame(rows, "host string, path string, z_quality double, z_toxic double").repartition(3)).collect()
    for t, at in (("quality", 2), ("toxic", 3)):
        want = plain_sites([(r[0], r[1], r[at]) for r in rows])
        assert len(got) == len(want)
        for r in got:
            assert (r[f"host_{t}"], r[f"path_{t}"], r[f"shift_{t}"], r.site_docs) == pytest.approx(want[r.host, r.path], rel=1e-9, abs=1e-9)


def test_registered_quality_equals_brute_force(spark):
    """The query op5 on a whole table: evidence by a plain loop over the fitted weights, posteriors in plain numbers."""
    from rowscout.llm import queries

    root = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    models = quality.fit(docs, labels)
    rows = docs.collect()
    z = {t: [sum(a * b for a, b in zip(models[t].shape_weights, quality.shape(r.text or ""), strict=True))
             + sum(models[t].word_weights.get(w, 0.0) for w in set(quality._WORD.findall((r.text or "").lower()))) for r in rows] for t in models}
    want = {}
    for t in models:
        sites = plain_sites([(r.source, r.lang, x) for r, x in zip(rows, z[t], strict=True)])
        for r, x in zip(rows, z[t], strict=True):
            host, path, shift, _ = sites[r.source, r.lang]
            want.setdefault(r.doc_id, {}).update({f"host_{t}": host, f"path_{t}": path, f"p_{t}": 1 / (1 + math.exp(-x - shift))})
    got = queries.op5_quality(spark, root).collect()
    assert len(got) == len(rows) == len(want)
    for r in got:
        assert {k: r[k] for k in want[r.doc_id]} == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-9)
        assert r.keep == (r.p_quality >= 0.5 and r.p_toxic < 0.1)


def test_quality_of_very_long_texts(spark):
    long = "good words and more " * 100_000
    docs = spark.createDataFrame([(1, long, "x"), (2, "short text", "x"), (3, "", None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in quality.classify(docs, labels).collect()} == {1, 2, 3}


def test_quality_without_labels_and_columns(spark):
    docs = spark.createDataFrame([(1, "some text", "x"), (None, None, "x"), (1, "some text", "x")], "doc_id long, text string, P_QUALITY string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, none).collect()
    assert len(rows) == 3 and all(abs(r.p_quality - 0.5) < 1e-6 and r.keep for r in rows)
    one = spark.createDataFrame([(1, 1, None), (1, 1, None), (7, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, one).columns == docs.columns
    assert quality.classify(docs.where("false"), one).count() == 0


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, root)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    good, near, cut = (seen[n] for n, _ in cp.STAGES[:-1])
    judged = {r.doc_id: r.keep for r in quality.classify(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")).collect()}
    assert set(good) == {d for d, keep in judged.items() if keep} and 0 < len(good) < len(judged)
    groups, words = Sets(), {d: np.frombuffer(simhash.long_fingerprint(simhash.shingle_hashes(t, 5), 8), np.uint64) for d, t in good.items()}
    for a in good:
        groups.find(a)
        for b in good:
            if a < b and np.bitwise_count(words[a] ^ words[b]).sum() <= simhash.radius_of(0.8, 512):
                groups.join(a, b)
    assert {d for d in good if groups.find(d) == d} <= set(near) < set(good)  # bands may miss a link, never make one
    alike = [(a, b) for a in near for b in near if a < b and jaccard(good[a], good[b]) >= 0.9]
    assert not alike
    want = {d: k.decode("utf-8", "ignore") for d, k, *_ in slow_cut([(d, t.encode()) for d, t in near.items()], 50)}
    assert cut == want
    rows = cp.run(spark, root).collect()
    assert {r.doc_id for r in rows} == set(cut) and all(r.length & (r.length - 1) == 0 for r in rows)
