import numpy as np
from llm_data import prose
from pyspark.sql import functions as F

from pairmeter.llm import jaccard, vectors
from pairmeter.llm.common import components, shingle_sets


def _classes(nodes, links):
    low = {n: n for n in nodes}

    def root(n):
        while low[n] != n:
            n = low[n]
        return n
    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _classes({x for a, b in edges if a != b for x in (a, b)}, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _brute_vectors(rows):
    n, links = [0] * len(rows), []
    for i, (_, e, label) in enumerate(rows):
        for j in range(i):
            f, other = rows[j][1], rows[j][2]
            if label is None or label != other or e is None or f is None or len(e) != len(f):
                continue
            a, b = (np.array([np.nan if x is None else x for x in v]) for v in (e, f))
            if np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any() and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                n[i] += 1
                n[j] += 1
                links.append((i, j))
    return n, _classes(range(len(rows)), links)


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)  # many tiles, and a dense group over many of them
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(12)], i % 3) for i in range(240)]
    centre = rng.standard_normal(12)
    rows += [(1000 + i, [float(x) for x in centre + 0.09 * rng.standard_normal(12)], 1) for i in range(150)]
    rows += [(2000 + i, rows[i % 5][1], i % 2) for i in range(40)]
    rows += [(3000, None, 1), (3001, [0.0] * 12, 1), (3002, [float("nan")] * 12, 1), (3003, [None] * 12, 1), (3004, rows[0][1], None), (3005, [1.0, 2.0], 1),
             (3006, [2.0, 4.0], 1), (3006, [2.0, 4.0], 1), (3007, [float("inf"), 1.0], 1), (3008, [], 1)]
    got = vectors.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, unit string")).collect()
    n, low = _brute_vectors(rows)
    want = sorted((r[0], n[i], min(rows[j][0] for j in range(len(rows)) if low[j] == low[i])) for i, r in enumerate(rows))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_passes_follow_the_size_of_a_label(spark):
    sizes = [1, 500, 513, 50_000, 10**6, 10**8]
    rows = spark.createDataFrame([(n,) for n in sizes], "size long").select("size", vectors.n_passes(F.col("size")).alias("p")).collect()
    got = {r["size"]: r.p for r in rows}
    assert got[1] == got[500] == got[513] == 16 and all(a <= b for a, b in zip([got[n] for n in sizes], [got[n] for n in sizes[1:]]))
    assert all((1 - 0.88 ** np.log2(n / 512)) ** got[n] <= 1e-5 for n in sizes[3:])


def test_labels_of_several_sizes_have_their_own_passes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 4)  # 750 tiles: 16 passes lose links here
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24))
    y = x + 0.3 * rng.standard_normal(x.shape)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))] + [(9000, x[0].tolist(), 2), (9001, y[0].tolist(), 2)]
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    n, _ = _brute_vectors(rows[-2:])
    z = np.concatenate([x, y])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    want = (z @ z.T >= 0.93).sum(axis=1) - 1
    assert [got[9000], got[9001]] == n and want.sum() > 1000 and [got[i] for i in range(3000)] == want.tolist()


def _edited(text, seed, edits):
    import random
    r, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def _brute_jaccard(rows, words, percent):
    sets = [set(s.tolist()) for s in shingle_sets([t for _, t in rows], words)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    low = _classes(range(len(rows)), links)
    ids = [d for d, _ in rows]
    best = {}
    for i, c in low.items():
        if ids[i] is not None:
            best[c] = min(best.get(c, ids[i]), ids[i])
    return sorted(((d if d is not None else -1), len(s), best.get(low[i], -1)) for i, (d, s) in enumerate(zip(ids, sets)))


def _compare(spark, rows, words, percent):
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got)
    assert got == _brute_jaccard(rows, words, percent)
    return got


def test_jaccard_join_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "TILE", 32)  # the large group below is compared in tiles
    passage = prose(77, 60)
    rows = [(i, prose(i, 20 + 7 * (i % 40))) for i in range(120)]
    rows += [(200 + i, _edited(prose(300, 240), i, i % 9)) for i in range(110)]
    rows += [(400 + i, passage + " " + prose(500 + i, 12)) for i in range(60)]
    rows += [(500 + i, _edited(prose(i, 20 + 7 * (i % 40)), i, 1 + i % 3)) for i in range(60)]
    rows += [(600 + i, " ".join(prose(9, 9).split()[:i % 10])) for i in range(40)]
    rows += [(700, None), (701, ""), (702, " \n\t"), (703, prose(300, 240).upper()), (704, prose(300, 240)), (704, prose(300, 240)), (None, prose(800, 90)), (None, prose(801, 90)),
             (705, prose(800, 90)), (706, "É é É"), (707, "é é é")]
    got = _compare(spark, rows, 3, 90)
    assert len({c for _, _, c in got}) < len(got)
    _compare(spark, rows, 5, 80)
    _compare(spark, [], 3, 90)


def test_a_tile_names_each_of_its_keys_once(spark):
    rows = [("0:0", [1, 2, 3]), ("0:0", [2, 3, 4]), ("0:0", []), ("0:1", [3, 3]), ("7:0", [])]
    got = [tuple(r) for r in jaccard.tile_keys(spark.createDataFrame(rows, "tile string, keys array<long>")).collect()]
    assert sorted(got) == [("0:0", 1), ("0:0", 2), ("0:0", 3), ("0:0", 4), ("0:1", 3)]


def test_pairs_at_the_threshold_share_a_key():
    rng = np.random.default_rng(8)
    for trial in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n))
        drop = int(rng.integers(0, max(1, len(a) // 10) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, len(a) // 20) + 1)))]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 90 * (len(a) + len(b) - both):
            continue
        often = {int(t): int(rng.integers(2, 200)) for t in np.union1d(a, b)}
        keys = []
        for s, other in ((a, b), (b, a)):
            inside = int(np.searchsorted(s, jaccard.region_end(90)))
            shared = [(often[int(t)], int(t)) for t in s[:inside] if t in other]
            keys.append(set(jaccard.index_keys(len(s), inside, s, shared)))
        assert keys[0] & keys[1] or np.array_equal(a, b), (n, drop)


def test_keep_one_keeps_columns_and_one_of_each_group(odd_documents, no_documents):
    kept = jaccard.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == [-1, -1, 1, 4, 5, 6, 6, 7, 8, 9, 10, 11, 12]
    assert jaccard.keep_one(no_documents).count() == 0
