"""Manifest, hard negatives and quality rules: against brute force, and on odd tables."""

import collections
import hashlib
import random
import zlib

import numpy as np

from tapeweave.llm import manifest, negatives, quality

from .test_operators import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use themselves.
CLASHING = "tree string, idx long, digest binary, n long, left string, _at long, root int, h long, q string, key long, shard int, cells int, y int, fold int, kept string, probability int"
REST = ("x", 1, b"x", 2, "l", 3, 4, 5, "q", 6, 7, 8, 9, 0, "k", 1)


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifest ------------------------------------------------------------------------------------


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, i):
    for nodes in tree[:-1]:
        first = i // 8 * 8
        yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 8])
        i //= 8


def leaf(row, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def brute_manifest(rows):
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        made[name] = levels([x[2] for x in trees[name]])
    top, out = levels([made[name][-1][0] for name in names]), []
    for k, name in enumerate(names):
        for i, (*_, own, r) in enumerate(trees[name]):
            path = [*siblings(made[name], i), *siblings(top, k)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            x = leaf(r, r[1] and r[1].translate(LOWER)) if tampered else own
            for a, b in path:
                x = H(a + x + b)
            out.append((r[0], own, made[name][-1][0], top[-1][0], H("".join(a + b for a, b in path)), x))
    return sorted(out, key=repr)


DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def documents(n, seed=1):
    rng = random.Random(seed)
    return [(i, prose(rng, 5, 500).title(), rng.choice(["en", "en", "en", "de", None, "é"]), "s", i) for i in range(n)]


def test_manifest_of_odd_tables(spark):
    rows = documents(1500)
    rows += [(None, "A", "en", None, None)] * 20 + [(None, f"A{i}", None, "s", 1) for i in range(30)]  # null ids
    rows += [(7, "Other", "en", "s", 1), rows[9], rows[9], (6000, None, "lone", "s", 0), (6001, "", "", "s", 0), (6002, "Ab " * 20_000, "de", None, None)]
    random.Random(2).shuffle(rows)
    for given in (rows, rows[:1], [], documents(9), [(i, "T", "en", "s", 1) for i in range(513)]):
        df = spark.createDataFrame([(*r, *REST) for r in given], f"{DOCS}, {CLASHING}").repartition(5)
        got = manifest.of_documents(df).proved("tampered", "doc_id").collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(given)


def test_versions_copy_ancestors_only(spark):
    """A version's nodes are its own copies and the untouched nodes of the first tree."""
    rows = [r for r in documents(700, 3) if r[2] == "en"]
    rows = rows + [(5000 + i, "A b", "de", "s", 1) for i in range(3)]
    built = manifest.of_documents(spark.createDataFrame(rows, DOCS))
    copied = collections.defaultdict(dict)
    for r in built.versions("tampered", "doc_id").collect():
        copied[r.doc_id][r.level] = r.digest
    order = {lang: sorted(r for r in rows if r[2] == lang) for lang in ("de", "en")}
    first = {lang: levels([leaf(r, r[1]) for r in own]) for lang, own in order.items()}
    assert set(copied) == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 0}
    for lang, own in order.items():
        for i, r in enumerate(own):
            if r[0] in copied:
                changed = levels([leaf(x, x[1].translate(LOWER) if x is r else x[1]) for x in own])
                top = levels([changed[-1][0] if name == lang else first[name][-1][0] for name in ("de", "en")])
                height, place = len(changed), i
                for level, (now, before) in enumerate(zip(changed, first[lang], strict=True)):
                    assert copied[r[0]][level] == now[place]
                    assert [a for k, a in enumerate(now) if k != place] == [a for k, a in enumerate(before) if k != place]
                    place //= 8
                assert copied[r[0]] == {**{k: copied[r[0]][k] for k in range(height)}, height: top[-1][0]}


# --- hard negatives ------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, k=3):
    use = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(int).tolist()) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, la, q in use:
        if a is None or a % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, w, strict=False)), last(i), i, lb) for i, lb, w in use if i != a), key=lambda s: s[:2])
        for p, _, pid, lp in [s for s in scored if s[3] == la][:5]:
            fits = [(i, -s) for s, _, i, lb in scored if lb != la and 50 * -p <= 100 * -s <= 95 * -p][:k]
            out += [(a, pid, j + 1, i, -p, s) for j, (i, s) in enumerate(fits)]
    return sorted(out, key=repr)


def mined(spark, rows, schema=VECTORS, rest=()):
    df = spark.createDataFrame([(*r, *rest) for r in rows], schema).repartition(3)
    return sorted((tuple(r) for r in negatives.mined(df).collect()), key=repr)


def clustered(n, seed, width=12, groups=20):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, width))
    return [(i, (middle[rng.integers(groups)] + rng.normal(size=width) * 0.1).tolist(), int(rng.integers(10))) for i in range(n)]


def test_negatives_equal_brute_force(spark):
    rows = clustered(900, 5)
    assert mined(spark, rows) == brute_negatives(rows) != []


def test_negatives_of_odd_tables(spark):
    rows = clustered(260, 6)
    rows += [(300, rows[50][1], 3), (350, rows[50][1], 4), (50, rows[3][1], 1)]  # equal vectors, an anchor's id again
    rows += [(400 + i, rows[100][1], i % 3) for i in range(60)]  # a hot vector
    rows += [(None, rows[7][1], 2), (None, rows[8][1], None), (501, None, 1), (502, [1.0, None], 1), (503, [float("nan")] * 12, 1), (504, [float("inf")] * 12, 1)]
    rows += [(505, [0.5] * 7, 2), (550, [], 2), (551, [0.1] * 14, 2), (600, [-1.0] * 12, 5), rows[20], rows[20]]
    got = mined(spark, rows, f"{VECTORS}, {CLASHING}", REST)
    assert got == brute_negatives(rows)
    large = [(i, [x * 3000 for x in v], label) for i, v, label in clustered(120, 7)]
    assert mined(spark, large) == brute_negatives(large)
    assert mined(spark, []) == [] and mined(spark, rows[50:51]) == [] and mined(spark, [(None, [1.0], 1)]) == []


def test_walk_visits_all_cells_by_falling_sums():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=7), rng.normal(size=5)
    seen = list(negatives.walk(a, b))
    assert sorted((i, j) for _, i, j in seen) == [(i, j) for i in range(7) for j in range(5)]
    assert [s for s, *_ in seen] == sorted((s for s, *_ in seen), reverse=True) and all(s == a[i] + b[j] for s, i, j in seen)


def test_search_stops_before_it_has_seen_all_cells(spark, monkeypatch):
    """In clustered data the second pass ends early, and bounds hold for every row."""
    monkeypatch.setattr(negatives, "FIRST", 100)
    rows = spark.createDataFrame(clustered(3000, 9), VECTORS)
    made = negatives.common.stored(negatives.prepared(rows), "t")
    index, placed = negatives.build(made)
    got = placed.collect()
    x, cell = np.array([r.q for r in got]), np.array([r.cell for r in got])
    assert (np.bincount(cell, minlength=len(index.count)) == index.count).all() and len(got) == 3000
    (low0, up0), (low1, up1) = index.bounds(x[:40])
    score, codes = x[:40] @ x.T, len(index.books[1])
    assert (score <= up0[:, cell // codes] + up1[:, cell % codes]).all() and (score >= low0[:, cell // codes] + low1[:, cell % codes]).all()
    any_score = negatives.F.array(negatives.F.lit(negatives.LOWEST)).alias("low"), negatives.F.array(negatives.F.lit(negatives.HIGHEST)).alias("high")
    asks = made.where("vec_id % 50 = 0").select("*", *any_score)
    found = collections.defaultdict(list)
    for r in negatives.search(index, placed, asks, True, 5).orderBy("rank").collect():
        found[r.anchor].append(r.score)
    of, label = {r.key: i for i, r in enumerate(got)}, np.array([r.label for r in got])
    floors = []
    for key, best in found.items():
        s = x @ x[of[key]]
        s[of[key]] = negatives.LOWEST
        assert best == sorted(s[label == label[of[key]]].tolist(), reverse=True)[:5]
        floors.append((key, best[-1]))
    floor = asks.join(spark.createDataFrame(floors, "key long, f long"), "key").select("key", "vec_id", "label", "q", negatives.F.array("f").alias("low"), "high")
    visited = [len(r.cells) for after in (False, True) for r in negatives._visits(index, floor, after).collect()]
    assert sum(visited) < 0.5 * len(floors) * (index.count > 0).sum()


# --- quality rules -------------------------------------------------------------------------------


def test_quality_of_odd_tables(spark):
    rng = random.Random(10)
    good = [(i, prose(rng, 80, 2000)) for i in range(200)]
    bad = [(200 + i, "".join(w + rng.choice(["###", "$$$"]) + " " for w in prose(rng, 80, 2000).split())) for i in range(100)]
    odd = [(None, None), (1000, None), (1001, ""), (1002, " \n\n \t"), (1003, "é" * 3), (1004, "a b"), (1005, "word " * 30_000), (None, good[0][1]), (5, good[5][1]), (5, bad[0][1]), (1006, "x y\nx y\n\nx y \n"), (1007, good[1][1] + "|&<")]
    docs = spark.createDataFrame([(*r, *REST) for r in good + bad + odd], f"doc_id long, text string, {CLASHING}").repartition(4)
    labels = [(i, 1, 0) for i in range(0, 200, 2)] + [(i, 0, 0) for i in range(200, 300, 2)] + [(0, None, 0), (None, 0, 0), (2, 1, 1), (77777, 0, 0)]
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = collections.defaultdict(list)
    for r in quality.judged(docs, model, ("doc_id", "n")).collect():
        found[r.doc_id].append(r)
        assert r.n == REST[3]
    held = [found[i][0].kept == (i < 200) for i in range(1, 300, 2) if i != 5]
    assert sum(len(v) for v in found.values()) == len(good + bad + odd) and np.mean(held) > 0.97
    base = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert base(found[1000][0]) == base(found[1001][0]) == base(found[1002][0]) == (0, 0, 0, 0, 0, True)
    assert base(found[1003][0]) == (1, 3, 0, 0, 0, True) and base(found[1005][0]) == (30_000, 120_000, 0, 0, 30_000, True)
    assert base(found[1006][0]) == (6, 6, 0, 1, 6, True) and found[1007][0].n_symbols == 3
    assert sorted(r.kept for r in found[5]) == [False, True, True] and not any(r.kept for r in found[1005])
    # one kind of label, or none: the base rules alone; an empty table gives no rows
    for rows in ([(i, 1, 0) for i in range(200)], []):
        alone = quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert alone.weight is None and all(r.kept != r.base_failed for r in quality.judged(docs, alone).collect())
    assert quality.judged(docs.limit(0), quality.fit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect() == []
