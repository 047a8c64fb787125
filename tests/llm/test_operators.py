"""Each operator on small made-up rows: against brute force, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeweave.llm import chat, common, dac, hmm, jaccard, merkle, packing, pii, tokens, toxicity, urls, winnowing

DOC = "doc_id long, text string, lang string, score double, n_words long, spans string"


def docs(spark, texts, start=0):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(start + i, t, "en", 0.5, 7, "x") for i, t in enumerate(texts)], DOC)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", "   ", "one", "é", "a\0b", "日本 語", "x" * 50_000, "a b\n\n c  d\t", "same text here twice now", "same text here twice now"]


# --- tokens, packing, token files ----------------------------------------------------------------


def test_cached_encoding_equals_the_library():
    enc = tokens.Encoder(tokens.tokenizer_path(), 50)
    texts = [t or "" for t in ODD] + ["  a  b ", "\n a", "it's 'll  don't!!", "<|endoftext|> x", "a\n\nb\nc 'll", "q \0a r", " ", "word, word. word", "a\n"]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_a_word_is_kept_once_whatever_mark_follows():
    enc = tokens.Encoder(tokens.tokenizer_path())
    text = "zorbly, quent. zorbly. quent, zorbly quent\nzorbly.. quent,, Zé. 7, b"
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert {"quent", "zorbly"} <= enc.known.keys() and not {"quent.", "zorbly.", "quent,", "zorbly,"} & enc.known.keys()


@pytest.mark.parametrize("select", ["norm", "dot"])
def test_plan_fills_sequences_within_every_capacity(select):
    rng = random.Random(3)
    histogram = Counter(rng.randint(1, 64) for _ in range(3000))
    cap = packing.Capacity(64, 5, 2500, (1.0, 0.3, 0.2), select)
    histogram = {n: c for n, c in histogram.items() if n <= 50}
    bins = {}
    placed = Counter()
    for length, _first, number, each, sequence, offset in packing.plan(histogram, cap):
        placed[length] += number * each
        for s in range(number):
            bins.setdefault(sequence + s, []).extend((offset + k * length, length) for k in range(each))
    assert dict(placed) == histogram
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 64 and len(own) <= 5 and sum(n * n for _, n in own) <= 2500


def test_packing_places_every_piece_once(spark):
    rng = random.Random(5)
    texts = [*ODD, *(prose(rng, rng.randint(1, 1500)) for _ in range(30))]
    rows = packing.pack_documents(docs(spark, texts)).toPandas()
    enc = tokens.Encoder(tokens.tokenizer_path())
    for i, t in enumerate(texts):
        ids = np.append(np.frombuffer(enc.encode(t or ""), enc.dtype), 2).astype("<u4")
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 1024).all() and own.length.max() <= 1024
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 1024
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 1024) + 1
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_sequences_hold_the_ids_of_their_pieces(spark):
    rng = random.Random(6)
    texts = [*ODD, *(prose(rng, rng.randint(1, 900)) for _ in range(12))]
    enc = tokens.Encoder(tokens.tokenizer_path())
    ids = [np.append(np.frombuffer(enc.encode(t or ""), enc.dtype), 2).astype("<u4") for t in texts]
    packed = packing.pack_documents(docs(spark, texts), with_ids=True)
    found = {r.sequence_id: (r.doc_ids, np.frombuffer(r.ids, "<u4")) for r in packing.sequences(packed).collect()}
    assert sum(len(x) for _, x in found.values()) == sum(map(len, ids))
    for r in packed.collect():
        own = found[r.sequence_id]
        assert r.doc_id in own[0] and own[1][r.offset : r.offset + r.length].tolist() == ids[r.doc_id][r.start : r.start + r.length].tolist()


def test_codes_give_any_token_without_decoding_the_rest():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = np.minimum(rng.geometric(0.001, n) ** 2, 2**31 - 1).astype(np.uint32)
        for bits in (8, 16):
            codes = dac.Codes(dac.pack_codes(ids, bits), bits)
            assert len(codes) == n and codes.decode().tolist() == ids.tolist()
            assert [codes[i] for i in range(0, n, 37)] == ids[::37].tolist()
            assert codes.decode(n // 3, n // 2).tolist() == ids[n // 3 : n // 2].tolist()
            with pytest.raises(IndexError):
                codes[n]


def test_token_files_round_trip_and_random_access(spark, tmp_path):
    path = f"file://{tmp_path}/files"
    table = docs(spark, ODD).union(docs(spark, ["again"], 3)).repartition(3)
    dac.write_token_files(table, path, shard_ids=40)
    rows = dac.read_documents(spark, path).orderBy("start").collect()
    enc = tokens.Encoder(tokens.tokenizer_path())
    assert [r.doc_id for r in rows] == sorted([*range(len(ODD)), 3])
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id != 3:
            ids = [*np.frombuffer(enc.encode(ODD[r.doc_id] or ""), enc.dtype).tolist(), 0]
            assert r.ids == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    flat = [i for r in rows for i in r.ids]
    wanted = spark.createDataFrame([(p,) for p in (0, 5, at - 1, at + 10, -1)], "position long")
    assert {r.position: r.token for r in dac.read_tokens(spark, path, wanted).collect()} == {p: flat[p] for p in (0, 5, at - 1)}
    dac.write_token_files(docs(spark, []), f"{path}-none")
    assert dac.read_documents(spark, f"{path}-none").count() == 0


def crowded(spark, n):
    """A third of the rows without id, a third of one id, nothing in one place; ids beyond 2^53 too."""
    texts = [f"text number {i % (n - 5)} of the crowd" for i in range(n)]
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else (2**60 + i * 2**40 if i % 2 else i) for i in range(n)]
    return [*zip(ids, texts, strict=True)], spark.createDataFrame([*zip(ids, texts, strict=True)], "doc_id long, text string").repartition(5)


def test_crowded_ids_fill_several_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dac, "BUCKET_ROWS", 10)
    pairs, table = crowded(spark, 300)
    path = f"file://{tmp_path}/crowd"
    dac.write_token_files(table, path)
    files, _ = dac.open_token_files(spark, path)
    assert max(len(r.doc_ids) for r in files.collect()) < 40
    rows = dac.read_documents(spark, path).orderBy("start").collect()
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert [r.doc_id for r in rows] == sorted((i for i, _ in pairs), key=lambda i: (i is not None, i))
    enc = tokens.Encoder(tokens.tokenizer_path())
    assert Counter((r.doc_id, tuple(r.ids[:-1])) for r in rows) == Counter((i, tuple(np.frombuffer(enc.encode(t), enc.dtype).tolist())) for i, t in pairs)
    hashes = dac.hash_ids([np.array(r.ids, enc.dtype).tobytes() for r in rows]).tolist()
    inside = [(r.doc_id is not None, r.doc_id, h) for r, h in zip(rows, hashes, strict=True)]
    assert inside == sorted(inside, key=lambda x: (x[0], x[1] or 0, x[2]))


# --- decontamination, near duplicates ------------------------------------------------------------

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_winnowing_equals_brute_force(spark):
    rng = random.Random(11)
    items = [prose(rng, 30, 50), "Short item, of FIVE words", "tiny", None, "", prose(rng, 12, 8), prose(rng, 9, 3)]
    texts = [*ODD, "tiny", prose(rng, 3000, 3), *(prose(rng, 40, 60) + " " + (items[0] if i % 2 else "short ITEM of five words") + " " + prose(rng, 5) for i in range(6)), *(prose(rng, 60, 4) for _ in range(20))]
    table = docs(spark, texts).union(docs(spark, [items[0]], 40)).union(docs(spark, [items[0]], 40))
    bench = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)] + [(None, "tiny"), ("i0", items[0])], "item_id string, text string")
    windows = {}
    for i, t in [(f"i{k}", t) for k, t in enumerate(items)] + [("", "tiny")]:
        w = _WORD.findall(low(t))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    got = winnowing.contamination(table, bench, filter_bits=1 << 12).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        w = _WORD.findall(low(texts[r.doc_id] if r.doc_id < len(texts) else items[0]))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        assert (r.n_words, r.n_hit, r.item_ids) == (len(w), len(hit), sorted(found)), r.doc_id
    assert winnowing.contamination(docs(spark, []), bench).count() == 0
    assert winnowing.contamination(docs(spark, ["a b"]), bench.limit(0)).collect()[0].n_hit == 0


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    head = list(range(len(texts)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(rng, text, share):
    return " ".join(f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(7)
    texts = list(ODD)
    for size in (4, 6, 7, 8, 9, 11, 14, 20, 40, 80, 160):
        base = prose(rng, size)
        texts += [base, *(edited(rng, base, rng.choice([0.005, 0.02, 0.04, 0.06])) for _ in range(5)), base + " tail", "head " + base]
    line = prose(rng, 60)
    texts += [line + " " + prose(rng, rng.randint(5, 60)) for _ in range(25)]  # a passage that many share
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert got == dict(enumerate(want))


def test_large_clusters_are_compared_in_parts(spark, monkeypatch):
    for name, value in {"PART": 6, "HEADS": 2, "LOOSE": 3, "OTHERS": 5, "GIANT": 30, "FEW": 5}.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(17)
    base, texts = prose(rng, 120, 10**6), []
    texts += [edited(rng, base, 0.02) for _ in range(40)]  # many link
    texts += [edited(rng, base, 0.035) for _ in range(60)]  # some do
    half = prose(rng, 60, 10**6)
    texts += [half + " " + prose(rng, rng.randint(8, 40), 10**6) for _ in range(60)]  # near the threshold, few do
    rng.shuffle(texts)
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert got == dict(enumerate(want))
    assert 20 < len({c for _, c in want}) < 120


def test_jaccard_join_on_odd_tables(spark):
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0
    twice = docs(spark, ["a b c d e f", None]).union(docs(spark, ["a b c d e f", None]))
    assert sorted(tuple(r) for r in jaccard.near_duplicates(twice).collect()) == [(0, 2, 0)] * 2 + [(1, 0, 1)] * 2


def test_index_entries_are_told_apart_by_40_bits(spark):
    sig = np.array([0x1122334455667788, 0x1122334456667788, 0x9122334455667788, 0x91223344556677FF], np.uint64)
    blobs = list(jaccard._blobs(np.zeros(4, np.int64), jaccard._packed(sig), np.array([5, 6, 7, 8])))
    rows = [tuple(r.values()) for b in blobs for r in b.to_pylist()]
    found = jaccard.candidates(spark.createDataFrame(rows, jaccard._BLOB)).collect()
    assert [tuple(r) for r in found] == [(7, 8)]  # only those whose hashes have 40 bits in common


def test_sketches_differ_in_no_more_bits_than_sets_in_members():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 900, np.uint64)
    sets = [np.unique(rng.choice(pool, size)) for size in (1, 5, 60, 300, 600, 600)]
    for bits in (64, 1024, 8192):
        rows = np.frombuffer(b"".join(jaccard.sketch(x, bits) for x in sets), np.uint8).reshape(len(sets), -1)
        apart = jaccard._bits_apart(rows, rows)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                differ = len(np.setxor1d(x, y))
                assert apart[i, j] <= differ and apart[i, j] % 2 == differ % 2
        assert bits < 8192 or apart[4, 5] > 0.8 * len(np.setxor1d(sets[4], sets[5]))


def test_sketches_cut_clusters_of_sets_that_are_not_alike(spark, monkeypatch):
    for name, value in {"PART": 6, "HEADS": 2, "SKETCHED": 7}.items():
        monkeypatch.setattr(jaccard, name, value)
    compared, in_parts = [], jaccard.in_parts
    monkeypatch.setattr(jaccard, "in_parts", lambda docs, clusters, *a: compared.append(clusters.groupBy("cluster").count().collect()) or in_parts(docs, clusters, *a))
    rng = random.Random(23)
    half, texts = prose(rng, 60, 10**6), []
    texts += [half + " " + prose(rng, rng.randint(32, 50), 10**6) for _ in range(50)]  # they share a passage, none is alike
    texts += [texts[0] + " tail", "head " + texts[0], edited(rng, texts[1], 0.01)]
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert got == dict(enumerate(want))
    clusters = spark.createDataFrame([(i, 1) for i in range(len(texts))], "doc_id long, cluster long")
    made = docs(spark, texts).withColumn("text_hash", F.xxhash64("text"))
    sizes = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(want)], "doc_id long, n long")
    rows = made.join(clusters, "doc_id").join(sizes, "doc_id").select(F.col("doc_id").alias("class"), "cluster", "doc_id", "text_hash", "n")
    linked = {(r.a, r.b) for r in jaccard.alike(made, rows, 5, 75).collect()}
    assert {x for pair in linked for x in pair} == {0, 1, 50, 51, 52}
    assert max((r["count"] for r in compared[0]), default=0) <= 6


def test_shuffle_files_of_written_tables_are_removed(spark):
    import glob
    import time

    at = spark.sparkContext.getConf().get("spark.local.dir")
    files = lambda: set(glob.glob(f"{at}/**/shuffle_*.data", recursive=True))
    before = files()
    with common.scratch(spark) as keep:
        made = keep(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 97).alias("k")).count(), "made")
        assert len(made.collect()) == 97
    assert len(common.stored(spark.range(5000).repartition(3, "id"), "made").collect()) == 5000
    left = time.time() + 20
    while (more := files() - before) and time.time() < left:
        time.sleep(0.2)
    assert not more
    assert spark.conf.get(common.CLEARED) == "false"


# --- fingerprints, language model ----------------------------------------------------------------


def test_fingerprints_tell_equality_and_place_of_edits(spark):
    rng = random.Random(2)
    text = "\n".join(prose(rng, 12) + "." for _ in range(40))
    assert "".join(merkle.paragraphs(text)) == text
    lines = text.split("\n")
    lines[20] = "something else entirely."
    other = "\n".join(lines)
    a, b = merkle.fingerprint(text), merkle.fingerprint(other)
    assert merkle.likeness(a, a) == 1 and 0.8 < merkle.likeness(a, b) < 1 and merkle.edits(a, a) == []
    (i, j, k, m), *more = merkle.edits(a, b)
    assert not more and "".join(merkle.paragraphs(text)[:i]) == "".join(merkle.paragraphs(other)[:k]) and j > i and m > k
    got = {r.doc_id: r.fingerprint for r in merkle.fingerprints(docs(spark, ODD)).collect()}
    assert got[0] == got[1] and got[9] == got[10] and len(set(got.values())) == len(ODD) - 2


def test_next_document_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_A_BUCKET", 3)
    texts = [f"t{i}" for i in range(20)]
    rows = docs(spark, texts).repartition(5)
    got = {r.doc_id: r.next_text for r in merkle.with_next(rows).collect()}
    assert got == {i: texts[(i + 1) % 20] for i in range(20)}
    assert [r.next_text for r in merkle.with_next(docs(spark, ["only"])).collect()] == ["only"]
    assert merkle.with_next(docs(spark, [])).count() == 0


def test_next_document_with_crowded_ids(spark, monkeypatch):
    for size in (3, 10, 1000):
        monkeypatch.setattr(merkle, "ROWS_A_BUCKET", size)
        pairs, table = crowded(spark, 120)
        order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, xxhash.xxh64_intdigest(p[1].encode(), 42) >> 32, p[1]))
        want = Counter((i, t, u) for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True))
        assert Counter(map(tuple, merkle.with_next(table).collect())) == want


def test_fingerprints_are_small_beside_their_texts():
    rng = random.Random(5)
    texts = [prose(rng, n) for n in (300, 900, 2000)]
    assert sum(map(len, map(merkle.fingerprint, texts))) < 0.25 * sum(map(len, texts))


def test_forward_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(4)
    states, size = 3, 5
    norm = lambda x: (x / x.sum(-1, keepdims=True)).astype(np.float32)
    m = hmm.Model(norm(rng.random(states)), norm(rng.random((states, states))), np.ascontiguousarray(norm(rng.random((states, size))).T))
    texts = [rng.integers(0, size, n) for n in (4, 1, 6, 9)]
    length, alone = np.array([len(t) for t in texts]), norm(rng.random(size))
    got = hmm.forward(*hmm.against(m, alone), np.concatenate(texts), length)
    for t, log in zip(texts, got, strict=True):
        total = 0.0
        for path in np.ndindex(*[states] * len(t)):
            p = m.start[path[0]] * m.emit[t[0], path[0]]
            for a, b, w in zip(path, path[1:], t[1:], strict=False):
                p *= m.move[a, b] * m.emit[w, b]
            total += p
        assert abs(np.log(total) - log - np.log(alone[t]).sum()) < 1e-4
    before = 0.0
    for k in range(6):  # Baum-Welch never loses likelihood, but for its smoothing
        s, mv, e, log = hmm.expected(*hmm.against(m, alone), np.concatenate(texts), length)
        assert e.sum() == pytest.approx(length.sum(), rel=1e-4) and (k == 0 or log > before - 1e-3)
        before, m = log, hmm.Model((s / s.sum()).astype(np.float32), norm(mv + 1e-9), (e / e.sum(0)).astype(np.float32) + 1e-9)


def test_base_score_and_mass_of_the_model(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 20)
    monkeypatch.setattr(hmm, "BUCKET_WORDS", 10)
    rng = random.Random(9)
    texts = [*ODD, *(prose(rng, 50, 80) for _ in range(30))]
    table = docs(spark, texts).union(docs(spark, ["same row"], 90)).union(docs(spark, ["same row"], 90))
    train = table.where("doc_id % 3 > 0")
    v, model, counts = hmm.train(train, states=3)
    assert abs(model.emit.sum(0) - 1).max() < 1e-3 and len(v.head) <= 20
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    c = Counter(w for r in train.collect() for w in split(r.text))
    n, size = sum(c.values()), len(c)
    assert (v.total, v.distinct) == (n, size)
    got = hmm.score(table, v, model, counts).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        w = split(texts[r.doc_id] if r.doc_id < len(texts) else "same row")
        want = sum(np.log10((c[x] + 0.1) / (n + 0.1 * (size + 1))) for x in w)
        assert (r.n_tokens, r.n_known) == (len(w), sum(c[x] > 0 for x in w)) and r.base_score == pytest.approx(want) and r.score < 0
    none = hmm.train(train.limit(0), states=2)
    assert hmm.score(docs(spark, ["a b"]), *none).collect()[0].n_known == 0


# --- toxicity ------------------------------------------------------------------------------------


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(8)

    def brute(gain):
        if not (gain > 0).any():
            return []
        best = max(((gain[i:j].sum(), -(j - i), -i, i, j) for i in range(len(gain)) for j in range(i + 1, len(gain) + 1)))
        i, j = best[3], best[4]
        return [(a, b) for a, b in brute(gain[:i])] + [(i, j)] + [(a + j, b + j) for a, b in brute(gain[j:])]

    for _ in range(40):
        gain = rng.normal(-0.2, 1, 14)
        assert [(a, b) for a, b, _ in toxicity.segments(gain)] == brute(gain)


def test_toxicity_is_learned_and_passages_are_placed(spark):
    rng = random.Random(1)
    bad = ["foul", "nasty", "vile"]
    texts, labels = [], []
    for i in range(300):
        words = prose(rng, 60).split(" ")
        if i % 3 == 0:
            words[20:23] = rng.sample(bad, 3)
        texts.append(" ".join(words))
        labels.append((i, 1, int(i % 3 == 0)))
    table = docs(spark, [*texts, "é clean words then foul nasty vile end", None])
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, label.where("doc_id < 200"))
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert all((got[i].score >= 0.7) == (i % 3 == 0) for i in range(200, 300))
    assert [("é clean words then foul nasty vile end")[p.start : p.stop] for p in got[300].passages] == ["foul nasty vile"]
    assert 0 <= got[301].score < 0.7 and got[301].n_words == 0
    kept = toxicity.below(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.where("doc_id >= 200").collect()} == {i for i in range(200, 302) if i % 3 and i < 300 or i == 301}


def test_more_toxic_words_never_lower_a_score(spark):
    rng, bad = random.Random(8), ["foul", "nasty", "vile"]
    texts = [prose(rng, rng.randint(5, 200), 3000) for _ in range(400)]
    for i in range(0, 400, 4):
        words = texts[i].split(" ")
        words[3:3] = rng.choices(bad, k=rng.randint(2, 12))
        texts[i] = " ".join(words)
    table = docs(spark, texts)
    model = toxicity.fit(table, spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int"))
    assert (model.curve[1:] >= 0).all() and model.curve[1:].any()
    rows = []
    for i in range(0, 400, 10):
        words = texts[i].split(" ")
        for step in range(12):
            rows.append((i * 100 + step, " ".join(words)))
            at = rng.randint(0, len(words))
            words[at:at] = rng.choices(bad, k=rng.randint(1, 40))
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i in range(0, 400, 10):
        own = [got[i * 100 + step] for step in range(12)]
        assert own == sorted(own) and own[-1] > 0.9


def test_toxicity_without_both_labels_rejects_nothing(spark):
    label = spark.createDataFrame([(0, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    table = docs(spark, ODD)
    assert {r.score for r in toxicity.score(table, toxicity.fit(table, label)).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), toxicity.fit(docs(spark, []), label.limit(0))).count() == 0


# --- personal data, urls, chats ------------------------------------------------------------------

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(_BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum((int(x) * 2 - 9 if int(x) > 4 else int(x) * 2) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_personal_data_base_spans_on_random_strings(spark):
    rng = random.Random(6)
    parts = ["a@b.c", "x_y@d-e.f.g", "@", "1.2.3.4", "300.1.1.1", "0255.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (523) 555-1055", "+", " ", "é", "𝒳", ".", "12", "-", "mail me at ", "7536784127813050 4845168114407329", "5.6.7.8.9.10.11.12", "a@b.c_x@d.e", "\n"]
    texts = [*ODD, "1" * 5000, "a@" + "b." * 3000 + "c", *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(300))]
    table = docs(spark, texts)
    rows = pii.with_spans(table, pii.train(table)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(s.start, s.rank, s.stop, s.kind) for s in r.spans if s.base] == base_spans(texts[r.doc_id]), texts[r.doc_id]
        assert all(texts[r.doc_id][s.start : s.stop] == s.text for s in r.spans)


def test_secrets_are_added_and_all_spans_redacted(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    table = docs(spark, [f'set token = "{hashlib.sha1(str(i).encode()).hexdigest()}" now, mail a{i}@b.com' for i in range(50)] + [f'the token = "{key}" é', "clean words only", None])
    model = pii.train(table)
    out = {r.doc_id: r.text for r in pii.redacted(table, model).collect()}
    assert out[50] == 'the token = "[SECRET]" é' and out[51] == "clean words only" and out[52] is None
    assert out[0].endswith("now, mail [EMAIL]") and pii.redacted(table, model).columns == table.columns
    assert pii.with_spans(docs(spark, []), pii.train(docs(spark, []))).count() == 0


def test_url_rules_longest_wins_and_mined_rules_match(spark):
    pages = [("https://a.example.com/en/71", "x"), ("http://example.com/en/8", "x"), ("x://de.net/de/1", "x"), ("x://www.example.net/de/8?q=1", "x"), (None, "x"), ("no scheme", "x"), ("http://Bad-Spam.Site.org/p", "x"), ("http://", "x"), ("a://b://c/d", "x")]
    pages += [(f"http://bad-spam{i}.site.org/p", "x") for i in range(20)] + [(f"http://fine{i}.place.org/p", "x") for i in range(20)]
    table = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, int(i >= 29), 0) for i in range(9, 49)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urls.judged(table, labels, support=0.1).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(4)] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block")]
    assert [(got[i].host, got[i].path) for i in (4, 5, 6, 7, 8)] == [("", ""), ("", ""), ("bad-spam.site.org", "/p"), ("", ""), ("b:", "//c/d")]
    assert got[6].verdict == "block" and got[6].because and got[4].verdict == "allow" and got[40].verdict == "allow"
    assert urls.judged(table.limit(0), labels).count() == 0
    assert {r.verdict for r in urls.judged(table, labels.limit(0)).where("rule is null").collect()} == {"allow"}


def test_chat_layouts_are_found_by_their_fingerprint_and_read_back(spark):
    said = "</s>[INST] ok [/INST] <|end|> \\ <s> <<SYS>>x<</SYS>> \\\\<| <\\| é"
    rows = spark.createDataFrame(
        [
            (1, "p", "r", None, None, None, None, None),
            (2, None, None, "do", "with", "done", None, None),
            (3, None, None, "do", None, said, None, None),
            (4, None, None, None, None, None, [("human", said), ("gpt", "b"), (None, None)], None),
            (5, None, None, None, None, None, None, "odd"),
        ],
        "conv_id long, prompt string, response string, instruction string, input string, output string, conversations array<struct<`from`:string,value:string>>, other string",
    )
    layouts = {r.conv_id: r.layout for r in chat.canonical(rows).collect()}
    assert layouts == {1: "prompt", 2: "instruction", 3: "instruction", 4: "conversations", 5: "unknown"}
    back = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in chat.parsed(chat.formatted(chat.conversations(rows))).collect()}
    assert back[1] == [("user", "p", False), ("assistant", "r", True)]
    assert back[2] == [("user", "do", False), ("user", "with", False), ("assistant", "done", True)]
    assert back[3][-1] == ("assistant", said, True) and back[4] == [("user", said, False), ("assistant", "b", True), ("", "", False)]
    assert 5 not in back


def test_turn_rows_with_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, None, "x"), (2, None, "as<|sistant", "\n")], "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.conversations(rows))
    assert all("<|" not in re.sub(r"<\|(turn|text|end)\|>", "", r.formatted) for r in out.collect())
    back = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in chat.parsed(out).collect()}
    assert back == {1: [("user", "a", False), ("assistant", "", True), ("assistant", "", True)], None: [("", "x", False)], 2: [("as<|sistant", "\n", False)]}
    assert chat.parsed(chat.formatted(chat.conversations(rows.limit(0)))).count() == 0
    assert F.col("x") is not None


def test_every_text_is_learned_from_in_its_slice_and_at_the_end(spark, monkeypatch):
    rng = random.Random(21)
    # one long text comes first; a rare language is in a few texts
    texts = [prose(rng, 3000, 300), *(prose(rng, 100, 300) for _ in range(300)), *(" ".join(f"rare{rng.randrange(40)}" for _ in range(60)) for _ in range(60))]
    table, sizes, sums = docs(spark, texts), [], hmm._sums

    def watched(*args):
        found, size = sums(*args)
        sizes.append(size)
        return found, size

    monkeypatch.setattr(hmm, "_sums", watched)
    v, model, counts = hmm.train(table, states=3)
    assert len(sizes) == hmm.SLICES + 1 and sum(sizes[:-1]) == sizes[-1] == v.total
    # what only a few texts hold is learned: texts like them are likelier than by words alone
    more = docs(spark, [" ".join(f"rare{rng.randrange(40)}" for _ in range(60)), prose(rng, 100, 300)])
    gain = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in hmm.score(more, v, model, counts).collect()}
    assert gain[0] > 0.3 and gain[1] > 0


def test_symbols_are_stored_whole_whatever_the_row(spark, monkeypatch):
    rng = random.Random(22)
    table = docs(spark, [*ODD, prose(rng, 500)])
    v = hmm.vocabulary(hmm.word_counts(table.select("text")).cache(), table.count())
    found = []
    for size in (1, 50, 1 << 16):
        monkeypatch.setattr(hmm, "ROW_SYMBOLS", size)
        rows = hmm.stored_symbols(table, v, lambda df, *_: df).collect()
        texts = []
        for r in rows:
            sym, n = np.frombuffer(r["sym"], "<u4"), np.frombuffer(r["lengths"], "<u4")
            texts += [t.tobytes() for t in np.split(sym, np.cumsum(n)[:-1])]
        assert sum(map(len, texts)) == 4 * v.total
        found.append(sorted(texts))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(ODD) + 1


def test_other_fields_leave_layouts_known_and_unknown_ones_stay(spark):
    kind = "conv_id long, source string, prompt string, response string, messages array<struct<role:string,content:string,name:string>>, body string, turn long, role string, text string"
    null = (None,) * 3
    data = [
        (1, "web", "p", "r", None, None, *null),
        (2, "web", None, None, [("human", "q", "Ann"), ("gpt", "a", None)], None, *null),
        (3, "web", None, None, None, None, 0, "user", "t"),
        (3, None, None, None, None, None, 1, "assistant", None),
        (4, None, None, None, None, "b", *null),
        (4, None, None, None, None, "c", *null),
        (None, None, "only a prompt", None, None, None, *null),
        (5, None, None, None, [("user", None, "Bob")], None, *null),
    ]
    got = chat.conversations(spark.createDataFrame(data, kind)).collect()
    known = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got if r.unknown_layout is None}
    assert known == {1: [("user", "p"), ("assistant", "r")], 2: [("user", "q"), ("assistant", "a")], 3: [("user", "t"), ("assistant", "")]}
    others = sorted(((r.conv_id, r.unknown_layout, r.turns) for r in got if r.unknown_layout), key=repr)
    of = chat.fingerprint_of
    assert others == sorted([(4, of(["body"]), [])] * 2 + [(None, of(["prompt"]), []), (5, of(["messages[].role", "messages[].name"]), [])], key=repr)
    out = chat.formatted(chat.conversations(spark.createDataFrame(data, kind)))
    assert out.where("unknown_layout is not null and formatted = ''").count() == 4 and chat.parsed(out).count() == 3
    # none of the columns is declared, or the texts of a list are nowhere to be read
    assert [r.turns for r in chat.conversations(spark.createDataFrame([(1, "x")], "conv_id long, body string")).collect()] == [[]]
    odd = spark.createDataFrame([(1, [("user", "x")])], "conv_id long, messages array<struct<role:string,said:string>>")
    assert [(r.turns, r.unknown_layout) for r in chat.conversations(odd).collect()] == [([], of(["messages[].role", "messages[].said"]))]
