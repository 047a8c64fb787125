"""The pipeline's stages on a small corpus with planted cases."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tapeweave.llm import queries as registered
from tapeweave.llm import tokens

from .test_operators import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def tables(spark, at):
    rng = random.Random(13)
    bad, texts = ["foul", "nasty", "vile"], []
    for i in range(240):
        words = prose(rng, 80, 3000).split(" ")
        if i % 4 == 0:
            words[30:33] = rng.sample(bad, 3)
        texts.append(" ".join(words))
    item = prose(rng, 25, 3000)
    texts[201] = texts[101]  # an exact copy
    texts[202] = texts[102] + " tail"  # a near one
    texts[203] = texts[203] + " " + item  # a benchmark passage
    texts[205] = texts[205] + " write to me@mail.com"
    texts += [None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("b0", item)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return texts


def test_stages_keep_clean_documents_and_catch_planted_ones(spark, tmp_path):
    at = f"{tmp_path}/t"
    texts = tables(spark, at)
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, at).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k < 4:
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
            kept.append({r.doc_id: r.text for r in docs.collect()})
    clean = {i for i in range(242) if i % 4 or i >= 240}
    assert set(kept[0]) == clean
    assert set(kept[1]) == clean - {201, 202}
    assert set(kept[2]) == clean - {201, 202, 203}
    assert kept[3][205].endswith("write to [EMAIL]") and kept[3][206] == texts[206] and set(kept[3]) == set(kept[2])
    # the sequences hold the ids of every document that is left, in full pieces, at most 1024 each
    encoder = tokens.Encoder(tokens.tokenizer_path(), 50).tokenizer
    want = collections.Counter()
    for text in kept[3].values():
        want.update([*encoder.encode(text or "", add_special_tokens=False).ids, 2])
    sequences, got = docs.collect(), collections.Counter()
    for r in sequences:
        ids = np.frombuffer(r.ids, "<u4")
        assert 0 < len(ids) <= 1024 and (ids == 2).sum() <= len(r.doc_ids)
        got.update(ids.tolist())
    assert got == want and {i for r in sequences for i in r.doc_ids} == set(kept[3])
    assert len({r.sequence_id for r in sequences}) == len(sequences)


def test_run_and_registration(spark, tmp_path):
    at = f"{tmp_path}/t"
    tables(spark, at)
    assert corpus_pipeline.run(spark, at).select(F.explode("doc_ids")).distinct().count() > 150
    assert sorted(int(n[2:].split("_")[0]) for n in registered.queries()) == list(range(1, 14))


def test_each_row_is_judged_by_its_own_text(spark, tmp_path):
    rng, at = random.Random(14), f"{tmp_path}/t"
    a, b, c, d, e, f, g, item = (prose(rng, 60, 3000) for _ in range(8))
    spark.createDataFrame([("b0", item)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    make = lambda pairs: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in pairs], SCHEMA)
    held = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    # a contaminated row takes no clean row of its id along, nor of the null ids
    clean = [(None, a), (None, b), (7, c), (8, d), (None, None), (9, "")]
    bad = [(None, e + " " + item), (7, f + " " + item)]
    got = held(corpus_pipeline.decontaminate(spark, make(clean + bad), at))
    assert got == sorted(clean, key=repr)

    # copies go by their text: null ids, repeated ids, rows that repeat as a whole; no words: all stay
    rows = [(None, a), (1, a), (None, b), (None, b), (2, c), (2, d), (3, d + " tail"), (4, e), (4, e), (0, f), (5, g), (5, f), (None, ""), (None, ""), (6, None), (6, "")]
    got = held(corpus_pipeline.drop_near_duplicates(spark, make(rows), at))
    assert got == sorted([(1, a), (None, b), (2, c), (2, d), (4, e), (0, f), (5, g), (None, ""), (None, ""), (6, None), (6, "")], key=repr)


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls in any column, long and repeated rows, and columns with the names of ours."""
    rng, at = random.Random(15), f"{tmp_path}/t"
    tables(spark, at)
    clashing = f"{SCHEMA}, _id string, _hash long, spans string, _c int, _t string, component long, `_each` int, c1 string, n_hit int, score double"
    rest = ("i", 3, "s", 4, "t", 5, 6, "c", 7, 0.5)
    texts = [None, "", " ", prose(rng, 90, 3000), prose(rng, 90, 3000), "word " * 30_000, "mail me@mail.com " + prose(rng, 60, 3000), "é" * 10]
    rows = [(i, t, "en", "s", 1, *rest) for i, t in enumerate(texts)] + [(None, texts[3], None, None, None, *[None] * 10)] * 2 + [(4, texts[4], "en", "s", 1, *rest)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, clashing)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, docs, at)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out.write.parquet(f"{tmp_path}/{len(given)}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{len(given)}-{k}")
        kept = docs.collect()
        if given:  # no row is toxic or contaminated; copies of rows 3 and 4 go
            assert sorted(r.doc_id for r in kept) == list(range(8)) and all(tuple(r)[5:] == rest for r in kept)
            assert [r.text for r in kept if r.doc_id == 6][0].startswith("mail [EMAIL] ")
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, at)
        assert {i for r in packed.collect() for i in r.doc_ids} == {r.doc_id for r in kept}


def test_near_duplicates_move_documents_once(spark):
    rows = [(7, "one two three four five six", "en", "s", 1)] * 3 + [(None, "one two three four five six", "en", "s", 1), (8, "", "en", "s", 0), (8, "", "en", "s", 0), (None, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "_each" in x]
        assert sorted((r.doc_id or 0, r.text or "") for r in found.collect()) == [(0, ""), (7, rows[0][1]), (8, ""), (8, "")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
