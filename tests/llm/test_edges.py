"""Null ids, repeated rows, empty tables and clashing columns; the pipeline's stages against brute force."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from outsieve.llm import chaining, decontam, langid, license, linededup, ngramjoin, queries, spfst, surrogate, tokencount, vecdedup

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "__d __gone __key __map __new __found __id __h h d rep bits set_id text_hash n_shingles component_id lang_pred score held_out n_tokens n_lines n_removed n_entities item_id edits label".split()
LATIN = "the house stands near a quiet river where people walk every morning with their dogs".split()


def operators(docs, bench):
    return {
        "op1": langid.identify(docs),
        "op2": linededup.dedup(docs, counts=True),
        "op3": decontam.matches(docs, bench),
        "op3clean": decontam.clean(docs, bench),
        "op5": surrogate.pseudonymise(docs, "k", counts=True),
        "op6": tokencount.count(docs),
        "op7": chaining.passages(docs),
        "op8": spfst.encode_column(docs),
        "op9": license.scan(docs),
        "op10": ngramjoin.link(docs),
    }


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "a benchmark passage that nobody else would ever write in quite this way, at all")], "item_id long, text string")


def test_empty_tables(spark, bench):
    none = spark.createDataFrame([], DOC)
    assert {k: v.count() for k, v in operators(none, bench.where("item_id < 0")).items()} == dict.fromkeys(operators(none, bench), 0)
    assert vecdedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_clashing_columns_and_null_ids_keep_every_row(spark, bench):
    rows = [(None, "mail me: a.b@site9.example.com now", None, None, None), (None, None, None, None, None), (1, "mail me: a.b@site9.example.com now", "en", "s1", 3), (1, "mail me: a.b@site9.example.com now", "en", "s1", 3), (2, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, DOC)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("taken"))
    for name, out in operators(docs, bench).items():
        got = out.collect()
        assert len(set(out.columns)) == len(out.columns), name
        if name not in ("op3", "op7"):
            assert len(got) == len(rows), name
    texts = {r.text for r in surrogate.pseudonymise(docs, "k").collect() if r.text}
    assert len(texts) == 1 and "a.b@" not in texts.pop()


def test_contaminated_row_without_id_goes_alone(spark, bench):
    passage = bench.first().text
    docs = spark.createDataFrame([(None, "x " + passage), (None, "clean words"), (5, passage), (5, "clean too")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in decontam.clean(docs, bench).collect()) == [(0, "clean words"), (5, "clean too")]


def jaccard_groups(rows):
    """Row numbers that stay: of each group of linked texts the first by id."""
    sets = []
    for r in rows:
        w = (r["text"] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a & b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    first = {}
    for i, c in enumerate(comp):
        if c not in first or rows[i]["doc_id"] < rows[first[c]]["doc_id"]:
            first[c] = i
    return {rows[i]["doc_id"] for i in first.values()}


def test_pipeline_equals_brute_force(spark, tmp_path, bench):
    rnd = random.Random(9)
    text = lambda n: " ".join(rnd.choice(LATIN) + str(rnd.randint(0, 60)) for _ in range(n))
    base = [text(60) for _ in range(5)]
    rows = [(i, base[i % 5] + (" extra" if i % 3 else "") + f"\nsubscribe to our paper\nsite line {i}", "en", f"s{i % 9}", 9) for i in range(20)]
    rows += [(50, text(30) + " " + bench.first().text, "en", "s1", 9), (51, "12 34 !", "en", "s1", 9), (52, None, "en", "s1", 9), (53, text(40), "en", None, 9), (53, "again", "en", None, 9)]
    rows += [rows[3]]
    docs = spark.createDataFrame(rows, DOC)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    # language ID: with one language learned, all but letterless and null texts stay
    left = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows if r[0] not in (51, 52)]
    # line dedup: the common line stays in document 0 alone
    sites = {r["source"] for r in left if r["text"] and "subscribe" in r["text"]}
    assert len(sites) >= linededup.MIN_SITES
    for r in left:
        if r["doc_id"] != 0:
            r["text"] = r["text"].replace("subscribe to our paper\n", "")
    # near duplicates, then the contaminated document
    kept = jaccard_groups(left) - {50}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == kept
    assert len(got) == len(kept) + 1  # document 53 has two rows with different texts
    assert all(r.round_trip for r in got)
    assert set(queries.QUERIES) >= {"pipeline", "op1_language_id", "op10_ngram_jaccard"}


def test_op2_tells_rows_of_one_id_apart(spark):
    rows = [(i, "stock line\nown text", f"s{i}") for i in range(9)] + [(5, "keep me A\nkeep me B", "s5"), (None, "stock line\nnameless", "s1")]
    got = {(r.doc_id, r.text) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # both lines of the first row are on nine sites; the nameless row stands before all
    assert got == {(None, "stock line\nnameless"), (0, "own text"), (5, "keep me A\nkeep me B"), *((i, "") for i in range(1, 9))}


def test_op3_item_without_id_and_ids_of_text(spark):
    passage = "some other benchmark question that is long enough to hold a segment of its own, with words"
    docs = spark.createDataFrame([(1, f"{passage} and more {passage.upper()} of it")], "doc_id long, text string")
    for kind, known in (("long", 3), ("string", "q3")):
        bench = spark.createDataFrame([(None, passage), (known, passage + " again"), (known, None)], f"item_id {kind}, text string")
        assert {r.item_id for r in decontam.matches(docs, bench).collect()} >= {None}
        assert decontam.clean(docs, bench).count() == 0


def test_op4_rows_without_id(spark):
    one, two = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    rows = [(None, one), (2**60 + 1, one), (2**60 + 3, [1.0, 0.01, 0.2]), (None, two), (4, None)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vecdedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    least = 2**60 + 1
    assert got == [(0, 0, 0, True), (0, 2, least, False), (4, 0, 4, True), (least, 2, least, True), (least + 2, 2, least, False)]


def test_op6_null_edits(spark):
    rows = [(1, "one two three", [(None, 3, "x"), (0, 3, None), (4, 4, "and ")]), (2, "kept", None), (3, None, [(0, 1, "y")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, changes array<struct<start:int,end:int,text:string>>")
    got = {r.doc_id: r for r in tokencount.count(docs, edits="changes", texts=True).collect()}
    assert got[1].edited == " twoand  three" and got[2].edited == "kept" and got[3].n_tokens is None


def test_op7_repeated_null_and_textual_ids(spark):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice(LATIN) + str(rnd.randint(0, 60)) for _ in range(n))
    shared = text(70)
    rows = [(1, shared + " " + text(30)), (2, text(20) + " " + shared), (2, text(300)), (None, text(10) + " " + shared)]
    got = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.src_doc_id, r.matched) for r in got} in ({(1, 2, 70), (1, None, 70), (None, 2, 70)}, {(1, 2, 70), (1, None, 70), (2, None, 70)}, {(1, 2, 70), (None, 2, 70)}, {(1, None, 70), (2, None, 70)})
    named = chaining.passages(spark.createDataFrame([("a", shared), ("b", "x " + shared)], "doc_id string, text string")).collect()
    assert [{r.doc_id, r.src_doc_id} for r in named] == [{"a", "b"}]


def test_workers_give_freed_memory_back():
    """What an operator cached in a worker is back with the system when another one's task starts."""
    script = """
import numpy as np
from outsieve.llm import common
resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
held = {i: (i, str(i) * 20) for i in range(1_500_000)}
common.sole_cache("one", held.clear)
last = [object()]
full = resident()
common.sole_cache("two")
assert full - resident() > 150_000_000, (full, resident())
"""
    subprocess.run([sys.executable, "-c", script], check=True, cwd=Path(__file__).parents[2])


def test_op8_keeps_more_cuts_on_its_own_than_in_the_pipeline(monkeypatch):
    made = []
    monkeypatch.setattr(spfst, "encode_column", lambda docs, **given: made.append(given))
    monkeypatch.setattr(queries, "read_table", lambda *given: None)
    queries.op8_sentencepiece(None, "")
    assert made[0]["most_cached"] > spfst.MOST_CACHED
