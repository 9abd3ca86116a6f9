"""The pipeline's stages against their operators' definitions."""

import corpus_pipeline
import pytest
from helpers import clashing, documents, store
from stayrate.llm.queries import QUERIES
from test_secrets import brute
from test_simhash import brute_components, brute_print


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows after every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs.collect())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        result = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == docs.columns
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_quality_drops_what_the_operator_rejects(spark, sf_dir, stages):
    kept = {r["doc_id"] for r in QUERIES["op1_quality_gam"](spark, sf_dir).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in stages[1]} == kept and len(kept) < len(stages[0])


def test_one_document_of_each_group_stays(stages):
    prints = {r["doc_id"]: brute_print(r["text"]) for r in stages[1]}
    roots, first = brute_components(prints.values(), 2), {}
    for i in sorted(prints):
        first.setdefault(roots[prints[i]], i)
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(first.values())


def test_secrets_are_masked_and_nothing_else(stages):
    before = {r["doc_id"]: r for r in stages[2]}
    assert sorted(before) == sorted(r["doc_id"] for r in stages[3])
    for r in stages[3]:
        if brute(before[r["doc_id"]]["text"]):
            assert not brute(r["text"]) and r["n_chars"] == len(r["text"])
        else:
            assert r == before[r["doc_id"]]


def test_mix_repeats_whole_rows(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    assert all(r == before[r["doc_id"]] for r in stages[4])
    copies = [sum(r["doc_id"] == i for r in stages[4]) for i in before]
    assert max(copies) <= 3 and sum(copies) == len(stages[4])


def test_tokens_of_every_document(stages):
    assert sorted(r["doc_id"] for r in stages[5]) == sorted(r["doc_id"] for r in stages[4])
    assert all(r["exact"] for r in stages[5])


def test_run_is_the_stages_in_order(spark, sf_dir, stages):
    key = lambda r: (r["doc_id"], tuple(r["ids"]))
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, stages[5]))


def test_odd_and_empty_tables(spark, tmp_path):
    rows = [(1, "A plain sentence with words in it."), (1, "A plain sentence with words in it."), (2, None), (3, ""), (None, "No id here."),
            (4, "token = " + "0123456789abcdef" * 2), (5, "x " * 50_000, None, None)]
    labels = spark.createDataFrame([(1, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = clashing(documents(spark, rows), "_key", "_text", "spans", "fp", "component_id", "_copies", "score")
    folder = store(spark, tmp_path / "odd", documents=docs, labels=labels)
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in found} <= {1, 2, 3, 4, 5, None} and found
    empty = store(spark, tmp_path / "none", documents=docs.limit(0), labels=labels)
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("rows, kept", [
    ([(1, "A"), (None, "A"), (None, "B")], [(1, "A"), (None, "B")]), ([(0, "A"), (1, "A"), (1, "B")], [(0, "A"), (1, "B")]),
    ([(None, "A"), (None, "A"), (None, "a")], [(None, "A")]), ([(2, "A"), (2, "a"), (2, "A")], [(2, "A")]),
    ([(None, "B"), (None, "C"), (5, "B")], [(5, "B"), (None, "C")])])
def test_one_row_of_each_group_stays_whatever_the_ids(spark, rows, kept):
    """A and a have one fingerprint; the row that stays has the smallest id, then the smallest hash of its text."""
    words = {"A": "one two three four five six seven", "B": "other things are said in this one here",
             "C": "and a third text that is like none of them", "a": "ONE two three four five six seven"}
    docs = documents(spark, [(i, words[t]) for i, t in rows])
    found = corpus_pipeline.near_copies(spark, docs, "").collect()
    same = {words["a"]: words["A"]}
    assert sorted(((r["doc_id"], same.get(r["text"], r["text"])) for r in found), key=str) == sorted(
        ((i, words[t]) for i, t in kept), key=str)
