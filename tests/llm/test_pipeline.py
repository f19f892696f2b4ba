"""The pipeline's stages, each against its operator's rule on its own input, and the registered queries against SQL."""

import os
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from bytewright.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append((name, docs.collect()))
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic, near, private, mixed, packed = (rows for _, rows in seen)
    assert {r.doc_id for r in near} <= {r.doc_id for r in toxic} <= before.keys()
    assert all(r == before[r.doc_id] for r in near)
    assert len({r.doc_id for r in near}) == len(near) == len(private)
    assert all(r.n_chars == len(r.text) for r in private if r.text != before[r.doc_id].text)
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 2 and copies.keys() <= {r.doc_id for r in private}
    assert Counter(r.doc_id for r in packed if r.start == 0) == copies
    assert {r.doc_id for r in packed} == copies.keys()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    at = [names.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)


def test_all_are_registered():
    names = __spark_entry__.queries().keys()
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names


KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeats, ties, clashing columns."""
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near), (None, near + " x"), (None, near), (2, near), (2, "other text of its own here"), (3, None), (4, ""), (4, ""), (None, None), (5, "Mrs. Olga Braun wrote to a@b.org")]
    docs = spark.createDataFrame([(d, t, None, "s" if d else None, 7, "c") for d, t in rows], KINDS + ", TEXT string")
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == list(corpus_pipeline.COLUMNS) and texts(kept) == sorted(rows, key=repr)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert texts(kept) == sorted((r for r in rows if r[1] is None or not r[1].startswith("w0") or r[0] == 1), key=repr)
    private = corpus_pipeline.replace_personal_data(spark, docs, SF)
    got = {r.doc_id: r for r in private.collect() if r.doc_id == 5}
    assert private.count() == len(rows) and "Braun" not in got[5].text and got[5].n_chars == len(got[5].text)
    mixed = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    assert max(mixed.values()) <= 8 and mixed.keys() <= {d for d, _ in rows}
    packed = corpus_pipeline.pack(spark, docs, SF).collect()
    assert sum(r.start == 0 for r in packed) == len(rows)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], KINDS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_near_duplicates_beyond_the_first_slice_of_a_batch(spark):
    rows = [(i, " ".join(f"w{i * 40 + k}" for k in range(40)), "en", "a", 200) for i in range(1300)]
    rows += [(5000 + i, f"{t} more", *rest) for i, t, *rest in rows]
    docs = spark.createDataFrame(rows, KINDS).coalesce(1)
    assert sorted(tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == rows[:1300]


def test_a_worker_holds_one_cache():
    """Scores of words are dropped before token ids are kept, and both before near duplicates."""
    from bytewright.plans import workers

    workers.kept(("a", 1), dict)["x"] = 1
    assert workers.kept(("a", 1), dict) == {"x": 1}
    assert workers.kept(("b", 1), list) == [] and list(workers._kept) == [("b", 1)]
    assert list(workers.alone(lambda batches: iter([len(workers._kept), *batches]))(iter([5]))) == [0, 5] and not workers._kept


def test_batches_of_texts_are_small(spark):
    docs = spark.createDataFrame([(i, "some text", "en", "a", 9) for i in range(5000)], KINDS).coalesce(1)
    before = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    try:
        for rows, want in ((10_000, 2_000), (0, 2_000), (300, 300)):
            spark.conf.set(corpus_pipeline.BATCH_SETTING, rows)
            corpus_pipeline.pack(spark, docs, SF)
            sizes = docs.select("doc_id").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
            assert max(r.n for r in sizes) == want
    finally:
        spark.conf.set(corpus_pipeline.BATCH_SETTING, before)
