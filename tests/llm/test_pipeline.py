import inspect
import os
import threading

import pyarrow as pa

import corpus_pipeline
from rankweave.llm import queries, storage
from rankweave.llm.storage import new_path, scope


def test_stages_keep_the_columns_and_take_effect(spark, sf):
    docs = first = spark.read.parquet(f"{sf}/documents.parquet").cache()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == first.columns and out.dtypes == first.dtypes, name
        assert {r.doc_id for r in out.select("doc_id").collect()} <= ids
        docs = out
    assert 0 < docs.count() and set(docs.columns) == {"doc_id", "source", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_run_agrees_with_its_stages(spark, sf, make):
    rows = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
    assert rows == sorted((r.doc_id, r.ids_sha256) for r in docs.collect())


def _written(spark, tmp_path, docs, labels):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_on_odd_rows(spark, make, tmp_path):
    """Nulls in any column, empty, repeated and long texts, clashing columns: each stage's rows."""
    words = [" ".join(f"{w}{k}" for k in range(60)) for w in "abcde"]
    texts = [None, "", " ", words[0], words[0], words[1], words[1] + " more", words[2], words[2], "x " * 50_000, words[3] + " " + words[0], words[4], words[4]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, None, None]
    docs = make(texts, ids, source=["s", None, "t", "s", "s", "t", "t", None, None, "s", "u", "u", None])
    labels = spark.createDataFrame([(3, 1, 0), (5, 1, 0), (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    sf_dir = _written(spark, tmp_path, docs, labels)
    stages = dict(corpus_pipeline.STAGES)
    held = stages["toxicity"](spark, docs, sf_dir).cache()
    assert held.columns == docs.columns and held.count() == len(texts)  # nothing toxic is known
    held = stages["near-dedup"](spark, held, sf_dir).cache()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in held.collect()) == [-1, -1, 0, 1, 2, 3, 5, 7, 8, 9]
    held = stages["substring-dedup"](spark, held, sf_dir).cache()
    left = {r.doc_id: r.text for r in held.collect() if r.doc_id is not None}
    assert left[0] is None and left[1] == "" and left[9] == words[3] and left[3] == words[0]
    mixed = stages["mixing"](spark, held, sf_dir).cache()
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} <= {r.text for r in held.collect()}
    last = stages["encoding"](spark, mixed, sf_dir)
    assert last.count() == mixed.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == mixed.count()


def test_no_documents(spark, make, tmp_path):
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, _written(spark, tmp_path, make([]), labels)).isEmpty()


def test_run_leaves_no_tables_and_only_its_last_stage(spark, sf):
    folder = spark.conf.get("spark.checkpoint.dir")
    before, tables = set(os.listdir(folder)) if os.path.isdir(folder) else set(), spark.catalog.listTables()
    corpus_pipeline.run(spark, sf)
    new = {name.split("-")[0] for name in set(os.listdir(folder)) - before}
    assert new == {"stage"} and spark.catalog.listTables() == tables


def test_scopes_are_their_own(spark):
    with scope() as outer:
        new_path(spark, "a")
        with scope() as inner:
            new_path(spark, "b")
        thread = threading.Thread(target=new_path, args=(spark, "c"))
        thread.start(), thread.join()
    assert [len(outer), len(inner)] == [1, 1]


def test_registered_queries_take_whole_tables():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    for f in queries.QUERIES.values():
        assert not {"limit", "sample", "filter"} & set(inspect.getsource(f).replace("(", ".").split("."))


def test_stages_bound_what_goes_to_a_worker(spark, make, sf):
    """Batches of bounded bytes; a bound that the session has stays."""
    seen = lambda docs: max(r.n for r in docs.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect())
    long = make(["word " * 4000] * 1000)
    spark.conf.unset(storage.BATCH_CONF)
    try:
        for _, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[-1:]:
            spark.conf.unset(storage.BATCH_CONF)
            assert seen(long) > 15 << 20
            stage(spark, long, sf)
            assert seen(long) < 5 << 20
        spark.conf.set(storage.BATCH_CONF, "1m")
        corpus_pipeline.encode(spark, long, sf)
        assert spark.conf.get(storage.BATCH_CONF) == "1m"
    finally:
        spark.conf.unset(storage.BATCH_CONF)
    out = corpus_pipeline.reject_toxic(spark, long, sf)
    assert out.columns == long.columns and out.dtypes == long.dtypes
