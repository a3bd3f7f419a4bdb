"""The pipeline, stage by stage, against plain forms on a small table."""

import time
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import common, jaccard, langid, secret_scan

from . import brute

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    model = langid.fit(docs)
    rows = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    gone = model.predict([r["text"] for r in rows])[2]
    rows = [r for r, x in zip(rows, gone) if not x]
    groups = brute.jaccard([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r, g in zip(rows, groups) if g[0] == g[2]]
    passages = [(i, t) for i, t in bench if len(brute.MARKED.findall(t.lower())) >= 8]
    dirty = {r[0] for r in brute.decontaminate([(r["doc_id"], r["text"]) for r in rows], passages) if r[3]}
    assert dirty
    rows = [r for r in rows if r["doc_id"] not in dirty]
    pair = secret_scan.fit(spark.createDataFrame([(r["text"],) for r in rows], "text string"))
    want = {r["doc_id"]: secret_scan.masked(r["text"], secret_scan.spans_of(r["text"], pair)[1], "[SECRET]") for r in rows}

    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
    kept = docs.collect()
    assert {r["doc_id"]: r["text"] for r in kept} == want and all(r["n_chars"] == len(r["text"]) for r in kept)
    out = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert out == {i: brute.sha(t) for i, t in want.items()}


def test_stages_take_empty_and_odd_tables(spark):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, token string"
    odd = spark.createDataFrame([(1, None, None, None, None, "t"), (2, "", "en", "s", 0, "t"), (3, "the words of a text", "en", None, 19, "t"), (3, "the words of a text", "en", None, 19, "t"), (None, "une phrase en plus", "fr", "s", 18, None)], kind)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            docs.collect()


def test_intermediate_tables_go_and_others_stay(spark):
    top = Path(common.shared_dir(spark).removeprefix("file:"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    linked = jaccard.link(docs)
    before = {p.name for p in top.iterdir()}
    with common.workspace(spark) as path:
        inner, outer = common.stored(docs.select("doc_id")), common.stored(docs.select("doc_id"), outside=True)
        assert inner.count() == outer.count() == 40 and Path(path.removeprefix("file:")).is_dir()
    assert not Path(path.removeprefix("file:")).exists() and outer.count() == 40 and linked.count() == 40
    assert len({p.name for p in top.iterdir()} - before) == 1


def test_broadcasts_go_with_their_workspace(spark):
    def blocks():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().master().getStorageStatus()
        return {str(x) for status in found for x in str(status.blocks().keySet().mkString(" ")).split() if x.startswith("broadcast_")}

    before = blocks()
    with common.workspace(spark):
        for i in range(3):
            common.stored(spark.range(100).join(F.broadcast(spark.range(50).withColumn("x", F.lit(i))), "id"))
        assert len(blocks() - before) >= 3
    for _ in range(50):  # the last query's own block may stay
        if len(blocks() - before) < 3:
            break
        time.sleep(0.1)
    assert len(blocks() - before) < 3


def test_a_cluster_names_its_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://head:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
