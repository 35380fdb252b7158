"""Tasks on workers that can't import the package; columns with any names; the pipeline as a whole."""

import os
import subprocess
import sys

from wirelens.llm import mixing, simhash

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from wirelens.llm import decontaminate, merkle, secrets
passage = " ".join("passage%d" % i for i in range(40))
docs = spark.createDataFrame([(1, "x " + passage), (2, "clean text " * 20)], "doc_id bigint, text string")
bench = spark.createDataFrame([(7, passage)], "item_id bigint, text string")
print("LEAKS", [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()])
print("CLEAN", [r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()])
print("SPANS", secrets.scan(docs).count(), merkle.manifest(docs.selectExpr("*", "'s' as source", "'en' as lang", "1 as n_chars")).where("verified").count())
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "LEAKS [(1, 7)]" in done.stdout and "CLEAN [2]" in done.stdout and "SPANS 2 2" in done.stdout, done.stderr[-2000:]


def test_columns_of_any_name(documents):
    docs = documents([(1, "one two three four five"), (2, "one two three four five"), (3, "other words are here now")]).selectExpr(
        "*", "1 as _id", "2 as _key", "3 as _copies", "4 as _ROWS", "5 as _at", "6 as _times", "7 as __time")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert mixing.repeat_documents(docs, mixing.mix(docs)).columns == docs.columns


def run(spark, folder, docs):
    import corpus_pipeline

    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, " ".join(f"passage{i}" for i in range(40)))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_pipeline(spark, tmp_path, documents):
    words = [f"word{i % 97}x{i % 13}" for i in range(4000)]
    rows = [(i, " ".join(words[i * 61 % 3000:i * 61 % 3000 + 90 + i]), "ab"[i % 2]) for i in range(60)]
    rows += [(100 + i, rows[i][1], "a") for i in range(10)]
    rows += [(200, rows[0][1] + " " + " ".join(f"passage{i}" for i in range(40)), "b"), (201, "too short", "a"), (None, None, None), (202, None, "a")]
    found = run(spark, tmp_path, documents(rows))
    assert {r.doc_id for r in found} <= set(range(60)) and len({r.doc_id for r in found}) > 5
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_without_documents(spark, tmp_path, documents):
    assert run(spark, tmp_path, documents([])) == []
