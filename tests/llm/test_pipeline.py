import zlib
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers as P
import pyarrow as pa
from cases import ascii_lower, empty, frame, rows
from test_joins import brute_components, shared_ids
from tokenizers import Tokenizer

from sparkjson.llm.queries import oracle_sql, queries


def stored(df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_pipeline_against_plain_python(spark, tmp_path):
    got = pipeline.run(spark, stored(frame(spark).where("doc_id <> 500"), tmp_path)).collect()
    docs = [(r[0], r[1]) for r in rows() if r[0] != 500 and any(c.isalpha() for c in r[1] or "")]
    last = defaultdict(lambda: -1)
    for i, t in docs:
        last[ascii_lower(t)] = max(last[ascii_lower(t)], i)
    docs = [(i, t) for i, t in docs if last[ascii_lower(t)] == i]
    least = {i: c for i, _, c in brute_components(docs, pipeline.NGRAM, *pipeline.SIMILAR)}
    docs = [(i, t) for i, t in docs if least[i] == i]
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for i, text in docs:  # the cases hold no personal data
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(r.offset + r.length <= 4096 for r in got)


def test_stages_keep_the_columns_and_run_on_nothing(spark, tmp_path):
    docs = empty(spark)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert pipeline.run(spark, stored(docs, tmp_path)).count() == 0


def test_rows_without_an_id_pass_the_stages(spark):
    docs = frame(spark, with_null_id=True).where("doc_id IS NULL OR doc_id IN (7, 300)")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").persist()
        assert sorted((r.doc_id for r in docs.collect()), key=str) == [300, 7, None]


def test_near_tells_texts_of_one_id_apart(spark):
    docs = spark.createDataFrame(shared_ids()[:5], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:3]) for r in pipeline.near(spark, docs, "").collect()) == [(1, "w1x"), (5, "w2x")]


def test_the_language_stage_gets_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        pipeline.language(spark, frame(spark), "")
        sizes = spark.range(0, 3000, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"id": [x.num_rows]}) for x in batches), "id long")
        assert max(r.id for r in sizes.collect()) == pipeline.BATCH_ROWS
        spark.conf.set(name, 100)
        pipeline.language(spark, frame(spark), "")
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)


def test_registry():
    names = list(queries())
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] == names[:-1] and names[-1] == "pipeline" and len(names) == 11
    assert set(oracle_sql()) == {"op2_chat_format", "op7_exact_dedup", "op9_substring_dedup", "op10_quality_rules"}
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
