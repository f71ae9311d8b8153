"""The pipeline by its stages' own plain versions, on small documents."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_by_what_each_keeps(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("abdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    docs, labels = [], []
    for i in range(360):
        t = rng.choices(words, k=rng.randint(40, 90))
        if i % 6 == 0:
            t[3:3] = ["grublik", "snarfen"]
        if i % 10 == 1:
            t[5:5] = ["password=abcdef0123456789abcd"]
        docs.append((i, " ".join(t), "en", f"src{i % 4}", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(1000 + i, docs[7][1], "en", "src0", 0) for i in range(5)] + [(2000, None, None, None, None), (2001, "", "en", "src1", 0), (7, docs[7][1], "en", "src3", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scans", "mixing", "best_fit_packing"]
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        before, at = at.columns, spark.read.parquet(str(tmp_path / name))
        assert k == 4 or at.columns == before
        kept.append(at)
    ids = [Counter(r.doc_id for r in d.select("doc_id").collect()) for d in kept]
    truth = {i for i, _, t in labels if t}
    assert len(truth & set(ids[0])) <= 3 and len((set(range(360)) - truth) - set(ids[0])) <= 9
    assert not {1000, 1001, 1002, 1003, 1004} & set(ids[1]) and ids[1][7] == 1 and set(ids[1].values()) == {1}
    assert ids[2] == ids[1] and kept[2].where(F.col("text").contains("password=")).count() == 0 and kept[2].where(F.col("text").contains("[SECRET]")).count() > 5
    assert max(ids[3].values()) <= 3
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, zlib.crc32(np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in kept[3].collect())
    assert Counter((r.doc_id, r.ids_crc32) for r in kept[4].collect()) == want
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.ids_crc32) for r in whole.collect()) == want
