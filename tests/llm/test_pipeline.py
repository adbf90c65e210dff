"""The pipeline's stages in order, each against a brute-force version of its decisions."""

import os
import zlib

import pytest

import corpus_pipeline
from ledgerlake.llm.common import written
from ledgerlake.llm.queries import tokenizer_path
from tests.llm import models

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_take_effect(spark):
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontaminate", "mix", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    label = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], SF), name))
        if name != "tokens":
            assert steps[-1].columns == docs.columns
    start, calm, single, clean, mixed = map(_rows, steps[:5])
    left = dict(calm)
    toxic = [i for i, _ in start if i in label and label[i].toxic == 1]
    fine = [i for i, _ in start if i in label and label[i].toxic == 0]
    assert sum(i not in left for i in toxic) > 0.5 * len(toxic) and sum(i in left for i in fine) > 0.98 * len(fine)
    groups = models.near_groups(calm, percent=80, size=5)
    assert sorted(i for i, _ in single) == sorted(i for i, (_, c) in groups.items() if i == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = models.contaminated(single, items)
    assert sorted(i for i, _ in clean) == sorted(i for i, _ in single if not hit[i][1])
    times = {i: 0 for i, _ in clean}
    for i, _ in mixed:
        times[i] += 1
    assert max(times.values()) <= 2 and 1.2 < len(mixed) / len(clean) < 1.8
    tok = Tokenizer.from_file(tokenizer_path())
    text = dict(mixed)
    out = sorted(steps[5].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted(i for i, _ in mixed)
    at = 0
    for r in out:
        ids = tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += len(ids)


def test_stages_on_awkward_and_empty_tables(spark, awkward):
    for docs in (awkward, awkward.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), name)
        assert set(docs.columns) >= {"doc_id", "start", "n_tokens", "ids_crc32"}
