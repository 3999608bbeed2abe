import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from tests.llm.test_neardup import _brute
from tests.llm.test_pii import BASE, _valid
from tests.llm.test_scores import _leaks
from tests.llm.test_tokens import WORD, _plain

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


def _masked(text):
    spans = sorted((m.start(), m.end(), k) for k, p in BASE.items() for m in re.finditer(p, text) if _valid(k, m.group()))
    out, at = "", 0
    for start, end, kind in spans:
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [(d, t) for d, t in docs if re.search(r"[^\W\d_]", t or "")]
    group = _brute(kept, 5)
    kept = [(d, t) for d, t in kept if group[d] == d]
    bad = {d for d, _ in _leaks(kept, items)}
    plain = _plain(WORD)
    wanted = {d: plain(_masked(t)) + [1] for d, t in kept if d not in bad}
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in out} == set(wanted)
    assert sum(r.length for r in out) == sum(map(len, wanted.values()))
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(wanted[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_stages_stand_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kind string, score string"
    odd = [(1, None, None, None, None, "x", "y"), (2, "", "en", "s", 0, None, None), (3, "plain text of one document", "en", "s", 1, None, None), (3, "plain text of one document", "en", "s", 1, None, None), (None, "no id here", None, None, None, None, None)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            following = stage(spark, docs, FOLDER)
            if name != "pack":
                assert following.columns == docs.columns
                docs = spark.createDataFrame(following.collect(), schema)
            else:
                assert following.agg(F.countDistinct("doc_id")).first()[0] <= 3
        assert docs.count() == (2 if rows else 0)


def test_all_are_registered():
    names = entry_module.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
