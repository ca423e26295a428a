"""The corpus pipeline against a brute-force version on a small table."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import brute_components, near_texts  # noqa: E402
from tidewright.llm import quality  # noqa: E402


def test_stages_and_run(spark, tmp_path):
    leak = "every good test item is a sentence that is long enough to be told from ordinary prose by its pieces"
    texts = near_texts(60, 9) + [f"before {leak} after w1 w2 w3", "write to someone@example.com or 10.0.0.1 please w5 w6", None, ""]
    junk = [" | ".join(f"t{i}{j}" for j in range(30)) for i in range(20)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < len(texts)), 0) for i in range(len(rows)) if i not in (62, 63)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    table, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(tmp_path))
        seen[name] = {r.doc_id: r for r in table.collect()} if name != "packing" else table.collect()
        if name != "packing":
            assert table.columns == docs.columns
    good = {r.doc_id for r in quality.score_documents(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r.predicted}
    assert set(seen["quality"]) == good and not good & set(range(len(texts), len(rows)))
    kept = sorted(good)
    component, _ = brute_components(kept, [rows[i][1] for i in kept], 5)
    assert set(seen["near_dedup"]) == {i for i in kept if component[i] == i}
    assert set(seen["decontaminate"]) == {i for i in seen["near_dedup"] if leak not in (rows[i][1] or "")} and 60 not in seen["decontaminate"]
    assert seen["pii"][61].text == "write to [EMAIL] or [IP] please w5 w6" and seen["pii"][61].n_chars == len(seen["pii"][61].text)
    assert {i for i, r in seen["pii"].items() if r.text != rows[i][1]} == {61}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    shape = lambda x: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in x)
    assert sum(r.length for r in whole) == sum(r.length for r in seen["packing"]) and {r.doc_id for r in whole} == set(seen["pii"])
    assert shape(whole) and len({r.sequence_id for r in whole}) == len({(r.sequence_id, r.doc_id) for r in whole if r.offset == 0})


def test_registered_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11)) and "pipeline" in names


def test_held_out_is_crc_of_the_id(spark):
    from tidewright.llm.common import held_out

    got = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
    assert not spark.range(1).select(F.lit(None).cast("long").alias("id")).select(held_out("id")).first()[0]
