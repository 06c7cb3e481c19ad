import importlib
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from tapeweave.llm import decontam, exact_dedup, jaccard
from tapeweave.session import written

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, sf):
    """Each stage is right on its own input: a subset of it, with its columns and its decisions in effect."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "ngram_jaccard", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, sf), f"test-{name}")
        assert after.columns == columns
        assert after.exceptAll(before).count() == 0
        if name == "exact_dedup":
            assert exact_dedup.deduplicated(after).filter("group_size > 1").count() == 0
            assert after.count() == exact_dedup.deduplicated(before).filter("kept").count()
        if name == "ngram_jaccard":
            rule = (jaccard.STAGE_SHINGLE, jaccard.STAGE_PERCENT)
            assert rule == (5, 80)
            groups = jaccard.grouped(before, *rule).selectExpr("coalesce(CAST(group AS STRING), row_key)")
            assert after.count() == groups.distinct().count()
            assert jaccard.grouped(after, *rule).filter("doc_id != component_id").count() == 0
        if name == "decontamination":
            bad = decontam.contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).select("doc_id").distinct()
            assert after.join(bad, "doc_id").count() == 0 and after.count() == before.count() - bad.count() > 0
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert packed.select("doc_id").distinct().count() == before.count()


def test_the_rest_stands_alone():
    """Without this folder the entry module still imports and registers the other queries."""
    code = (
        "import sys; sys.modules['tapeweave.llm'] = None\n"
        "import importlib.abc, importlib.machinery\n"
        "del sys.modules['tapeweave.llm']\n"
        "class Absent(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('tapeweave.llm', 'corpus_pipeline'):\n"
        "            raise ModuleNotFoundError('absent', name=name)\n"
        "sys.meta_path.insert(0, Absent())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_registered_queries():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
