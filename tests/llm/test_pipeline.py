import ctypes
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_dedup import components, squeezed


@pytest.fixture(scope="module")
def folder(spark, docs, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_by_brute_force(spark, docs, folder):
    exact = corpus_pipeline.exact_stage(spark, docs, folder)
    rows = [tuple(r) for r in exact.collect()]
    assert exact.columns == docs.columns
    assert sorted(squeezed(r[1]) for r in rows) == sorted({squeezed(r.text) for r in docs.collect()})
    near = {r.doc_id for r in corpus_pipeline.near_stage(spark, exact, folder).collect()}
    assert near == {c for _, _, c in components(rows, 5, 80)}


def test_run(spark, folder):
    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and {"doc_id", "piece", "sequence_id", "offset"} <= set(out[0].asDict())


def test_empty_documents_pass_all_stages(spark, empty, labels, folder):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


WORKER = """
import ctypes, random, re, sys
import numpy as np, pyarrow as pa
from weirflow.llm import exact_dedup, ngram_join

class Frequent:
    value = np.zeros((0, 2), np.int64)

run = {"sets": ngram_join._sets(5), "prefixes": ngram_join._prefixes(5, 80, 50, Frequent), "marks": exact_dedup._prints(exact_dedup.PRIMES)}[sys.argv[1]]

def megabytes():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def batch(docs, seed):
    rng = random.Random(seed)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(300)) for _ in range(docs)]
    ids = list(range(docs))
    return pa.record_batch({"doc_id": ids, "text": texts, "row": ids})

def task(rows):
    for out in run(iter([rows])):
        del out

small, large = batch(10, 1), batch(8000, 2)
task(small)
ctypes.CDLL(None).malloc_trim(0)  # what making the rows left
before = megabytes()
task(large)
print(megabytes() - before)
"""


@pytest.mark.parametrize("function", ["sets", "prefixes", "marks"])
def test_a_worker_keeps_no_memory_of_a_task(function):
    """An executor's memory holds its Python workers as well, which Spark keeps for later tasks."""
    if not Path("/proc/self/status").exists() or not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("needs glibc")
    done = subprocess.run([sys.executable, "-c", WORKER, function], cwd=Path(corpus_pipeline.__file__).parent, capture_output=True, text=True, check=True)
    assert float(done.stdout) < 5
