"""Window rows through Python in bounded pieces."""

import pyarrow as pa
import pytest

from lexiloom.operators import relational
from lexiloom.operators.apply import apply_grammar
from lexiloom.plans import batches
from lexiloom.sources import streams

TEXT = '"<a>"\n\t"a" N\n<STREAMCMD:SETVAR:m=x>\n"<.>"\n\t"." D\n"<b>"\n\t"b" N\n"<.>"\n\t"." D\n'


def test_pieces_are_bounded():
    """However many rows a batch has, few of them are objects at once, and what goes back is cut too."""
    taken = []
    batch = pa.RecordBatch.from_pylist([{"text": "x" * 10_000, "tags": ["a"]}] * 1000)
    rows = batches.rows_of([batch])
    out = list(batches.batches_of((taken.append(1) or r for r in rows), pa.schema([("text", pa.string())])))
    assert len(taken) == 1000 == sum(b.num_rows for b in out) and max(b.nbytes for b in out) < 2 << 20
    assert max(b.num_rows for b in batches.batches_of(({"text": ""} for _ in range(5000)), pa.schema([("text", pa.string())]))) == batches.ROWS


@pytest.mark.parametrize("limit", ["1", "3", "10000"])
def test_documents_across_batches(spark, limit):
    """A document's windows are run together wherever a batch ends, also without an id."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    try:
        ids = [None, *range(7)]
        rows = streams.read_texts(spark.createDataFrame([(k, TEXT if k is None or k % 2 else TEXT.replace("<STREAMCMD:SETVAR:m=x>\n", "")) for k in ids], "doc_id long, text string"), "cg", 'DELIMITERS = "<.>"; SELECT (q);')
        done = apply_grammar(rows.repartition(3), "ADD (hit) (N) IF (0 (VAR:m=x));").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    hits = {(r.doc_id, r.win): sum("hit" in x.tags for c in r.cohorts for x in c.readings) for r in done}
    assert hits == {(k, n): int(k is None or k % 2) for k in ids for n in (1, 2)}


@pytest.mark.parametrize("name", ["kernel_external", "kernel_variables", "kernel_setrelation", "kernel_relation_test", "kernel_delimit"])
def test_coupled_windows_are_a_stream(spark, sf_dir, name):
    """No call of Python per document, and no shuffle beside the one that collects the turns."""
    plan = relational.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["codec_cg", "codec_jsonl", "codec_fst", "codec_plain", "codec_detect", "codec_niceline"])
def test_texts_are_streams(spark, sf_dir, name):
    assert "Pandas" not in relational.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["kernel_external", "kernel_variables", "kernel_setrelation", "kernel_relation_test", "kernel_delimit", "kernel_select", "codec_cg", "stream_commands"])
def test_python_has_all_cores(spark, sf_dir, name):
    """Few bytes are many windows: the runtime must not join the partitions before Python."""
    done = relational.QUERIES[name](spark, sf_dir).rdd
    assert done.getNumPartitions() >= spark.sparkContext.defaultParallelism
