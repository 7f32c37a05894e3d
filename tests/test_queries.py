import pytest

from pageloom.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


def test_undo_stream_matches_batch(spark, sf_dir):
    batch, stream = (sorted(map(tuple, QUERIES[k](spark, sf_dir).collect())) for k in ("undo_redo_state", "undo_redo_stream"))
    assert batch and batch == stream


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "page_no", "out_page", "role", "text_md5", "error"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_training_data_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['pageloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[1])
    assert int(out.stdout) == len(QUERIES)
