import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from lamina.plans import catalog

ROOT, DATA = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


def test_entry_imports_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ocr_eval' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    frame = catalog.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    ours = sorted((tuple(tidy(r[c]) for c in columns) for r in frame.collect()), key=str)
    relation = con.sql(catalog.ORACLES[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    theirs = sorted((tuple(tidy(r[i]) for i in places) for r in relation.fetchall()), key=str)
    assert ours == theirs


def test_entry_imports_without_a_library_of_the_corpus_operators():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'ocr_eval' in q and 'op3_prefix_hash' not in q; assert 'ocr_eval' in e.oracle_sql()"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)})


def test_pseudo_labels_of_letters_without_a_single_capital_equal_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["ßa", "ŉb", "ǰc", "ﬁd", "éf", "ıg", "ſh", "zi", "", None, "ΐj", "ὖk", "ᾀl", "ῳm"]
    spark.createDataFrame([(i, t, 200) for i, t in enumerate(texts, 1)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(1, len(texts) + 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    ours = sorted(map(tuple, catalog.QUERIES["pseudo_labels"](spark, str(tmp_path)).select("doc_id", "class", "reason").collect()))
    theirs = sorted(con.sql(f"select doc_id, class, reason from ({catalog.ORACLES['pseudo_labels']})").fetchall())
    assert ours == theirs and ("ẞ" in {r[1] for r in ours})
