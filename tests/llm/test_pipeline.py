import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
import test_decontaminate
import test_line_chunks
import test_repetition
import test_simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def small(spark, tmp_dir):
    rows = [(i, t) for i, t in enumerate(test_repetition.texts()[:-1])]
    docs, items = test_decontaminate.cases()
    rows += [(1000 + i, t) for i, t in docs if i is not None]
    rows += [(2000 + i, t) for i, t in test_line_chunks.corpus()[0] if i is not None]
    long = " ".join(f"clean{k}" for k in range(80))
    rows += [(3000, long), (3001, long + " more"), (3002, long), (3003, "\n".join(f"{long} {k}" for k in range(5))), (None, long)]
    lines = "\n".join(f"paragraph {k} of a passage that repeats across documents" for k in range(20))
    rows += [(3100 + k, f"start {k} {long}\n{lines}\nend {k}") for k in range(3)]
    table = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    table.repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    return tmp_dir, rows, items


def test_pipeline_equals_brute_force(spark, small):
    from tokenizers import Tokenizer

    from textpulse.llm.queries import tokenizer_path

    path, rows, items = small
    rows = [(i, t) for i, t in rows if test_repetition.brute(t)["kept"]]
    left = [(None if i == "None" else int(i), t) for i, t in test_line_chunks.brute(rows)]
    before = {}
    for i, t in rows:
        before.setdefault(i, t)
    rows = [(i, t) for i, t in left if (t or "").strip() or not (before[i] or "").strip()]
    root = test_simhash.brute_groups([test_simhash.brute_fp(t) for _, t in rows])
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    rows = [(i, t) for (i, t), r in zip(rows, root, strict=True) if i == least[r]]
    rows = [(i, t) for i, t in rows if not test_decontaminate.brute(t, items)[3]]
    library = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and 3000 in {r[0] for r in got}


def test_stages_keep_the_columns_and_count_characters(spark, small):
    path, _, _ = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes
    lines = corpus_pipeline.line_dedup(spark, docs, path)
    assert lines.where(F.length("text") != F.col("n_chars")).count() == 0


def test_registered_queries_run_and_match_their_sql(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    names = [n for n in queries if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] and "pipeline" in queries
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    for name in names:
        if name in oracles:
            df = queries[name](spark, SF)
            columns = ", ".join(sorted(df.columns))
            want = con.execute(f"select {columns} from ({oracles[name]})").fetchall()
            got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
            assert sorted(map(str, got)) == sorted(map(str, want)), name
