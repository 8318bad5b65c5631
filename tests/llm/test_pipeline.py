import os
from collections import Counter

import corpus_pipeline
import pytest
from captionloom.llm import queries
from captionloom.llm.common import table
from captionloom.session import new_shared_path
from test_dedup_mixing import fold, plain_components, plain_fingerprint
from test_text_models import LIBRARY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The output of each stage, in order, after the input."""
    frames = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        path = new_shared_path(spark, name)
        stage(spark, frames[-1], SF).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns_of_documents(stages):
    assert all(set(f.columns) == {"doc_id", "text", "lang", "source", "n_chars"} for f in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    kept = ids(stages[1])
    gone = [i for i in ids(stages[0]) if i not in kept]
    assert gone and sum(labels.get(i, 1) for i in gone) / len(gone) > 0.9
    assert sum(labels[i] and i in kept for i in labels) <= 0.05 * sum(labels.values()) + 1


def test_copies_go(stages):
    groups = {}
    for r in stages[1].collect():
        groups[fold(r["text"])] = max(r["doc_id"], groups.get(fold(r["text"]), -1))
    assert ids(stages[2]) == Counter(groups.values())


def test_near_copies_go(stages):
    rows = sorted((r["doc_id"], plain_fingerprint(r["text"])) for r in stages[2].collect())
    label = plain_components(len(rows), [[bin(a ^ b).count("1") <= 2 for _, b in rows] for _, a in rows])
    assert ids(stages[3]) == Counter(rows[k][0] for k in set(label))


def test_mix_and_tokens(spark, stages):
    texts = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    mixed = ids(stages[4])
    assert set(mixed) <= set(texts) and max(mixed.values()) <= 3
    got = Counter((r["doc_id"], r["n_tokens"]) for r in stages[5].collect())
    assert got == Counter({(i, len(LIBRARY.encode_ordinary(texts[i]))): n for i, n in mixed.items()})
    run = corpus_pipeline.run(spark, SF)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in run.collect()) == got


def test_stages_take_odd_rows_and_nothing(spark, odd, nothing):
    for df in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.count() <= 3 * df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.SQL[name])
    columns = [c[0] for c in cur.description]
    want = Counter(map(tuple, cur.fetchall()))
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == want


def test_nothing_else_imports_this_subpackage():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, files in os.walk(os.path.join(root, "captionloom")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert not [line for line in text if "import" in line and ("llm" in line or "corpus_pipeline" in line)], f
