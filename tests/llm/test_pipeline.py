"""The pipeline's stages on small tables, and the registered queries."""

import re

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from metercast.llm import packing, queries
from metercast.plans.oracle import compare, duckdb_views

from ..conftest import SF_SMALL
from .conftest import CLASHING, SENTENCE
from .test_dedup import brute_components, brute_lines, brute_spans
from .test_models import brute_counts


def test_registered_queries():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(names) == set(queries.QUERIES)
    assert "pipeline" in E.queries() and set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, name):
    con = duckdb_views(SF_SMALL)
    out = compare(queries.QUERIES[name](spark, SF_SMALL), con, queries.ORACLE[name], name)
    con.close()
    assert out.ok, out.detail


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_other_queries_cover_the_whole_table(spark, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    if name == "op13_spelling_variants":
        pytest.skip("one row for each word: tests/llm/test_spelling.py")
    key = "page_id" if "page_id" in df.columns else "doc_id"
    table = "pages" if key == "page_id" else "documents"
    ids = {r[0] for r in spark.read.parquet(f"{SF_SMALL}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in df.select(key).collect()} == ids


def corpus():
    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(k, f"{text(40)}.\n{text(30)}.") for k in range(60)]
    shared = text(30)
    rows += [(100 + k, f"{text(40)} {shared} {text(25)}") for k in range(6)]          # a shared passage
    near = text(120).split()
    for k in range(5):                                                               # near copies
        w = list(near)
        w[10 * k] = "changed"
        rows.append((200 + k, " ".join(w)))
    rows += [(300 + k, f"a common line of many documents\n{text(50)}") for k in range(5)]
    rows += [(400, SENTENCE), (401, ""), (402, None), (403, "too short"), (404, (text(20) + "\n") * 5)]
    own = text(50)  # rows without an id: clean ones (one twice), and some that the rules reject
    return rows + [(None, own), (None, own), (None, f"a common line of many documents\n{text(50)}"), (None, "short"), (None, None)]


def test_stages_against_brute_force(spark, make_docs, tmp_path):
    rows = corpus()
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = make_docs(rows)
    clean = sorted(t for i, t in rows if i is None and len((t or "").split()) >= 20)  # no stage changes these
    assert len(clean) == 3

    def read(df):
        got = df.collect()
        assert sorted(r.text for r in got if r.doc_id is None) == clean
        return sorted((r.doc_id, r.text) for r in got if r.doc_id is not None)
    stages = dict(corpus_pipeline.STAGES)

    out = stages["quality_rules"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and set(CLASHING) <= set(out.columns)
    fine = [(i, t) for i, t in rows if i is not None and (c := brute_counts(t))[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    assert read(out) == sorted(fine)

    out = stages["line_dedup"](spark, out, str(tmp_path))
    fine = [(i, kept) for i, _, _, kept in brute_lines(fine)]
    assert out.columns == docs.columns and read(out) == sorted(fine)
    assert all(r.n_chars == len(r.text) for r in out.collect())

    out = stages["ngram_jaccard_join"](spark, out, str(tmp_path))
    parts = brute_components(fine, 80, 5)
    fine = [(i, t) for i, t in fine if parts[i][1] == i]
    assert out.columns == docs.columns and read(out) == sorted(fine)
    assert sum(200 <= i < 210 for i, _ in fine) == 1

    out = stages["suffix_array_dedup"](spark, out, str(tmp_path))
    fine = [(i, kept.decode("utf-8", "ignore")) for i, *_, kept in brute_spans(fine)]
    assert out.columns == docs.columns and read(out) == sorted(fine)

    packed = stages["best_fit_packing"](spark, out, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in fine} | {None}
    assert packed.where("doc_id IS NULL AND piece = 0").count() == len(clean)
    assert packed.agg({"length": "max"}).first()[0] <= packing.CAPACITY


def test_pipeline_over_a_table_and_over_nothing(spark, make_docs, tmp_path):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.count() > 0 and got.columns[:2] == ["doc_id", "piece"]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
