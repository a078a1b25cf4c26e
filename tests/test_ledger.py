"""Scoring taken up again, and exact token counts of distinct texts."""

import os

import pytest
from pyspark.sql import functions as F

from metercast.operators import scoring as SC
from metercast.operators import token_counts as TC
from metercast.operators.scoring_ledger import ScoringLedger, score_texts_resumable
from metercast.plans import registry

from .conftest import SF_SMALL

KNOWN, UNKNOWN = ["llama3.1-8b", "mistral-large2"], "no-such-model"


def counting_factory(log, poison=None, failing=None):
    """The stand-in scorer, which notes every prompt it is given; ``poison`` ends the worker, ``failing`` is an error row."""
    def factory():
        echo = SC.echo_scorer_factory()()

        def score(model, prompts):
            if poison is not None and poison in prompts:
                os._exit(1)
            with open(os.path.join(log, f"{os.getpid()}"), "a") as f:
                f.writelines(f"{model}\t{p}\n" for p in prompts)
            return [RuntimeError("refused") if p == failing else r for p, r in zip(prompts, echo(model, prompts))]
        return score
    return factory


def calls_in(log):
    return sorted(tuple(line.rstrip("\n").split("\t")) for n in os.listdir(log) for line in open(os.path.join(log, n)))


def rows_of(df):
    return sorted((r.doc_id, r.model, r.response, r.status, r.input_tokens, r.output_tokens) for r in df.collect())


@pytest.fixture()
def texts(spark):
    rows = [(k, f"text {k % 40}") for k in range(60)] + [(100, None), (101, ""), (7, "text 7")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("prompt", F.lit("clashing name"))


def test_a_rerun_calls_only_the_rest(spark, catalog, texts, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    ledger = ScoringLedger(spark, f"{tmp_path}/ledger")
    run = lambda models, **k: rows_of(score_texts_resumable(
        texts, "text", "doc_id", models, counting_factory(str(log), **k), catalog, ledger, batch_size=4, chunk_prompts=5))
    want = lambda models: rows_of(SC.score_texts(texts, "text", "doc_id", models, SC.echo_scorer_factory(), catalog))
    assert run(KNOWN[:1]) == want(KNOWN[:1])
    distinct = sorted({r.text for r in texts.collect()} - {None})
    assert calls_in(log) == [(KNOWN[0], t) for t in distinct]                  # copies are called once
    assert run([*KNOWN, UNKNOWN]) == want([*KNOWN, UNKNOWN])
    assert calls_in(log) == [(m, t) for m in KNOWN for t in distinct]          # the second model alone was called
    assert run([*KNOWN, KNOWN[0]]) == want(KNOWN) and len(calls_in(log)) == 2 * len(distinct)


def test_errors_are_tried_again(spark, catalog, texts, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    ledger = ScoringLedger(spark, f"{tmp_path}/ledger")
    args = (texts, "text", "doc_id", KNOWN[:1])
    first = score_texts_resumable(*args, counting_factory(str(log), failing="text 3"), catalog, ledger)
    assert sorted({(r.response, r.status, r.input_tokens) for r in first.where("status = 'error'").collect()}) == [("refused", "error", 0)]
    n = len(calls_in(log))
    kept = score_texts_resumable(*args, counting_factory(str(log)), catalog, ledger, retry_errors=False)
    assert kept.where("status = 'error'").count() == 2 and len(calls_in(log)) == n
    again = score_texts_resumable(*args, counting_factory(str(log)), catalog, ledger)
    assert again.where("status = 'error'").count() == 0 and len(calls_in(log)) == n + 1


def test_a_lost_run_keeps_its_finished_chunks(spark, catalog, texts, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    ledger = ScoringLedger(spark, f"{tmp_path}/ledger")
    args = (texts, "text", "doc_id", KNOWN[:1])
    with pytest.raises(Exception):  # noqa: B017 - the worker dies, the job with it
        score_texts_resumable(*args, counting_factory(str(log), poison="text 39"), catalog, ledger, chunk_prompts=2)
    kept = {bytes(r.prompt_hash) for r in ledger.calls().collect()}
    assert 0 < len(kept) < 41
    before = len(calls_in(log))
    got = rows_of(score_texts_resumable(*args, counting_factory(str(log)), catalog, ledger, chunk_prompts=2))
    assert got == rows_of(SC.score_texts(texts, "text", "doc_id", KNOWN[:1], SC.echo_scorer_factory(), catalog))
    assert len(calls_in(log)) - before == 41 - len(kept)                       # 40 texts and the empty one


def test_nothing_to_score(spark, catalog, texts, tmp_path):
    ledger = ScoringLedger(spark, f"{tmp_path}/ledger")
    for df, models in ((texts.limit(0), KNOWN), (texts.where("text IS NULL"), KNOWN), (texts, [])):
        assert score_texts_resumable(df, "text", "doc_id", models, SC.echo_scorer_factory(), catalog, ledger).count() == 0
    only = score_texts_resumable(texts, "text", "doc_id", [UNKNOWN], SC.echo_scorer_factory(), catalog, ledger)
    assert {(r.response, r.status) for r in only.collect()} == {(f"Unknown model: {UNKNOWN}", "error")}


# -- exact token counts ----------------------------------------------------------------

def test_exact_counts_equal_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = ["", "hello world", "hello world", "naïve – 东京 \n\n x", "hi <|endoftext|> there", "a" * 5000, None, "hello world"]
    df = spark.createDataFrame([(k, "ab"[k % 2] if k else None, t) for k, t in enumerate(texts)], "doc_id long, g string, text string")
    n = [None if t is None else len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    factory = TC.vocabulary_tokenizer_factory()
    got = {r.doc_id: r.n_tokens for r in TC.exact_token_counts(df, "text", "doc_id", factory).collect()}
    assert got == dict(enumerate(n)) and got[0] == 0
    stats = {r.g: r for r in TC.exact_token_stats(df, "text", "g", factory).collect()}
    for g in (None, "a", "b"):
        own = [(t, n[k]) for k, t in enumerate(texts) if t is not None and ("ab"[k % 2] if k else None) == g]
        counts = [c for _, c in own]
        assert (stats[g].texts, stats[g].distinct_texts, stats[g].total_tokens, stats[g].min_tokens, stats[g].max_tokens) \
            == (len(own), len({t for t, _ in own}), sum(counts), min(counts), max(counts))
        assert stats[g].avg_tokens == pytest.approx(sum(counts) / len(counts))
    assert TC.exact_token_stats(df.limit(0), "text", "g", factory).count() == 0


def test_copies_are_counted_once(spark, tmp_path):
    log = str(tmp_path)

    def factory():
        def count(texts):
            with open(os.path.join(log, f"{os.getpid()}"), "a") as f:
                f.writelines(f"count\t{t}\n" for t in texts)
            return [len(t) for t in texts]
        return count
    df = spark.range(0, 900, 1, 6).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    assert TC.exact_token_counts(df, "text", "id", lambda: factory()).agg(F.count("n_tokens")).first()[0] == 900
    assert len(calls_in(log)) == 301


def test_token_queries_equal_the_library_on_the_whole_table(spark):
    public = pytest.importorskip("public_tokenizers")
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want, langs = {}, {}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        want[r.doc_id] = None if r.text is None else len(tok.encode(r.text, add_special_tokens=False).ids)
        if r.text is not None:
            langs.setdefault(r.lang, []).append((r.text, want[r.doc_id]))
    assert {r.doc_id: r.n_tokens for r in registry.QUERIES["exact_token_counts"](spark, SF_SMALL).collect()} == want
    got = {r.lang: tuple(r)[1:] for r in registry.QUERIES["exact_token_stats"](spark, SF_SMALL).collect()}
    for lang, rows in langs.items():
        n = [c for _, c in rows]
        assert got.pop(lang) == (len(n), len({t for t, _ in rows}), sum(n), pytest.approx(sum(n) / len(n)), min(n), max(n))
    assert not got


def test_the_ledger_query_equals_its_oracle_twice(spark):
    from metercast.plans.oracle import compare, duckdb_views
    con = duckdb_views(SF_SMALL)
    for _ in range(2):
        out = compare(registry.QUERIES["score_texts_resumed"](spark, SF_SMALL), con, registry.ORACLE["score_texts_resumed"])
        assert out.ok, out.detail
    con.close()
