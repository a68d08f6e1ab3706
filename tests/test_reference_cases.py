"""Small cases with known results."""

import pytest
from pyspark.sql import functions as F

from evisparq.functions.stem import stem
from evisparq.operators import audit, evidence, expansion, gates, metrics, panel, retrieval, stats
from evisparq.plans import generation, registry
from evisparq.sources import store


def one(df):
    return df.collect()[0]


def test_bm25_build_save_load_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Asthma treatment", "Bronchodilator therapy", []), (2, "Diabetes", "Insulin therapy", []), (3, "Hypertension", "Blood pressure therapy", [])], "doc_id long, title string, text string, mesh_terms array<string>")
    store.save_index(retrieval.bm25_index(docs), str(tmp_path / "i"))
    index = store.load_index(spark, str(tmp_path / "i"))
    q = spark.createDataFrame([(7, "asthma bronchodilator")], "question_id long, question string")
    assert one(retrieval.bm25_search(index, q, 1)).doc_id == 1
    assert retrieval.fill_run(retrieval.bm25_search(index, q, 3), q, docs, 3).count() == 3
    with pytest.raises(ValueError):
        retrieval.bm25_search(index, q, 0)


def ap(spark, ranked, gold, k=10):
    run = retrieval.dedupe_ranked(spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ranked)], "question_id long, doc_id string, rank int"), k)
    q = spark.createDataFrame([(1,)], "question_id long")
    return one(metrics.retrieval_metrics(run, spark.createDataFrame([(1, x) for x in gold], "question_id long, doc_id string"), q, k))


def test_average_precision(spark):
    assert ap(spark, ["a", "noise", "b"], ["a", "b"]).ap == pytest.approx((1 + 2 / 3) / 2, abs=1e-6)
    assert ap(spark, [f"g{i}" for i in range(10)], [f"g{i}" for i in range(12)]).ap == 1.0
    assert ap(spark, ["a", "a", "b"], ["a", "b"]).ap == 1.0
    assert tuple(ap(spark, [], ["a"]))[1:] == (0.0,) * 5
    assert tuple(ap(spark, ["a"], []))[1:] == (0.0,) * 5


def test_expansion(spark):
    corpus = spark.createDataFrame([(["Breast Neoplasms"],)], "mesh_terms array<string>")
    q = spark.createDataFrame([(1, "How are breast neoplasms treated?"), (2, "Unrelated")], "question_id long, question string")
    got = {r.question_id: r.query for r in expansion.expand(q, expansion.term_vocabulary(corpus)).collect()}
    assert got == {1: "How are breast neoplasms treated? Breast Neoplasms", 2: "Unrelated"}


def test_expansion_finds_terms_of_any_length(spark):
    term = "Amine Oxidase (Copper-Containing) of the Long-Named and Rarely-Seen Kind Two"
    corpus = spark.createDataFrame([([term, "Kind"],)], "mesh_terms array<string>")
    q = spark.createDataFrame([(1, f"What does {term.lower()} do?"), (2, "What kind?")], "question_id long, question string")
    got = {r.question_id: r.query for r in expansion.expand(q, expansion.term_vocabulary(corpus)).collect()}
    assert got == {1: f"What does {term.lower()} do? {term} Kind", 2: "What kind? Kind"}
    assert {r.query for r in expansion.expand(q, expansion.term_vocabulary(corpus.limit(0))).collect()} == {r.question for r in q.collect()}


def test_resamples_as_many_as_the_reference(spark):
    rows = spark.createDataFrame([(i, 1.0) for i in range(40)], "i long, delta double")
    assert stats.permutation_p(rows).first().p == round(1 / 10_001, 6)
    groups = spark.createDataFrame([(g, float(g * g % 7)) for g in range(9)], "grp long, delta double")
    assert stats.bootstrap(groups).first() == stats.bootstrap(groups, 10_000).first()


def test_windows_slice_back(spark):
    text = "First sentence.  Second sentence! Third sentence?"
    docs = spark.createDataFrame([(1, text), (2, "no end"), (3, ""), (4, "\xe9\xe9. Z\xfc. 9")], "doc_id long, text string")
    rows = evidence.sentence_windows(docs, 2).collect()
    for r in rows:
        body = {1: text, 2: "no end", 3: "", 4: "\xe9\xe9. Z\xfc. 9"}[r.doc_id]
        assert body[r.begin : r.end] == r.snippet
    assert [(r.begin, r.snippet) for r in rows if r.doc_id == 1][0] == (0, "First sentence.  Second sentence!")
    assert sum(r.doc_id == 4 for r in rows) == 3 and sum(r.doc_id == 3 for r in rows) == 1


def test_chunks_cover(spark):
    words = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, words), (2, "  "), (3, words[:60])], "doc_id long, text string")
    rows = sorted((r for r in evidence.fixed_chunks(docs, 32, 8).collect()), key=lambda r: (r.doc_id, r.chunk))
    assert [r.chunk for r in rows if r.doc_id == 1] == [0, 1, 2, 3] and not [r for r in rows if r.doc_id == 2]
    assert all(words[r.begin : r.end] == r.snippet for r in rows if r.doc_id == 1)
    assert rows[3].snippet.split()[-1] == "w99" and rows[1].snippet.split()[0] == "w24"
    with pytest.raises(ValueError):
        evidence.fixed_chunks(docs, 16)


def test_order_diversity_packing(spark):
    assert one(spark.createDataFrame([(list("abcd"), ["a", "b"])], "x array<string>, y array<string>").select(evidence.strongest_middle("x"), evidence.strongest_middle("y")))[:] == (["b", "a", "c", "d"], ["a", "b"])
    rows = spark.createDataFrame([(1, d, i + 1, str(d), "t", s) for i, (d, s) in enumerate([(0, "a " * 90), (0, "b " * 300), (1, "c"), (1, "d")])], "question_id long, doc_id long, rank int, pmid string, title string, snippet string")
    assert sorted(r.doc_id for r in evidence.source_diverse(rows).collect()) == [0, 1]
    packed = one(evidence.pack(rows, 120))
    assert packed.ranks == [1, 3, 4] and packed.used <= 120 and packed.context.count("[PMID:") == 3
    with pytest.raises(ValueError):
        evidence.pack(rows, 99)


def test_overlap_and_spans(spark):
    pairs = spark.createDataFrame([(1, "alpha beta gamma", "alpha beta gamma"), (2, "", "x"), (3, "a b", "b a")], "qa long, prediction string, reference string")
    got = {r.qa: r.f1 for r in metrics.overlap_f1(pairs, "qa").collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and got[3] == pytest.approx(2 / 3, abs=1e-6)
    spans = spark.createDataFrame([(1, "http://x/9/", "Abstract", 2, 8)], "question_id long, document string, section string, begin int, end int")
    q = spark.createDataFrame([(1,), (2,)], "question_id long")
    assert {r.question_id: r.f1 for r in metrics.span_f1(spans, spans, q).collect()} == {1: 1.0, 2: 0.0}


def test_stems(spark):
    cases = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat rational:ration digitizer:digit vietnamization:vietnam hopefulness:hope sensibiliti:sensibl triplicate:triplic electrical:electr goodness:good revival:reviv replacement:replac adoption:adopt homologous:homolog probate:probat rate:rate cease:ceas controll:control roll:roll"
    for case in cases.split():
        word, want = case.split(":")
        assert stem(word) == want, (word, stem(word))
    pairs = spark.createDataFrame([(1, "Motoring cats, hopping!", "motors cat hops"), (2, "", "x y"), (3, None, None)], "qa long, prediction string, reference string")
    assert {r.qa: r.f1 for r in metrics.overlap_f1(pairs, "qa", 1, False, stemmed=True).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_exact_answers(spark):
    schema = "question_id long, type string, predicted array<string>, gold array<array<string>>"
    rows = [(1, "yesno", ["Yes"], [["yes"]]), (2, "factoid", ["x", "b"], [["B", "bee"]]), (3, "list", ["a", "b"], [["A"], ["c"]]), (4, "summary", None, None)]
    got = {r.question_id: r for r in metrics.exact_answer(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].strict == 1.0 and (got[2].strict, got[2].lenient, got[2].mrr) == (0.0, 1.0, 0.5) and got[3].f1 == 0.5
    with pytest.raises(Exception, match="unavailable"):
        metrics.exact_answer(spark.createDataFrame([(1, "factoid", ["x"], None)], schema)).collect()


def test_statistics(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "grp string, delta double")
    assert one(stats.bootstrap(rows, 100)).ci95_low == 1.0
    assert one(stats.effect_size(rows)).effect == 0.0
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r.name: r.adjusted for r in stats.holm(tests).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    ratings = spark.createDataFrame([(u, s) for u, s in ((1, 0), (2, 3)) for _ in range(3)], "unit long, score int")
    assert one(stats.krippendorff_ordinal(ratings)).alpha == 1.0
    with pytest.raises(ValueError):
        stats.paired(tests.select("name", "p"), tests.where("p < 0.02").select("name", "p"), "name", "p")


def test_percentile(spark):
    got = one(metrics.describe(spark.createDataFrame([(10,), (20,)], "v int"), "v"))
    assert got.p95 == 20.0 and got["median"] == 15.0
    assert one(metrics.describe(spark.createDataFrame([], "v int"), "v")).max is None


def test_gates(spark):
    row = spark.createDataFrame([(0.02, 0.005, 0.0, 1.2, 4, 4)], "mean_delta double, ci95_low double, failure_delta double, p95_ratio double, n_left int, n_right int")
    assert one(gates.superiority(row)).passed and one(gates.noninferiority(row)).passed and one(gates.evidence(row)).passed
    assert not one(gates.superiority(row.withColumn("p95_ratio", F.lit(None).cast("double")))).passed
    screen = spark.createDataFrame([(0.15, 0.0, 1.0, 5.0, 40)], "failure_rate double, retry_rate double, citation_validity double, p95_ms double, questions int")
    assert not one(gates.generator_screen(screen)).passed


def test_panel(spark):
    votes = [(1, "left"), (1, "right"), (1, "tie"), (2, "left"), (2, "right"), (2, "right")]
    got = {r.q: r.winner for r in panel.winner(spark.createDataFrame(votes, "q long, vote string"), "q").collect()}
    assert got == {1: "tie", 2: "right"}


def test_runs_and_codes(spark):
    shards = spark.createDataFrame([(1, 1, True, None), (1, 2, False, "x"), (2, 1, False, "y")], "question_id long, shard int, failed boolean, result string")
    got = {r.question_id: (r.shard, r.recovered) for r in audit.merge_shards(shards).collect()}
    assert got == {1: (2, True), 2: (1, False)}
    with pytest.raises(ValueError):
        audit.merge_shards(shards.union(spark.createDataFrame([(2, 2, False, "z")], shards.schema)))
    fields = "failed boolean, has_provenance boolean, retrieved_hit boolean, packed_hit boolean, span_f1 double, answered boolean, type_ok boolean, cited int, valid int, rouge double"
    codes = lambda *r: one(spark.createDataFrame([r], fields).select(audit.error_codes().alias("c"))).c
    assert codes(False, False, False, False, 0.0, True, True, 1, 1, 0.5) == []
    assert codes(False, True, False, False, 0.0, True, True, 1, 1, 0.5) == ["R1"]
    assert codes(True, True, True, False, 0.0, True, False, 2, 1, 0.0) == ["SYS1", "CTX1", "G3", "CIT2"]


def test_registry():
    families = registry.load_registry()
    assert registry.validate_registry(families) == {"core": 41, "stretch": 13}
    with pytest.raises(ValueError, match="unknown"):
        registry.levels([{"id": "A", "depends_on": ["Z"], "arms": []}])
    with pytest.raises(ValueError, match="cycle"):
        registry.levels([{"id": "A", "depends_on": ["B"], "arms": []}, {"id": "B", "depends_on": ["A"], "arms": []}])
    with pytest.raises(ValueError):
        registry.PipelineConfig("Bad Name")


def test_answers_citations_cache_and_traces(spark, tmp_path):
    q = spark.createDataFrame([(1, "What?", "summary"), (2, "Why?", "yesno")], "question_id long, question string, type string")
    contexts = spark.createDataFrame([(1, "[PMID:1] T\nSome fact. More."), (2, "")], "question_id long, context string")
    made = lambda: F.when(F.col("question_id") == 1, F.lit('{"predicted_type":"summary","ideal_answer":"a","citation_pmids":["1","999","1"],"abstained":false}')).otherwise(F.lit("broken"))
    got = {r.question_id: r for r in generation.answer(q, contexts, provider=made).collect()}
    assert got[1].citations == ["1"] and got[1].citation_count == 2 and not got[1].failed
    assert got[2].failed and got[2].citations == []
    cache, at = str(tmp_path / "cache"), str(tmp_path / "traces")
    for _ in range(2):
        generation.answer_and_trace(q, contexts, "bm25_rag", at, cache_path=cache).collect()
    assert spark.read.parquet(cache).count() == 2
    rows = store.get_traces(spark, at).collect()
    assert len(rows) == 2 and '"failed":false' in rows[0].payload
    secret = spark.createDataFrame([('{"api_key":"abc","n":1,"my_secret":{"x":2}}',)], "payload string").select(store.redact("payload").alias("p"))
    assert "abc" not in one(secret).p and '"n":1' in one(secret).p


def test_parser(spark):
    parse = lambda raw: one(spark.createDataFrame([(raw,)], "raw string").select(generation.parse_answer("raw").alias("a")).select("a", generation.valid_answer("a").alias("ok")))
    kept = parse('```json\n{"predicted_type":"summary","ideal_answer":null,"abstained":true,"citation_pmids":[]}\n```')
    assert kept.ok and kept.a.ideal_answer == generation.INSUFFICIENT
    assert not parse('{"predicted_type":"summary","ideal_answer":null,"abstained":false}').ok
    assert not parse("nothing").ok


def test_jsonl_and_pins(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id":"1"}\nbroken\n')
    with pytest.raises(Exception, match="x.jsonl:2"):
        store.scan_jsonl(spark, str(path), "id string").collect()
    assert [r.id for r in store.scan_jsonl(spark, str(path), "id string", strict=False).collect() if r._corrupt_record is None] == ["1"]
    digests = store.file_digests(spark, str(tmp_path))
    pins = digests.select(F.lit("x.jsonl").alias("name"), "length", "sha256").union(spark.createDataFrame([("gone", 1, "0")], "name string, length long, sha256 string"))
    assert {r.name: r.matches for r in store.verify_pin(digests, pins).collect()} == {"x.jsonl": True, "gone": False}
