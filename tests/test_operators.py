import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.model import ClusterConfig, EmptySchema, FieldKind, LinkMode, ModelParams, PipelineConfig, Schema
from linkweave.operators import blocking as B
from linkweave.operators import cluster as C
from linkweave.operators import em, graph, inference, metrics
from linkweave.operators import keys as K
from linkweave.operators.compare import FieldComparator
from linkweave.operators.graph import components
from linkweave.plans import catalogue, scenarios
from linkweave.plans.pipeline import Pipeline
from linkweave.sources import sinks
from linkweave.sources.ingest import fnv1a
from linkweave.sources.store import EntityStore, ModelRegistry
from linkweave.streaming.ingester import Ingester

SF = "/root/testdata/sf0.001"


def keys(spark, key, row, schema):
    d = spark.createDataFrame([(1, *row)], "record_id long, " + schema)
    return sorted(r["block_key"] for r in B.CompositeBlocker(key).index(d).collect())


def test_keys(spark):
    assert keys(spark, K.PlateOcrFuzzy("p"), ("AB-1",), "p string") == ["plate_ocr:A1", "plate_ocr:AB", "plate_ocr:AB1", "plate_ocr:B1"]
    assert keys(spark, K.FuzzyYear("n", "d", 1), ("Smit", "1980-01-01"), "n string, d string") == [f"phonetic_dob:SMT:{y}" for y in (1979, 1980, 1981)]
    assert keys(spark, K.FuzzyYear("n", "d", 1), ("Smit", "1980-01-02"), "n string, d string") == []
    assert keys(spark, K.AliasPhonetic("a", "d"), ("Smit|Bos||Smits", "1980"), "a string, d string") == ["phonetic_dob:PS:1980", "phonetic_dob:SMT:1980", "phonetic_dob:SMTS:1980"]
    assert keys(spark, K.CameraTimeWindow("c", "t", 10), ("c1", "2024-01-01T10:29:00"), "c string, t string") == ["cam_time_window:c1:2024-01-01:62"]
    assert keys(spark, K.CameraTimeWindow("c", "t", 10), ("c1", "2024-01-01 10:29"), "c string, t string") == []
    assert keys(spark, K.GeoGrid("a", "b", 0.5), ("-0.1", "0.6"), "a string, b string") == ["geo_grid:-1:1"]
    assert keys(spark, K.Suffix("p", 4), ("+31 6-12",), "p string") == ["suffix:1612"]
    assert keys(spark, K.Suffix("p", 9), ("12",), "p string") == []
    assert keys(spark, K.DateFragment("d", 7), (None,), "d string") == []


def test_pairs_match_brute_force_and_cap(spark):
    rows = [(i, "AB"[i % 2], f"k{i % 3}") for i in range(30)]
    idx = spark.createDataFrame(rows, "record_id long, source string, block_key string").select("block_key", "record_id", "source")
    want = {(a, b) for (a, _, k), (b, _, l) in itertools.combinations(rows, 2) if k == l}
    assert {tuple(r) for r in B.candidate_pairs(idx, 0).collect()} == want
    assert B.candidate_pairs(idx, 9).count() == 0
    cross = {(a, b) for a, b in want if a % 2 != b % 2}
    assert {tuple(r) for r in B.candidate_pairs(idx, 300, "link-only").collect()} == cross


@pytest.mark.parametrize("chunk", [2048, 3])
def test_pairs_of_several_keys_and_sources_come_once(spark, monkeypatch, chunk):
    """Records of several buckets, an id of two sources, hot buckets that are met chunk by chunk."""
    monkeypatch.setattr(B, "CHUNK", chunk)
    monkeypatch.setattr(B, "LOOKS", 20)
    rng = np.random.default_rng(3)
    rows = [(int(i), "ABC"[i % 3], f"k{k}") for i in range(40) for k in rng.choice(6, 3)] + [(1, "C", "k1"), (1, "A", "k1"), (2, "A", "k1"), (2, "C", "k1"), (2, None, "k2"), (5, None, "k2")]
    idx = spark.createDataFrame(rows, "record_id long, source string, block_key string").select("block_key", "record_id", "source")
    every = [((a, s), (b, t)) for (a, s, k), (b, t, l) in itertools.product(rows, rows) if k == l and a < b]
    for mode, want in (("dedupe", {(x[0], y[0]) for x, y in every}), ("link_only", {(x[0], y[0]) for x, y in every if x[1] != y[1]})):
        got = [tuple(r) for r in B.candidate_pairs(idx, 0, mode).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_pair_is_shuffled(spark):
    people = catalogue.people(spark, SF)
    plan = FieldComparator(catalogue.PEOPLE_CMP).compare_blocked(catalogue.people_index(spark, SF), people)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin")]
    assert "Exchange" not in above and "Aggregate" not in above
    joined = FieldComparator(catalogue.PEOPLE_CMP).compare(B.candidate_pairs(catalogue.people_index(spark, SF)), people)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, catalogue.people_compared(spark, SF).collect()))


def test_edges_are_thinned_before_they_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES", 50)
    monkeypatch.setattr(graph, "HELD", 60)
    e = spark.createDataFrame(list(itertools.combinations(range(40), 2)) + [(100 + i, 101 + i) for i in range(100)], "a long, b long").coalesce(1)
    thin = graph.thinned(e)
    assert thin.count() <= 300
    assert {tuple(r) for r in components(thin.toDF("a", "b")).collect()} == {(i, 0) for i in range(40)} | {(i, 100) for i in range(100, 201)}


def test_linear_links_of_sizes_stand_for_all_links(spark):
    rows = [(r["record_id"], r["brand"], r["type"], r["size"]) for r in catalogue.parts(spark, SF).collect()]
    all_links = [(a[0], b[0]) for a, b in itertools.combinations(sorted(rows), 2) if a[1:3] == b[1:3] and abs(a[3] - b[3]) <= 1]
    few = catalogue.size_links(spark, SF)
    assert few.count() < 2 * len(rows)
    found = lambda e: {tuple(r) for r in components(e).collect()}
    assert found(few) == found(spark.createDataFrame(all_links, "a long, b long"))
    ends = all_links + [(b, a) for a, b in all_links]
    degrees = {i: sum(a == i for a, _ in ends) for i in {a for a, _ in ends}}
    assert dict(map(tuple, catalogue.size_degrees(spark, SF).collect())) == degrees
    asked = spark.createDataFrame([(i,) for i in list(degrees)[:20]], "record_id long")
    assert {tuple(r) for r in catalogue.size_neighbours(spark, SF, asked).collect()} == {e for e in ends if e[0] in list(degrees)[:20]}


def test_curve_of_marked_pairs_equals_that_of_all(spark):
    people, truth = catalogue.people(spark, SF), catalogue.truth(spark, SF)
    keyed = catalogue.people_keyed(spark, SF).withColumn("match_probability", F.round("match_probability", 9))
    plain = catalogue.with_keys(catalogue.people_scored(spark, SF).withColumn("match_probability", F.round("match_probability", 9)), people)
    assert sorted(map(tuple, metrics.curve(keyed, truth).collect())) == sorted(map(tuple, metrics.curve(plain, truth).collect()))
    hit = keyed.join(truth, ["key_a", "key_b"], "left_semi")
    assert hit.where("maybe").count() == hit.count() > 0 and keyed.where("maybe").count() < 2 * hit.count()


def test_components_chain_star_and_empty(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1050)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1050)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_star_prune_keeps_hub_and_neighbours(spark):
    links = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (2, 4, 0.9), (4, 5, 0.9)], "a long, b long, p double")
    members = spark.createDataFrame([(i, 1) for i in range(1, 6)], "record_id long, entity long")
    got = {tuple(r) for r in C.star_prune(members, links, ClusterConfig(max_cluster_size=4)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1)}


def synthetic(seed=5, match=200, other=800):
    rng = np.random.default_rng(seed)
    m = rng.choice(4, (match, 3), p=[0.02, 0.05, 0.13, 0.8])
    u = rng.choice(4, (other, 3), p=[0.8, 0.1, 0.05, 0.05])
    return np.concatenate([m, u]), match / (match + other)


def test_em_recovers_share_and_equals_expanded_rows():
    x, share = synthetic()
    seen, n = np.unique(x, axis=0, return_counts=True)
    p, _ = em.run_em(seen, n.astype(float))
    q, _ = em.run_em(x, np.ones(len(x)))
    assert em.change(p, q) < 1e-9
    assert abs(1 / (1 + np.exp(-p.log_prior_odds)) - share) < 0.05
    assert all(m[3] > 0.6 and u[0] > 0.6 for m, u in zip(p.m, p.u))


def test_spark_em_equals_numpy(spark):
    x, _ = synthetic()
    seen, n = np.unique(x, axis=0, return_counts=True)
    levels = ["lvl_0", "lvl_1", "lvl_2"]
    d = spark.createDataFrame([(*map(int, r), int(c)) for r, c in zip(seen, n)], "lvl_0 int, lvl_1 int, lvl_2 int, n long")
    p = q = em.initial_params(3, 0.2)
    for _ in range(3):
        p = em.m_step(seen, n.astype(float), em.probabilities(seen, p), p)
    assert em.change(p, em.spark_em(d, levels, q, 3)) < 1e-9


def test_nulls_give_no_evidence(spark):
    s = Schema.of(a="Categorical", b="Categorical")
    r = spark.createDataFrame([(1, "x", None), (2, "x", ""), (3, "y", "z")], "record_id long, a string, b string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert sorted(map(tuple, FieldComparator(s).compare(pairs, r).collect())) == [(1, 2, 3, 0), (1, 3, 0, 0)]
    assert sorted(map(tuple, FieldComparator(s, missing_as_null=True).compare(pairs, r).collect())) == [(1, 2, 3, 255), (1, 3, 0, 255)]
    p = em.default_params(2)
    d = spark.createDataFrame([(3, 255), (3, 3)], "lvl_0 int, lvl_1 int")
    w = [r["match_weight"] for r in em.score(d, ["lvl_0", "lvl_1"], p).collect()]
    assert w[0] == pytest.approx(w[1] / 2)


def test_inference_and_fingerprints(spark):
    assert inference.kind_of_name("license_plate") == FieldKind.ID
    assert inference.kind_of_name("datetime") == FieldKind.DATE
    assert inference.kind_of_name("kenteken") == FieldKind.LICENSE_PLATE
    assert inference.kind_of_name("xyz") is None
    d = spark.createDataFrame([(f"2020-01-{i:02}", f"word{i} and more words to make a long text here {i}", "c") for i in range(1, 21)], "q string, w string, z string")
    assert {f.name: f.kind.value for f in inference.infer_schema(d).fields} == {"q": "Date", "w": "FreeText", "z": "Categorical"}
    with pytest.raises(EmptySchema):
        Schema(())
    a, b = Schema.of(x="Name", y="Date"), Schema.of(y="Date", x="Name")
    assert inference.schema_hash(a) == inference.schema_hash(b)
    assert inference.fingerprint_distance(inference.fingerprint(a), inference.fingerprint(Schema.of(z="Id"))) == pytest.approx(0.7)


def test_registry(tmp_path):
    r, s = ModelRegistry(str(tmp_path)), Schema.of(x="Name", y="Date")
    f = inference.fingerprint(s)
    assert r.startup(f) == ("ColdStart", None)
    p = em.default_params(2)
    r.save(f, p)
    mode, got = ModelRegistry(str(tmp_path)).startup(f)
    assert mode == "WarmLoad" and got == p
    assert r.delete(f["hash"]) and r.startup(f)[0] == "ColdStart"
    assert ModelParams.from_json(p.to_json()) == p


def test_modes_and_ids():
    assert LinkMode.parse("dedupe") == LinkMode.DEDUPLICATE and LinkMode.parse("Link-And-Dedupe") == LinkMode.LINK_AND_DEDUPE
    assert fnv1a("") == 0xCBF29CE484222325 and fnv1a("a") == 0xAF63DC4C8601EC8C


def test_pipeline_links_people_with_high_f1(spark, tmp_path):
    people = catalogue.people(spark, SF)
    registry = ModelRegistry(str(tmp_path))
    run = Pipeline(catalogue.PEOPLE, EntityStore(spark), registry=registry, config=PipelineConfig(link_mode="link_only")).run_batch(people)
    pairs = catalogue.with_keys(run.scored.where("band = 'AutoMatch'"), people)
    from linkweave.operators.metrics import confusion

    got = confusion(pairs, catalogue.truth(spark, SF)).first()
    assert got["f1"] >= 0.9, got
    assert run.report.startup_mode == "ColdStart" and run.report.within_source_pairs == 0
    again = Pipeline(catalogue.PEOPLE, EntityStore(spark), registry=registry, config=PipelineConfig(link_mode="link_only")).run_batch(people)
    assert again.report.startup_mode == "WarmLoad" and again.report.em_iterations == 0


def test_ingester_batches_equal_one_by_one(spark):
    s = Schema.of(n="Categorical", p="Phone")
    rows = [(1, 1, "a", "0612345678"), (2, 2, "a", "0612345678"), (3, 3, "b", "0699999999"), (4, 4, "a", "0612345678"), (5, 5, "b", "0699999999")]
    make = lambda: Ingester(spark, s, B.CompositeBlocker(K.Suffix("p", 7)))
    df = lambda rs: spark.createDataFrame(rs, "record_id long, seq long, n string, p string")
    one, many = make(), make()
    one.process(df(rows))
    for at in (0, 2, 4):
        many.process(df(rows[at : at + 2]))

    def groups(i):
        found = {}
        for r in i.results.collect():
            found.setdefault(r["entity"], set()).add(r["record_id"])
        return sorted(map(sorted, found.values()))

    assert groups(one) == groups(many) == [[1, 2, 4], [3, 5]]


PERSON = "record_id long, seq long, n string, p string"


def _stream(spark, **more):
    return Ingester(spark, Schema.of(n="Categorical", p="Phone"), B.CompositeBlocker(K.Suffix("p", 7)), **more)


def _entities(i):
    return {r["record_id"]: r["entity"] for r in i.results.collect()}


def test_ingester_joins_the_partners_entity_whatever_the_ids(spark):
    """A record of a smaller id that comes later joins the entity that is there, in one batch or over several."""
    a, b = "0612345678", "0699999999"
    rows = [(100, 1, "x", a), (5, 2, "x", a), (70, 3, "y", b), (3, 4, "y", b), (1, 5, "x", a)]
    want = {100: 100, 5: 100, 1: 100, 70: 70, 3: 70}
    for sizes in ([5], [1, 1, 1, 1, 1], [2, 3], [3, 2]):
        i, at = _stream(spark), 0
        for n in sizes:
            i.process(spark.createDataFrame(rows[at : at + n], PERSON))
            at += n
        assert _entities(i) == want, sizes


def test_ingester_replays_and_restarts(spark):
    """A batch that comes again changes nothing; another ingester on the same folder goes on; an unfinished batch leaves no trace."""
    df = lambda *rs: spark.createDataFrame(list(rs), PERSON)
    one = _stream(spark)
    first = df((9, 1, "x", "0612345678"), (8, 2, "z", "0611111111"))
    got = sorted(one.process(first, 0).collect())
    assert sorted(one.process(first, 0).collect()) == got and one.results.count() == 2
    two = _stream(spark, path=one.path)
    two.versions.write("results", one.results.withColumn("batch", F.lit(1).cast("long")))  # a batch that failed before its state was published
    assert two.results.count() == 2
    assert [(r["record_id"], r["partner"], r["entity"]) for r in two.process(df((2, 3, "x", "0612345678")), 1).collect()] == [(2, 9, 9)]
    assert _entities(one) == {9: 9, 8: 8, 2: 9} and two.versions.state()["batch"] == 1
    assert sorted(two.process(first, 0).collect()) == got


def test_ingester_borderline_partner_founds_an_entity(spark):
    """A borderline record has no entity until a later one matches it."""
    params = em.default_params(2)
    i = _stream(spark, params=params)
    i.process(spark.createDataFrame([(50, 1, "x", "0612345678")], PERSON))
    i.params = type(params)(params.m, params.u, params.log_prior_odds, 2.0, 0.0)  # whatever it meets stays borderline
    i.process(spark.createDataFrame([(40, 2, "x", "0612345678")], PERSON))
    assert _entities(i) == {50: 50, 40: None} and i.borderlines().count() == 1
    i.params = params
    i.process(spark.createDataFrame([(30, 3, "x", "0612345678")], PERSON))  # of equal partners the last one
    assert _entities(i) == {50: 50, 40: 40, 30: 40} and i.borderlines().count() == 0


def test_ingester_many_batches_compact(spark):
    i = _stream(spark)
    i.versions.COMPACT = 3
    for k in range(6):
        i.process(spark.createDataFrame([(10 - k, k, "x", "0612345678")], PERSON))
    assert set(_entities(i).values()) == {10} and all(len(p) <= 3 for p in i.versions.state()["parts"].values())


def test_ingester_as_a_stream_sink(spark, tmp_path):
    source = tmp_path / "in"
    df = spark.createDataFrame([(7, 1, "x", "0612345678"), (6, 2, "x", "0612345678")], PERSON)
    df.coalesce(1).write.parquet(str(source))
    i = _stream(spark, path=f"file://{tmp_path}/state")
    for _ in range(2):  # the second run finds nothing new
        q = i.start(spark.readStream.schema(df.schema).parquet(str(source)), str(tmp_path / "checkpoint"))
        q.processAllAvailable()
        q.stop()
    assert _entities(_stream(spark, path=f"file://{tmp_path}/state")) == {7: 7, 6: 7}


def test_em_smoothing(spark):
    x, n = np.array([[3, 3], [0, 0], [3, 0]]), np.array([50.0, 900.0, 5.0])
    plain, _ = em.run_em(x, n)
    smooth, done = em.run_em(x, n, smoothing=em.SMOOTHING)
    assert done >= 1 and (smooth.upper_threshold, smooth.lower_threshold) == em.SMOOTHED_THRESHOLDS
    assert min(min(f) for f in plain.m) < 1e-8 < 1e-6 < min(min(f) for f in smooth.m + smooth.u)
    assert np.allclose(np.sum(smooth.m, 1), 1) and np.allclose(plain.m, smooth.m, atol=1e-3)


def test_rules_from_files(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([(i, f"AB{i}", "x") for i in range(20)], "record_id long, colour string, dob string")
    names, values = tmp_path / "names.toml", tmp_path / "values.toml"
    names.write_text('[[rules]]\nkind = "Categorical"\nexact = ["dob"]\n')
    values.write_text('[[rules]]\nkind = "LicensePlate"\nregex = "^AB"\nshare = 0.9\n')
    kinds = lambda s: {f.name: f.kind.value for f in s.fields}
    assert kinds(inference.infer_schema(d)) == {"colour": "Name", "dob": "Date"}
    assert kinds(inference.infer_schema(d, name_rules=inference.rules_from(str(names)), value_rules=inference.rules_from(str(values)))) == {"colour": "LicensePlate", "dob": "Categorical"}
    monkeypatch.setenv("LINKWEAVE_NAME_RULES", str(names))
    monkeypatch.setenv("LINKWEAVE_VALUE_RULES", str(values))
    assert kinds(inference.infer_schema(d, {"colour": "Id"})) == {"colour": "Id", "dob": "Categorical"}
    values.write_text('[[rules]]\nkind = "Colour"\n')
    with pytest.raises(ValueError):
        inference.infer_schema(d)


def test_scenario_run(spark, tmp_path):
    """A small two-register scenario from files: everything planted is found, and the report has its fields."""
    s = scenarios.SCENARIOS["brp_sis/link"]
    assert s.dataset == "brp_sis_link" and [m.a_field for m in s.mappings] == scenarios.SHARED["sis"] and len(scenarios.full_size()) == 8
    assert [x.name for x in scenarios.throughput()] == ["brp/dedupe", "kvk/dedupe", "micro/brp/dedupe"] and len(scenarios.by_tag("sis")) == 2
    head = "voornamen,achternaam,geboortedatum,geboorteplaats,geboorteland,nationaliteit,geslacht"
    names = [(a, b) for a in ("Anna", "Pieter", "Maria", "Kees", "Femke") for b in ("Jansen", "Bakker", "Visser", "Mulder", "Peters", "Dekker")]
    person = lambda k: f"{names[k][0]},{names[k][1]},19{50 + k}-0{k % 9 + 1}-1{k % 7},Utrecht,NL,NL,{'MV'[k % 2]}"
    folder = tmp_path / "benchmarks/brp_sis/link"
    folder.mkdir(parents=True)
    (folder / "source_brp.csv").write_text("\n".join([f"record_id,{head},straatnaam", *(f"B{k},{person(k)},Kerkstraat" for k in range(30))]))
    (folder / "source_sis.csv").write_text("\n".join([f"record_id,{head},categorie", *(f"S{k},{person(k)},x" for k in range(20))]))
    (folder / "ground_truth.csv").write_text("\n".join(["record_id_a,record_id_b,is_match,match_type", *(f"B{k},S{k},true,{'even' if k % 2 == 0 else 'odd'}" for k in range(20))]))
    done, report = scenarios.run(spark, s, f"file://{tmp_path}")
    m = report["metrics"]
    assert (m["total_records"], m["true_pos"], m["false_pos"], m["false_neg"], m["f1"]) == (50, 20, 0, 0, 1.0) and list(m) == list(sinks.METRICS)
    assert [x["match_type"] for x in report["strat"]] == ["even", "odd"] and report["files"]["strat_csv"] == "brp_sis_link_strat.csv" and done.report.candidate_pairs >= 20


def test_comparison_of_summaries(spark, tmp_path):
    base = {c: "1" for c in sinks.SUMMARY}
    rows = [base | {"library": lib, "mode": mode, "dataset": ds, "f1": "0.98765"} for lib, mode, ds in (("b", "deduplicate", "brp_dedupe"), ("a", "dedupe", "brp_dedupe"), ("a", "link_only", "brp_link"))]
    for k, r in enumerate(rows):
        sinks.write_summary(spark.createDataFrame([r]), str(tmp_path / f"in/{k}_summary"))
    found = sinks.comparison(spark, str(tmp_path / "in"), "dedupe", "brp")
    assert [(r["library"], r["f1"]) for r in found.collect()] == [("a", "0.98765"), ("b", "0.98765")]
    assert sinks.comparison(spark, str(tmp_path / "in")).count() == 3
    path = sinks.write_comparison(found, str(tmp_path / "out"), "dedupe")
    assert path.endswith("comparison_dedupe_all") and spark.read.csv(path, header=True).columns == sinks.SUMMARY
    text = sinks.comparison_text(found)
    assert "0.988" in text and len(text.splitlines()) == 4
