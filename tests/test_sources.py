import json
import os

import pytest
from pyspark.sql import functions as F

from linkweave import storage
from linkweave.model import ConfigError, LinkMode, Schema
from linkweave.operators import judge as J
from linkweave.operators import judge_model as JM
from linkweave.plans.pipeline import Pipeline
from linkweave.sources import ingest, sinks
from linkweave.sources.store import EntityStore


def test_csv_keeps_blanks_as_empty_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("key,name,city\n1,Jan,\n2,,Delft\n")
    got = sorted((r["record_key"], r["source"], r["name"], r["city"]) for r in ingest.read_csv(spark, str(tmp_path / "a.csv"), "crm").collect())
    assert got == [("1", "crm", "Jan", ""), ("2", "crm", "", "Delft")]
    some = ingest.read_csv_columns(spark, str(tmp_path / "a.csv"), ["name", "phone"])
    assert sorted(map(tuple, some.collect())) == [("", ""), ("Jan", "")]


def test_missing_key_becomes_row_number(spark):
    d = spark.createDataFrame([(None, "a"), ("k", "b")], "k string, v string").coalesce(1)
    assert sorted(r["record_key"] for r in ingest.load_dataset(d, ingest.DatasetConfig("s", "k")).collect()) == ["0", "k"]
    assert ingest.load_dataset(d, ingest.DatasetConfig("s", "none")).select("record_key").distinct().count() == 2


def test_unsigned_numbers_survive(spark):
    d = spark.createDataFrame([("18446744073709551615",)], "x string")
    assert str(ingest.wide_unsigned(d, "x").first()["x"]) == "18446744073709551615"


def test_truth_is_canonical(spark):
    d = spark.createDataFrame([("b", "a", "Yes", "t"), ("a", "c", "0", "t"), ("a", "b", "1", "t")], "a string, b string, is_match string, match_type string")
    assert [tuple(r) for r in ingest.ground_truth(d).collect()] == [("a", "b", "t")]


def test_record_store(spark):
    store = ingest.RecordStore(spark.createDataFrame([(1, "x"), (2, "y")], "record_id long, v string"))
    store.insert(spark.createDataFrame([(1, "z")], "record_id long, v string"))
    assert store.len() == 3
    assert [r["v"] for r in store.get(spark.createDataFrame([(1,)], "record_id long")).collect()] == ["z"]


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.4)], "key_a string, key_b string, match_probability double")
    truth = spark.createDataFrame([("a", "b")], "key_a string, key_b string")
    sinks.write_scored_csv(pairs, truth, str(tmp_path / "scored"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "scored"), header=True).collect()] == [("0.9", "true"), ("0.4", "false")]
    sinks.write_pairs(pairs, str(tmp_path / "pairs"))
    assert spark.read.json(str(tmp_path / "pairs")).count() == 2
    for mode in ("dedupe", "link"):
        sinks.write_summary(spark.createDataFrame([("own", mode, "d")], "library string, mode string, dataset string"), str(tmp_path / "summary"))
    assert [r["mode"] for r in sinks.read_summaries(spark, str(tmp_path / "summary")).collect()] == ["dedupe", "link"]
    assert sinks.read_summaries(spark, str(tmp_path / "summary"), mode="link").columns == sinks.SUMMARY
    sinks.write_report({"b": 1}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"b": 1}
    assert sinks.format_unix(0) == "1970-01-01T00:00:00Z"


def test_store_versions_and_first_member_rule(spark):
    store = EntityStore(spark)
    kind = "entity long, record_id long, record_key string, score double, method string, source string"
    row = lambda e, r: (e, r, str(r), 0.9, "AutoMatch", None)
    store.upsert(spark.createDataFrame([row(1, 1), row(1, 2), row(5, 5), row(5, 6)], kind))
    ids = {r["entity"]: (r["entity_id"], r["created"]) for r in store.upsert(spark.createDataFrame([row(2, 2), row(2, 5), row(2, 9), row(10, 10), row(10, 11)], kind)).collect()}
    assert ids == {2: (1, False), 10: (3, True)}
    assert {r["record_id"]: r["entity_id"] for r in store.members().collect()} == {1: 1, 2: 1, 5: 2, 6: 2, 9: 1, 10: 3, 11: 3}
    assert sorted((r["event_type"], r["entity_id"], r["step"]) for r in store.events().collect()) == [("EntityCreated", 1, 1), ("EntityCreated", 2, 1), ("EntityCreated", 3, 2), ("RecordsAdded", 1, 2)]
    assert len(store.entities().where("entity_id = 1").first()["members"]) == 3


def test_model_judge_and_bands(spark):
    pairs = spark.createDataFrame([(1, 2, "good"), (1, 3, "bad"), (1, 4, "mid")], "a long, b long, pair_text string")
    judge = J.model_judge(lambda texts: [{"good": 0.9, "bad": 0.1, "mid": 0.5}[t] for t in texts])
    scored = pairs.select("a", "b", F.lit("Borderline").alias("band"), F.lit(0.5).alias("match_probability"))
    got = {r["b"]: (r["band"], r["resolution"]) for r in J.apply_verdicts(scored, judge(pairs)).collect()}
    assert got == {2: ("AutoMatch", "JudgePromoted"), 3: ("AutoReject", "JudgeDemoted"), 4: ("Borderline", None)}


def test_pipeline_needs_schema_and_store(spark):
    with pytest.raises(ConfigError):
        Pipeline(Schema.of(a="Name"))
    with pytest.raises(ConfigError):
        LinkMode.parse("other")
    empty = spark.createDataFrame([], "record_id long, record_key string, source string, a string")
    assert Pipeline(Schema.of(a="Name"), EntityStore(spark)).run_batch(empty).report.records_in == 0


def test_pipeline_with_judge_promotes(spark):
    d = spark.createDataFrame([(1, "1", "Jan", "1980-01-01"), (2, "2", "Jan", "1980-01-01"), (3, "3", "Piet", "1980-01-01")], "record_id long, record_key string, n string, d string")
    from linkweave.operators.blocking import CompositeBlocker
    from linkweave.operators.keys import DateFragment

    run = Pipeline(Schema.of(n="Categorical", d="Date"), EntityStore(spark), CompositeBlocker(DateFragment("d", 10)), judge=J.dummy_judge).run_batch(d)
    r = run.report
    assert r.candidate_pairs == 3 and r.auto_matched + r.borderline + r.auto_rejected == 3 and r.borderline == 0


def test_store_reopens_and_publishes_at_once(spark, monkeypatch):
    """A store on an existing folder has what was stored; members and events change together or not at all."""
    kind = "entity long, record_id long, record_key string, score double, method string, source string"
    df = lambda *rs: spark.createDataFrame([(e, r, str(r), 0.9, "AutoMatch", None) for e, r in rs], kind)
    store = EntityStore(spark)
    store.upsert(df((1, 1), (1, 2)))
    again = EntityStore(spark, store.path)
    assert again.members().count() == 2 and again.events().count() == 1
    again.upsert(df((2, 2), (2, 3), (7, 7), (7, 8)))
    want = {1: 1, 2: 1, 3: 1, 7: 2, 8: 2}
    assert {r["record_id"]: r["entity_id"] for r in EntityStore(spark, store.path).members().collect()} == want
    assert store.members().count() == 5 and store.events().count() == 3

    def fails(name, df):
        if name == "events":
            raise RuntimeError("lost")
        return write(name, df)

    write = again.versions.write
    monkeypatch.setattr(again.versions, "write", fails)
    with pytest.raises(RuntimeError):
        again.upsert(df((9, 9), (9, 10)))
    assert store.members().count() == 5 and store.events().count() == 3


def test_store_compacts_and_forgets_old_parts(spark):
    kind = "entity long, record_id long, record_key string, score double, method string, source string"
    store = EntityStore(spark)
    store.versions.COMPACT = 2
    for k in range(5):
        store.upsert(spark.createDataFrame([(k, 10 * k + j, "x", 0.9, "AutoMatch", None) for j in range(2)], kind))
    state = store.versions.state()
    assert store.members().count() == 10 and store.events().count() == 5 and all(len(p) <= 2 for p in state["parts"].values())
    folder = store.path.removeprefix("file://")
    assert len([f for f in os.listdir(folder) if f.startswith("state-")]) == 2 and len(os.listdir(f"{folder}/members")) <= 5
    assert {r["entity_id"] for r in store.members().collect()} == {1, 2, 3, 4, 5}


def test_shared_dir_on_a_cluster(monkeypatch):
    """Without a folder that all executors share, nothing may be written on a cluster."""
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    for master, ok in (("local[4]", True), ("local", True), ("yarn", False), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False)):
        s = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
        if ok:
            assert storage.shared_dir(s).startswith("file://")
        else:
            with pytest.raises(RuntimeError):
                storage.shared_dir(s)


def _field(number, value):
    """One protobuf field: a number, or bytes (texts and messages)."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def _tiny_model():
    """An ONNX model whose two logits are minus and plus the largest input id."""
    attribute = lambda name, i: _field(5, _field(1, name) + _field(3, i) + _field(20, 2))
    ints = lambda name, i: _field(5, _field(1, name) + _field(8, i) + _field(20, 7))
    node = lambda op, ins, out, *more: _field(1, b"".join(_field(1, x) for x in ins) + _field(2, out) + _field(4, op) + b"".join(more))
    value = lambda n, name, kind: _field(n, _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, _field(1, _field(2, b"n")) + _field(1, _field(2, name + b"_w"))))))
    nodes = [node(b"Cast", [b"input_ids"], b"f", attribute(b"to", 1)), node(b"ReduceMax", [b"f"], b"top", ints(b"axes", 1), attribute(b"keepdims", 1)), node(b"Neg", [b"top"], b"low"), node(b"Concat", [b"low", b"top"], b"logits", attribute(b"axis", 1))]
    graph = b"".join(nodes) + _field(2, b"g") + value(11, b"input_ids", 7) + value(12, b"logits", 1)
    return _field(1, 7) + _field(7, graph) + _field(8, _field(1, b"") + _field(2, 11))


def test_nli_judge(spark, tmp_path, monkeypatch):
    """A tiny model through the whole judge: id 0 everywhere says nothing, larger ids speak for a match."""
    import numpy as np
    import tokenizers

    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({"no": 0, "maybe": 0, "yes": 5, "[UNK]": 1}, "[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    folder = tmp_path / "nli-base/fp16_fused/nli-minilm-onnx"
    folder.mkdir(parents=True)
    t.save(str(folder / "tokenizer.json"))
    (folder / "model.onnx").write_bytes(_tiny_model())
    monkeypatch.setenv(JM.MODELS, str(tmp_path))
    spec = JM.choose(JM.models_folder(), 8 << 30)  # the larger model isn't there
    assert spec.name.endswith("MiniLM2-L6-H768") and spec.max_length == 512
    (tmp_path / "nli-base/fp16_fused/nli-deberta-v3-base-onnx").mkdir()
    assert JM.choose(JM.models_folder(), 8 << 30).memory == 2 << 30 and JM.choose(JM.models_folder(), 1 << 30).name == spec.name
    encoded = JM.tokenizer((folder / "tokenizer.json").read_bytes(), 3)(["yes", "no yes no no", ""])
    assert encoded["input_ids"].tolist() == [[5, 0, 0], [0, 5, 0], [0, 0, 0]] and encoded["attention_mask"].sum(1).tolist() == [1, 3, 0]
    pairs = spark.createDataFrame([(1, 2, "no yes"), (1, 3, "no no"), (1, 4, "yes")], "a long, b long, pair_text string")
    got = {r["b"]: r["verdict"] for r in JM.nli_judge(spec, batch=2)(pairs).collect()}
    assert got == {2: J.INCREASE, 3: J.NO_CHANGE, 4: J.INCREASE}
    score = JM.scorer(_tiny_model(), JM.tokenizer((folder / "tokenizer.json").read_bytes(), 3), 1)
    assert np.allclose(score(["yes", "no"]), [1 / (1 + np.exp(-10)), 0.5])
    with pytest.raises(JM.JudgeError):
        JM.nli_judge(JM.ModelSpec("x", "nowhere", "nowhere"))(pairs)


def test_load_frame(spark):
    """Tables in memory, pandas or Arrow: the same records, temporal cells as text, whole numbers as they are."""
    import datetime

    import pandas as pd
    import pyarrow as pa

    rows = {"k": ["a", None], "born": [datetime.date(1980, 2, 29), None], "at": [datetime.datetime(2024, 1, 2, 3, 4, 5), None], "n": [7, 8]}
    want = [("a", "1980-02-29", "2024-01-02T03:04:05", 7), ("1", None, None, 8)]

    class Other:
        def to_arrow(self):
            return pa.table(rows)

    for frame in (pa.table(rows), Other(), pd.DataFrame(rows)):
        got = ingest.load_frame(spark, frame, ingest.DatasetConfig("mem", "k")).coalesce(1).collect()
        assert {r["source"] for r in got} == {"mem"} and {r["n"] for r in got} == {7, 8}
        first = next(r for r in got if r["n"] == 7)
        assert (first["record_key"], first["born"], first["at"]) == want[0][:3]
