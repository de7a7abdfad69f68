"""Corpus operators on small tables of edge cases, against brute force or the library."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from linkweave.llm import common, op1_quality_classifier, op2_token_counts, op3_quality_rules, op4_suffix_dedup, op5_sentencepiece, op6_minhash, op7_pii, op8_fingerprints, op9_line_dedup, op10_mixing

random.seed(11)
VOCAB = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(random.choice(VOCAB) for _ in range(n))


SHARED = prose(120)
BASE = prose(200).split()


def near(k: int) -> str:
    w = list(BASE)
    for _ in range(k):
        w[random.randrange(len(w))] = random.choice(VOCAB)
    return " ".join(w)


TEXTS = [
    None, "", " ", "\n\n", "one", "two words", "Line A\n line a \nLINE A", "É é ﬁ x", "é É fi x", "▁lit  double  ▁▁ ", "日本語 текст 🙂 " * 3,
    prose(50) + " " + SHARED + " " + prose(40), prose(30) + " " + SHARED, SHARED, prose(3000), "the the the " * 60, "ab" * 900, "x\ty\x0bz\x0cq\r\nw",
    *(near(k) for k in (0, 0, 1, 2, 4, 8, 12, 16, 20, 25)), prose(20) + "\nshared line\n", *("Shared Line \n" + prose(12) for _ in range(12)), prose(80) + " " + prose(5) + " trailing ",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts above with extra columns whose names clash with outputs, a repeated row and a row without id."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t), 9, True, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[11], (None, prose(30), "en", "s0", 1, 9, True, "x"), (None, None, None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, kept boolean, component_id string")
    return common.stored(d, "docs", spark)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def all_rows(df):
    return [r.asDict() for r in df.collect()]


def by_id(df):
    return {r["doc_id"]: r for r in all_rows(df) if r["doc_id"] is not None}


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def labels(spark):
    return spark.createDataFrame([(11, 1, 0), (14, 1, 0), (15, 0, 0), (16, 0, 0), (15, 0, 0), (None, 1, 0), (12, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")


def test_op1_scores_every_row(spark, docs, empty):
    model = op1_quality_classifier.fit(docs, labels(spark))
    got = all_rows(op1_quality_classifier.score_only(docs, model))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = op1_quality_classifier.fit(empty, labels(spark))
    assert {r["score"] for r in all_rows(op1_quality_classifier.score_only(docs, none))} == {0.5}
    assert op1_quality_classifier.score_only(empty, model).count() == 0
    kept = op1_quality_classifier.score(docs.withColumn("score", F.lit("clash")), model)
    assert kept.columns[-1] == "score" and dict(kept.dtypes)["score"] == "double"


def test_op1_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op1_quality_classifier.query(spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(got) > 50 and np.mean([r[0] == r[1] for r in got]) >= 0.95


def test_op2_equals_library(spark, docs, empty):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows_of(docs))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in all_rows(op2_token_counts.count_tokens(docs)))
    assert got == want
    assert op2_token_counts.count_tokens(empty).count() == 0


def test_op3_equals_brute_force(docs, empty):
    def want(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(win)
        cover = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)

    ledger = op3_quality_rules.measure(docs)
    got = by_id(op3_quality_rules.apply_policy(ledger))
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want(t), i
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert op3_quality_rules.measure(empty).count() == 0


def test_op3_ablation_equals_reapplied_policies(docs):
    ledger = op3_quality_rules.measure(docs)
    masks = [r["failed"] for r in ledger.collect()]
    for r in op3_quality_rules.ablate(ledger).collect():
        mask = op3_quality_rules.POLICIES[r["policy"]] & ~op3_quality_rules.BIT.get(r["without"], 0)
        assert (r["n_docs"], r["n_kept"]) == (len(masks), sum(m & mask == 0 for m in masks))


def test_op3_stored_ledger_reads_no_text_again(spark):
    path = common.fresh_path(spark, "op3")
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(path)
    ledger = op3_quality_rules.stored_ledger(spark.read.parquet(path))
    for df in (ledger, op3_quality_rules.apply_policy(ledger, "base"), op3_quality_rules.ablate(ledger)):
        assert df.inputFiles() and not any(path.split("/")[-1] in f for f in df.inputFiles())
    assert op3_quality_rules.apply_policy(ledger).count() == len(TEXTS)


def brute4(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group, batches", [(4096, 1), (1, 2), (4096, 5)])
def test_op4_equals_brute_force(docs, empty, monkeypatch, group, batches):
    monkeypatch.setattr(op4_suffix_dedup, "GROUP", group)
    rows = rows_of(docs)
    got = all_rows(op4_suffix_dedup.remove_repeats(docs, batches=batches))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute4([t for _, t in rows], 400))), key=key)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got), key=key) == want
    assert op4_suffix_dedup.remove_repeats(empty).count() == 0


def test_op4_blocks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(op4_suffix_dedup, "BLOCK", 700)
    passage = prose(400)
    texts = [prose(300) + passage, passage + prose(200), prose(500)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(op4_suffix_dedup.remove_repeats(d, kept_bytes=True))
    for i, x in enumerate(brute4(texts, 400)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], len(got[i]["spans"]), got[i]["kept_sha256"]) == x
        assert hashlib.sha256(got[i]["kept"]).hexdigest() == x[3]


def test_op5_equals_library_and_decodes(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=op2_token_counts.model_bytes())
    out = op5_sentencepiece.encode(docs)
    got = by_id(out)
    for i, t in enumerate(TEXTS):
        assert got[i]["ids"] == sp.encode(t or "") and got[i]["round_trip"] and got[i]["n_tokens"] == len(got[i]["ids"]), i
    assert out.count() == docs.count()
    back = by_id(op5_sentencepiece.decode(out))
    assert all(back[i]["decoded"] == (t or "").replace("▁", " ") for i, t in enumerate(TEXTS))
    assert op5_sentencepiece.encode(empty).count() == 0


def test_op5_spells_fragments_together(monkeypatch):
    """All fragments of a chunk at once, in slices; those with a character that is no piece stay apart."""
    monkeypatch.setattr(op5_sentencepiece, "FRAGMENTS", 2)
    found = pa.table({"word": ["▁añb", "ab", "▁x💡", "▁", "▁▁a"], "borders": [0b11001, 0b101, 0b1111, 0b11, 0b1101]})
    number = {"▁añ": 7, "b": 8, "ab": 9, "▁": 4, "x": 5, "▁▁": 6, "a": 3}
    first, rest = op5_sentencepiece.spelled(found.slice(0), number)
    ids = {k: np.frombuffer(v, np.int32).tolist() for k, v in first.items()}
    assert ids == {"añb": [7, 8], op5_sentencepiece.BARE + "ab": [9], "": [4], " a": [6, 3]}
    assert rest == {"▁x💡": 0b1111}
    assert op5_sentencepiece.spelled(found.slice(0, 0), number) == ({}, {})


def test_op5_cuts_texts_without_jvm_expressions(spark):
    """Words and fragments are cut out of whole texts by one Arrow function, not by expressions that take a text apart several times."""
    d = spark.createDataFrame([(1, "some words of a text, words")], "doc_id long, text string")
    plan = op5_sentencepiece.encode(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "array_distinct" not in plan and "MapInArrow" in plan


def test_op5_viterbi_equals_library(spark):
    """The same pieces as a unigram model: least cost over the lattice."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(op2_token_counts.model_bytes())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1:
            p.score = -8 - p.score / -4000 if p.score > -1e8 else -30
    model = proto.SerializeToString()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    words = ["▁" + w for w in VOCAB[:60]] + ["▁international", "▁xyzzy", "▁a"]
    d = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: op5_sentencepiece.pieces_of(r["word"], r["borders"]) for r in op5_sentencepiece.fold(op5_sentencepiece.lattice(d, model, []), False, []).collect()}
    score = {p.piece: p.score for p in proto.pieces}
    total = lambda ps: sum(score[p] for p in ps)
    assert set(got) == set(words)
    assert all(total(got[w]) >= total(sp.encode(w[1:], out_type=str)) - 1e-3 for w in words)


def sets_of(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80), (3, 60)])
def test_op6_equals_brute_force(docs, empty, n, percent):
    texts, sets = TEXTS, sets_of(TEXTS, n)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = op6_minhash.near_duplicates(docs, n, percent)
    got = by_id(out)
    assert {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))} == {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()}
    assert out.count() == docs.count()
    assert all(r["component_id"] is None and r["kept"] for r in all_rows(out) if r["doc_id"] is None)
    assert op6_minhash.near_duplicates(empty, n, percent).count() == 0


def test_op6_second_round_finds_links_past_the_center(spark):
    """A chain whose ends are unlike: the star finds some links, the blocks the rest."""
    w, texts = [f"w{i}" for i in range(300)], []
    for step in range(12):
        texts.append(" ".join(w[step * 12 : step * 12 + 150]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in all_rows(op6_minhash.near_duplicates(d, 3, 80))} == {0}


def test_op6_texts_of_a_shared_id(spark):
    """Every text of an id counts, whichever comes first: by brute force over all combinations."""
    base = [prose(60) for _ in range(4)]
    edited = lambda t: " ".join(t.split()[:-1] + ["other"])
    rows = [(1, "aa " + base[0]), (1, "zz " + base[1]), (2, edited("zz " + base[1])), (3, "aa " + base[2]), (3, "zz " + base[3]), (4, "ab " + prose(60)), (4, edited("zz " + base[3])), (4, None), (5, prose(60))]
    sets, root = sets_of([t for _, t in rows], 3), {i: i for i, _ in rows}
    for (i, _), x in zip(rows, sets):
        for (j, _), y in zip(rows, sets):
            if i < j and 100 * len(x & y) >= 80 * max(1, len(x | y)):
                root[j] = min(root[i], root[j])
    assert root == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    got = all_rows(op6_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80))
    assert len(got) == len(rows) and all(r["component_id"] == root[r["doc_id"]] for r in got if r["n_shingles"])


PII = {
    "he.19@mail5.example.com": "email", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff": "secret", "152.143.123.131": "ip", "+1 (706) 555-3138": "phone",
    "NL91 ABNA 0417 1643 00": "iban", "4644348398010899": "card", "4111-1111-1111-1111": "card", "123-45-6789": "ssn", "2024-02-29": "date", "31/12/1999": "date",
}
CLEAN = ["999.1.1.1", "4111111111111112", "000-12-3456", "29.02.2023", "plain words", "\x01\x02\x03 7", "", "version 12 of 2024"]


def test_op7_pseudonyms(spark, empty):
    texts = [f"a {p}. b {p}" for p in PII] + [f"other {p}" for p in PII] + CLEAN + [None]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, kinds string")
    got = by_id(op7_pii.pseudonymise(d))
    shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "9", s))
    for i, (p, kind) in enumerate(PII.items()):
        new = got[i]["text"]
        assert p not in new and got[i]["kinds"] == kind and got[i]["n_replaced"] == 2, (p, new)
        first = re.fullmatch(r"a (.*)\. b (.*)", new)
        assert first[1] == first[2] == got[i + len(PII)]["text"][6:]
        if kind not in ("ip", "secret"):
            assert shape(first[1]) == shape(p)
    for k, t in enumerate([*CLEAN, None]):
        assert got[2 * len(PII) + k]["text"] == t and got[2 * len(PII) + k]["n_replaced"] == 0
    assert op7_pii.pseudonymise(empty).count() == 0


def test_op7_neighbours(spark):
    """Values of each pair of kinds with one blank between are both replaced, each as it is alone."""
    more = ["BE68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32", "4111 1111 1111 1111", "3782 822463 10005", "+33 1 23 45 67 89", "+49 30 12345678", "+1 706 555 3138", "(706) 555-3138", "706-555-3138", "19.he@mail.example.com", "12.05.2020"]
    values = [*PII, *more]
    pairs = [(p, q) for p in values for q in values]
    texts = values + [f"{p} {q}" for p, q in pairs] + ["+1 (826) 555-4081 190.137.223.204 du anviou", "+49 30 12345678-0", "+44 900-45-6789"]
    got = by_id(op7_pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    alone = {p: got[i]["text"] for i, p in enumerate(values)}
    assert all(got[i]["n_replaced"] == 1 and alone[p] != p for i, p in enumerate(values))
    for i, (p, q) in enumerate(pairs, len(values)):
        assert got[i]["text"] == f"{alone[p]} {alone[q]}" and got[i]["n_replaced"] == 2, (p, q, got[i]["text"])
    last = [got[i] for i in range(len(texts) - 3, len(texts))]
    assert last[0]["kinds"] == "ip,phone" and last[0]["n_replaced"] == 2 and "223.204" not in last[0]["text"]
    assert all(r["kinds"] == "phone" and r["n_replaced"] == 1 for r in last[1:])


def test_op7_network_permutes(spark):
    """Every two-digit text, and every date of the years in question, has its own pseudonym."""
    two = spark.range(100).select(op7_pii.feistel(F.lpad(F.col("id").cast("string"), 2, "0"), 10, "t", "k").alias("x"))
    assert len({r["x"] for r in two.collect()}) == 100
    odd = spark.range(1000).select(op7_pii.feistel(F.lpad(F.col("id").cast("string"), 3, "0"), 10, "t", "k").alias("x"))
    assert len({r["x"] for r in odd.collect()}) == 1000
    small = spark.range(37).select(op7_pii.walked(F.lpad(F.col("id").cast("string"), 2, "0"), 10, "t", "k", lambda s: s.cast("int") < 37).alias("x"))
    assert sorted(int(r["x"]) for r in small.collect()) == list(range(37))


def test_op8_equals_brute_force(spark, docs, empty):
    rows = sorted(((i, t or "") for i, t in rows_of(docs)), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    seeds = lambda t: f"{xxhash.xxh64_intdigest(t.encode(), 42):016x}{xxhash.xxh64_intdigest(t.encode(), xxhash.xxh64_intdigest(b'linkweave', 42)):016x}"
    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), seeds(fold(t)), seeds(fold(edited)), float(fold(t) == fold(edited)), float(fold(t) == fold(nxt))))
    least = {}
    for i, t in rows:
        if i is not None:
            least[fold(t)] = min(i, least.get(fold(t), i))
    want = [(*w, least.get(fold(t), w[0])) for w, (_, t) in zip(want, rows)]  # and the group
    path = common.fresh_path(spark, "op8")
    docs.write.parquet(f"{path}/documents.parquet")
    got = [tuple(r) for r in op8_fingerprints.query(spark, path).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert op8_fingerprints.with_next(empty).count() == 0


def test_op8_groups_by_canonical_form(docs):
    got = by_id(op8_fingerprints.exact_groups(docs))
    assert got[7]["group_id"] == got[8]["group_id"] == 7 and got[0]["group_id"] == got[3]["group_id"] == 0 and got[4]["group_id"] == 4


@pytest.mark.parametrize("batches", [1, 3])
def test_op9_equals_brute_force(docs, empty, batches):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    rows = rows_of(docs)
    count = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = op9_line_dedup.dedup_lines(docs, op9_line_dedup.build(docs, batches))
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (key(x) and count[key(x)] >= 10)]
        want.append((-1 if i is None else i, len(lines) - len(keep), "\n".join(keep)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["lines_dropped"], r["text"] or "") for r in all_rows(out)) == sorted(want)
    assert any(w[1] for w in want)
    assert set(docs.columns) <= set(out.columns)
    assert op9_line_dedup.dedup_lines(empty, op9_line_dedup.build(empty, batches)).count() == 0


def test_op9_levels_merge(docs):
    index = op9_line_dedup.build(docs, 5)
    assert sorted(index.levels) == [0, 2]


def test_op10_draws(spark, docs, empty):
    big = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("source"))
    got = op10_mixing.mix(big, {"rare": 0.5, "common": 0.5}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert n["rare"] == pytest.approx(10000, rel=0.05) and n["common"] == pytest.approx(10000, rel=0.05)
    one = op10_mixing.mix(big, {"rare": 1.0}, epochs=50.0)  # a mean above PART: several draws
    assert one.count() == pytest.approx(1_000_000, rel=0.01) and one.where("source = 'common'").count() == 0
    again = [tuple(r) for r in op10_mixing.mix(docs).select("doc_id", "copy", "shuffle_key").collect()]
    assert again == [tuple(r) for r in op10_mixing.mix(docs).select("doc_id", "copy", "shuffle_key").collect()]
    assert [k for _, _, k in again] == sorted(k for _, _, k in again)
    assert op10_mixing.mix(empty).count() == 0


def test_pipeline_stages_on_small_tables(spark, docs, tmp_path):
    sf = common.fresh_path(spark, "pipeline")
    labels(spark).write.parquet(f"{sf}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    lined = corpus_pipeline.lines(spark, plain, sf)
    assert lined.columns == plain.columns and lined.where("n_chars <> length(text)").count() == 0
    one = common.stored(corpus_pipeline.near_duplicates(spark, plain, sf), "one", spark)
    got = [r["doc_id"] for r in one.collect() if r["doc_id"] is not None]
    whole = by_id(op6_minhash.near_duplicates(plain, 5, 80))
    assert sorted(got) == sorted(i for i, r in whole.items() if r["kept"])
    assert corpus_pipeline.mixing(spark, plain, sf).columns == plain.columns
    assert corpus_pipeline.quality(spark, plain, sf).columns == plain.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.where("false"), sf).count() == 0


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    """Rows of one id are dropped only as near duplicates, and always the same ones, however they are dealt."""
    base = [prose(60) for _ in range(4)]
    rows = [(1, base[0], "b"), (1, base[0], "a"), (1, base[1], "c"), (1, None, "d"), (2, base[1] + " more", "e"), (3, base[2], "f"), (3, base[2] + " more", "g"), (4, base[3], "h"), (None, base[3], "i")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {(1, base[0], "a"), (1, None, "d"), (2, base[1] + " more", "e"), (3, base[2], "f"), (4, base[3], "h"), (None, base[3], "i")}
    for n in (1, 3):
        got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, d.repartition(n), "").collect()]
        assert set(got) == want and len(got) == len(want)
    unlike = spark.createDataFrame([(7, t, "x") for t in base], "doc_id long, text string, source string")
    assert corpus_pipeline.near_duplicates(spark, unlike, "").count() == 4


def test_op4_batches_are_scanned_against_the_levels(spark):
    """Six batches: each scan returns the matches of its own batch; the spans so far equal brute force after every batch."""
    passage, other = prose(150), prose(150)
    texts = [prose(20) + passage + prose(30), prose(300), passage[7:] + prose(9), other + prose(20), prose(15) + other[5:-5] + passage, prose(200)]
    index, seen = op4_suffix_dedup.SuffixIndex(spark), []
    for k, t in enumerate(texts):
        found = index.add(spark.createDataFrame([(k, t)], "doc_id long, text string"))
        assert (found.count() > 0) == (k in (2, 4)), k
        seen.append((k, t))
        spans = index.repeated(spark.createDataFrame(seen, "doc_id long, text string")).collect()
        assert bool(spans) == (sum(x[1] for x in brute4([t for _, t in seen], 400)) > 0)
    assert sorted(index.levels) == [0, 2] and index.newest is not None and len(index.members) == 6
    got = by_id(op4_suffix_dedup.remove_repeats(spark.createDataFrame(seen, "doc_id long, text string"), batches=6))
    assert [(got[i]["n_bytes"], got[i]["n_removed"], len(got[i]["spans"]), got[i]["kept_sha256"]) for i in range(6)] == brute4(texts, 400)


def test_op8_collisions_split_and_heavy_groups(spark, monkeypatch):
    """With a digest of one value for all texts, groups are still those of equal forms; and with any number of heavy groups."""
    texts = ["a b", "A  b", "c", "c", "d", None, "", "e"]
    d = spark.createDataFrame([*enumerate(texts), (None, "c")], "doc_id long, text string")
    want = {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5, 7: 7, None: 2}
    for heavy in (1, 4, 1000):
        monkeypatch.setattr(op8_fingerprints, "HEAVY", heavy)
        assert {r["doc_id"]: r["group_id"] for r in op8_fingerprints.exact_groups(d).collect()} == want
    monkeypatch.setattr(op8_fingerprints, "digest", lambda canon: F.concat(F.lit("same"), F.substring(canon, 1, 0)))
    assert {r["doc_id"]: r["group_id"] for r in op8_fingerprints.exact_groups(d).collect()} == want


def test_op9_batches_meet_the_runs(spark):
    """A line settles with the batch that brings it to min_docs documents, is then counted no more, and goes from the runs."""
    index = op9_line_dedup.LineIndex(spark, min_docs=4)
    batch = lambda ids, line: spark.createDataFrame([(i, f"{line}\nown {i}") for i in ids], "doc_id long, text string")
    settled = []
    for ids, line in (([1, 2, 3], "one"), ([4], "one"), ([5, 6], "one"), ([7, 8], "two"), ([9, 10], "two")):
        index.add(batch(ids, line))
        settled.append(index.frequent().count())
    assert settled == [0, 1, 1, 1, 2] and sorted(index.levels) == [0, 2]
    assert index.levels[2].count() == 8 + 1 and index.levels[0].count() == 2  # own lines, and "two" until the next compaction


def score_by_hand(model, text):
    """The score from the definition: the mean weight of all features, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    names = [x for w in words for x in (f"<{w}>", *(f"<{w}>"[i : i + n] for n in (3, 4) if n < len(w) + 2 for i in range(len(w) + 3 - n)))]
    buckets = [zlib.crc32(x.encode("utf-8", "replace")) % (1 << 17) for x in names] + [zlib.crc32(b"\x00repeat") % (1 << 17)] * sum(a == b for a, b in zip(words, words[1:]))
    z = model.bias + (sum(float(model.weight[b]) for b in buckets) / len(buckets) if buckets else 0.0)
    return 1 / (1 + math.exp(-z))


def test_op1_scores_equal_brute_force(spark, docs):
    model = op1_quality_classifier.fit(docs, labels(spark))
    got = {(r["doc_id"], r["score"]) for r in op1_quality_classifier.score_only(docs, model).collect()}
    for i, t in rows_of(docs):
        assert any(j == i and s == pytest.approx(score_by_hand(model, t), abs=1e-6) for j, s in got), i
    prior = {s for i, s in got if i in (0, 1, 2, 3)}
    assert len(prior) == 1 and prior.pop() == pytest.approx(1 / (1 + math.exp(-model.bias)))


def test_op1_fit_takes_each_id_once(spark, docs):
    """Repeated labels count by the largest, repeated documents once; held-out rows and unusable labels teach nothing."""
    more = labels(spark).unionByName(spark.createDataFrame([(11, 0, 0), (11, 1, 0), (14, 0, 0)], "doc_id long, quality int, toxic int"))
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    more = more.unionByName(spark.createDataFrame([(i, 0, 0) for i in held], "doc_id long, quality int, toxic int"))
    a, b = (op1_quality_classifier.fit(docs, x) for x in (labels(spark).where("doc_id NOT IN (%s)" % ", ".join(map(str, held))), more))
    assert a.bias == b.bias and np.array_equal(a.weight, b.weight)
    small = op1_quality_classifier.fit(docs, more, max_train=1)
    assert small.bias != a.bias


def test_op2_limit(spark):
    n = op2_token_counts.LIMIT
    d = spark.createDataFrame([(k, " ".join(["the"] * m)) for k, m in enumerate((n - 1, n, n + 1))], "doc_id long, text string")
    got = by_id(op2_token_counts.count_tokens(d))
    assert [(got[k]["n_tokens"], got[k]["over_limit"]) for k in range(3)] == [(n - 1, False), (n, False), (n + 1, True)]


def test_op3_values_at_the_limits(spark):
    """One more or less on each side of every rule's limit; repeated rows and rows without an id each keep theirs."""
    again = "a b c d e f a b c d e"  # ten words in repeated windows

    def fails(text, rule):
        row = op3_quality_rules.measure(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")).collect()
        assert len(row) == 3 and len({r["failed"] for r in row}) == 1
        return bool(row[0]["failed"] & op3_quality_rules.BIT[rule])

    words = lambda n: " ".join(f"w{i}x" for i in range(n))
    assert fails(words(9), "few_words") and not fails(words(10), "few_words")
    assert not fails(again + " " + words(39), "repeated_words") and fails(again + " " + words(38), "repeated_words")
    assert not fails(words(9) + " ###", "symbols") and fails(words(9) + " ####", "symbols")
    assert not fails("\n".join([words(5)] * 4 + [f"line {i}" for i in range(6)]), "repeated_lines") and fails("\n".join([words(5)] * 5 + [f"line {i}" for i in range(6)]), "repeated_lines")
    assert not fails("x" * 50, "word_length") and fails("x" * 51, "word_length") and not fails("ab a", "word_length") and fails("ab a a", "word_length")
    assert not fails("ABCDEFabcd", "capitals") and fails("ABCDEFGabc", "capitals")


def feistel_by_hand(s, radix, tweak, key):
    """The network from its description, in Python."""
    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(1, 11):
        f = int(hashlib.sha256("|".join([key, tweak, str(i), str(len(a)), b]).encode()).hexdigest()[:15], 16)
        c, out = (int(a or "0", radix) + f) % radix ** len(a), ""
        while len(out) < len(a):
            out, c = "0123456789ABCDEFGHIJKLMNOP"[c % radix] + out, c // radix
        a, b = b, out
    return a + b


def test_op7_network_equals_python(spark):
    rng = random.Random(3)
    for radix, digits in ((10, "0123456789"), (16, "0123456789ABCDEF"), (26, "0123456789ABCDEFGHIJKLMNOP")):
        texts = ["".join(rng.choice(digits) for _ in range(rng.randint(1, 12))) for _ in range(60)]
        d = spark.createDataFrame([(x,) for x in texts], "s string").withColumn("y", op7_pii.feistel(F.col("s"), radix, "kind", "secret"))
        assert all(r["y"] == feistel_by_hand(r["s"], radix, "kind", "secret") for r in d.collect())
    ok = lambda s: not re.match("000|666|9", s) and s[3:5] != "00" and s[5:] != "0000"
    new = feistel_by_hand("123456789", 10, "ssn", "k")
    while not ok(new):
        new = feistel_by_hand(new, 10, "ssn", "k")
    got = op7_pii.pseudonymise(spark.createDataFrame([("no 123-45-6789.",)], "text string"), "k").first()
    assert got["text"] == f"no {new[:3]}-{new[3:5]}-{new[5:]}." and got["n_replaced"] == 1


def test_op7_keys_repeats_and_long_texts(spark):
    text = "id 123-45-6789 on 2024-02-29, " + "x" * 300_000 + " end 4644348398010899"
    d = spark.createDataFrame([(1, text, 7), (1, text, 7)], "doc_id long, text string, n_replaced int")
    a, b, c = ([r.asDict() for r in op7_pii.pseudonymise(d, k).collect()] for k in ("k1", "k2", None))
    assert a[0] == a[1] and a[0]["n_replaced"] == 3 and len(a[0]["text"]) == len(text)
    assert len({x[0]["text"] for x in (a, b, c)}) == 3  # another key, another pseudonym; without one a key of the process
    assert op7_pii.pseudonymise(d).first()["text"] == c[0]["text"]
    never = spark.range(1).select(op7_pii.walked(F.lit("12"), 10, "t", "k", lambda s: F.lit(False)).alias("x")).first()["x"]
    assert never is None


def test_op9_texts_of_a_shared_id(spark):
    """Different texts under one id are documents of their own, each with its lines."""
    rows = [(1, "same\nfirst"), (1, "second\nsame"), *((k, f"same\nx{k}") for k in range(2, 10))]
    index = op9_line_dedup.build(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"], r["text"]) for r in op9_line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), index).collect())
    assert got == sorted((i, "\n".join(x for x in t.split("\n") if x != "same")) for i, t in rows)


def copies_by_hand(rows, seed="mix-1"):
    """doc_id and n_copies by Poisson draws at each source's rate, for rows (doc_id, text, source)."""
    units = collections.Counter()
    for _, t, s in rows:
        units[s] += len(t or "") + 1
    weight, every = {s: u**0.5 for s, u in units.items()}, sum(units.values())
    out = []
    for i, t, s in rows:
        rate = weight[s] / sum(weight.values()) * every / units[s]
        u = int(hashlib.md5(f"{seed}/1/{i}".encode()).hexdigest()[:15], 16) / float(1 << 60)
        p = c = math.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out += [(i, t)] * k
    return out


def test_pipeline_equals_brute_force(spark):
    """run() on small tables against plain Python, stage by stage."""
    import sentencepiece

    rng = random.Random(8)
    junk = lambda: " ".join(rng.choice(["###", "%%", "zz!!", "buy", "$$$"]) for _ in range(40))
    texts = [prose(60) + "\nshared footer\n" + prose(20) if k % 2 else prose(70) + f"\nline {k}" for k in range(40)] + [junk() for _ in range(20)]
    texts += [texts[3], texts[5] + " more", "Shared Footer", None, ""]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    sf = common.fresh_path(spark, "pipeline")
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{sf}/documents.parquet")
    lab = spark.createDataFrame([(k, int(k < 40), 0) for k in range(60) if k % 3], "doc_id long, quality int, toxic int")
    lab.write.parquet(f"{sf}/labels.parquet")

    model = op1_quality_classifier.fit(d, lab)
    docs = [(i, t, s) for i, t, _, s, _ in rows if score_by_hand(model, t) >= 0.7]
    assert {i for i, _, _ in docs} >= set(range(40)) and not {i for i, _, _ in docs} & set(range(40, 60))
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    count = collections.Counter(k for _, t, _ in docs for k in {key(x) for x in (t or "").split("\n")})
    # texts that lose nothing stay as they are, null included
    docs = [(i, "\n".join(x for x in t.split("\n") if not (key(x) and count[key(x)] >= 10)) if t else t, s) for i, t, s in docs]
    assert any("footer" in (texts[i] or "").lower() and "footer" not in (t or "").lower() for i, t, _ in docs)
    sets, gone = sets_of([t for _, t, _ in docs], 5), set()
    for x in range(len(docs)):  # no chains among these texts, so the smaller of a pair stays
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                gone.add(x)
    docs = [r for x, r in enumerate(docs) if x not in gone]
    assert len(gone) >= 2
    sp = sentencepiece.SentencePieceProcessor(model_proto=op2_token_counts.model_bytes())
    want = sorted((i, tuple(sp.encode(t or ""))) for i, t in copies_by_hand(docs))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got) == want and all(r["n_tokens"] == len(r["ids"]) and r["round_trip"] for r in got)


def test_pipeline_keeps_the_order_of_the_mixing(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL")
    mixed = common.stored(corpus_pipeline.mixing(spark, plain, "").coalesce(1), "mixed", spark)
    assert [r["doc_id"] for r in corpus_pipeline.encoding(spark, mixed, "").collect()] == [r["doc_id"] for r in mixed.collect()]


def test_op4_query_returns_what_is_left(spark):
    """The query's texts are the remaining bytes; a cut inside a character leaves a replacement character."""
    passage = "é" * 300
    texts = ["x" + passage + "y", passage[:-1] + "z", None, "", "short"]
    path = common.fresh_path(spark, "op4")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = by_id(op4_suffix_dedup.query(spark, path))
    assert list(got[0]) == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    for i, x in enumerate(brute4(texts, 400)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == x
        if "\ufffd" not in got[i]["text"]:
            assert hashlib.sha256(got[i]["text"].encode()).hexdigest() == x[3]
    assert (got[2]["text"], got[3]["text"], got[4]["text"]) == ("", "", "short") and got[0]["text"].startswith("x") and got[1]["text"].endswith("z")


def test_op6_broadcasts_nothing_but_a_bitmap(spark, monkeypatch):
    """The driver's memory doesn't depend on the rows: no table of buckets or requests goes through it."""
    rng, seen, plain = random.Random(6), [], F.broadcast
    groups = [[rng.choice(VOCAB) for _ in range(60)] for _ in range(40)]
    rows = [(100 * g + k, " ".join([*w[:-1], f"x{k}"])) for g, w in enumerate(groups) for k in range(3)]
    monkeypatch.setattr(op6_minhash.F, "broadcast", lambda d: seen.append((d.columns, d.count())) or plain(d))
    got = by_id(op6_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))
    assert {i: r["component_id"] for i, r in got.items()} == {i: i - i % 100 for i, _ in rows}
    assert seen and all(columns == ["page", "bitmap"] and n <= op6_minhash.SLOTS // op6_minhash.PAGE for columns, n in seen)


@pytest.mark.parametrize("limit", [op4_suffix_dedup.CELL, 1200])
def test_op4_large_groups_are_packed(spark, monkeypatch, limit):
    """A segment of a large group is one row a cell, not one a window; windows in different cells give the same runs."""
    monkeypatch.setattr(op4_suffix_dedup, "GROUP", 2)
    monkeypatch.setattr(op4_suffix_dedup, "CELL", limit)
    passage, counted, plain = prose(110), [], op4_suffix_dedup.meet
    texts = [prose(40 + i) + passage + prose(50) for i in range(12)]

    def meet(rows):
        counted.append((rows.count(), rows.select("kh", "sh").distinct().count(), rows.select(F.sum(F.size("xs"))).first()[0]))
        return plain(rows)

    monkeypatch.setattr(op4_suffix_dedup, "meet", meet)
    got = by_id(op4_suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, x in enumerate(brute4(texts, 400)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], len(got[i]["spans"]), got[i]["kept_sha256"]) == x
    rows, segs, hashes = counted[0]
    assert rows == segs if limit > 1200 else rows > segs
    assert segs >= 12 and hashes > 5 * segs


def test_op6_tables_that_grow_are_never_broadcast(spark, monkeypatch):
    """Joins of small tables too are shuffles: at another size the same tables would fill the driver."""
    from linkweave import storage
    from linkweave.operators import graph

    rng, plans, plain = random.Random(7), [], storage.stored
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(9)) for _ in range(60))) for i in range(40)]
    rows += [(100 + i, t + " more") for i, t in rows]

    def kept(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(storage, "stored", kept)
    monkeypatch.setattr(graph, "stored", kept)
    out = op6_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    broadcast = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert len(plans) > 10 and all("page#" in line for line in broadcast)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {i + k: i for i in range(40) for k in (0, 100)}
