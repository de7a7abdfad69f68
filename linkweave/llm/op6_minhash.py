"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct word shingles as 64-bit hashes. Documents of equal sets are one class; its smallest doc_id
stands for it. A class has 128 minima: 32 bands of 4 rows give the bands' keys, and the low 4 bits of each minimum are kept, packed into 8
longs. Classes that share a band key are candidates. The similarity of candidates is estimated from the bits (equal nibbles, less
the 1 in 16 that agree by chance); what is estimated far below the threshold goes, all others are confirmed on the full sets.

No bucket is expanded into all its pairs, and none is capped. First each member is compared with its bucket's smallest
member (a star); components of the confirmed links follow. Buckets that still hold several components are tied into groups, and each group is
cut into blocks of bounded size. Every block meets all members outside the group's main component, its guests, in chunks of bounded size: first by
the packed bits alone, then, those that come near enough to one of the block, by their exact intersections with the whole block, counted at once
over the block's inverted index. Only confirmed links come out, at most one for a member and a component. Pairs inside one component
can't change the result.

At similarity 0.85 a pair shares no band with probability 6e-11, at 0.8 with 5e-8. Texts that are null, empty or blank have an empty set and are
linked with nothing. Rows that share a doc_id are one document with the links of each; rows without a doc_id have component_id null, are
kept, and link nothing. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import shuffled
from . import common

BANDS, ROWS, SEED = 32, 4, 20
PERMS = BANDS * ROWS
#: Pairs whose estimated similarity is lower than the threshold by more than this (over 6 standard errors) are not confirmed.
SLACK = 0.2
#: Shingles of the members in one block; members in one block, and guests that meet a block in one task.
BLOCK, MEMBERS = 1_000_000, 512
#: Slots of the bitmap that keeps texts nobody asks for out of a shuffle, and slots in one of its pages: 1 MB in all, the only thing broadcast.
SLOTS, PAGE = 1 << 23, 1 << 15
MAX_WORDS = 400_000
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_rng = np.random.default_rng(SEED)
XORS = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2)
FACTORS = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles (of all its words, if there are fewer)."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z fold, only ASCII blanks split
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(w))
    acc = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        acc = mixed(acc * ONE + w[k : len(w) - n + 1 + k])
    return np.unique(mixed(acc + TWO))


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):
        np.minimum(out, ((s[at : at + 512, None] ^ XORS) * FACTORS).min(0), out)
    return out


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, c1, c2 (128-bit hash of the set), bands (array of longs), bits (8 longs); one pass, no shuffle."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            size, c1, c2, bands, bits = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, n, hashes)
                size.append(len(s))
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                c1.append((d >> 65))
                c2.append(d & ((1 << 63) - 1))
                m = mixed(minima(s)) if len(s) else np.zeros(PERMS, np.uint64)
                acc = np.zeros(BANDS, np.uint64)
                for r in range(ROWS):
                    acc = mixed(acc * ONE + m[r::ROWS])
                bands.append(acc.view(np.int64))
                nib = (m & np.uint64(15)).reshape(8, 16) << np.arange(0, 64, 4, dtype=np.uint64)
                bits.append(np.bitwise_or.reduce(nib, 1).view(np.int64))
            pack = lambda xs, k: pa.ListArray.from_arrays(pa.array(np.arange(len(xs) + 1, dtype=np.int32) * k), pa.array(np.concatenate(xs) if xs else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pack(bands, BANDS), pack(bits, 8)], names=["doc_id", "n_shingles", "c1", "c2", "bands", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>, bits array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from packed nibbles: the share of equal ones, corrected for agreement by chance."""
    equal = F.lit(0)
    for k in range(8):
        x = F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        equal = equal + (16 - F.bit_count(x))
    return (equal / PERMS - 1 / 16) / (1 - 1 / 16)


def texts_for(asked: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """A stored table of requests by key, a doc_id, with the texts.

    The join is a shuffle, so the driver's memory is the same for any number of requests. A bitmap of the ids' hashes lets
    through what is asked for and, by chance, some other texts, which the join drops.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")
    page, at = F.shiftright(slot, 15), slot.bitwiseAND(PAGE - 1)
    pages = asked.select(page.alias("page"), at.cast("long").alias("at")).distinct().groupBy("page").agg(F.bitmap_construct_agg("at").alias("bitmap"))
    texts = docs.select(F.col("doc_id").cast("long").alias(key), F.col("text").cast("string").alias("text"))
    texts = texts.withColumns({"page": page, "at": at}).join(F.broadcast(pages), "page")
    byte = F.conv(F.hex(F.expr("substring(bitmap, shiftright(at, 3) + 1, 1)")), 16, 10).cast("int")
    bit = F.call_function("getbit", byte, F.col("at").bitwiseAND(7))
    return texts.where(bit == 1).select(key, "text").join(shuffled(asked), key)


def confirm(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union|, on the full sets, as (a, b).

    Where an id has several texts, one combination is enough. A document with many partners is salted: its text goes to as many groups as it
    has 64 partners. Rows are sorted by group, so a worker holds the sets of one id at a time.
    """
    spark = pairs.sparkSession
    common.small_batches(spark)
    pairs = common.stored(pairs, "pairs", spark)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 64).cast("int").alias("salts"))
    salted = pairs.join(shuffled(salts), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    heads = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    asked = salted.select(F.col("b").alias("id"), "a", "salt").unionByName(heads.select(F.col("a").alias("id"), "a", "salt"))
    asked = common.stored(asked, "asked", spark)
    rows = texts_for(asked, docs, "id").select("a", "salt", (F.col("id") != F.col("a")).alias("other"), F.col("id").alias("b"), "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "other", "b", "text")

    def run(batches):
        hashes, heads, at, last, linked = WordHashes(), [], None, None, None
        for batch in batches:
            got_a, got_b = [], []
            for a, salt, other, b, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if not other:
                    if at != (a, salt):
                        heads, at, last, linked = [], (a, salt), None, None
                    if last != (a, text):
                        heads.append(shingles(text, n, hashes))
                        last = (a, text)
                    continue
                if linked == b or last == (b, text) or at != (a, salt):
                    continue
                last = (b, text)
                s = shingles(text, n, hashes)
                for head in heads:
                    both = len(np.intersect1d(head, s, assume_unique=True))
                    if 100 * both >= percent * (len(head) + len(s) - both) and both:
                        got_a.append(a)
                        got_b.append(b)
                        linked = b
                        break
            yield pa.RecordBatch.from_arrays([pa.array(got_a, pa.int64()), pa.array(got_b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def likely(least: float):
    """For rows by cell (grp, block, chunk), members first: the guests that the packed bits put near a member of another component."""
    ones, one, two = np.uint64(0x1111111111111111), np.uint64(1), np.uint64(2)

    def run(batches):
        at, bits, parts, own = None, [], [], None
        for batch in batches:
            out: list = []
            for grp, block, chunk, guest, rep, part, x in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if at != (grp, block, chunk):
                    at, bits, parts, own = (grp, block, chunk), [], [], None
                if not guest:
                    bits.append(x)
                    parts.append(part)
                    continue
                if own is None:
                    own = np.array(bits, np.int64).reshape(-1, 8).view(np.uint64), np.array(parts, np.int64)
                unlike = own[0] ^ np.array(x, np.int64).view(np.uint64)
                unlike |= unlike >> one
                unlike = (unlike | unlike >> two) & ones
                equal = PERMS - np.bitwise_count(unlike).sum(1)
                if (((equal / PERMS - 1 / 16) / (1 - 1 / 16) >= least) & (own[1] != part)).any():
                    out.append((grp, block, rep, part))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["grp", "block", "rep", "part"])

    return run


def across(member: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between different components that share a bucket of three or more."""
    spark = member.sparkSession
    common.small_batches(spark)
    part = member.where("size > 2").join(shuffled(found.withColumnRenamed("node", "rep")), "rep", "left").select("band", "key", "a", "rep", F.coalesce("component", "rep").alias("part"))
    part = common.stored(part, "parts", spark)
    several = common.stored(part.groupBy("band", "key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("band", "key"), "several", spark)
    # buckets that share a member are one group, so a pair is compared once and not in each band
    ties = part.join(shuffled(several), ["band", "key"]).where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    groups = components(ties).withColumnRenamed("component", "grp")
    size = reps.groupBy("rep").agg(F.sum("n_shingles").alias("weight"))
    of = groups.join(shuffled(found), "node", "left").select("grp", F.col("node").alias("rep"), F.coalesce("component", "node").alias("part")).join(shuffled(size), "rep")
    of = common.stored(of, "groups", spark)
    mains = of.groupBy("grp", "part").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    blocks = F.ceil(F.greatest(F.sum("w") / BLOCK, F.sum("n") / MEMBERS)).cast("int").alias("blocks")
    mains = mains.groupBy("grp").agg(F.max(F.struct("w", "part"))["part"].alias("main"), blocks, F.sum("n").alias("n"))
    of = of.join(shuffled(mains), "grp").withColumn("loose", F.col("part") != F.col("main"))
    base = of.select("rep", "grp", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "part", F.ceil(F.col("n") / MEMBERS).cast("int").alias("chunks"))
    guests = of.where("loose").select("rep", "grp", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("rep", F.lit(SEED)), F.ceil(F.col("n") / MEMBERS)).cast("int").alias("chunk"))
    cell = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    # first the packed signatures meet, chunks of guests with blocks of members; only guests that may link go on with their texts
    packed = base.select("grp", "block", cell, F.lit(False).alias("guest"), "rep", "part").unionByName(guests.withColumn("guest", F.lit(True)))
    packed = packed.join(shuffled(reps.select("rep", "bits")), "rep").select("grp", "block", "chunk", "guest", "rep", "part", "bits")
    packed = packed.repartition("grp", "block", "chunk").sortWithinPartitions("grp", "block", "chunk", "guest")
    guests = common.stored(packed.mapInArrow(likely(percent / 100 - SLACK), "grp long, block int, rep long, part long").distinct(), "guests", spark)
    chunks = guests.groupBy("grp", "block").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("chunks"))
    base = base.drop("chunks").join(shuffled(chunks), ["grp", "block"]).select("grp", "block", cell, "rep", "part", F.lit(False).alias("guest"))
    guests = guests.join(shuffled(chunks), ["grp", "block"]).select("grp", "block", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"), "rep", "part", F.lit(True).alias("guest"))
    asked = common.stored(base.unionByName(guests), "asked", spark)
    rows = texts_for(asked, docs, "rep").select("grp", "block", "chunk", "guest", "rep", "part", "text")
    rows = rows.repartition("grp", "block", "chunk").sortWithinPartitions("grp", "block", "chunk", "guest")

    def run(batches):
        hashes, at, sets, ids, parts, index = WordHashes(), None, [], [], [], None
        for batch in batches:
            got_a, got_b = [], []
            for grp, block, chunk, guest, rep, part, text in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if at != (grp, block, chunk):
                    at, sets, ids, parts, index = (grp, block, chunk), [], [], [], None
                s = shingles(text, n, hashes)
                if not guest:
                    sets.append(s)
                    ids.append(rep)
                    parts.append(part)
                    continue
                if index is None:
                    flat, owner = (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
                    order = np.argsort(flat, kind="stable")
                    index = (flat[order], owner[order], np.array([len(x) for x in sets], np.int64), np.array(ids, np.int64), np.array(parts, np.int64))
                flat, owner, sizes, own_ids, own_parts = index
                lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, "right")
                length = hi - lo
                first = np.cumsum(length) - length
                places = np.arange(length.sum()) + np.repeat(lo - first, length)
                both = np.bincount(owner[places], minlength=len(sizes))
                hit = np.flatnonzero((100 * both >= percent * (len(s) + sizes - both)) & (own_parts != part) & (both > 0))
                for k in np.unique(own_parts[hit], return_index=True)[1]:
                    got_a.append(min(rep, int(own_ids[hit[k]])))
                    got_b.append(max(rep, int(own_ids[hit[k]])))
            yield pa.RecordBatch.from_arrays([pa.array(got_a, pa.int64()), pa.array(got_b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sig = common.stored(signatures(docs, n), "signatures", spark)
    usable = sig.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = common.stored(usable.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "classes", spark)
    # class representatives with their signatures; the first row of a shared id and set
    reps = usable.join(shuffled(classes), [usable.c1 == classes.c1, usable.c2 == classes.c2, usable.doc_id == classes.rep]).select("rep", "bands", "bits", "n_shingles", usable.c1).dropDuplicates(["rep", "c1"])
    reps = common.stored(reps.drop("c1"), "reps", spark)
    banded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("rep").alias("a"), F.max("rep").alias("last"), F.count("*").alias("size")).where("last > a")
    buckets = common.stored(buckets.drop("last"), "buckets", spark)  # stored, so that the join is split where a bucket is huge
    member = common.stored(banded.join(shuffled(buckets), ["band", "key"]), "members", spark)
    bits = reps.select("rep", "bits")
    stars = member.where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    stars = stars.join(shuffled(bits.select(F.col("rep").alias("a"), F.col("bits").alias("x"))), "a").join(shuffled(bits.select(F.col("rep").alias("b"), F.col("bits").alias("y"))), "b")
    least = percent / 100 - SLACK
    links = common.stored(confirm(stars.where(estimate("x", "y") >= least).select("a", "b").distinct(), docs, n, percent), "links", spark)
    # an id on several texts ties their classes together
    ids = usable.join(shuffled(classes), ["c1", "c2"]).select("doc_id", "rep")
    shared = ids.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").drop("z")
    links = links.unionByName(shared.join(shuffled(ids), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")))
    found = common.stored(components(links), "components-1", spark)
    more = common.stored(across(member, found, reps, docs, n, percent), "links-2", spark)
    tied = found.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
    final = components(tied.unionByName(more)) if more.limit(1).count() else found
    common.forget(spark, reps, buckets, member, links, more)
    whole = classes.join(shuffled(final.withColumnRenamed("node", "rep")), "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("root"))
    out = sig.join(shuffled(whole), ["c1", "c2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), 3, 85)


ORACLE_SQL = """
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
one AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t WHERE len(w) >= 3),
three AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS s FROM one WINDOW o AS (PARTITION BY r ORDER BY i)),
sh AS (SELECT DISTINCT doc_id, s FROM three WHERE s IS NOT NULL UNION SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 2),
c AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 85 * (ca.n + cb.n - k)),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT x.other, r.root FROM r JOIN (SELECT a AS node, b AS other FROM e UNION SELECT b, a FROM e) x ON x.node = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, doc_id = root AS kept FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN c USING (doc_id)
"""
