"""Removal of long repeated byte strings over a logarithmic family of sparse suffix arrays.

A byte goes if a LENGTH-byte string that covers it also starts anywhere else in the input. Every LENGTH-byte window picks an anchor: the
K-gram inside it with the smallest hash, the leftmost of equals. Equal windows pick equal anchors at equal offsets, so only suffixes
around anchors (about 2 in LENGTH-K bytes) need an index entry. The windows of one anchor are adjacent and form a segment. A sparse suffix
array is a table of the distinct segments of some batches, sorted by the suffix that starts at the anchor: alphabetically by its first HEAD
bytes, then by the hash of the K-gram and the hash of the whole segment, with the number of occurrences and one place. Entries that share K bytes or more
are neighbours; the order among equal heads is of no account, since only equality of long strings counts.

A new batch's array is merge-scanned against the array of each existing level before it joins them: an entry met again is a segment
that is repeated whole; different segments of one anchor share K bytes and are long matches to be extended. Matches among the levels' own entries were found
when the later of them came, so each pair of batches is looked at once and no pass over the whole index follows. Then the array enters on level
0, and two arrays of equal level merge into one of the next, adding up their occurrences: n batches leave at most log2(n) + 1 arrays.

At the end the matches of all scans are extended: different segments of one anchor are compared window by window, one place of each, read from the
texts. Such a group is compared in one task up to GROUP segments. Of larger groups only the windows' hashes meet, a segment's as one packed
row, or, above CELL hashes in a group, as one for each of the cells they are dealt to by hash; so no group is gathered as text or capped. Hashes have 64 bits for the anchor and 64 for the content, from independent
polynomials over random byte values. A query over one table deals its rows into BATCHES batches.

Null and empty texts have no bytes and lose none, like all texts below LENGTH bytes. Repeated rows are each other's copies. Rows that share an id
are told apart by a hash of the text. Texts of any length are cut into overlapping blocks of BLOCK windows, so memory is
bounded. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, K, HEAD, BATCHES = 400, 200, 8, 4
GROUP = 256
#: Window hashes of a larger group that meet in one task.
CELL = 1 << 20
#: Anchors up to this number (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
BLOCK = 1 << 20
POSITION = np.uint64((1 << 21) - 1)
_rng = np.random.default_rng(4)
BYTES = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, (2, 256), dtype=np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.up, self.down = (np.ones(1, np.uint64) for _ in range(2))
        self.base = base

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                xs = getattr(self, name)
                setattr(self, name, np.concatenate([xs, xs * np.uint64(pow(b, m, 1 << 64))]))


POWERS = [Powers(b) for b in BASES]


def prefix(data: np.ndarray, which: int) -> np.ndarray:
    POWERS[which].grow(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[which][data] * POWERS[which].up[: len(data)], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    return (sums[end] - sums[start]) * POWERS[which].down[start]


def segments(data: np.ndarray, length: int = LENGTH, k: int = K):
    """The anchor's first HEAD bytes as an ordered number, its hash, segment hash, first and last window start of each segment, in order."""
    found = []
    for at in range(0, len(data) - length + 1, BLOCK):
        part = data[at : at + BLOCK + length - 1]
        a, b = prefix(part, 0), prefix(part, 1)
        m, w = len(part) - k + 1, length - k + 1
        grams = mixed((a[k:] - a[:m]) * POWERS[0].down[:m])
        key = (grams & ~POSITION) | np.arange(m, dtype=np.uint64)
        rows = np.concatenate([key, np.full((-m) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
        ahead = np.minimum.accumulate(rows, 1).ravel()[:m]
        back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()[:m]
        pos = (np.minimum(back[: m - w + 1], ahead[w - 1 :]) & POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        last = np.concatenate([first[1:], [len(pos)]]) - 1
        anchor = pos[first]
        shape = ((anchor - first).astype(np.uint64) << np.uint64(24)) + (last - first).astype(np.uint64)
        whole = mixed(mixed(between(b, first, last + length, 1)) + mixed(shape))
        head = np.zeros(len(anchor), np.uint64)
        for j in range(min(HEAD, k)):
            head = head << np.uint64(8) | part[anchor + j]
        head = (head ^ np.uint64(1 << 63)).view(np.int64)  # signed order is the bytes' order
        found.append((head, grams[anchor].view(np.int64), whole.view(np.int64), first + at, last + at))
    if not found:
        return (np.empty(0, np.int64),) * 5
    return tuple(map(np.concatenate, zip(*found)))


def raw(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 96-bit key (ra, rb) of the row."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    row = F.struct("doc_id", F.xxhash64("text"))
    return d.withColumns({"ra": F.xxhash64(row), "rb": F.hash(row)})


ENTRY = "ra long, rb int, head long, kh long, sh long, n long, first long, last long"


def entries(docs: DataFrame, length: int, k: int) -> DataFrame:
    """The distinct segments of each document, with their numbers and first places; no shuffle."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for ra, rb, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                head, kh, sh, first, last = segments(np.frombuffer(raw(text), np.uint8), length, k)
                if len(kh):
                    order = np.lexsort((first, sh, kh, head))
                    head, kh, sh, first, last = (x[order] for x in (head, kh, sh, first, last))
                    new = np.flatnonzero(np.concatenate([[True], (kh[1:] != kh[:-1]) | (sh[1:] != sh[:-1])]))
                    n = np.diff(np.concatenate([new, [len(kh)]]))
                    out.append((np.full(len(new), ra), np.full(len(new), rb, np.int32), head[new], kh[new], sh[new], n, first[new], last[new]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=[x.split()[0] for x in ENTRY.split(", ")])

    return keyed(docs).select("ra", "rb", "text").mapInArrow(run, ENTRY)


def place() -> list[Column]:
    """The place of any one of equal segments: all four from one row, as each aggregate takes the first row it meets."""
    return [F.first(c).alias(c) for c in ("ra", "rb", "first", "last")]


class SuffixIndex:
    """The family: at most one array on each level, stored in the shared folder, and the matches that the batches' scans found.

    The newest batch's array waits as `newest` until the next one comes, so the last and largest merge isn't made before it is of use.
    """

    def __init__(self, spark: SparkSession, length: int = LENGTH, k: int = K):
        self.spark, self.length, self.k = spark, length, k
        self.levels: dict[int, DataFrame] = {}
        self.newest: DataFrame | None = None
        self.members: list[DataFrame] = []
        self.matches: list[DataFrame] = []
        self.scans: list[DataFrame] = []

    @staticmethod
    def merged(rows: DataFrame, *more: Column) -> DataFrame:
        return rows.groupBy("head", "kh", "sh").agg(F.sum("n").alias("n"), *place(), *more)

    def arranged(self, rows: DataFrame, level: int) -> DataFrame:
        """One array of the rows, in suffix order inside each partition."""
        return common.stored(self.merged(rows).sortWithinPartitions("head", "kh", "sh"), f"suffix-{level}", self.spark)

    def add(self, docs: DataFrame) -> DataFrame:
        """Takes in a batch and returns its matches."""
        return self.add_entries(common.stored(entries(docs, self.length, self.k), "suffix-members", self.spark))

    def add_entries(self, members: DataFrame) -> DataFrame:
        self.members.append(members)
        if self.newest is not None:
            self.put(0, self.newest)
        self.newest = self.arranged(members, 0)
        self.matches.append(common.stored(self.scan(self.newest), "suffix-matches", self.spark))
        return self.matches[-1]

    def put(self, level: int, array: DataFrame) -> None:
        if level not in self.levels:
            self.levels[level] = array
            return
        other = self.levels.pop(level)
        up = self.arranged(union([array, other]), level + 1)
        common.forget(self.spark, array, other)
        self.put(level + 1, up)

    def scan(self, array: DataFrame) -> DataFrame:
        """The entries of a new array and of the levels, merged by suffix, that take part in a match with a new one.

        whole: the segment occurs twice, in the batch or in the batch and the levels; shared: it has the anchor of a different
        segment. Only a match of at least the anchor's K bytes that involves the batch comes out: the levels' own matches were found before.
        """
        spark, old = self.spark, list(self.levels.values())
        rows = array.withColumn("new", F.lit(True))
        if old:
            rows = self.merged(union([rows, *(x.withColumn("new", F.lit(False)) for x in old)]), F.max("new").alias("new"))
        # one shuffle of the entries gives both the repeated segments and the anchors of several segments
        whole = rows.where("n > 1 AND new").select("kh", "sh", "ra", "rb", "first", "last", F.lit(False).alias("shared"))
        anchors = rows.groupBy("head", "kh").agg(F.count("*").alias("size"), F.max("new").alias("new")).where("size > 1 AND new")
        none = F.lit(None).cast("long")
        anchors = anchors.select("kh", none.alias("sh"), none.alias("ra"), none.cast("int").alias("rb"), none.alias("first"), none.alias("last"), F.lit(True).alias("shared"))
        both = common.stored(whole.unionByName(anchors), "suffix-scan", spark)
        self.scans.append(both)
        named = both.where("shared").select("kh")
        if named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            named = F.broadcast(named)
        asked = union([array, *old]).join(named, "kh", "left_semi").select("kh", "sh", "ra", "rb", "first", "last", F.lit(False).alias("whole"), F.lit(True).alias("shared"))
        return both.where("NOT shared").withColumn("whole", F.lit(True)).unionByName(asked)

    def repeated(self, docs: DataFrame) -> DataFrame:
        """kh, sh, lo, hi: the windows lo to hi of a segment (counted from its first) that occur elsewhere, from the matches of all batches."""
        spark, length = self.spark, self.length
        matches = union(self.matches).groupBy("kh", "sh").agg(F.max("whole").alias("whole"), F.max("shared").alias("shared"), *place())
        matches = common.stored(matches, "suffix-all-matches", spark)
        whole = matches.where("whole").select("kh", "sh", F.lit(0).cast("long").alias("lo"), (F.col("last") - F.col("first")).alias("hi"))
        shared = matches.where("shared")
        # stored, so that the join is split where an anchor has very many segments
        sizes = common.stored(shared.groupBy("kh").agg(F.count("*").alias("size")), "suffix-sizes", spark)
        asked = common.stored(shared.join(sizes, "kh"), "suffix-asked", spark)
        texts = keyed(docs).select("ra", "rb", "text")
        one = F.struct("kh", "sh", "whole", "first", "last", "size")
        by_doc = asked.groupBy("ra", "rb").agg(F.collect_list(one).alias("asked"))
        wanted = texts.join(by_doc, ["ra", "rb"])

        def cut(batches):
            for batch in batches:
                out = []
                for text, reqs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    data = raw(text)
                    out += [(r["kh"], r["sh"], r["whole"], r["size"], data[r["first"] : r["last"] + length]) for r in reqs]
                yield pa.RecordBatch.from_pylist([dict(zip(("kh", "sh", "whole", "size", "bytes"), x)) for x in out], schema=CUT)

        cuts = wanted.select("text", "asked").mapInArrow(cut, "kh long, sh long, whole boolean, size long, bytes binary")
        cuts = common.stored(cuts, "suffix-cuts", spark)
        small = cuts.where(F.col("size") <= GROUP).repartition("kh").sortWithinPartitions("kh", "sh").select("kh", "sh", "whole", "bytes")

        def compare(batches):
            held: list = []
            for batch in batches:
                out: list = []
                for kh, sh, whole, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if held and held[0][0] != kh:
                        out += compared(held, length)
                        held = []
                    if not held or held[-1][1] != sh:  # repeated rows ask twice
                        held.append((kh, sh, whole, data))
                yield as_spans(out)
            yield as_spans(compared(held, length))

        spans = small.mapInArrow(compare, SPAN)
        large = cuts.where(F.col("size") > GROUP).dropDuplicates(["kh", "sh"])

        hits = meet(dealt(large, length)).groupBy("kh", "sh").agg(F.array_sort(F.flatten(F.collect_list("xs"))).alias("xs"))
        # starts and ends of runs of neighbours
        starts = F.filter("xs", lambda x, i: (i == 0) | (F.get("xs", i - 1) != x - 1))
        ends = F.filter("xs", lambda x, i: (i == F.size("xs") - 1) | (F.get("xs", i + 1) != x + 1))
        hits = hits.select("kh", "sh", F.inline(F.arrays_zip(starts.alias("lo"), ends.alias("hi"))))
        out = common.stored(whole.unionByName(spans), "suffix-spans", spark)
        if cuts.where(F.col("size") > GROUP).limit(1).count():
            out = out.unionByName(common.stored(hits, "suffix-hits", spark))
        common.forget(spark, matches, sizes, asked, cuts)
        return out

    def close(self) -> None:
        """Deletes the arrays and matches; the members stay for results that read them."""
        common.forget(self.spark, *self.levels.values(), *self.matches, *self.scans, *([self.newest] if self.newest is not None else []))
        self.levels, self.matches, self.scans, self.newest = {}, [], [], None


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


SPAN = "kh long, sh long, lo long, hi long"
CUT = pa.schema([("kh", pa.int64()), ("sh", pa.int64()), ("whole", pa.bool_()), ("size", pa.int64()), ("bytes", pa.binary())])


def windows(data: bytes, length: int) -> np.ndarray:
    """Hashes of all windows of a segment."""
    b = prefix(np.frombuffer(data, np.uint8), 1)
    start = np.arange(len(data) - length + 1)
    return mixed(between(b, start, start + length, 1)).view(np.int64)


def compared(group: list, length: int) -> list:
    """For segments of one anchor: (kh, sh, lo, hi) of windows that another segment has too."""
    if len(group) < 2:
        return []
    hashes = [windows(data, length) for *_, data in group]
    _, which, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    twice, at, out = n[which] > 1, 0, []
    for (kh, sh, whole, _), h in zip(group, hashes):
        hit = twice[at : at + len(h)]
        at += len(h)
        if not whole and hit.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            out += [(kh, sh, int(lo), int(hi) - 1) for lo, hi in zip(edge[::2], edge[1::2])]
    return out


def dealt(segs: DataFrame, length: int) -> DataFrame:
    """The window hashes hs and their places xs of segments (kh, sh, whole, size of the group, bytes): a row for each cell they fall into."""
    limit = CELL

    def run(batches):
        for batch in batches:
            out: list = []
            for kh, sh, whole, size, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                h = windows(data, length)
                cells = -(-size * length // limit)  # the same for all segments of a group
                cell = (h.view(np.uint64) % np.uint64(cells)).astype(np.int64)
                order = np.argsort(cell, kind="stable")
                edge = np.flatnonzero(np.diff(cell[order])) + 1
                out += [(kh, int(cell[x[0]]), sh, whole, x.astype(np.int32), h[x]) for x in np.split(order, edge)]
            if out:
                kh, cell, sh, whole, xs, hs = zip(*out)
                at = pa.array(np.cumsum([0, *map(len, xs)]), pa.int32())
                lists = (pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (xs, hs))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (kh, cell, sh)), pa.array(whole, pa.bool_()), *lists], names=["kh", "cell", "sh", "whole", "xs", "hs"])

    return segs.select("kh", "sh", "whole", "size", "bytes").mapInArrow(run, "kh long, cell long, sh long, whole boolean, xs array<int>, hs array<long>")


def meet(rows: DataFrame) -> DataFrame:
    """kh, sh, xs: of dealt() rows, the places of windows that occur twice in their cell; segments that are repeated whole don't come out."""
    rows = rows.repartition("kh", "cell").sortWithinPartitions("kh", "cell")

    def found(held: list) -> pa.RecordBatch:
        out: list = []
        if held:
            _, which, n = np.unique(np.concatenate([x[-1] for x in held]), return_inverse=True, return_counts=True)
            twice, at = n[which] > 1, 0
            for _, kh, sh, whole, xs, hs in held:
                hit = twice[at : at + len(hs)]
                at += len(hs)
                if not whole and hit.any():
                    out.append((kh, sh, xs[hit]))
        cols = list(zip(*out)) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["kh", "sh", "xs"])

    def run(batches):
        held: list = []
        for batch in batches:
            kh, cell, sh, whole = (batch.column(i).to_pylist() for i in range(4))
            xs, hs = (batch.column(i).flatten().to_numpy() for i in (4, 5))
            at = batch.column(4).offsets.to_numpy()
            for k in range(batch.num_rows):
                if held and held[0][0] != (kh[k], cell[k]):
                    yield found(held)
                    held = []
                lo, hi = at[k] - at[0], at[k + 1] - at[0]
                held.append(((kh[k], cell[k]), kh[k], sh[k], whole[k], xs[lo:hi], hs[lo:hi]))
        yield found(held)

    return rows.mapInArrow(run, "kh long, sh long, xs array<int>")


def as_spans(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["kh", "sh", "lo", "hi"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, batches: int = BATCHES, kept_bytes: bool = False, kept_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end of each maximal removed run), kept_sha256 and, if asked for, kept (binary) and text.

    text is what is left as a string; where a cut falls inside a character, a replacement character stands for the rest of it.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    index = SuffixIndex(spark, length, k)
    # one pass over the texts gives the entries of all batches
    members = common.stored(entries(docs, length, k), "suffix-members", spark)
    for i in range(batches):
        index.add_entries(members.where(F.pmod("ra", F.lit(batches)) == i))
    spans = index.repeated(docs)
    index.close()
    marks = members.select("ra", "rb", "kh", "sh").join(spans, ["kh", "sh"]).distinct().groupBy("ra", "rb").agg(F.collect_list(F.struct("kh", "sh", "lo", "hi")).alias("marks"))
    both = keyed(docs).join(marks, ["ra", "rb"], "left").select("doc_id", "text", "marks")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = raw(text)
                kept, runs = data, []
                if marks:
                    arr = np.frombuffer(data, np.uint8)
                    at: dict = {}
                    for m in marks:
                        at.setdefault((m["kh"], m["sh"]), []).append((m["lo"], m["hi"]))
                    step = np.zeros(len(arr) + 1, np.int32)
                    _, kh, sh, first, _ = segments(arr, length, k)
                    for key, f in zip(zip(kh.tolist(), sh.tolist()), first.tolist()):
                        for lo, hi in at.get(key, ()):
                            step[f + lo] += 1
                            step[f + hi + length] -= 1
                    gone = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
                    runs = [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])]
                    kept = arr[~gone].tobytes()
                out.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if kept_bytes else None, kept.decode("utf-8", "replace") if kept_text else None))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept", "text"])

    common.small_batches(spark)
    out = both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string, kept binary, text string")
    return out.drop(*(name for name, asked in (("kept", kept_bytes), ("text", kept_text)) if not asked))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.documents(spark, sf_dir), kept_text=True)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "text")
