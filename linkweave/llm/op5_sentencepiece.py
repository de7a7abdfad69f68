"""SentencePiece encoding and decoding over a relational lattice.

Texts split into fragments, whose borders no piece crosses: two neighbouring characters that no piece of the vocabulary holds side by side never
merge. The cuts used are those in front of runs of blanks (written as the word-start mark), at line ends and around runs of ASCII marks and digits, as far as
the vocabulary proves them. Documents are dealt into chunks of about CHUNK characters by one shuffle; inside its partition a chunk's distinct
fragments explode into their substrings of bounded length, an equi-join with the piece table (a fixed vocabulary, broadcast) leaves the
lattice's edges, edges are grouped by fragment, and a Spark higher-order aggregate folds them into the best path. Only the fragments
are shuffled again, as they come out of an Arrow function. A co-group then hands each chunk's dictionary to its documents.

The fold depends on the model's type. unigram: Viterbi, best score over the edges by their ends. bpe: scores are merge ranks, whose
best sum is not the library's result, so the fold replays the merges: over the edges by rank (then start), an edge whose
two ends are borders with one border between them removes that border. Borders are the bits of one long.

Characters outside the vocabulary become their bytes, as in the library. Fragments of over LONGEST characters, more than a long has bits for, are
left to the library, one by one, in the same co-group. Null and empty texts have no tokens. Repeated rows each give a row. A literal mark in a
text decodes as a blank, as in the library. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .op2_token_counts import MARK, model_bytes

CHUNK, LONGEST = 24_000_000, 61
#: In front of a word that comes without a blank; what a line end is replaced by before a text is split at blanks; the same cuts as regular expressions.
BARE = "\x01"
LINE_END = f" {BARE}\n {BARE}"
SLOW = {True: r" +[^ \n]*|\n|[^ \n]+", False: " +[^ ]*"}
MARKS = string.punctuation + string.digits
#: Texts, and fragments, that are Python objects or numpy columns at a time.
ROWS, FRAGMENTS = 256, 20_000


def piece_table(model: bytes) -> tuple[list[tuple[str, int, float]], int, bool]:
    """(piece, id, score) of the vocabulary without control and byte pieces; the longest piece; whether the model merges."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p, *_ in rows):
        raise ValueError("a piece crosses a word border")
    proto = pb.ModelProto()
    proto.ParseFromString(model)
    return rows, max(len(p) for p, *_ in rows), proto.trainer_spec.model_type == 2


def fragment_pattern(pieces: list[str]) -> str:
    """A regular expression, for Java and Python, whose matches in a row are the fragments of a text that starts with a blank."""
    pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    if any("\n" in p for p in pieces):
        return " +[^ ]*"
    marks, more = set(MARKS), {""}
    while more:  # what pieces hold beside a mark is a mark, too, if it isn't a letter or digit
        more = {o for x in pairs for m, o in (x, x[::-1]) if m in marks and o not in marks and not o.isalnum() and o != MARK}
        marks |= more
    more = {""}
    while more:  # a mark that some piece continues with anything but a mark can't end a fragment
        more = {x[0] for x in pairs if x[0] in marks and x[1] not in marks}
        marks -= more
    escaped = lambda xs: "".join("\\" + x if x in string.punctuation else x for x in sorted(xs))
    if not marks:
        return " +[^ \\n]*|\\n|[^ \\n]+"
    # behind these characters marks may belong to the same piece, so they stay together
    before = {x[0] for x in pairs if x[1] in marks and x[0] not in marks and x[0] != MARK}
    tail = f"(?:(?<=[{escaped(before)}])[{escaped(marks)}]+)?" if before else ""
    return f" *(?:[^ \\n{escaped(marks)}]+{tail}|[{escaped(marks)}]+)| +|\\n"


def raw_words_of(text: str, lines: bool) -> list[str]:
    """The words of a text, cheaply: what is between single blanks, each to be led by a blank; BARE in front says that none is.

    Line ends are words of their own if no piece holds one. Texts with runs of blanks (also at the start) or a BARE of their own are cut by a
    regular expression, at the same places for more cost, into words with their blanks.
    """
    if not text:
        return []
    if text[0] == " " or "  " in text or BARE in text:
        return [BARE + x for x in re.findall(SLOW[lines], " " + text)]
    return (text.replace("\n", LINE_END) if lines else text).split(" ")


def unpacked(row: str) -> tuple[int, str | None, str]:
    """Place, id and text of a packed row."""
    place, size, rest = row.split(":", 2)
    size = int(size)
    return int(place), None if size < 0 else rest[:size], rest[max(size, 0) :]


def lattice(words: DataFrame, model: bytes, keys: list[str]) -> DataFrame:
    """words (keys, word) as keys, word, edges. Words without any edge drop out.

    A model that merges needs only pieces of two characters or more, each edge as one long: rank, start (8 bits), end (8 bits).
    Otherwise an edge is a struct of end, start and cost (the negative score).
    """
    spark = words.sparkSession
    rows, longest, merges = piece_table(model)
    least = 2 if merges else 1
    rows = sorted((r for r in rows if len(r[0]) >= least), key=lambda r: -r[2])
    pieces = spark.createDataFrame(pa.table({"known": [r[0] for r in rows], "rank": pa.array(range(len(rows)), pa.int32()), "cost": pa.array([-r[2] for r in rows], pa.float64())}))
    pieces = pieces.withColumn("h", F.xxhash64("known"))
    subs = words.select(*keys, "word", F.length("word").alias("n")).where(F.col("n") >= least)
    subs = subs.select(*keys, "word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - least)).alias("start"))
    subs = subs.select(*keys, "word", "start", F.explode(F.sequence(F.lit(least), F.least(F.lit(longest), F.col("n") - F.col("start")))).alias("size"))
    # joined on a 64-bit hash of the piece, which is quicker than on the text; the texts are compared after it
    subs = subs.withColumn("piece", F.expr("substring(word, start + 1, size)")).withColumn("h", F.xxhash64("piece"))
    # a bitmap of the pieces' hashes, 8 bits a piece, keeps out most of the others before the join looks them up
    n = 1 << max(0, (len(rows) // 8).bit_length())
    bits = np.zeros(n, np.uint64)
    for (x,) in pieces.select("h").collect():
        bits[(x >> 6) & (n - 1)] |= np.uint64(1 << (x & 63))
    cell = f"get(cast(split('{','.join(map(str, bits.view(np.int64).tolist()))}', ',') as array<bigint>), cast(shiftright(h, 6) & {n - 1} as int))"
    subs = subs.where(F.expr(f"shiftright({cell}, cast(h & 63 as int)) & 1L = 1L"))
    end = F.col("start") + F.col("size")
    if merges:
        edge = F.col("rank").cast("long") * 65536 + F.col("start") * 256 + end
    else:
        edge = F.struct(end.alias("e"), F.col("start").alias("s"), F.col("cost").alias("cost"))
    return subs.join(F.broadcast(pieces), "h").where("piece = known").groupBy(*keys, "word").agg(F.collect_list(edge).alias("edges"))


#: Borders are the bits 0 to n of one long. Edges come by rank and start; one whose ends are borders with just one
#: border between them removes that border.
FOLD_BPE = """
aggregate(sort_array(edges), shiftleft(1L, length(word) + 1) - 1,
  (m, x) -> if(bit_count(m & (shiftleft(2L, cast(x & 255 as int)) - shiftleft(1L, cast(shiftright(x, 8) & 255 as int)))) = 3
      and (shiftright(m, cast(x & 255 as int)) & shiftright(m, cast(shiftright(x, 8) & 255 as int)) & 1L) = 1L,
    m & ~(shiftleft(1L, cast(x & 255 as int)) - shiftleft(2L, cast(shiftright(x, 8) & 255 as int))), m))
"""
#: Least cost and borders for each end so far; edges come by end, so every start is settled.
FOLD_VITERBI = """
aggregate(array_sort(edges), map_from_arrays(array(0), array(struct(cast(0 as double) as cost, 1L as borders))),
  (best, x) -> if(element_at(best, x.s) is null or coalesce(element_at(best, x.e).cost, double('infinity')) <= element_at(best, x.s).cost + x.cost, best,
    map_concat(map_filter(best, (k, v) -> k != x.e), map_from_arrays(array(x.e),
      array(struct(element_at(best, x.s).cost + x.cost as cost, element_at(best, x.s).borders | shiftleft(1L, x.e) as borders))))))
"""


def fold(edges: DataFrame, merges: bool, keys: list[str]) -> DataFrame:
    """keys, word, borders: the best path of each word as bits; words that no path covers are left out."""
    if merges:
        return edges.select(*keys, "word", F.expr(FOLD_BPE).alias("borders"))
    best = edges.withColumn("best", F.expr(FOLD_VITERBI))
    return best.select(*keys, "word", F.expr("try_element_at(best, length(word)).borders").alias("borders")).where("borders IS NOT NULL")


def pieces_of(word: str, borders: int) -> list[str]:
    found, at, rest = [], 0, borders & ~1
    while rest:
        end = (rest & -rest).bit_length() - 1
        found.append(word[at:end])
        at, rest = end, rest & (rest - 1)
    return found


def book_key(fragment: str) -> str:
    """The raw word that is just this fragment."""
    return fragment[1:] if fragment[0] == " " and fragment[1:2] != BARE else BARE + fragment


def spelled(found: pa.Table, number: dict[str, int]) -> tuple[dict[str, bytes], dict[str, int]]:
    """The ids (32 bits each) of the fragments of found (word, borders) by their raw words, many at once; the borders of those with a character that is no piece.

    Fragments lie side by side in the column's bytes, so the starts of their pieces make a column of pieces without a copy.
    """
    vocabulary, numbers = pa.array(list(number), pa.string()), np.array([*number.values(), -1], np.int32)
    first: dict[str, bytes] = {}
    rest: dict[str, int] = {}
    for batch in found.select(["word", "borders"]).to_batches(max_chunksize=FRAGMENTS):
        words, borders = batch.column(0), batch.column(1).to_numpy()
        _, at, data = words.buffers()
        at = np.frombuffer(at, np.int32)[words.offset : words.offset + len(words) + 1]
        starts = np.flatnonzero((np.frombuffer(data, np.uint8)[at[0] : at[-1]] & 0xC0) != 0x80) + at[0]  # of characters, in bytes
        ahead = np.searchsorted(starts, at)  # characters before each fragment
        of = np.repeat(np.arange(len(words)), np.diff(ahead))
        border = (borders[of] >> (np.arange(len(starts)) - ahead[of])) & 1 == 1
        cuts, of = np.append(starts[border], at[-1]).astype(np.int32), of[border]
        pieces = pa.StringArray.from_buffers(len(of), pa.py_buffer(cuts), data)
        ids = numbers[pc.fill_null(pc.index_in(pieces, vocabulary), len(number)).to_numpy()]
        odd = np.bincount(of[ids < 0], minlength=len(words)) > 0
        ends, ids = (4 * np.append(0, np.cumsum(np.bincount(of, minlength=len(words))))).tolist(), ids.tobytes()
        for k, word in enumerate(words.to_pylist()):
            if odd[k]:
                rest[word] = int(borders[k])
            else:
                first[book_key(word.replace(MARK, " "))] = ids[ends[k] : ends[k + 1]]
    return first, rest


def encode(docs: DataFrame, model: bytes | None = None, in_order: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and round_trip: whether the pieces spell the text again.

    in_order: rows that are read in one partition leave in one, in the same order, such as that of a shuffled corpus; one shuffle of the ids more.

    A literal U+2581 counts as the blank it encodes as, so round_trip is true for it, although the decoded text has a blank. Ids aren't decoded here.
    """
    spark = docs.sparkSession
    model = model or model_bytes()
    table, _, merges = piece_table(model)
    pattern, lines = fragment_pattern([p for p, *_ in table]), not any("\n" in p for p, *_ in table)
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = d.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // CHUNK))
    # place, id and text as one column: both branches below need the same columns and so share one exchange of the texts
    d = d.withColumn("place", F.monotonically_increasing_id())
    doc = F.col("doc_id").cast("string")
    packed = F.concat(F.col("place").cast("string"), F.lit(":"), F.coalesce(F.length(doc), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(doc, F.lit("")), F.col("text")).alias("packed")
    # dealt by place: repeated rows spread over all chunks
    d = d.select(F.pmod(F.xxhash64("place"), F.lit(chunks)).cast("int").alias("chunk"), packed).repartitionById(chunks, "chunk")

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct fragments of each chunk that a partition holds, a list for those that ROWS texts add."""
        find = re.compile(pattern).findall
        seen_in: dict[int, set[str]] = {}
        had_in: dict[int, set[str]] = {}
        for b in batches:
            for at in range(0, len(b), ROWS):
                new: dict[int, list[str]] = {}
                for c, row in zip(*(x.to_pylist() for x in b.slice(at, ROWS).columns)):
                    seen, had = seen_in.setdefault(c, set()), had_in.setdefault(c, set())
                    more = set(raw_words_of(unpacked(row)[2].replace(MARK, " "), lines)) - seen
                    seen |= more
                    out = new.setdefault(c, [])
                    for word in more:
                        text = word[1:] if word[:1] == BARE else " " + word
                        for x in [text] if word.isalpha() else find(text):  # letters hold no cut
                            if 2 <= len(x) <= LONGEST and x not in had:
                                had.add(x)
                                out.append(x)
                # in order, which packs better
                yield pa.record_batch({"chunk": pa.array(list(new), pa.int32()), "words": pa.array([sorted(x) for x in new.values()], pa.list_(pa.string()))})

    # Python's rows have no known partitioning, so the fragments are dealt once more
    words = d.mapInArrow(fragments, "chunk int, words array<string>").repartitionById(chunks, "chunk")
    words = words.select("chunk", F.explode("words").alias("word")).select("chunk", F.replace("word", F.lit(" "), F.lit(MARK)).alias("word"))
    # edges are few and small for a word, and a chunk's words are bounded: no sort before they are grouped
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "2000000")
    known = fold(lattice(words, model, ["chunk"]), merges, ["chunk"]).withColumnRenamed("chunk", "part")
    shared = spark.sparkContext.broadcast(model)
    kind, arrow = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)

    def assemble(texts: pa.Table, found: pa.Table) -> pa.Table:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        number = {p: i for p, i, _ in piece_table(shared.value)[0]}
        first, borders = spelled(found, number)
        spell = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.get_piece_size())]
        raw = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        find, behind = re.compile(pattern).findall, len(sp.encode("\n"))
        wrong: set[str] = set()

        def from_library(word: str) -> list[int]:
            if word == " ":
                return sp.encode("a ")[len(sp.encode("a")) :]
            if word[0] == " ":  # the library puts the first blank in front by itself
                return sp.encode(word[1:])
            # behind a line end, which merges with nothing
            return sp.encode("\n" + word)[behind:] if word != "\n" else sp.encode("\n")[len(sp.encode("a ")) - len(sp.encode("a")) :]

        def by_lattice(word: str) -> list[int] | None:
            """The ids of a fragment; None where the lattice has no path or no bytes for a character outside the vocabulary."""
            marked, n = word.replace(" ", MARK), len(word)
            if n == 1 and marked in number:
                return [number[marked]]
            b = borders.get(marked, 2 * (1 << n) - 1 if merges and n <= LONGEST else None)  # without edges, nothing merges
            if b is None:
                return None
            parts = pieces_of(marked, b)
            x = [number.get(p, -1) for p in parts]
            if -1 in x:
                x = None if len(raw) < 256 else [i for p, k in zip(parts, x) for i in ([k] if k >= 0 else [raw[c] for c in p.encode("utf-8", "replace")])]
            return x

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                text = word[1:] if word[:1] == BARE else " " + word
                x: list[bytes] = []
                for fragment in [text] if word.isalpha() else find(text):  # letters hold no cut
                    if (y := self.get(k := book_key(fragment))) is not None and k not in wrong:
                        x.append(y)
                        continue
                    if (y := by_lattice(fragment)) is None:
                        y = from_library(fragment)
                        # pieces of the lattice spell their fragment; a text decodes to itself if all its words do
                        if b"".join([spell[i] for i in y]) != fragment.encode("utf-8", "surrogatepass"):
                            wrong.add(word)
                    x.append(array("i", y).tobytes())
                got = self[word] = b"".join(x)
                return got

        book = Words(first)
        places, who, out, n, same = [], [], [], [0], []
        for row in (x for part in texts.column("packed").chunks for k in range(0, len(part), ROWS) for x in part[k : k + ROWS].to_pylist()):
            place, name, text = unpacked(row)
            places.append(place)
            who.append(name)
            words = raw_words_of(text.replace(MARK, " "), lines)
            got = np.frombuffer(b"".join(map(book.__getitem__, words)), np.int32)
            out.append(got)
            n.append(n[-1] + len(got))
            same.append(not wrong or wrong.isdisjoint(words))
        every = pa.array(np.concatenate(out) if out else np.empty(0, np.int32))
        n = np.array(n, np.int64)
        return pa.table({"place": pa.array(places, pa.int64()), "doc_id": pa.array(who, pa.string()).cast(arrow), "n_tokens": np.diff(n), "ids": pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), every), "round_trip": pa.array(same, pa.bool_())})

    out = d.groupBy("chunk").cogroup(known.groupBy("part")).applyInArrow(assemble, f"place long, doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")
    if in_order:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        out = out.repartitionById(n, F.pmod(F.shiftright("place", 33), F.lit(n)).cast("int")).sortWithinPartitions("place")
    return out.drop("place")


def decode(df: DataFrame, model: bytes | None = None) -> DataFrame:
    """df (with ids) and decoded: the text that the ids stand for. A null list decodes as null."""
    model = model or model_bytes()
    common.small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    base = df.drop("decoded")
    at = base.columns.index("ids")

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for b in batches:
            texts = [None if x is None else sp.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("decoded", T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.documents(spark, sf_dir))
