"""Token counts of whole texts by the whole-token shortcut.

The vocabulary holds no piece with a word-start mark after another character, so merges never cross the
border in front of a run of blanks: a text splits there into pre-tokens that encode independently. For each
vocabulary string that is such a pre-token, the library shows once, on the driver, whether it encodes alone as
one token. Pre-tokens among the proven strings count one each; only the others go through the merges.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
LIMIT = 4096
split_pretokens = re.compile(" +[^ ]*").findall


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def proven_singles(model: bytes) -> frozenset[str]:
    """Pre-tokens (blanks, then others) that the library encodes alone as exactly one token.

    The proof runs once for a model in a process. Raises ValueError for a vocabulary whose pieces cross pre-token borders: the shortcut would be wrong there.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    found = set()
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = sp.id_to_piece(i)
        if re.search(f"[^{MARK}]{MARK}", piece):
            raise ValueError(f"piece {i} crosses a word border")
        if piece[0] == MARK and sp.encode(piece[1:].replace(MARK, " ")) == [i]:
            found.add(piece.replace(MARK, " "))
    return frozenset(found)


def counter(model: bytes, singles: frozenset[str]):
    """A function from a text to its number of tokens."""
    import sentencepiece

    encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode

    blank = len(encode("a ")) - len(encode("a"))  # a last lone blank, which the library would take for an empty text

    def count(text: str) -> int:
        if not text:
            return 0
        parts = split_pretokens(" " + text.replace(MARK, " "))
        rest = [p for p in parts if p not in singles]
        # the library puts the first blank in front by itself
        if rest == [" "]:
            return len(parts) - 1 + blank
        return len(parts) - len(rest) + (len(encode("".join(rest)[1:])) if rest else 0)

    return count


def count_tokens(df: DataFrame, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of df; one pass without a shuffle."""
    spark = df.sparkSession
    common.small_batches(spark)
    model = model or model_bytes()
    shared = spark.sparkContext.broadcast((model, proven_singles(model)))

    def run(batches):
        count = counter(*shared.value)
        for b in batches:
            texts = b.column(1)
            n = [count(t) for t in texts.to_pylist()]
            size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pa.compute.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir))
