"""Encoding of the whole corpus with a public byte-level BPE tokenizer, through a table of its distinct words.

A byte-level BPE cuts a text into words and encodes each word by itself. Spark cuts the texts, each distinct word of the corpus is
encoded once, and the ids are joined back by position: the most frequent words, a table of bounded size, within the scan of the
texts, all other words by a join on the word.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import materialize

#: Where the vocabulary files of public tokenizers are; a parameter of every function that needs them.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: How a text is cut into words: the published pattern of this tokenizer. White space is that of Unicode.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same words in fewer steps: beginnings that alternatives share are tried once, and runs of a class, which exclude each other, aren't given back.
SPARK_PATTERN = r"(?U)'(?:s|t|re|ve|m|ll|d)| ?+(?:\p{L}++|\p{N}++|[^\s\p{L}\p{N}]++)|\s+(?!\S)|\s+"
#: At most so many words of at most so many bytes are sent to every task (under 45 MB; a few MB as a rule).
FREQUENT_WORDS, FREQUENT_BYTES = 1 << 17, 64
SALTS = 16


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    """The pieces of a tokenizer and their ids."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_LOADED: dict[tuple[str, str], object] = {}


def _encoder(name: str, folder: str):
    import tiktoken

    if (name, folder) not in _LOADED:
        _LOADED[name, folder] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=vocabulary(name, folder), special_tokens={})
    return _LOADED[name, folder]


def words_of(text: Column) -> Column:
    """The words of a text in order; together they are the text. Null for null, none for an empty text."""
    return F.regexp_extract_all(text, F.lit(SPARK_PATTERN), F.lit(0))


def word_table(texts: DataFrame, text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``word, n, ids``: each distinct word of the texts, how often it occurs, and its ids. A word is counted before the shuffle, so a frequent one isn't hot."""
    counted = texts.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def encode(batches):
        enc = _encoder(name, folder)
        for b in batches:
            yield b.append_column("ids", pa.array([enc.encode_ordinary(w) for w in b["word"].to_pylist()], pa.list_(pa.int32())))

    return counted.mapInArrow(encode, "word string, n bigint, ids array<int>")


class _Frequent:
    """The frequent words, ordered, with their ids in one flat array."""

    def __init__(self, words: pa.Array, ids: pa.ListArray):
        self.words = words
        self.flat = ids.flatten().to_numpy()
        self.start = ids.offsets.to_numpy()
        self.size = np.diff(self.start)

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word, or -1."""
        import pyarrow.compute as pc

        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()


def _frequent(table: DataFrame, limit: int) -> tuple[object, bool]:
    """(the frequent words, broadcast; whether there are others)."""
    top = table.where(F.octet_length("word") <= FREQUENT_BYTES).orderBy(F.desc("n"), "word").limit(limit).select("word", "ids").toArrow()
    others = table.count() > top.num_rows
    top = top.combine_chunks()
    if not top.num_rows:
        found = _Frequent(pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())))
    else:
        found = _Frequent(top["word"].chunk(0), top["ids"].chunk(0))
    return table.sparkSession.sparkContext.broadcast(found), others


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    at = np.cumsum(size) - size
    return np.repeat(start - at, size) + np.arange(int(size.sum()))


def _place(found: _Frequent, batch: pa.RecordBatch, counts: bool):
    """For each text: its ids (or their number), -1 in the place of each other word, and those words in order."""
    words = batch["words"]
    lengths = words.value_lengths().fill_null(0).to_numpy()
    code = words.flatten().dictionary_encode()
    number = found.find(code.dictionary)
    flat = number[code.indices.to_numpy()] if len(code) else np.empty(0, np.int64)
    known = flat >= 0
    ends = np.r_[0, np.cumsum(lengths)]
    size = np.where(known, found.size[flat] if len(found.size) else 0, 0 if counts else 1).astype(np.int64)
    total = np.r_[0, np.cumsum(size)]
    if counts:
        out = pa.array(total[ends[1:]] - total[ends[:-1]])
    else:
        pos = _spread(np.where(known, found.start[flat] if len(found.size) else 0, 0), size)
        ids = found.flat[pos] if len(found.flat) else np.full(len(pos), -1, np.int32)
        ids = np.where(np.repeat(known, size), ids, -1).astype(np.int32)
        out = pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(ids))
    rest = np.flatnonzero(~known)
    rest_ends = np.searchsorted(rest, ends).astype(np.int32)
    others = pa.ListArray.from_arrays(pa.array(rest_ends), code.take(pa.array(rest)).dictionary_decode() if len(rest) else pa.array([], pa.string()))
    return out, others


def encode_texts(texts: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", counts: bool = False, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, frequent: int = FREQUENT_WORDS, table: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, *keep, out``: the ids of each text without special tokens, or with ``counts`` how many there are.

    A null and an empty text have no ids: an empty list, or 0. The strings of special tokens are ordinary text. Rows are never
    merged, whatever their key; other columns are ignored. ``table`` may hold the words (see ``word_table``).
    """
    spark = texts.sparkSession
    table = materialize(word_table(texts, text, name, folder), "words") if table is None else table
    found, others = _frequent(table, frequent)
    kind = T.LongType() if counts else T.ArrayType(T.IntegerType())
    cut = texts.select(F.col(key).alias("key"), *(F.col(c).alias(f"keep_{c}") for c in keep), words_of(F.col(text)).alias("words"))
    kept = [c for c in cut.columns if c != "words"]
    fields = [cut.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("out", kind)] + [T.StructField("others", T.ArrayType(T.StringType()))] * others)

    def place(batches):
        for b in batches:
            result, rest = _place(found.value, b, counts)
            yield pa.RecordBatch.from_arrays([b[c] for c in kept] + [result] + [rest] * others, names=[*kept, "out"] + ["others"] * others)

    placed = cut.mapInArrow(place, schema)
    if others:
        placed = _fill(materialize(placed.withColumn("row", F.monotonically_increasing_id()), "placed"), table, counts)
    return placed.select(F.col("key").alias(key), *(F.col(f"keep_{c}").alias(c) for c in keep), F.col("out").alias(out))


def _fill(placed: DataFrame, table: DataFrame, counts: bool) -> DataFrame:
    """The ids of the words that are not frequent, joined on the word and put back in their places."""
    # a word that is too long to be sent may be as frequent as any, a ruler of dashes for one, so such words are joined over salts
    long_ = F.octet_length("word") > FREQUENT_BYTES
    asked = placed.where(F.size("others") > 0).select("row", F.posexplode("others").alias("slot", "word"))
    asked = asked.withColumn("salt", F.when(long_, F.pmod(F.xxhash64("row", "slot"), F.lit(SALTS))).otherwise(0).cast("int"))
    words = table.select("word", "ids", F.explode(F.when(long_, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    got = asked.join(words, ["word", "salt"])
    if counts:
        more = got.groupBy("row").agg(F.sum(F.size("ids")).alias("more"))
        return placed.join(more, "row", "left").withColumn("out", F.col("out") + F.coalesce("more", F.lit(0)))
    slots = got.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slot", "ids"))).alias("slots"))
    both = placed.join(slots, "row", "left").select(*[c for c in placed.columns if c not in ("out", "others")], "out", F.transform("slots", lambda s: s["ids"]).alias("slots"))
    kept = [c for c in both.columns if c != "slots"]

    def fill(batches):
        for b in batches:
            ids, lists = b["out"].flatten().to_numpy(), b["slots"].flatten()
            start, size = np.arange(len(ids)), np.ones(len(ids), np.int64)
            holes = np.flatnonzero(ids < 0)
            size[holes] = lists.value_lengths().to_numpy()
            start[holes] = len(ids) + lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            flat = np.concatenate([ids, lists.flatten().to_numpy()])[_spread(start, size)].astype(np.int32)
            total = np.r_[0, np.cumsum(size)]
            ends = np.r_[0, np.cumsum(b["out"].value_lengths().to_numpy())]
            out = pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([out if c == "out" else b[c] for c in kept], names=kept)

    return both.mapInArrow(fill, both.select(*kept).schema)


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", out: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key, out``: the texts of lists of ids, by a join of ids and pieces (the vocabulary, of fixed size, is broadcast).

    Null or empty lists give an empty text, ids that the vocabulary doesn't have are skipped. Bytes that aren't UTF-8 become U+FFFD.
    """
    spark: SparkSession = encoded.sparkSession
    pieces = spark.createDataFrame([(i, bytearray(p)) for p, i in vocabulary(name, folder).items()], "id int, piece binary")
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "encoded")
    each = rows.select("row", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces), "id")
    # a run of positions becomes one binary before the shuffle by text ends
    joined = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("piece")))).alias("p"))
    text = joined.select("row", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")), "UTF-8").alias("t"))
    return rows.join(text, "row", "left").select(F.col("key").alias(key), F.coalesce("t", F.lit("")).alias(out))
