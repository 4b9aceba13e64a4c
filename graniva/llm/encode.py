"""Encoding a corpus with a byte-level BPE tokenizer through a table of distinct words."""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniva.plans.stage import fits, materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The white space of Unicode, and the contractions split off by the tokenizer's public pattern.
_SPACE = r"\t-\r \x85\xa0  -     　"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD = rf"{_CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Code points without a class in the JVM's Unicode version, which may have one in the tokenizer's.
_UNKNOWN = r"\p{Cn}"
#: Most frequent words that are broadcast where the whole table of words is too large.
HOT_WORDS = 100_000


def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.encode_special_tokens = True  # their strings are ordinary text
    return t


def _split_python(spec: str, names: list[str]):
    def run(batches):
        split = _tokenizer(spec).pre_tokenizer.pre_tokenize_str
        for batch in batches:
            words = pa.array([[t[a:b] for _, (a, b) in split(t)] for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), words], names=names)

    return run


def _encode(spec: str):
    def run(batches):
        t = _tokenizer(spec)
        for pdf in batches:
            ids = [e.ids for e in t.encode_batch(list(pdf["word"]), add_special_tokens=False)]
            yield pd.DataFrame({"word": pdf["word"], "n": pdf["n"], "ids": ids})

    return run


def split_words(docs: DataFrame, text: str, spec: str, keep: list[Column]) -> DataFrame:
    """(key, kept columns, words): the words of each text in order, split once and staged; null and empty texts have none.

    Words are split in the JVM; texts with code points unknown to its Unicode version by the tokenizer's own splitter.
    """
    base = docs.select(F.monotonically_increasing_id().alias("key"), *keep, F.col(text).alias("__text"))
    odd = F.coalesce(F.col("__text").rlike(_UNKNOWN), F.lit(False))
    plain = base.filter(~odd).select(*base.columns[:-1], F.regexp_extract_all("__text", F.lit(_WORD), 0).alias("words"))
    schema = T.StructType([*base.schema.fields[:-1], T.StructField("words", T.ArrayType(T.StringType()))])
    return materialize(plain.unionByName(base.filter(odd).mapInArrow(_split_python(spec, schema.names), schema)), "split")


def word_table(split: DataFrame, spec: str) -> DataFrame:
    """Distinct words with their number and ids (word, n, ids), each encoded once; staged."""
    distinct = split.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return materialize(distinct.mapInPandas(_encode(spec), "word string, n long, ids array<int>"), "words")


def _runs(build):
    """Arrow batches to one row for each run of equal keys in the first column; a run may go on in the next batch.

    The rows of one text come from one exploded row through joins with broadcasts, which keep their order, so that each
    text is one run and needs no shuffle to come together again.
    """

    def emit(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [c.combine_chunks() for c in pa.Table.from_batches(parts).columns]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        key = columns[0].to_numpy(zero_copy_only=False)
        return build(columns, np.flatnonzero(np.r_[True, key[1:] != key[:-1]]))

    def run(batches):
        pending, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy(zero_copy_only=False)
            if pending and key[0] != last:
                yield emit(pending)
                pending = []
            change = np.flatnonzero(key[1:] != key[:-1])
            tail = int(change[-1]) + 1 if len(change) else 0
            if tail:
                yield emit([*pending, b.slice(0, tail)])
                pending = []
            pending.append(b.slice(tail))
            last = key[-1]
        if pending:
            yield emit(pending)

    return run


def _offsets(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    ends = np.r_[0, np.cumsum(lengths)]
    return ends[np.r_[starts, len(lengths)]].astype(np.int32)


def _lists(names: list[str]):
    """Kept columns, then the lists of the last column of a run as one list."""

    def build(columns: list[pa.Array], starts: np.ndarray) -> pa.RecordBatch:
        ids = columns[-1]
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        joined = pa.ListArray.from_arrays(pa.array(_offsets(lengths, starts)), ids.flatten())
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(starts)) for c in columns[1:-1]), joined], names=names)

    return build


def _join_back(split: DataFrame, table: DataFrame, value: Column, limit: int | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """Kept columns and ``ids``: the lists ``value`` of all words of a text in order, joined back by the words.

    The table of words is broadcast if its measured size allows it. Else its most frequent words are; the other words are
    shuffled, and only texts that have such words are joined with them.
    """
    keep = [f for f in split.schema.fields if f.name not in ("key", "words")]
    names = [f.name for f in keep]
    words = split.select("key", *names, F.posexplode_outer("words").alias("pos", "word"))
    kind = T.ArrayType(T.IntegerType())
    if fits(table, limit):
        known = words.join(F.broadcast(table.select("word", value.alias("value"))), "word", "left").select("key", *names, "value")
        return known.mapInArrow(_runs(_lists([*names, "ids"])), T.StructType([*keep, T.StructField("ids", kind)]))
    hot = materialize(table.orderBy(F.desc("n"), "word").limit(hot_words).select("word", value.alias("value")), "hot_words")
    first = words.join(F.broadcast(hot), "word", "left")
    rare = F.col("word").isNotNull() & F.col("value").isNull()
    parts = F.when(F.col("value").isNotNull(), F.array(F.struct("pos", F.col("value").alias("ids")))).when(rare, F.array(F.struct("pos", F.lit(None).cast(kind).alias("ids"))))
    element = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("ids", kind)])
    schema = T.StructType([T.StructField("key", T.LongType()), *keep, T.StructField("parts", T.ArrayType(element))])
    whole = first.select("key", F.col("key").alias("__key"), *names, parts.alias("parts")).mapInArrow(_runs(_lists(schema.names)), schema)
    whole = materialize(whole.withColumn("open", F.exists("parts", lambda x: x["ids"].isNull())), "known")
    others = first.filter(rare).select("key", "pos", "word").hint("merge").join(table.select("word", value.alias("ids")), "word")
    others = others.groupBy("key").agg(F.collect_list(F.struct("pos", "ids")).alias("more"))
    closed = whole.filter("not open").select(*names, F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
    both = F.array_sort(F.concat(F.filter("parts", lambda x: x["ids"].isNotNull()), "more"), lambda a, b: a["pos"] - b["pos"])
    opened = whole.filter("open").hint("merge").join(others, "key").select(*names, F.flatten(F.transform(both, lambda x: x["ids"])).alias("ids"))
    return closed.unionByName(opened)


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, *, limit: int | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """Token ids of each text: (doc_id, ids array<int>), one row for every row of ``docs``.

    No special tokens are added, and their strings are encoded as ordinary text. Empty and null texts have
    an empty list; rows with a null or repeated id keep one row each. An empty table gives no rows; extra
    columns are ignored. Whole texts are encoded, whatever their length.
    """
    spec = Path(tokenizer).read_text()
    split = split_words(docs, text, spec, [F.col(doc_id).alias("doc_id")])
    return _join_back(split, word_table(split, spec), F.col("ids"), limit, hot_words)


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER, *, limit: int | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """Columns ``keep`` and ``n_tokens`` of each row; null and empty texts have 0."""
    spec = Path(tokenizer).read_text()
    split = split_words(docs, text, spec, [F.col(c) for c in keep])
    sizes = _join_back(split, word_table(split, spec), F.array(F.size("ids")), limit, hot_words)
    return sizes.select(*keep, F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_tokens"))


def pieces(spark: SparkSession, tokenizer: str = TOKENIZER) -> DataFrame:
    """The vocabulary as (id, piece): the bytes of each piece. Its size is that of the tokenizer."""
    vocab = json.loads(Path(tokenizer).read_text())["model"]["vocab"]
    # the public byte-to-character rule of byte-level BPE: printable Latin-1 characters stand for themselves, the others follow from U+0100
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    rows = [(i, bytes(byte[c] for c in p) if all(c in byte for c in p) else p.encode()) for p, i in vocab.items()]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode_corpus(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """Texts of lists of ids: (doc_id, text), by a join of the ids with their pieces. Empty and null lists give an empty text."""
    base = encoded.select(F.monotonically_increasing_id().alias("key"), F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    base = base.select("key", "doc_id", F.explode_outer("ids").alias("id"))
    joined = base.join(F.broadcast(pieces(encoded.sparkSession, tokenizer)), "id", "left").select("key", "doc_id", "piece")
    schema = T.StructType([joined.schema["doc_id"], T.StructField("bytes", T.BinaryType())])
    return joined.mapInArrow(_runs(_bytes), schema).select("doc_id", F.decode("bytes", "UTF-8").alias("text"))


def _bytes(columns: list[pa.Array], starts: np.ndarray) -> pa.RecordBatch:
    """(doc_id, bytes): the pieces of a run are already one after the other in the buffer of their array."""
    pieces = pc.fill_null(columns[-1], b"")
    lengths = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
    data = pa.py_buffer(b"".join(pieces.to_pylist()))
    joined = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(_offsets(lengths, starts)), data])
    return pa.RecordBatch.from_arrays([columns[1].take(pa.array(starts)), joined], names=["doc_id", "bytes"])
