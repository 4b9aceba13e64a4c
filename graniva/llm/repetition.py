"""Repetition inside single documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniva.plans.stage import materialize

_SIGN = r"\p{Han}\p{Hiragana}\p{Katakana}"
_WORD = rf"[{_SIGN}]|[[\p{{L}}\p{{N}}]--[{_SIGN}]]+"
_MEASURES = [("n_words", T.LongType()), ("repeated_words", T.LongType()), ("sentence_share", T.DoubleType()), ("paragraph_share", T.DoubleType())]


def repeated_words(ids: np.ndarray, span: int) -> int:
    """Number of words inside ``span`` consecutive words that also begin at an earlier word."""
    n = len(ids) - span + 1
    if n < 2:
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, span)
    powers = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(span)], np.uint64)
    with np.errstate(over="ignore"):
        h = (windows.astype(np.uint64) + np.uint64(1)) @ powers
    _, first, where = np.unique(h, return_index=True, return_inverse=True)
    at = np.nonzero(first[where] < np.arange(n))[0]
    at = at[(windows[at] == windows[first[where[at]]]).all(1)]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + span, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def most_repeated_words(words: list[str], span: int) -> int:
    """An upper bound of :func:`repeated_words` without their windows.

    Every run of three words inside a repeated window began before. A stretch of repeated words is covered by windows that each
    begin ``span - 2`` such runs, so it has at most ``span / (span - 2)`` words for each of them.
    """
    size = min(3, span)
    again = len(words) + 1 - size - len(set(zip(*(words[i:] for i in range(size)))))
    return min(len(words), again * span // (span + 1 - size)) if again > 0 else 0


def _repeated_share(parts: list[str]) -> float:
    """Share of the characters of ``parts`` in parts that occurred before."""
    seen, again, total = set(), 0, 0
    for p in parts:
        p = " ".join(p.split()).lower()
        total += len(p)
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def _measure(span: int, kept: int, schema: list[str]):
    def run(batches):
        import regex

        word = regex.compile(_WORD, regex.V1)
        stop = regex.compile(r"[.!?。！？…]+\s*|\n+")
        gap = regex.compile(r"\n\s*\n")
        for batch in batches:
            rows = []
            for text in batch.column(kept).to_pylist():
                text = text or ""
                known: dict[str, int] = {}
                ids = np.array([known.setdefault(w, len(known)) for w in word.findall(text.lower())], np.int64)
                rows.append((len(ids), repeated_words(ids, span), _repeated_share(stop.split(text)), _repeated_share(gap.split(text))))
            new = list(zip(*rows)) or [()] * 4
            arrays = [batch.column(i) for i in range(kept)] + [pa.array(x, t) for x, t in zip(new, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema)

    return run


def _bound(span: int, kept: int, least: float, schema: list[str]):
    def run(batches):
        import regex

        word = regex.compile(_WORD, regex.V1)
        for batch in batches:
            texts, n_words, shares = [], [], []
            for text in batch.column(kept).to_pylist():
                words = word.findall((text or "").lower())
                share = most_repeated_words(words, span) / len(words) if words else 0.0
                texts.append(text if share >= least else None)
                n_words.append(len(words))
                shares.append(share)
            new = [pa.array(texts, batch.column(kept).type), pa.array(n_words, pa.int64()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(kept)] + new, names=schema)

    return run


def repetition_bounds(docs: DataFrame, keep: list[str], text: str = "text", span: int = 8, least: float = 0.0) -> DataFrame:
    """Columns ``keep``, ``text``, ``n_words`` and ``most_share``, which ``word_share`` of :func:`repetition_shares` never exceeds.

    A fast first look at all texts, for which to measure: ``text`` is null where ``most_share`` is below ``least``.
    One row for every row; null, empty and wordless texts have a share of 0.
    """
    base = docs.select(*keep, F.col(text).alias("text"))
    schema = T.StructType([*base.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("most_share", T.DoubleType())])
    return base.mapInArrow(_bound(span, len(keep), least, schema.names), schema)


def repetition_shares(docs: DataFrame, keep: list[str], text: str = "text", span: int = 8) -> DataFrame:
    """Columns ``keep``, ``n_words``, ``repeated_words`` and the repeated shares of words, sentences and paragraphs of each text.

    Words are runs of letters or digits in lower case; each Han or kana sign is a word. A word is repeated when
    it lies in ``span`` consecutive words that also begin at an earlier word of the text. Sentences and
    paragraphs are repeated from their second occurrence on, weighted by their characters. Null, empty and
    wordless texts have shares of 0. One row for every row, extra columns ignored; whole texts are measured.
    """
    base = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType(base.schema.fields[:-1] + [T.StructField(n, t) for n, t in _MEASURES])
    out = base.mapInArrow(_measure(span, len(keep), schema.names), schema)
    return out.withColumn("word_share", F.when(F.col("n_words") > 0, F.col("repeated_words") / F.col("n_words")).otherwise(F.lit(0.0)))


def flag_repetition(shares: DataFrame, groups: list[str], measure: str = "word_share", quantile: float = 0.98, floor: float = 0.30, ceiling: float = 0.30, accuracy: int = 2000) -> DataFrame:
    """Rows of ``shares`` with the ``threshold`` of their group and whether they reach it (``flagged``).

    The threshold of a group (language and source, say) is the quantile of its own shares, from a mergeable quantile
    sketch of bounded size, kept between ``floor`` and ``ceiling``; equal bounds give a fixed cutoff.
    Null group values form a group of their own. Texts without words are never flagged.
    """
    if floor > ceiling:
        raise ValueError("floor must not exceed ceiling")
    shares = materialize(shares, "shares")
    cuts = shares.filter("n_words > 0").groupBy(*groups).agg(F.percentile_approx(measure, quantile, accuracy).alias("q"))
    cuts = materialize(cuts.select(*[F.col(g).alias(f"__{g}") for g in groups], F.greatest(F.lit(floor), F.least(F.lit(ceiling), "q")).alias("threshold")), "cuts")
    on = None
    for g in groups:
        same = F.col(g).eqNullSafe(F.col(f"__{g}"))
        on = same if on is None else on & same
    joined = shares.join(cuts, on, "left").drop(*[f"__{g}" for g in groups])
    return joined.withColumn("flagged", (F.col("n_words") > 0) & F.coalesce(F.col(measure) >= F.col("threshold"), F.lit(False)))
