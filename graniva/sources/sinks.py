"""Sinks: JSON documents, CSV, itemsets, communities and scored edges."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of a table that a JSON document may hold.
DOCUMENT_ROWS = 100_000


def json_document(values: dict[str, DataFrame | int | float | str], path: str, most: int = DOCUMENT_ROWS) -> None:
    """One JSON document, indented by 2; a DataFrame of one cell becomes its value, any other (a bounded report) a list of rows.

    A report of more than ``most`` rows isn't one for a document on the driver, and raises.
    """
    out = {}
    for k, v in values.items():
        if isinstance(v, DataFrame):
            rows = [list(r) for r in v.limit(most + 1).collect()]
            if len(rows) > most:
                raise ValueError(f"{k} has more than {most} rows; write it as CSV")
            out[k] = rows[0][0] if len(rows) == 1 and len(rows[0]) == 1 else rows
        else:
            out[k] = v
    with open(path, "w") as f:
        json.dump(out, f, indent=2)


def csv(df: DataFrame, path: str) -> None:
    """CSV files with header in a folder."""
    kept = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    df.write.mode("overwrite").options(**kept).csv(path)


def _text(lines: DataFrame, order: list, path: str, single: bool) -> None:
    ordered = lines.orderBy(*order).select("value")
    (ordered.coalesce(1) if single else ordered).write.mode("overwrite").text(path)


def itemset_lines(sets: DataFrame) -> DataFrame:
    """(size, value): all itemsets of one size in one line, ('a', 'b') sorted, separated by commas."""
    one = quoted_sets(sets)
    return one.groupBy("size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("items", "value"))), lambda v: v["value"]), ",").alias("value"))


def quoted_sets(sets: DataFrame) -> DataFrame:
    """(size, items, value): each itemset as ('a', 'b')."""
    quoted = F.array_join(F.transform("items", lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", ")
    return sets.select(F.size("items").alias("size"), "items", F.concat(F.lit("("), quoted, F.lit(")")).alias("value"))


def itemsets(sets: DataFrame, path: str, single: bool = True) -> None:
    """Itemsets as text, a line and a blank line for each size.

    With ``single`` all of a size stand in one line of one file, as a report; else, for results of any size, each itemset has a
    line of its own, in files that are sorted by size and items.
    """
    if single:
        _text(itemset_lines(sets).select("size", F.concat("value", F.lit("\n")).alias("value")), ["size"], path, True)
    else:
        _text(quoted_sets(sets), ["size", "items"], path, False)


def communities(groups: DataFrame, path: str, single: bool = True) -> None:
    """One community per line, members quoted, by size and first member; in one file, or in files of a distributed sort."""
    quoted = F.array_join(F.transform("members", lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", ")
    _text(groups.select("size", F.col("members")[0].alias("first"), quoted.alias("value")), ["size", "first"], path, single)


def clustering(labels: DataFrame, rounds: DataFrame, path: str) -> None:
    """Round log and labels of a clustering: ``rounds`` as lines 'Round i: discard,clusters,points,retained', ``labels`` as lines index,label."""
    log = F.format_string("Round %d: %d,%d,%d,%d", "round", "ds_points", "cs_clusters", "cs_points", "rs_points")
    _text(rounds.select("round", log.alias("value")), ["round"], f"{path}/rounds", True)
    _text(labels.select("point_id", F.concat_ws(",", "point_id", "label").alias("value")), ["point_id"], f"{path}/labels", False)


def reservoir(snapshots: DataFrame, path: str, slots: tuple[int, ...] = (0, 20, 40, 60, 80)) -> None:
    """Snapshots of a reservoir as CSV of seqnum and one column for each slot."""
    csv(reservoir_table(snapshots, slots).orderBy("seqnum"), path)


def reservoir_table(snapshots: DataFrame, slots: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """(seqnum, slot_0, slot_20, …): a row for each snapshot."""
    return snapshots.groupBy("seqnum").agg(*[F.max(F.when(F.col("slot") == s, F.col("element"))).alias(f"slot_{s}") for s in slots])


def edge_scores(edges: DataFrame, path: str, single: bool = True) -> None:
    """('a', 'b'),score per line with 5 digits, highest first, then by both ends; in one file, or in files of a distributed sort."""
    score = F.bround("betweenness", 5)  # half to even
    value = F.format_string("('%s', '%s'),%s", "src", "dst", score.cast("string"))
    _text(edges.select(score.alias("s"), "src", "dst", value.alias("value")), [F.desc("s"), "src", "dst"], path, single)
