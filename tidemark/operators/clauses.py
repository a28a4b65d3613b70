"""Clause graphs of parsed texts as tables (G8, U1, U3): a parser only fills the table of tokens; the graph is joins over it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import text as X
from tidemark.operators.grouped import CORE_DEPENDENCIES, rule_parser
from tidemark.sources.scratch import cut, forget, shipped

_TOKEN = ["s", "i", "text", "lemma", "pos", "dep", "head", "phrase", "trivial"]


def token_table(texts: DataFrame, key: str, text: str, parser: Callable[[str], list[list[dict]]] = rule_parser) -> DataFrame:
    """(key, s, i, text, lemma, pos, dep, head, phrase, trivial): the tokens of each text's sentences, by a pluggable parser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, s, *[t[c] for c in _TOKEN[1:]]) for k, x in zip(pdf[key], pdf[text], strict=True) for s, tokens in enumerate(parser(x or "")) for t in tokens]
            yield pd.DataFrame(rows, columns=[key, *_TOKEN])

    kinds = f"{key} {dict(texts.dtypes)[key]}, s int, i int, text string, lemma string, pos string, dep string, head int, phrase string, trivial boolean"
    return shipped(texts).select(key, text).mapInPandas(run, kinds)


def clause_tables(tokens: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, s, i, txt, pos) and edges (key, s, src, trg) of all sentences' clause graphs, from a table of tokens.

    Nodes are the last root of a sentence and tokens with a core dependency, unless they are trivial; their text is the noun phrase, where
    they end one. A node hangs from its nearest ancestor that is a node, one further for ``conj``; nodes without one, and the root, are tops,
    and a sentence's tops are linked with each other, the root first.

    Nearest nodes are found by pointer doubling: a token that isn't a node points to its head, and in each round to where that points, so
    that a sentence of n tokens takes log2(n) rounds of one join by (key, s, token). Heads are taken to be trees; a head that isn't
    in the sentence leads nowhere."""
    dep = F.when(F.lower("lemma").isin(*X.NEGATIONS), "neg").otherwise(X.universal_label(F.col("dep")))
    solid = ~F.col("trivial")
    # what travels is what the graph needs: the texts of tokens that may be nodes, and of labels what is asked of them
    text = F.when(solid, F.coalesce("phrase", "lemma")).alias("txt"), F.when(solid, F.when(F.col("phrase").isNotNull(), "NOUN").otherwise(F.col("pos"))).alias("pos")
    rows = tokens.select(key, "s", "i", "head", (F.col("dep") == "ROOT").alias("root"), (dep == "conj").alias("conj"), (solid & dep.isin(*CORE_DEPENDENCIES)).alias("core"), solid.alias("solid"), *text)
    last = F.max(F.when(F.col("root"), F.col("i"))).over(W.partitionBy(key, "s"))
    rows = rows.withColumn("is_root", F.coalesce(F.col("i") == last, F.lit(False))).withColumn("kept", F.col("solid") & (F.col("is_root") | F.col("core")))
    rows = cut(rows.drop("root", "core", "solid"))
    at = cut(rows.select(key, "s", "i", F.when(F.col("kept"), F.col("i")).otherwise(F.col("head")).alias("to"), (F.col("kept") | (F.col("head") == F.col("i"))).alias("done")))
    while not at.filter("not done").isEmpty():
        far = at.select(key, "s", F.col("i").alias("to"), F.col("to").alias("_to"), F.col("done").alias("_done"))
        met = at.filter("not done").join(far, [key, "s", "to"], "left")
        # nowhere, or round in a circle: it ends
        step = met.select(key, "s", "i", F.coalesce("_to", "to").alias("to"), (F.coalesce("_done", F.lit(True)) | (F.col("_to") == F.col("to")) | (F.col("_to") == F.col("i"))).alias("done"))
        after = cut(at.filter("done").unionByName(step))
        forget(at)
        at = after
    nearest = at.join(rows.filter("kept").select(key, "s", F.col("i").alias("to")), [key, "s", "to"])  # (token, its nearest node upwards, itself included)
    up = lambda a, b: nearest.select(key, "s", F.col("i").alias(a), F.col("to").alias(b))
    heads = rows.select(key, "s", F.col("i").alias("first"), F.col("head").alias("above"))
    nodes = rows.filter("kept")
    hung = nodes.join(up("head", "first"), [key, "s", "head"], "left").join(heads, [key, "s", "first"], "left").join(up("above", "second"), [key, "s", "above"], "left")
    hung = hung.withColumn("src", F.when(F.col("conj"), F.col("second")).otherwise(F.col("first")))
    hung = cut(hung.withColumn("src", F.when(~F.col("is_root") & (F.col("src") != F.col("i")), F.col("src"))).select(key, "s", "i", "src", "is_root"))
    tops = hung.filter("src is null").withColumn("place", F.when(F.col("is_root"), -1).otherwise(F.col("i")))
    side = lambda a, b: tops.select(key, "s", F.col("i").alias(a), F.col("place").alias(b))
    linked = side("src", "p").join(side("trg", "q"), [key, "s"]).filter("p < q").select(key, "s", "src", "trg")
    edges = hung.filter("src is not null").select(key, "s", "src", F.col("i").alias("trg")).unionByName(linked)
    named = nodes.select(key, "s", "i", "txt", "pos")
    return named, edges
