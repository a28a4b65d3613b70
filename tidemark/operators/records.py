"""From raw posts to typed records (P1-P11) and row filters."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import text as X
from tidemark.functions import vectors as V

REPLY, QUOTE = "in_reply_to_status_id_str_h", "quoted_status_id_str_h"



def post_type(reply: Column, retweeted: Column, quoted: Column, null_is_reply: bool = False) -> Column:
    """R before t before q before n. An empty reply id is none; with ``null_is_reply`` a null one is a reply."""
    is_reply = reply.isNull() if null_is_reply else F.lit(False)
    return F.when(is_reply | (F.coalesce(reply, F.lit("")) != ""), "r").when(retweeted.isNotNull(), "t").when(quoted.isNotNull(), "q").otherwise("n")


def typed(posts: DataFrame, reply: str = REPLY, null_is_reply: bool = False) -> DataFrame:
    """Posts with tw_id, usr_id, lang, tw_type, tw_datetime and tw_src_id columns."""
    kind = post_type(F.col(reply), F.col("retweeted_status"), F.col("quoted_status"), null_is_reply)
    source = F.when(F.col("tw_type") == "r", F.nullif(F.col(reply), F.lit(""))).when(F.col("tw_type") == "q", F.coalesce(F.col(QUOTE), F.col("quoted_status.id_str_h"))).when(F.col("tw_type") == "t", F.col("retweeted_status.id_str_h"))
    return (
        posts.withColumn("tw_type", kind)
        .withColumn("tw_id", F.col("id_str_h"))
        .withColumn("usr_id", F.col("user.id_str_h"))
        .withColumn("tw_datetime", X.stamp(X.created_at(F.col("created_at"))))
        .withColumn("tw_src_id", source)
    )


def raw_text(tw_type: Column, lang: Column) -> Column:
    """English posts have their full text or else their text, a retweet that of the retweeted post; others have a translation."""
    own = F.coalesce(F.col("full_text_m"), F.col("text_m"))
    other = F.coalesce(F.col("retweeted_status.full_text_m"), F.col("retweeted_status.text_m"))
    return F.when(lang == "en", F.when(tw_type == "t", other).otherwise(own)).otherwise(F.col("extension.google_translation_m"))


def text_lists(posts: DataFrame) -> DataFrame:
    """Raw (own lines, then the quoted post's) and org (own lines; of a retweet none). Needs tw_type."""
    own = X.split_lines(F.coalesce("full_text_m", "text_m"))
    quoted = X.split_lines(F.coalesce("quoted_status.full_text_m", "quoted_status.text_m"))
    empty = F.array().cast("array<string>")
    return posts.withColumn("raw", F.concat(own, F.when(F.col("tw_type") == "q", quoted).otherwise(empty))).withColumn("org", F.when(F.col("tw_type") == "t", empty).otherwise(own))


def source_users(posts: DataFrame, users: DataFrame) -> DataFrame:
    """P5: src_usr_id of a post's source by a look-up of posts (tw_id, usr_id); '' where it isn't known."""
    known = users.groupBy(F.col("tw_id").alias("tw_src_id")).agg(F.min("usr_id").alias("src_usr_id"))
    return posts.join(known, "tw_src_id", "left").withColumn("src_usr_id", F.coalesce("src_usr_id", F.lit("")))


def narrative_codes(names: Column, codes: Mapping[str, int], unknown: str = "error") -> Column:
    """Names as codes. An unknown name is an error, or (``null``) makes the list null."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]).cast("map<string,int>")
    found = F.transform(names, lambda n: F.element_at(table, n))
    strange = F.exists(found, lambda i: i.isNull())
    return F.when(strange, F.raise_error(F.lit("unknown narrative")).cast("array<int>") if unknown == "error" else F.lit(None)).otherwise(found)


def stances() -> Column:
    """[am, pm, ?] as numbers; null without the struct."""
    s = F.col("extension.supervised_stance")
    return F.when(s.isNotNull(), F.array(*[s.getField(k).try_cast("double") for k in ("am", "pm", "?")]))


def sentiments() -> Column:
    """[positive, negative, neutral]; N/A is null."""
    s = F.col("extension.sentiment_scores")
    return F.when(s.isNotNull(), F.array(*[F.when(s[k] != "N/A", s[k].try_cast("double")) for k in ("positive", "negative", "neutral")]))


def parsed(posts: DataFrame, codes: Mapping[str, int]) -> DataFrame:
    """English or translated posts with all their fields: tw_id, usr_id, tw_type, tw_src_id, tw_datetime, raw_txt, nars."""
    rows = typed(posts)
    rows = rows.withColumn("raw_txt", raw_text(F.col("tw_type"), F.col("lang"))).withColumn("nars", narrative_codes(F.col("extension.supervised_narratives"), codes))
    whole = F.col("usr_id").isNotNull() & F.col("tw_datetime").isNotNull() & F.col("raw_txt").isNotNull() & ((F.col("tw_type") == "n") | F.col("tw_src_id").isNotNull()) & (F.size("nars") > 0)
    return rows.filter(whole).select("tw_id", "usr_id", "tw_type", "tw_src_id", "tw_datetime", "raw_txt", "nars")


def profile_posts(posts: DataFrame, codes: Mapping[str, int], start: str | None = None, end: str | None = None) -> DataFrame:
    """Posts of any language: tw_id, usr_id, tw_type, tw_src_id, tw_datetime, l_nars (null if empty), l_stances, l_sentiments. Bounds are inclusive."""
    rows = typed(posts)
    nars = narrative_codes(F.col("extension.supervised_narratives"), codes)
    rows = rows.withColumn("l_nars", F.when(F.size(nars) > 0, nars)).withColumn("l_stances", stances()).withColumn("l_sentiments", sentiments())
    for bound, test in ((start, lambda c: c >= F.lit(start)), (end, lambda c: c <= F.lit(end))):
        rows = rows.filter(test(F.col("tw_datetime"))) if bound is not None else rows
    return rows.select("tw_id", "usr_id", "tw_type", "tw_src_id", "tw_datetime", "l_nars", "l_stances", "l_sentiments")


def interval_records(posts: DataFrame) -> DataFrame:
    """Uid, tid, time, type, src, raw, raw_cln, org, org_cln."""
    rows = text_lists(typed(posts, reply="in_reply_to_status_id_h"))
    clean = lambda c: F.transform(c, lambda t: F.array_join(X.sentence_words(t), "\n"))
    return rows.select(F.col("usr_id").alias("uid"), F.col("tw_id").alias("tid"), F.col("tw_datetime").alias("time"), F.col("tw_type").alias("type"), F.col("tw_src_id").alias("src"), "raw", clean(F.col("raw")).alias("raw_cln"), "org", clean(F.col("org")).alias("org_cln"))


def labelled_vectors(rows: DataFrame) -> DataFrame:
    """P10: vectors by language: Spanish rows take the Spanish one first, others the English one; rows without narratives or a vector go."""
    pick = lambda k: F.when(F.col("lang") == "es", F.coalesce(f"{k}_es", f"{k}_en")).otherwise(F.coalesce(f"{k}_en", f"{k}_es"))
    out = rows.withColumn("ft_vec", pick("ft_vec")).withColumn("topic_vec", pick("topic_vec")).withColumn("single_nar", F.size("man_nar") == 1)
    return out.filter((F.size("man_nar") > 0) & F.col("ft_vec").isNotNull() & F.col("topic_vec").isNotNull())


# -------------------------------------------------------------------- filters


def clean_rows(df: DataFrame) -> DataFrame:
    """not a retweet of a known post, and with clean text."""
    return df.filter(~F.col("tref") & F.col("clean_txt").isNotNull())


def selected(df: DataFrame, users: DataFrame | None = None, types: Sequence[str] = (), start: str | None = None, end: str | None = None) -> DataFrame:
    """users in a table (none given: all), types in a list, 14-digit times in [start, end]."""
    df = df.join(users.select("usr_id").distinct(), "usr_id", "left_semi") if users is not None else df
    df = df.filter(F.col("tw_type").isin(*types)) if types else df
    df = df.filter(F.col("tw_datetime") >= start) if start is not None else df
    return df.filter(F.col("tw_datetime") <= end) if end is not None else df


def in_range(df: DataFrame, col: str, start, end, closed: str = "both") -> DataFrame:
    """``closed`` is both, left or right."""
    c = F.col(col)
    return df.filter((c >= F.lit(start) if closed in ("both", "left") else c > F.lit(start)) & (c <= F.lit(end) if closed in ("both", "right") else c < F.lit(end)))


def counted_between(df: DataFrame, key: str, low: int, high: int | None = None, name: str = "n") -> DataFrame:
    """Keys with at least ``low`` rows (and at most ``high``), most first."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) >= low)
    n = n.filter(F.col(name) <= high) if high is not None else n
    return n.orderBy(F.desc(name), key)


def large_groups(df: DataFrame, key: str, least: int) -> DataFrame:
    """rows of keys that have at least ``least`` rows."""
    big = df.groupBy(key).count().filter(F.col("count") >= least).select(key)
    return df.join(big, key, "left_semi")


def heavy_edges(edges: DataFrame, least: float, col: str = "weight") -> DataFrame:
    """edges whose weight is a number of at least ``least``, heaviest first."""
    return edges.withColumn(col, F.col(col).try_cast("double")).filter(F.col(col) >= least).orderBy(F.desc(col), "src", "trg")


def stance_counts(df: DataFrame, cols: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """rows where one score alone reaches the threshold, by score, and all rows, nulls included."""
    hit = lambda c: F.coalesce(F.col(c) >= threshold, F.lit(False))
    alone = [F.count_if(hit(c) & ~F.greatest(*[hit(o) for o in cols if o != c], F.lit(False))).alias(f"n_{c}") for c in cols]
    return df.agg(*alone, F.count(F.lit(1)).alias("total"))


def exact_sample(df: DataFrame, rate: float, key: str, order: Column | None = None, seed: int = 0) -> DataFrame:
    """exactly ceil(n * rate) rows without replacement, in the given order, or that of a seeded hash of the key."""
    hashed = df.withColumn("_h", order if order is not None else F.xxhash64(F.lit(seed), F.col(key)))
    want = math.ceil(df.count() * rate)
    return hashed.orderBy("_h", key).limit(want).drop("_h")


def stratified_sample(df: DataFrame, stratum: str, per: int, least: int, order: Sequence[Column | str]) -> DataFrame:
    """``per`` rows of each stratum that has at least ``least``, in the given order. Spark keeps only ``per`` rows a task before the shuffle."""
    rows = large_groups(df, stratum, least)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(stratum).orderBy(*order))).filter(F.col("_r") <= per).drop("_r")


def originals(df: DataFrame) -> DataFrame:
    """F11."""
    return df.filter("tw_type = 'n'").select("tw_id", "usr_id", "tw_datetime")


def equal_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    """share of rows where two columns are equal."""
    return df.agg(F.avg(F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("double")).alias("ratio"))


def zero_filled(df: DataFrame, col: str, n: int) -> DataFrame:
    """Missing and invalid vectors as zeros."""
    return df.withColumn(col, V.or_zeros(F.col(col), n))


