"""Parsing, cleaning and filters on literal fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import records as R
from tidemark.sources import tables as S


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values()) or (0,)], ", ".join(f"{k} {t}" for k, t in zip(cols, ["string"] * len(cols), strict=True)) or "x int")
    return row.select(expr.alias("v")).first()["v"]


def post(**more):
    base = {"id_str_h": "1", "lang": "en", "created_at": "Wed Aug 27 13:08:45 +0000 2008", "user": {"id_str_h": "u"}, "full_text_m": "full", "text_m": "short"}
    return base | more


def read(spark, tmp_path, posts):
    (tmp_path / "p.json").write_text("\n".join(p if isinstance(p, str) else json.dumps(p) for p in posts) + "\n")
    return S.read_posts(spark, str(tmp_path / "p.json"))


def test_type_priority_and_bad_lines(spark, tmp_path):
    good, bad = read(spark, tmp_path, [
        post(id_str_h="a", in_reply_to_status_id_str_h="9", retweeted_status={"id_str_h": "8"}), post(id_str_h="b", in_reply_to_status_id_str_h="", retweeted_status={"id_str_h": "8"}),
        post(id_str_h="c", quoted_status={"id_str_h": "7"}), post(id_str_h="d"), "{not json", "",
    ])
    rows = {r.tw_id: (r.tw_type, r.tw_src_id, r.tw_datetime, r.usr_id) for r in R.typed(good).collect()}
    when = "20080827130845"
    assert rows == {"a": ("r", "9", when, "u"), "b": ("t", "8", when, "u"), "c": ("q", "7", when, "u"), "d": ("n", None, when, "u")}
    assert bad.count() == 1
    assert {r.tw_type for r in R.typed(good.filter("id_str_h = 'd'"), null_is_reply=True).collect()} == {"r"}


def test_text_and_extension(spark, tmp_path):
    ext = {"google_translation_m": "translated", "supervised_narratives": ["b", "a"], "supervised_stance": {"am": "0.5", "pm": "0.1", "?": "0.4"}, "sentiment_scores": {"positive": "N/A", "negative": "0.2", "neutral": "0.8"}}
    good, _ = read(spark, tmp_path, [
        post(id_str_h="a", extension=ext), post(id_str_h="b", lang="fr", extension=ext), post(id_str_h="c", extension=ext, retweeted_status={"id_str_h": "8", "text_m": "inner"}), post(id_str_h="d", lang="fr"), post(id_str_h="e", extension=ext | {"supervised_narratives": []}), post(id_str_h="f", user=None, extension=ext),
    ])
    rows = {r.tw_id: (r.raw_txt, r.nars) for r in R.parsed(good, {"a": 0, "b": 1}).collect()}
    assert rows == {"a": ("full", [1, 0]), "b": ("translated", [1, 0]), "c": ("inner", [1, 0])}
    p = {r.tw_id: r for r in R.profile_posts(good, {"a": 0, "b": 1}).collect()}
    assert p["e"].l_nars is None and p["a"].l_stances == [0.5, 0.1, 0.4] and p["a"].l_sentiments == [None, 0.2, 0.8] and p["d"].l_stances is None and len(p) == 6
    with pytest.raises(Exception, match="unknown narrative"):
        R.parsed(good, {"a": 0}).collect()
    assert R.profile_posts(good, {"a": 0, "b": 1}, "20080827130846").count() == 0


def test_text_clean(spark):
    assert one(spark, X.text_clean(F.col("t")), t="hi @bob see http://x.y #tag") == "hi see tag"
    assert one(spark, X.text_clean(F.col("t")), t="a " + "x" * 22 + " b") == "a b"
    assert one(spark, X.text_clean(F.col("t")), t="") is None and one(spark, X.clean_or_null(F.col("t")), t="http://only") is None
    assert one(spark, X.text_clean(F.col("t")), t="one\n12\ntwo") == "one\n12\ntwo" and one(spark, X.text_clean(F.col("t"), strict=True), t="one\n12\ntwo") == "one\ntwo"


def test_other_text(spark):
    assert one(spark, X.words_only(F.col("t")), t="An <b>old</b> cat, 123 is it45self!") == "old cat itself"
    assert one(spark, X.sentence_words(F.col("t"), merged={"White Helmets": "whitehelmets"}), t="The White Helmets came. 12!\nnot here http://x") == ["whitehelmets came", "not here"]
    assert one(spark, X.without_stop_words(F.split("t", " "), ("not", "the", "of"), ("not",)), t="not The end") == ["not", "end"]
    assert one(spark, X.universal_label(F.col("t")), t="nn") == "compound" and one(spark, X.universal_label(F.col("t")), t="pobj") == "pobj"
    assert one(spark, X.float_vector(F.col("t")), t="1, 2.5,x") == [1.0, 2.5, None]
    a = one(spark, X.shuffled(F.split("t", " "), 3), t="a b c d e f")
    assert sorted(a) == list("abcdef") and a == one(spark, X.shuffled(F.split("t", " "), 3), t="a b c d e f")
    assert one(spark, X.bit_vector(F.split("t", " ").cast("array<int>"), 4), t="0 3") == [1, 0, 0, 1]


def test_seconds(spark):
    assert one(spark, X.seconds_between(F.col("a"), F.col("b")), a="20240101000000", b="20240102000001") == 86401
    with pytest.raises(Exception, match="ends before"):
        one(spark, X.seconds_between(F.col("a"), F.col("b")), a="20240102000000", b="20240101000000")
    assert one(spark, X.created_at(F.col("a")), a="nonsense") is None


def test_stance_counts(spark):
    rows = spark.createDataFrame([(0.6, 0.1, 0.1), (0.6, 0.6, 0.1), (None, None, None), (0.1, 0.1, 0.9)], "am double, pm double, un double")
    assert R.stance_counts(rows, ["am", "pm", "un"]).first().asDict() == {"n_am": 1, "n_pm": 0, "n_un": 1, "total": 4}


def test_samples(spark):
    df = spark.range(101).withColumn("s", F.col("id") % 3)
    assert R.exact_sample(df, 0.1, "id").count() == 11 and sorted(R.exact_sample(df, 0.1, "id").collect()) == sorted(R.exact_sample(df, 0.1, "id").collect())
    assert {(r.s, r["count"]) for r in R.stratified_sample(df, "s", 5, 34, ["id"]).groupBy("s").count().collect()} == {(0, 5), (1, 5)}


def test_edges_and_vectors(spark):
    e = spark.createDataFrame([("a", "b", "0.9"), ("a", "c", "x"), ("b", "c", "0.5")], "src string, trg string, weight string")
    assert [(r.src, r.trg) for r in R.heavy_edges(e, 0.85).collect()] == [("a", "b")]
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0])], "id int, v array<double>")
    assert {r.id: r.v for r in R.zero_filled(v, "v", 2).collect()} == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    S.append_new(a, at, "id")
    S.append_new(a.unionByName(spark.createDataFrame([(3, "d")], "id int, v string")), at, "id")
    assert sorted(tuple(r) for r in spark.read.parquet(at).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    (tmp_path / "i.txt").write_text("20240101:20240107\n20240104:20240110\n\n")
    assert [(r.idx, r.key) for r in S.read_intervals(spark, str(tmp_path / "i.txt")).orderBy("idx").collect()] == [(0, "20240101_20240107"), (1, "20240104_20240110")]
    (tmp_path / "g.txt").write_text("the 1 2 3\nbad 1 2\n")
    assert [(r.token, r.vec) for r in S.valid_vectors(spark, str(tmp_path / "g.txt"), 3).collect()] == [("the", [1.0, 2.0, 3.0])]
    (tmp_path / "s.csv").write_text('u,t2,t1,t1,"[1,2]",1,0\nu,t1,,t1,"[]",0,0\n')
    nodes, edges = S.read_simulation(spark, str(tmp_path / "s.csv"))
    assert [tuple(r) for r in edges.collect()] == [("t1", "t2")] and {r.id: r.narratives for r in nodes.collect()} == {"t2": [1, 2], "t1": []}
    S.write_graph(nodes, edges, str(tmp_path / "g"))
    assert S.read_graph(spark, str(tmp_path / "g"))[1].count() == 1
    (tmp_path / "c.csv").write_text('pajek_id,label,community,members,is_member\n1,a,x,"[""p"",""q""]",1\n')
    S.csv_to_table(spark, str(tmp_path / "c.csv"), S.COMMUNITY_NODES, str(tmp_path / "nodes"))
    assert spark.read.parquet(str(tmp_path / "nodes")).first().members == ["p", "q"]
