"""Extra columns whose names are used inside the operators change nothing; nor do repeated rows break anything."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm.decontamination import contaminated
from tidemark.llm.exact_dedup import exact_groups
from tidemark.llm.html_extraction import main_texts
from tidemark.llm.lm_scoring import lm_scores
from tidemark.llm.near_dedup import near_groups
from tidemark.llm.quality import quality_scores
from tidemark.llm.secrets import secret_spans
from tidemark.llm.sentence_pieces import encode_documents
from tidemark.llm.token_output import read_tokens, write_tokens
from tidemark.llm.toxicity import toxic_scores

SF = "/root/testdata/sf0.001"
CLASH = "cls keys key k v k2 v2 low root n unit ids score y bytes rest grp digit sha keep_id rid base weak held train b f row part seq item_id n_shingles shingles extra host page token toxic quality component_id".split()


def operators(spark):
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    return {
        "pieces": lambda d: encode_documents(d, public_tokenizers.path("piece_bpe_32k.model")),
        "tokens": lambda d: read_tokens(write_tokens(d, public_tokenizers.path("word_bpe_49k.json"))[0]),
        "toxicity": lambda d: toxic_scores(d, labels),
        "near": near_groups,
        "secrets": secret_spans,
        "quality": lambda d: quality_scores(d, labels),
        "contaminated": lambda d: contaminated(d, items),
        "scores": lambda d: lm_scores(d),
        "exact": exact_groups,
    }


@pytest.mark.parametrize("name", ["pieces", "tokens", "toxicity", "near", "secrets", "quality", "contaminated", "scores", "exact"])
def test_documents(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 3 = 0 or doc_id < 30").select("doc_id", "text")
    docs = docs.unionByName(docs.filter("doc_id < 4"))  # repeated rows
    odd = docs.select("doc_id", "text", *[F.lit("x").alias(c) for c in CLASH])
    run = operators(spark)[name]
    # sums in another order may differ in the last digits
    near = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert near(run(odd).collect()) == near(run(docs).collect())


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = pages.select("*", *[F.lit("x").alias(c) for c in [*CLASH, "roots", "depth", "size", "support", "whole", "text"]])
    assert sorted(map(tuple, main_texts(odd).collect())) == sorted(map(tuple, main_texts(pages).collect()))


def test_stages_with_a_column_of_the_row_number_s_name(spark):
    """Both spellings of the number's own name, and repeated rows: stages drop the right rows and give all columns back."""
    from tidemark.llm.decontamination import drop_contaminated
    from tidemark.llm.exact_dedup import drop_exact
    from tidemark.llm.near_dedup import drop_near
    from tidemark.llm.toxicity import drop_toxic

    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    plain = spark.createDataFrame([(1, "A", 7), (2, "B", 7), (3, "A", 7), (4, "B", 7)], "doc_id long, text string, _tidemark_row int")
    assert sorted(map(tuple, drop_exact(plain).collect())) == [(3, "A", 7), (4, "B", 7)]
    assert drop_exact(plain.withColumnRenamed("_tidemark_row", "_Tidemark_Row")).columns == ["doc_id", "text", "_Tidemark_Row"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")
    odd = docs.select("*", F.lit(7).alias("_tidemark_row"), *[F.lit("x").alias(c) for c in CLASH if c not in ("text", "doc_id")])
    for stage in (drop_exact, drop_near, lambda d: drop_toxic(d, labels), lambda d: drop_contaminated(d, items)):
        left, want = stage(odd), stage(docs)
        assert left.columns == odd.columns and set(left.select("_tidemark_row").distinct().collect()) <= {(7,)}
        assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in want.collect())


def test_sample_takes_the_largest_text_of_an_id(spark):
    from tidemark.llm.toxicity import sample

    docs = spark.createDataFrame([(1, "z"), (1, "aaaaaaaaaa"), (3, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    texts, y = sample(docs, labels, "toxic", 10)
    assert sorted(zip(texts, y)) == [(b"", 0), (b"aaaaaaaaaa", 1)]


def test_scores_at_the_threshold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for scores in (toxic_scores, quality_scores):
        row = scores(docs, labels).orderBy(F.desc("score")).first()
        again = {r.doc_id: r.predicted for r in scores(docs, labels, threshold=row.score).collect()}
        assert again[row.doc_id] == 1  # a score of just the threshold counts
