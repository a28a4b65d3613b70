"""Schemas, scans and sinks of every table shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = "full_text_m string, text_m string"


def post_schema(topic_vector: str = "topic_vector") -> str:
    """A post. Field names are those of the records; the one of the topic vector is the caller's."""
    return f"{_POST}, sentiment_scores: struct<positive: string, negative: string, neutral: string>, `{topic_vector}`: array<double>>, favorite_count long, _corrupt string"


_POST = (
    f"id_str_h string, lang string, created_at string, user struct<id_str_h: string>, in_reply_to_status_id_str_h string, in_reply_to_status_id_h string, quoted_status_id_str_h string, {_TEXT}, "
    f"retweeted_status struct<id_str_h: string, user: struct<id_str_h: string>, full_text_m: string, text_m: string>, quoted_status struct<id_str_h: string, user: struct<id_str_h: string>, full_text_m: string, text_m: string>, "
    "extension struct<google_translation_m: string, supervised_narratives: array<string>, supervised_stance: struct<am: string, pm: string, `?`: string>"
)
POST = post_schema()
#: Node and edge files of communities.
COMMUNITY_NODES = "pajek_id int, label string, community string, members array<string>, is_member int"
COMMUNITY_EDGES = "sender int, receiver int, weight double"
#: Videos and their comments.
VIDEO = "id string, title string, description string, caption string"
COMMENT = "id string, video_id string, text string"
#: A step of a simulation.
SIMULATION = "usr_id string, tweet_id string, parent_id string, root_id string, narratives string, step int, root_category int"
#: A submission, schema only; the connector needs a network.
SUBMISSION = "id string, title string, author_id string, created_utc double, permalink string, num_comments long, comments_id array<string>, votable_ups long, votable_downs long, votable_likes boolean, score long, upvote_ratio double, is_self boolean, selftext string, url string"


def read_posts(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType = POST) -> tuple[DataFrame, DataFrame]:
    """JSON-lines posts, and the lines that don't parse. The schema is given, never inferred."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    raw = lines.select(F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j")).select("j.*")
    return raw.filter(F.col("_corrupt").isNull()).drop("_corrupt"), raw.filter(F.col("_corrupt").isNotNull()).select("_corrupt")


def between_stamps(df: DataFrame, start: str | None, end: str | None, col: str = "tw_datetime") -> DataFrame:
    """Rows whose 14-digit time is in [start, end]; a null bound is none."""
    for bound, test in ((start, lambda c: c >= F.lit(start)), (end, lambda c: c <= F.lit(end))):
        df = df.filter(test(F.col(col))) if bound is not None else df
    return df


def write_by_interval(df: DataFrame, path: str, interval: str = "time_int", order: str = "time") -> None:
    """S3: one partition folder an interval, sorted by time within. Rows are dealt by interval and time so that a hot interval is several files."""
    df.repartitionByRange(interval, order).sortWithinPartitions(interval, order).write.mode("overwrite").partitionBy(interval).parquet(path)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``yyyymmdd:yyyymmdd`` as (idx, key, start, end)."""
    day = lambda k: F.to_timestamp(F.split("value", ":")[k], "yyyyMMdd")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.regexp_replace(F.trim("value"), ":", "_").alias("key"), day(0).alias("start"), day(1).alias("end"))
    return rows.withColumn("idx", F.expr("row_number() over (order by start, `end`)") - 1)


def first_by(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Of rows of one key, the first in the given order. Aggregates on the map side; the order's ties go by all columns."""
    rest = [c for c in df.columns if c != key]
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    least = F.min_by(F.struct(*rest), F.struct(*by, *[F.col(c).cast("string") if isinstance(df.schema[c].dataType, (T.MapType,)) else F.col(c) for c in rest]))
    return df.groupBy(key).agg(least.alias("_r")).select(key, "_r.*").select(*df.columns)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lines of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''").distinct()


def csv_to_table(spark: SparkSession, path: str, schema: str, out: str) -> None:
    """A typed CSV file with a header, as Parquet. Lists come as JSON text."""
    kinds = T._parse_datatype_string(schema)
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in kinds])
    df = spark.read.schema(flat).option("header", True).option("escape", '"').csv(path)
    df.select(*[(F.from_json(f.name, f.dataType) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)).alias(f.name) for f in kinds]).write.mode("overwrite").parquet(out)


def with_topic_vector(posts: DataFrame, field: str = "topic_vector") -> DataFrame:
    """Ids and topic vectors of the posts that have one, under the field name of the schema that they were read by."""
    vec = F.col("extension")[field]
    return posts.filter(vec.isNotNull()).select(F.col("id_str_h").alias("tw_id"), vec.alias("topic_vec"))


def read_pipes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pipe-separated text."""
    return spark.read.schema(schema).option("sep", "|").csv(path)


def texts_by_video(videos: DataFrame, comments: DataFrame) -> DataFrame:
    """Vid and the texts of a video and its comments, one a line, in order of kind and id."""
    v = videos.select(F.col("id").alias("vid"), F.lit(0).alias("k"), F.lit("").alias("i"), F.concat_ws("\n", "title", "description", "caption").alias("t"))
    c = comments.select(F.col("video_id").alias("vid"), F.lit(1).alias("k"), F.col("id").alias("i"), F.col("text").alias("t"))
    whole = v.unionByName(c).filter("t is not null and t <> ''").groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("k", "i", "t"))).alias("x"))
    return whole.select("vid", F.array_join(F.col("x.t"), "\n").alias("txt"))


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the table doesn't have, one for each key. Run again, it adds nothing."""
    spark = df.sparkSession
    new = first_by(df, key)
    try:
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:  # no such table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def merged(frames: Sequence[DataFrame], order: Sequence[str] = ()) -> DataFrame:
    """One table of several, columns by name, missing ones null; ordered only if asked to be."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(*order) if order else out


def tasks(df: DataFrame, n: int, key: str) -> DataFrame:
    """The number of the task, of n, that a row belongs to."""
    return df.withColumn("task", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def valid_vectors(spark: SparkSession, path: str, width: int = 300) -> DataFrame:
    """``word v1 v2 ...`` lines as (token, vec); lines of another width go."""
    parts = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).select(parts[0].alias("token"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: x.try_cast("float")).alias("vec"))
    return rows.filter(F.size("vec") == width)


def write_vectors(df: DataFrame, path: str, key: str = "id", vec: str = "vec") -> None:
    """``id|v1,v2,..`` lines."""
    df.select(F.concat_ws("|", F.col(key).cast("string"), F.array_join(F.col(vec).cast("array<string>"), ",")).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quoted where needed."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two tables."""
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def read_simulation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and parent edges of a simulation's CSV; narratives are a list in brackets."""
    rows = spark.read.schema(SIMULATION).csv(path).withColumn("narratives", F.from_json("narratives", "array<int>"))
    edges = rows.filter("parent_id is not null and parent_id <> tweet_id").select(F.col("parent_id").alias("src"), F.col("tweet_id").alias("trg"))
    return rows.select(F.col("tweet_id").alias("id"), "usr_id", "root_id", "narratives", "step", "root_category"), edges


def scores_by_period(spark: SparkSession, path: str, pattern: str = r"Period(\d+)", column: int = 7) -> DataFrame:
    """One row a file row with the period of the file's name; an empty score is 0."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col(rows.columns[0]).alias("nar"), F.regexp_extract(F.input_file_name(), pattern, 1).alias("period"), F.coalesce(F.col(rows.columns[column]).try_cast("double"), F.lit(0.0)).alias("f1"))


def f1_pivot(scores: DataFrame, periods: Sequence[str] | None = None) -> DataFrame:
    """Nar by period."""
    by = scores.groupBy("nar")
    return (by.pivot("period", list(periods)) if periods else by.pivot("period")).agg(F.first("f1"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A table of a database, read in ranges of a numeric column. Credentials come as options of the caller."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts, **options).load()


def distinct_values(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """Distinct non-null values."""
    return (df.filter(where) if where is not None else df).select(col).filter(F.col(col).isNotNull()).distinct()
