"""Queries that write tables of a case with every sink and read them back with every source."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import corpus
from quillspark.sources import commits, readers, writers
from quillspark.streaming import reviews

from .base import CASES_SQL, SPLIT_SQL, cases, scratch, split_by, table

FOUND: dict = {}
FILES = {"train": "train", "valid": "valid_ht", "test": "test"}


def query(sql: str | None = None):
    def keep(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return keep


def _split_files(spark: SparkSession, sf_dir: str) -> str:
    """Cases as JSON arrays, a folder of parts a split, written by the executors."""
    folder = scratch(spark, "splits")
    c = cases(spark, sf_dir)
    rows = c.select(F.col("conv_id").cast("string").alias("encounter_id"), "split", F.col("question").alias("query_content_es"), F.transform(F.coalesce("responses", F.array().cast("array<string>")), lambda a: F.struct(a.alias("content_es"))).alias("responses"))
    for split, name in FILES.items():
        writers.write_json_array(rows.filter(F.col("split") == split).drop("split"), f"{folder}/{name}.json")
    return folder


_LOADED_SQL = f"WITH {CASES_SQL} SELECT CAST(conv_id AS VARCHAR) AS encounter_id, split, coalesce(question, '') AS question, CAST(len(coalesce(responses, [])) AS BIGINT) AS answers FROM cases"


def _loaded(df: DataFrame) -> DataFrame:
    return df.select("encounter_id", "split", F.coalesce("query_content_es", F.lit("")).alias("question"), F.size("responses").cast("long").alias("answers"))


@query(_LOADED_SQL)
def splits_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several JSON arrays with their split by file name, one file missing."""
    return _loaded(readers.load_splits(spark, _split_files(spark, sf_dir), [*FILES.values(), "missing"]))


@query(_LOADED_SQL + " WHERE split = 'valid'")
def strict_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files must be there, and the split must have rows."""
    rows = readers.load_splits(spark, _split_files(spark, sf_dir), list(FILES.values()), strict=True)
    corpus.require_columns(rows, ["encounter_id", "split"])
    return _loaded(corpus.require_split(rows, "valid"))


@query(_LOADED_SQL + " WHERE split <> 'train'")
def corpus_of_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comma list of splits."""
    return _loaded(readers.load_corpus(readers.load_splits(spark, _split_files(spark, sf_dir), list(FILES.values())), "valid, test"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays written and read by the executors."""
    path = f"{scratch(spark, 'array')}/orders.json"
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    writers.write_json_array(o.repartition(4), path)
    return readers.read_records(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double").select(*[F.col(c).cast(t) for c, t in o.dtypes])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || chr(10) || '"quoted", ' || c_custkey AS note, CASE WHEN c_custkey % 3 > 0 THEN round(c_acctbal, 2) END AS balance, NULL::VARCHAR AS missing FROM customer""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed columns as text, quotes and line breaks kept, empty numbers null when cast."""
    path = f"{scratch(spark, 'csv')}/customer"
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit('\n"quoted", '), F.col("c_custkey").cast("string")).alias("note"), F.when(F.col("c_custkey") % 3 > 0, F.round("c_acctbal", 2)).alias("balance"), "c_name")
    writers.write_dataset(writers.projected(c, ["c_custkey", "note", "balance", "missing"]), path, "csv")
    return readers.with_numbers(readers.read_csv_text(spark, path), ["balance"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def zipped_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first path that exists, here an archive; of its members the JSON array goes before the table, and its records say their
    types."""
    folder = scratch(spark, "zip")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    writers.write_json_array(c, f"{folder}/customer.json", single_file=True)
    writers.write_dataset(c.limit(1).withColumn("c_name", F.lit("wrong")), f"{folder}/customer.csv", "csv", single_file=True)  # not to be read
    writers.zip_bundle(spark, [f"{folder}/customer.csv", f"{folder}/customer.json"], f"{folder}/customer.zip")
    return readers.read_dataset(spark, [f"{folder}/none.jsonl", f"{folder}/customer.zip"]).select(*[F.col(x).cast(t) for x, t in c.dtypes])


@query("SELECT event_type, 'events-' || event_type || '.zip' AS archive, event_id, user_id FROM events")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of several members each, read a task a member: JSON arrays of one event type go in one archive."""
    folder = scratch(spark, "archives")
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id")
    kinds = sorted(r.event_type for r in e.select("event_type").distinct().collect())  # a handful
    for kind in kinds:
        writers.write_json_array(e.filter(F.col("event_type") == kind).drop("event_type").repartition(3), f"{folder}/{kind}.json")
        writers.zip_bundle(spark, [f"{folder}/{kind}.json"], f"{folder}/zips/events-{kind}.zip")
    readers.members.register(spark)
    found = spark.read.format("quill_members").load(f"{folder}/zips")
    rows = found.select(F.regexp_extract("member", r"^(.*)-\d+\.json$", 1).alias("event_type"), F.regexp_extract("path", r"([^/]+)$", 1).alias("archive"), F.from_json("record", "event_id long, user_id long").alias("r"))
    return rows.select("event_type", "archive", "r.*")


@query("SELECT event_id, event_type FROM events")
def append_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, then lines that are blank or no JSON, which the scan leaves out."""
    path = scratch(spark, "log")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    writers.append_log(e.filter("event_id % 2 = 0"), path)
    writers.append_log(e.filter("event_id % 2 = 1"), path)
    readers.write_bytes(spark, f"{path}/broken.json", [b"\n   \n{broken\nnot json\n"])
    return readers.read_log(spark, path, "event_id long, event_type string")


@query(f"SELECT CAST(count(*) AS VARCHAR) AS row_count FROM (SELECT {SPLIT_SQL.format(k='doc_id')} AS split FROM documents)")
def flat_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar fields of a JSON object, here a manifest; its nested fields are left out."""
    path = f"{scratch(spark, 'manifest')}/manifest.json"
    writers.write_manifest(table(spark, sf_dir, "documents").select("doc_id", split_by("doc_id").alias("split")), path)
    return readers.read_flat_json(spark, path)


@query("SELECT 'o_orderstatus=' || o_orderstatus AS found, count(*) AS n, sum(o_orderkey) AS keys FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a glob pattern by folder, without excluded names, and what is in them: a table written by status, its summaries and
    one status left out."""
    folder = scratch(spark, "found")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").csv(folder, header=True)
    for status in ("F", "O"):
        readers.write_bytes(spark, f"{folder}/o_orderstatus={status}/summary.csv", [b"o_orderkey\n1\n"])
    found = readers.discover(spark, f"{folder}/*/*.csv", ("summary.csv",)).filter("parent <> 'o_orderstatus=P'")
    rows = spark.read.csv([r.path for r in found.collect()], header=True, schema="o_orderkey long")  # paths of a listing
    parent = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    return rows.select(parent.alias("found"), "o_orderkey").groupBy("found").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'img' || c_custkey || '.jpg' WHEN 1 THEN 'img' || c_custkey || '.png' END AS file FROM customer")
def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by name: as it is, or with the first extension that is there; names with a dot are tried alone."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    name = F.concat(F.lit("img"), key.cast("string"))
    index = c.filter(key % 4 == 0).select(F.concat(name, F.lit(".jpg")).alias("name")).unionByName(c.filter(key % 4 < 2).select(F.concat(name, F.lit(".png")).alias("name"))).withColumn("path", F.concat(F.lit("/images/"), "name"))
    rows = c.withColumn("image_id", F.when(key % 4 == 3, F.concat(name, F.lit(".gif"))).when(key % 4 == 1, F.concat(name, F.lit(".png"))).otherwise(name))
    return readers.find_images(rows, index).select("c_custkey", F.regexp_extract("image_path", r"([^/]+)$", 1).alias("file"))


@query("SELECT l_orderkey, max(l_quantity) AS score FROM lineitem GROUP BY l_orderkey")
def nested_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in the first list that an object holds."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("similarity"))
    packed = per.groupBy(F.pmod("l_orderkey", F.lit(16)).alias("part")).agg(F.collect_list(F.struct("l_orderkey", "similarity")).alias("results"))
    return readers.read_scores(readers.score_records(packed), keep=("l_orderkey",)).select("l_orderkey", "score")


@query("SELECT n_nationkey, 'new' AS version FROM nation")
def guarded_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path that exists raises; overwriting is asked for."""
    path = f"{scratch(spark, 'guarded')}/nation"
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    writers.write_dataset(n.withColumn("version", F.lit("old")), path, "jsonl", single_file=True)
    try:
        writers.write_dataset(n.withColumn("version", F.lit("lost")), path, "jsonl")
    except Exception as e:  # noqa: BLE001
        if "exist" not in str(e).lower():
            raise
    writers.write_dataset(n.withColumn("version", F.lit("new")), path, "jsonl", overwrite=True)
    return spark.read.schema("n_nationkey long, version string").json(path).withColumn("n_nationkey", F.col("n_nationkey").cast(dict(n.dtypes)["n_nationkey"]))


# --------------------------------------------------------------------------- several writers, and a stream
@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -1, 'new'")
def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in buckets, then changed and new rows; versions tell which folders hold the rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    kept = commits.Table(spark, scratch(spark, "buckets"), "o_orderkey long, o_orderstatus string", ["o_orderkey"])
    kept.upsert(o)
    kept.upsert(o.filter("o_orderkey % 50 = 0").withColumn("o_orderstatus", F.lit("X")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit("new").alias("o_orderstatus"))))
    return kept.read()


@query("SELECT user_id, count(DISTINCT user_id) AS reviews FROM events GROUP BY user_id")
def concurrent_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writers append reviews of the same jobs at once: every job has one review."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    path = scratch(spark, "reviews")

    def write(k: int) -> None:
        commits.Table(spark, path, "user_id long, event_id long, ts timestamp", ["user_id"]).append_first(e.filter(F.col("event_id") % 3 == k), ["ts", "event_id"])

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    return commits.Table(spark, path, "user_id long, event_id long, ts timestamp", ["user_id"]).read().groupBy("user_id").agg(F.count(F.lit(1)).alias("reviews"))


@query("""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS job_id, event_id % 2 AS batch, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, CASE WHEN event_type = 'purchase' THEN 'aprobar' ELSE 'rechazar' END AS accion FROM events)
SELECT job_id, id, accion FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY batch, t, id) AS r FROM e) WHERE r = 1""")
def review_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews replayed as a stream in two batches with a restart between: of each job the first review of the batch that it came in."""
    folder = scratch(spark, "replay")
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("user_id").cast("string").alias("job_id"), F.when(F.col("event_type") == "purchase", "aprobar").otherwise("rechazar").alias("accion"), F.lit("x").alias("borrador_original"), F.col("event_id"))
    for batch in (0, 1):
        e.filter(F.col("event_id") % 2 == batch).drop("event_id").write.json(f"{folder}/in/{batch}")
        reviews.write_reviews(reviews.review_stream(spark, f"{folder}/in/*"), f"{folder}/log", f"{folder}/approved", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/log").select("job_id", "id", "accion")
