"""Sinks: tables with one header, append-only evidence, campaign trees, indexes, caches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import retrieval as rt


def write_csv(df: DataFrame, path: str) -> None:
    """One header for all part files; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)


def append_evidence(df: DataFrame, path: str) -> None:
    """JSON lines, added to what is there; Spark's commit makes an append whole or nothing."""
    df.write.mode("append").json(path)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """One small document, written aside and renamed, in any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = system.create(aside, True)
    stream.write(bytearray(content.encode()))
    stream.close()
    system.delete(target, False)
    if not system.rename(aside, target):
        raise OSError(f"could not rename to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small document, or None if there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def write_campaign(windows: DataFrame, root: str, manifest: dict) -> None:
    """A manifest and one folder for each cell, dataset and window; a second run replaces only its own folders."""
    spark = windows.sparkSession
    write_text(spark, f"{root}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True))
    windows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("row_key", "dataset", "window").parquet(f"{root}/cells")


def cells_index(spark: SparkSession, root: str) -> DataFrame:
    """One row a window, in a stable order."""
    return spark.read.parquet(f"{root}/cells").groupBy("row_key", "dataset", "window").agg(F.count("*").alias("n_rows")).orderBy("dataset", "row_key", "window")


def next_ordinal(spark: SparkSession, root: str, row_key: str, dataset: str) -> int:
    """The ordinal after the last of a cell's windows."""
    last = cells_index(spark, root).filter((F.col("row_key") == row_key) & (F.col("dataset") == dataset)).agg(F.max("window").alias("w")).first()["w"]
    return 0 if last is None else int(last) + 1


def save_index(docs: DataFrame, path: str, *, k1: float = rt.K1, b: float = rt.B, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Postings sorted by term (so a query reads few row groups), and what they were made of."""
    spark = docs.sparkSession
    print_of = rt.corpus_fingerprint(docs, doc_id).first()
    stats = rt.bm25_stats(docs, text).first()
    meta = {"type": "bm25", "k1": k1, "b": b, "n_docs": stats["n_docs"], "avgdl": stats["avgdl"], "fingerprint": print_of["fingerprint"]}
    rt.bm25_postings(docs, doc_id, text).repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    write_text(spark, f"{path}/meta.json", json.dumps(meta, sort_keys=True))
    return meta


def load_index(spark: SparkSession, path: str, *, k1: float = rt.K1, b: float = rt.B) -> tuple[DataFrame, dict]:
    """Postings and metadata; other parameters refuse."""
    meta = json.loads(read_text(spark, f"{path}/meta.json") or "{}")
    if (meta.get("type"), meta.get("k1"), meta.get("b")) != ("bm25", k1, b):
        raise ValueError("the index was built with other parameters")
    return spark.read.parquet(f"{path}/postings"), meta


def ensure_index(docs: DataFrame, path: str, *, k1: float = rt.K1, b: float = rt.B, doc_id: str = "doc_id", text: str = "text") -> tuple[dict, bool]:
    """The index's metadata, and whether it had to be built anew: absent, unreadable or of other content or parameters."""
    try:
        meta = json.loads(read_text(docs.sparkSession, f"{path}/meta.json") or "{}")
    except ValueError:
        meta = {}
    same = meta.get("fingerprint") == rt.corpus_fingerprint(docs, doc_id).first()["fingerprint"]
    if same and (meta.get("type"), meta.get("k1"), meta.get("b")) == ("bm25", k1, b):
        return meta, False
    return save_index(docs, path, k1=k1, b=b, doc_id=doc_id, text=text), True


def search_index(queries: DataFrame, postings: DataFrame, meta: dict, *, k: int) -> DataFrame:
    """The k best documents of every query (query_id, query) from stored postings."""
    from meridia.functions import text as tx

    asked = queries.select("query_id", F.explode(F.array_distinct(tx.bm25_tokens("query"))).alias("term"))
    hits = postings.join(asked.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    k1, b, n, avgdl = (F.lit(float(meta[x])) for x in ("k1", "b", "n_docs", "avgdl"))
    weight = rt.idf(F.col("df"), n) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    scored = asked.join(hits.join(df, "term"), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 9).alias("score"))
    return rt.top_k(scored.filter("score > 0"), k)


def cache_key(dataset: str, model: str, top_k: int, query: str = "query") -> F.Column:
    return F.concat_ws(":", F.lit(dataset), F.lit(model), F.lit(str(top_k)), F.sha1(F.col(query)))


def cache_lookup(queries: DataFrame, cache: DataFrame, *, now: float) -> tuple[DataFrame, DataFrame]:
    """Hits with their newest live value, and the misses. cache: key, value, written_at, ttl."""
    live = cache.filter(F.col("written_at") + F.col("ttl") > now).groupBy("key").agg(F.max_by("value", "written_at").alias("value"))
    return queries.join(live, "key"), queries.join(live.select("key"), "key", "left_anti")
