"""Vector columns (array of float): norms, means, distances, nearest neighbours; arithmetic is in double."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column, tolerance: float = 1e-6) -> Column:
    """Unit vector; zero vectors and those within ``tolerance`` of unit length stay as they are."""
    length = norm(v)
    return F.when((length == 0) | (F.abs(length - 1) <= tolerance), doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / length))


def is_zero(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


def l2_distance(v: Column, query: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(v), doubles(query), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def is_comparable(v: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite components."""
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def query_literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def with_dimension(df: DataFrame, column: str, dim: int) -> DataFrame:
    """``df``, failing at run time where a vector has another number of components."""
    wrong = F.size(column) != dim
    return df.withColumn(column, F.when(wrong, F.raise_error(F.concat(F.lit(f"{column}: expected {dim} components, got "), F.size(column).cast("string"))).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def mean_vector(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys and the element-wise mean of ``vector`` in each group; partial sums combine before the shuffle."""
    items = df.select(*keys, F.posexplode(vector).alias("i", "x"))
    means = items.groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    parts = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))
    return parts.select(*keys, F.transform("p", lambda s: s["m"]).alias(vector))


def knn(df: DataFrame, id_column: str, vector: str, query: Sequence[float], k: int, keep_zero: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(id, columns of ``carry``, dist) of the k nearest by Euclidean distance, ties by id.

    A zero vector is nearer to a unit query than most real ones, so it is left out unless ``keep_zero``.  Vectors that are null, of
    another length than the query, or hold null or non-finite components have no distance and are left out.
    """
    rows = df.where(is_comparable(F.col(vector), len(query)))
    if not keep_zero:
        rows = rows.where(~is_zero(F.col(vector)))
    return rows.select(id_column, *carry, l2_distance(F.col(vector), query_literal(query)).alias("dist")).orderBy("dist", id_column).limit(k)


def embed_query(backend: Callable[[list[str]], list[list[float]]], text: str, dim: int | None = None) -> list[float]:
    """The vector of one search text; ValueError if it has another number of components than ``dim``."""
    found = backend([text])
    if len(found) != 1 or (dim is not None and len(found[0]) != dim):
        raise ValueError(f"expected one vector of {dim} components, got {[len(v) for v in found]}")
    return [float(x) for x in found[0]]


def backfill_normalized(v: Column, tolerance: float = 1e-9) -> Column:
    """Stored vectors made unit length, all but those of a length of ``tolerance`` at most."""
    length = norm(v)
    return F.when(length > tolerance, F.transform(doubles(v), lambda x: x / length)).otherwise(doubles(v))


def fetch_vectors(vectors: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``vectors`` whose key is wanted."""
    return vectors.join(wanted.select(key).distinct(), key, "left_semi")


def thread_vectors(threads: DataFrame, chunks: DataFrame, prior: DataFrame | None, dim: int, backend: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """(thread_id, embedding, origin): the mean of a thread's chunks, else its earlier vector if that is not zero, else its subject's, else zero.

    ``threads`` has thread_id and subject, ``chunks`` thread_id and embedding, ``prior`` thread_id and embedding.  A chunk's vector of
    another length than ``dim`` is an error.
    """
    means = mean_vector(with_dimension(chunks, "embedding", dim), ["thread_id"], "embedding").withColumnRenamed("embedding", "_mean")
    rows = threads.select("thread_id", "subject").join(means, "thread_id", "left")
    if prior is None:
        rows = rows.withColumn("_prior", F.lit(None).cast("array<double>"))
    else:
        rows = rows.join(prior.where(~is_zero(F.col("embedding"))).select("thread_id", doubles(F.col("embedding")).alias("_prior")), "thread_id", "left")
    zero = F.array_repeat(F.lit(0.0), dim)
    first = F.coalesce("_mean", "_prior", zero)
    origin = F.when(F.col("_mean").isNotNull(), "chunks").when(F.col("_prior").isNotNull(), "prior").otherwise("none")
    found = rows.select("thread_id", "subject", l2_normalize(first).alias("embedding"), origin.alias("origin"))
    if backend is None:
        return found.drop("subject")
    from threadloom.operators.chunking import embed

    bare = found.where("origin = 'none'").select("thread_id", F.when(F.trim(F.coalesce("subject", F.lit(""))) == "", "(empty thread)").otherwise(F.col("subject")).alias("_text"))
    named = embed(bare, "thread_id", "_text", backend, dim).select(F.col("key").alias("_k"), "embedding")
    named = bare.select("thread_id").join(named, F.col("thread_id").cast("string") == F.col("_k")).select("thread_id", l2_normalize(F.col("embedding")).alias("embedding"), F.lit("subject").alias("origin"))
    return found.where("origin <> 'none'").drop("subject").unionByName(named)
