"""A table of vectors by id, in Parquet: a stored dimension, and the last write of an id wins.

A write is a folder of its own, made live by one row (its number) once it is whole, so a failed write changes nothing, and
readers never see half of one. Reading takes each id's latest row by an aggregate that combines before it shuffles. A
null vector removes an id. `compact` folds the writes so far into one.

Edge cases: a vector of another length, or with a null or non-finite component, fails the write; rows without id fail it too; of an id
that recurs within a write the row with the largest `order` wins (ties: the larger vector); an empty table reads as no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieve import cosine

LIVE = "write string, number long, dimension int, folded boolean"


class VectorTable:
    def __init__(self, spark: SparkSession, path: str, dimension: int, key: str = "string"):
        self.spark, self.path, self.dimension, self.key = spark, path.rstrip("/"), dimension, key
        if dimension < 1:
            raise ValueError("a vector has at least one component")
        for r in self._live():
            if r["dimension"] != dimension:
                raise ValueError(f"the table at {path} holds vectors of {r['dimension']} components")

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/live")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _live(self) -> list:
        """Writes from the last fold on, a row each."""
        if not self._exists():
            return []
        rows = sorted(self.spark.read.schema(LIVE).parquet(f"{self.path}/live").collect(), key=lambda r: r["number"])
        folds = [r["number"] for r in rows if r["folded"]]
        return [r for r in rows if r["number"] >= (folds[-1] if folds else 0)]

    def _put(self, rows: DataFrame, number: int, folded: bool) -> None:
        write = f"w{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/writes/{write}")
        self.spark.createDataFrame([(write, number, self.dimension, folded)], LIVE).coalesce(1).write.mode("append").parquet(f"{self.path}/live")

    def _checked(self, v: Column) -> Column:
        sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        return v.isNull() | ((F.size(v) == self.dimension) & sound)

    def save(self, rows: DataFrame, id_col: str = "id", vec_col: str = "vector", order: Column | None = None) -> None:
        """Insert or replace by id; a null vector removes."""
        v = F.col(f"`{vec_col}`").cast("array<double>")
        put = rows.select(F.col(f"`{id_col}`").cast(self.key).alias("id"), v.alias("vector"), (F.lit(0) if order is None else order).cast("long").alias("place"))
        put = put.filter(F.assert_true(F.col("id").isNotNull(), "a vector has an id").isNull() & F.assert_true(self._checked(F.col("vector")), f"a vector has {self.dimension} finite components").isNull())
        live = self._live()
        self._put(put, live[-1]["number"] + 1 if live else 0, False)

    def load(self) -> DataFrame:
        """id, vector: the latest of each id."""
        every = None
        for r in self._live():  # a row a write since the last fold
            one = self.spark.read.schema(f"id {self.key}, vector array<double>, place long").parquet(f"{self.path}/writes/{r['write']}").withColumn("number", F.lit(r["number"]))
            every = one if every is None else every.unionByName(one)
        if every is None:
            return self.spark.createDataFrame([], f"id {self.key}, vector array<double>")
        latest = every.groupBy("id").agg(F.max(F.struct("number", "place", "vector")).alias("l"))
        return latest.select("id", F.col("l.vector").alias("vector")).filter("vector is not null")

    def compact(self) -> None:
        live = self._live()
        if len(live) > 1:
            self._put(self.load().withColumn("place", F.lit(0).cast("long")), live[-1]["number"] + 1, True)

    def similarities(self, probe: list[float]) -> DataFrame:
        """id, cosine with a probe of the table's dimension; one row an id, as retrieve.assemble wants it."""
        if len(probe) != self.dimension:
            raise ValueError(f"a probe has {self.dimension} components")
        return self.load().select("id", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in probe])).alias("cosine"))

    def nearest(self, probe: list[float], k: int = 5) -> DataFrame:
        return self.similarities(probe).orderBy(F.desc("cosine"), "id").limit(k)
