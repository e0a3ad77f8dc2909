"""Substring search by positional q-gram lists: a term looks up its rarest grams, their places are intersected, and finds are verified."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: Letters of a gram; grams of a term that are looked up, at most; folders of stored lists.
Q, LOOKED_UP, BUCKETS = 3, 2, 64
#: Fills texts up, so that a gram begins at each of their letters.
END = "\x00"
LISTS = "gram string, text string, places array<int>, size int, bucket int"


def _grams(text: Column) -> Column:
    """Array of (place from 0, gram) of all places of a text."""
    full = F.concat(text, F.lit(END * (Q - 1)))
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.struct((i - 1).alias("place"), F.substring(full, i, F.lit(Q)).alias("gram")))


@dataclass(frozen=True)
class QGramIndex:
    """``lists`` (bucket, gram, text, size, places), ``counts`` (gram, n): each distinct text once per gram that it has."""

    lists: DataFrame
    counts: DataFrame

    @staticmethod
    def write(texts: DataFrame, path: str, text: str = "text") -> QGramIndex:
        """Store the lists of the distinct texts of a column, null and empty ones left out. Texts are short (names, titles): lists hold them."""
        rows = texts.select(F.col(text).alias("text")).where("text <> ''").distinct()
        each = rows.select("text", F.explode(_grams(F.col("text"))).alias("g")).select("text", "g.gram", "g.place")
        lists = each.groupBy("gram", "text").agg(F.sort_array(F.collect_list("place")).alias("places"))
        lists = lists.withColumn("size", F.length("text")).withColumn("bucket", _bucket(F.col("gram")))
        # A frequent gram's list is dealt over as many tasks as there are texts' parts.
        lists = lists.repartition("bucket", F.pmod(F.xxhash64("text"), F.lit(8))).sortWithinPartitions("bucket", "gram")
        lists.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists")
        stored = texts.sparkSession.read.schema(LISTS).parquet(f"{path}/lists")
        stored.groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
        return QGramIndex.read(texts.sparkSession, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> QGramIndex:
        return QGramIndex(spark.read.schema(LISTS).parquet(f"{path}/lists"), spark.read.schema("gram string, n long").parquet(f"{path}/counts"))

    def find(self, terms: DataFrame, least: float | None = None) -> DataFrame:
        """(term, text): the texts that hold a term (a column ``term``; null and empty ones hold nothing).

        Terms of Q letters and more look up their LOOKED_UP rarest grams; a term with a gram
        that no text has is dropped there and then. Shorter ones take the grams that begin with
        them, from the table of grams. With ``least`` only texts count that are longer than their
        term, and of which the term is more than that share; this is judged on the lists.
        """
        terms = terms.select("term").where("term <> ''").distinct()
        long = terms.where(F.length("term") >= Q)
        whole = F.filter(_grams(F.col("term")), lambda g: g["place"] <= F.length("term") - Q)
        each = long.select("term", F.size(whole).alias("of"), F.explode(whole).alias("g")).select("term", "of", "g.gram", F.col("g.place").alias("at"))
        known = each.join(self.counts, "gram").withColumn("have", F.count("*").over(Window.partitionBy("term"))).where("have = of")
        rank = F.row_number().over(Window.partitionBy("term").orderBy("n", "gram", "at"))
        wanted = known.withColumn("r", rank).where(F.col("r") <= LOOKED_UP).select("term", "gram", "at", F.least("of", F.lit(LOOKED_UP)).alias("need"))
        at = scratch.path(terms.sparkSession, "grams")
        wanted.write.parquet(at)
        wanted = terms.sparkSession.read.parquet(at)
        long = self._listed(wanted).select("term", "need", "at", "text", "size", F.explode(F.transform("places", lambda p: p - F.col("at"))).alias("start"))
        if least is not None:
            long = long.where(_within(least))
        found = long.where("start >= 0").groupBy("term", "text", "start", "need").agg(F.count_distinct("at").alias("k")).where("k = need")
        found = found.where(F.substring(F.col("text"), F.col("start") + 1, F.length("term")) == F.col("term")).select("term", "text")
        short = terms.where(F.length("term") < Q)
        begins = self.counts.select("gram", F.explode(F.transform(F.sequence(F.lit(1), F.lit(Q - 1)), lambda i: F.substring("gram", F.lit(1), i))).alias("term")).distinct()
        brief = self._listed(short.join(begins, "term").select("term", "gram"))
        if least is not None:
            brief = brief.where(_within(least))
        return found.unionByName(brief.select("term", "text")).distinct()

    def _listed(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` with the lists of its grams; folders without any are not read."""
        used = [r[0] for r in wanted.select(_bucket(F.col("gram"))).distinct().collect()]  # BUCKETS at most
        return wanted.join(self.lists.where(F.col("bucket").isin(used)), "gram")


def _within(least: float) -> Column:
    return (F.length("term") < F.col("size")) & (F.length("term") / F.col("size") > least)


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def index_of(texts: DataFrame, text: str = "text") -> QGramIndex:
    """The lists of a column's texts, for as long as the driver lives."""
    return QGramIndex.write(texts, scratch.path(texts.sparkSession, "grams"), text)
