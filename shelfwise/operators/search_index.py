"""FLT-6 by index: substring search that does not read the whole catalogue.

The index holds a posting ``(gram, key, fields)`` for every run of three characters
of a product's name and description, in lower case, and for the one or two characters
that a text ends with; ``fields`` has the bit of the field that holds the gram.  The
postings lie in folders by hash of the gram, sorted by gram, with the number of postings
of each gram.  A term of up to three characters is the start of grams.  A longer one is
looked up by its three-character grams, of which the ``MOST_GRAMS`` rarest are read: the
products that have all of them in one field are candidates, and only those are read and
checked with the plain search.  Only the folders of a longer term's grams are read; a
shorter term skips the row groups whose grams begin otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.expressions import search_match

LONGEST = 3             # characters of a gram
MOST_GRAMS = 4          # that are intersected; more make the candidates few fewer
SPREAD = 8              # files of a folder, by hash of the key


def _grams(text: Column, ends: bool) -> Column:
    """Distinct runs of ``LONGEST`` characters; with ``ends``, the shorter runs at the end, too."""
    chars = F.split(F.lower(text), "")

    def run(_: Column, i: Column) -> Column:
        return F.concat(*[F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(LONGEST)])

    found = F.array_distinct(F.transform(chars, run))
    return found if ends else F.filter(found, lambda g: F.char_length(g) == LONGEST)


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, key: str = "id", parts: int = 64):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts

    def _part(self, gram) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.parts)).cast("int")

    def build(self, products: DataFrame, fields: tuple[str, ...] = ("name", "description")) -> None:
        """Write the index of ``products``, whose ``key`` tells them apart."""
        def postings(field: str, bit: int) -> Column:
            return F.transform(_grams(F.coalesce(field, F.lit("")), ends=True), lambda g: F.struct(g.alias("gram"), F.lit(bit).alias("fields")))

        cells = F.explode(F.concat(*[postings(f, 1 << i) for i, f in enumerate(fields)]))
        rows = products.select(F.col(self.key).alias("key"), cells.alias("c")).filter("c.gram <> ''").select(
            "key", F.col("c.gram").alias("gram"), F.col("c.fields").alias("fields")).withColumn("part", self._part(F.col("gram")))
        rows.repartition("part", F.pmod(F.xxhash64("key"), F.lit(SPREAD))).sortWithinPartitions("part", "gram") \
            .write.partitionBy("part").parquet(f"{self.path}/postings")
        self.spark.read.parquet(f"{self.path}/postings").groupBy("part", "gram").agg(F.count(F.lit(1)).alias("n")) \
            .repartition("part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{self.path}/counts")

    def _of(self, what: str, schema: str, grams: dict[str, int]) -> DataFrame:
        table = self.spark.read.schema(f"{schema}, part int").parquet(f"{self.path}/{what}")
        return table.filter(F.col("part").isin(sorted(set(grams.values()))) & F.col("gram").isin(sorted(grams)))

    def _grams_of(self, term: str) -> dict[str, int]:
        """Three-character grams of a term, as the index lower-cases and cuts, and their folders."""
        found = self.spark.range(1).select(F.explode(_grams(F.lit(term), ends=False)).alias("gram"))
        return {r.gram: r.part for r in found.select("gram", self._part(F.col("gram")).alias("part")).collect()}

    def candidates(self, term: str) -> DataFrame:
        """Keys (``key``) of the products that can hold ``term``, once each."""
        grams = self._grams_of(term)
        postings = "key long, gram string, fields int"
        if not grams:       # a short term
            table = self.spark.read.schema(f"{postings}, part int").parquet(f"{self.path}/postings")
            start = self.spark.range(1).select(F.lower(F.lit(term))).first()[0]
            return table.filter(F.col("gram").startswith(start)).select("key").distinct()
        counts = {r.gram: r.n for r in self._of("counts", "gram string, n long", grams).select("gram", "n").collect()}
        rarest = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:MOST_GRAMS]
        read = self._of("postings", postings, {g: grams[g] for g in rarest})
        if len(rarest) == 1:
            return read.select("key").distinct()
        having = [F.coalesce(F.bit_or(F.when(F.col("gram") == g, F.col("fields"))), F.lit(0)) for g in rarest]
        everywhere = having[0]
        for h in having[1:]:
            everywhere = everywhere.bitwiseAND(h)
        return read.groupBy("key").agg(everywhere.alias("_in")).filter("_in <> 0").select("key")

    def search(self, products: DataFrame, term: str | None) -> DataFrame:
        """:func:`~shelfwise.operators.catalog.search` over the indexed products."""
        if not term:
            return products.filter(search_match(term))
        found = products.join(self.candidates(term).withColumnRenamed("key", self.key), self.key, "left_semi")
        return found.filter(search_match(term)).select(*products.columns)
