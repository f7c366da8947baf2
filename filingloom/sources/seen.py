"""Ids that were stored before, kept batch by batch with a Bloom filter beside them.

A new batch asks the filter first. Ids it does not know are new without any look at the
stored ones; only what it may know is joined with them exactly. The filter is a table of
blocks of 32,768 bits: an id has all its bits in one block, so it is asked with one join,
and the bits of a batch are merged into it block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BITS = 32_768
#: words of 64 bits that a filter sent to all tasks has at most: some 3 MB
FILTER_WORDS = 1 << 17


def keep_asked(rows: DataFrame, key: str, asked: DataFrame, asked_key: str, words: int = FILTER_WORDS) -> DataFrame:
    """The rows whose key is one of ``asked``, and a few others, without moving any row.

    A Bloom filter of at most ``words`` words goes to the rows: an id has its four bits in
    one word. Null keys are dropped. More ids let more other rows pass and never drop a row
    that is asked for, so an exact join on the key has to follow.
    """

    def word(id_: Column) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(words))

    def bits(id_: Column) -> Column:
        places = F.xxhash64(id_, F.lit(1))
        out = F.lit(0).cast("long")
        for shift in (0, 6, 12, 18):
            place = F.shiftrightunsigned(places, shift).bitwiseAND(F.lit(63)).cast("int")
            out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
        return out

    ids = asked.where(F.col(asked_key).isNotNull()).select(F.col(asked_key).cast(rows.schema[key].dataType).alias("_id"))
    known = ids.select(word(F.col("_id")).alias("_word"), bits(F.col("_id")).alias("_bits"))
    known = known.groupBy("_word").agg(F.bit_or("_bits").alias("_known"))
    met = rows.where(F.col(key).isNotNull()).join(F.broadcast(known), word(F.col(key)) == F.col("_word"))
    wanted = bits(F.col(key))
    return met.where(F.col("_known").bitwiseAND(wanted) == wanted).select(*rows.columns)


class SeenIds:
    """A store of ids below ``folder``, which driver and executors share.

    ``expected`` is about how many ids it will hold: with ``bits`` bits for each, some one
    in a hundred of the new ids is joined for nothing. More ids only make that share grow;
    answers are exact whatever the filter says. A store that is opened again must be given
    the same numbers.
    """

    def __init__(self, spark: SparkSession, folder: str, expected: int, bits: int = 12, hashes: int = 5):
        if expected < 1 or bits < 1 or hashes < 1:
            raise ValueError("expected ids, bits and hashes must be positive")
        self.spark, self.folder = spark, folder.rstrip("/")
        self.blocks, self.hashes = -(-expected * bits // BLOCK_BITS), hashes

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/filter")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        names = [s.getPath().getName() for s in store.listStatus(path)]
        # a version counts when its write has been committed
        done = [n for n in names if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/filter/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def batches(self) -> int:
        """How many batches the store holds."""
        found = self._versions()
        return found[-1] + 1 if found else 0

    def _block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks)).cast("int")

    def _places(self, key: Column) -> Column:
        return F.array(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BLOCK_BITS)) for k in range(self.hashes)])

    def _ids(self, upto: int) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/ids/batch={k}" for k in range(upto)]).select("id").distinct()

    def ask(self, rows: DataFrame, key: str) -> DataFrame:
        """Adds ``seen`` to rows: false where the filter rules their id out, else null.

        A null id is never seen.
        """
        versions = self._versions()
        if not versions:
            return rows.withColumn("seen", F.lit(False))
        bits = self.spark.read.parquet(f"{self.folder}/filter/version={versions[-1]}")
        asked = rows.withColumn("_block", self._block(F.col(key))).join(bits, F.col("_block") == F.col("block"), "left")

        def is_set(place: Column) -> Column:
            byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.floor(byte / F.pow(F.lit(2), place % 8)).cast("int") % 2 == 1

        maybe = F.col(key).isNotNull() & F.col("bits").isNotNull() & F.forall(self._places(F.col(key)), is_set)
        return asked.select(*rows.columns, F.when(~maybe, F.lit(False)).alias("seen"))

    def add(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose id was in no earlier batch, after storing the batch's ids.

        Rows of one batch that share a new id are all new, as are rows without id. The
        filter's version is written last: a batch that was interrupted is added anew.
        """
        number = self.batches()
        asked = self.ask(rows, key)
        path = f"{self.folder}/new/batch={number}"
        if number:
            known = self._ids(number).withColumnRenamed("id", "_id")
            unsure = asked.where("seen IS NULL").join(known, F.col(key) == F.col("_id"), "left_anti")
            fresh = asked.where("seen IS NOT NULL").unionByName(unsure)
        else:
            fresh = asked
        fresh.drop("seen").write.mode("overwrite").parquet(path)
        fresh = self.spark.read.schema(rows.schema).parquet(path)
        ids = fresh.where(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct()
        ids.write.mode("overwrite").parquet(f"{self.folder}/ids/batch={number}")
        mine = self.spark.read.parquet(f"{self.folder}/ids/batch={number}")
        set_bits = mine.select(self._block(F.col("id")).alias("block"), F.explode(self._places(F.col("id"))).alias("place"))
        bits = set_bits.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
        if number:
            before = self.spark.read.parquet(f"{self.folder}/filter/version={number - 1}")
            bits = before.unionByName(bits).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
        bits.write.mode("overwrite").parquet(f"{self.folder}/filter/version={number}")
        return fresh

    def repeated(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose id is stored, exactly; nothing is stored."""
        number = self.batches()
        if not number:
            return rows.where(F.lit(False))
        unsure = self.ask(rows, key).where("seen IS NULL").drop("seen")
        known = self._ids(number).withColumnRenamed("id", "_id")
        return unsure.join(known, F.col(key) == F.col("_id"), "left_semi")
