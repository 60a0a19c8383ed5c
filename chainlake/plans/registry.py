"""The catalog of chains: names, definitions, salt epochs and states, as small tables in a folder.

Every change writes a new version of a table and renames it into place; readers see whole versions. Deleted entries stay, marked.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.operators import chain
from chainlake.sources import work

TABLES = {
    "chains": "chain_id long, name string, description string, uri string, deleted boolean",
    "definitions": "chain_id long, size_query string, row_query string, salted string, positive boolean",
    "salts": "salt_id long, chain_id long, seed binary, start_row long, deleted boolean",
}


@dataclass(frozen=True)
class Rights:
    """What a catalog may do beyond reading."""

    write: bool = True
    delete: bool = False
    commit: bool = True
    rollback: bool = False


class Registry:
    def __init__(self, spark: SparkSession, path: str, rights: Rights = Rights(), prefix: str = ""):
        self.spark, self.path, self.rights, self.prefix = spark, path, rights, prefix

    def table(self, name: str) -> DataFrame:
        where = f"{self.path}/{self.prefix}{name}"
        if work.exists(self.spark, where):
            return self.spark.read.schema(TABLES[name]).parquet(where)
        return self.spark.createDataFrame([], TABLES[name])

    def _put(self, name: str, df: DataFrame) -> None:
        if not self.rights.write:
            raise PermissionError("this catalog is read only")
        where = f"{self.path}/{self.prefix}{name}"
        new = f"{where}.{os.urandom(4).hex()}.new"
        df.coalesce(1).write.parquet(new)
        work.swap(self.spark, new, where)

    def chains(self) -> DataFrame:
        return self.table("chains").where("not deleted").orderBy("chain_id")

    def find(self, *, chain_id: int | None = None, name: str | None = None, uri: str | None = None) -> DataFrame:
        out = self.chains()
        for column, value in (("chain_id", chain_id), ("name", name), ("uri", uri)):
            if value is not None:
                out = out.where(F.col(column) == value)
        return out

    def create(self, name: str, description: str = "", uri: str | None = None) -> int:
        if not name.strip():
            raise ValueError("a chain needs a name")
        if self.find(name=name).count() or uri is not None and self.find(uri=uri).count():
            raise ValueError(f"chain {name!r} or its uri is there already")
        every = self.table("chains")
        chain_id = (every.agg(F.max("chain_id")).first()[0] or 0) + 1
        self._put("chains", every.unionByName(self.spark.createDataFrame([(chain_id, name, description, uri, False)], TABLES["chains"])))
        return chain_id

    def update(self, chain_id: int, **changes: str | None) -> None:
        if not set(changes) <= {"name", "description", "uri"} or not self.find(chain_id=chain_id).count():
            raise ValueError("no such chain or column")
        out, mine = self.table("chains"), F.col("chain_id") == chain_id
        for column, value in changes.items():
            out = out.withColumn(column, F.when(mine, F.lit(value)).otherwise(F.col(column)))
        self._put("chains", out)

    def delete(self, chain_id: int) -> None:
        if not self.rights.delete:
            raise PermissionError("this catalog deletes nothing")
        self._put("chains", self.table("chains").withColumn("deleted", F.col("deleted") | (F.col("chain_id") == chain_id)))

    def define(self, chain_id: int, size_query: str, row_query: str, salted: tuple[int, ...] = (), positive: bool = True) -> None:
        """A chain's queries and salt scheme, once for good."""
        from chainlake.sources.sql import check_query

        if not self.find(chain_id=chain_id).count():
            raise ValueError("no such chain")
        every = self.table("definitions")
        if every.where(F.col("chain_id") == chain_id).count():
            raise ValueError("a chain's definition can't be changed")
        row = (chain_id, check_query(size_query, 0), check_query(row_query, 1), ",".join(map(str, salted)), positive)
        self._put("definitions", every.unionByName(self.spark.createDataFrame([row], TABLES["definitions"])))

    def add_epoch(self, chain_id: int, start_row: int, seed: bytes | None = None) -> int:
        """A salt epoch that starts later than all of the chain's others; the first starts at row 1. Its id."""
        seed = os.urandom(32) if seed is None else seed
        mine = self.epochs(chain_id)
        if start_row != 1 if not mine else start_row <= mine[-1][0] or len(seed) != len(mine[0][1]):
            raise ValueError("epochs start at row 1, go up, and have seeds of one length")
        every = self.table("salts")
        salt_id = (every.agg(F.max("salt_id")).first()[0] or 0) + 1
        self._put("salts", every.unionByName(self.spark.createDataFrame([(salt_id, chain_id, bytearray(seed), start_row, False)], TABLES["salts"])))
        return salt_id

    def epochs(self, chain_id: int) -> list[tuple[int, bytes]]:
        """(start_row, seed) of a chain, in order: what joins.with_epoch_seed takes."""
        found = self.table("salts").where(~F.col("deleted") & (F.col("chain_id") == chain_id)).orderBy("start_row")
        return [(r["start_row"], bytes(r["seed"])) for r in found.collect()]

    def states(self) -> DataFrame:
        """chain_id, name, defined, epochs of every chain."""
        defined = self.table("definitions").select("chain_id", F.lit(True).alias("defined"))
        epochs = self.table("salts").where("not deleted").groupBy("chain_id").agg(F.count("*").alias("epochs"))
        out = self.chains().join(defined, "chain_id", "left").join(epochs, "chain_id", "left")
        return out.select("chain_id", "name", F.coalesce("defined", F.lit(False)).alias("defined"), F.coalesce("epochs", F.lit(0)).alias("epochs"))

    def committed(self, chain_id: int) -> DataFrame:
        """The chain's committed rows."""
        return chain.committed(self.spark, self._rows(chain_id))

    def commit(self, chain_id: int, rows: DataFrame) -> int:
        """Append chain rows (ledger_id, row_no, input_hash, row_hash) to the chain; the number that weren't there yet."""
        if not self.rights.commit:
            raise PermissionError("this catalog commits nothing")
        return chain.append(self._rows(chain_id), rows)

    def rollback(self, chain_id: int, to: DataFrame) -> None:
        """Trim the chain to sizes (ledger_id, size)."""
        if not self.rights.rollback:
            raise PermissionError("this catalog rolls nothing back")
        chain.rollback(self._rows(chain_id), to)

    def _rows(self, chain_id: int) -> str:
        if not self.find(chain_id=chain_id).count():
            raise ValueError("no such chain")
        return f"{self.path}/{self.prefix}rows-{chain_id}"
