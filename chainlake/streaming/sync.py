"""Continuous commitment: new source rows extend chain tables as they arrive.

Rows come as (ledger_id, row_no, input_hash) in any order across micro-batches. Rows ahead of a gap wait in the operator's state
until the gap closes; rows at or below the committed end are checked, never hashed anew, and a difference ends the stream. What a
micro-batch reads of the chain is bounded by its own range of rows, and what the state keeps of it by a number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from chainlake.operators import chain as H


def commit_stream(inputs: DataFrame, path: str, checkpoint: str, scheme: str = "v05", max_rows: int | None = None, **trigger) -> StreamingQuery:
    """Append each micro-batch to the chain table at path. A batch that is run again after a failure commits nothing twice, as rows
    that are there are only checked. A ledger's rows must arrive without gaps between batches."""

    def commit(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        held = H.work.written(batch.select("ledger_id", "row_no", "input_hash").distinct(), "batch")
        span = held.agg(F.min("row_no").alias("low"), F.max("row_no").alias("high")).first()
        if span["low"] is None:
            return
        # only the rows in the batch's range, and the ends that are kept beside the chain, are read of what is committed
        chain = H.committed(spark, path, span["low"], span["high"])
        forked = H.conflicts(chain, held).limit(1).collect()
        if forked:
            raise ValueError(f"ledger {forked[0]['ledger_id']!r} was forked at row {forked[0]['row_no']}")
        H.append(path, H.extend(chain, held, scheme, max_rows, H.ends_of(spark, path)))

    writer = inputs.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


#: Committed rows whose inputs the operator's state keeps, once a ledger.
RECENT = 4096


class ChainProcessor(StatefulProcessor):
    """Per ledger: the frontier, the rows that wait for a gap to close, and the last `recent` committed inputs."""

    def __init__(self, scheme: str = "v05", recent: int = RECENT):
        self.scheme, self.keep = scheme, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frontier = handle.getValueState("frontier", "row_no long, hashes array<binary>")
        self.recent = handle.getMapState("committed", "row_no long", "input_hash binary")
        self.waiting = handle.getMapState("waiting", "row_no long", "input_hash binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        held = self.frontier.get() if self.frontier.exists() else (0, [])
        frontier = H.Frontier(held[0], [bytes(h) for h in held[1]], self.scheme)
        made = []
        for part in rows:
            for no, data in zip(part["row_no"].tolist(), part["input_hash"]):
                if 0 < no <= frontier.row_no - self.keep:
                    made.append((key[0], no, data, None))  # to be checked against the chain
                    continue
                known = self.recent if no <= frontier.row_no else self.waiting
                if known.containsKey((no,)):
                    if bytes(known.getValue((no,))[0]) != bytes(data):
                        raise ValueError(f"ledger {key[0]!r}: row {no} came with another hash")
                else:
                    self.waiting.updateValue((no,), (bytes(data),))
        first = frontier.row_no
        while self.waiting.containsKey((frontier.row_no + 1,)):
            no = frontier.row_no + 1
            data = bytes(self.waiting.getValue((no,))[0])
            made.append((key[0], no, data, frontier.append(data)))
            self.recent.updateValue((no,), (data,))
            if self.recent.containsKey((no - self.keep,)):
                self.recent.removeKey((no - self.keep,))
            self.waiting.removeKey((no,))
        if frontier.row_no > first:
            self.frontier.update((frontier.row_no, frontier.hashes))
        if made:
            yield pd.DataFrame(made, columns=["ledger_id", "row_no", "input_hash", "row_hash"])

    def close(self) -> None:
        pass


def chain_stream(inputs: DataFrame, scheme: str = "v05", recent: int = RECENT) -> DataFrame:
    """The chain rows of a stream of inputs, as soon as they are contiguous (needs the RocksDB state store).

    A row that comes again is compared with the last `recent` committed ones of its ledger, which the state keeps. One of before
    comes out without a row hash: settled() compares it with the chain.
    """
    rows = inputs.select("ledger_id", "row_no", "input_hash")
    return rows.groupBy("ledger_id").transformWithStateInPandas(ChainProcessor(scheme, recent), H.CHAIN, "Append", "None")


def settled(out: DataFrame) -> DataFrame:
    """What chain_stream() wrote, as a chain: rows that came again late must equal the committed ones, else an error names one."""
    chain = out.where("row_hash is not null")
    late = out.where("row_hash is null").select("ledger_id", "row_no", "input_hash")
    forked = H.conflicts(chain, late).limit(1).collect()
    if forked:
        raise ValueError(f"ledger {forked[0]['ledger_id']!r}: row {forked[0]['row_no']} came with another hash")
    return chain
