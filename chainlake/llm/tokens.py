"""Operator 10: token counts by byte-pair merging over a heap and a linked list; and the splitting that packing shares.

A text is cut at spaces that follow a character other than white space. No pretoken of the byte-level split spans such a
place, so each piece can be counted alone, and pieces that recur are looked up. The table of pieces is bounded by
CACHE_ENTRIES; pieces beyond it are computed each time, so the bound changes the speed only.

A pretoken's count is its number of bytes less the merges made: the pairs of neighbours lie in a heap by rank, the symbols
in a linked list; the lowest rank, leftmost first, is popped and merged until no pair has a rank. No ids are made. An
added special string counts 1, as the library has it by default.

Defined cases: a null or empty text has 0 bytes and 0 tokens; texts have no length limit; repeated rows are counted each;
null ids are kept; an empty table gives an empty result; columns other than doc_id and text are ignored.

Rows stay where they are: no shuffle, and memory is bounded by Arrow batches of BATCH_ROWS rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession

from chainlake.llm.shared import table

CACHE_ENTRIES = 700_000
#: Longer pieces are not kept, so the table's bytes are bounded too.
CACHE_PIECE = 64
#: The byte-level split, as the public format defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512

_SPACE_AFTER_SPACE = re.compile(r"\s ")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(text: str) -> list[str] | None:
    """The text's parts between spaces; each but the first had one space before it. None if a space follows white space."""
    if text.isascii():
        if "  " in text or "\n " in text or "\t " in text or "\r " in text or "\x0b " in text or "\x0c " in text:
            return None
    elif _SPACE_AFTER_SPACE.search(text):
        return None
    return text.split(" ")


class PieceTable(dict):
    """Values of pieces (without the space before them), computed when first asked for."""

    def __init__(self, compute: Callable[[str], object], most: int = CACHE_ENTRIES):
        self.compute, self.most = compute, most

    def __missing__(self, piece: str) -> object:
        value = self.compute(" " + piece)
        if len(self) < self.most and len(piece) <= CACHE_PIECE:
            self[piece] = value
        return value

    def renew(self) -> None:
        """At the start of a task: a full table is emptied, as this task's texts may differ."""
        if len(self) >= self.most:
            self.clear()


def byte_symbols() -> list[str]:
    """The character that the vocabulary format writes for each byte: printable ones stand for themselves, others follow from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class MergeCounter:
    """Token counts from a vocabulary file's merges."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        symbols = byte_symbols()
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        self.byte_ids = [number(s) for s in symbols]
        #: left id << 32 | right id -> rank << 32 | merged id
        self.rules: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rules.setdefault(number(a) << 32 | number(b), rank << 32 | number(a + b))
        self.split = regex.compile(PATTERN).findall
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.table = PieceTable(self.count_raw)

    def count_pretoken(self, pretoken: str) -> int:
        """Bytes less merges, by a heap of neighbouring pairs and a linked list of symbols."""
        rules, byte_ids = self.rules.get, self.byte_ids
        symbol = [byte_ids[b] for b in pretoken.encode()]
        n = left = len(symbol)
        heap = [(rule, i) for i in range(n - 1) if (rule := rules(symbol[i] << 32 | symbol[i + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rule, i = heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n or rules(symbol[i] << 32 | symbol[j]) != rule:
                continue  # one of the two has been merged since
            merged = symbol[i] = rule & 0xFFFFFFFF
            symbol[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rule := rules(merged << 32 | symbol[k])) is not None:
                    heappush(heap, (rule, i))
            if (k := before[i]) >= 0 and (rule := rules(symbol[k] << 32 | merged)) is not None:
                heappush(heap, (rule, k))
        return left

    def count_raw(self, text: str) -> int:
        count = self.count_pretoken
        parts = self.special.split(text)
        return len(parts) - 1 + sum(count(p) for part in parts for p in self.split(part))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = pieces(text)
        if parts is None:
            return self.count_raw(text)
        first = parts.pop(0)
        return self.count_raw(first) + sum(map(self.table.__getitem__, parts))


@lru_cache(maxsize=2)
def merge_counter(path: str) -> MergeCounter:
    """One for each Python worker and file."""
    return MergeCounter(path)


def token_counts(docs: DataFrame, *, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. vocabulary: a byte-level BPE file that every executor has."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = merge_counter(path)
        counter.table.renew()
        for batch in batches:
            texts = batch.column(1)
            tokens = pa.array([counter.count(t.as_py()) for t in texts], pa.int64())
            n_bytes = pa.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], pa.int64())
            over = pa.array([t > limit for t in tokens.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, tokens, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_counts": op10_token_counts}
SQL: dict[str, str] = {}
