"""Merkle trees over short lists of hashes, by RFC 6962: leaves are hashed after byte 0, inner nodes after byte 1."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of a tree over at most 64 leaves: a row number of 63 bits has no more pointers.
ROUNDS = 6


def _sha(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def root(leaves: list[bytes]) -> bytes:
    layer = [_sha(b"\0" + x) for x in leaves]
    while len(layer) > 1:
        pairs = [_sha(b"\1" + a + b) for a, b in zip(layer[::2], layer[1::2])]
        layer = pairs + layer[len(layer) - len(layer) % 2 :]
    return layer[0]


def funnel(leaves: list[bytes], index: int) -> list[bytes]:
    """The sibling hashes that prove a leaf, from the leaf up."""
    layer, out = [_sha(b"\0" + x) for x in leaves], []
    while len(layer) > 1:
        sibling = index ^ 1
        if sibling < len(layer):
            out.append(layer[sibling])
        pairs = [_sha(b"\1" + a + b) for a, b in zip(layer[::2], layer[1::2])]
        layer, index = pairs + layer[len(layer) - len(layer) % 2 :], index // 2
    return out


def root_from(leaf: bytes, index: int, count: int, proof: list[bytes]) -> bytes:
    """The root that a leaf and its funnel prove."""
    node, rest = _sha(b"\0" + leaf), list(proof)
    while count > 1:
        if index ^ 1 < count:
            other = rest.pop(0)
            node = _sha(b"\1" + (other + node if index % 2 else node + other))
        index, count = index // 2, (count + 1) // 2
    if rest:
        raise ValueError("the funnel is too long")
    return node


def root_col(leaves: Column) -> Column:
    """root() of an array of at most 64 hashes (null for none). Each layer is bound once, so the expression stays small however
    the plan moves it."""
    sha = lambda data: F.unhex(F.sha2(data, 256))

    def above(layer: Column) -> Column:
        at = lambda i: F.try_element_at(layer, i)
        pair = lambda k: F.when(F.size(layer) < 2 * k, at(2 * k - 1)).otherwise(sha(F.concat(F.lit(b"\1"), at(2 * k - 1), at(2 * k))))
        return F.when(F.size(layer) > 1, F.transform(F.sequence(F.lit(1), F.ceil(F.size(layer) / 2).cast("int")), pair)).otherwise(layer)

    layer = F.transform(leaves, lambda h: sha(F.concat(F.lit(b"\0"), h)))
    for _ in range(ROUNDS):
        layer = F.transform(F.array(layer), above)[0]
    return F.try_element_at(layer, F.lit(1))


def _layers(leaves: Column, use) -> Column:
    """use(layers) with the array of all layers of the tree over leaves, each layer an array of hashes, bound once."""
    sha = lambda data: F.unhex(F.sha2(data, 256))

    def above(layer: Column) -> Column:
        at = lambda i: F.try_element_at(layer, i)
        pair = lambda k: F.when(F.size(layer) < 2 * k, at(2 * k - 1)).otherwise(sha(F.concat(F.lit(b"\1"), at(2 * k - 1), at(2 * k))))
        return F.when(F.size(layer) > 1, F.transform(F.sequence(F.lit(1), F.ceil(F.size(layer) / 2).cast("int")), pair)).otherwise(layer)

    first = F.transform(leaves, lambda h: sha(F.concat(F.lit(b"\0"), h)))
    every = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.array(first), lambda layers, _: F.concat(layers, F.array(above(F.element_at(layers, -1)))))
    return F.transform(F.array(every), use)[0]


def funnel_col(leaves: Column, index: Column) -> Column:
    """funnel() of an array of at most 64 hashes."""

    def siblings(layers: Column) -> Column:
        # the node above a leaf in layer k is its index without the last k bits; its sibling's differs in one bit
        of = lambda layer, k: F.get(layer, F.call_function("shiftright", index, k).bitwiseXOR(F.lit(1)))
        return F.array_compact(F.transform(layers, lambda layer, k: F.when(F.size(layer) > 1, of(layer, k))))

    return _layers(leaves, siblings)


def root_from_col(leaf: Column, index: Column, count: Column, proof: Column) -> Column:
    """root_from(): the root that a leaf and its funnel prove; null for a funnel of another length."""
    sha = lambda data: F.unhex(F.sha2(data, 256))
    start = F.struct(sha(F.concat(F.lit(b"\0"), leaf)).alias("node"), index.cast("int").alias("i"), count.cast("int").alias("n"), F.lit(0).alias("used"))

    def step(state: Column, _: Column) -> Column:
        sibling = state["i"].bitwiseXOR(F.lit(1)) < state["n"]
        other = F.get(proof, state["used"])
        node = F.when(state["i"] % 2 == 1, sha(F.concat(F.lit(b"\1"), other, state["node"]))).otherwise(sha(F.concat(F.lit(b"\1"), state["node"], other)))
        up = F.struct(F.when(sibling, node).otherwise(state["node"]).alias("node"), F.floor(state["i"] / 2).cast("int").alias("i"), F.floor((state["n"] + 1) / 2).cast("int").alias("n"), (state["used"] + sibling.cast("int")).alias("used"))
        return F.when(state["n"] > 1, up).otherwise(state)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(s["used"] == F.size(proof), s["node"]))
    return end
