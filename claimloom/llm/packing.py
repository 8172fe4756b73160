"""Filling containers of fixed capacity with texts measured in tokens.

Best-two-fit. A text longer than the capacity is cut into full containers and a rest; nothing else is ever split. The pieces
are spread by a hash over shards whose number follows their count, so that each task packs a bounded share whatever the
corpus or a source's part of it, and each shard is packed by itself: a container is filled greedily with the largest piece
that fits its gap until none does; then its smallest piece goes back, if two pieces that are still unpacked fit the gap so
widened more tightly. Packing works on the counts of each size, so a step costs a few operations on one integer whose bits
are the sizes in stock, not a search through pieces. All shards together leave at most one badly filled container each.

Defined cases: texts of no tokens, null and empty ones included, need no container; repeated rows are packed as often as they
occur; capacities that are null or below one, and repeated windows, are ignored; an empty input gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import cut

#: Pieces that one task packs. A shard's last container may stay half empty: one container in some ten thousand.
SHARD_PIECES = 100_000


class Stock:
    """Pieces by size: ``stock[size]`` is a list of piece numbers; ``bits`` has bit s set where size s is in stock."""

    def __init__(self, sizes: list[int]):
        self.by: dict[int, list[int]] = {}
        for i, s in enumerate(sizes):
            self.by.setdefault(s, []).append(i)
        for v in self.by.values():
            v.reverse()
        self.bits = sum(1 << s for s in self.by)

    def largest(self, most: int) -> int:
        """The largest size in stock that is at most ``most``, or 0."""
        return (self.bits & ((2 << most) - 1)).bit_length() - 1 if most > 0 and self.bits & ((2 << most) - 1) else 0

    def take(self, size: int) -> int:
        v = self.by[size]
        i = v.pop()
        if not v:
            del self.by[size]
            self.bits ^= 1 << size
        return i

    def give(self, size: int, i: int) -> None:
        if size not in self.by:
            self.by[size] = []
            self.bits |= 1 << size
        self.by[size].append(i)

    def pair(self, gap: int, above: int) -> tuple[int, int] | None:
        """Two pieces whose sizes add up to at most ``gap``, more than ``above`` and as much as any pair does."""
        best: tuple[int, int] | None = None
        a = self.largest(gap - 1)
        while a and 2 * a > above:
            b = self.largest(min(a, gap - a))
            if b == a and len(self.by[a]) < 2:
                b = self.largest(a - 1)
            if b and a + b > above:
                best, above = (a, b), a + b
                if above == gap:
                    break
            a = self.largest(a - 1)
        return best


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers, each a list of positions in ``sizes``; every size is between 1 and ``capacity``."""
    stock, out = Stock(sizes), []
    while stock.bits:
        gap, held = capacity, []
        while s := stock.largest(gap):
            held.append((s, stock.take(s)))
            gap -= s
        if gap and stock.bits:
            small, i = held[-1]
            if two := stock.pair(gap + small, small):
                held.pop()
                held += [(s, stock.take(s)) for s in two]
                stock.give(small, i)
        out.append([i for _, i in held])
    return out


def containers(token_table: DataFrame, windows: DataFrame, key: str = "doc_id", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(window_id, capacity, container, key, start_token, tokens): which tokens of which text each container holds.

    ``token_table``: (key, tokens). ``windows``: (window_id, capacity), a fixed table of a few rows, which the driver reads.
    ``container`` is unique within a window and the same however often the job runs.
    """
    sizes = [(r[0], r[1]) for r in windows.where("capacity >= 1").groupBy("window_id").agg(F.min("capacity")).collect()]
    spark = token_table.sparkSession
    counted = token_table.select(F.col(key).alias("__key"), F.col("tokens").cast("long").alias("__n")).where("__n > 0").groupBy("__key", "__n").agg(F.count("*").alias("__copies"))
    docs = cut(counted.select("__key", "__n", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")))
    shards = max(1, -(-docs.count() // shard_pieces))
    if not sizes:
        return spark.createDataFrame([], f"window_id int, capacity int, container string, `{key}` {token_table.schema[key].dataType.simpleString()}, start_token long, tokens long")
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("window_id"), F.lit(c).alias("capacity")) for w, c in sorted(sizes)]))
    pieces = docs.select("__key", "__n", "__copy", each.alias("w")).select("__key", "__n", "__copy", "w.*", F.expr("__n div w.capacity").alias("__full"))
    whole = pieces.where("__full > 0").select(
        "window_id", "capacity", "__n", "__copy", F.col("__key").alias(key), F.explode(F.sequence(F.lit(0), F.col("__full") - 1)).alias("__k")
    ).select("window_id", "capacity", F.concat_ws("-", F.lit("full"), F.coalesce(F.col(key).cast("string"), F.lit("null")), "__n", "__copy", "__k").alias("container"), key, (F.col("__k") * F.col("capacity")).alias("start_token"), F.col("capacity").cast("long").alias("tokens"))
    rest = pieces.withColumn("tokens", F.col("__n") % F.col("capacity")).where("tokens > 0").select("window_id", "capacity", F.pmod(F.xxhash64("__key"), F.lit(shards)).alias("shard"), F.col("__key").alias(key), (F.col("__n") - F.col("tokens")).alias("start_token"), "tokens")

    def run(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        window_id, capacity, shard = k
        g = g.sort_values(["tokens", key, "start_token"], kind="stable").reset_index(drop=True)
        number = [0] * len(g)
        for n, held in enumerate(pack(g["tokens"].tolist(), int(capacity))):
            for i in held:
                number[i] = n
        return pd.DataFrame({"window_id": window_id, "capacity": capacity, "container": [f"{shard}-{n}" for n in number], key: g[key], "start_token": g["start_token"], "tokens": g["tokens"]})

    schema = f"window_id int, capacity int, container string, `{key}` {token_table.schema[key].dataType.simpleString()}, start_token long, tokens long"
    return rest.groupBy("window_id", "capacity", "shard").applyInPandas(run, schema).unionByName(whole)


def fill(packed: DataFrame) -> DataFrame:
    """(window_id, capacity, containers, tokens, fewest, empty_share) of a packing; ``fewest``: tokens / capacity, rounded up."""
    used = packed.groupBy("window_id", "capacity", "container").agg(F.sum("tokens").alias("tokens"))
    return used.groupBy("window_id", "capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens")).select(
        "window_id", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"),
        F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("empty_share"),
    )
