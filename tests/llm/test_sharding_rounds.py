"""Rounds of label propagation against plain loops over the same groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairnlight.llm import sharding as S


def plain(groups, capacity, rounds, classes, tie, place):
    """Cells of each group after the rounds: proposals in order of band, class and group, moves under the room there is."""
    groups = {g: list(map(list, cells)) for g, cells in groups.items()}
    for _ in range(rounds):
        load = [sum(c for cells in groups.values() for s, c in cells if s == j) for j in range(len(capacity))]
        room = [max(0, k - x) for k, x in zip(capacity, load)]
        asked = {}
        for g, cells in groups.items():
            best = max(((c, tie[g, s], s) for s, c in cells if room[s] > 0), default=None)
            if best and (asks := sum(c for _, c in cells) - best[0]) > 0:
                asked.setdefault(best[2], []).append((-math.floor(math.log2(best[0])), place[g] % classes, g, asks))
        for target, rows in asked.items():
            before = 0
            for *_, g, asks in sorted(rows):
                left = moves = max(0, min(asks, room[target] - before))
                before += asks
                for cell in groups[g] if moves else ():
                    if cell[0] == target:
                        cell[1] += moves
                    else:
                        took = min(left, cell[1])
                        left, cell[1] = left - took, cell[1] - took
                groups[g] = [cell for cell in groups[g] if cell[1] > 0]
    return groups


@pytest.mark.parametrize("seed, shards, n, slack", [(1, 4, 60, 0), (2, 8, 150, 5), (3, 3, 40, 0), (4, 16, 80, 1)])
def test_rounds_equal_plain_loops(spark, seed, shards, n, slack):
    rnd = random.Random(seed)
    groups = {g * 7 - 50: [(s, rnd.randrange(1, 6)) for s in sorted(rnd.sample(range(shards), rnd.randrange(1, min(shards, 5) + 1)))] for g in range(n)}
    groups[10**9] = [(s, 40) for s in range(shards)]  # a hot group
    total = sum(c for cells in groups.values() for _, c in cells)
    capacity = [total // shards + (j < total % shards) + slack for j in range(shards)]
    df = spark.createDataFrame(list(groups.items()), f"g long, cells {S.CELLS}")
    keys = df.select("g", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s")).select("g", "s", F.xxhash64("g", F.col("s").cast("int")).alias("t"), F.xxhash64("g").alias("h")).collect()
    tie, place = {(r.g, r.s): r.t for r in keys}, {r.g: r.h for r in keys}
    for rounds in (1, S.ROUNDS):
        got = {r.g: [[x.shard, x.c] for x in r.cells] for r in S.propagate(S.materialize(df, "g"), capacity, rounds, 5).collect()}
        want = plain(groups, capacity, rounds, 5, tie, place)
        assert got == want
        assert {g: sum(c for _, c in cells) for g, cells in got.items()} == {g: sum(c for _, c in cells) for g, cells in groups.items()}
    edges = lambda cells: sum(c * (c - 1) // 2 for _, c in cells)
    assert sum(map(edges, got.values())) > sum(map(edges, groups.values()))  # more pairs of neighbours share a shard
