"""Step groups of packed windows: of one tier, of nearly equal size and cost."""

import random
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")

from ledgerloom.llm import packing  # noqa: E402


def test_deal():
    r = random.Random(1)
    for n, g in ((1, 1), (7, 3), (64, 8), (100, 7), (0, 2)):
        costs = [r.randint(1, 1000) for _ in range(n)]
        where = packing.deal(costs, g)
        sizes = [where.count(k) for k in range(g)]
        assert max(sizes) - min(sizes) <= 1
        if n >= 64:
            sums = [sum(c for c, w in zip(costs, where, strict=True) if w == k) for k in range(g)]
            assert max(sums) <= 1.15 * min(sums)


def test_groups_are_balanced(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(["one", "two", "token", "packing"]) for _ in range(r.choice([20, 90, 300, 700])))) for k in range(400)]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), step_tokens=8192).collect()
    windows, groups = defaultdict(int), {}
    for p in pieces:
        windows[p.sequence_id] += p.length
        groups[p.sequence_id] = (p.sequence_id // packing.WINDOWS, p.tier, p.step_group)
    assert all(windows[s] == tier for s, (_, tier, _) in groups.items())
    size, tiers = defaultdict(int), defaultdict(set)
    for key in groups.values():
        size[key] += 1
        tiers[key[2]].add(key[1])
    assert all(len(x) == 1 for x in tiers.values())
    for task in {k[0] for k in size}:
        for tier in {k[1] for k in size if k[0] == task}:
            own = [n for (t, x, _), n in size.items() if (t, x) == (task, tier)]
            assert max(own) <= max(1, 8192 // tier)
            n, most = sum(own), max(1, 8192 // tier)
            assert len(own) == n // (packing.DEALT * most) * packing.DEALT + -(-(n % (packing.DEALT * most)) // most)
