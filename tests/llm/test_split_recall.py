"""Pairs at the threshold whose buckets are all split are found as often as stated."""

from __future__ import annotations

import math

import numpy as np

from ridgeflow.llm import jaccard_join as j
from ridgeflow.llm.hashing import mixed


def test_runs_allow_for_lost_paths():
    assert math.exp(-j.run_count() * j.SHARED * (1 - j.lost_in_splits())) <= 1 - j.RECALL
    assert j.run_count(depth=0) == math.ceil(-math.log(1 - j.RECALL) / j.SHARED)


def test_recall_in_split_buckets():
    recall, pairs, missed = 0.9, 1500, 0
    runs = j.run_count(1.0, recall)
    for n in range(pairs):
        tokens = mixed(np.arange(1000 * n, 1000 * n + 250, dtype=np.uint64), 3)
        a, b = tokens[:225], tokens[25:]  # 200 of 250 shared
        paths = [set(j.first_paths(s, runs, 1.0, 0.8).tolist()) for s in (a, b)]
        for _ in range(j.DEPTH):
            met = paths[0] & paths[1]
            paths = [{q for p in met for q in j.next_paths(s, p, j.DEEPER, 0.8).tolist()} for s in (a, b)]
        missed += not paths[0] & paths[1]
    assert missed <= (1 - recall) * pairs + 3 * math.sqrt((1 - recall) * pairs)
