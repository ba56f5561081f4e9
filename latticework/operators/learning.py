"""Learning weights from gold segmentations: sentences are decoded in tasks, a batch at a time,
and the driver updates the weights in the order of the sentences, so results don't depend on
which task ends first."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.hashing import BOS_PATTERN, PREFIXES, mix_one
from latticework.operators.evaluation import ConfidenceWeighted
from latticework.operators.search import Lattices, beam_search, node_codes
from latticework.operators.trie import codes_of

BITS = 16


def features(codes: list[int], bits: int = BITS) -> Counter:
    """How often each masked feature occurs on a path of nodes, the end of the sentence included."""
    mask, t1, t2, out = (1 << bits) - 1, BOS_PATTERN, BOS_PATTERN, Counter()
    for code in [*codes, 0]:
        uni, bi, tri = (mix_one(p, code) for p in PREFIXES)
        out.update((uni & mask, mix_one(bi, t1) & mask, mix_one(mix_one(tri, t1), t2) & mask))
        t1, t2 = code, t1
    return out


def best_of(texts: list[str], edges: list[list[tuple[int, int]]], weights, beam: int, bits: int) -> tuple[Lattices, list[list[tuple[int, int]]]]:
    """Sentences as lattices, and each one's best path."""
    begins, codes = codes_of(texts)
    found = sorted({(row, *e) for row, of in enumerate(edges) for e in of})
    row, start, end = np.array(found, np.int64).reshape(-1, 3).T
    x = Lattices(0, begins, codes, row, start, end)
    made, paths = beam_search(x, weights, beam, 1, bits=bits), [[] for _ in texts]
    for rows, _, nodes, _ in made.paths(1):
        for r, k in zip(rows.tolist(), nodes.tolist()):
            if made.source[k] != -2:
                paths[r].append((int(made.start[k]), int(made.end[k])))
    return x, [p[::-1] for p in paths]


def loss(path: list[tuple[int, int]], gold: list[tuple[int, int]]) -> float:
    """The share of gold words that the path hasn't."""
    return 1 - len(set(path) & set(gold)) / max(1, len(gold))


def annealed_beam(ratio: float, first: int, last: int) -> int:
    """The global beam when a share `ratio` of the epochs is over: from first down to last."""
    share = max(0.0, 1.09574 * float(np.exp(-3.04689 * ratio)) - 0.0957439)
    return last + round((first - last) * share)


def train(lattices: DataFrame, ids: list[str], epochs: int = 3, batch: int = 100, most: int = 1000, beam: int = 3, bits: int = BITS, least_loss: float = 1e-3) -> tuple[np.ndarray, list[float]]:
    """(weights, loss of each epoch) from lattices (<ids>, text, edges, gold), gold being the
    array<struct<start, end>> of the right path; its words are candidates in any case.

    Learning is sequential, so it takes at most `most` sentences, those that hash lowest; a
    batch's differences are what the driver holds. Ends early below `least_loss`."""
    sample = lattices.withColumn("_at", F.xxhash64(*ids)).orderBy("_at", *ids).limit(most)
    sample = sample.select("_at", "text", "edges", "gold").toPandas()
    model, losses = ConfidenceWeighted(1 << bits), []
    spark = lattices.sparkSession
    schema = "at long, loss double, features array<long>, diff array<double>"
    for epoch in range(epochs):
        order, total = np.random.default_rng(epoch).permutation(len(sample)), 0.0
        for k in range(0, len(order), batch):
            weights = spark.sparkContext.broadcast(model.weights)

            def decode(parts, weights=weights):
                for part in parts:
                    out, golds = [], [[(e["start"], e["end"]) for e in of] for of in part.gold]
                    edges = [[*((e["start"], e["end"]) for e in of), *gold] for of, gold in zip(part.edges, golds)]
                    x, paths = best_of(list(part.text), edges, lambda i: weights.value[i], beam, bits)
                    coded = lambda k, path: node_codes(x, np.full(len(path), k), *np.array(path, np.int64).reshape(-1, 2).T).tolist()  # noqa: B023, E731
                    for k, (at, gold, path) in enumerate(zip(part["at"], golds, paths)):
                        diff = features(coded(k, gold), bits)
                        diff.subtract(features(coded(k, path), bits))
                        kept = sorted(f for f, n in diff.items() if n)
                        out.append((at, loss(path, gold), kept, [float(diff[f]) for f in kept]))
                    yield pd.DataFrame(out, columns=["at", "loss", "features", "diff"])

            rows = sample.iloc[order[k : k + batch]].assign(at=np.arange(k, min(k + batch, len(order)))).drop(columns="_at")
            some = spark.createDataFrame(rows, "text string, edges array<struct<start:int,end:int>>, gold array<struct<start:int,end:int>>, at long")
            for r in some.repartition(8).mapInPandas(decode, schema).orderBy("at").toLocalIterator():
                total += r.loss
                model.update(r.loss, np.array(r.features, np.int64), np.array(r.diff))
            weights.unpersist()
        losses.append(total / max(1, len(order)))
        if losses[-1] < least_loss:
            break
    return model.weights, losses
