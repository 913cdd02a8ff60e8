"""Greedy choices over several keys against the sequential pass."""

import random

from pyspark.sql import functions as F

from lexforge.operators import curation as C


def test_merge_where_coarse_keys_differ(spark):
    rng = random.Random(1)
    rows = [(0, "A", "x"), (1, "A", "y"), (2, "B", "y")] + [(i, f"e{rng.randrange(25)}", f"c{rng.randrange(25)}") for i in range(3, 80)]
    es, cs, want = set(), set(), {}
    for i, e, c in rows:
        want[i] = "exact_duplicate" if e in es else "same_article_term" if c in cs else "first"
        if want[i] == "first":
            es.add(e)
            cs.add(c)
    got = C.merge_versions(spark.createDataFrame(rows, "id int, e string, c string"), F.col("e"), F.col("c"), ["id"])
    assert set(got.columns) == {"id", "e", "c", "reason", "keep"}
    assert {r["id"]: (r["reason"], r["keep"]) for r in got.collect()} == {i: (w, w == "first") for i, w in want.items()}


def test_sample_passes_over_known_articles(spark):
    rng = random.Random(2)
    rows = [(i, f"s{i % 4}", rng.randrange(5), [f"k{rng.randrange(30)}", f"m{i}"]) for i in range(120)]
    frame = spark.createDataFrame(rows, "id int, code string, p int, keys array<string>")
    rank = {r["id"]: r for r in frame.select("id", C.seeded(F.col("id"), 7).alias("a"), C.seeded(F.col("code"), 7).alias("b")).collect()}
    queues = {}
    for i, c, p, keys in sorted(rows, key=lambda r: (rank[r[0]]["b"], -r[2], rank[r[0]]["a"])):
        queues.setdefault(c, []).append((i, keys))
    want, known, turn = [], set(), 0
    while turn < 8 and len(want) < 25:
        turn += 1
        for c, queue in queues.items():
            while queue and len(want) < 25:
                i, keys = queue.pop(0)
                if known.isdisjoint(keys):
                    known.update(keys)
                    want.append((i, turn))
                    break
    got = C.balanced_sample(frame, "code", "id", F.col("p"), 25, 8, 7, F.col("keys")).collect()
    assert [(r["id"], r["turn"]) for r in got] == want and len(want) > 15
