"""The near stage of the pipeline against a comparison of all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from factloom.llm import near_dedup, simhash

RNG = random.Random(5)
VOCABULARY = [f"w{k}" for k in range(3000)]


def text(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def edited(words, n):
    words = list(words)
    for at in RNG.sample(range(len(words)), n):
        words[at] = "other" + str(RNG.random())
    return words


def shingle_set(t):
    words = (t or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def kept_ids(rows):
    """Smallest id of each component, all pairs compared."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        return k if root[k] == k else top(root[k])

    for a, b in combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(i, least.get(top(k), i))
    return sorted(least.values())


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())


def test_near_copies_beyond_two_bits(spark):
    base, rows = text(200), []
    for i in range(40):
        if i % 8 == 0:
            base = text(RNG.choice([30, 200, 1500]))
        rows.append((100 - i, " ".join(edited(base, len(base) // 70))))
    rows += [(200, None), (201, " "), (202, "a b"), (203, "A  b"), (204, "a c"), (205, " ".join(text(200)))]
    fps = [simhash.fingerprint(t or "") for _, t in rows[:8]]
    assert max((a ^ b).bit_count() for a, b in combinations(fps, 2)) > 2
    want = kept_ids(rows)
    assert len(want) < 20 and stage(spark, rows) == want


def test_near_copies_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").dropDuplicates(["text"]).collect()]
    assert stage(spark, rows) == kept_ids(rows)


@pytest.mark.parametrize("share", [0.9, 0.5])
def test_links_connect_every_near_pair(share):
    base = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 100, dtype=np.uint64))
    sets = [np.unique(np.r_[base[RNG.randrange(int(100 * (1 - share)) + 1) :], np.array([RNG.getrandbits(63)], np.uint64)]) for _ in range(60)]
    root = list(range(60))

    def top(k):
        return k if root[k] == k else top(root[k])

    near = lambda a, b: 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))
    found = near_dedup.near_links(sets)
    assert all(near(a, b) for a, b in found)
    for a, b in found:
        root[top(a)] = top(b)
    assert all(top(a) == top(b) for a, b in combinations(range(60), 2) if near(a, b))


def test_texts_are_joined_by_merge_at_any_size(spark):
    rows = [(k, " ".join(text(40))) for k in range(4)] * 2
    kept = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan.split("LeftAnti")[0]
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3]
