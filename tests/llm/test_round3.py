"""Word runs, importance resampling and the set join against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairforge.llm import importance, registry, set_join, word_runs

SCHEMA = "doc_id long, text string, lang string, source string, rank int, cid string, row int, n long, weight double"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def runs_by_comparison(w, least=6, power=4):
    out = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


#: Ids of documents whose text op11 leaves as it is.
LONG = [i for i in range(400, 500) if zlib.crc32(str(i).encode()) % 10][:4]


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(60):
        w = [rng.choice("ab" if i % 3 else "abcdefghijkl") for _ in range(rng.randrange(0, 90))]
        if i % 4 == 0 and w:
            a = rng.randrange(len(w))
            w = w[: a + 5] + w[a : a + rng.randrange(1, 6)] * rng.randrange(2, 9) + w[a:]
        rows.append((i, " ".join(w)))
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    for i in range(60, 110):  # near copies on both sides of the limit
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w[: rng.randrange(140, 151)])))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "One two"), (204, "one  TWO"), (205, "one"), (206, "日本語 É é 😀"), (206, "日本語 É é 😀"), (206, " ".join(base)), (None, " ".join(base)), (None, "ab " * 30)]
    rows += [(LONG[0], "lorem ipsum dolor " * 15000), (LONG[1], " ".join(str(i % 977) for i in range(30000))), (LONG[2], "x " * 40000), (LONG[3], "x" * 200_000)]
    rows += [(211 + i, " ".join(base)) for i in range(40)]  # many copies
    rows += [(300, "a b c d e f g h i j k"), (301, "a b c d e f g h i j"), (302, "p q r s t u v w x y z"), (303, "p q r s t u v w x y")]  # 8 of 9 shingles
    rows += [(304, " ".join(f"t{i}" for i in range(11))), (305, " ".join(f"t{i}" for i in range(12)))]  # 9 of 10: linked
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 2, 3, 0.5) for i, t in corpus()], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_comparison_of_all_shifts(seed):
    rng = random.Random(seed)
    for _ in range(150):
        letters = rng.randrange(1, 5)
        w = [rng.randrange(letters) for _ in range(rng.randrange(0, 70))]
        if rng.random() < 0.5:
            block = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(w) + 1)
            w = w[:at] + block * rng.randrange(1, 8) + block[: rng.randrange(len(block))] + w[at:]
        for least, power in ((6, 4), (2, 2), (9, 3)):
            assert [tuple(r) for r in word_runs.runs(np.array(w, np.int64), least, power).tolist()] == runs_by_comparison(w, least, power)


def test_automaton_knows_all_substrings():
    rng = random.Random(3)
    for _ in range(50):
        w = [rng.randrange(3) for _ in range(rng.randrange(1, 25))]
        length, link, end = word_runs.automaton(w)
        assert sum(n - length[p] for n, p in zip(length[1:], link[1:], strict=True)) == len({tuple(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)})
        assert sorted(e for e in end if e >= 0) == list(range(len(w)))


def echoed(i, t):
    w = SPACE.findall(t or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    return w


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_word_runs_query(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in corpus():
        w = echoed(i, t)
        found = runs_by_comparison(w) if len(w) < 2000 else [(0, len(w), len(set(w)))]  # long texts repeat all their words
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in found), default=None)
        tail = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want.append((i, len(found), *tail, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = [tuple(r) for r in registry.op11_word_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[1] for r in want if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0)


def test_long_period(docs):
    got = word_runs.detect(docs.where(F.col("doc_id").isin(LONG[1], LONG[3]))).orderBy("doc_id").collect()
    assert [tuple(r) for r in got[0].runs] == [(0, 30000, 977)] and got[0].collapsed == " ".join(map(str, range(977)))
    assert got[1].runs == [] and got[1].n_words == 1


@pytest.mark.parametrize("percent", [10, 50])
def test_importance(spark, docs, percent):
    target = ["w1 w2 w3 a b", "a a a É", None, ""]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    split = lambda t: ALNUM.findall(small(t))
    code = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, text in corpus():
        np.add.at(s, [code(f) for f in split(text)], 1)
    for text in target:
        np.add.at(t, [code(f) for f in split(text)], 1)
    gain = [math.floor(1000 * math.log((float(b) + 1) * (float(s.sum()) + 10000) / ((float(a) + 1) * (float(t.sum()) + 10000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in corpus():
        w = split(text)
        weight = sum(gain[code(f)] for f in w) // len(w) if w else 0
        score = None
        if i is not None:
            score = weight + math.floor(-1000 * math.log(-math.log((int(sha(f"2024:{i}")[:8], 16) + 0.5) / 4294967296)))
        rows.append([i, len(w), weight, score, None])
    able = sorted((r for r in rows if r[3] is not None and r[1] >= 20), key=lambda r: (-r[3], r[0], -r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    got = [list(r) for r in importance.resample(docs, aim, percent).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_ranks_do_not_depend_on_partitions(spark, docs):
    aim = spark.createDataFrame([("w1 w2",)], "text string")
    made = [sorted(map(tuple, importance.resample(docs.repartition(n), aim).collect()), key=repr) for n in (1, 7)]
    assert made[0] == made[1]
    assert importance.resample(docs, aim.where("false")).count() == docs.count()


def test_bigrams_are_features(spark):
    rows = spark.createDataFrame([("a b a",), ("a",), (None,)], "text string")
    got = rows.select(importance.features(importance.words(F.col("text")), 3).alias("f")).collect()
    assert [r.f for r in got] == [["a", "b", "a", "a b", "b a", "a b a"], ["a"], []]


def components_by_comparison(rows, shingle, percent):
    sets = []
    for i, t in rows:
        w = SPACE.findall(small(t))
        sets.append(frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset())
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and rows[a][0] is not None and rows[b][0] is not None and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    label[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), least.get(root(k)) if i is not None else None) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("shingle", "percent", "block"), [(3, 90, None), (3, 90, 400), (2, 80, 700), (3, 95, None)])
def test_set_join(docs, monkeypatch, shingle, percent, block):
    if block:
        monkeypatch.setattr(set_join, "BLOCK_TOKENS", block)
        monkeypatch.setattr(set_join, "QUERY_TOKENS", 2 * block)
    got = sorted((tuple(r) for r in set_join.join(docs, shingle, percent).collect()), key=repr)
    assert got == components_by_comparison(corpus(), shingle, percent)


@pytest.mark.parametrize("block", [300, 128_000])
def test_groups_that_no_leader_explains(spark, monkeypatch, block):
    """Chains of near copies, whose ends are far from each other, and templates that fill with other words."""
    monkeypatch.setattr(set_join, "BLOCK_TOKENS", block)
    rng = random.Random(4)
    rows, w = [], [f"c{k}" for k in range(90)]
    for i in range(60):
        w[rng.randrange(90)] = f"n{i}"
        rows.append((i, " ".join(w)))
    for i in range(60, 120):
        t = [f"f{k}" for k in range(60)]
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(60)] = f"v{rng.randrange(6)}"
        rows.append((i, " ".join(t)))
    rng.shuffle(rows)
    got = sorted((tuple(r) for r in set_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == components_by_comparison(sorted(rows), 3, 90)


def test_bound_opens_only_groups_that_may_hold_a_partner():
    made = lambda *lists: set_join._Sets(pa.array(lists, pa.list_(pa.int64())))
    members = made(list(range(10)), list(range(5, 16)))
    queries = made(list(range(9)), list(range(16, 30)), [], list(range(3, 13)))
    pairs = {(int(a), int(b)) for x in set_join.similar(queries, members, 90) for a, b in zip(*x, strict=True)}
    assert pairs == {(0, 0)}
    assert {(int(a), int(b)) for x in set_join.similar(made(), members, 90) for a, b in zip(*x, strict=True)} == set()


def test_empty_tables(empty):
    assert word_runs.digests(word_runs.detect(empty)).count() == 0
    assert importance.resample(empty, empty).count() == 0
    assert set_join.join(empty).count() == 0


def test_workers_give_memory_back(spark):
    """Workers outlive a stage: what one stage frees in them must not count in the next."""
    from pairforge.llm.shared import WORKERS, ready

    def scan(batches):
        import os

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"pool": [pa.default_memory_pool().backend_name], "trim": [os.environ.get("MALLOC_TRIM_THRESHOLD_")]})

    ready(spark)
    assert {tuple(r) for r in spark.range(2, numPartitions=1).mapInArrow(scan, "pool string, trim string").collect()} == {("system", WORKERS["MALLOC_TRIM_THRESHOLD_"])}
