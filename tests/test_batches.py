"""Plans of batches and named annotations against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pairforge.functions import annotators
from pairforge.operators import batches


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def plain_plan(rows, p, seed, size, factor):
    order = sorted(rows, key=lambda r: (md5(seed, p, r[0]), r[0]))
    made = []
    for s in range(0, len(order), size * factor):
        part = sorted(order[s : s + size * factor], key=lambda r: r[1] or 0)
        made += [(s // size + i // size, part[i : i + size]) for i in range(0, len(part), size)]
    made.sort(key=lambda b: (md5(seed, p, "batch", b[0]), b[0]))
    return [(p, place, at, k, n or 0, max(x or 0 for _, x in b)) for place, (_, b) in enumerate(made) for at, (k, n) in enumerate(b)]


ROWS = [(i, random.Random(i).choice([None, 0, 3, 7, 7, 40, 900])) for i in range(203)]


@pytest.mark.parametrize("parts", [1, 7])
def test_plan_resumes_at_any_batch(spark, tmp_path, parts):
    d = spark.createDataFrame(ROWS, "key long, n int").repartition(parts)
    want = sorted(x for p in range(3) for x in plain_plan(ROWS, p, 5, 4, 6))
    assert sorted(map(tuple, batches.plan(d, "key", "n", range(3), 5, 4, 6).collect())) == want
    for at, done in ((0, 0), (1, 17), (2, 51)):
        path = str(tmp_path / f"cursor{at}.json")
        batches.save_cursor(path, d, "key", "n", at, done, 5, 4, 6)
        assert sorted(map(tuple, batches.resume(path, d.repartition(3), "key", "n", 3).collect())) == [x for x in want if (x[0], x[1]) >= (at, done)]
    with pytest.raises(ValueError):
        batches.resume(path, d.where("key > 0"), "key", "n", 3)


def test_padding_and_empty_tables(spark):
    d = spark.createDataFrame(ROWS, "key long, n int")
    r = batches.padding(batches.plan(d, "key", "n", [0], 5, 4, 6), "n").head()
    assert (r.batches, r.rows, r.tokens) == (51, 203, sum(n or 0 for _, n in ROWS)) and r.tokens <= r.padded < r.padded_without_plan == 203 * 900
    assert batches.plan(d.limit(0), "key", "n", [0], 5).count() == 0


def test_each_text_is_annotated_once(spark, tmp_path):
    told = tmp_path / "told"
    told.mkdir()
    path = str(told)

    def load():
        import uuid

        def annotate(texts):
            with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(texts))
            words = {"The Hague": "GPE", "Ann Lee": "PERSON", "noon": "TIME", "five": "CARDINAL", "...": "ORG", "NASA": "ORG"}
            return [[(w, label) for w, label in words.items() if w in t] for t in texts]

        return annotate

    a, b, c = "Is Ann Lee in The Hague at noon?", "Is she in Hague in 1990 ...", "What did NASA do, five times?"
    rows = [(1, a, b), (2, b, a), (3, a, a), (4, a, c), (5, None, c), (6, "", None)]
    got = annotators.named_features(spark.createDataFrame(rows, "id long, question1 string, question2 string"), f"told{random.random()}".replace(".", ""), load)
    assert all(c in got.columns for g in annotators.GROUPS.values() for c in g) and len(annotators.GROUPS) == 9
    r = {x.id: x for x in got.collect()}
    seen = [line for f in told.iterdir() if f.read_text() for line in f.read_text().split("\n")]
    assert sorted(seen) == sorted([a, b, c]) or sorted(seen) == sorted(["", a, b, c])
    assert r[1].ents_any == 1 and r[1].ents_both == 0 and r[1].ents_unmatched_total == 1  # hague stands in the other text, ann lee does not
    assert r[1].loc_unmatched_total == 0 and r[1].date_both == 1 and r[1].date_mismatch == 1 and r[1].dateh_both == 0
    assert [r[2][c] for c in annotators.GROUPS["entity_named"]] == [r[1][c] for c in annotators.GROUPS["entity_named"]]  # the same with the sides changed
    assert r[3].ents_both == 1 and r[3].ents_mismatch == 0 and r[4].ents_mismatch == 1 and r[4].ents_unmatched_total == 3
    assert r[5].ents_one_sided == 1 and r[6].ents_any == 0


def test_a_wrong_number_of_results_is_an_error(spark):
    texts = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    with pytest.raises(Exception, match="gave 0 results"):
        annotators.spans(texts, "t", "none", lambda: lambda texts: []).agg(F.count("_spans")).collect()
