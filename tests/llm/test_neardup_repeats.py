import random

from lantern.llm import neardup
from tests.llm.test_neardup import shingle_sets

SCHEMA = "doc_id long, text string"


def brute(rows):
    """Components of doc_ids, linked by any two of their texts."""
    root = {d: d for d, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, shingle_sets(t)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a0, b0 = sorted((top(a), top(b)))
                root[b0] = a0
    return sorted((d, len(shingle_sets(t)), top(d), top(d) == d) for d, t in rows)


def got(spark, rows):
    return sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id", "kept").collect()))


def test_every_text_of_an_id_links(spark):
    a, b = "one two three four", "five six seven eight"
    for first, second in ((a, b), (b, a)):
        rows = [(5, first), (5, second), (7, second)]
        assert got(spark, rows) == brute(rows) and brute(rows)[2][2] == 5
        left = neardup.one_of_each(spark.createDataFrame(rows, SCHEMA))
        assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted(rows[:2])


def test_ids_join_what_their_texts_link(spark):
    r = random.Random(7)
    rows = []
    for base in range(25):
        words = [f"w{base}-{k}" for k in range(60)]
        for _ in range(r.choice([1, 2, 4])):
            changed = [w if r.random() > 0.03 else f"c{r.random()}" for w in words]
            rows.append((r.randrange(30) * r.choice([1, -1]), " ".join(changed)))
    rows += [rows[0], (rows[1][0], ""), (rows[2][0], None), (99, " "), (99, rows[3][1])]
    r.shuffle(rows)
    assert len({d for d, _ in rows}) < len(rows) - 10
    assert got(spark, rows) == brute(rows)
