"""Near-duplicates, components, line dedup and decontamination against brute force."""

import itertools
import random

import numpy as np
import pytest

import __spark_entry__ as entry_point
from rondo.llm.components import components
from rondo.llm.decontaminate import contained_items, drop_contaminated, least_hits, slots
from rondo.llm.line_dedup import dedup_lines, line_dedup, repeated_lines
from rondo.llm.minhash_dedup import band_keys, drop_near_duplicates, near_duplicates, shingle_set
from rondo.plans.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"


def brute_components(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, set(shingle_set(t).tolist())) for i, t in rows]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        both = len(a & b)
        if a and 100 * both >= 75 * (len(a) + len(b) - both):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def family(rng, base, n, changes):
    for _ in range(n):
        words = base.split()
        for _ in range(changes):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


def test_near_duplicates_match_brute_force(spark, sample):
    rng = random.Random(1)
    texts = [r.text for r in sample.collect()]
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    for changes in (1, 2, 3, 4, 5):  # groups of near misses around one text, larger than a block when put together
        texts += list(family(rng, " ".join(word() for _ in range(120)), 60, changes))
    base = " ".join(word() for _ in range(150))
    texts += [base, *family(rng, base, 420, 5), base.upper(), base.replace(" ", "\n"), "a b", "A  b", "a b c", "a b c d e", "a b c d f"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_odd_rows(odd, none):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.kept and r.component_id == r.doc_id for r in rows)
    assert [r.n_shingles for r in rows if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert near_duplicates(none).count() == 0
    assert drop_near_duplicates(odd).columns == odd.columns and drop_near_duplicates(odd).count() == odd.count()


def test_bucket_keys_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    for n in (4, 40, 1500):
        shared = [(band_keys(np.sort(x[: 7 * n // 8])) == band_keys(np.sort(x[n // 8 :]))).sum() for x in (rng.permutation(pool)[:n] for _ in range(40))]
        assert 72 * 0.75**5 * 0.6 < np.mean(shared) < 72 * 0.75**5 * 1.5 or n == 4
        assert min(shared) > 0


def test_components(spark):
    links = [(i, i + 1) for i in range(100)] + [(300, 200), (200, 400), (7, 7), (None, 3), (50, 49)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(101), 0), 200: 200, 300: 200, 400: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(5)

    def edit(s):
        i, c = rng.randrange(len(s) + 1), rng.choice("abé漢")
        return rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]])

    base = ["".join(rng.choice("ab c漢") for _ in range(n)) for n in (22, 23, 24, 64, 65, 66, 128, 129, 130, 200)]
    docs = []
    for i in range(250):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                line = edit(line)
            lines.append(rng.choice(["", " "]) + line + rng.choice(["", "\t"]))
        docs.append((i, "\n".join(lines)))
    docs += [(None, base[3]), (1000, None), (1001, "short\nshort"), (1002, base[3])]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen = []
    for i, text in docs:
        if i is None or text is None:
            assert got[i] == text
            continue
        kept = []
        for line in text.split("\n"):
            bare = line.strip(" \t")
            if bare:
                again = any(bare == s or len(bare) >= 20 and len(s) >= 20 and one_edit(bare, s) for s in seen)
                seen.append(bare)
                if again:
                    continue
            kept.append(line)
        assert got[i] == "\n".join(kept), i


def test_short_lines_go_as_exact_repeats(spark):
    docs = spark.createDataFrame([(1, "Home\n\n} \nBy A. Writer\n\nHome"), (2, "Hole\n}\nBy A. Writer"), (3, "Home")], "doc_id long, text string")
    assert dict(dedup_lines(docs).collect()) == {1: "Home\n\n} \nBy A. Writer\n", 2: "Hole", 3: ""}
    assert dict(dedup_lines(docs, shortest=20).collect()) == dict(docs.collect())


def test_many_repeated_lines_in_one_text(spark):
    """Dropping lines is linear in the text: 100,000 lines, every second one a repeat."""
    text = "\n".join(f"line number {k // 2}" for k in range(100_000))
    left = dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert left == "\n".join(f"line number {k}" for k in range(50_000))


def test_line_dedup_odd_rows(odd, none):
    left = dedup_lines(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert [r.text for r in left.filter("doc_id = 1").collect()] == [None]
    assert {r.n_dropped for r in line_dedup(odd).filter("doc_id = 4").collect()} == {0}
    assert repeated_lines(none).count() == 0 and dedup_lines(none).count() == 0


def test_decontamination(spark, odd, none):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    long = " ".join(f"w{i}" for i in range(3000))
    docs = [(1, f"{long} {item.upper()} {long}"), (2, item.replace("seven", "7")), (3, f"x {item[:40]}"), (4, None), (5, "a b"), (None, item), (1, item)]
    items = [(10, item), (11, None), (12, ""), (13, "A b"), (14, " ".join(f"w{i}" for i in range(500, 2500))), (10, item)]
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.n_item, r.n_common) for r in contained_items(frame, tests).collect())
    assert got == [(0, 10, 9, 9), (1, 10, 9, 9), (1, 14, 1996, 1996), (5, 13, 1, 1)]
    assert sorted(r.doc_id for r in drop_contaminated(frame, tests).collect()) == [2, 3, 4]
    assert contained_items(none, tests).count() == 0 and contained_items(odd, tests.limit(0)).count() == 0
    assert drop_contaminated(odd, tests).count() == odd.count()


def test_least_hits_grow_with_the_signature():
    assert [slots(c) for c in (0, 4, 5, 6, 7, 20)] == [16, 16, 16, 32, 64, 64]
    assert 1 <= least_hits(16) < least_hits(32) < least_hits(64) < 48


@pytest.mark.parametrize("name", ["op2_line_dedup", "op10_benchmark_decontamination"])
def test_against_sql(spark, name):
    got = entry_point.queries()[name](spark, SF_DIR).toPandas()
    assert compare(got, duck(SF_DIR).execute(entry_point.oracle_sql()[name]).df()) is None
