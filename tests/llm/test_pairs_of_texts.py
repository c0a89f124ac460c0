"""Near duplicates and repeats of history against brute force on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from quillgrid.llm.cores import core_string, likeness
from quillgrid.llm.history import check_batch, repeats, write_history
from quillgrid.llm.neardup import near_duplicate_pairs

SCHEMA = "row_id long, id string, text string, core string, a string, ord string"


def edited(rng, text):
    out = list(text)
    for _ in range(rng.randint(0, len(text) // 25)):
        out[rng.randrange(len(out))] = rng.choice("abcdefgh中文字")
    return "".join(out)


def collection(seed, count):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz中文字符组装") for _ in range(rng.randint(40, 200))) for _ in range(count // 4)]
    texts = [edited(rng, rng.choice(bases)) for _ in range(count)]
    texts += [None, "", " ", "ab", "abcd", "abcd", "ABCD!", texts[0], texts[0], texts[1] * 400]
    rng.shuffle(texts)
    return [(k, f"id{k}", t, "x", "y", "z") for k, t in enumerate(texts)]


def brute(rows, n):
    return {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if likeness(a[2], b[2], n) >= 0.7}


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_are_those_of_brute_force(spark, seed):
    rows = collection(seed, 160)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in near_duplicate_pairs(df, "row_id", F.col("text")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 4)


def test_an_empty_table_has_no_pairs(spark):
    out = near_duplicate_pairs(spark.createDataFrame([], SCHEMA), "row_id", F.col("text"))
    assert out.columns == ["row_id_a", "row_id_b"] and out.count() == 0


def test_a_third_of_equal_rows_gives_all_their_pairs(spark):
    rows = [(k, "i", "the same long text of all these rows", "", "", "") for k in range(60)] + collection(3, 60)[:0]
    got = near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), "row_id", F.col("text")).count()
    assert got == 60 * 59 // 2


def not_new(history, batch):
    plain = lambda s: (s or "").strip().lower()
    out = set()
    for k, row in enumerate(sorted(batch)):
        before = history + sorted(batch)[:k]
        if any((plain(row[1]) and plain(row[1]) == plain(b[1])) or likeness(row[2], b[2], 3) >= 0.7 for b in before if b in history or b[0] < row[0]):
            out.add(row[0])
    return out


def history_case(seed):
    rng = random.Random(seed)
    old = [(k, f"Q-{k}", t, "", "", "") for k, (_, _, t, *_) in enumerate(collection(seed, 80))]
    new = []
    for k in range(40):
        kind = rng.randrange(4)
        text = edited(rng, rng.choice([r[2] for r in old if r[2] and len(r[2]) > 30])) if kind == 0 else "".join(rng.choice("pqrstuvwxyz序列") for _ in range(60))
        new.append((1000 + k, f" q-{rng.randrange(80)} " if kind == 1 else f"new-{rng.randrange(60)}", text, "", "", ""))
    new += [(2000, None, None, "", "", ""), (2001, " ", "", "", "", ""), (2002, None, "xy", "", "", ""), (2003, None, "xy", "", "", ""), (2004, None, new[5][2], "", "", "")]
    return old, new


@pytest.mark.parametrize("seed", [5, 6])
def test_repeats_are_those_of_brute_force(spark, seed):
    old, new = history_case(seed)
    got = [r[0] for r in repeats(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA), key="row_id", id_column="id", text="text").collect()]
    assert len(got) == len(set(got)) and set(got) == not_new(old, new)


def test_repeats_without_history_or_batch(spark):
    old, new = history_case(7)
    none = spark.createDataFrame([], SCHEMA)
    names = {"key": "row_id", "id_column": "id", "text": "text"}
    assert {r[0] for r in repeats(none, spark.createDataFrame(new, SCHEMA), **names).collect()} == not_new([], new)
    assert repeats(spark.createDataFrame(old, SCHEMA), none, **names).count() == 0


def test_a_store_gives_the_same_batch_by_batch(spark, tmp_path):
    old, new = history_case(8)
    new = sorted(new)
    names = {"key": "row_id", "id_column": "id", "text": "text"}
    write_history(spark.createDataFrame(old, SCHEMA), str(tmp_path), **names)
    got = set()
    for part in (new[:20], new[20:]):
        got |= {r[0] for r in check_batch(spark, str(tmp_path), spark.createDataFrame(part, SCHEMA), **names).collect()}
    assert got == not_new(old, new)
    assert core_string("A-b") == "ab"
