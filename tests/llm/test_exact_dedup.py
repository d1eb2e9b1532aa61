"""Who decides equality in the content sort, and what a heavy content does."""

import pytest
from pyspark.sql import functions as F

from framewright.llm import exact_dedup as x

SCHEMA = "doc_id long, text string, salt string, rn int"


@pytest.fixture(scope="module")
def mixed(spark):
    """A third of 3,000 rows is one content in several writings, some of them without an identifier; the rest are different, but for pairs."""
    same = [(i if i % 7 else None, ("one", " o ne", "\tone\n")[i % 3], None, None) for i in range(1000)]
    other = [(10_000 + i, f"text number {i // 2 if i < 400 else i}", "s", 1) for i in range(2000)]
    return spark.createDataFrame(same + other, SCHEMA).repartition(5)


def groups(df):
    out = {}
    for r in df.collect():
        g = out.setdefault(r.text_sha256, [set(), set(), 0, 0])
        g[0].add(r.keep_id)
        g[1].add(r.group_size)
        g[2] += 1
        g[3] += r.kept
    return out


def test_copies_of_a_normal_table_meet_by_comparison(spark):
    """No content is heavy, so no digest takes part: the 704 merges come from the comparison of neighbours."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert x.heavy_contents(docs) == []
    assert x.exact_dedup(docs).filter("not kept").count() == 704


def test_heavy_content_spreads_and_comes_together(mixed):
    heavy = x.heavy_contents(mixed)
    assert len(heavy) == 1
    names = x._names(mixed)
    runs = x.content_sort(mixed, "doc_id", "text", heavy, names).filter(F.col(names["norm"]) == "one")
    assert runs.select(names["salt"]).distinct().count() > 1
    got = groups(x.exact_dedup(mixed))
    assert len(got) == 1801
    assert sorted(n for _, _, n, _ in got.values())[-2:] == [2, 1000]
    for keep, size, n, kept in got.values():
        assert len(keep) == 1 and size == {n} and kept == 1
    out = x.drop_exact_copies(mixed)
    assert out.columns == mixed.columns and out.count() == 1801
    # The longest writing stays, of equally long ones the smallest identifier.
    best = [r for r in out.collect() if r.text.strip(" \t\n").replace(" ", "") == "one"]
    assert [(r.doc_id, r.text) for r in best] == [(1, " o ne")]


@pytest.mark.parametrize("forced", [False, True])
def test_contents_that_share_their_hash_stay_apart(spark, monkeypatch, forced):
    """With one hash for all contents and one beginning, only the whole comparison is left to tell them apart."""
    monkeypatch.setattr(x, "content_hash", lambda norm: F.lit(7).cast("long") + F.length(norm) * 0)
    monkeypatch.setattr(x, "heavy_contents", lambda docs, text_col="text": [7] if forced else [])
    rows = [(i, "the same beginning of them all " + str(i % 40), None, None) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = groups(x.exact_dedup(docs))
    assert len(got) == 40 and all(n == 10 and kept == 1 and size == {10} and len(keep) == 1 for keep, size, n, kept in got.values())
    assert x.drop_exact_copies(docs).count() == 40
