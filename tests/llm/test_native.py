"""Mixing and quality rules: against SQL, and on small hard tables."""

from fractions import Fraction

import duckdb
import pytest

from lexicask.llm import mixing, quality
from lexicask.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def compared(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    compared(spark, sf, name)


def deviations(got, block, share):
    """Greatest distance of any prefix of slots, while all sources have documents, from the exact shares; and that prefix's length."""
    per_slot, left = {}, {}
    for r in got:
        per_slot.setdefault(r.slot, set()).add(r.source)
        left.setdefault(r.source, set()).add(r.slot)
    assert all(len(x) == 1 for x in per_slot.values())
    end = min(max(slots) for slots in left.values()) + 1
    served, worst = dict.fromkeys(left, 0), 0
    for t in range(end):
        (s,) = per_slot[t]
        served[s] += 1
        worst = max(worst, max(abs(served[x] - share[x] * (t + 1)) for x in left))
    return worst, end


def test_mixing_keeps_to_its_weights(spark):
    """Against the requested weights themselves, over many slots."""
    cases = [
        ({"a": 0.5, **{f"s{k}": 0.5 / 9 for k in range(9)}}, 3000),
        ({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, 3000),
        ({"a": 0.9, **{f"s{k}": 0.001 for k in range(100)}}, 4000),
        ({"a": 0.9995, "b": 0.0005}, 5000),
        ({"a": 7.0, "b": 2.5, "c": 0.125}, 2000),
    ]
    for weights, n in cases:
        total = sum(weights.values())
        share = {s: Fraction(w).limit_denominator(10_000) / sum(Fraction(x).limit_denominator(10_000) for x in weights.values()) for s, w in weights.items()}
        names = list(weights)
        rows = [(k, s) for k, s in enumerate(s for s in names for _ in range(1 + int(n * weights[s] / total)))]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block=1, weights=weights).orderBy("position").collect()
        assert [r.position for r in got] == list(range(len(rows))) and sorted(r.doc_id for r in got) == list(range(len(rows)))
        worst, end = deviations(got, 1, share)
        assert worst < 1 and end > 900, weights


def test_mixing_by_default_weights(spark):
    rows = [(k, "a" if k % 3 else f"s{k % 7}") for k in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block=2).orderBy("position").collect()
    assert [r.position for r in got] == list(range(4000)) and sorted(r.doc_id for r in got) == list(range(4000))
    sizes = {s: sum(r.source == s for r in got) for s in {r.source for r in got}}
    roots = {s: round(n**0.5 * 1000) for s, n in sizes.items()}
    whole = {s: (2000 * r + sum(roots.values())) // (2 * sum(roots.values())) for s, r in roots.items()}
    worst, _ = deviations(got, 2, {s: Fraction(w, sum(whole.values())) for s, w in whole.items()})
    assert worst < 1


def test_mixing_many_sources(spark):
    rows = [(k, f"s{k % 1100}") for k in range(2200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block=1).orderBy("position").collect()
    assert [r.position for r in got] == list(range(2200)) and len({r.source for r in got[:1100]}) == 1100


def test_mixing_given_weights_and_hard_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, None), (3, ""), (4, "b")]
    df = spark.createDataFrame([(d, s, "x", 9) for d, s in rows], "doc_id long, source string, slot string, _k int")
    got = mixing.mix(df, block=1, weights={"a": 3.0, "b": 1.0}).collect()
    assert sorted(r.position for r in got) == list(range(6)) and got[0].asDict().keys() >= {"doc_id", "source", "_k", "block", "slot", "position"}
    assert mixing.mix(df.limit(0)).count() == 0
    staged = mixing.stage(df)
    assert staged.columns == df.columns and staged.count() == 6
    with pytest.raises(ValueError, match="millionth"):
        mixing.mix(df, weights={"a": 0.0})


def brute(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


HARD = [None, "", " \n\t ", "a", "a a", "a a a", "a a a a", "a b c a b c", "x y z x y z x", "é# ü* 😀 | <>", "l\nl\nl\n\n \n", "a\x0bb\x0cc a\rb c", "w " * 3000, "a b c d " * 40 + "q", "   x"]


def test_quality_measures(spark):
    df = spark.createDataFrame([(k, t, 1, "z") for k, t in enumerate(HARD)] + [(0, None, 1, "z")], "doc_id long, text string, n_words int, kept string")
    for r in quality.ledger(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(HARD[r.doc_id]), HARD[r.doc_id]
    assert quality.stage(df).columns == df.columns and quality.ledger(df.limit(0)).count() == 0
    assert quality.ledger(df).count() == len(HARD) + 1


def test_policies_and_ablations(spark):
    words = " ".join(f"w{k}x" for k in range(60))
    texts = [words, "few", words + " #" * 30, "# few", words.replace(" ", "! ")]
    book = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    assert {r.doc_id for r in quality.decide(book, "v1").collect() if r.kept} == {0, 2, 4}
    assert {r.doc_id for r in quality.decide(book, "v2").collect() if r.kept} == {0}
    got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept) for r in quality.ablations(book).collect()}
    assert got["few_words"] == (2, 1 if texts[3].count("#") * 10 > 2 else 2, 1) and got["symbols"][1] == 1 and got["shouting"] == (1, 1, 1)
    book.unpersist()
