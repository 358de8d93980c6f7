import itertools
import re
from collections import Counter

import duckdb
import pytest

from fieldstone.llm import filter_audit as M

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """rows: (doc_id, text, source)."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({r[0] for r in labels if r[i] == 1} - {None} for i in (1, 2))
    marked = []
    for d, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t]]
        marked.append((s or "", {x for x, y in zip("ABCDE", fails, strict=True) if y}, d in good, d in toxic))
    out, shares = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for step, x in enumerate(order, 1):
            for part, fails, g, tox in marked:
                row = out.setdefault((part, order, step), Counter())
                before = bool(fails & set(order[: step - 1]))
                hit = x in fails and not before
                shares[part, x] += hit
                row.update(kept=not before and not hit, removed=hit, redundant=before and x in fails, unique_fails=fails == {x}, good_lost=hit and g, toxic_lost=hit and tox)
    return {(p, o, s, *(row[c] for c in M.COUNTS[:6]), shares[p, o[s - 1]]) for (p, o, s), row in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step, *(r[c] for c in M.COUNTS)) for r in df.collect()}


ROWS = [
    (5, "one two", "a"), (3, "one two", "b"), (9, "one two", None), (3, "one two", "b"), (None, "one two", "a"), (1, "One $ TWO", ""), (2, "x" * 70, "a"), (4, "x" * 70, "a"), (6, "x" * 69 + "y", "a"),
    (7, None, "b"), (8, "", "b"), (10, " \t\n", "b"), (11, " ".join(f"w{i}" for i in range(300)), "a"), (12, " ".join(["w"] * 300), "a"), (13, "é" * 5000, "c"), (14, "é" * 5000, "c"), (15, "é" * 4999 + "e", "c"),
]
SAID = [(5, 1, 0), (3, 0, 1), (4, 1, 1), (4, 0, None), (9, None, 1), (99, 1, 1), (None, 1, 1), (12, 1, 0)]


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_matches_brute_force_whatever_the_hashes(spark, bits):
    docs, labels = spark.createDataFrame(ROWS, "doc_id long, text string, source string"), spark.createDataFrame(SAID, LABELS)
    assert found(M.audit(docs, labels, bits=bits)) == brute(ROWS, SAID)


def test_refinement_drops_singletons(spark):
    docs = spark.createDataFrame(ROWS, "row_key long, text string, source string").na.fill("").select("row_key", "text")
    kept = M.refined(M.with_classes(docs))
    assert kept.count() == 4  # two words, 70 x, the empty text, 5000 accents


def test_query_matches_its_sql(spark):
    d, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = M.op11_filter_audit(spark, d), db.sql(M.ORACLE["op11_filter_audit"])
    columns = got.columns
    assert sorted(got.collect()) == sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 1)], LABELS)
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    assert found(M.audit(odd_docs, labels)) == brute(rows, [(5, 1, 1)])
    assert M.audit(no_docs, labels).count() == 0
    assert M.audit(odd_docs, labels.where("false")).count() == 600 * 4
