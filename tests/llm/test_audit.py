"""The filter audit against every order run over every document."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from tessella.llm import audit, tables
from tessella.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def settings_of_text(spark):
    tables.prepared(spark)


def plain(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in range(2))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)),
            i is not None and i > least[t])) if bad}
        parts[lang or ""].append((fails, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        share = defaultdict(int)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[0]]
                gone = [r for r in rows if f in r[0] and set(order[: step - 1]) & r[0]]
                left = [r for r in left if f not in r[0]]
                share[f] += len(here)
                out.append([part, "".join(order), step, len(left), len(here), len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)])
        for row in out:
            if row[0] == part:
                row.append(share[row[1][row[2] - 1]])
    return sorted(map(tuple, out))


def test_steps_are_the_first_filters_failed():
    orders = np.array(list(permutations(range(4))))
    steps = audit.removal_steps(orders, 4)
    for s in range(16):
        for o, order in enumerate(orders):
            want = next((k for k, f in enumerate(order, 1) if s >> f & 1), 5)
            assert steps[s, o] == want


def test_awkward_rows_and_columns(spark):
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "", long, long, long, long + " #", "A " * 300, "a " * 300, "SHORT TEXT", "é" * 3, long.upper(), "no id", "no id", "\x0b\x1c \t"]
    ids = [0, 1, 2, 9, 4, 4, 5, 6, 7, 8, 10, 11, None, None, 12]
    langs = ["en", "de", None, "en", "en", "de", "en", "", None, "en", "en", "en", "fr", "fr", "de"]
    docs = list(zip(ids, texts, langs))
    labels = [(9, 1, 0), (4, 1, 1), (4, 0, 1), (0, None, 1), (7, 0, None), (11, 1, 0), (None, 1, 1), (99, 1, 1), (5, 2, 1)]
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, lang string, part string, `meta.url` int, n int")
    la = spark.createDataFrame([(*x, 7, 8) for x in labels], "doc_id long, quality int, toxic int, good int, `meta.url` int")
    assert sorted(map(tuple, audit.audit_filters(df, la).collect())) == plain(docs, labels)
    assert sorted(map(tuple, audit.audit_filters(df.repartition(7), la.limit(0)).collect())) == plain(docs, [])
    assert audit.audit_filters(df.limit(0), la).count() == 0


def test_query(spark):
    ok, note = compare(QUERIES["op12_filter_audit"], ORACLE["op12_filter_audit"], spark, connect(SF), SF)
    assert ok, note
    docs = [(r.doc_id, r.text, r.lang) for r in tables.table(spark, SF, "documents").collect()]
    labels = [tuple(r) for r in tables.table(spark, SF, "labels").select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, QUERIES["op12_filter_audit"](spark, SF).collect())) == plain(docs, labels)
