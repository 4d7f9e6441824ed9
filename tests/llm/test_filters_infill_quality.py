"""Filter audits, fill-in-middle and quality from positives, against plain forms on small fixtures and SQL on the smallest tables."""

import hashlib
import itertools
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import common, filter_trie, infill, positive_unlabelled, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n ", "one", "Ünï cödé 日本語 🤷🏽 <P don't <", "<P>already", "x <S> y", "<M", "<<P<S<M", "aé" * 90, "🤷" * 65, "z" * 64, "z" * 128, "é" * 32 + ">", "a b " * 3000, "one"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("part", "key", "n", "words", "state", "filter", "h1", "form", "output", "score", "size")}) if extra else df


def same(got: pd.DataFrame, want: pd.DataFrame):
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).apply(lambda r: tuple(int(v) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) else v for v in r), axis=1)))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["op11_permutation_trie", "op12_fill_in_middle"])
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    same(queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df())


# filter audit


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    rows = []
    for d, text, _, source, _ in docs:
        text = text or ""
        w = WORD.findall(text)
        copy = d is not None and any((t or "") == text and o is not None and o < d for o, t, *_ in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}
        rows.append((source or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removals = {}
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                alive = [r for r in mine if not r[1] & set(order[: step - 1])]
                gone = [r for r in alive if f in r[1]]
                removals[f] = removals.get(f, 0) + len(gone)
                out.append([part, "".join(order), step, len(alive) - len(gone), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        for r in out:
            if r[0] == part:
                r[-1] = removals[r[-1]] if isinstance(r[-1], str) else r[-1]
    return pd.DataFrame(out, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def audited_rows(copies=0):
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(60):
        text = " ".join(r.choice(words, r.integers(150, 400) if i % 3 else 220, replace=bool(i % 2)))
        text = text.upper() if i % 7 == 0 else text + " # $" if i % 5 == 0 else ("again " * 400) if i % 11 == 0 else text
        rows.append((i, text, "en", [None, "", "s1", "s2"][i % 4], 0))
    rows += [(100 + i, rows[i][1], "en", "s1", 0) for i in range(0, 60, 6)]
    rows += [(200 + i, t, None, "s2", None) for i, t in enumerate(ODD)]
    return rows + [(None, None, None, None, None), (None, rows[3][1], None, "s1", 0), (3, rows[3][1], "en", "s2", 0)] + [(1000 + i, "one text of many copies", "en", "hot", 0) for i in range(copies)]


LABELS = [(i, i % 2, i % 3 == 0) for i in range(0, 300, 2)] + [(2, 1, 1), (4, None, None), (None, 1, 1), (4, 0, 1), (101, 1, 0)]


@pytest.mark.parametrize("extra", [False, True])
def test_audit_equals_plain(spark, extra):
    rows = audited_rows()
    labels = spark.createDataFrame([(d, q, None if t is None else int(t)) for d, q, t in LABELS], "doc_id long, quality int, toxic int")
    same(filter_trie.audit(frame(spark, rows, extra), labels).toPandas(), plain_audit(rows, LABELS))


def test_audit_deals_out_many_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "PART", 16)
    rows = audited_rows(150)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same(filter_trie.audit(frame(spark, rows), labels).toPandas(), plain_audit(rows, []))


def test_audit_walks_each_state_once(spark):
    rows = spark.createDataFrame([("p", i % 2, i % 3, True) for i in range(12)] + [("q", None, 1, False)], "part string, a int, b int, good boolean")
    got = filter_trie.edges(rows, {"X": "a = 1", "Y": "b = 0", "Z": "a = 5"}, "part", ["good"]).toPandas()
    assert len(got) == len(got.drop_duplicates(["part", "state", "filter"])) == 2 * 12
    x = got.set_index(["part", "state", "filter"])
    assert x.loc["p", 0, 0].tolist() == [12, 6, 6] and x.loc["p", 1, 1].tolist() == [6, 2, 2] and x.loc["q", 0, 0].tolist() == [1, 0, 0]
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_audit_of_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_trie.audit(frame(spark, []), labels).count() == 0


# fill in the middle


def plain_infill(d, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not n or any(s in text for s in infill.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return n, *(("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"))


@pytest.mark.parametrize("extra", [False, True])
def test_infill_equals_plain(spark, extra):
    r = np.random.default_rng(1)
    parts = ["<", "P", "<P", "<S", "M>", ">", "é", "日", "🤷🏽", "a ", "\n", "<M", "S>"]
    texts = ODD * 4 + ["".join(r.choice(parts, r.integers(1, 90))) for _ in range(300)] + ["long é " * 50_000]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (5, "said twice", None, None, None), (5, "said twice", None, None, None)]
    cut = infill.fill_in_middle(frame(spark, rows, extra))
    got = [tuple(x) for x in infill.restore(cut).collect()]
    want = [(d, *plain_infill(d, t), t or "") for d, t, *_ in rows]
    order = lambda x: sorted(x, key=repr)
    assert order(got) == order(want)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_infill_of_an_empty_table(spark):
    assert infill.restore(infill.fill_in_middle(frame(spark, []))).count() == 0


def test_infill_needs_its_sentinels(spark):
    bad = spark.createDataFrame([(1, 3, "psm", 1, 1, "<P>a<S>b")], "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
    with pytest.raises(Exception, match="sentinels"):
        infill.restore(bad).collect()


def test_automaton_counts_units_and_sentinels():
    auto = infill.automaton(("<P>", "é<", "<P>é"))
    for text in ["", "<P>", "aé<P>é<", "日本<P" + "x" * 70 + "<<P>", "é" * 100 + "é<" * 50]:
        data, offsets = common.byte_chunks([text.encode(), b"tail <P>"])
        scan = infill.Scan(auto, data, offsets)
        assert scan.units.tolist() == [len(text), 8]
        found = [text[m.start() : m.end()] for m in re.finditer("<P>é|<P>|é<", text)]
        if "<P>é" not in found:
            assert scan.hits[0] == len(found)
        for k in range(len(text) + 1):
            assert scan.locate(np.array([0]), np.array([k]))[0] == len(text[:k].encode())


# quality


def test_risk_is_never_fitted_below_zero():
    g, positive = np.array([2.0, 1.0, -3.0, -2.5]), np.array([True, True, False, False])
    up, down, follow = positive_unlabelled.risk(g, positive, 0.9)
    s = 1 / (1 + np.exp(-g))
    assert up == pytest.approx(0.9 * np.mean(1 - s[:2])) and down == pytest.approx(np.mean(s[2:]) - 0.9 * np.mean(s[:2]))
    assert down < 0 and follow[2] < 0 < follow[0]
    total = lambda x: sum(positive_unlabelled.risk(x, positive, 0.05)[:2])
    slope = positive_unlabelled.risk(g, positive, 0.05)[2]
    for i in range(4):
        e = np.eye(4)[i] * 1e-5
        assert slope[i] == pytest.approx((total(g + e) - total(g - e)) / 2e-5, rel=1e-4)


def test_network_gradients():
    r = np.random.default_rng(0)
    net = positive_unlabelled.Network(np.zeros(5), np.ones(5), r)
    z, slope = r.normal(size=(6, 5)), r.normal(size=6)
    g = net.gradients(z, net.forward(z)[1], slope)
    for k in net.p:
        at = tuple(0 for _ in net.p[k].shape)
        kept = net.p[k].copy()
        net.p[k][at] += 1e-6
        high = net.forward(z)[0] @ slope
        net.p[k] = kept.copy()
        net.p[k][at] -= 1e-6
        low = net.forward(z)[0] @ slope
        net.p[k] = kept
        assert g[k][at] == pytest.approx((high - low) / 2e-6, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("share", [0.5, 0.85])
def test_prior_and_network_from_positives(share):
    r = np.random.default_rng(2)
    make = lambda n, y: r.normal(size=(n, positive_unlabelled.FEATURES)) + (np.arange(positive_unlabelled.FEATURES) < 4) * (2.5 * y)
    truth = r.random(4000) < share
    unl = np.where(truth[:, None], make(4000, 1), make(4000, -1))
    net = positive_unlabelled.train(make(2000, 1), unl)
    assert abs(net.prior - share) < 0.08
    test = r.random(2000) < 0.5
    x = np.where(test[:, None], make(2000, 1), make(2000, -1))
    assert np.mean((net.forward(net.scaled(x))[0] >= 0) == test) > 0.97


def test_features_equal_plain():
    texts = [t or "" for t in ODD] + ["a a a b\nc c\na a a b\nc c", "one two three four five six one two three four five"]
    x, words = positive_unlabelled.features(*common.byte_chunks([t.encode() for t in texts]))
    kinds = positive_unlabelled._KIND
    for i, t in enumerate(texts):
        w, raw = WORD.findall(t), t.encode()
        assert words[i] == len(w)
        n = max(len(w), 1)
        pairs = np.zeros(64)
        for a, b in zip(raw, raw[1:]):
            pairs[kinds[a] * 8 + kinds[b]] += 1
        assert np.allclose(x[i][:64], pairs / max(len(raw) - 1, 1))
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        marked = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(grams) < 1000 else set(range(len(w)))
        lines = t.split("\n")
        dup = sum(len(WORD.findall(s)) for j, s in enumerate(lines) if s in lines[:j])
        want = [np.log1p(len(w)), sum(len(v.encode()) for v in w) / n, len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:])) / n, len(marked) / n, dup / n]
        assert np.allclose(x[i][64:70], want)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = queries.QUERIES["op13_positive_unlabelled_quality"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    x = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    low, high = x[x.quality == 0], x[x.quality == 1]
    assert (high.predicted == 1).mean() > 0.97 and (low.predicted == 0).mean() > 0.9
    assert np.mean(high.score.to_numpy()[:, None] > low.score.to_numpy()[None]) > 0.98


def test_quality_never_reads_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = positive_unlabelled.fit(docs, labels, 150, 300), positive_unlabelled.fit(docs, turned, 150, 300)
    assert all((a.p[k] == b.p[k]).all() for k in a.p) and a.prior == b.prior


@pytest.mark.parametrize("extra", [False, True])
def test_quality_of_odd_tables(spark, extra):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None)] + [(7, "repeated", None, None, None)] * 3
    docs = frame(spark, rows, extra)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nothing = positive_unlabelled.fit(docs, none)
    assert nothing.only == 0 and set(positive_unlabelled.score(docs, nothing).toPandas().predicted) == {0}
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, 0), (3, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    net = positive_unlabelled.fit(docs, labels)
    got = positive_unlabelled.score(docs, net).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert (got[got.doc_id.isin([0, 1, 2])].score == 0).all() and got[got.doc_id == 7].score.nunique() == 2
    assert positive_unlabelled.score(docs.limit(0), net).count() == 0
    assert positive_unlabelled.fit(docs.limit(0), labels).only == 0
