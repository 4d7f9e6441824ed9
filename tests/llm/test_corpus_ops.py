"""Corpus operators against brute force on small fixtures: nulls, empty and long texts, repeats, ties, clashing columns."""

import base64
import collections
import hashlib
import re
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import bpe, common, fingerprints, langid, mixing, neardup, packed_ids, repetition, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "Ünï cödé   日本語 🤷🏽 don't", "a b c d e f g h i j k", "x " * 3000, "line one here\nline one here\nother\n\nline one here", "tab\tvt\x0bff\x0c\x1c\x85 z", "THE the The THE the The"]


def documents(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"size": F.lit("clash"), "target": F.lit(1), "sig": F.lit(b"x"), "score": F.lit(0), "key": F.lit("k"), "pid": F.lit(2)}) if extra else df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def many(n, seed=0):
    r = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(400)])
    return [" ".join(words[r.integers(0, 400, r.integers(12, 120))]) for _ in range(n)]


# mixing


def test_mix_targets_and_words(spark):
    texts = many(300)
    got = mixing.mix_sources(documents(spark, texts, extra=True)).toPandas()
    assert len(got) == 300 and (got["size"] == [len(WORD.findall(texts[i])) for i in got.doc_id]).all()
    src = ["~null" if i % 4 == 0 else f"s{i % 3}" for i in got.doc_id]
    got["src"] = src
    sizes = got.groupby("src")["size"].sum().sort_index()
    weights = dict(zip(sizes.index, [1, 2, 3, 1]))
    # excess over three times a source's size is shared again until none is above
    left, fixed = float(sizes.sum()), {}
    while True:
        rest = {s: left * weights[s] / sum(w for k, w in weights.items() if k not in fixed) for s in weights if s not in fixed}
        over = [s for s, t in rest.items() if t > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 3.0 * sizes[s]
        left = float(sizes.sum()) - sum(fixed.values())
    want = rest | fixed
    for s, g in got.groupby("src"):
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - want[s]) <= g["size"].max() / 2 + 1
        assert (g.taken <= 3 * g["size"]).all() and (g.taken % g["size"] == 0).all()
    again = mixing.mix_sources(documents(spark, texts)).toPandas().set_index("doc_id")
    assert (again.taken == got.set_index("doc_id").taken).all()


def test_mix_sampling_is_unbiased(spark):
    texts = many(200, 3)
    counts = np.zeros(200)
    for k in range(6):
        got = mixing.mix_sources(documents(spark, texts), seed=f"seed{k}:").toPandas().set_index("doc_id").sort_index()
        counts += got.taken / got["size"]
    assert 0.5 < counts.mean() / 6 < 1.6


def test_mix_inclusion_follows_size(spark):
    """Long documents are included more often than short ones, and each half's share of words comes near its expectation."""
    texts = [" ".join(["w"] * n) for n in [20] * 60 + [200] * 60]
    docs = spark.createDataFrame([(i, t, "a" if i % 2 else "b") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    seen = np.zeros(120)
    for k in range(8):
        got = mixing.mix_sources(docs, seed=f"s{k}:").toPandas().set_index("doc_id").sort_index()
        assert all(abs(g.taken.sum() - g.target.iloc[0]) <= 101 for _, g in got.groupby("target"))
        seen += got.copies
    for source, want in ((1, 2 / 3), (0, 4 / 3)):
        short, long_ = seen[source:60:2].mean() / 8, seen[60 + source :: 2].mean() / 8
        assert abs((20 * short + 200 * long_) / 220 - want) < 0.05 and abs(short - want) < 0.3 and long_ >= short - 0.12


def test_mix_edges(spark):
    assert mixing.mix_sources(empty(spark)).count() == 0
    got = mixing.mix_sources(documents(spark, ODD + ODD)).toPandas()
    assert len(got) == 2 * len(ODD) and got.taken.notna().all()
    only_empty = mixing.mix_sources(documents(spark, [None, ""])).toPandas()
    assert (only_empty.taken == 0).all() and (only_empty.target == 0).all()
    docs = documents(spark, many(40))
    mixed = mixing.mixed_documents(docs.unionByName(docs.filter("doc_id = 3")))
    assert mixed.columns == docs.columns and mixed.count() > 10


# fingerprints


def scalar_landmarks(sym):
    """The coin tossing of one sequence, a symbol at a time."""

    def toss(c):
        out = []
        for i, x in enumerate(c):
            bit = 0 if i == 0 else ((x ^ c[i - 1]) & -(x ^ c[i - 1])).bit_length() - 1
            out.append(2 * bit + ((x >> bit) & 1))
        return out

    c = list(sym)
    for _ in range(4):
        c = toss(c)
    for v in (5, 4, 3):
        old = list(c)
        for i, x in enumerate(old):
            if x == v:
                near = {old[j] for j in (i - 1, i + 1) if 0 <= j < len(c)}
                c[i] = min({0, 1, 2} - near)
    n = len(c)
    get = lambda i: c[i] if 0 <= i < n else -1
    top = [i > 0 and c[i] > get(i - 1) and c[i] > get(i + 1) for i in range(n)]
    low = [0 < i < n - 1 and c[i] < c[i - 1] and c[i] < c[i + 1] and not any(top[max(0, i - 1) : i + 2]) for i in range(n)]
    return [i == 0 or (i != 1 and (top[i] or low[i])) for i in range(n)]


def test_landmarks_match_scalar_form():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 200):
        s = r.integers(1, 50, n).astype(np.uint64)
        s = s[np.append(True, s[1:] != s[:-1])]
        first = np.zeros(len(s), bool)
        first[0] = True
        assert fingerprints.landmarks(s, first).tolist() == scalar_landmarks([int(x) for x in s])


def test_equal_substrings_share_names():
    body = " ".join(many(1, 9)).encode() * 3
    a = [set(n.tolist()) for n, _ in fingerprints.parse(*common.byte_chunks([body]))]
    b = [set(n.tolist()) for n, _ in fingerprints.parse(*common.byte_chunks([b"another start, " + body + b" and end"]))]
    for level in range(4):
        assert len(a[level] - b[level]) <= 8


def plain_mix(x):
    m = (1 << 64) - 1
    x &= m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def plain_levels(data):
    """Phrase names of a text, level by level, one symbol at a time."""
    sym, m, base, out = [b + 1 for b in data], (1 << 64) - 1, 0xD6E8FEB86659FD93, []
    for level in range(1, fingerprints.LEVELS + 1):
        runs = []
        for x in sym:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        sym = [plain_mix(x * 3 + (n << 32)) if n > 1 else x for x, n in runs]
        marks = scalar_landmarks(sym) if sym else []
        phrases = []
        for x, begins in zip(sym, marks):
            if begins:
                phrases.append([])
            phrases[-1].append(x)
        sym = [plain_mix(sum(x * pow(base, i + 1, m + 1) for i, x in enumerate(ph)) + len(ph) * (level * 2 + 1)) for ph in phrases]
        out.append(sym)
    return out


def plain_fingerprint(data):
    levels = plain_levels(data)
    top = max([k + 1 for k, s in enumerate(levels) if len(s) >= fingerprints.ENOUGH] + [1 if data else 0])
    shown = {k: sorted({x >> 32 for x in levels[k - 1]})[: fingerprints.NAMES] for k in {top, top - 1, 1} if k > 0 and levels[k - 1]}
    return {k: [f"{x:08x}" for x in v] for k, v in shown.items()}


def plain_likeness(a, b):
    if a == b:
        return 1.0
    common_ = set(a) & set(b)
    if min(max(a, default=1), max(b, default=1)) > 2:
        common_ -= {1}
    if not common_:
        return 0.0
    p, q = set(a[max(common_)]), set(b[max(common_)])
    least = sorted(p | q)[: fingerprints.NAMES]
    return sum(x in p and x in q for x in least) / len(least)


def test_names_level_and_likeness_equal_a_plain_form():
    texts = [b"", b"a", b"ab" * 40, *[t.encode() for t in many(6, 4)], ("é日 " * 300).encode(), b" ".join(t.encode() for t in many(8, 4))]
    got, want = fingerprints.fingerprints(texts), [plain_fingerprint(t) for t in texts]
    for g, w in zip(got, want):
        assert g == "/".join(f"{k}:{''.join(w[k])}" for k in sorted(w, reverse=True))
    for i, x in enumerate(texts):
        for j in range(len(texts)):
            assert fingerprints.likeness(got[i], got[j]) == plain_likeness(want[i], want[j])


def test_fingerprint_documents(spark):
    texts = ODD + many(60) + ODD
    got = fingerprints.fingerprint_documents(documents(spark, texts, extra=True)).toPandas().set_index("doc_id").sort_index()
    assert list(got.index) == list(range(len(texts)))
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        row = got.loc[i]
        assert row.n_chars == len(t) and row.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        fp = fingerprints.fingerprints([t.encode(), e.encode(), nxt.encode()])
        assert [row.fingerprint, row.edited_fingerprint] == fp[:2]
        assert row.near_next == fingerprints.likeness(fp[0], fp[2]) and 0 <= row.near_edited <= 1
    assert got.near_edited[len(ODD) : len(ODD) + 59].mean() > 0.4 > 0.05 > got.near_next[len(ODD) : len(ODD) + 59].mean()
    assert fingerprints.fingerprint_documents(empty(spark)).count() == 0
    one = fingerprints.fingerprint_documents(documents(spark, ["abcdefgh"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    odd_ids = spark.createDataFrame([(None, "b b"), (5, "c c"), (5, "c c"), (None, None)], "doc_id long, text string")
    assert fingerprints.fingerprint_documents(odd_ids).count() == 4


# WARC


def pages(spark, htmls):
    return spark.createDataFrame([(i, f"http://h/{i}" if i % 5 else None, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    htmls = [None, "", "<p>é\r\n\r\nx</p>", "same", "same", "", "long " * 50_000, "same"] + [f"<html><body>page {i} {'word ' * (i % 50)}</body></html>" for i in range(300)]
    df = pages(spark, htmls).withColumns({"payload": F.lit(1), "digest": F.lit("d"), "size": F.lit(2)})
    path = str(tmp_path / "a")
    warc.write_warc(df.repartition(3), path)
    got = warc.read_warc(spark, path, payloads=True).toPandas().set_index("page_id").sort_index()
    assert len(got) == len(htmls)
    first = {}
    for i, h in enumerate(htmls):
        p = (h or "").encode()
        lead = first.setdefault(p, i)
        row = got.loc[i]
        assert row.payload_bytes == len(p) and row.payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert row.record_type == ("response" if lead == i else "revisit")
        assert row.refers_to == lead if lead != i else row.payload == p and np.isnan(row.refers_to)
    least = warc.archive_pages(pages(spark, ["a", "a", "bcd", "bcd"]), least=2).orderBy("page_id").toPandas()
    assert list(least.record_type) == ["response", "response", "response", "revisit"]
    assert warc.archive_pages(pages(spark, ["x"]).limit(0)).count() == 0


def test_warc_rolls_files(spark, tmp_path, monkeypatch):
    """Every file begins with the dictionary; reruns give the same bytes."""
    import glob

    monkeypatch.setattr(warc, "RUN_BYTES", 400)
    monkeypatch.setattr(warc, "RUNS_PER_FILE", 2)
    df = pages(spark, [f"<p>page {i} {'word ' * (i % 40)}</p>" for i in range(120)] + ["same"] * 3).coalesce(1)
    first, again = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write_warc(df, first)
    warc.write_warc(df, again)
    files = sorted(glob.glob(first + "/part-*"))
    assert len(files) > 5 and all(open(f, "rb").read(4) == struct.pack("<I", 0x184D2A5D) for f in files)
    assert sorted(open(f, "rb").read() for f in files) == sorted(open(f, "rb").read() for f in glob.glob(again + "/part-*"))
    got = warc.read_warc(spark, first).toPandas()
    assert sorted(got.page_id) == list(range(123)) and (got.record_type == "revisit").sum() == 2


def test_warc_files_are_plain_zstandard(spark, tmp_path):
    """A stock decoder with the dictionary of the leading frame reads record after record."""
    import glob

    import zstandard

    path = str(tmp_path / "b")
    warc.write_warc(pages(spark, [f"page number {i}" for i in range(40)]).coalesce(1), path)
    data = open(glob.glob(path + "/part-*")[0], "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).stream_reader(data[8 + size :], read_across_frames=True)
    assert reader.read().count(b"WARC/1.1\r\n") == 40


# repetition


def brute_counts(x):
    w = WORD.findall(x)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in x), dup, len(marked)]


def brute_shares(x):
    w = WORD.findall(x)
    chars = max(1, sum(map(len, w)))
    out = {}
    for n in (5, 7, 10):
        c = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        marked = {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out[f"dup_{n}_share"] = sum(len(w[j]) for j in marked) / chars
    seen, dup = set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += sum(map(len, WORD.findall(line))) if line in seen else 0
            seen.add(line)
    return out | {"dup_line_share": dup / chars}


def test_repetition(spark):
    texts = ODD + many(40) + ["p q r s t " * 9, "#*$ | <> &%", "a\r\nb\na\r\nb", " \n \n a"] + ODD
    got = repetition.repetition(documents(spark, texts, extra=True)).toPandas().set_index("doc_id").sort_index()
    for i, t in enumerate(texts):
        want = brute_counts(t or "")
        assert got.loc[i, repetition.COUNTS].tolist() == want, t
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        shares = brute_shares(t or "")
        assert got.loc[i, list(shares)].tolist() == pytest.approx(list(shares.values()))
        most = {"dup_5_share": 0.15, "dup_7_share": 0.13, "dup_10_share": 0.10, "dup_line_share": 0.20}
        assert got.base_failed[i] == failed and got.kept[i] == (not failed and all(shares[k] <= v for k, v in most.items()))
    assert got.kept[len(ODD) : len(ODD) + 40].all()
    assert repetition.repetition(empty(spark)).count() == 0


def test_repetition_long_range_lines():
    lines = [f"alpha {i} beta {i} gamma" for i in range(40)]
    data, offsets = common.byte_chunks(["\n".join(lines + lines).encode()])
    m = repetition.measures(data, offsets)
    assert m["dup_line_share"][0] == pytest.approx(0.5) and m["dup_5_share"][0] > 0.9


def test_repetition_limits_bind_below_the_base(spark):
    word = iter(f"w{i:03d}" for i in range(900))
    some = lambda n: [next(word) for _ in range(n)]
    phrase, passage, short, line = some(9), some(10), some(6), "\n" + " ".join(c * 40 for c in "abcd") + "\n"
    texts = [
        " ".join(some(30) + phrase + some(30) + phrase + some(22)),
        " ".join(some(60) + passage + some(60) + passage + some(43)),
        " ".join(some(40)) + line + " ".join(some(26)) + line + " ".join(some(26)),
        " ".join(some(30) + short + some(30) + short + some(28)),
    ]
    got = repetition.repetition(documents(spark, texts)).toPandas().set_index("doc_id").sort_index()
    assert not got.base_failed.any()
    assert got.kept.tolist() == [False, False, False, True]
    assert got.dup_5_share[0] == pytest.approx(0.18) and 0.10 < got.dup_10_share[1] < 0.13 and 0.20 < got.dup_line_share[2] < 0.30


# toxicity


def test_toxicity_learns_and_scores_edges(spark):
    r = np.random.default_rng(5)
    texts = many(160, 11)
    labels = [i % 2 for i in range(160)]
    for i in range(160):
        if labels[i]:
            w = texts[i].split()
            for _ in range(3):
                w.insert(int(r.integers(0, len(w))), f"vile{r.choice(['', 'ly', 'ness'])}")
            texts[i] = " ".join(w)
    docs = documents(spark, texts + ODD, extra=True)
    marks = spark.createDataFrame([(i, int(l)) for i, l in enumerate(labels)] + [(0, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.fit(docs, marks)
    got = toxicity.score(docs, net).toPandas().set_index("doc_id").sort_index()
    assert len(got) == 170 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got.predicted[i] == labels[i] for i in held]) >= 0.9
    assert (got.score[160:163] == 0).all() and (got.windows[160:163] == 0).all()
    assert got.windows[166] == 1 + -(-(3000 - toxicity.WINDOW) // toxicity.STRIDE)
    assert toxicity.score(empty(spark), net).count() == 0
    untrained = toxicity.fit(empty(spark), marks)
    assert set(toxicity.score(docs, untrained).toPandas().score) == {0.0}
    clash = docs.withColumns({c: F.lit(c) for c in ("predicted", "windows", "kept", "kept_score", "odd name")})
    left = toxicity.without_toxic(clash, net)
    assert left.columns == clash.columns and left.count() == (got.predicted == 0).sum()
    assert {r.predicted for r in left.collect()} == {"predicted"}


def test_toxicity_of_one_class_and_bounds(spark):
    docs = documents(spark, many(40) + [None, ""])
    for label in (0, 1):
        net = toxicity.fit(docs, spark.createDataFrame([(i, label) for i in range(42)], "doc_id long, toxic int"))
        assert set(toxicity.score(docs, net).toPandas().score) == {float(label)}
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert set(toxicity.score(docs, nothing).toPandas().score) == {0.0}
    # Repeated ids and long texts: one text of an id, and no more bytes than asked for.
    both = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0)], "doc_id long, toxic int")
    again = docs.unionByName(docs.filter("doc_id < 6")).unionByName(documents(spark, ["y " * 50_000, "z " * 50_000]))
    net = toxicity.fit(again, both, 30, 20_000)
    assert net.only is None and toxicity.score(again, net).count() == 50
    assert toxicity.fit(documents(spark, ["y " * 50_000] * 40), both, 30, 20_000).only == 0.0


def test_toxicity_scores_equal_a_plain_network(spark):
    """Every window word by word, in double precision."""
    net = toxicity.Network(5)
    net.cal = (1.0, 0.3)
    texts = ["one two Three " * 9 + "end", "four", "Ünï cödé 日本", None]
    got = toxicity.score(documents(spark, texts), net).orderBy("doc_id").toPandas()
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def gru(xs, u):
        h, out = np.zeros(toxicity.HIDDEN), []
        for x in xs:
            g, n = h @ u, toxicity.HIDDEN
            r, z = sig(x[:n] + g[:n]), sig(x[n : 2 * n] + g[n : 2 * n])
            h = (1 - z) * np.tanh(x[2 * n :] + r * g[2 * n :]) + z * h
            out.append(h)
        return out

    for row, text in zip(got.itertuples(), texts):
        words = WORD.findall(text or "")
        begins = sorted({*range(0, max(1, len(words) - toxicity.WINDOW + 1), toxicity.STRIDE), max(0, len(words) - toxicity.WINDOW)}) if words else []
        assert row.windows == len(begins)
        logits = []
        for at in begins:
            xs = []
            for word in words[at : at + toxicity.WINDOW]:
                data, offsets = common.byte_chunks([word.encode()])
                w = common.Words(data, offsets, lower=True)
                v, _ = toxicity.vocabulary(w)
                chars = p["C"][v.grams].sum(axis=0) / np.sqrt(v.count[0])
                xs.append(np.concatenate([p["E"][v.word[0]], chars]) @ p["W"] + p["b"])
            n = 3 * toxicity.HIDDEN
            h = np.concatenate([gru([x[:n] for x in xs], p["Uf"]), gru([x[n:] for x in xs[::-1]], p["Ub"])[::-1]], axis=1)
            e = np.exp(np.tanh(h @ p["A"]) @ p["a"])
            logits.append((e / e.sum()) @ h @ p["o"] + p["c"][0])
        assert row.score == pytest.approx(sig(max(logits) + 0.3) if logits else 0.0, abs=1e-4)


def test_toxicity_gradients():
    """Back-propagation against finite differences."""
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, offsets = common.byte_chunks([b"one two three two", b"four one"])
    w = common.Words(data, offsets, lower=True)
    v, inverse = toxicity.vocabulary(w)
    doc, first, size = toxicity.windows(w.count)
    index, mask = toxicity._gather(first, size, inverse)
    y = np.array([1.0, 0.0])

    def loss():
        proj = net.embed(v) @ net.p["W"] + net.p["b"]
        z = net.forward(proj, index, mask)
        return float((np.log1p(np.exp(z)) - y * z).sum())

    keep = {}
    proj = net.embed(v) @ net.p["W"] + net.p["b"]
    z = net.forward(proj, index, mask, keep)
    g, _ = net.gradients(keep, toxicity._sigmoid(z) - y)
    for k in ("Uf", "Ub", "A", "a", "o"):
        at = (0,) * net.p[k].ndim
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = loss()
        net.p[k][at] = old - 1e-3
        down = loss()
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4), k


# packed ids and BPE


@pytest.mark.parametrize("values", [[0], [7] * 600, list(range(1300)), [1, 2, 3, 2**32 - 1, 0] * 250, [5] * 511 + [2**31]])
def test_pack_round_trip(values):
    ids = np.array(values, np.uint32)
    for lo in range(0, len(ids), packed_ids.BLOCK):
        assert (packed_ids.unpack(b"xx" + packed_ids.pack(ids[lo : lo + packed_ids.BLOCK]), 2) == ids[lo : lo + packed_ids.BLOCK]).all()


def test_segments_and_random_access():
    r = np.random.default_rng(2)
    docs = [r.integers(0, 50_000, n).astype("<u4") for n in (1, 0, 700, 3, 2000)]
    raw = packed_ids.write_segment([5, None, 7, 8, 9], [d.tobytes() for d in docs])
    both = raw + packed_ids.MARKER.encode() + raw + packed_ids.MARKER.encode()
    for s in packed_ids.segments(both):
        for i, d in enumerate(docs):
            assert (s.document(i) == d).all()


def test_packed_ids(spark):
    special = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n <|endoftext|", "  <|endoftext|>  "]
    texts = ODD + special + many(30) + ODD
    got = packed_ids.packed_ids(documents(spark, texts, extra=True).repartition(3), public_tokenizers.path("byte_bpe_50k.json")).toPandas().set_index("doc_id").sort_index()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert t.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    start = 0
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        assert got.loc[i].tolist() == [start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())]
        start += len(ids)
    assert packed_ids.packed_ids(empty(spark), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    odd_ids = spark.createDataFrame([(None, "b"), (5, "c"), (5, "c")], "doc_id long, text string")
    assert [r[1] for r in packed_ids.packed_ids(odd_ids, public_tokenizers.path("byte_bpe_50k.json")).orderBy("start").collect()] == [0, 2, 4]


def test_packed_ids_over_many_files(spark, tmp_path, monkeypatch):
    """A range's files begin anew after a few segments, and starts run on through them."""
    import glob

    monkeypatch.setattr(packed_ids, "SEGMENT_BYTES", 300)
    monkeypatch.setattr(packed_ids, "SEGMENTS_PER_FILE", 3)
    texts = many(60, 2) + ["long " * 2000] + many(20, 3)
    path = str(tmp_path / "ids")
    packed_ids.write_ids(documents(spark, texts), path, public_tokenizers.path("byte_bpe_50k.json"), shards=2)
    files = glob.glob(path + "/part-*")
    assert len(files) > 8 and any("-c001" in f for f in files)
    got = packed_ids.read_ids(spark, path).orderBy("doc_id").toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = [len(t.encode(x, add_special_tokens=False).ids) + 1 for x in texts]
    assert got.n_tokens.tolist() == lengths and got.start.tolist() == (np.cumsum(lengths) - lengths).tolist()


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_digests(spark):
    texts = ODD + ["<|endoftext|> it's IT'S", "\x00\x01\r\n\r\n  z   ", "ǅʰͅ ९٣²½", "".join(map(chr, range(0x20, 0x300)))]
    got = bpe.digests(documents(spark, texts, extra=True), public_tokenizers.path("byte_bpe_50k.tiktoken")).toPandas().set_index("doc_id").sort_index()
    want = reference_encoding()
    for i, x in enumerate(texts):
        ids = want.encode_ordinary(x or "")
        assert got.loc[i].tolist()[:3] == [len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()]
        assert got.offsets_sha256[i] == hashlib.sha256(np.array(brute_offsets(want, ids), "<u4").tobytes()).hexdigest()
    assert bpe.digests(empty(spark), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0
    full = bpe.encode(documents(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken")).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in full] == [x or "" for x in texts]
    assert [np.frombuffer(r.offsets, "<u4").reshape(-1, 2).tolist() for r in full] == [brute_offsets(want, want.encode_ordinary(x or "")) for x in texts]


def brute_offsets(encoding, ids):
    """The characters that each token's bytes touch, byte by byte."""
    data = b"".join(map(encoding.decode_single_token_bytes, ids))
    owner, at = [], -1
    for b in data:
        at += (b & 0xC0) != 0x80
        owner.append(at)
    out, byte = [], 0
    for i in ids:
        n = len(encoding.decode_single_token_bytes(i))
        out.append([owner[byte], owner[byte + n - 1] + 1])
        byte += n
    return out


# near duplicates


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    label = list(range(len(texts)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_copies(seed=4):
    r = np.random.default_rng(seed)
    out = []
    for base in many(12, seed):
        words = base.split()
        for _ in range(6):
            w = list(words)
            for _ in range(int(r.integers(0, 4))):
                w[int(r.integers(0, len(w)))] = f"z{r.integers(0, 9)}"
            out.append(" ".join(w))
        for _ in range(3):  # a chain: each link drifts further from the base
            words = list(words)
            words[int(r.integers(0, len(words)))] = f"y{r.integers(0, 9)}"
            out.append(" ".join(words).upper())
    return out


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    texts = ODD + near_copies() + ODD
    got = neardup.near_duplicates(documents(spark, texts, extra=True), shingle=k, percent=percent).toPandas().set_index("doc_id").sort_index()
    sizes, comp = brute_components(texts, k, percent)
    assert got.n_shingles.tolist() == sizes and got.component_id.tolist() == comp
    assert got.kept.tolist() == [c == i for i, c in enumerate(comp)]


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "q r s t"), (2, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(odd).collect()), key=str)
    assert got == [(2, 0, 2, True), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 9, True), (None, 2, 4, False)]
    one = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(one).collect())) == [(None, 0, None, True), (None, 2, None, True), (None, 2, None, True)]


def test_near_duplicates_of_repeated_ids(spark):
    a, b = "the quick brown fox jumps over the lazy dog again and again", "nothing here is like any other text in this small table"
    docs = spark.createDataFrame([(1, a, 0), (2, a, 1), (2, b, 2), (3, a, 3), (3, a, 4), (5, b + " at all", 5), (5, b + " at all", 6), (7, None, 7), (7, None, 8), (None, b, 9), (None, "", 10)], "doc_id long, text string, near_key int")
    got = {(r.doc_id, r.text) for r in neardup.without_near_duplicates(docs, 5, 80).collect()}
    assert got == {(1, a), (2, b), (5, b + " at all"), (7, None), (None, "")}
    assert neardup.without_near_duplicates(docs, 5, 80).count() == 6 and neardup.without_near_duplicates(docs, 5, 80).columns == docs.columns
    alone = spark.createDataFrame([(4, b), (4, b), (4, a)], "doc_id long, text string")
    assert sorted(r.text for r in neardup.without_near_duplicates(alone, 5, 80).collect()) == sorted([a, b])
    assert neardup.without_near_duplicates(docs.limit(0), 5, 80).count() == 0


def test_near_duplicates_of_one_template(spark, monkeypatch):
    """Hundreds of texts share a template, most of them below the threshold: parts and blocks are many, and no link is lost."""
    monkeypatch.setattr(common, "PART", 16)
    monkeypatch.setattr(neardup, "BLOCK", 24)
    r = np.random.default_rng(12)
    template = many(1, 31)[0].split() * 2
    texts = []
    for i in range(260):
        w = list(template)
        for _ in range(int(r.integers(0, 14))):
            w[int(r.integers(0, len(w)))] = f"v{r.integers(0, 50)}"
        texts.append(" ".join(w))
    got = neardup.near_duplicates(documents(spark, texts)).toPandas().set_index("doc_id").sort_index()
    sizes, comp = brute_components(texts, 3, 85)
    assert got.n_shingles.tolist() == sizes and got.component_id.tolist() == comp
    assert 1 < len(set(comp)) < 260


def test_near_duplicates_of_very_long_texts(spark):
    """200,000 words each: one pair just above the threshold and one just below it."""
    words = [f"n{i}" for i in range(200_000)]

    def changed(prefix, n):
        w = [prefix + x for x in words]
        for k in range(n):
            w[5 + 35 * k] = f"{prefix}changed{k}"
        return " ".join(w)

    texts = [changed("a", 0), changed("a", 5400), changed("b", 0), changed("b", 5420)]
    got = neardup.near_duplicates(documents(spark, texts)).toPandas().set_index("doc_id").sort_index()
    assert got.n_shingles.tolist() == [199_998] * 4 and got.component_id.tolist() == [0, 0, 2, 3]


def test_blocks_of_a_group_equal_all_pairs():
    """Groups over several batches: every pair of two components within reach once, in the first group that it shares."""
    r = np.random.default_rng(8)
    rows, bands, hashes = 2, 4, 48
    sig = r.integers(0, 3, (60, 8)).astype(np.uint16)
    sig = np.concatenate([sig, sig[r.integers(0, 12, 60)][:, :1] * 0 + r.integers(0, 2, (60, hashes - 8))], axis=1).astype(np.uint16)
    size, component = r.integers(80, 101, 60), r.integers(0, 30, 60)
    groups = {}
    for i in range(60):
        for band in range(bands):
            groups.setdefault((band, *sig[i, band * rows : band * rows + rows]), []).append(i)
    bounds = [6, 16, 27]
    near = lambda i, j: component[i] != component[j] and 100 * min(size[i], size[j]) >= 85 * max(size[i], size[j]) and all((sig[i, : 16 * (t + 1)] == sig[j, : 16 * (t + 1)]).sum() >= m for t, m in enumerate(bounds))
    lines, want = [], set()
    for g, (key, ids) in enumerate(sorted(groups.items())):
        largest = int(np.bincount(component[ids]).argmax())
        for side, members in ((0, [i for i in ids if component[i] != largest]), (1, ids)):
            lines += [(g, 0, 0, side, int(key[0]), i, int(size[i]), int(component[i]), largest, sig[i].tobytes()) for i in members]
        want |= {frozenset((i, j)) for i in ids for j in ids if near(i, j)}
    names = ["bucket", "block_a", "block_b", "side", "band", "rep", "n_shingles", "component", "largest", "sig"]
    columns = [pa.array(c, pa.binary() if n == "sig" else pa.int64()) for n, c in zip(names, zip(*lines))]
    batches = pa.Table.from_arrays(columns, names).to_batches(max_chunksize=37)
    out = pa.Table.from_batches(list(neardup._block_pruner(bounds, 85, rows)(iter(batches)))).to_pylist()
    got = [(x["rep"], b) for x in out if x["kind"] for b in x["others"]]
    assert len(want) > 50 and {frozenset(p) for p in got} == want and len(got) == len(want)
    for x in out:
        if x["kind"]:
            named = {y["rep"] for y in out if not y["kind"] and y["bucket"] == x["bucket"]}
            assert {x["rep"], *x["others"]} <= named and len([y for y in out if y["bucket"] == x["bucket"] and y["kind"]]) <= 60

    # Sets so that exactly some of these pairs are links: what comes back joins the components as all links do.
    base = r.integers(0, 1 << 60, (4, 90)).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[i % 4][: 90 - int(r.integers(0, 12))], r.integers(0, 1 << 60, int(r.integers(0, 8))).astype(np.uint64)])) for i in range(60)]
    ready = sorted((x | {"members": None if x["kind"] else sets[x["rep"]].tobytes()} for x in out), key=lambda x: (x["bucket"], x["kind"], x["rep"]))
    table = pa.Table.from_pylist(ready, pa.schema([("bucket", pa.int64()), ("block_a", pa.int64()), ("block_b", pa.int64()), ("kind", pa.int32()), ("rep", pa.int64()), ("component", pa.int64()), ("others", pa.list_(pa.int64())), ("members", pa.binary())]))
    links = [(int(a), int(b)) for o in neardup._block_verifier(85)(iter(table.to_batches(max_chunksize=23))) for a, b in zip(o.column("a").to_pylist(), o.column("b").to_pylist())]
    alike = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))

    def joined(edges):
        label = list(range(30))
        for i, j in [*edges, *edges, *edges, *edges]:
            low, high = sorted((label[component[i]], label[component[j]]))
            label = [low if x == high else x for x in label]
        return label

    true = [tuple(p) for p in want if alike(*p)]
    assert 5 < len(true) < len(want) and all(frozenset(p) in want and alike(*p) for p in links) and len(links) <= len(true)
    assert joined(links) == joined(true)


def test_posterior_bounds_keep_true_links():
    for n, least in zip(range(16, 145, 16), neardup.posterior_bounds(0.85, 2e-5, 144)):
        lost = sum(__import__("math").comb(n, m) * 0.85**m * 0.15 ** (n - m) for m in range(least))
        assert lost < 1e-4


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    got = dict(neardup.components(links).collect())
    assert all(got[i] == 1 for i in range(1, 41)) and got[100] == got[95] == got[90] == 90


# language


def test_language(spark):
    r = np.random.default_rng(8)
    stems = {"aa": ["ching", "chung", "heit"], "bb": ["oire", "ment", "eaux"], "cc": ["tion", "ness", "ly"]}
    rows = []
    for i in range(150):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join(r.choice(stems[lang]) + r.choice(stems[lang]) for _ in range(60)), lang if i % 10 else None))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !!", None), (903, "x" * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = langid.identify(docs, langid.dictionaries(langid.learned_rows(docs), 20)).toPandas().set_index("doc_id")
    assert np.mean([got.lang_pred[i] == ["aa", "bb", "cc"][i % 3] for i in range(150)]) > 0.98
    assert list(got.lang_pred[[900, 901, 902]]) == ["und"] * 3 and got.rejected[[900, 901, 902]].all()
    assert got.score.between(0, 1).all() and got.lang_pred[903] in stems
    assert langid.identify(docs.limit(0), {}).count() == 0
    assert set(langid.identify(docs, {}).toPandas().lang_pred) == {"und"}


def test_language_equals_plain_compression(spark):
    import zstandard

    r = np.random.default_rng(3)
    rows = [(i, " ".join(r.choice(["heit", "keit", "oire", "ment", "tion"]) + str(r.integers(0, 9)) for _ in range(30 + i)), ["aa", "bb"][i % 2]) for i in range(30)]
    docs = spark.createDataFrame(rows + rows[:4], "doc_id long, text string, lang string")
    content = langid.dictionaries(docs, 5)
    got = langid.identify(docs, content).toPandas()
    for x in got.itertuples():
        plain = re.sub(r"[^a-z]+", " ", rows[x.doc_id][1].lower()).strip()
        plain = re.sub(r"(?<![^ ])([a-z]+)(?: \1(?![^ ]))+", r"\1", plain).encode()
        size = {}
        for lang, raw in content.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size[lang] = 8 * len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(plain)) / len(plain)
        best = min(size, key=lambda k: (size[k], k))
        assert x.lang_pred == best and x.rejected == (max(size.values()) - size[best] < langid.MARGIN)
        assert x.score == pytest.approx(1 / sum(np.exp(-8 * (v - size[best])) for v in size.values()))


def test_language_dictionaries_are_bounded(spark):
    text = lambda i: " ".join(f"{'abcdefghij'[k % 10]}{'klmnopqrst'[(k * i) % 10]}é{'uvwxyz'[(k + i) % 6]}" for k in range(4000))
    rows = [(i, text(i), "aa" if i % 2 else "bb") for i in range(12)] + [(3, text(3), "aa")] * 200 + [(None, "x y", "aa"), (50, None, "cc"), (51, "12", "cc"), (52, "kurz und gut", "dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = langid.dictionaries(docs, 4, 8000)
    assert set(content) == {"aa", "bb", "dd"} and content["dd"] == b"kurz und gut"
    assert all(6000 < len(content[x]) < 8400 for x in ("aa", "bb")) and len(content["aa"].decode().split("\n")) == 4
    assert langid.dictionaries(docs.limit(0)) == {}
    assert set(langid.identify(docs, {"aa": b"x"}).toPandas().lang_pred) == {"aa", "und"}


def test_words_and_chunks():
    col = pa.array(ODD)
    seen = [(i, j) for i, j, _, _ in common.text_chunks(col, 50)]
    assert seen[0][0] == 0 and seen[-1][1] == len(ODD) and all(a[1] == b[0] for a, b in zip(seen, seen[1:]))
    for i, j, data, offsets in common.text_chunks(col.slice(2), 1 << 30):
        w = common.Words(data, offsets)
        assert w.count.tolist() == [len(WORD.findall(t or "")) for t in ODD[2:]]


def test_words_and_vocabulary_in_blocks():
    """Memory beside the results stays small whatever the texts' size, and blocks change no hash."""
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(10**6, 10**8, 4000))) for _ in range(60)] + ["", "x" * 60_000, "A b a B"]
    (_, _, data, offsets), *_ = common.text_chunks(pa.array(texts), 1 << 40)
    tracemalloc.start()
    w = common.Words(data, offsets, lower=True)
    words_peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    v, inverse = toxicity.vocabulary(w)
    vocabulary_peak = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    # Without blocks: 44 and 166 bytes a byte of text.
    assert words_peak < 30 * len(data) and vocabulary_peak < 80 * len(data)
    short = [bytes(data[s : s + n]).lower() for s, n in zip(w.start, w.length)]
    at = [0, 1, len(short) // 2, len(short) - 5, len(short) - 4, len(short) - 1]
    for i in at:
        one = common.Words(np.frombuffer(short[i], np.uint8), np.array([0, len(short[i])]))
        assert one.hash[0] == w.hash[i]
        alone, _ = toxicity.vocabulary(one)
        k = inverse[i]
        assert list(v.grams[v.first[k] : v.first[k] + v.count[k]]) == list(alone.grams)
