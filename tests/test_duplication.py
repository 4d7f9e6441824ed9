"""Copied blocks against a plain walk over all windows and all their places."""

import hashlib
import re

import numpy as np
import pytest

from tallyforge.rules import duplication


def plain_lines(text):
    out, inside = [], False
    for at, raw in enumerate(text.split("\n"), 1):
        t = raw.strip()
        if inside:
            inside = "*/" not in t
        elif t.startswith("/*"):
            inside = "*/" not in t
        elif t not in ("", "{", "}", "};", "});", "})", "[", "]", "else", "try", "finally") and not re.match(r"//|#|using |namespace ", t):
            out.append((at, re.sub(" +", " ", t)))
    return out


def plain_blocks(files, window, least):
    lines = {d: plain_lines(t) for d, t in files.items()}
    key = lambda d, i: "".join(x + "\n" for _, x in lines[d][i : i + window])
    places = {}
    for d, ls in lines.items():
        for i in range(len(ls) - window + 1):
            places.setdefault(key(d, i), []).append((d, i))
    out = []
    for d, ls in lines.items():
        last = len(ls) - window
        i = 0
        while i <= last:
            if len(places[key(d, i)]) < 2:
                i += 1
                continue
            start, common, seen = i, None, {}
            while i <= last and len(places[key(d, i)]) > 1:
                mine = [(o, p) for o, p in places[key(d, i)] if o != d or p < start or p >= i + window]
                here = {o for o, _ in mine}
                if common is not None and not common & here:
                    break
                common = here if common is None else common & here
                for o, p in mine:
                    seen.setdefault(o, []).append(lines[o][p][0])
                i += 1
            if i - start + window - 1 >= least and common:
                first = hashlib.sha256(key(d, start).encode()).hexdigest()[:16].upper()
                # A place counts from the moment that its file is a partner; partners at the end were so all along.
                out.append((d, ls[start][0], ls[i + window - 2][0] - ls[start][0] + 1, first, tuple((o, min(seen[o])) for o in sorted(common)[:5])))
    return sorted(out)


def found(spark, files, **how):
    df = spark.createDataFrame([(d, t) for d, t in files.items()], "path string, content string")
    return sorted((r.doc, r.first_line, r.lines, r.hash, tuple((o["doc"], o["line"]) for o in r.others)) for r in duplication.copied_blocks(df, **how).collect())


def test_lines_that_count(spark):
    text = "/* a\n b */ c\n  x   y \n\n}\nusing z;\n/* one */\n// no\n# no\nelse\nkept /* open\nstill kept */\n/*\n*/\nlast"
    rows = duplication.code_lines(spark.createDataFrame([("f", text)], "path string, content string"), "path", "content").orderBy("n").collect()
    assert [(r.line, r.code) for r in rows] == plain_lines(text) == [(3, "x y"), (11, "kept /* open"), (12, "still kept */"), (15, "last")]


def test_a_new_partner_is_a_new_block(spark):
    a, b = [f"first {i}" for i in range(14)], [f"second {i}" for i in range(14)]
    files = {"both": "\n".join(a + b), "one": "\n".join(["own line"] + a), "two": "\n".join(b), "none": "nothing here"}
    got = found(spark, files)
    assert got == plain_blocks(files, 8, 12)
    assert [(x[0], x[1], x[2], x[4]) for x in got] == [("both", 1, 14, (("one", 2),)), ("both", 15, 14, (("two", 1),)), ("one", 2, 14, (("both", 1),)), ("two", 1, 14, (("both", 15),))]


def test_a_block_is_no_copy_of_itself(spark):
    files = {"same": "\n".join(["again"] * 40), "twice": "\n".join([f"l {i}" for i in range(13)] * 2)}
    assert found(spark, files) == plain_blocks(files, 8, 12)


@pytest.mark.parametrize("hot", [1000, 3])
@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_walk(spark, seed, hot):
    r = np.random.default_rng(seed)
    blocks = [[f"b{k} {i % (3 if k % 4 == 0 else 99)}" for i in range(r.integers(3, 9))] for k in range(7)]
    files = {}
    for d in range(24):
        text = [f"own {d}"] if d % 3 else ["licence a", "licence b", "licence c", "licence d"]
        for k in r.integers(0, 7, r.integers(1, 7)):
            text += blocks[k][r.integers(0, 2) :] + ([f"own {d} {len(text)}"] if r.random() < 0.3 else [""])
        files[f"f{d:02}"] = "\n".join(text)
    files["f24"] = files["f25"] = files["f03"]
    want = plain_blocks(files, 3, 4)
    assert len(want) > 20 and found(spark, files, window=3, least=4, hot=hot) == want


def test_odd_tables(spark):
    none = spark.createDataFrame([], "path string, content string")
    assert duplication.copied_blocks(none).count() == 0
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "\n".join(f"l{i}" for i in range(20)), "z"), (4, "\n".join(f"l{i}" for i in range(20)), "z")], "id long, body string, held string")
    out = duplication.copied_blocks(rows, "id", "body")
    assert [(r.doc, r.first_line, r.lines, [tuple(o) for o in r.others]) for r in out.orderBy("doc").collect()] == [(3, 1, 20, [(4, 1)]), (4, 1, 20, [(3, 1)])]
    assert [r.symbol.split(" ")[1] for r in duplication.duplication_findings(out).orderBy("file_path").collect()] == ["4:1", "3:1"]
