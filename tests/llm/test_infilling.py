"""Fill-in-the-middle against a plain version, on edge cases."""

import hashlib
import random
import re

import pytest

infilling = pytest.importorskip("meridian.llm.infilling")

TEXTS = [None, "", "a", "<", "one two  three", "é日本 x\n\ty🙂z", "has <P> inside", "ends with <S", "<M", ">S> <<P", "\u0000 nul \u0000", "x" * 3000, "  ", "A1b2C3" * 50]
CLASH = "doc_id long, text string, h1 string, output string, form int, `meta.url` string, n string"


def plain(doc_id, text):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    n = len(u)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_plain_version(spark):
    rnd = random.Random(5)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id at all"), (None, None), (3, "same id, other text"), (3, "same id, other text")]
    rows += [(1000 + k, "".join(rnd.choice("ab <>PSM\né日") for _ in range(rnd.randint(0, 60)))) for k in range(2000)]
    docs = spark.createDataFrame([(i, t, "h", "o", 1, "u", "n") for i, t in rows], CLASH).repartition(3)
    out = infilling.restored(infilling.infilled(docs)).collect()
    key = lambda x: tuple(map(str, x))
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["text"]) for r in out), key=key)
    assert got == sorted(((i, *plain(i, t), t or "") for i, t in rows), key=key)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    report = sorted(map(tuple, infilling.infilled_report(docs).collect()), key=key)
    assert report == sorted(((i, *w[:4], digest(w[4]), digest(t or "")) for i, t in rows for w in [plain(i, t)]), key=key)


def test_other_parameters_and_long_texts(spark):
    long = "word, " * 400_000
    docs = spark.createDataFrame([(k, long + str(k)) for k in range(3)], "doc_id long, text string")
    rows = infilling.restored(infilling.infilled(docs, ("[p]", "[s]", "[m]"), 0, 100, "7"), ("[p]", "[s]", "[m]")).collect()
    assert all(r["form"] == "spm" and r["output"].startswith("[s]") and r["text"] == long + str(r["doc_id"]) for r in rows) and len(rows) == 3


def test_empty_table(spark):
    assert infilling.infilled_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
