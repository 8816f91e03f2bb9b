"""The filter audit against a plain version: every order walked for every document."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

filter_audit = pytest.importorskip("meridian.llm.filter_audit")

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, mask int, part string, `meta.url` string, label int, text_a string"


def fails(doc_id, text, smallest):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    out = ""
    out += "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return out + "E" * (doc_id is not None and smallest.get(text, doc_id) < doc_id)


def plain(rows, labels):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, s in rows:
        parts[s or ""].append((i, fails(i, t or "", smallest)))
    out, shapley = {}, Counter()
    for part, documents in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = documents
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                every = [x for x in documents if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                out[part, order, step + 1] = (len(left), len(gone), len(every) - len(gone), sum(x[1] == f for x in documents), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone))
    return {(p, o, k, *x, shapley[p, o[k - 1]]) for (p, o, k), x in out.items()}


def audit(spark, rows, labels, n=3):
    docs = spark.createDataFrame([(i, t, s, "en", 1, 2, "p", "u", 3, "x") for i, t, s in rows], SCHEMA).repartition(n)
    frame = filter_audit.audited(filter_audit.failure_masks(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, good int")))
    return set(map(tuple, frame.collect()))


def some_rows():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeé日Z") for _ in range(rnd.randint(1, 7))) for _ in range(900)]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = [some(rnd.choice([3, 150, 199, 200, 201, 400])) for _ in range(40)] + ["same word " * 150, "x" * 9000, "x" * 9000 + "y", "", " \n ", "Ab" * 30, "a#b", some(300) + "|", "x\x1cy \x85 z"]
    rows = [(i, rnd.choice([*base, None]), rnd.choice(["s", "t", "hot", "hot", "hot", None, ""])) for i in range(300)]
    return rows + [(7, base[0], "s"), (7, base[0], "s"), (None, base[1], "s"), (None, base[1], None), (8, base[1], "t")]


def test_against_plain_version(spark):
    rows = some_rows()
    labels = [(i, i % 3 % 2, (i % 5 == 0) + 0, 0) for i in range(0, 200)] + [(3, None, 1, 0), (3, 1, None, 0), (None, 1, 1, 0), (9999, 1, 1, 0)]
    assert audit(spark, rows, labels) == plain(rows, [x[:3] for x in labels])
    assert audit(spark, rows[:1], []) == plain(rows[:1], [])
    assert audit(spark, [], labels) == set()


def test_hot_texts_and_common_openings(spark, monkeypatch):
    """A text with a third of all rows, and another third that shares an opening longer than the sample's prefixes."""
    monkeypatch.setattr(filter_audit, "SAMPLE_BYTES", 50)
    monkeypatch.setattr(filter_audit, "RANGE_BYTES", 4000)
    opening = "opening " * 20
    rows = [(i, ["one hot text", f"{opening}{i // 2}", f"{i * 7919 % 1000} other"][i % 3], "s") for i in range(1200)]
    ranges = filter_audit.Ranges([((t or "").encode()[:50], hash(t)) for _, t, _ in rows], 50)
    assert max(ranges.spread) > 1 and max(ranges.split) > 1
    assert audit(spark, rows, [], 8) == plain(rows, [])


def test_tries_hold_what_they_were_given():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12))).encode() for _ in range(2000)]
    trie = filter_audit.Trie()
    for t in texts:
        node = trie.terminal(t)
        node.value = (node.value or 0) + 1
    assert [(t, n.value) for t, n in trie.walk()] == sorted(Counter(texts).items())


def test_terminals_keep_the_smallest_id():
    copies = filter_audit.Copies()
    assert [copies.add(i, p) for i, p in [(5, "a"), (5, "b"), (3, "c"), (9, "d"), (3, "e"), (5, "f")]] == [None, None, (5, ["a", "b"]), (9, ["d"]), None, (5, ["f"])]
    assert copies.low == 3 and copies.parts == ["c", "e"]
