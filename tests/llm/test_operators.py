"""Each operator against a brute-force version, on edge cases and on a small table."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__

pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, anchor string, node long, cut string, label int"


def texts():
    """Nulls, blanks, short and long texts, copies, near copies, shared passages, odd characters."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeèü日 ".strip()) for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = some(120), some(60)
    near = base.split(" ")
    near[60] = "other"
    out = [None, "", " \n\t ", "one", "the same word " * 40, base, base, " ".join(near), base.upper(), some(30) + " " + passage + "\n" + some(40), passage, some(5) + " " + passage, some(3000)]
    out += ["a" * 500, "ab" * 300, "x\x85y \x1c z", "Licensed under the MIT License.\nSPDX-License-Identifier: Apache-2.0", "GNU General, Public (License) cc by", "you idiot, this moron is trash", "not an idiot"]
    return out + [some(rnd.randint(1, 200)) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", None, None, "x", 1, "y", None) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def as_dict(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def split(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_substring_dedup(docs):
    from meridian.llm.substring_dedup import repeated_passages_report

    got = as_dict(repeated_passages_report(docs))
    all_words = {i: split(t) for i, t in enumerate(texts())}
    count = Counter(tuple(w[k : k + 35]) for w in all_words.values() for k in range(len(w) - 34))
    for i, w in all_words.items():
        gone = {j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert tuple(got[i]) == (i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert len(got) == len(all_words)


def suffix_cut(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        out[i] = (b, gone)
    return out


def test_suffix_dedup(docs):
    from meridian.llm.suffix_dedup import later_copies_report, remove_later_copies

    got, cut = as_dict(later_copies_report(docs)), as_dict(remove_later_copies(docs))
    for i, (b, gone) in suffix_cut(enumerate(texts())).items():
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        runs = len(re.findall(b"\1+", bytes(gone)))
        assert tuple(got[i]) == (i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
        assert (cut[i]["text"] or "") == kept.decode(errors="ignore")
        assert (cut[i]["text"] is None) == (texts()[i] is None)
    assert set(cut[0].asDict()) == set(docs.columns)


def test_suffix_dedup_of_shared_openings(spark):
    """Openings of 93 to 106 bytes in many partitions: only what is 100 bytes long goes, whatever a document's place in its slice."""
    from meridian.llm.suffix_dedup import later_copies_report

    rnd = random.Random(5)
    letters = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    openings = [letters(106) for _ in range(8)]
    rows = [(i, openings[i % 8][: 93 + i // 8 % 14] + letters(150)) for i in range(448)]
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = as_dict(later_copies_report(spark.createDataFrame(rows, "doc_id long, text string")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for i, (b, gone) in suffix_cut(rows).items():
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        assert tuple(got[i])[:3] == (i, len(b), sum(gone)) and got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def shingles(text):
    w = split(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and label[a] < label[b]:
                    label[b], changed = label[a], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_dedup(docs):
    from meridian.llm.near_dedup import drop_near_duplicates, near_duplicates

    want = groups(enumerate(texts()))
    got = as_dict(near_duplicates(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    kept = as_dict(drop_near_duplicates(docs))
    assert set(kept) == {i for i, (_, c) in want.items() if i == c}


def test_near_dedup_of_a_large_family(spark):
    """A star of copies of which many are linked to nothing: no link is lost, none is invented."""
    from meridian.llm.near_dedup import near_duplicates

    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(90)]
    rows = []
    for i in range(250):
        copy = list(base)
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(len(copy))] = f"w{rnd.randint(0, 20)}"
        rows.append((i, " ".join(copy)))
    got = as_dict(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == groups(rows)


def test_registers_are_locality_sensitive():
    from meridian.llm.near_dedup import likely_similarity, sketch

    rnd = np.random.default_rng(1)
    shared, a, b = (rnd.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 100, 100))
    own, name = np.repeat([0, 1], 700), np.concatenate([shared, a, shared, b])
    both = sketch(own, name, 2)
    got = likely_similarity(both[:1], both[1:], np.array([700.0]), np.array([700.0]))[0]
    assert abs(got - 0.75) < 0.12
    union = sketch(np.zeros(800, np.int64), np.concatenate([shared, a, b]), 1)
    assert (np.maximum(both[0], both[1]) == union[0]).all()


def test_toxicity(spark):
    from meridian.llm import queries

    d = "/root/testdata/sf0.01"
    rows = queries.op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    clean = [r["predicted"] for r in rows if r["held_out"] and not r["toxic"]]
    toxic = [r["predicted"] for r in rows if r["held_out"] and r["toxic"]]
    assert np.mean(clean) < 0.05 and np.mean(toxic) > 0.5


def test_toxicity_grammar(spark, docs):
    from meridian.llm import toxicity as T

    after, factor = T.composed(T.PARTS)
    path, total = [T.TARGET, T.INSULT], 1.0
    state = 0
    for k in path:
        total *= factor[state, k]
        state = after[state, k]
    assert total == pytest.approx(1.3)
    state = after[0, T.NEGATION]
    assert factor[state, T.INSULT] == 0.5
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    got = as_dict(T.scored(docs, T.train(docs, empty)))
    by_text = {t: got[i]["score"] for i, t in enumerate(texts()) if t}
    assert by_text["you idiot, this moron is trash"] > by_text["not an idiot"] > got[0]["score"] == got[1]["score"]


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from meridian.llm.packing import packed

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    pieces = packed(docs, path, length=64).collect()
    digests = packed(docs, path, length=64, digest=True).collect()
    assert sorted(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in pieces) == sorted(r["ids_crc32"] for r in digests)
    by_doc = {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(by_doc.setdefault(r["doc_id"], [])) and r["length"] == len(r["ids"])
        by_doc[r["doc_id"]] += r["ids"]
    for i, t in enumerate(texts()):
        assert by_doc[i] == [*plain.encode(t or "", add_special_tokens=False).ids, 1]
    fill = Counter()
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert all(n == 64 for k, n in fill.items() if k < max(fill)) and max(fill) == len(fill) - 1


def test_quality_measures(docs):
    from meridian.llm.quality import judged

    got = as_dict(judged(docs))
    for i, t in enumerate(texts()):
        w = split(t)
        count = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["over"] is None)


def test_quality_limits_follow_the_source(spark):
    """Values that are usual in one source and odd in another are judged by source; merged sketches give the quartiles."""
    from pyspark.sql import functions as F

    from meridian.llm import quality as Q

    rows = [(i, " ".join(["x" * (5 if i % 2 else 15)] * 1 + [f"{'y' * (5 if i % 2 else 15)}{k}" for k in range(60)]), "en", "short" if i % 2 else "long") for i in range(600)]
    rows.append((1000, " ".join("z" * 15 + str(k) for k in range(60)), "en", "short"))
    got = as_dict(Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert got[0]["kept"] and got[1]["kept"] and not got[1000]["kept"] and got[1000]["over"] == "word_length"
    values = np.arange(1, 1001) / 100.0
    frame = spark.createDataFrame([("m", float(v)) for v in values], "metric string, v double").select(F.lit("a").alias("lang"), F.lit("b").alias("source"), "metric", Q.bucket(F.col("v")).alias("bucket"), F.lit(1).alias("n"))
    upto = np.cumsum([r["n"] for r in frame.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect()])
    assert upto[-1] == 1000


def test_license_scan(docs):
    from meridian.llm.licenses import BASE, Scanner, license_labels, rules

    assert len(rules()) > 200
    got = as_dict(license_labels(docs))
    for i, t in enumerate(texts()):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t).encode())
        places = sorted((k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == [x.encode() for x in p.split()])
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = sorted({x for _, x in places})
        assert r["base_labels"] == ",".join(base) and set(base) <= set(r["labels"].split(",") if r["labels"] else []) and 0 <= r["score"] <= 1
    scan = lambda x: [(r.label, r.way) for _, _, r in Scanner().detections(x)]
    assert scan(b"gnu lesser general public license v2.1") == [("lgpl", "name with version")]
    assert scan(b"under cc by-nc 4.0.")[0][0] == "cc-by-nc"


def test_license_scan_of_long_matches_bodies_and_abbreviations():
    from meridian.llm.licenses import Scanner

    scan = lambda x: [(r.label, r.way, b - a) for a, b, r in Scanner().detections(x)]
    url = b"https://www.apache.org/licenses/" + b"a/" * 300
    assert scan(b"see " + url) == [("apache", "address", len(url))]
    name = b"gnu" + b" " * 900 + b"lesser" + b"\n" * 900 + b"general public license"
    assert scan(name) == [("lgpl", "name", len(name))]
    far = b"licensed under" + b" " * 500 + b"the mit license"
    assert scan(far) == [("mit", "grant", len(far))]
    labels = lambda x: {x for x, _, _ in scan(x)}
    assert labels(b"permission is hereby granted, free of charge, to any person obtaining a\ncopy of this") == {"mit"}
    assert labels(b"redistribution and use in source and binary forms, with or without\nmodification, are permitted") == {"bsd"}
    assert labels(b"licensed under the gpl") == labels(b"gplv3 or later") == labels(b"gpl-3.0-only") == {"gpl"}
    assert labels(b"under lgplv2.1") == {"lgpl"} and labels(b"agplv3") == {"agpl"}


def test_byte_bpe(docs):
    import public_tokenizers as P
    import tiktoken

    from meridian.llm.byte_bpe import decoded, encoded, read_ranks, round_trip

    path = P.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    rows = encoded(docs, path, P.PATTERN)
    got, back, digest = as_dict(rows), as_dict(decoded(rows, path, P.PATTERN)), as_dict(round_trip(docs, path, P.PATTERN))
    for i, t in enumerate(texts()):
        ids = plain.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and bytes(back[i]["content"]) == (t or "").encode()
        assert got[i]["ends"] == np.cumsum([len(plain.decode_single_token_bytes(k)) for k in ids]).tolist()
        assert tuple(digest[i])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_token_counts(docs):
    import public_tokenizers
    import sentencepiece

    from meridian.llm.token_counts import token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = as_dict(token_counts(docs, path, limit=50))
    for i, t in enumerate(texts()):
        n = len(model.encode(t or ""))
        assert tuple(got[i]) == (i, len((t or "").encode()), n, n > 50)


def test_media_round_trip(spark, docs):
    from meridian.llm import media as M

    got = as_dict(M.media_report(docs))
    tensors = as_dict(M.decode_media(M.encode_media(docs)))
    for i, t in enumerate(texts()):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = M.encode_jpeg(payload)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        x = tensors[i]
        assert bytes(x["payload"]) == payload and len(x["rgb"]) == x["height"] * x["width"] * 3
    with pytest.raises(ValueError, match="JPEG"):
        M.read_jpeg(b"GIF89a")


def jvm_pixels(spark, media):
    """The pixels that an independent reader sees."""
    jvm = spark._jvm
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(media)))
    return np.array([[[(v := picture.getRGB(x, y)) >> 16 & 255, v >> 8 & 255, v & 255] for x in range(picture.getWidth())] for y in range(picture.getHeight())])


def test_media_is_a_picture_for_others(spark):
    """An independent reader takes the file and sees the same luminance."""
    from meridian.llm import media as M

    rnd = random.Random(6)
    media = M.encode_jpeg(bytes(rnd.getrandbits(8) for _ in range(64 * 24)))
    whole = M.read_jpeg(media)
    grey = M.to_rgb(M.Picture(whole.height, whole.width, whole.components[:1], whole.quantisers))[..., 0]
    jvm = spark._jvm
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
    reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(bytearray(media))))
    raster = reader.readRaster(0, None)
    theirs = np.array([[raster.getSample(x, y, 0) for x in range(raster.getWidth())] for y in range(raster.getHeight())])
    assert grey.shape == theirs.shape and np.abs(grey.astype(int) - theirs).max() <= 2


@pytest.mark.parametrize("progressive", [True, False])
def test_pictures_of_others_are_read(spark, progressive):
    """Files of another writer, with tables, predictions, runs and odd sizes of its own."""
    from meridian.llm import media as M

    jvm, wide, tall = spark._jvm, 37, 21
    image = jvm.java.awt.image.BufferedImage(wide, tall, 1)
    for y in range(tall):
        for x in range(wide):
            image.setRGB(x, y, (6 * x) << 16 | (11 * y) << 8 | 128)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    if progressive:
        how.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.close()
    media = bytes(out.toByteArray())
    picture = M.read_jpeg(media)
    assert media.count(b"\xff\xda") == (10 if progressive else 1) and M.payload_of(picture) is None
    assert np.abs(M.to_rgb(picture).astype(int) - jvm_pixels(spark, media)).mean() < 4  # chroma is smoothed there


def test_scans_unpacked_at_once_are_as_decoded(monkeypatch):
    from meridian.llm import jpeg as J
    from meridian.llm import media as M

    rnd = random.Random(2)
    media = M.encode_jpeg(bytes(rnd.getrandbits(8) for _ in range(64 * 30)))
    once = J.read_jpeg(media)
    monkeypatch.setattr(J.Scan, "unpack", lambda self, scan: False)
    each = J.read_jpeg(media)
    assert all((a.blocks == b.blocks).all() for a, b in zip(once.components, each.components, strict=True))


def test_empty_tables(spark):
    from meridian.llm import licenses, media, near_dedup, packing, quality, substring_dedup, suffix_dedup, token_counts, toxicity
    from meridian.llm.queries import vocabulary

    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    frames = [
        substring_dedup.repeated_passages_report(none), near_dedup.near_duplicates(none), toxicity.drop_toxic(none, labels), packing.packed(none, vocabulary("word_bpe_49k.json")),
        quality.keep_good(none), licenses.license_labels(none), token_counts.token_counts(none, vocabulary("piece_bpe_32k.model")), media.media_report(none), suffix_dedup.remove_later_copies(none),
    ]
    assert [x.count() for x in frames] == [0] * len(frames)


def test_repeated_rows_and_null_ids(spark):
    from meridian.llm import near_dedup, packing, substring_dedup, suffix_dedup
    from meridian.llm.queries import vocabulary

    text = " ".join(f"word{k}" for k in range(80))
    rows = spark.createDataFrame([(1, text), (1, text), (None, "other " * 3), (None, None)], "doc_id long, text string")
    one = substring_dedup.repeated_passages_report(rows).collect()
    assert len(one) == 4 and all(r["n_removed"] == 0 for r in one)
    assert all(r["n_removed"] == 0 for r in suffix_dedup.later_copies_report(rows).collect())
    near = near_dedup.near_duplicates(rows).collect()
    assert len(near) == 4 and all(r["kept"] for r in near)
    assert packing.packed(rows, vocabulary("word_bpe_49k.json")).count() == 4
    twin = spark.createDataFrame([(None, text), (2, text)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.later_copies_report(twin).collect()} == {None: 0, 2: len(text)}


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 14)) and "pipeline" in names


def thue_morse(letters, n=2048):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement have one value under every odd base modulo 2**64."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from meridian.llm import near_dedup, packing, quality, substring_dedup

    one, two = thue_morse("ab"), thue_morse("ba")
    rest = " ".join(f"w{k}" for k in range(34))
    rows = spark.createDataFrame([(1, f"{one} {rest}", "en", "s"), (2, f"{two} {rest}", "en", "s"), (3, f"{one}\n{two}", "en", "s")], "doc_id long, text string, lang string, source string")
    assert [r["n_removed"] for r in substring_dedup.repeated_passages_report(rows).collect()] == [0, 0, 0]
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality.judged(rows).collect()} == {1: 0, 2: 0, 3: 0}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in as_dict(near_dedup.near_duplicates(rows)).items()} == groups([(r["doc_id"], r["text"]) for r in rows.collect()])
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    ids = {}
    for r in sorted(packing.packed(rows, path).collect(), key=lambda r: (r["doc_id"], r["start"])):
        ids.setdefault(r["doc_id"], []).extend(r["ids"])
    assert ids == {r["doc_id"]: [*plain.encode(r["text"], add_special_tokens=False).ids, 1] for r in rows.collect()}


def test_names_are_told_apart_by_bytes():
    """Words that share a name are still different words."""
    from meridian.llm import pieces

    table = pieces.WordTable(lambda words: (np.arange(len(words)), np.array([int(x) for x in words], np.int32), np.ones(len(words), np.int64)), 100)
    data = np.frombuffer(b"11 22 11 33", np.uint8)
    begin, end = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    real, pieces.stretch_names = pieces.stretch_names, lambda data, a, b: np.zeros(len(a), np.uint64)
    try:
        for _ in range(2):
            assert table.tokens(table.numbers(data, begin, end))[0].tolist() == [11, 22, 11, 33]
    finally:
        pieces.stretch_names = real


def test_rows_that_share_an_id(spark):
    """Rows of one id (or none) with different texts are documents of their own."""
    from meridian.llm import near_dedup, quality, substring_dedup, suffix_dedup

    rnd = random.Random(9)
    some = lambda n: " ".join(f"w{rnd.randint(0, 99)}" for _ in range(n))
    passage = some(80)
    rows = [(1, passage + " " + some(30)), (1, some(300) + " " + passage), (1, None), (None, passage), (None, some(5) + " " + passage), (None, ""), (2, passage), (2, passage), (3, some(400))]
    for k in range(40):
        rows.append((k // 4, some(rnd.randint(1, 60)) + (" " + passage if k % 3 == 0 else "")))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    distinct = {(i, t or "") for i, t in rows}
    words = {k: split(k[1]) for k in distinct}
    count = Counter(tuple(w[j : j + 35]) for w in words.values() for j in range(len(w) - 34))
    want = Counter()
    for i, t in rows:
        w = split(t)
        gone = {j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()] += 1
    assert Counter(map(tuple, substring_dedup.repeated_passages_report(frame).collect())) == want

    cut = Counter((r["doc_id"], r["text"] or "") for r in suffix_dedup.remove_later_copies(frame).collect())
    report = suffix_dedup.later_copies_report(frame).collect()
    assert len(report) == len(rows) == sum(cut.values())
    # The first place of the passage stays: a document without id comes before all others.
    assert sum(passage in t for _, t in cut.elements()) >= 1 and all(i is None for i, t in cut.elements() if passage in t)
    assert sum(r["n_removed"] for r in report) == sum(len((t or "").encode()) for _, t in rows) - sum(len(t.encode()) for _, t in cut.elements())

    got = near_dedup.near_duplicates(frame).collect()
    assert len(got) == len(rows) and all(r["kept"] for r in got if r["doc_id"] is None)
    kept = near_dedup.drop_near_duplicates(frame).collect()
    assert Counter((r["doc_id"]) for r in kept) == Counter(r["doc_id"] for r in got if r["kept"])
    judged = quality.judged(frame.selectExpr("*", "'en' as lang", "'s' as source"))
    assert judged.count() == len(rows) and quality.keep_good(frame.selectExpr("*", "'en' as lang", "'s' as source")).count() == judged.where("kept").count()


CLASH = "doc_id long, text string, lang string, source string, _gone long, _cut_id long, _cut_text string, id long, hash long, twin long, row long, cut string, node long, text_a string, slice long, piece string, part long, settled string, toxic int"


def test_clashing_columns_long_texts_and_repeated_rows(spark):
    """Columns with the operators' own names, a text longer than any slice, and rows that come twice."""
    import public_tokenizers as P

    from meridian.llm import byte_bpe, licenses, media, near_dedup, packing, quality, substring_dedup, suffix_dedup, token_counts, toxicity

    rnd = random.Random(4)
    long = " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(150_000))
    assert len(long) > 800_000
    rest = (7, 7, "x", 7, 7, 7, 7, "x", 7, "x", 7, "x", 7, "x", 7)
    rows = [(i, t, "en", "s", *rest) for i, t in [(1, long), (2, "short text"), (2, "short text"), (3, None)]]
    docs = spark.createDataFrame(rows, CLASH)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model, words, ranks = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
    n = {1: 150_000, 2: 2, 3: 0}
    assert sorted((r["doc_id"], r["n_words"]) for r in substring_dedup.repeated_passages_report(docs).collect()) == [(1, n[1]), (2, 2), (2, 2), (3, 0)]
    assert sorted((r["doc_id"], r["n_words"]) for r in licenses.license_labels(docs).collect()) == [(1, n[1]), (2, 2), (2, 2), (3, 0)]
    assert sorted((r["doc_id"], r["n_words"]) for r in quality.judged(docs).collect()) == [(1, n[1]), (2, 2), (2, 2), (3, 0)]
    assert sorted(r["n_bytes"] for r in suffix_dedup.later_copies_report(docs).collect()) == [0, 10, 10, len(long)]
    assert sorted(r["n_bytes"] for r in token_counts.token_counts(docs, model).collect()) == [0, 10, 10, len(long)]
    assert sorted(r["n_bytes"] for r in media.media_report(docs).collect()) == [0, 10, 10, len(long)]
    digests = byte_bpe.round_trip(docs, ranks, P.PATTERN).collect()
    assert sorted(r["decoded_sha256"] for r in digests) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
    assert {r["doc_id"] for r in packing.packed(docs, words).where("start = 0").collect()} == {1, 2, 3}
    assert toxicity.scored(docs, toxicity.train(docs, labels)).count() == 4
    for frame in (near_dedup.drop_near_duplicates(docs), suffix_dedup.remove_later_copies(docs), toxicity.drop_toxic(docs, labels)):
        assert sorted(map(str, frame.collect())) == sorted(map(str, docs.collect())) and frame.columns == docs.columns
    assert [r["doc_id"] for r in quality.keep_good(docs).collect()] == [1]


def test_token_counts_fuzzed(spark):
    """Blanks, the sign for blanks, and characters that are normalised, in all orders."""
    import public_tokenizers
    import sentencepiece

    from meridian.llm.token_counts import token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("ab c  \u2581\n\t.\u00e9\u65e5\u00a0\u3000xyz") for _ in range(rnd.randint(0, 30)))) for i in range(3000)]
    got = as_dict(token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, size=5000))
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(model.encode(t)) for i, t in rows}


def test_token_counts_move_little(spark):
    """A slice's pre-tokens and frequencies take less than the texts, also where each word is new."""
    from meridian.llm import token_counts as T
    from meridian.llm.common import slices

    rnd = random.Random(2)
    rows = [(i, " ".join("".join(rnd.choice("abcdefghij") for _ in range(8)) for _ in range(200))) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").toArrow()
    found = T.Frequencies()
    for part in slices(iter(frame.to_batches())):
        found.add(part)
    row = found.row(0).to_pylist()[0]
    assert len(found.number) > 99_000
    moved = sum(len(x["packed"]) for x in row["pieces"]) + len(row["counts"])
    assert moved < 0.8 * found.bytes
    some = [y for x in row["pieces"] for y in T.unpacked_pieces(x["packed"])]
    assert sorted(some) == sorted(found.number)


def test_license_signatures_hold_their_keywords():
    from meridian.llm.signatures import KINDS, signatures

    rows = signatures()
    assert len(rows) > 180 and len(set(rows)) == len(rows)
    assert all(len(x) == 4 and x[2] in KINDS and x[1] in x[3].replace("\\", "") for x in rows)


def test_byte_bpe_of_no_rows(spark):
    import public_tokenizers as P

    from meridian.llm.byte_bpe import round_trip

    assert round_trip(spark.createDataFrame([], SCHEMA), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("n", [100, 300])
def test_a_family_costs_members_not_pairs(spark, monkeypatch, n):
    """A family with a passage that its hub lacks: what is measured grows like its members."""
    from meridian.llm import near_dedup as N

    rnd = random.Random(8)
    base, passage = [f"b{k}" for k in range(80)], [f"p{k}" for k in range(25)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        copy = base + passage
        copy[rnd.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    seen = []
    real = N.measured
    monkeypatch.setattr(N, "measured", lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest))
    got = as_dict(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in groups(rows).items()}
    assert sum(seen) < 60 * n


def test_components_are_not_labelled_anew(spark, monkeypatch):
    """Later rounds of links cost the links between components, not the nodes of all components."""
    from meridian.llm import near_dedup as N

    rnd = random.Random(8)
    base, passage = [f"b{k}" for k in range(80)], [f"p{k}" for k in range(25)]
    rows = [(0, " ".join(base))]
    for i in range(1, 100):
        copy = base + passage
        copy[rnd.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(i, f"other{i % 100} " + " ".join(f"o{i % 100}w{k}" for k in range(40))) for i in range(100, 300)]
    rows += [(i, rows[i - 200][1] + " tail") for i in range(300, 500)]
    seen = []
    real = N.components
    monkeypatch.setattr(N, "components", lambda edges: seen.append(edges.where("a != b").count()) or real(edges))
    got = as_dict(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in groups(rows).items()}
    assert len(seen) > 1 and seen[0] >= 100 and max(seen[1:]) < 100


@pytest.mark.parametrize("edges", [[(1, 1)], [(k, k + 1) for k in range(100)], [(100, k) for k in range(100)], [(k, 199 - k) for k in range(100)] + [(199 - k, k + 1) for k in range(80)]])
def test_components_of_any_shape(spark, edges):
    """Each node that is not the smallest of its component has one row."""
    from meridian.llm.near_dedup import components

    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted((x, y) for x, y in label.items() if x != y)


def test_only_centres_rows_are_dealt(spark):
    """Rows that no pair needs are not joined, and each centre's pairs all find their row."""
    from pyspark.sql import functions as F

    from meridian.llm.near_dedup import PAIRS_A_TASK, dealt_join

    n = 3 * PAIRS_A_TASK
    pairs = spark.createDataFrame([(0, b) for b in range(1, n)] + [(1, 2)], "a long, b long")
    of = lambda key, x: spark.range(n).select(F.col("id").alias(key), (F.col("id") * 10).alias(x))
    dealt = dealt_join(pairs, of("a", "x"), of("b", "y"))
    found = sorted(tuple(r) for r in dealt.select("a", "b", "x", "y").collect())
    assert found == sorted([(0, b, 0, 10 * b) for b in range(1, n)] + [(1, 2, 10, 20)])
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") == 1 and plan.count("Join Inner") == 3


def plain_figures(text, grammar):
    """The figures of a text word by word, with the four transducers run side by side instead of composed."""
    from meridian.llm import toxicity as T
    from meridian.llm.common import TextSlice

    listed = dict(zip(grammar.names.tolist(), zip(grammar.kinds.tolist(), grammar.weights.tolist(), strict=True), strict=True))
    raw = lower(text).encode()
    words = [(m.start(), m[0]) for m in re.finditer(rb"[a-z\x80-\xff]+", raw)]
    clauses, last = [[]], 0
    for at, word in words:
        if re.search(rb"[.!?;:\n]", raw[last:at]):
            clauses.append([])
        data = np.frombuffer(word, np.uint8)
        kind, weight, name = T.OTHER, 0.0, None
        for _, names in T.word_features(TextSlice(None, data, np.array([0, len(data)])))[2]:
            for x in names.tolist():
                k, w = listed.get(x, (None, 0.0))
                if k is not None and (kind == T.OTHER or k == kind == T.INSULT and w > weight):
                    kind, weight, name = k, w, x
        clauses[-1].append((kind, weight, name))
        last = at
    totals, seen = [], set()
    for clause in clauses:
        states, total = [0] * len(T.PARTS), 0.0
        for kind, weight, name in clause:
            steps = [p.step(s, kind) for p, s in zip(T.PARTS, states, strict=True)]
            gain = np.prod([f for _, f in steps])
            total += gain * (weight if kind == T.INSULT else T.THREAT_WEIGHT if kind == T.THREAT else 0.0)
            states = [s for s, _ in steps]
            if kind == T.INSULT:
                seen.add(name)
        totals.append(total)
    whole = sum(totals)
    return np.log1p(whole), max(totals), len(seen), whole / np.log(2 + len(words)), sum(x > 0 for x in totals)


def test_toxicity_against_a_plain_scorer(spark):
    from meridian.llm import toxicity as T

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    grammar = T.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet").join(docs.select("doc_id"), "doc_id"))
    extra = ["you idiot, he said. i will kill you! not a moron, never scum", "they said he is stupid; you trash: burn it", "kill. you", "no no no idiot idiot idiot", None, ""]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-1 - k, t) for k, t in enumerate(extra)]
    got = as_dict(T.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), grammar))
    hits = 0
    for i, t in rows:
        x = plain_figures(t, grammar)
        z = grammar.curve @ np.array([1.0, x[0], min(x[1], 6.0), min(x[2], 6.0), min(x[3], 3.0)])
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9) and got[i]["clauses"] == x[4]
        hits += x[4] > 0
    assert hits >= 4


def test_words_with_one_name_are_no_repeat(spark):
    """Two words of sixteen bytes share their first name; documents that differ in this word only repeat no window."""
    from meridian.llm import common, substring_dedup

    pair = "abcdefghd000adaa", "1R2mZlC6xDUO69BX"
    data = np.frombuffer("".join(pair).encode(), np.uint8)
    starts, ends = np.array([0, 16]), np.array([16, 32])
    assert len(set(common.stretch_names(data, starts, ends).tolist())) == 1 and len(set(common.stretch_names(data, starts, ends, True).tolist())) == 2
    around = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join([*around[:20], word, *around[20:]])) for k, word in enumerate(pair)]
    got = as_dict(substring_dedup.repeated_passages_report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {k: r["n_removed"] for k, r in got.items()} == {0: 0, 1: 0}


def test_spans_do_not_depend_on_rolling_fingerprints(monkeypatch):
    """Where all rolling fingerprints of two texts are equal, their stretches still have different names."""
    import pyarrow as pa

    from meridian.llm import suffix_dedup

    class Same:
        def of(self, a, b):
            return np.zeros(len(a), np.uint64)

    monkeypatch.setattr(suffix_dedup, "byte_rolling", lambda data, second=False: Same())
    batch = pa.record_batch([pa.array([1, 2]), pa.array([0, 0]), pa.array([3, 4]), pa.array(["x" * 100, "y" * 100])], names=["doc_id", "twin", "hash", "text"])
    spans = [x for rows in suffix_dedup._parse(100, 32)(iter([batch])) for x in rows.column("span").to_pylist()]
    assert len(spans) == 2 == len(set(spans))


def test_stages_take_any_column_names(spark):
    from meridian.llm import near_dedup, quality, suffix_dedup, toxicity

    text = " ".join(f"some{k} word" for k in range(60))
    docs = spark.createDataFrame([(1, text, "en", "s", "u"), (2, None, "en", "s", "v")], "doc_id long, text string, lang string, source string, `meta.url` string")
    labels = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, toxic int")
    for frame in (toxicity.drop_toxic(docs, labels), near_dedup.drop_near_duplicates(docs), suffix_dedup.remove_later_copies(docs)):
        assert frame.columns == docs.columns and sorted(map(str, frame.collect())) == sorted(map(str, docs.collect()))
    assert [r["meta.url"] for r in quality.keep_good(docs).collect()] == ["u"]


def test_limits_come_from_the_groups(spark):
    """On the given tables, word lengths are judged by what is usual in a source, and that decides."""
    from meridian.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality.measured(docs)
    limits = quality.limits(quality.sketches(rows)).collect()
    found = {r["limit_word_length"] for r in limits}
    assert len(found) >= 3 and min(found) > quality.FLOORS["word_length"] and max(found) < 10
    by_lang = {}
    for r in limits:
        by_lang.setdefault(r["lang"], set()).add(r["limit_word_length"])
    assert max(map(len, by_lang.values())) > 1
    judged = quality.judged(docs).collect()
    by_length = [r for r in judged if r["over"] == "word_length" and not r["base_failed"]]
    assert len(by_length) > 20
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    good = [r for r in judged if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(not r["kept"] for r in good) <= len(good) // 100
