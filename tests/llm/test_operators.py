"""The training-data operators against brute force, on small fixtures with the awkward rows."""

import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedplane.llm import bpe, common, components, decontaminate, html_extract, jaccard, langid, license_scan, lm_score, pii, topk, url_filter
from seedplane.llm.queries import vocabulary

LONG = "lorem " * 30_000


def texts_frame(spark, texts, extra=True):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    return df if extra else df.select("doc_id", "text")


# 1
@pytest.mark.parametrize("leaf", [1, 3, 16, 8192])
def test_bpe_equals_the_library(leaf):
    path = vocabulary()
    library = bpe.tokenizer(path)
    chance = random.Random(leaf)
    pools = ["a", "ab", "the and ing ", "éèß日本", "'s'll'tx ", "0123", "!?'.", " \n\t", "<|endoftext|> x", "😀é"]
    for _ in range(200):
        pool = chance.choice(pools) + chance.choice(pools)
        text = "".join(chance.choice(pool) for _ in range(chance.randrange(0, 200)))
        if chance.random() < 0.2:
            text = text[:40] + "<|endoftext|>" + text[40:]
        ids = bpe.encode(path, text, leaf)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert bpe.decode(path, ids) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_long_unsplit_and_dealt_texts(spark):
    path = vocabulary()
    library = bpe.tokenizer(path)
    texts = [None, "", "x" * 50_000, "ab" * 20_000 + "  \n" + "cd" * 10_000, "hello world", "hello world", LONG[:40_000], "<|endoftext|>" * 3]
    df = bpe.with_digests(bpe.encoded(texts_frame(spark, texts), path, leaf=1000, long_chars=5_000), path)
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(struct.pack("<I", x) for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.with_digests(bpe.encoded(texts_frame(spark, []), path), path).count() == 0


def test_bpe_uses_tiktoken_only_where_it_merges_alike(tmp_path):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    def file(name, merges):
        letters = sorted({c for pair in merges for c in "".join(pair)})
        vocabulary = {c: i for i, c in enumerate([*letters, *dict.fromkeys(a + b for a, b in merges)])}
        t = Tokenizer(models.BPE(vocabulary, merges))
        t.pre_tokenizer, t.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
        t.save(path := str(tmp_path / name))
        return path, t

    path, t = file("unreachable.json", [("b", "c"), ("x", "y"), ("xy", "b"), ("xyb", "c")])  # xybc is never made from its own text
    assert bpe.ranked(path) is None
    assert bpe.encode_batch(path, ["xybc xyb"]) == [t.encode("xybc xyb").ids]


def test_bpe_repeated_long_rows_of_other_partitions_and_batches(spark):
    path = vocabulary()
    one = texts_frame(spark, ["the cat and the hat " * 500]).coalesce(1)
    want = hashlib.sha256(b"".join(struct.pack("<I", x) for x in bpe.tokenizer(path).encode("the cat and the hat " * 500, add_special_tokens=False).ids)).hexdigest()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 1)
    try:
        for df in (one.union(one), one.union(one).union(one).coalesce(1)):
            got = [r.ids_sha256 for r in bpe.with_digests(bpe.encoded(df, path, leaf=1000, long_chars=5_000), path).collect()]
            assert got == [want] * df.count()
    finally:
        spark.conf.set(name, before)


# 2
def brute_lm(texts, order=3, backoff=0.4):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    total = {k: Counter(g for w in words for g in grams(w, k)) for k in range(1, order + 1)}
    n = sum(map(len, words))
    out = []
    for w in words:
        own = {k: Counter(grams(w, k)) for k in total}
        c = lambda g: total[len(g)][g] - own[len(g)][g]

        def s(history, x):
            if not history:
                return np.log(c((x,)) / max(n - len(w), 1)) if c((x,)) > 0 else np.log(backoff / (n - len(w) + 1))
            g = (*history, x)
            return np.log(c(g) / max(c(history), 1)) if c(g) > 0 else np.log(backoff) + s(history[1:], x)

        out.append(sum(s(tuple(w[max(0, i - order + 1) : i]), x) for i, x in enumerate(w)))
    return words, out


def test_lm_scores_equal_brute_force(spark):
    chance = random.Random(2)
    vocab = "the a of cat dog Sat mat on".split()
    texts = [" ".join(chance.choice(vocab) for _ in range(chance.randrange(0, 40))) for _ in range(60)] + [None, "", "  \n", "one", "the cat", "the cat", "the " * 3000]
    words, want = brute_lm(texts)
    got = {r.doc_id: r for r in lm_score.scores(texts_frame(spark, texts), block_bytes=300).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i].n_words == len(words[i])
        assert got[i].log_score == pytest.approx(w, abs=1e-6)
        assert (got[i].mean_log_score is None) == (not words[i])
    assert lm_score.scores(texts_frame(spark, [])).count() == 0


def test_lm_texts_shorter_than_an_ngram_alone_in_a_partition(spark):
    texts = ["a b c d", "x", "y z", "", None]
    df = texts_frame(spark, texts).repartitionByRange(5, "doc_id").withColumns({c: F.lit(1) for c in ("id", "block", "k", "bucket", "n_words", "log_score")})
    got = {r.doc_id: (r.n_words, r.log_score) for r in lm_score.scores(df).collect()}
    assert {i: n for i, (n, _) in got.items()} == {0: 4, 1: 1, 2: 2, 3: 0, 4: 0}
    assert got[1][1] == pytest.approx(np.log(0.4 / 7)) and got[3][1] == got[4][1] == 0


def test_lm_packed_numbers_come_back():
    chance = np.random.default_rng(2)
    for n in (0, 1, 2, 9, 1000):
        for top in (1, 2, 300, 2**17, 2**58, 2**64):
            x = np.sort(chance.integers(0, top, n, dtype=np.uint64))
            assert (lm_score._unpack_rising(lm_score._pack_rising(x)) == x).all()


def test_lm_tells_words_apart_that_share_their_leading_hash_bits(spark):
    texts = ["w3906113 a b", "w594863 b a", "w594863 c d", "w3042786 d c", "w3573259 e a", "w195174 f b", "w4843729 g c"]  # pairs that share 42 bits
    _, want = brute_lm(texts)
    got = {r.doc_id: r.log_score for r in lm_score.scores(texts_frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-6)


# 3
def test_pii_is_replaced_consistently(spark):
    texts = [
        "Write to anna.b@corp.de or ANNA.B@corp.de from 8.8.4.4, card 4111 1111 1111 1111.", "anna.b@corp.de again; card 4111111111111111; +1 (017) 555-7713", None, "", "nothing here, version 3.", "Mrs Anna Schmidt met Mr Bob Jones",
        "Frau Anna Schmidt", "the years 1998 1999 2000 2001", "IBAN DE89 3704 0044 0532 0130 00", "key a" + "0" * 39, "no entity " * 20_000, "anna.b@corp.de again; card 4111111111111111; +1 (017) 555-7713",
    ]
    df = pii.pseudonymised(texts_frame(spark, texts), "secret")
    assert df.columns == ["doc_id", "text", "source", "n"]
    got = {r.doc_id: r.text for r in df.collect()}
    assert got[2] is None and got[3] == "" and all(got[i] == texts[i] for i in (4, 7, 10))
    assert got[1] == got[11]
    mail = re.findall(r"\S+@\S+", got[0])
    assert mail[0] == mail[1] == re.findall(r"[^ ;]+@[^ ;]+", got[1])[0] != "anna.b@corp.de"
    card = re.search(r"card ([\d ]+)", got[0])[1]
    assert re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", card) and card.replace(" ", "") == re.search(r"card (\d+)", got[1])[1]
    digits = [int(c) for c in card.replace(" ", "")][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r"10(\.\d+){3},", re.search(r"from (\S+)", got[0])[1])
    assert "555-7713" not in got[1] and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}$", got[1])
    first, family = re.fullmatch(r"Mrs (\w+) (\w+) met Mr \w+ \w+", got[5]).groups()
    assert got[6] == f"Frau {first} {family}" and first in pii.NAMES["f", "latin"]
    iban = re.search(r"DE\d\d[ \d]+", got[8])[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pii.pseudonymised(texts_frame(spark, []), "k").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymised(texts_frame(spark, []), " ")


def test_pii_surrogates_are_distinct(spark):
    rows = [("SSN", f"{i:09d}", None) for i in range(100, 900)] + [("NAME", f"N{i} M{i}", "f") for i in range(300)]
    made = pii.surrogate_map(spark.createDataFrame(rows, "kind string, value string, gender string"), "k").collect()
    assert len(made) == len(rows)
    assert len({(r.kind, r.made) for r in made}) == len(rows)
    assert not {(r.kind, r.made) for r in made} & {(k, v) for k, v, _ in rows}


# 4
def test_html_main_text(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/x>Menu</a></li></ul></nav><div class=\"ad\">Buy now</div>"
        "<article><h1>Head &amp; line</h1><p>One  two\n three.<p><b>Un</b>closed &eacute;<br>after &am</p><aside>side</aside><form><p>Name</p></form><div class='comments'><p>First!</p></div><p>End.</article><footer>&copy; x</footer>"
    )
    plain = "<div class=menu><a href=1>a</a></div><div>A longer text stands here.</div><div>And more.</div>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", plain), (5, "u", "<p>" + "word " * 50_000), (6, "u", "<nav>only</nav>"), (1, "u", page)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 7 and got[0].text == got[6].text
    by = {r.page_id: r for r in got}
    assert by[1].text == "Head & line\nOne two three.\nUnclosed é\nafter &am\nEnd."
    assert by[2].text == by[3].text == by[6].text == ""
    assert by[4].text == "A longer text stands here.\nAnd more."
    assert by[5].n_chars == len(by[5].text) == 249_999
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_without_a_mark_leaves_thin_lines_out():
    long = ["The river rose in the night and the whole lower town was under water by the morning of the second day.", "People carried what they could up the hill, and the school was opened to all who had no place to sleep.", "Nobody was hurt.", "The bridge is closed until the engineers have looked at each of its pillars, which will take a week or so.", "Trains stop one station earlier, and buses take the long way round by the northern road until further word."]
    body = "<h1>Flood</h1>" + "".join(f"<p>{t}</p>" for t in long[:3]) + "<h2>Traffic</h2>" + "".join(f"<div>{t}</div>" for t in long[3:])
    page = f"<body><div>Please turn on scripts.</div><p>Today's offer: shoes!</p>{body}<div>Share this story</div><div>Print</div><p>Copyright The Paper</p><h3>More</h3><div>Imprint</div></body>"
    assert html_extract.main_text(page) == "\n".join(["Flood", *long[:3], "Traffic", *long[3:]])
    # a very long line doesn't make the others thin
    assert html_extract.main_text(f"<p>{'word ' * 9000}</p>{body}").endswith(long[-1])


# 5
def test_license_scan(spark):
    texts = ["Intro text.\nLicensed under the Apache License, Version 2.0. More", "LICENSED under the apache licence version 2.0", "clean text about a license", None, "", "Released under the MIT License. x " * 2, "pad " * 40_000 + "Licensed under CC BY-NC 4.0."]
    got = license_scan.scan(texts_frame(spark, texts)).collect()
    found = Counter((r.doc_id, r.license) for r in got)
    assert found == {(0, "Apache-2.0"): 1, (1, "Apache-2.0"): 1, (5, "MIT"): 2, (6, "CC-BY-NC-4.0"): 1}
    first = next(r for r in got if r.doc_id == 0)
    assert texts[0][first.span_start : first.span_end] == "Licensed under the Apache License, Version 2.0"
    assert license_scan.scan(texts_frame(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 1.", ["GPL"]),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.", ["LGPL-2.1"]),
        ("Licensed under the Apache License, Version 1.1.", ["Apache"]),
        ("Licensed under CC BY 3.0.", ["CC"]),
        ("Licensed under CC BY-SA 4.0. And: licensed under CC BY-ND 4.0.", ["CC-BY-SA-4.0", "CC-BY-ND-4.0"]),
        ("Copyright me. " + next(x[1] for x in license_scan.TEMPLATES if x[0] == "BSD-2-Clause") + " THIS SOFTWARE IS PROVIDED AS IS", ["BSD-2-Clause"]),
        ("Copyright me. " + next(x[1] for x in license_scan.TEMPLATES if x[0] == "BSD-3-Clause") + " THIS SOFTWARE IS PROVIDED AS IS", ["BSD-3-Clause"]),
        ("the license of the software is under the terms of a public work in source and binary forms", []),
    ],
)
def test_license_versions_and_variants(text, want):
    index = license_scan.Index(license_scan.TEMPLATES)
    assert [x[0] for x in license_scan.scan_text(index, text)] == want


def test_license_alignment_equals_brute_force():
    chance = random.Random(8)
    for _ in range(200):
        a, b = ([chance.randrange(5) for _ in range(chance.randrange(1, 14))] for _ in range(2))
        best, grid = (0, 0), [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                (s, m), up, left = grid[i][j], grid[i][j + 1], grid[i + 1][j]
                grid[i + 1][j + 1] = max((s + 2, m + 1) if x == y else (s - 1, m), (up[0] - 1, up[1]), (left[0] - 1, left[1]), (0, 0))
                if grid[i + 1][j + 1][0] <= 0:
                    grid[i + 1][j + 1] = (0, 0)
                best = max(best, grid[i + 1][j + 1])
        assert license_scan.align(np.array(a), np.array(b), -len(a), len(b))[0] == best[1]


def test_winnowing_keeps_one_of_every_window():
    x = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    kept = set(license_scan.winnowed(x, 4).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(len(x) - 3))


# 6
def test_top_k_equals_brute_force(spark):
    chance = np.random.default_rng(3)
    x = chance.normal(size=(400, 6)).round(1)
    x[50:120] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1020, [None] * 6), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (1080, []), (1100, [1.0, 2.0]), (1101, [1.0, 3.0]), (None, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "rank", "score", "b", "qb", "floor")})
    got = topk.top_k(df, F.col("id") % 20 == 0, query_block=7, block=60).collect()
    q = np.floor(64 * x).astype(int)
    want = set()
    for i in range(0, 400, 20):
        s = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:20]
        want |= {(i, k + 1, j, -v) for k, (v, j) in enumerate(s)}
    want.add((1100, 1, 1101, 64 * 64 + 128 * 192))
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_threshold_stops_early_and_large_values_stay_exact():
    c = np.zeros((5000, 3))
    c[:, 0] = np.arange(5000)
    at, ids, scores, made = topk.threshold_top_k(np.array([-1]), np.array([[1.0, 0, 0]]), np.arange(5000), c, 5)
    assert made < 200
    assert sorted(zip(scores.tolist(), ids.tolist(), strict=True), reverse=True) == [(4999 - i, 4999 - i) for i in range(5)]
    # components that fall off: a part of the products, all of the results; a floor from elsewhere leaves still less
    chance = np.random.default_rng(5)
    skewed = np.floor(64 * chance.normal(size=(4000, 16)) * 0.4 ** np.arange(16))
    q = skewed[:40]
    at, ids, scores, made = topk.threshold_top_k(np.arange(40), q, np.arange(4000), skewed, 20)
    want = q @ skewed.T
    want[np.arange(40), np.arange(40)] = -np.inf
    for i in range(40):
        assert sorted(scores[at == i].tolist()) == sorted(np.sort(want[i])[-20:].astype(int).tolist())
    assert made < 0.5 * want.size
    floor = np.sort(want, axis=1)[:, -20]
    again = topk.threshold_top_k(np.arange(40), q, np.arange(4000), skewed, 20, floor=floor)
    assert again[3] <= made and len(again[2]) >= 800 and all(again[2] >= floor[again[0]])
    weak = np.floor(skewed * 0.3)  # a block that holds nothing better
    _, _, scores, rest = topk.threshold_top_k(np.arange(40), q, np.arange(4000, 8000), weak, 20, floor=floor)
    assert rest < 0.5 * topk.threshold_top_k(np.arange(40), q, np.arange(4000, 8000), weak, 20)[3]
    assert len(scores) == int((q @ weak.T >= floor[:, None]).sum())
    big = np.array([[2.0**40, 3.0]])
    assert topk._dot(big, big)[0, 0] == 2**63 - 1
    assert topk._dot(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0]]))[0, 0] == 2**60 + 1


# 7
def test_decontamination_finds_substitutions(spark):
    chance = random.Random(5)
    word = lambda: "".join(chance.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (15, 40, 150, 3)]
    def changed(w, every):
        return [x if (i + 1) % every else word() for i, x in enumerate(w)]
    docs = [
        " ".join(word() for _ in range(700)) + " " + " ".join(items[0]) + ".", "Start: " + ", ".join(changed(items[1], 8)).upper() + " end", " ".join(items[2]), " ".join(items[1][:10]), None, "", " ".join(word() for _ in range(100)),
        "see " + " ".join(items[3]), " ".join(word() for _ in range(253)) + " " + " ".join(items[1]),
    ]
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(items)] + [(9, None, 1), (10, "", 1)], "item_id long, text string, n long")
    for limit in (1 << 18, 1):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(texts_frame(spark, docs), bench, broadcast_seeds=limit).collect()}
        assert set(got) == {(0, 0), (1, 1), (2, 2), (7, 3), (8, 1)}
        assert got[0, 0].matched == 15 and got[1, 1].matched == 35 and got[2, 2].matched == 150
    left = decontaminate.without_overlaps(texts_frame(spark, docs), bench)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6] and left.columns == ["doc_id", "text", "source", "n"]
    assert decontaminate.overlaps(texts_frame(spark, []), bench).count() == 0
    assert decontaminate.overlaps(texts_frame(spark, docs), bench.limit(0)).count() == 0


def test_decontamination_finds_passages_and_moved_words(spark):
    chance = random.Random(6)
    word = lambda: "".join(chance.choice("abcdefgh") for _ in range(5))
    many = lambda n: [word() for _ in range(n)]
    items = [many(n) for n in (150, 30, 15, 200)]
    docs = [
        many(300) + items[0][40:120] + many(300),  # 80 words of 150
        many(50) + items[1][:15] + many(1) + items[1][15:] + many(50),  # one word put in
        many(50) + items[1][:15] + items[1][16:] + many(50),  # one left out
        many(250) + items[2][:7] + many(2) + items[2][7:],  # 7 and 8 words of 15, over a block's end
        many(70) + items[3][57:71] + many(70),  # 14 words over a segment's end
        [x if (i + 1) % 8 else word() for i, x in enumerate(items[3][20:60])],  # 40 words of 200, each eighth changed
        many(80) + items[3][10:18] + many(80) + items[3][100:109] + many(80) + items[0][5:15],  # short quotes only
    ]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.overlaps(texts_frame(spark, [" ".join(d) for d in docs]), bench).collect()}
    assert got == {(0, 0): 80, (1, 1): 30, (2, 1): 29, (3, 2): 15, (4, 3): 14, (5, 3): 35}


# 8
def test_language_id(spark):
    words = {"en": "the of and that with for this", "de": "der und mit von ist nicht auch", "fr": "le de et que pour avec dans", "es": "el de que para con una por"}
    chance = random.Random(8)
    rows = [(i, " ".join(chance.choice(words[k].split()) for _ in range(20)), k) for i, k in enumerate(list(words) * 60)]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "der und mit " * 40_000, None), (1003, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:240] if got[r[0]].held_out]
    assert held and sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert got[1000].lang_pred == got[1001].lang_pred == got[1003].lang_pred == "und" and got[1000].score == 0
    assert got[1002].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_language_id_null_and_repeated_ids_and_ties(spark):
    words = {"en": "the house and the tree were there", "de": "das Haus und der Baum waren dort"}
    rows = [(i if i % 5 else None, t, lang) for i in range(40) for lang, t in words.items()] + [(7, words["en"], "en")] * 3 + [(7, words["de"], "de"), (8, "123", "en"), (9, None, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("h", "v", "score", "held_out")})
    a, b = ([(r.doc_id, r.text, r.held_out, r.lang_pred, r.score) for r in langid.identify(d).select("doc_id", "text", "held_out", "lang_pred", "score").collect()] for d in (df, df.repartition(7)))
    assert Counter(a) == Counter(b) and len(a) == len(rows)  # the same model in whatever order the rows come
    assert all(h is False for i, _, h, _, _ in a if i is None)
    assert {(t, p) for _, t, _, p, _ in a} == {(words["en"], "en"), (words["de"], "de"), ("123", "und"), (None, "und")}
    only_null = df.filter("doc_id is null")
    assert {r.lang_pred for r in langid.identify(only_null).collect()} == {"und"}


# 9
def test_url_rules_and_edge_cases(spark):
    urls = ["http://A.Example.COM/en/7?x", "https://b.example.com/en/81#top", "http://x.net/de/1", "http://q.example.net/de/8/9", "http://org/es/", "http://fr.org/es", None, "no scheme", "x://", "http://x.net", "http://x.net", "http://h.test/" + "a" * 5000]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.url_filter(df, url_filter.CONTRACT_RULES).collect()}
    assert [got[i].rule for i in range(6)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None]
    assert [got[i].verdict for i in range(6)] == ["allow", "block", "allow", "block", "block", "allow"]
    assert (got[0].host, got[0].path) == ("a.example.com", "/en/7")
    for i in (6, 7, 8):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == ("", "", None, "allow")
    assert (got[9].host, got[9].path) == ("x.net", "")
    assert len(got) == len(urls)
    assert url_filter.url_filter(df.limit(0), url_filter.CONTRACT_RULES).count() == 0


def verdicts(spark, urls, rules):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.url_filter(df, rules).collect()}
    assert len(got) == len(urls)
    return [got[i] for i in range(len(urls))]


def test_url_branches_part_at_any_depth(spark):
    rules = [url_filter.Rule("h.test", "/a/b/c/spam/x", True), url_filter.Rule("h.test", "/a/b/c/d/e/f/bad/x", True)]
    marked = [f"http://h.test/a/b/c/spam/x/{i}" for i in range(40)] + [f"http://h.test/a/b/c/d/e/f/bad/x/{i}" for i in range(40)]
    spam = [f"http://h.test/a/b/c/d/e/f/bad/{i}" for i in range(5)]
    clean = [f"http://h.test/a/b/c/news/{i}" for i in range(30)] + [f"http://h.test/a/b/c/d/e/f/good/{i}" for i in range(30)] + ["http://h.test/a/b/c", "http://deep.test" + "/s" * 300]
    got = verdicts(spark, marked + clean, rules)
    assert got == ["block"] * len(marked) + ["allow"] * len(clean)
    assert verdicts(spark, spam, rules) == ["allow"] * len(spam)


def test_url_sections_with_support_stay_branches(spark):
    rules = [url_filter.Rule("h.test", "/en/", True)]
    sections = ["en"] + [f"s{chr(97 + i)}" for i in range(24)]
    urls = [f"http://h.test/{s}/{i}" for s in sections for i in range(40)]
    assert verdicts(spark, urls, rules) == ["block"] * 40 + ["allow"] * 960
    # single urls are variable segments, however many there are
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(600)]
    names_at = [f"http://v.test/u/{n}" for n in names]
    rules = [url_filter.Rule("v.test", f"/u/{c}", True) for c in "abcdefghijklm"]
    assert set(verdicts(spark, names_at, rules)) == {"block"}


# 10
def brute_groups(texts, words=4, percent=85):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80)])
def test_jaccard_groups_equal_brute_force(spark, words, percent):
    chance = random.Random(words)
    vocab = [f"w{i}" for i in range(300)]
    base = [[chance.choice(vocab) for _ in range(chance.randrange(1, 80))] for _ in range(40)]
    common = [chance.choice(vocab) for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:25]:
        for _ in range(4):  # chains of small edits
            b = list(b)
            for _ in range(chance.randrange(0, 3)):
                b[chance.randrange(len(b))] = chance.choice(vocab)
            texts.append(" ".join(b))
    texts += [" ".join(common + [chance.choice(vocab) for _ in range(chance.randrange(0, 9))]) for _ in range(60)]
    texts += [None, "", " \n\t", "One two", "one  two", "one", "one", "a b c", "x " * 5000, LONG[:60_000], LONG[:60_000]]
    n, want = brute_groups(texts, words, percent)
    got = {r.doc_id: r for r in jaccard.groups(texts_frame(spark, texts), words=words, percent=percent).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id) == (n[i], want[i]), (i, texts[i])


def test_jaccard_links_between_clusters_of_revisions(spark):
    chance = random.Random(20)

    def edited(words, k):
        words = list(words)
        for _ in range(k):
            words[chance.randrange(len(words))] = f"e{chance.randrange(10**9)}"
        return words

    texts, want = [], []
    for f in range(400):  # two clusters of revisions each; whether they link is a borderline matter
        draft = [f"f{f}w{chance.randrange(200)}" for _ in range(chance.randrange(60, 160))]
        other = edited(draft, max(1, len(draft) // 50))
        family = [" ".join(edited(d, chance.randrange(0, 2))) for d in (draft, other) for _ in range(chance.randrange(2, 6))]
        want += [len(texts) + g for g in brute_groups(family)[1]]
        texts += family
    got = {r.doc_id: r.component_id for r in jaccard.groups(texts_frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("seed", [1])
def test_jaccard_near_copies_of_drafts_and_a_common_line(spark, seed):
    chance = random.Random(seed)
    word = lambda: f"w{chance.randrange(100_000)}"
    draft = [word() for _ in range(90)]
    other = list(draft)
    for at in chance.sample(range(90), 5):
        other[at] = word()

    def copy(of, edits):
        t = list(of)
        for at in chance.sample(range(len(t)), edits):
            if chance.random() < 0.3:
                t[at] = ""
            else:
                t[at] = word() + (" " + word() if chance.random() < 0.2 else "")
        return " ".join(t)

    texts = [copy(chance.choice([draft, other]), chance.randrange(0, 7)) for _ in range(260)]
    texts += [copy(t.split(), chance.randrange(1, 4)) for t in chance.sample(texts, 60)]  # near copies of near copies
    line = " ".join(word() for _ in range(12))
    texts += [line + " " + " ".join(word() for _ in range(chance.randrange(0, 9))) for _ in range(400)] + [line] * 30
    chance.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("rep", "n", "fp", "group", "cluster", "token")})
    got = {r.doc_id: r.component_id for r in jaccard.groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts, 4, 85)[1]


def test_jaccard_one_id_with_different_texts(spark):
    chance = random.Random(4)
    a, b = (" ".join(f"w{chance.randrange(9999)}" for _ in range(60)) for _ in range(2))
    rows = [(5, a), (5, b), (8, b + " end"), (9, a), (9, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 57, 5), (5, 57, 5), (8, 58, 5), (9, 0, 9), (9, 57, 5)]


def test_all_pairs_adds_up_a_pairs_matches_over_tokens_of_both_majors(spark):
    # classes 2 and 4 share two tokens: group 1 has the most classes of one, group 3 of the other
    rows = [(t, rep, group) for t, reps in ((10, (1, 2, 4)), (11, (3, 4, 2))) for rep in reps for group in [1 if rep < 3 else 3]]
    placed = spark.createDataFrame([(t, 0, 1, rep, 20, 2, t - 10, t - 10, g, rep) for t, rep, g in rows], "token long, part int, parts int, rep long, n int, l int, pos int, shared int, group long, cluster long")
    assert {(2, 4)} <= {(r.a, r.b) for r in jaccard._pairs_across(placed, 85).collect()}


def test_jaccard_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (7, "A b c d e"), (9, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.groups(df).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, None), (7, 5), (9, 9)], key=str)
    assert jaccard.groups(df.limit(0)).count() == 0


def test_prefix_filter_is_complete():
    chance = np.random.default_rng(4)
    none = (np.empty(0, np.uint64), np.empty(0, np.int64), 20)
    for _ in range(300):
        a = np.unique(chance.integers(1, 2**63, chance.integers(1, 60)).astype(np.uint64))
        b = a[chance.random(len(a)) < 0.95]
        b = np.unique(np.r_[b, chance.integers(1, 2**63, chance.integers(0, 3)).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            la, pa, _ = jaccard.prefix(a, 85, none)
            lb, pb, _ = jaccard.prefix(b, 85, none)
            assert len(np.intersect1d(pa, pb)) >= min(la, lb)


# 3
def test_pii_names_without_their_title_and_other_forms(spark):
    texts = [
        "Mrs Anna Schmidt called. Later Anna Schmidt said yes; Schmidt left. Schmidtke stayed.",
        "Call 0171-2345678 or 030 1234567, see 2001:db8::ff00:42:8329 at 10:30:15.",
        "order 1234567890123 card 4111111111111111",
    ]
    got = {r.doc_id: r.text for r in pii.pseudonymised(texts_frame(spark, texts), "key").collect()}
    m = re.fullmatch(r"Mrs (\w+) (\w+) called\. Later (\w+) (\w+) said yes; (\w+) left\. Schmidtke stayed\.", got[0])
    assert m and m[1] == m[3] != "Anna" and m[2] == m[4] == m[5] != "Schmidt"
    m = re.fullmatch(r"Call (0?\d{3,4}-\d{7}) or (\d{3} \d{7}), see ([0-9a-f]{4}:[a-z0-9]{3}::[0-9a-f]{4}:\d\d:\d{4}) at 10:30:15\.", got[1])
    assert m and m[1] != "0171-2345678" and m[2] != "030 1234567" and m[3] != "2001:db8::ff00:42:8329"
    assert got[2].startswith("order 1234567890123 card 4") and "4111111111111111" not in got[2]
    # the distinct entities keep distinct surrogates, the same key the same ones
    again = {r.doc_id: r.text for r in pii.pseudonymised(texts_frame(spark, texts).repartition(3), "key").collect()}
    assert again == got


# 7
def test_decontamination_long_and_short_items_and_the_shuffled_path(spark):
    chance = random.Random(7)
    word = lambda: f"w{chance.randrange(10**6)}"
    items = [" ".join(word() for _ in range(n)) for n in (65, 129, 300, 7, 4, 1)]
    around = lambda t: " ".join([word() for _ in range(30)] + t.split() + [word() for _ in range(30)])
    w = [t.split() for t in items]
    docs = [around(" ".join(x)) for x in (w[0], w[1], w[2][40:210], w[3], w[4], w[5], w[0][-1:], w[1][50:90], w[2][118:150])] + [around("") for _ in range(5)]
    asked = texts_frame(spark, docs).withColumns({c: F.lit(1) for c in ("w", "b", "k", "at", "h", "item_id", "seg", "share")})
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "words", "step")})
    want = {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (7, 1), (8, 2)}
    for seeds in (decontaminate.BROADCAST_SEEDS, 3):
        got = decontaminate.overlaps(asked, bench, broadcast_seeds=seeds).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert {r.share for r in got if r.doc_id in (0, 1, 3, 4)} == {1.0}


# links
def _links_of(seed):
    chance = random.Random(seed)
    chain = [(i, i + 1) for i in range(900, 960)]
    star = [(500, i) for i in range(501, 540)]
    return [(b, a) if chance.random() < 0.5 else (a, b) for a, b in chain + star + [(7, 7), (-3, 8), (2**40, 8), (8, -3)] + [(chance.randrange(300), chance.randrange(300)) for _ in range(120)]]


def _smallest(links):
    label = {x: x for link in links for x in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components_of_few_and_many_links(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    links = _links_of(few)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.label for r in got} == _smallest(links)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_few_links_take_no_rounds(spark):
    links = spark.createDataFrame(_links_of(5), "a long, b long")
    spark.sparkContext.setJobGroup("few links", "")
    components.components(links)
    spark.sparkContext.setJobGroup("others", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 4


def test_readers_unpack_few_rows_at_once(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    try:
        spark.conf.unset(name)
        common.small_batches(spark)
        assert int(spark.conf.get(name)) == common.READ
        spark.conf.set(name, 100)
        common.small_batches(spark)
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.unset(name)


def test_written_tables_come_in_small_row_groups_without_a_marker(spark, monkeypatch):
    import os

    import pyarrow.parquet as pq

    monkeypatch.setattr(common, "ROW_GROUP", 1 << 20)
    rows = spark.range(0, 400_000, 1, 1).select("id", F.xxhash64("id").alias("h"))
    table = common.written(rows, "test")
    names = os.listdir(table._seedplane_path)
    assert "_SUCCESS" not in names
    (part,) = (n for n in names if n.endswith(".parquet"))
    assert pq.ParquetFile(f"{table._seedplane_path}/{part}").metadata.num_row_groups > 1
    assert table.count() == 400_000 and not table.exceptAll(rows).count()
    common.dropped(table)


def test_bpe_digests_of_one_pass_equal_those_of_two(spark):
    path = vocabulary()
    texts = ["", None, "two words", "a" * 3_000, "many words " * 900, "\u00e9\u4e2d " * 50, "two words"]
    df = texts_frame(spark, texts).repartition(3)
    once = bpe.digested(df, path, leaf=1000, long_chars=5_000)
    twice = bpe.with_digests(bpe.encoded(df, path, leaf=1000, long_chars=5_000), path)
    assert once.schema == twice.schema and once.count() == len(texts)
    assert not once.exceptAll(twice).count() and not twice.exceptAll(once).count()
    plan = bpe.digested(df, path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # run, deal, encode_leaves: no second one over them
