"""License scans, URL cascade, line frequency."""

import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from wordloom.llm.license_scan import KNOWN_TEXTS, canonical, canonical_lines, digest, known_digests, license_scan, licenses_in
from wordloom.llm.line_frequency import LineRules, line_frequency
from wordloom.llm.url_cascade import BloomCascade, judge_urls


def test_licenses(spark):
    mit = KNOWN_TEXTS[0][1]
    odd = "# Copyright (c) 2021 Some One\n\n" + mit.replace("license", "licence").upper().replace(",", " ;")
    rows = [(1, mit), (2, odd), (3, "words\nReleased under the MIT License.\nwords"), (4, None), (5, ""), (6, mit + " extra"), (None, mit), (1, mit), (7, "Licensed under CC BY-NC 4.0. " * 30_000)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, digest string, license_id string")
    got = sorted(((r.doc_id, r.license_id, tuple(r.notice_ids)) for r in license_scan(docs).collect()), key=repr)
    want = [(1, "MIT", ()), (1, "MIT", ()), (2, "MIT", ()), (3, None, ("MIT",)), (4, None, ()), (5, None, ()), (6, None, ()), (7, None, ()), (None, "MIT", ())]
    assert got == sorted(want, key=repr)
    assert license_scan(docs.where("false")).count() == 0


def test_notices_of_any_words(spark):
    bsd = next(body for name, body in KNOWN_TEXTS if name == "BSD-2-Clause" and "license" not in body.lower())
    rows = [(1, "x = 1\n/*! " + " ".join(bsd.split()) + " */\ny = 2"), (2, "a\n-- Use it as you like! --\n\n-- --\nb"), (3, "use it as you like, all of you")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.notice_ids for r in license_scan(docs).collect()} == {1: ["BSD-2-Clause"], 2: [], 3: []}
    own = spark.createDataFrame([("Use it as you like",)], "body string").select(digest(F.col("body")).alias("digest"), F.lit("own").alias("license_id"))
    assert {r.doc_id: r.notice_ids for r in license_scan(docs, own).collect()} == {1: [], 2: ["own"], 3: []}


def test_licenses_of_a_folder(spark, tmp_path):
    text = "Fair Licence, version 2.0\n\n  1. Usage of the works is permitted,\n  provided that this instrument is retained.\n"
    (tmp_path / "Fair-2.0.txt").write_text(text)
    (tmp_path / "Zebra").write_text(text.upper())
    (tmp_path / "Other-1.md").write_text("Other words")
    known = licenses_in(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "// Copyright 2020 me\n" + " ".join(text.split())), (2, "x\nother, words!\ny")], "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.notice_ids) for r in license_scan(docs, known.unionByName(known_digests(spark))).collect()}
    assert got == {1: ("Fair-2.0", ["Fair-2.0"]), 2: (None, ["Other-1"])}
    assert known.count() == 2


def test_lines_of_one_pass_equal_single_lines(spark):
    text = "Sub\nLicence, sub  licence\r\n(c) 2020 me\r\n * Copyright 2020 you\nhttps\n://x\n\n  \nnon\tcommercial\u2028favour \r\u00a9 they\nAll rights reserved\nend per cent"
    got = spark.createDataFrame([(text,)], "text string").select(canonical_lines(F.col("text"))).first()[0]
    one = spark.createDataFrame([(x,) for x in text.split("\n")], "text string").select(canonical(F.col("text"))).collect()
    assert sorted(got) == sorted({x for (x,) in one} - {""})


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
URLS = [None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://WWW.A.NET/x?y#z", "https://www.example.net/en/1", "https://badexample.net/en/", "http://example.com/de/?q", "http://example.com/de", "x://b.org/fr/a://c/d", "http://org/fr/", "http://h?/net/", "http://a.net//", "http://é.net/ü", "http://a.net/" + "p/" * 20_000]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(None, URLS[6], "h", "r"), (6, URLS[6], "h", "r")], "page_id long, url string, host string, rule string")
    block, allow = [r for r, a in RULES.items() if a == "block"], [r for r, a in RULES.items() if a == "allow"]
    for bits in (1 << 20, 1):  # one cascade a list, then cascades over parts of the keys
        got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, block, allow, max_bits=bits).collect()), key=repr)
        want = [(i, *plain.judged(u, RULES)) for i, u in enumerate(URLS)] + [(None, *plain.judged(URLS[6], RULES)), (6, *plain.judged(URLS[6], RULES))]
        assert got == sorted(want, key=repr)
    assert judge_urls(pages.where("false"), block, allow).count() == 0
    assert {r.verdict for r in judge_urls(pages, [], []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("key like '%7'")
    cascade = BloomCascade.build(listed, universe.unionByName(universe))
    assert len(cascade.levels) > 2
    wrong = universe.where(cascade.contains(F.col("key")) != F.col("key").endswith("7"))
    assert wrong.count() == 0
    with pytest.raises(OverflowError):
        BloomCascade.build(listed, universe, max_bits=64)


def test_line_frequency(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "a", f"{body} {i}\nCommon  Line here {i}\n\nown {i} line\nown {i} line") for i in range(30)]
    rows += [(100 + i, "a", "\n".join(["Common line here 5"] * 30 + [f"some words of its own {i}"])) for i in range(3)]
    rows += [(200, "b", "Common line here 1\n" + body), (201, None, body), (202, "a", None), (203, "a", ""), (204, "a", " \n\t "), (None, "a", body), (200, "b", "Common line here 1\n" + body)]
    rows += [(300, "c", "a b c " * 20_000), (301, "c", "x #*$%&|<> é\u00a0z y"), (302, "c", " ".join(f"q{i}" for i in range(50)) + " q0 q1 q2 q3")]
    docs = spark.createDataFrame([(*r, True, 5) for r in rows], "doc_id long, source string, text string, kept boolean, n_words int")
    got = sorted((tuple(r)[:8] for r in line_frequency(docs, LineRules(min_docs=10)).collect()), key=repr)
    assert got == sorted(plain.line_verdicts(rows, min_docs=10), key=repr)
    assert any(g[7] for g in got) and not all(g[7] for g in got)
    assert line_frequency(docs.where("false")).count() == 0
