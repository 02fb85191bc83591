"""Language identification, URL filters, licences, the registry and the pipeline."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.llm import langid, licenses, queries, url_filter
from larkspur.session import ship

SF = "/root/testdata/sf0.001"


def test_languages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    models = langid.dictionaries(rows.where(~langid.held_out(rows.doc_id)))
    got = langid.identify(rows, models).join(rows, "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.9 * len(got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "12 !?", "en"), (None, "the thing", "en"), (4, "ß", None), (5, "½ ² Ⅷ ① 七"[:-2], "en")], "doc_id long, text string, score string")
    found = {r.doc_id: r for r in langid.identify(odd, models).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and found[i].rejected for i in (1, 2, 3, 5))
    assert found[None].lang_pred in dict(models) and 0 <= found[4].score <= 1
    assert {r.doc_id for r in langid.accepted(odd, models).collect()} <= {None, 4}
    assert langid.identify(odd, []).where("lang_pred = 'und'").count() == 6
    assert langid.dictionaries(rows.limit(0)) == []


def test_cascade_is_exact(spark):
    keys = [f"host{i}.example" for i in range(3000)]
    for step, shard_bits in ((7, url_filter.SHARD_BITS), (7, 1024), (500, url_filter.SHARD_BITS)):  # one shard, many, few listed keys
        listed = set(keys[::step])
        universe = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean")
        found = url_filter.cascade(universe, shard_bits)
        assert (found.shards > 2) == (shard_bits == 1024)
        judged = url_filter.with_membership(universe, "key", found, "hit")
        assert judged.count() == 3000 and judged.where("hit <> listed").count() == 0
        assert len(found.levels) >= 2 or step == 500
        assert sum(x.bits for x in found.levels) <= 64 * len(listed) * 1.5 + 64 * 5 * found.shards  # bounded by the listed keys, whatever the universe
    assert url_filter.cascade(universe.where("not listed")).levels == []


def test_url_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Bad.Example.NET:80?q", "http://bad.example.net/de/8", "http://x.example.com/en/7", "http://com/en/", "http://notcom/en/", "http://ok.org/es#x", "http://good.example.org/en/1", "http://me:pw@bad.example.net./x", "http://bad.example.net.evil.org/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[6], "h")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("Bad.example.net",), (None,)], "key string")
    for bits in (url_filter.SHARD_BITS, 8):  # one shard, several
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, queries.URL_RULES, listed, bits).collect()}
        assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
        assert got[4] == ("a.bad.example.net:80", "", None, "block")
        assert got[11] == ("me:pw@bad.example.net.", "/x", None, "block") and got[12][2:] == (None, "allow")
        assert got[5] == ("bad.example.net", "/de/8", "example.net/de/8", "block")
        assert got[6] == got[None] == ("x.example.com", "/en/7", "example.com/en/7", "allow")
        assert got[7][2:] == ("com/en/", "block") and got[8][2:] == (None, "allow") and got[9][1:] == ("/es", None, "allow")
    assert url_filter.judge(pages.limit(0), queries.URL_RULES, listed).count() == 0
    assert url_filter.judge(pages, queries.URL_RULES, listed.limit(0)).count() == 14


def test_queries_run_whole(spark):
    """Each query over the smallest tables: one row a document or page where the contract says so."""
    ship(spark)
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet").count(), spark.read.parquet(f"{SF}/pages.parquet").count()
    found = {re.match(r"op(\d+)_", n)[1]: f(spark, SF) for n, f in queries.queries().items()}
    assert all(found[n].count() == pages for n in ("1", "9"))
    assert all(found[n].count() == docs for n in ("4", "5", "6", "7", "8", "10"))
    assert all(found[n].select("doc_id").distinct().count() == docs for n in ("3", "11")) and found["2"].count() > 0
    assert found["12"].count() == spark.read.parquet(f"{SF}/embeddings.parquet").count() and found["13"].count() > 0
    held = found["6"].where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert held.where("lang_pred = lang").count() > 0.9 * held.count()


def test_listed_hosts_occur(spark):
    rows = queries.op9_bloom_cascade(spark, "/root/testdata/sf0.1").collect()
    spam = [r for r in rows if r.rule is None and re.search("casino-win|free-bets|spam-farm|adult-x|cheap-pills|ads-track", r.host)]
    assert len(spam) > 40 and {r.verdict for r in spam} == {"block"}
    names = spark.createDataFrame([(h, any(h == x or h.endswith(f".{x}") for x in queries.URL_LIST)) for h in {r.host for r in rows}], "key string, listed boolean")
    assert len(url_filter.cascade(names).levels) >= 1


def brute_licenses(units):
    tokens = lambda t: [x for x in (re.sub(r"^[.+-]+|[.+-]+$", "", w) for w in re.split(r"[^\w.+-]+|_", t.lower())) if x]
    docs = [Counter(tokens(u)) for u in units]
    decide = [set(c) | {f"={v}" for v in re.findall(licenses.BOUND, " ".join(tokens(u)))} for u, c in zip(units, docs, strict=True)]
    templates = [(k, Counter(tokens(t))) for k, texts in licenses.TEMPLATES.items() for t in texts]
    df = Counter(w for c in docs + [c for _, c in templates] for w in c)
    idf = {w: math.log((1 + len(docs) + len(templates)) / (1 + n)) + 1 for w, n in df.items()}
    norm = lambda c: math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
    out = []
    for c, has in zip(docs, decide, strict=True):
        fits = lambda k: all(set(g) & has for g in licenses.DECISIVE[k][0]) and not set(licenses.DECISIVE[k][1]) & has  # noqa: E731, B023
        score = lambda k, t: (fits(k) and round(sum(n * c[w] * idf[w] ** 2 for w, n in t.items()) / norm(t) / norm(c), 6), k)  # noqa: E731, B023
        top = max(score(k, t)[0] for k, t in templates)
        out.append((top, min(k for k, t in templates if score(k, t)[0] == top)))
    return out


def test_licenses_equal_brute_force(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License", "Copyright 2020 Foo. Released under the MIT License.", "a license to kill", "This work is licensed under the GNU General Public License, version 3."]
    files = [(i, f"a/b/{i}.txt", f"x\n{line}\ny", 1) for i, line in enumerate(lines)]
    rows = [*files, (10, "a/LICENSE", "Released under the MIT License.", 1), (11, "a/b/c/d.txt", "nothing", 1), (12, "z/e.txt", None, 1), (13, None, "", 1), (11, "a/b/c/d.txt", "nothing", 1)]
    table = spark.createDataFrame(rows, "doc_id long, path string, text string, license int")
    got = {r.doc_id: r for r in licenses.scan(table).collect()}
    want = brute_licenses([*lines, *[rows[5][2]] * 3])  # a licence file counts as a whole, by its paragraphs and by its lines
    for i in range(len(lines)):
        score, name = want[i]
        if score >= licenses.MIN_COSINE:
            assert (got[i].license, got[i].origin) == (name, "own") and abs(got[i].cosine - score) < 1e-5
        else:
            assert (got[i].license, got[i].origin, got[i].licence_file) == ("MIT", "inherited", "a/LICENSE")
    assert got[11].origin == "inherited" and got[12].origin == got[13].origin == "none"
    assert licenses.scan(table).count() == len(rows) and licenses.scan(table.limit(0)).count() == 0


def test_neighbouring_licences_are_told_apart(spark):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    said = {
        gpl.format("", 2): "GPL-2.0",
        gpl.format("", 3): "GPL-3.0",
        gpl.format("Affero", 3): "AGPL-3.0",
        gpl.format("Lesser", "2.1"): "LGPL-2.1",
        "Licensed under the Apache License, Version 1.1.": "Apache-1.1",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
        "// SPDX-License-Identifier: ISC": "ISC",
        "SPDX-License-Identifier: Unheard-Of": None,
        "a license to kill": None,
    }
    files = [(i, f"p{i}/f.txt", f"x\n{t}\ny") for i, t in enumerate(said)]
    full = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\nPreamble\n\n" + "The license is a free, copyleft one for software.\n\n" * 30
    files += [(90, None, "x\nReleased under the MIT License."), (91, None, "plain text"), (92, "q/COPYING", full), (93, "q/a/b.c", "int x;")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert [got[i].license for i in range(len(said))] == list(said.values())
    assert (got[90].license, got[90].origin) == ("MIT", "own") and (got[91].license, got[91].origin) == (None, "none")
    assert (got[92].license, got[93].license, got[93].origin, got[93].licence_file) == ("GPL-3.0", "GPL-3.0", "inherited", "q/COPYING")


def test_lines_that_offer_several_licences(spark):
    said = {
        "Licensed under MIT or Apache License, Version 2.0, at your option.": "Apache-2.0,MIT",
        "GPL version 2 or version 3": "GPL-2.0,GPL-3.0",
        "Licensed under the GNU General Public License, version 2 or 3.": "GPL-2.0,GPL-3.0",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
        "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */": "BSD-3-Clause,GPL-2.0",
        "SPDX-License-Identifier: LGPL-2.1+ or later text": "LGPL-2.1",
        "This project is licensed under the Apache License, Version 2.0 and the MIT License.": "Apache-2.0,MIT",
        "Dual licensed under MIT/Apache-2.0": "Apache-2.0,MIT",
        "Licence: BSD-3-Clause or LGPL-3.0": "BSD-3-Clause,LGPL-3.0",
        "Released under the MIT License, or later.": "MIT",
        "Copyright (c) by Mit and Apache, two dogs": None,
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL-2.0",
    }
    # The same files, one of them twice, and under a directory that offers two licences.
    files = [(i, f"p{i}/f.txt", f"x\n{t}\ny") for i, t in enumerate(said)]
    abridged = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\n2. Basic Permissions.\n\nAll rights granted under this License are granted for the term of copyright.\n"
    files += [files[0], (50, "q/LICENSE", abridged), (60, "r/LICENSE.md", f"x\n{next(iter(said))}\n"), (61, "r/a/b.c", "int x;"), (62, "r/a/c.c", None)]
    rows = licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()
    got = {r.doc_id: r.licenses and ",".join(r.licenses) for r in rows}
    assert [got[i] for i in range(len(said))] == list(said.values())
    assert len(rows) == len(files) and all(r.license is None if r.licenses is None else r.license in r.licenses for r in rows)
    assert got[50] == "GPL-3.0" and got[60] == got[61] == got[62] == "Apache-2.0,MIT"


def test_a_very_long_line_of_names_is_one_pass(spark):
    text = "License: " + "mit or apache, " * 200_000
    row = licenses.scan(spark.createDataFrame([(1, "a/b", text), (2, "a/c", " " * 500_000 + "licensed under MIT"), (3, "a/d", "1. " * 200_000)], "doc_id long, path string, text string")).orderBy("doc_id").collect()
    assert [r.doc_id for r in row] == [1, 2, 3] and row[1].license == "MIT" and row[2].origin == "none"


def test_registry(spark):
    names = queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from larkspur.llm import decontaminate, pii, simhash

    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    models = tuple(langid.dictionaries(docs.where(~langid.held_out(docs.doc_id))))
    keep = {i for i, t in texts.items() if langid.classify(t, models)[1] >= langid.MIN_MARGIN}
    fps = {i: simhash.fingerprint(texts[i]) % 2**64 for i in keep}
    group = {i: i for i in sorted(keep)}
    find = lambda x: x if group[x] == x else find(group[x])
    words = {i: (texts[i] or "").lower().split() for i in keep}
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    alike = lambda x, y: bool(x) and 5 * len(x & y) >= 4 * len(x | y)
    for i in sorted(keep):
        for j in sorted(keep):
            if i < j and ((fps[i] ^ fps[j]).bit_count() <= 2 or alike(grams[i], grams[j])):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    assert any(alike(grams[i], grams[j]) and (fps[i] ^ fps[j]).bit_count() > 2 for i in keep for j in keep)
    keep = {i for i in keep if find(i) == i}
    leaks = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    keep -= leaks
    got = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == keep
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
    rows = docs
    for name, stage in pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns, name
    for r in rows.collect():
        assert r.text == pii.mask(texts[r.doc_id], pii.find(texts[r.doc_id])[1]) and r.n_chars == len(r.text)
