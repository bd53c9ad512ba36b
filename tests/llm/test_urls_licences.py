import random

from collatio.llm import license_scan as L
from collatio.llm import url_filter as U

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return host.translate(LOWER), tail[:end]


def judged(url, rules):
    host, path = parts(url)
    fit = [r for r in rules if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    return (host, path, best and best[0] + best[1], best[2] if best else "allow")


def test_judge(spark):
    rng = random.Random(6)
    hosts = ["com", "example.com", "EXAMPLE.com", "www.example.com", "badexample.com", "m.www.example.com", "a.net", "net", "x.org", "ünï.net", "a..net", ""]
    paths = ["", "/", "/en", "/en/", "/en/a", "/EN/", "/es/1?q#f", "/fr/", "?x=/en/", "#/en/", "/fr/a://b"]
    urls = [rng.choice(["http", "HTTPS", ""]) + rng.choice(["://", ":/", "://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(400)] + [None, "", "://", "a\n://com/\n/"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://a.net/fr/", "h"), (1, urls[1], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame(U.QUERY_RULES + [("com", "/", "allow")], "host string, path string, verdict string")
    got = sorted((tuple(r) for r in U.judge(pages, rules).collect()), key=str)
    assert got == sorted(((i, *judged(u, U.QUERY_RULES)) for i, u, _ in rows), key=str)


def test_many_rules_and_none(spark):
    listed = [(f"h{i}.com", f"/{i % 5}/", "block") for i in range(3000)] + [("h1.com", "/1/", "allow")]
    pages = spark.createDataFrame([(i, f"http://w.h{i}.com/{i % 7}/x") for i in range(500)], "page_id long, url string")
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    got = sorted((tuple(r) for r in U.judge(pages, rules).collect()), key=str)
    assert got == sorted(((r.page_id, *judged(r.url, listed)) for r in pages.collect()), key=str)
    assert {r.verdict for r in U.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert U.judge(pages.limit(0), rules).count() == 0


def test_hosts_of_many_labels_and_hot_urls(spark, monkeypatch):
    from collatio.llm import common

    monkeypatch.setattr(common, "HOT_PARTS", 5)
    urls = ["http://" + "." * 100_000 + "net/fr/", "http://" + "a." * 50_000 + "example.com/en/"] + ["http://x.com/1"] * 40 + [None] * 40 + ["http://b.net/es/2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(U.QUERY_RULES, "host string, path string, verdict string")
    got = sorted(tuple(r) for r in U.judge(pages, rules).collect())
    assert got == [(i, *judged(u, U.QUERY_RULES)) for i, u in enumerate(urls)]


def test_bloom_has_no_false_negative():
    bloom = U.BlockedBloom.empty(64)
    forms = [f"f{i}".encode() for i in range(1000)]
    bloom.add(forms)
    assert bloom.test(forms).all()
    assert bloom.test([f"g{i}".encode() for i in range(1000)]).mean() < 0.2


MIT = ". ".join(s.capitalize() for i, s in L.SENTENCES if i in (10, 11, 12))


def test_licences(spark):
    rows = [
        (1, "Text. Released under the MIT License.\nMore", "3", "mit-line", "MIT"),
        (2, f"Lead.\n{MIT}.", "10,11,12", "mit-text", "MIT"),
        (3, "Licensed under CC BY-NC 4.0.\n\nRELEASED under the -- mit licence", "2", "cc-by-nc-line", "CC-BY-NC-4.0"),
        (4, None, "", "", ""),
        (5, "", "", "", ""),
        (6, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "11", "", ""),
        (7, "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: MIT", "4,50", "apache-line,mit-spdx", "Apache-2.0,MIT"),
        (None, "Licensed under the Apache License, Version 2.0", "4", "apache-line", "Apache-2.0"),
        (7, "x" * 100_000 + ". Released under the MIT License!", "3", "mit-line", "MIT"),
    ]
    docs = spark.createDataFrame([(i, t, "r") for i, t, *_ in rows], "doc_id long, text string, rules string")
    got = sorted((tuple(r) for r in L.scan(docs).collect()), key=str)
    assert got == sorted(((i, a, b, c, bool(b)) for i, _, a, b, c in rows), key=str)
    assert L.scan(docs.limit(0)).count() == 0


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
MPL = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n"


def test_usual_layouts_and_both_of_two_licences(spark):
    """A licence that is part of another counts where it stands by itself; rows as in the SQL."""
    import duckdb

    texts = [
        (BSD, "bsd-2-text", "BSD-2-Clause"),
        (BSD + THIRD, "bsd-3-text", "BSD-3-Clause"),
        (BSD + THIRD + "\nOther files:\n\n" + BSD, "bsd-3-text,bsd-2-text", "BSD-2-Clause,BSD-3-Clause"),
        (BSD.replace("1.", "(a)").replace("2.", "b)"), "bsd-2-text", "BSD-2-Clause"),
        (BSD.replace("1.", "*").replace("2.", "*"), "bsd-2-text", "BSD-2-Clause"),
        (GPL, "gpl-3-notice", "GPL-3.0-or-later"),
        ("// " + GPL.replace("\n", "\n// "), "gpl-3-notice", "GPL-3.0-or-later"),
        (MPL, "mpl-2-notice", "MPL-2.0"),
        ("Released under the MIT License\r\nReleased under the MIT License; SPDX-License-Identifier: CC0-1.0", "mit-line,mit-line,cc0-1.0-spdx", "CC0-1.0,MIT"),
        ("licensed under a license that nobody knows", "", ""),
        ("\u212ailled. Licensed under the ISC License\u0085 x", "", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(texts)], "doc_id long, text string")
    got = [tuple(r) for r in L.scan(docs).orderBy("doc_id").collect()]
    assert [(r[2], r[3]) for r in got] == [(a, b) for _, a, b in texts]
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    assert db.sql(L.ORACLE_SQL + " ORDER BY doc_id").fetchall() == got


def test_words_tell_every_sentence():
    words = L.telling_words(L.SENTENCES)
    assert all(any(w in s for w in words) for _, s in L.SENTENCES) and min(map(len, words)) >= 7


def test_wrapped_notices(spark):
    import textwrap

    mit = [next(s for i, s in L.SENTENCES if i == k).capitalize() for k in (10, 11, 12)]
    wrapped = f"MIT License\n\nCopyright (c) 2024 X\n\n{textwrap.fill(mit[0], 70)}:\n\n{textwrap.fill(mit[1] + '.', 70)}\n\n{textwrap.fill(mit[2] + '.', 70)}"
    head = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at'
    apache = head + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law"
    texts = [wrapped, wrapped.replace("\n", "\r\n"), textwrap.indent(wrapped, "# ", lambda x: True), apache, textwrap.indent(apache, " * ", lambda x: True), " ".join(apache.split("\n\nUnless")[0].split())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.identifiers, r.rules) for r in L.scan(docs).orderBy("doc_id").collect()]
    assert got == [("10,11,12", "mit-text")] * 3 + [("20,21,22", "apache-notice")] * 3
