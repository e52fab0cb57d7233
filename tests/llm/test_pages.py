"""Operators on pages, vectors, licences and pieces."""

import hashlib
import os
import re
import struct
import tempfile

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from check import TABLES, compare
from sensorium.llm import licences, notices, partitions, pieces, queries, tagpaths, urls, warc
from sensorium.llm.base import Scratch
from tests.conftest import FOLDER
from tests.llm import plain_notices

QUOTED = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_their_sql(spark, con, name):
    text, _, _ = compare(spark, con, name, queries.QUERIES[name], queries.ORACLE[name], FOLDER)
    assert text.startswith("ok"), text


def test_archives_round_trip(spark):
    rows = [(1, "http://a/", QUOTED * 3 + "x"), (2, "http://b/", "é" * 900 + QUOTED * 40), (3, None, None), (4, "c", "a" * 1500), (5, "d", "a" * 1500), (5, "d", "a" * 1500)]
    rows += [(6, "u\r\nX: y", "WARC/1.0\r\n" * 500), (7, "v", ""), (None, "w", "z" * 1200), (8, "short", "q"), (9, "short", "q")]
    rows += [(400, "cut", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\n日本")]
    rows += [(10 + i, "h", QUOTED * (i % 9) + "t" * i * 20) for i in range(60)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, offset int")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/w"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        warc.write_archives(pages.repartition(2), path)
        got = warc.read_archives(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    raw = lambda h: (h or "").encode()
    want = sorted((str(i), hashlib.sha1(raw(h)).hexdigest(), len(raw(h))) for i, _, h in rows)
    assert sorted((str(r.id), r.digest, r.payload_bytes) for r in got) == want
    assert [(r.id, r.refers_to) for r in got if r.record_type == "revisit"] == [(4, 5)]
    texts = {}
    for i, _, h in rows:
        texts.setdefault(i, []).append(h or "")
    assert all(r.payload in texts[r.id] for r in got if r.record_type == "response")


def test_no_archives(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/w"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_chain_stops_at_a_gap(spark):
    from sensorium.llm.base import Scratch

    points = [("f", 0, 10), ("f", 10, 25), ("f", 15, 25), ("f", 25, None), ("f", 40, 50), ("g", 5, 9), ("g", 9, 20)]
    got = warc.reached(spark.createDataFrame(points, "file string, offset long, next long"), Scratch(spark)).collect()
    assert sorted((r.file, r.offset) for r in got) == [("f", 0), ("f", 10), ("f", 25)]


def test_main_text():
    page = """<html><head><title>t</title><style>p{}</style></head><body><div class="site-header"><a href=x>Home</a> nav</div>
    <div id=cookie-notice>We use cookies, and more. Accept, please, now.</div><div class=content><div class=post><h2>Title</h2>
    <p>First para, long enough, yes. It&nbsp;is &lt;good&gt; &eacute;.<p>Second one<br>broken <b>bold</b> end.<ul><li>one<li>two</ul>
    <pre>x  y\nz</pre></div><div class="comments"><p>Nice article, thanks a lot! I agree, really.</p></div></div>
    <div class=sidebar>Links, links.</div><form><p>Name <input> go</form><script>var t="</p>";</script></body>"""
    assert tagpaths.main_text(page) == "Title\n\nFirst para, long enough, yes. It is <good> é.\n\nSecond one broken bold end.\n\none\n\ntwo\n\nx y z"
    assert [tagpaths.main_text(x) for x in (None, "", "<p>", "plain", "<article><header><h1>H</h1></header><p>x</p><aside>no</aside></article>")] == ["", "", "", "plain", "H\n\nx"]
    assert tagpaths.main_text("<article>" + "<p>word, word.</p>" * 20_000 + "</article>").count("\n\n") == 19_999


PARAGRAPHS = "<p>First para, long enough, yes. It goes on, and on.</p><p>Second para, also long, with a stop.</p>"
SAID = "First para, long enough, yes. It goes on, and on.\n\nSecond para, also long, with a stop."


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "with-sidebar", "page-header-fixed", "post-with-comments", "sidebar"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_main_text_in_marked_wrappers(name, inner):
    page = f'<body><nav>x</nav><div class="{name}"><{inner}>{PARAGRAPHS}</{inner}><div class="ad">Buy now, please.</div></div><div id="sidebar">Links, links.</div></body>'
    assert tagpaths.main_text(page) == SAID


@pytest.mark.parametrize("name", ["related-work", "notice", "share", "tags"])
def test_content_of_articles_with_doubtful_names(name):
    more = "<p>Others did, before us, much the same. They found, too, what we find.</p>"
    page = f'<body><article>{PARAGRAPHS}<div class="{name}">{more}</div><div class="{name}"><a href="x">one</a> <a href="y">two</a></div><div class="ad">Buy now, please.</div></article></body>'
    assert tagpaths.main_text(page) == SAID + "\n\n" + more[3:-4]


LONG = "<p>This one says much, at length, and then it says more. It has its points, too.</p>" * 6
LONG_SAID = "\n\n".join([LONG[3 : LONG.index("</p>")]] * 6)


def test_paths_of_articles_meet_the_threshold():
    links = '<div class="x1"><ul><li><a href="a">One thing</a></li><li><a href="b">Another thing</a></li></ul></div>'
    note = '<div class="x2">Order today and save</div>'
    assert tagpaths.main_text(f"<body><article><h1>Title</h1>{LONG}{links}</article></body>") == "Title\n\n" + LONG_SAID
    assert tagpaths.main_text(f"<body><article><h1>Title</h1>{LONG}{links}{LONG}{note}</article></body>") == "Title\n\n" + LONG_SAID + "\n\n" + LONG_SAID
    # items of the text and short blocks between others stay
    kept = f"<body><article>{LONG}<ul><li>one</li></ul><div>See below</div>{LONG}<pre>x = 1</pre></article></body>"
    assert tagpaths.main_text(kept) == f"{LONG_SAID}\n\none\n\nSee below\n\n{LONG_SAID}\n\nx = 1"


def test_title_and_lead_beside_the_article():
    page = f"<body><main><h1>Title</h1><p>A lead, to begin with.</p><article>{LONG}</article><div>More of this kind</div></main></body>"
    assert tagpaths.main_text(page) == "Title\n\nA lead, to begin with.\n\n" + LONG_SAID


def test_failing_paths_do_not_come_back_with_the_body():
    page = f'<body><div class="top">Shop Cart Help</div><div><div>{LONG}</div></div><section>{LONG}</section><div class="low">All rights reserved</div></body>'
    assert tagpaths.main_text(page) == LONG_SAID + "\n\n" + LONG_SAID


def test_main_text_of_frames(spark):
    rows = [(1, "<article><p>a</p></article>", "clash"), (1, "<article><p>a</p></article>", "clash"), (2, None, "clash")]
    got = tagpaths.with_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, "a"), (1, "a"), (2, "")]


def test_url_rules_edges(spark):
    rows = [None, "", "nothing", "http://", "HTTP://WWW.Example.ORG/en/12?x", "x://example.org/es/", "x://notexample.org/es/", "x://a.com/fr/x", "x://com/de/", "x://free-bets.net", "x://free-bets.org/", "x://a.com/de/#/fr/"]
    pages = spark.createDataFrame([(k, u, "clash", "clash", "clash") for k, u in enumerate(rows)], "page_id int, url string, host string, rule string, token string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in urls.judge(pages, queries.URL_RULES + urls.DEFAULT_RULES).collect()}
    assert got[4] == ("www.example.org", "example.org/en/1", "block") and got[5][1] == "example.org/es/" and got[6] == ("notexample.org", "org/", "allow")
    assert got[7][1:] == ("com/fr/", "allow") and got[8][1:] == ("com/de/", "block") and got[9][1:] == (None, "block") and got[10][1:] == ("org/", "allow")
    assert got[11][1:] == ("com/de/", "block") and all(got[k] == ("", None, "allow") for k in range(4))
    assert urls.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_licence_inheritance(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/f.py", "text"), ("a/b/COPYING.txt", "Hi.\nLicensed under the Apache License, Version 2.0.\nBye"), ("a/x.py", None)]
    rows += [("a/y.py", "x\nThis work is licensed under the GNU General Public License, version 3. More."), ("z.py", ""), (None, "x"), ("LICENSEX/q", "licence of nothing at all"), ("a/x.py", None)]
    files = spark.createDataFrame([(p, t, "c", "c") for p, t in rows], "path string, text string, header string, licence string")
    got = sorted(((r.id, r.licence, r.origin) for r in licences.scan(files).collect()), key=str)
    want = [("a/LICENSE", "MIT", "header"), ("a/b/c/f.py", "Apache-2.0", "inherited"), ("a/b/COPYING.txt", "Apache-2.0", "header"), ("a/x.py", "MIT", "inherited"), ("a/x.py", "MIT", "inherited")]
    want += [("a/y.py", "GPL-3.0", "header"), ("z.py", None, "none"), (None, None, "none"), ("LICENSEX/q", None, "none")]
    assert got == sorted(want, key=str)
    assert licences.scan(files.limit(0)).count() == 0


MPL = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at http://mozilla.org/MPL/2.0/.\nimport x"
GO = "// Copyright 2009 The Go Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\npackage x"
GNU = "/*\n * Foo.\n * Copyright (C) 2020 Jane\n *\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU {}General Public License as published by\n * the Free Software Foundation, either version {} of the License, or\n * (at your option) any later version.\n */\nint x;"
NO_NOTICE = ["licence of nothing at all", "Copyright 2020 Jane Doe. All rights reserved.", "You need a driving license to drive.", "This file has no license.", "Contact us to buy a license. License: commercial"]


def test_real_notices(spark):
    want = {"SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "x\nLicensed under the MIT License.": "MIT", "MIT License": "MIT", MPL: "MPL-2.0", GO: "BSD-3-Clause"}
    want |= {GNU.format("", 3): "GPL-3.0", GNU.format("", 2): "GPL-2.0", GNU.format("Affero ", 3): "AGPL-3.0", GNU.format("Lesser ", 3): "LGPL-3.0", GNU.format("Lesser ", 2.1): "LGPL-2.1"}
    rows = [(f"f{k}/{k}.c", t) for k, t in enumerate([*want, *NO_NOTICE])]
    got = {r.path: (r.licence, r.origin) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[p] for p, _ in rows] == [(x, "header") for x in want.values()] + [(None, "none")] * len(NO_NOTICE)


def test_whole_licence_files(spark):
    # without its title a licence file is known by its bag of terms
    bsd = "Copyright (c) 2011, Someone Else\nAll rights reserved.\n\n" + notices.BSD_USE.replace(": 1.", ":\n\n1.") + "\n" + notices.BSD_END
    rows = [("bsd/LICENSE", bsd), ("bsd/src/x.py", "x")]
    for name in sorted(os.listdir(notices.FOLDER)):
        with open(os.path.join(notices.FOLDER, name)) as f:
            rows += [(f"{name[:-4]}/COPYING", "Copyright 2020 Jane Doe\n\n" + "\n".join(f.read().split("\n")[2:])), (f"{name[:-4]}/a/b.c", "int x;")]
    got = {r.path: (r.licence, r.origin) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got.pop("bsd/LICENSE") == ("BSD-2-Clause", "header") and got.pop("bsd/src/x.py") == ("BSD-2-Clause", "inherited")
    assert len(got) == 28 and all(x == p.split("/")[0] and o == ("header" if "COPYING" in p else "inherited") for p, (x, o) in got.items())


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(1)
    data = np.round(rng.standard_normal((1500, 16)), 2)
    data[700:1200] = data[5]
    rows = [(k, [float(x) for x in v], "c", 1) for k, v in enumerate(data)]
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (5004, [None] * 16), (None, [1.0] * 16), (5005, [float("inf")] * 16)]
    frame = spark.createDataFrame(rows + [(*b, "c", 1) for b in bad] + rows[:3], "vec_id long, embedding array<double>, key string, part int")
    got = partitions.search(frame, F.col("id") % 20 == 0, block=200).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 20):
        score = data @ data[q]
        order = [k for k in np.lexsort((np.arange(1500), -score)) if k != q][:20]
        hits += len({k for k, _ in found[q]} & set(order))
        assert len(found[q]) == 20 and all(abs(s - score[k]) < 1e-9 for k, s in found[q]) and [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True)
    assert hits >= 0.9 * 75 * 20 and set(found) == set(range(0, 1500, 20))
    assert [k for k, _ in found[700]][:3] == [5, 701, 702]
    assert partitions.search(frame.limit(0), F.col("id") % 20 == 0).count() == 0


TRICKY = ["", " ", "  a  b ", "▁▁a", "a▁b", "<s>x</s>", "　x", "Hello world, hello  world", "ünï😀日本\x00\n\t", "a " * 500, "<0x41>"]


def test_pieces_match_sentencepiece(spark):
    known = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in [*TRICKY, None]], "text string"))
    docs = pieces.with_pieces(docs.withColumn("ids", F.lit("clash")), queries.PIECE_MODEL)
    rows = docs.withColumn("back", pieces.decoded(docs, queries.PIECE_MODEL)).collect()
    assert all(r.ids == known.encode(r.text) and r.back == known.decode(r.ids) for r in rows if r.text is not None)
    assert [(r.ids, r.back) for r in rows if r.text is None] == [(None, None)]
    assert pieces.with_pieces(docs.limit(0), queries.PIECE_MODEL).count() == 0


def _message(number, value):
    size = lambda n: bytes([n & 127 | 128, n >> 7]) if n > 127 else bytes([n])
    if isinstance(value, int):
        return size(number << 3) + size(value)
    if isinstance(value, float):
        return size(number << 3 | 5) + struct.pack("<f", value)
    return size(number << 3 | 2) + size(len(value)) + value


@pytest.mark.parametrize("fewer", [0, 1])
def test_unigram_with_byte_fallback(fewer):
    table = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]
    table += [("▁a", -1.5, 1), ("▁", -2.0, 1), ("a", -2.5, 1), ("b", -2.7, 1), ("ab", -2.9, 1), ("▁ab", -4.0, 1), ("ba", -3.3, 1)]
    data = b"".join(_message(1, _message(1, p.encode()) + _message(2, s) + _message(3, k)) for p, s, k in table)
    data += _message(2, _message(3, 1) + _message(35, 1)) + _message(3, _message(1, b"identity") + _message(3, 1) + _message(4, fewer) + _message(5, 1))
    known = sentencepiece.SentencePieceProcessor(model_proto=data)
    own = pieces.build(pieces.parse(data))
    for text in ("ab", "a b  ab", "abba é b", " ab ", "bbb aab"):
        assert own.encode(text, add_special_tokens=False).ids == known.encode(text), text


def test_url_hosts_with_spaces_and_line_breaks(spark):
    urls_of = ["http://a b.example.org/es/x", "http://a\nb.example.org/es/x", "http://x casino.net/", "http://exampleXorg/es/", "http://net?.example.org/es/", "http://.org/"]
    pages = spark.createDataFrame(list(enumerate(urls_of)), "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, queries.URL_RULES + urls.DEFAULT_RULES).collect()}
    assert got == {0: ("example.org/es/", "block"), 1: ("example.org/es/", "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("org/", "allow")}


def test_notices_match_a_plain_version(spark):
    rng = np.random.default_rng(9)
    parts = ["# Copyright 2020 Someone", "// Licensed under the MIT License.", "Released under the Apache 2.0 license", "x = 1", "", "#", "* This program is free software: you can redistribute it and/or modify", "SPDX-License-Identifier: BSD-3-Clause-only",
             "// SPDX-License-Identifier: no-such", "All rights reserved.", "/* Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "it under the terms of the GNU General Public License as published by", "This is free and unencumbered software released into the public domain.", "see the license; or not. Licensed under CC BY-SA 4.0!"]
    texts = ["\n".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(60)] + ["license\n" * 300, "", "LICENSE"]
    rows = [(f"{'LICENSE-' if k % 5 == 0 else 'f'}{k}", t) for k, t in enumerate(texts)]
    known = notices.Notices()
    want = {p: plain_notices.find(known, t, p.startswith("LICENSE"), 0.3) if re.search("licen[sc]e|copyright|spdx|public domain", t.lower()) or p.startswith("LICENSE") else None for p, t in rows}
    files = spark.createDataFrame([(k, t, p.startswith("LICENSE")) for k, (p, t) in enumerate(rows)], "row long, text string, whole boolean").where("whole OR lower(text) RLIKE 'licen[sc]e|copyright|spdx|public domain'")
    got = {rows[r.row][0]: (r.licence, r.score) for r in licences.noticed(files, Scratch(spark), 0.3).collect()}
    assert got == {p: w for p, w in want.items() if w} and len(set(got.values())) > 5

