"""Comments and teasers in pages, mixes on other partitions, notices in other words."""

import numpy as np
import pytest

from scarpline.llm import license_scan, mixing, token_files
from scarpline.llm.common import n_words, rows_per_batch, trimmed
from scarpline.llm.html_text import difference, lines


def main_text(html):
    return difference(lines(html), None)[0]


def test_comments_and_teasers_go_with_their_articles():
    article = "<article><h1>Title</h1><p>The story.</p>{}</article>"
    comments = '<section class="comments"><h2>2 Comments</h2><article class="c1"><p>First!</p></article><article><p>Me too.</p></article></section>'
    teaser = '<aside class="sidebar"><h3>More</h3><article class="teaser"><p>Another story.</p></article></aside>'
    assert main_text(article.format(comments)) == "Title\nThe story."
    assert main_text(article.format("") + comments) == "Title\nThe story."
    assert main_text(f"<body>{teaser}<main>{article.format('')}</main>{teaser}</body>") == "Title\nThe story."
    assert main_text(f"<nav><article><p>Menu.</p></article></nav>{article.format('')}") == "Title\nThe story."
    assert main_text(article.format('<div class="related"><article><p>Related.</p></article></div>')) == "Title\nThe story."
    assert main_text(article.format('<div id="comments"><div class="menu"><article><p>Mine.</p></article></div></div>')) == "Title\nThe story."
    # A frame around the only article is none of these.
    assert main_text(f'<div class="widget"><div id="menu">{article.format("")}</div></div>') == "Title\nThe story."


def test_mixes_agree_on_other_partitions(spark):
    rows = [(i % 7, f"w{i} w{i} end", "ab"[i % 2]) for i in range(60)] + [(None, f"n{i} x y", None) for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixes = []
    for parts in (1, 3, 11):
        for order in ("text", "source"):
            got = mixing.mixed_rows(table.repartition(parts).sortWithinPartitions(order), n_words(table["text"]), weights=(1, 9, 4))
            mixes.append(sorted(map(repr, got.collect())))
    assert all(m == mixes[0] for m in mixes) and 0 < len(set(mixes[0])) < 69


def test_notices_in_other_words():
    """Notices that no template was chosen by: nine of ten are found as their license, and prose gives none."""
    said = [
        ("Released under MIT License.", "MIT"), ("Distributed under the MIT License.", "MIT"), ("This project is licensed under the MIT License", "MIT"), ("Published under the MIT license, see LICENSE.", "MIT"), ("SPDX-License-Identifier: MIT", "MIT"),
        ("Licensed under the Apache License 2.0.", "Apache"), ("Released under the Apache License, Version 2.0", "Apache"), ("// SPDX-License-Identifier: Apache-2.0", "Apache"), ("Made available under the Apache License, version 2.0.", "Apache"),
        ("Licensed under the GNU General Public License, version 3.", "GPL-3"), ("This work is released under the GNU General Public License, version 3", "GPL-3"), ("Distributed under the GNU General Public License, version 2.", "GPL-2"),
        ("Released under CC BY-SA 4.0", "CC-BY-SA"), ("Published under CC BY 4.0.", "CC-BY-4"), ("Text is licensed under CC BY-NC 4.0", "CC-BY-NC"), ("Licensed under the Mozilla Public License 2.0", "MPL"),
        ("This software is released under the BSD 3-Clause License", "BSD-3"), ("Licensed under the BSD 2-Clause License", "BSD-2"), ("Licensed under the GNU Affero General Public License version 3", "AGPL"), ("Made available under the CC BY-SA 4.0.", "CC-BY-SA"),
    ]
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.1)
    found = [{f[0] for f in scanner.text(f"Some words before it. {t} And some behind.")} for t, _ in said]
    right = sum(bool(f) and all(x.startswith(name) for x in f) for f, (_, name) in zip(found, said, strict=True))
    assert right >= 0.9 * len(said)
    for t in ("Permit under the license of MIT", "under the MIT umbrella", "Das Buch ist mit der Version unter dem Titel", "He was licensed to drive under the general rule, version 3", "The public license of the Apache tribe"):
        assert scanner.text(t) == []


def test_rank_decides_what_is_confirmed():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.1)
    scanner._wins = lambda *a: False
    assert scanner.text("Released under the MIT License.") == []


def test_tokens_of_texts_larger_than_a_batch(spark):
    """Texts are cut into batches by size; one that is larger than a batch stays whole, and columns of clashing names do no harm."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    rows = [(i, " ".join(f"word{i}-{j} The café," for j in range(n)), [str(i)], {"n": i}) for i, n in enumerate((3, 4000, 0, 1, 900, 1, 1))] + [(7, None, None, None), (7, "twice", [], {})]
    table = spark.createDataFrame(rows, "doc_id int, text string, ids array<string>, n_tokens map<string,int>").coalesce(1)
    whole = Tokenizer.from_file(path)
    want = sorted((i, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in rows)
    for size, few in ((2000, 2), (50, 1), (10_000_000, 1000)):
        with rows_per_batch(spark, few):
            got = token_files.tokenize(table, path, 2, batch_bytes=size).collect()
        assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u2").tolist()) for r in got) == want
        assert all(len(r["ids"]) == 2 * r["n_tokens"] for r in got)


def test_batch_size_is_put_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), rows_per_batch(spark, 3):
        assert spark.conf.get(key) == "3"
        raise ValueError
    assert spark.conf.get(key) == before
    assert list(trimmed(iter)([1, 2])) == [1, 2]
