"""Each operator against brute force, on texts that hold nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from scarpline.llm import decontaminate, html_text, jaccard_join, license_scan, mixing, quality, rans, sharding, substring_dedup, token_files, warc
from scarpline.llm.automaton import SuffixAutomaton, spans
from scarpline.llm.common import n_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rest string, shard string"


def corpus():
    """(doc_id, text): prose of few words, near copies, shared passages, odd texts."""
    dice = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["The", "the,", "é x", "中文", "don't", "###"]
    prose = lambda n: " ".join(dice.choice(words) for _ in range(n))
    texts = [prose(dice.randrange(20, 200)) for _ in range(40)]
    passage = prose(60)
    for i in range(12):
        base = texts[i].split(" ")
        base[len(base) // 2] = "changed"
        texts.append(" ".join(base))
        texts.append(f"{prose(30)}\n{passage}\t{prose(20)}")
    texts += [texts[3], texts[3], "", "   \n\t", None, "one", "one two three", "One TWO three", "a\x01b <|endoftext|> <|ENDOFTEXT|>", prose(5000), "x " * 300]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or ""), "k", "r", "s") for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


# --- 1 ---


def test_rans_round_trip():
    dice = np.random.default_rng(1)
    for n in (1, 31, 33, 8192, 8193, 40_000, 70_001):
        x = np.minimum(dice.geometric(0.01, n), 3000).astype(np.uint32)
        t = rans.Tables(rans.quantised(np.bincount(x)))
        blocks = rans.encode(x, t)
        assert (np.concatenate(rans.decode(blocks, t)) == x).all()
        last = x[: rans.BLOCK]
        k = (len(last) - 1) // (rans.CHECK * rans.LANES)
        assert (rans.part(blocks[0], k, t) == last[k * rans.CHECK * rans.LANES :]).all()
    broken = bytearray(blocks[0])
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        rans.decode([bytes(broken)], t)
    same = np.zeros(100, np.uint32)
    t = rans.Tables(rans.quantised(np.array([100, 0])))
    assert (rans.decode(rans.encode(same, t), t)[0] == 0).all()


def test_crc32_joined():
    for n in (0, 1, 5, 1000):
        a, b = os.urandom(20), os.urandom(n)
        assert token_files.crc32_joined(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


@cache
def whole_text_tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoded(path, text):
    return whole_text_tokenizer(path).encode(text or "", add_special_tokens=False).ids + [2]


def test_token_files(spark, docs, empty, tokenizer, tmp_path):
    folder = f"file://{tmp_path}/t"
    token_files.encode_corpus(docs.unionByName(docs.where("doc_id in (1, 9)")), folder, tokenizer, 2, shard_tokens=3000)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.documents(spark, folder).collect())
    start, expected = 0, []
    for i, t in sorted(corpus() + [corpus()[1], corpus()[9]], key=lambda r: r[0]):
        ids = encoded(tokenizer, t)
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    pieces = token_files.decode_pieces(spark, folder, with_ids=True).where("doc_id = 0").orderBy("piece").collect()
    assert np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist() == encoded(tokenizer, corpus()[0][1])
    token_files.encode_corpus(empty, f"{folder}0", tokenizer, 2)
    assert token_files.documents(spark, f"{folder}0").count() == 0


def test_decomposed_accents(tokenizer):
    texts = ["cafe\u0301, voila\u0300. nin\u0303 CAFE\u0301! x\u030c; \u0915\u093f, J\u030c. e\u0301\u0323) a\u0301b\u0301? \u0301x", "\u1100\u1161\u11a8. o\u0302\u0301... n\u0303\u0303-", "m\u00b2, \u0391\u0301. \u212b! A\u030a!"]
    dice = random.Random(3)
    texts += ["".join(dice.choice("aEn\u03b1 ,.(\u0301\u0303\u0323\u030c\u00e9\u0915\u093c\u4e2d3_'\n") for _ in range(200)) for _ in range(50)]
    found = token_files.WordTokenizer(tokenizer)
    assert found.by_word
    assert_same_ids(found, texts, tokenizer)


def assert_same_ids(found, texts, tokenizer):
    ids, sizes = found.encode(pa.array(texts, pa.string()), 2)
    for text, part in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert part.tolist() == encoded(tokenizer, text)


def test_random_unicode_words(tokenizer):
    dice = random.Random(5)
    pools = ["abcXYZ", "\u00e9\u00c9\u00fc\u00df\u0131\u0130\u017f\u0149\u00ff\u0178\u0132", "\u0301\u0300\u0338\u0307\u0323\u093c\u093f\u0903", "'.,;-_<>|!#", "0123\u0663\u00b2\u00bd", "\u4e2d\u65e5\ud55c\uae00\u03a3\u03c2\u03c3\u0410\u0915\u0958\u212b\u1e9b", " \t\r\x0b\x1c\x85\u00a0\u200b\u3000\ufeff", "\x01\x00\x7f", "\U0001d400\U0001f600"]
    word = lambda: "".join(dice.choice(dice.choice(pools)) for _ in range(dice.randint(0, 7)))
    texts = [dice.choice([" ", "\n", "  "]).join(word() for _ in range(dice.randint(0, 12))) for _ in range(3000)]
    assert_same_ids(token_files.WordTokenizer(tokenizer), [*texts, "<|endoftext|> a<|startoftext|>b", "it's o'clock' 'tis I'll,'ve", "", "\n\n", " "], tokenizer)


# --- 2 ---

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>a="</p>"</script></head><body><nav><ul><li><a href=x>menu {0}</a></ul></nav>
<header>head</header><div class="cookie-notice">ok?</div>{1}<div id=comments><p>first!</p></div><form>send</form><footer>foot {0}</footer>"""


def test_lines_of_a_page():
    text, kinds = html_text.lines(PAGE.format(1, "<article><h1>T &amp; t</h1><p><b>a\n b<br>c<p>&lt;x&gt; y&nbsp;z<aside>no</aside></article>"))
    assert [t for t, k in zip(text, kinds, strict=True) if k == 2] == ["T & t", "a b c", "<x> y z"]
    assert html_text.lines("") == ([], []) and html_text.lines("plain &am")[0] == ["plain &am"] and html_text.lines("cut <p")[0] == ["cut"]


def main_text(html, neighbour=None):
    return html_text.difference(html_text.lines(html), neighbour)[0]


def test_names_are_whole_classes_and_few_ids():
    article = "<article><h2 id='search-algorithms'>A</h2><h2 id='search'>B</h2><section id='related-work'>C</section><p class='market-share'>D</p><p title='a hidden x'>E</p><h3 id='comments-on-the-data'>F</h3></article>"
    for outside in ("class='page has-sidebar'", "class='no-sidebar'", "id='content-with-sidebar'", "class='sidebar'", "title='the hidden valley'"):
        assert main_text(f"<div {outside}>{article}</div>") == "A\nB\nC\nD\nE\nF"
    assert main_text(f"<form id=aspnet><nav>n</nav>{article}<div hidden>h</div></form>") == "A\nB\nC\nD\nE\nF"
    assert main_text("<p>a <a title='the hidden valley'>b</a> c</p><p data-x=\"class='ad'\">d</p><div class='x ad'>no</div><div aria-hidden=true>no</div>") == "a b c\nd"
    assert main_text("<main><p>a</p><div id=comments><article class='comment even'>no</article></div><aside>no</aside></main>") == "a"


def test_small_articles_leave_the_rest_to_differencing():
    page = "<div>Site</div><div class=post><p>the long text of a post</p></div><article>card</article>"
    assert main_text(page, ["Site", "other"]) == "the long text of a post\ncard"
    assert main_text("<div>Site</div><p>by me</p><article>the long text of a post</article>", ["Site", "other"]) == "the long text of a post"


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_common_subsequence():
    dice = random.Random(1)
    for _ in range(300):
        a, b = ([dice.randrange(5) for _ in range(dice.randrange(20))] for _ in range(2))
        at = html_text.shared(a, b)
        rest = iter(b)
        assert len(at) == longest(a, b) and at == sorted(set(at)) and all(any(y == a[i] for y in rest) for i in at)


def test_pages_without_articles_are_differenced(spark):
    body = lambda i: f"<div>Site</div><div>All rights</div><p>own {i}</p>" + "<p>shared text</p>" * (i < 3) + "<div>Bottom</div>"
    rows = [(i, f"http://h.example/a/{i:03}", body(i)) for i in range(30)] + [(30, "http://other.example/", "<p>alone</p>"), (31, None, None), (32, None, ""), (33, "http://main.example/a/007", PAGE.format(7, "<main><p>Site</p></main>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages, range_pages=4).collect()}
    assert got == {r.page_id: r.text for r in html_text.extract(pages.repartition(3)).collect()}
    assert all(got[i] == f"own {i}" for i in range(3, 30)) and got[30] == "alone" and got[31] == got[32] == "" and got[33] == "Site"
    assert html_text.extract(pages.limit(0)).count() == 0


# --- 3 ---


def test_automaton():
    dice = random.Random(2)
    for _ in range(200):
        refs = [[dice.randrange(3) for _ in range(dice.randrange(12))] for _ in range(4)]
        query = [dice.randrange(3) for _ in range(14)]
        a = SuffixAutomaton()
        for r in refs:
            a.add(r)
        parts = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        expected = [max([0] + [n for n in range(1, e + 1) if tuple(query[e - n : e]) in parts]) for e in range(1, 15)]
        assert a.statistics(query) == expected
        covered = {x for e, n in enumerate(expected, 1) if n >= 3 for x in range(e - n, e)}
        assert covered == {x for i, j in spans(expected, 3) for x in range(i, j)}


def without_repeats(rows):
    first, out = {}, {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - 12):
            if first.setdefault(tuple(w[s : s + 13]), i) < i:
                gone.update(range(s, s + 13))
        out[i] = len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    return out


@pytest.mark.parametrize("hot", [2000, 3])
def test_substring_dedup(docs, empty, hot):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(docs, hot=hot, digest=True).collect()}
    assert got == without_repeats(corpus())
    assert substring_dedup.deduplicate(empty).count() == 0


def test_repeated_and_null_ids_in_substring_dedup(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(4, long), (4, long), (4, "x " + long), (None, long), (None, None), (7, long + " tail"), (9, None)]
    got = substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(3))).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted([("4", 40, 0, long), ("4", 40, 0, long), ("4", 41, 0, "x " + long), ("None", 40, 0, long), ("None", 0, 0, ""), ("7", 41, 40, "tail"), ("9", 0, 0, "")])


def test_anchors_of_many_texts_are_those_of_each():
    dice = random.Random(4)
    texts = [" ".join(dice.choice("abcd") for _ in range(dice.randrange(40))) for _ in range(60)] + [None, ""]
    owner, at, hashes, span = substring_dedup.anchors_of(pa.array(texts, pa.string()), 13, 6)
    for i, t in enumerate(texts):
        alone = substring_dedup.anchors_of(pa.array([t], pa.string()), 13, 6)
        assert [x[owner == i].tolist() for x in (at, hashes, span)] == [x.tolist() for x in alone[1:]]
        windows = [s for a, x in zip(at[owner == i], span[owner == i], strict=True) for s in range(a - (x >> 8), a - (x >> 8) + (x & 255))]
        assert windows == list(range(max(0, len((t or "").split()) - 12)))


# --- 4 ---


def test_statistics(docs, empty):
    for r in quality.statistics(docs).collect():
        w, t = words(r.text), r.text or ""
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    assert quality.statistics(empty).count() == 0


def test_long_texts_count_alike():
    text = " ".join(str(i % 70_001) for i in range(210_000))
    assert quality._counts(text)[4] == 210_000 and quality._counts("a b c d e")[4] == 0


def test_decision_list(spark):
    dice = np.random.default_rng(3)
    x = dice.random((3000, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    noisy = bad ^ (dice.random(3000) < 0.01)
    rules = quality.learn(x[:2000], noisy[:2000], ["a", "b", "c"], precision=0.9)
    table = spark.createDataFrame(x[2000:].tolist(), "a double, b double, c double")
    kept = [r[0] for r in table.select(rules.verdict({c: F.col(c) for c in "abc"})).collect()]
    assert np.mean(np.array(kept) == ~bad[2000:]) > 0.97
    assert quality.learn(x, np.zeros(3000, bool), ["a", "b", "c"]).rules == () and quality.learn(x[:0], bad[:0], ["a", "b", "c"]).rules == ()


def test_rules_on_tables(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 0, 0), (3, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rules = quality.fit_texts(docs, labels)
    judged = quality.judged(quality.statistics(docs), rules)
    assert judged.count() == docs.count() and judged.where("kept is null or base_failed is null").isEmpty()
    assert quality.fit_texts(empty, labels.limit(0)).rules == ()


# --- 5 ---


def test_capped_shares():
    assert mixing.capped_shares([10, 100, 100], [5, 2, 1], 3) == [30.0, 120.0, 60.0]
    assert mixing.capped_shares([], [], 3) == [] and mixing.capped_shares([0, 4], [5, 2], 3) == [0.0, 4.0]


def drawn(rows):
    """Keys of a source's further copies, by going along the order one by one."""
    left = rows[0].target - rows[0].target // max(1, rows[0].source_size) * rows[0].source_size
    out = set()
    for r in sorted(rows, key=lambda r: (r.order, r.source, r.key, r.size, r.nth)):
        if r.size <= left and (r.size or left):
            out.add((r.key, r.size, r.nth))
            left -= r.size
        if left <= 0.001 * rows[0].target:
            break
    return out, left


def test_mix(docs, empty):
    size = n_words(F.col("text"))
    for preference in (None, F.sqrt(size)):
        mixed = mixing.mix(docs, size, preference=preference).collect()
        assert len(mixed) == docs.count()
        by = collections.defaultdict(list)
        for r in mixed:
            by[r.source].append(r)
        for rows in by.values():
            assert rows[0].source_size == sum(r.size for r in rows) and all(0 <= r.copies <= 3 for r in rows)
            certain = int(rows[0].target // max(1, rows[0].source_size))
            assert {r.copies - certain for r in rows} <= {0, 1}
            out = {(r.key, r.size, r.nth) for r in rows if r.copies > certain and r.size}
            expected, left = drawn(rows)
            expected = {x for x in expected if x[1]}
            over = [r for r in rows if left < r.size < 2 * left and (r.key, r.size, r.nth) not in expected] if left > 0.001 * rows[0].target else []
            nearest = {(k, n, i) for n, _, k, i in [min((r.size, r.order, r.key, r.nth) for r in over)]} if over else set()
            assert out == expected | nearest
            error = rows[0].target - sum(r.copies * r.size for r in rows)
            assert abs(error) <= max(0.001 * rows[0].target, min((r.size for r in rows if r.size and r.copies == certain), default=0) / 2 + 1)
        again = mixing.mix(docs.repartition(3), size, preference=preference).collect()
        assert sorted((r.id, r.copies) for r in again) == sorted((r.id, r.copies) for r in mixed)
    out = mixing.mixed_rows(docs, size, preference=F.sqrt(size))
    assert out.columns == docs.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter({r.id: r.copies for r in mixed if r.copies})
    assert mixing.mix(empty, size).count() == 0


def test_preference_and_repeated_rows(spark):
    rows = spark.createDataFrame([(i // 2, "s", 10, 4.0 if i % 4 < 2 else 1.0) for i in range(2000)] + [(None, "t", 60, 1.0)] * 300 + [(5, None, None, None)], "doc_id long, source string, size long, liked double")
    mixed = mixing.mix(rows, F.coalesce("size", F.lit(0)), weights=(1, 3), preference=F.col("liked"))
    taken = {(r.source, r.liked): r.n for r in mixed.join(rows.select("doc_id", "liked").distinct(), mixed.id == rows.doc_id).groupBy(mixed.source, "liked").agg(F.sum("copies").alias("n")).collect()}
    assert taken["ss", 4.0] > 2 * taken["ss", 1.0]
    assert mixed.count() == 2301 and mixed.where("source = 'st'").agg(F.sum("copies")).first()[0] == round(38_000 * 0.75 / 60)


def test_scales_of_inclusion():
    assert mixing.capped_scale({0: 100, 8: 100}, 90) == pytest.approx(0.3) and mixing.capped_scale({}, 5) == float("inf")
    c = mixing.capped_scale({0: 100, 24: 50}, 70)  # the most preferred are certain
    assert c == pytest.approx(0.2) and mixing.capped_scale({0: 10}, 10) == pytest.approx(1.0)


# --- 6 ---


def hit(doc, items, n):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    w, covered, found = low(doc), set(), set()
    for item, text in items:
        v = low(text)
        size = min(n, len(v))
        runs = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1) if v else ():
            if tuple(w[i : i + size]) in runs:
                covered.update(range(i, i + size))
                found.add(str(item))
    return len(w), len(covered), sorted(found)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination(spark, docs, empty, limit):
    texts = dict(corpus())
    items = [(0, " ".join(words(texts[5])[3:25]).upper()), (1, "One two THREE"), (2, ""), (3, None), (10, " ".join(words(texts[5])[3:13])), (4, "nothing like this in any of the texts at all here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in decontaminate.decontaminate(docs, bench, broadcast_windows=limit).collect()}
    assert got == {i: hit(t, items, 10) for i, t in corpus()}
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").isEmpty()
    assert decontaminate.decontaminate(empty, bench).count() == 0
    twice = decontaminate.decontaminate(docs.where("doc_id = 5").unionByName(docs.where("doc_id = 5")), bench).collect()
    assert len(twice) == 2 and twice[0].n_hit == twice[1].n_hit == 22


def test_long_texts_are_scanned_in_chunks(spark):
    text = " ".join(f"a{i}" for i in range(3 * decontaminate.CHUNK + 5))
    items = [(k, " ".join(f"a{i}" for i in range(s, s + 10))) for k, s in enumerate((0, decontaminate.CHUNK - 5, 2 * decontaminate.CHUNK, 3 * decontaminate.CHUNK - 5))]
    found = decontaminate.decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).first()
    assert found.n_hit == 40 and sorted(found["items"]) == ["0", "1", "2", "3"]


# --- 7 ---


def component_ids(rows, n=5, percent=75):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [1500, 4])
def test_jaccard_join(spark, docs, empty, block):
    got = {r.doc_id: (r["size"], r.component_id) for r in jaccard_join.components(docs, block=block).collect()}
    assert got == component_ids(corpus())
    assert jaccard_join.components(empty).count() == 0


@pytest.mark.parametrize("block", [1500, 7])
def test_groups_whose_members_are_not_all_linked(spark, block):
    dice = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in dice.sample(range(100), dice.choice((1, 2, 3, 4, 6))):
            w[k] = f"x{dice.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r["size"], r.component_id) for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == component_ids(rows)


def test_several_ranges_in_a_task(spark, docs):
    """Ranges far smaller than a block, and more of them than tasks, leave the same n-grams and anchors."""
    whole, cut = (sorted((r.doc_id is None, r.doc_id or 0, r.key or 0, sorted(r.rest or [])) for r in jaccard_join.reduced_sets(docs, doc_id="doc_id", text="text", n=5, percent=75, **more).collect()) for more in ({}, {"range_bytes": 500, "tasks": 3}))
    assert whole == cut
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").where("doc_id is not null")
    whole, cut = (sorted(map(tuple, substring_dedup.anchors(keyed, 13, 6, 2000, **more).collect()), key=str) for more in ({}, {"range_bytes": 500, "tasks": 3}))
    assert whole == cut and whole


def test_equal_and_null_ids(spark):
    rows = spark.createDataFrame([(7, "a b c d e f g"), (7, "a b c d e f g"), (None, "A b c d e f g"), (3, "q"), (None, None)], "doc_id long, text string")
    got = [(r.doc_id, r["size"], r.component_id) for r in jaccard_join.components(rows).collect()]
    assert sorted(got, key=repr) == sorted([(7, 3, 7), (7, 3, 7), (None, 3, 7), (3, 1, 3), (None, 0, None)], key=repr)


# --- 8 ---


def test_warc(spark, tmp_path):
    long = "ü" * 200
    rows = [(5, "http://a/ b\n", long), (2, "http://a/c", long), (9, None, long), (1, "u", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "v", long), (7, "v", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    paths = warc.write(warc.planned(pages), f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read(spark, paths).collect()}
    for page, _, html in rows:
        raw = (html or "").encode()
        twin = html == long and page != 2
        r = got[page]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if twin else "response", 2 if twin else None)
        assert r.payload is None if twin else bytes(r.payload) == raw
    assert warc.read(spark, warc.write(warc.planned(pages.limit(0)), f"file://{tmp_path}/e")).count() == 0


def test_damaged_records():
    import gzip
    import io

    whole = warc.record(1, "u", b"text", hashlib.sha256(b"text").hexdigest(), None, "d")
    assert [r[0] for r in warc._records(io.BytesIO(whole + whole))] == [1, 1]
    raw = gzip.decompress(whole)
    for bad in (raw.replace(b"\r\ntext", b"\r\ntaxt"), raw[:-1], raw + b"x"):
        with pytest.raises(ValueError):
            list(warc._records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(ValueError):
        list(warc._records(io.BytesIO(whole[:-9])))


# --- 9 ---


def test_license_scan(spark, docs, empty):
    prose = corpus()[0][1]
    filler = " ".join(f"word{i}" for i in range(500))
    texts = [
        ("Released under the MIT License.", ["MIT"]), (f"{prose}\nLICENSED under the apache license version 2.0\n{prose}", ["Apache-2.0"]), ("Licensed under CC BY-SA 4.0.\nReleased under the MIT License.", ["CC-BY-SA-4.0", "MIT"]),
        (f"{filler} This work is licensed under the GNU General Public License, version 2. {filler}", ["GPL-2.0"]), ("He released the version that was licensed to him", []), ("The license", []), (None, []), ("", []), (prose, []),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [f.license for f in r.findings] for r in license_scan.scan(rows).collect()}
    assert got == {i: e for i, (_, e) in enumerate(texts)}
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(docs).columns == [*docs.columns, "findings"]


def found_licenses(text, templates=license_scan.TEMPLATES):
    return [f[:2] for f in license_scan.Scanner(templates, 0.1).text(text)]


def test_notice_words_around_a_notice():
    notice = "released under the mit license".split()
    for text, at in [("foo is released under the mit license see the license file in the root", 2), ("it was released last year now it is released under the mit license", 8)]:
        assert license_scan.windows(notice, text.split(), 0) == [(0, at, at + 5)]
    assert found_licenses("Foo is released under the MIT License. See the LICENSE file in the root of this repository for details.") == [("MIT", 0)]
    dice = random.Random(4)
    for _ in range(300):
        a, b = ([dice.randrange(4) for _ in range(n)] for n in (dice.randrange(2, 6), dice.randrange(12)))
        plain = [len(a) + e - s - 2 * longest(a, b[s:e]) for s in range(len(b)) for e in range(s + 1, len(b) + 1)]
        got = license_scan.windows(a, b, len(a) - 1)
        assert min((w[0] for w in got), default=len(a)) == min([x for x in plain if x < len(a)], default=len(a))
        assert all(w[0] == len(a) + w[2] - w[1] - 2 * longest(a, b[w[1] : w[2]]) for w in got) and all(v[2] <= w[1] for v, w in itertools.pairwise(got))


def test_notices_over_lines_and_side_by_side(spark):
    mit, bsd = (license_scan.TEMPLATES[k] for k in ("MIT-text", "BSD-text"))
    wrap = lambda t, n: "\n".join(f" * {' '.join(x)}" for x in itertools.batched(t.split(" "), n))
    assert found_licenses(f"Copyright\n{wrap(mit, 6)},\nincluding\n{wrap(bsd, 3)}") == [("MIT-text", 1), ("BSD-text", 7)]
    assert found_licenses("Licensed under CC BY 4.0. Released under the MIT License.") == [("CC-BY-4.0", 0), ("MIT", 0)]
    assert found_licenses("Released under the MIT License. " * 3 + "\nReleased under\nthe MIT License.") == [("MIT", 0)] * 3 + [("MIT", 1)]
    changed = mit.replace("any person", "any one person").replace("free of charge, ", "free of, ")
    assert [f[3:] for f in license_scan.Scanner(license_scan.TEMPLATES, 0.1).text(f"x {changed} y")] == [(["charge"], ["one"], 1)]
    assert found_licenses(mit.replace("free of charge, ", "")) == []
    more = {f"T{i}": f"use as is {i}" for i in range(8)}
    assert found_licenses("; ".join(more.values()), more) == [(k, 0) for k in more]
    rows = spark.createDataFrame([(0, "You may\nuse as is 3 times")], "doc_id long, text string")
    assert [f.license for f in license_scan.scan(rows, templates=more).first().findings] == ["T3"]
    with pytest.raises(ValueError):
        license_scan.scan(rows, templates={"none": "--"})


@pytest.mark.parametrize("name", license_scan.TEMPLATES)
def test_each_notice_is_found_as_itself(name):
    """Wrapped as a comment, with a wrong word in long ones; of notices that hold others, or differ by few words, only the right one."""
    given = license_scan.TEMPLATES[name].split()
    lines = [f" * {' '.join(x)}" for x in itertools.batched(given, 7)]
    assert found_licenses("\n".join(["Copyright 2020 A. Author", *lines, "int main() {}"])) == [(name, 1)]
    if len(given) >= 30:
        assert (name, 0) in found_licenses("\n".join(lines).replace(given[9], "misspelt", 1))


def test_clauses_tell_bsd_licenses_apart():
    two, three = (license_scan.TEMPLATES[k] for k in ("BSD-2-Clause", "BSD-3-Clause"))
    disclaimer = two[two.index("THIS SOFTWARE") :]
    assert found_licenses(f"{three}\n{disclaimer}") == [("BSD-3-Clause", 0)] and found_licenses(two) == [("BSD-2-Clause", 0)]


# --- 10 ---


def test_rendezvous(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), sharding.rendezvous(F.col("id"), [1, 1, 2]).alias("a"), sharding.rendezvous(F.col("id"), [1, 1, 2, 1]).alias("b"))
    assert rows.where("a <> b and b <> 3").isEmpty()
    sizes = {r.a: r["count"] for r in rows.groupBy("a").count().collect()}
    assert abs(sizes[0] - 5000) < 300 and abs(sizes[2] - 10_000) < 300
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), [1, 0])


def test_shards_are_written_as_dealt(spark, docs, tmp_path):
    dealt = sharding.shard(docs.select("doc_id", "text"), "doc_id", [1.0, 2.0])
    sharding.write_shards(dealt, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in dealt.collect())


def test_slots_have_no_gaps(spark, docs, empty):
    rows = docs.select("doc_id", "text", "shard").unionByName(docs.select("doc_id", "text", "shard").where("doc_id < 5")).unionByName(spark.createDataFrame([(None, "t", "s")] * 3, "doc_id long, text string, shard string"))
    dealt = sharding.shard(rows, "doc_id", [1.0] * 3, order=["text"], buckets=8).collect()
    assert len(dealt) == rows.count()
    for s in range(3):
        slots = sorted(r.slot for r in dealt if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in dealt if r.doc_id is None}) == 1
    assert sharding.shard(empty, "doc_id", [1.0] * 3).count() == 0
