"""Operators on the corpus as a whole: lines, repeats, quality, outliers, pages, vectors and the pipeline."""

import collections


import math
import random
import re

import numpy as np

import pytest

import corpus_pipeline
from sparktrace.llm import html, lines, outliers, quality, repeats, topk
from sparktrace.llm.common import table

DOCS = "doc_id bigint, text string, lang string, source string, _row int, n_lines int"


def doc_rows(texts):
    return [(i, t, "en", "s", 1, 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- lines ------------------------------------------------------------------------------------------------------------


def plain_lines(texts, min_docs, min_chars=1):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    split = [(t or "").split("\n") for t in texts]
    found = collections.Counter(k for ls in split for k in {key(x) for x in ls})
    return sorted(
        (len(ls), len(ls) - len(stay), "\n".join(stay))
        for ls in split
        for stay in [[x for x in ls if len(key(x)) < min_chars or found[key(x)] < min_docs]]
    )


@pytest.mark.parametrize("min_docs, min_chars", [(10, 1), (2, 3), (1, 1)])
def test_lines_equal_brute_force(spark, min_docs, min_chars):
    draw = random.Random(7)
    pool = ["Common\x0b", " common", "É", "é", "", " ", "ab", *(f"line {i}" for i in range(40)), "\x85x", "x" * 9000]
    texts = ["\n".join(draw.choice(pool) for _ in range(draw.randrange(1, 9))) for _ in range(150)] + [None, "", "\n", "unique"] + ["same\ntext"] * 12
    made = lines.drop_common_lines(spark.createDataFrame(doc_rows(texts), DOCS), min_docs=min_docs, min_chars=min_chars, n_lines="lines")
    assert made.columns == ["doc_id", "text", "lang", "source", "_row", "n_lines", "lines", "n_dropped"]
    assert sorted(made.select("lines", "n_dropped", "text").collect()) == plain_lines(texts, min_docs, min_chars)


def test_lines_of_many_shards(spark, monkeypatch, none):
    monkeypatch.setattr(lines, "SHARD", 20)
    monkeypatch.setattr(lines, "COMMON", 20)
    texts = [f"a{i % 40}\nb{i % 7}\nall" for i in range(300)]
    made = lines.drop_common_lines(spark.createDataFrame(doc_rows(texts), DOCS).repartition(5), n_lines="lines")
    assert sorted(made.select("lines", "n_dropped", "text").collect()) == plain_lines(texts, 10)
    assert lines.drop_common_lines(none, n_lines="lines").count() == 0


def test_perfect_hash():
    draw = np.random.default_rng(1)
    keys, prints, counts = (draw.integers(-(1 << 63), (1 << 63) - 1, 5000) for _ in range(3))
    keys[:20] = 7  # equal keys are told apart by their prints
    made = lines.PerfectHash.from_row(*lines.PerfectHash.build(keys, prints, counts).to_row())
    assert (made.count(keys, prints) == counts).all() and len(made.prints) == 5000
    assert (made.count(keys[20:], prints[20:] + 1) == 0).all()
    nothing = lines.PerfectHash.build(keys[:0], keys[:0], keys[:0])
    assert (nothing.count(keys, prints) == 0).all()


# --- repeats ----------------------------------------------------------------------------------------------------------


def plain_repeats(rows, length):
    first = {}
    order = [((1 << 63) - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    for d, data in sorted(order):
        for i in range(len(data) - length + 1):
            first.setdefault(data[i : i + length], d)
    out = []
    for d, data in order:
        cover = np.zeros(len(data) + 1, dtype=bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < d:
                cover[i : i + length] = True
        spans = int((cover[:-1] & ~np.r_[False, cover[:-2]]).sum()) if len(data) else 0
        out.append((str(d), len(data), int(cover.sum()), spans, bytes(b for b, c in zip(data, cover) if not c)))
    return sorted(out)


def repeat_rows():
    draw = random.Random(5)
    word = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 9))) for _ in range(400)]
    passages = [" ".join(draw.choice(word) for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = [" ".join(draw.choice(word) for _ in range(draw.randrange(40)))]
        for _ in range(draw.randrange(3)):
            p = draw.choice(passages)
            cut = draw.randrange(len(p))
            parts += [p[cut:] if draw.random() < 0.4 else p, " ".join(draw.choice(word) for _ in range(draw.randrange(20)))]
        rows.append((i, draw.choice([" ", ""]).join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (201, rows[3][1]), (None, rows[4][1]), (None, rows[5][1] + "x"), (202, None), (203, ""), (204, "z" * 49), (205, "z" * 50)]
    return rows + [(206, "z" * 120), (207, "ab" * 300 + "z" * 50), (208, "ab" * 200), (-5, rows[7][1][:70])]


@pytest.mark.parametrize("crowded, length", [(20_000, 50), (2, 50), (20_000, 41)])
def test_repeats_equal_brute_force(spark, monkeypatch, crowded, length):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 300)
    monkeypatch.setattr(repeats, "GROUP_ROWS", 8)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 700)
    rows = repeat_rows()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, least int").repartition(4)
    made = repeats.remove_repeats(docs, length=length)
    found = sorted((str(r["doc_id"] if r["doc_id"] is not None else (1 << 63) - 1), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in made.collect())
    assert found == plain_repeats(rows, length)


def test_repeats_of_an_empty_table(spark, none):
    assert repeats.remove_repeats(none).count() == 0
    assert repeats.remove_repeats(spark.createDataFrame(doc_rows([None, "", "x"]), DOCS)).selectExpr("sum(n_removed)").first()[0] == 0


def test_merged_transforms_equal_sorting():
    draw = random.Random(2)
    strings = ["".join(draw.choice("ab") for _ in range(draw.randrange(6, 30))).encode() for _ in range(40)]
    parts = [strings[i::3] for i in range(3)]
    made = [repeats.shard_transform(p, 6) for p in parts]
    source, block = repeats.repeated_intervals([t for _, t in made], 6)
    seen, texts = [0, 0, 0], ["\x00".join(x.decode() for x in p) + "\x00" for p in parts]
    prefixes = []
    for s in source.tolist():
        at = made[s][0][seen[s]]
        seen[s] += 1
        whole = texts[s][at : at + 6]
        prefixes.append(whole if "\x00" not in whole and len(whole) == 6 else f"end {s} {seen[s]}")
    assert len(source) == sum(len(t) for t in texts)
    blocks = collections.defaultdict(set)
    for b, p in zip(block.tolist(), prefixes):
        blocks[b].add(p)
    assert all(len(p) == 1 for p in blocks.values()) and len(blocks) == len(set(prefixes))
    plain = [p for p in prefixes if not p.startswith("end")]
    assert plain == sorted(plain)


@pytest.mark.parametrize("length", [1, 2, 7, 50])
def test_merging_takes_two_letters_a_step(monkeypatch, length):
    draw, sort, calls = random.Random(length), np.argsort, []
    strings = ["".join(draw.choice("ab") for _ in range(draw.randrange(length, length + 60))).encode() for _ in range(60)]
    documents = np.array([draw.randrange(30) for _ in strings])
    least = {}
    for s, d in zip(strings, documents.tolist()):
        for i in range(len(s) - length + 1):
            least[s[i : i + length]] = min(d, least.get(s[i : i + length], d))
    made = repeats.smallest_documents(strings, documents, length, 300)
    assert [m.tolist() for m in made] == [[least[s[i : i + length]] for i in range(len(s) - length + 1)] for s in strings]
    transforms = [repeats.shard_transform(strings[i::3], length)[1] for i in range(3)]
    monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(1) or sort(*a, **k))
    repeats.repeated_intervals(transforms, length)
    assert len(calls) <= 3 + 2 * -(-length // 2)


def test_merging_takes_four_letters_a_step(monkeypatch):
    draw, sort, calls = random.Random(9), np.argsort, []
    passage = "".join(draw.choice("abcé ") for _ in range(120))
    strings = [passage[draw.randrange(30) :].encode() + draw.choice(["", "x", "yz"]).encode() for _ in range(40)]
    documents = np.arange(40)[::-1].copy()
    transforms = [repeats.shard_transform(strings[i::3])[1] for i in range(3)]
    monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(1) or sort(*a, **k))
    repeats.repeated_intervals(transforms)
    assert len(calls) <= 3 + 2 * 13  # two letters, then twelve times four
    by_four = [m.tolist() for m in repeats.smallest_documents(strings, documents, 50, 700)]
    monkeypatch.setattr(repeats, "FOUR_LETTERS", 0)
    assert by_four == [m.tolist() for m in repeats.smallest_documents(strings, documents, 50, 700)]


def test_repeats_send_no_null_lists(spark):
    docs = spark.createDataFrame(doc_rows(["a" * 60, "a" * 60, "b" * 70]), DOCS)
    plan = repeats.remove_repeats(docs)._jdf.queryExecution().analyzed().toString()
    assert "copies" in plan and "null as array" not in plan


def test_lists_of_equal_numbers_become_one_number():
    found = [np.array(x) for x in ([5], [4, 4, 4], [4, 3, 4], [9, 9], [1, 2])]
    assert repeats.one_if_equal(found).to_pylist() == [[5], [4], [4, 3, 4], [9], [1, 2]]


# --- quality ------------------------------------------------------------------------------------------------------------


def plain_model(texts):
    """Interpolated modified Kneser-Ney by the definition, with dictionaries."""
    size, order = quality.CLASSES, quality.ORDER
    grams = collections.Counter()
    for t in texts:
        s = [0] * (order - 1) + quality.symbols(t).tolist()
        grams.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    levels = [grams]
    for _ in range(order - 1):
        levels.insert(0, collections.Counter(g[1:] for g in levels[0]))

    def rule(level):
        n = [sum(c == k for c in level.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        return [min(max((k + 1) - (k + 2) * y * (n[k + 1] / n[k] if n[k] else 0), 0.1), k + 0.9) for k in range(3)]

    discounts = [rule(level) for level in levels]

    def p(gram, k):
        if k < 0:
            return 1 / size
        level, d = levels[k], discounts[k]
        context = [g for g in level if g[:-1] == gram[:-1]]
        if not context:
            return p(gram[1:], k - 1)
        total = sum(level[g] for g in context)
        weight = sum(d[min(level[g], 3) - 1] for g in context) / total
        own = max(level[gram] - d[min(level[gram], 3) - 1], 0) / total if level[gram] else 0
        return own + weight * p(gram[1:], k - 1)

    return p


def test_quality_equals_the_definition(spark):
    texts = ["the cat sat on the mat.", "The hat, the cat!", "a mat and a hat\nthe end", "été là"]
    docs = spark.createDataFrame([(i, t, "en", i) for i, t in enumerate([*texts, "xyz 99 cat", None, ""])], "doc_id bigint, text string, lang string, _log int")
    model = quality.fit(docs.filter("doc_id < 4"))
    found = {r["doc_id"]: r["perplexity"] for r in quality.score(docs, model).collect()}
    p = plain_model(texts)
    for i, t in enumerate([*texts, "xyz 99 cat"]):
        s = [0] * 3 + quality.symbols(t).tolist()
        want = math.exp(-sum(math.log(p(tuple(s[j : j + 4]), 3)) for j in range(len(s) - 3)) / len(t))
        assert found[i] == pytest.approx(want, rel=1e-4)
    assert found[5] is None and found[6] is None
    some = quality.dense(model).reshape(-1, quality.CLASSES)
    assert np.allclose(np.exp(some[[0, 5, 100, 2000]].astype(float)).sum(axis=1), 1, atol=1e-4)


def plain_points(texts):
    """Log probability of an n-gram of characters under the model of the texts, by the definition."""
    grams = collections.Counter()
    for t in texts:
        s = [-1] * (quality.ORDER - 1) + [ord(c) for c in t]
        grams.update(tuple(s[i : i + quality.ORDER]) for i in range(len(s) - quality.ORDER + 1))
    levels = [grams]
    for _ in range(quality.ORDER - 1):
        levels.insert(0, collections.Counter(g[1:] for g in levels[0]))
    discounts = []
    for level in levels:
        n = [sum(c == k for c in level.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        discounts.append([min(max((k + 1) - (k + 2) * y * (n[k + 1] / n[k] if n[k] else 0), 0.1), k + 0.9) for k in range(3)])

    def p(gram):
        if not gram:
            return 1 / quality.POINTS
        level, d = levels[len(gram) - 1], discounts[len(gram) - 1]
        context = [n for g, n in level.items() if g[:-1] == gram[:-1]]
        if not context:
            return p(gram[1:])
        weight = sum(d[min(n, 3) - 1] for n in context) / sum(context)
        own = max(level[gram] - d[min(level[gram], 3) - 1], 0) / sum(context) if level[gram] else 0
        return own + weight * p(gram[1:])

    return p


@pytest.mark.parametrize("group_bytes", [1, 100, 8_000_000])
def test_quality_tells_characters_apart(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(quality, "GROUP_BYTES", group_bytes)
    texts = ["THE CAT SAT on the mat.", "The hat, the cat!", "a mat and a hat\nthe end", "été là", "été là"]
    # Capitals, digits and letters four code points apart were one class each.
    others = ["THE CAT SAT", "QZX KWJ VYV", "été", "íxí", "2024", "1999", "日本\x00😀", "x" * 300]
    rows = [(i, t, i < len(texts)) for i, t in enumerate([*texts, *others, None, ""])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sure boolean").repartition(3)
    found = {r["doc_id"]: r["perplexity"] for r in quality.perplexities(docs, "sure").collect()}
    p = plain_points(texts)
    for i, t in enumerate([*texts, *others]):
        s = [-1] * 3 + [ord(c) for c in t]
        want = math.exp(-sum(math.log(p(tuple(s[j : j + 4]))) for j in range(len(s) - 3)) / len(t))
        assert found[i] == pytest.approx(want, rel=1e-9)
    assert found[len(rows) - 2] is None and found[len(rows) - 1] is None and len(found) == len(rows)
    assert found[6] > 2 * found[5]


def test_quality_on_labels(spark, sf_dir, none):
    rows = {r["doc_id"]: r for r in quality.op1_quality(spark, sf_dir).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    good = [rows[d]["kept"] for d, q in labels.items() if q == 1]
    bad = [rows[d]["kept"] for d, q in labels.items() if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)
    ids = none.select("doc_id")
    assert quality.judge(none, ids).count() == 0
    odd = spark.createDataFrame(doc_rows(["a", None]), DOCS)
    assert sorted((r["doc_id"], r["kept"], r["perplexity"]) for r in quality.judge(odd, ids).collect()) == [(0, True, None), (1, True, None)]


def test_quality_keeps_columns_with_its_own_names(spark):
    texts = ["the cat sat on the mat"] * 3 + ["xq zz kk"]
    docs = spark.createDataFrame([(i, t, "en", i, "l", "t", 7, 8) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, _log int, _lang string, trusted string, kept int, perplexity int")
    made = quality.judge(docs, docs.filter("doc_id < 2").select("doc_id"))
    assert made.columns == ["doc_id", "lang", "_log", "_lang", "trusted", "kept", "perplexity", "_trusted", "_perplexity", "_kept"]
    row = made.filter("doc_id = 1").first()
    assert (row["_log"], row["_lang"], row["trusted"], row["kept"], row["perplexity"], row["_trusted"]) == (1, "l", "t", 7, 8, True)


# --- outliers ---------------------------------------------------------------------------------------------------------


def plain_statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = list(zip(words, words[1:], words[2:]))
    n = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    some = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(some) - len(set(some)), len(covered)


def test_statistics_equal_the_definition():
    draw = random.Random(3)
    texts = ["".join(draw.choice(["a", "b", "é", " ", "\n", "\x0b", "#", "\x85", "|x", "日"]) for _ in range(draw.randrange(200))) for _ in range(300)]
    for t in [*texts, None, "", "a b c a b c", "a a a a", "x " * 5000]:
        assert outliers.statistics_of(t)[:5] == plain_statistics(t)


def test_chi_square():
    assert outliers.chi_square_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3)
    assert outliers.chi_square_share(9.2364, 5) == pytest.approx(0.9, abs=1e-4)


def test_outliers_are_found_and_clean_kept(spark, none):
    draw = random.Random(9)
    word = ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(draw.choice(word) for _ in range(draw.randrange(60, 200))), "en", None if i % 3 else "s", 0, 0) for i in range(300)]
    bad = [(1000 + i, " ".join(draw.choice(word) + "###" for _ in range(100)), "en", "s", 0, 0) for i in range(20)]
    bad += [(2000 + i, " ".join(draw.choice(word).upper() for _ in range(100)), "en", "s", 0, 0) for i in range(10)]
    odd = [(3000, None, None, None, 0, 0), (None, "few words", "fr", None, 0, 0), (3001, "a b c " * 60, "en", "s", 0, 0), (3002, " ".join(word[:200]), None, "x", 0, 0)]
    found = {r["doc_id"]: r for r in outliers.outliers(spark.createDataFrame(rows + bad + odd, DOCS)).collect()}
    assert sum(found[i]["kept"] for i in range(300)) >= 297 and not any(found[r[0]]["kept"] for r in bad)
    assert [found[d]["base_failed"] for d in (3000, None, 3001, 3002)] == [True, True, True, False] and found[3002]["kept"]
    assert outliers.outliers(none).count() == 0


# --- pages ------------------------------------------------------------------------------------------------------------


def page_text(page):
    return html.main_text(html.blocks_of(page), set())


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain  &amp; simple", "plain & simple"), ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\n\nd"),
        ("<div>a<b>b<br>c</b>d</div>", "ab cd"), ("<nav>x</nav><p>a<script>var t='</p>';</script>b</p>", "ab"),
        ("<header>site</header><article><header><h1>T</h1></header><p>x&nbsp;&lt;y</p><aside>no</aside></article><p>after", "T\n\nx <y"),
        ("<main>m<div class='comments'><p>c1</div><form><p>f</form>n</main>", "m\n\nn"), ("<ul><li>a<li>b</ul>", "a\n\nb"),
        ("<p>x <span class=ad>buy</span> y", "x\n\ny"), ("<article>a</p></div>b</article></article>c", "a\n\nb"),
        ("<div role=navigation>n</div><!-- <p>no</p> --><p>y", "y"), ("<style>a{}", ""), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ('<div class="layout with-sidebar"><article><p>kept</p></article></div>', "kept"), ('<div id="page" class="no-sidebar"><main>kept</main></div>', "kept"),
        ('<article><p class="related-work">kept</p><div class="article-header"><h1>T</h1></div></article>', "kept\n\nT"),
        ('<article>kept</article><article class="comment">reader</article>', "kept"), ('<main><article class="comment-body" id="comment-7">reader</article>kept</main>', "kept"),
        ("<main>kept<p hidden>no</p><div style='display: none'>no</div><p title='hidden'>yes</p></main>", "kept\n\nyes"),
        ('<p>kept</p><div class="post-comments">c</div><ul class="related-posts"><li>r</ul><div id="ad-slot-3">a</div><p class="cookie-notice">n</p>', "kept"),
        ('<div class="sidebar"><article class="teaser">t</article></div><article class="post header-less">kept</article>', "kept"),
    ],
)
def test_main_text(page, text):
    assert page_text(page) == text


def test_template_texts_go_and_articles_stay(spark, none):
    def page(i):
        return f"<div class=top>Our site</div><div><p>Story {i} of the day</p><p>More about {i * 7}</p></div><div>Write to us</div>"

    rows = [(i, f"http://h.example/{i}", page(i), "x") for i in range(30)] + [(99, None, "<p>alone</p>", "x"), (99, None, "<p>alone</p>", "x")]
    rows += [(200 + i, "https://Copy.example/a", "<article><p>same text</p></article>", "x") for i in range(9)] + [(300, "http://h.example/n", None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    found = sorted(map(tuple, html.extract(pages).select("page_id", "text", "host").collect()), key=str)
    want = [(i, f"Story {i} of the day\n\nMore about {i * 7}", "x") for i in range(30)] + [(99, "alone", "x")] * 2 + [(200 + i, "same text", "x") for i in range(9)] + [(300, "", None)]
    assert found == sorted(want, key=str)
    assert html.extract(pages.limit(0)).count() == 0


def test_copies_make_no_template(spark):
    rows = [(i, "http://copies.example/", "<div><p>same text</p></div>", "x") for i in range(9)]
    rows += [(20 + i, "http://two.example/", f"<div><p>text {'ab'[i % 2]}</p><p>foot</p></div>", "x") for i in range(8)]
    found = {r["page_id"]: (r["_text"], r["text"]) for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()}
    assert all(found[i] == ("same text", "x") for i in range(9))
    assert all(found[20 + i] == (f"text {'ab'[i % 2]}\n\nfoot", "x") for i in range(8))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_equal_occurrence_vectors(spark, seed):
    """The template from sums of hashes is the one from the vectors themselves, copies of pages counted once."""
    draw = random.Random(seed)
    fixed = [f"<div class=f{i}>part {i}</div>" for i in range(8)]
    pages = []
    for n in range(24):
        body = [f for i, f in enumerate(fixed) if (n * (i + 1) + seed) % (i + 2) or i < 3]
        body.insert(2, "".join(f"<p>{draw.choice('abcdef')} {n}</p>" for _ in range(draw.randrange(1, 4))))
        pages += ["".join(body)] * draw.randrange(1, 4)
    df = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string").repartition(5)
    contents = sorted(set(pages))
    seen = collections.defaultdict(list)
    for n, page in enumerate(contents):
        blocks = html.blocks_of(page)
        for i, (path, _, _, text) in enumerate(blocks):
            for t, is_text in ((html.token(path, ""), False), (html.token(path, text), True)):
                seen[t, is_text].append((n, (i + 0.5) / len(blocks)))
    rows = []
    for (t, is_text), places in seen.items():
        counts = collections.Counter(n for n, _ in places)
        firsts = {}
        for n, place in places:
            firsts.setdefault(n, place)
        if len(counts) >= max(3, len(contents) / 2):
            rows.append((t, is_text, len(counts), len(contents), sum(firsts.values()) / len(firsts), tuple(sorted(counts.items()))))
    import pandas as pd

    table = pd.DataFrame(rows, columns=["token", "is_text", "pages", "host_pages", "place", "vector"])
    want = set(html.nested_template(table))
    assert {t for r in html.templates(df).collect() for t in r["template"]} == want and want


# --- vectors ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [4096, 16])
def test_nearest_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    draw = np.random.default_rng(4)
    vectors = (draw.normal(size=(300, 8)) * np.r_[3, 2, 1, 1, 0.5, 0.2, 0.1, 0.1] * draw.exponential(size=(300, 1))).round(2)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(i, vectors[7].tolist(), 0) for i in range(300, 380)]
    rows += [(7, vectors[7].tolist(), 1), (400, [0.0] * 8, 0), (401, [1.0, 2.0], 0), (450, [], 0)]
    bad = [(500, None, 0), (550, [1.0, None], 0), (600, [math.nan] * 8, 0), (650, [math.inf] * 8, 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, length int")
    from pyspark.sql import functions as F

    found = collections.defaultdict(list)
    for r in topk.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ints = {(i, tuple(math.floor(256 * x) for x in v) + (0,) * (8 - len(v))) for i, v, _ in rows}
    for i, q in [x for x in ints if x[0] % 50 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ints if (j, c) != (i, q))[:5]
        assert found.pop(i) == [(n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert not found
    assert topk.nearest(df.limit(0), F.lit(True)).count() == 0
    assert topk.nearest(df.filter("vec_id = 3"), F.col("vec_id") == 3).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir, none):
    docs = table(spark, sf_dir, "documents")
    copies = docs.limit(5).selectExpr("doc_id + 100000 AS doc_id", "concat(text, ' \\n') AS text", "lang", "source", "n_chars")
    passage = "a passage of many words that stands in two documents and is longer than fifty bytes by far"
    more = spark.createDataFrame(
        [(200000, "the and of " + passage, "en", "s", 0), (200001, passage + " in that of", "en", "s", 0), (200002, "123 456", None, None, 0), (200003, None, None, None, 0), (None, "the of and", "en", None, 0)],
        docs.schema,
    )
    now = docs.unionByName(copies).unionByName(more)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, now, sf_dir)
        assert made.columns == docs.columns
        now = spark.createDataFrame(made.toPandas().astype(object).where(lambda x: x.notna(), None), docs.schema)
        seen[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert not {200002, 200003} & set(seen["language ID"]) and len(seen["language ID"]) == docs.count() + 8
    assert not [d for d in seen["near-duplicate removal"] if d is not None and 100000 <= d < 200000]
    assert passage in seen["repeat removal"][200000] and passage not in seen["repeat removal"][200001]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 4096").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
