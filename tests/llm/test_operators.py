"""Each operator against brute force or an exact round trip, and on odd rows and empty tables."""

import hashlib
import html
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import roots
from helpers import duck, rows
from tidemark.llm import _common, audio, bpe, exact_substrings, fuzzy_lines, hamming_search, html_text, jaccard_join, language, mixing, quality, queries, shingles
from tidemark.llm._common import components, squeeze

LAST = (1 << 63) - 1


def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, small, name):
    assert rows(queries.QUERIES[name](spark, small).toPandas()) == rows(duck(small, queries.ORACLES[name]))


# 1. Mixing


@pytest.mark.parametrize("quota", [[1], [3, 1], [5, 3, 2], [1] * 7 + [57], mixing.quotas([3.3, 1.1, 0.01, 9], 640)])
def test_pfair_stays_within_a_block(quota):
    total, seen = sum(quota), [0] * len(quota)
    for t, s in enumerate(mixing.period(quota), 1):
        seen[s] += 1
        assert all(abs(n - t * q / total) < 1 for n, q in zip(seen, quota, strict=True))
    assert seen == list(quota)


def test_schedule_uses_every_block_once_and_goes_on_without_the_used_up():
    blocks, weights = [10, 400, 3], [5.0, 5.0, 1.0]
    plan = mixing.schedule(blocks, weights)
    slots = [o + j // len(p) * q + p[j % len(p)] for ph in plan for _, c, o, q, p in ph for j in range(c)]
    assert sorted(slots) == list(range(413)) and [sum(c for _, c, *_ in ph) for ph in plan] == blocks


def test_mix_places_every_row_once(spark, small, odd, none):
    for df, kw in ((docs(spark, small), {"block_rows": 3}), (odd, {"block_rows": 2}), (odd, {"weights": {"a": 2.0, None: 1.0}})):
        got = mixing.mix(df, **kw)
        assert got.columns == ["doc_id", "source", "block", "slot", "position"]
        assert sorted(r["position"] for r in got.collect()) == list(range(df.count()))
    m = mixing.mix(docs(spark, small), block_rows=3).orderBy("position").toPandas()
    assert (m.groupby("source")["block"].apply(lambda b: b.is_monotonic_increasing)).all()
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("blocks, weights", [([30_000, 9_000, 5_000, 3_000, 2_000], [1732.05, 948.68, 707.1, 547.7, 447.2]), ([20_000] * 3 + [10_000], [0.7, 0.2, 0.0995, 0.0005])])
def test_schedule_stays_within_a_block_over_many_periods(blocks, weights):
    plan = mixing.schedule(blocks, weights)
    first = [ph[0] for ph in plan]
    end = min(ph[0][2] + max(ph[0][4]) for ph in plan if ph[0][1] == blocks[plan.index(ph)])
    assert end > 10_000
    for (_, _, _, _, slots), w in zip(first, weights, strict=True):
        n = np.cumsum(np.bincount([x for x in slots if x < end], minlength=end)[:end])
        assert (abs(n - np.arange(1, end + 1) * (w / sum(weights))) < 1).all()


def test_mix_takes_any_number_of_sources(spark):
    n = mixing.MAX_SOURCES + 300
    df = spark.range(n + 5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") < n, F.col("id")).otherwise(0)).alias("source"))
    got = mixing.mix(df, block_rows=2).toPandas()
    assert sorted(got["position"]) == list(range(n + 5000)) and got["source"].nunique() == n
    b = got.groupby("slot").agg(k=("source", "nunique"), n=("block", "nunique"))
    assert (b == 1).all().all() and got.sort_values("position")["slot"].is_monotonic_increasing


# 2. Language


def test_language_held_out_accuracy_and_odd_rows(spark, odd, none):
    df = docs(spark, "/root/testdata/sf0.01")
    model = language.fit(language.training_sample(df.where(~language.held_out())))
    got = language.identify(df.where(language.held_out()), model, keep=("lang",)).toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()
    o = language.identify(odd.drop("score"), model).collect()
    assert len(o) == 11 and sorted({(r["lang_pred"], r["score"]) for r in o if r["doc_id"] in (3, 4, 6, 7)}) == [("und", 0.0)]
    assert language.identify(none, model).count() == 0
    untaught = language.fit(language.training_sample(none))
    assert {r["lang_pred"] for r in language.identify(odd, untaught).collect()} == {"und"}


def test_every_labelled_language_is_learned(spark):
    g = np.random.default_rng(5)
    langs = [f"l{i:02d}" for i in range(70)]
    words = {x: ["".join(g.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)] for x in langs}
    text = {x: " ".join(g.choice(words[x], 30)) for x in langs}
    text["l03"] = " ".join(g.choice(words["l03"], 4000))  # no short text
    rows = [(None if x == "l05" else i, text[x], x) for i, x in enumerate(langs)]
    rows += [(1000 + i, text[x], x) for i, x in enumerate(langs[:9]) if x not in ("l03", "l05")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.training_sample(df)
    assert sorted(sample) == langs and max(len(t) for x in sample.values() for t in x) == 16_384
    got = language.identify(df, language.fit(sample), keep=("lang",)).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_repeats_of_a_row_crowd_out_nothing(spark):
    texts = [f"eine Zeile Nummer {i} auf deutsch" for i in range(40)]
    rows = [(texts[0], "de")] * 5000 + [(t, "de") for t in texts] + [(f"une ligne {i}", "fr") for i in range(3)] + [("x" * 40_000, "xx")]
    got = language.training_sample(spark.createDataFrame(rows, "text string, lang string"), docs_per_lang=30)
    assert {k: len(v) for k, v in got.items()} == {"de": 30, "fr": 3, "xx": 1} and len(set(got["de"])) == 30


def test_code_lengths_equal_brute_force():
    """Prediction by partial matching with full exclusion, one byte and one context at a time."""
    samples = {"a": [b"abracadabra abra", b"cab"], "b": [b"banana bandana", b"nab ban"]}
    order = 2
    model = language.fit(samples, order)

    def counts(lang):
        seen = {}
        for t in samples[lang]:
            padded = b"\n" * order + t
            for i in range(order, len(padded)):
                for d in range(order + 1):
                    c = seen.setdefault(padded[i - d : i], {})
                    c[padded[i]] = c.get(padded[i], 0) + 1
        return seen

    def p(seen, context, byte):
        below = p(seen, context[1:], byte) if context else 1 / 256
        here = seen.get(context)
        if not here:
            return below
        total, kinds = sum(here.values()), len(here)
        if byte in here:
            return here[byte] / (total + kinds)
        free = 1 - sum(p(seen, context[1:], x) if context else 1 / 256 for x in here)
        return kinds / (total + kinds) * below / free

    text = b"a banana cab"
    for i, lang in enumerate(model.langs):
        seen, padded = counts(lang), b"\n" * order + text
        bits = -sum(np.log2(p(seen, padded[k - order : k], padded[k])) for k in range(order, len(padded)))
        assert abs(model.lengths([text])[0, i] / language.UNIT - bits) < 0.01 * len(text)


def test_held_out_is_the_crc(spark):
    got = spark.range(40).select(F.col("id").alias("doc_id")).select("doc_id", language.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_code_lengths_are_those_of_a_distribution():
    model = language.fit({"x": [b"abracadabra abracadabra", b"abc"], "y": [b"zzz"]}, order=2)
    for context in (b"", b"ab", b"qq", b"ra", b"zz"):
        whole = model.lengths([context + bytes([b]) for b in range(256)]) - model.lengths([context] * 256)
        assert np.exp2(-whole / language.UNIT).sum(0) == pytest.approx([1, 1], abs=0.02)


# 3. HTML


def test_html_regions_entities_and_blocks():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body class='has-sidebar'><header>Site</header><nav><ul><li><a href='/'>x</a></ul></nav><div class='ad'>Buy &amp; go</div>"
        "<main><h1>T &eacute; &#x27;q&#39;</h1><p>One  two<br>three <span class=ad>buy</span> four.<p>Five <b>si</b>x<script>var a='</p>'</script></p><p>x</p><form>f<input></form>"
        "<aside>side</aside><section id=comments><p>first!</p></section></main><footer>z</footer></body></html>"
    )
    assert html_text.main_text(page) == "T é 'q'\nOne two three four.\nFive six\nx"
    for odd in (None, "", "<", "<<<>>", "<p", "<!--", "<script>never closed", "</p></div>", "<a" * 5000):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("just text") == "just text" and html_text.main_text("<nav>only menu</nav>") == ""


def test_html_without_article():
    body = "".join(f"<p>{'Long paragraph of content number %d goes on and on here. ' % i * 3}</p>" for i in range(4))
    got = html_text.main_text(f"<body><div id='menu'><a>a</a><a>b</a></div><div><h2>Head</h2>{body}<p>ok</p></div><div class='sidebar'><p>s</p></div></body>")
    assert got.startswith("Head\nLong") and got.endswith("\nok") and got.count("\n") == 5


def test_html_wrappers_do_not_empty_a_page():
    text = "Words of the article go on for a while. " * 5
    for wrapper in ("layout with-sidebar", "post comments-open"):
        assert html_text.main_text(f"<body><div class='{wrapper}'><article><h1>H</h1><p>{text}</p></article><div class='sidebar'>side</div></div><p>left</p></body>") == f"H\n{text.strip()}"
        got = html_text.main_text(f"<div class='{wrapper}'><div><p>{text}</p></div><div class='comments'><p>{text}{text}</p></div></div>")
        assert got == text.strip()
    # Comments stay out even where they are articles and longer than the article.
    assert html_text.main_text(f"<main><p>{text}</p></main><div id='comments'><article>{text}{text}</article></div>") == text.strip()
    inner = f"<div class='post comments-open'><article><p>{text}</p><section class='comments'>{text}{text}</section></article></div>"
    assert html_text.main_text(inner) == text.strip()


def test_html_math_inside_the_article_stays():
    assert html_text.main_text("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == "so x=2 holds"


def test_html_threshold_decides(monkeypatch):
    """Where no name says so, the smoothed ratio tells content from the rest; without the threshold all of it stays."""
    links = "".join(f"<a href='/{i}'>l{i}</a> " for i in range(12))
    text = "".join(f"<p>{'Sentences that a reader came for, one after the other. ' * 4}</p>" for _ in range(5))
    plain = f"<body><div>{links}</div><div>{links}</div><div>{text}</div><div>{links}</div><div>{links}</div><div>Copyright 2020 all</div></body>"
    cards = f"<body><article><h2>{links}</h2></article><article><p>{links}</p></article><article>{text}</article><article>{links}</article><article>{links}</article></body>"
    want = "\n".join(["Sentences that a reader came for, one after the other. " * 4] * 5).replace(" \n", "\n").strip()
    assert html_text.main_text(plain) == want == html_text.main_text(cards)
    # An article element of links only does not win over a container of text.
    assert html_text.main_text(f"<body><article>{links}</article><div>{links}</div><div>{text}</div></body>") == want
    monkeypatch.setattr(html_text, "threshold", lambda values: float("-inf"))
    assert "l3" in html_text.main_text(plain) and "l3" in html_text.main_text(cards) and "Copyright" in html_text.main_text(plain)


def test_html_pages(spark, small, none):
    got = html_text.extract(spark.read.parquet(f"{small}/pages.parquet")).collect()
    assert len(got) == 50 and all(len(r["text"]) == r["n_chars"] > 0 for r in got)
    o = spark.createDataFrame([(1, None, None), (1, None, ""), (None, "u", "<p>a")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted(r["text"] for r in html_text.extract(o).collect()) == ["", "", "a"]
    assert html_text.extract(o.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_html_pages_equal_the_article_element(spark, sf):
    """Of the test pages, which have one article each, an independent reading by regular expressions."""

    def want(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [re.sub(r"<[^>]*>", "", x.replace("<br>", " ")) for x in re.split(r"</?(?:p|h1|ul|li)>", inner)]
        return "\n".join(x for p in parts if (x := " ".join(html.unescape(p).split())))

    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    texts = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {i: want(t) for i, t in texts.items()}


# 4. Hamming search


def test_top_k_equals_brute_force(spark, none):
    g = np.random.default_rng(0)
    v = g.normal(size=(300, 40)).astype(float)
    v[100:120] = v[0]
    data = [(i, v[i].tolist()) for i in range(300)] + [(7, v[7].tolist()), (None, v[1].tolist()), (350, None), (400, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("code", F.lit("x"))
    got = hamming_search.top_k(df, k=7, bits=40, shard_rows=64).collect()
    ids = np.array([i for i, x in data if i is not None and x is not None])
    codes = np.array([np.r_[np.array(x) >= 0, np.zeros(40 - len(x), bool)] for i, x in data if i is not None and x is not None])
    want = []
    for q in sorted({int(i) for i in ids if i % 50 == 0}):
        d = (codes != codes[list(ids).index(q)]).sum(1)
        want += [(q, k + 1, int(ids[j]), int(d[j])) for k, j in enumerate(np.lexsort((ids, d))[:7])]
    assert sorted(tuple(r) for r in got) == want
    assert hamming_search.top_k(df.limit(0)).count() == 0


# 5. Exact substrings


def removed(texts: dict, length: int) -> dict:
    seen, out = {}, {}
    for i in sorted(texts):
        b, mask = texts[i], bytearray(len(texts[i]))
        for p in range(len(b) - length + 1):
            first = seen.setdefault(b[p : p + length], i)
            if first < i:
                mask[p : p + length] = b"\1" * length
        out[i] = mask
    return out


@pytest.mark.parametrize("seed", range(3))
def test_substrings_equal_brute_force(spark, seed):
    g = np.random.default_rng(seed)
    words = [bytes(g.integers(97, 100, g.integers(1, 6))).decode() for _ in range(40)]
    shared = [" ".join(g.choice(words, 20)) for _ in range(4)]
    texts = {int(i): " ".join(x for _ in range(6) for x in (shared[g.integers(4)] if g.random() < 0.5 else " ".join(g.choice(words, 12)), "é")) for i in g.permutation(60)}
    texts[100], texts[101], texts[102] = "a" * 300, "a" * 49, "b" * 20 + "a" * 60
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in exact_substrings.remove_repeats(df, buckets=3).collect()}
    for i, mask in removed({i: t.encode() for i, t in texts.items()}, 50).items():
        kept = bytes(c for c, m in zip(texts[i].encode(), mask, strict=True) if not m)
        runs = len(bytes(mask).replace(b"\0", b" ").split())
        assert (got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (sum(mask), runs, kept)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_substrings_odd_rows(spark, odd, none):
    got = exact_substrings.remove_repeats(odd, text=False).collect()
    assert len(got) == 11 and Counter(r["n_removed"] for r in got if r["doc_id"] == 2) == {70: 2}
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] in (1, 3, 4, 6, 7, 8))
    assert exact_substrings.remove_repeats(none).count() == 0


@pytest.mark.parametrize("more", [0, 19, 20, 30, 49, 50])
def test_anchors_behind_a_whole_number_of_chunks(monkeypatch, more):
    monkeypatch.setattr(exact_substrings, "CHUNK", 1000)
    data = np.concatenate([np.random.default_rng(6).integers(0, 256, 3000 + more - 40), np.full(40, 7)]).astype(np.uint8)
    got = exact_substrings.anchors(data, 50, 20)
    monkeypatch.setattr(exact_substrings, "CHUNK", 1 << 18)
    want = exact_substrings.anchors(data, 50, 20)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, want, strict=True))


def test_suffix_sort_orders_and_verifies():
    g = np.random.default_rng(0)
    ctx = g.integers(97, 99, (200, 30)).astype(np.uint8)
    ctx[50:60] = ctx[0]
    group = np.sort(g.integers(0, 5, 200))
    up, _ = shingles.powers(30)
    p = np.concatenate([np.zeros((200, 1), np.uint64), np.cumsum((ctx.astype(np.uint64) + np.uint64(1)) * up[:30], axis=1, dtype=np.uint64)], 1)
    order = exact_substrings.suffix_sort(p, ctx, np.full(200, 4), group, 26)
    assert [(group[i], bytes(ctx[i, 4:])) for i in order] == sorted((x, bytes(c[4:])) for x, c in zip(group, ctx, strict=True))


# 6. Fuzzy lines


def test_lines_equal_brute_force(spark):
    g = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    base = [list(g.choice(words, n)) for n in (6, 12, 30, 60, 150)]
    texts = []
    for i in range(60):
        lines = []
        for _ in range(4):
            x = list(base[g.integers(len(base))])
            for _ in range(g.integers(0, 3)):
                x[g.integers(len(x))] = str(g.choice(words))
            lines.append(" ".join(x) + "." * int(g.integers(2)))
        texts.append((i, "\n".join([*lines, "", "!!!"])))
    got = {r["doc_id"]: r for r in fuzzy_lines.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    seq = {(i, n): x.replace(".", "").split() for i, t in texts for n, x in enumerate(t.split("\n")) if n < 4}
    first = dict(zip(seq, (r == k for k, r in enumerate(roots(list(seq.values())))), strict=True))
    for i, t in texts:
        want = [x for n, x in enumerate(t.split("\n")) if first.get((i, n), True)]
        assert got[i]["text"] == "\n".join(want) and got[i]["n_lines"] == 6 and got[i]["n_removed"] == 6 - len(want)


@pytest.mark.parametrize(("common", "words"), [(64, 1 << 20), (1 << 40, 64)])
def test_lines_by_edits_alone_equal_brute_force(spark, monkeypatch, common, words):
    """All grams in small buckets, or (with no gram counted as rare) all of them by aggregation."""
    monkeypatch.setattr(fuzzy_lines, "COMMON", common)
    monkeypatch.setattr(fuzzy_lines, "WORDS", words)
    g = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = []
    for n in (4, 5, 6, 9, 10, 15, 16, 19, 20, 21, 40, 80, 120):
        for _ in range(6):
            base = list(g.choice(vocabulary, n))
            for _ in range(3):
                x = list(base)
                for _ in range(g.integers(0, n // 4 + 2)):
                    k, at = g.integers(3), int(g.integers(len(x)))
                    x[at : at + int(k != 1)] = [] if k == 2 else [str(g.choice(vocabulary))]
                texts.append(" ".join(x))
    texts += ["ha " * 30, "ha " * 11, "ha " * 10, "ha " * 4, "ha ho ha ho ha"]
    got = {r["doc_id"]: r["n_removed"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = roots([t.split() for t in texts])
    assert got == {i: int(r != i) for i, r in enumerate(want)} and 40 < sum(got.values()) < 180


def test_edits_spread_evenly_leave_a_block(spark):
    """Every fifth word changed: the stretches in common are as short as they can be."""
    texts = []
    for n in (5, 6, 10, 11, 15, 16, 20, 25, 50, 100, 400):
        base = [f"n{n}w{i}" for i in range(n)]
        texts += [" ".join(base), " ".join(f"x{i}" if i % 5 == 4 else w for i, w in enumerate(base))]
    got = fuzzy_lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: i % 2 for i in range(len(texts))}


def test_lines_of_the_same_words_meet_each_other(spark):
    b = [f"w{i}" for i in range(20)]
    kinds = [b, [*b[1:10], b[0], *b[10:]]]  # one word moved
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(kinds + [list(g) for g in (b[::-1], b[1::2] + b[::2], b[::2] + b[1::2], b[10:] + b[:10])])], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in fuzzy_lines.dedup_lines(df).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0}


def test_lines_lose_marks_and_blanks_anywhere(spark):
    texts = ["Home | About", "Home About", "home\u00a0about", "Home\x0b\u2013 About\f", "Terms, privacy", "\u201cTerms\u201d privacy\r"]
    got = fuzzy_lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1}


def test_word_ranks_count_all_lines(spark):
    texts = [(i, f"ein{i} zwei{i} und drei{i % 5} oder\nund noch eine Zeile {i}") for i in range(40)]
    lines = fuzzy_lines.lines_of(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    rank, common = fuzzy_lines._ranks(lines)
    found, n = np.unique(np.concatenate([np.frombuffer(r["w"], "<u2") for r in lines.select("w").collect()]), return_counts=True)
    assert {int(c): int(rank[c]) for c in np.flatnonzero(rank)} == {int(c): int(8 * np.log2(1 + k)) for c, k in zip(found, n, strict=True)}
    assert common == int(8 * np.log2(1 + 80 / fuzzy_lines.COMMON))


def test_long_lines_of_repeated_words_are_close_only_if_similar(spark):
    """Runs of a few words: their mere parities, or 256 classes for hundreds of words, tell nothing."""
    runs = [" ".join(f"{w} " * 55 for w in ["the", *[f"r{i}x{j}" for j in range(7)]]) for i in range(6)]
    mixed = [" ".join(f"m{i}x{j}" for j in range(400 + 600 * (i % 2))) for i in range(6)]
    similar = [" ".join("new" if j % 5 == 4 else w for j, w in enumerate(t.split())) for t in (runs[0], mixed[0], mixed[1])]
    texts = list(enumerate([*runs, *mixed, *similar]))
    lines = fuzzy_lines.lines_of(spark.createDataFrame(texts, "doc_id long, text string"))
    close = lines.alias("a").join(lines.alias("b"), fuzzy_lines._close(80)).selectExpr("a.did as a", "b.did as b").where("a < b")
    assert sorted((r["a"], r["b"]) for r in close.collect()) == [(0, 12), (6, 13), (7, 14)]


def test_lines_of_other_lengths_are_close_only_with_fewer_replaced_words(spark):
    """Of 20 edits of 100 words 16 leave words out: 4 replaced ones are left, and 24 parities that can change."""
    words = [f"w{j}" for j in range(100)]
    shorter, other = words[:80], [*words[:74], *[f"v{j}" for j in range(10)]]
    lines = fuzzy_lines.lines_of(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate([words, shorter, other])], "doc_id long, text string"))
    close = lines.alias("a").join(lines.alias("b"), fuzzy_lines._close(80)).selectExpr("a.did as a", "b.did as b").where("a = 0 and b > 0")
    assert [(r["a"], r["b"]) for r in close.collect()] == [(0, 1)]


def test_lines_nearly_similar_meet_once_though_they_share_dozens_of_blocks(spark, monkeypatch):
    g = np.random.default_rng(5)
    texts = []
    for i in range(10):
        words = [f"w{j}" for j in range(150)]
        for j in g.choice(150, 20, replace=False):
            words[j] = f"v{i}x{j}"
        texts.append((i, " ".join(words)))
    docs, met = spark.createDataFrame(texts, "doc_id long, text string"), []
    pairs = fuzzy_lines._pairs_met

    def counted(x, percent):
        out = pairs(x, percent)
        met.append((out.count(), out.select(F.least("a.h", "b.h"), F.greatest("a.h", "b.h")).distinct().count()))
        return out

    monkeypatch.setattr(fuzzy_lines, "_pairs_met", counted)
    now = sorted((r["doc_id"], r["n_removed"]) for r in fuzzy_lines.dedup_lines(docs).collect())
    monkeypatch.setattr(fuzzy_lines, "FIRST", 1 << 20)  # no line remembers its blocks
    assert sorted((r["doc_id"], r["n_removed"]) for r in fuzzy_lines.dedup_lines(docs).collect()) == now
    (rows, different), (all_rows, same) = met
    assert different == same > 10 and rows <= 2 * different and all_rows > 10 * different


def test_op6_drops_a_line_with_one_changed_word(spark, tmp_path):
    base = [f"w{i}" for i in range(10)]
    spark.createDataFrame([(1, " ".join(base)), (2, " ".join(["other", *base[1:]]))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r["doc_id"], r["n_removed"]) for r in queries.op6_fuzzy_lines(spark, str(tmp_path)).collect()) == [(1, 0), (2, 1)]


def test_lines_odd_rows(spark, odd, none):
    got = fuzzy_lines.dedup_lines(odd, keep=("lang", "source")).collect()
    assert len(got) == 11 and [r["text"] for r in got if r["doc_id"] == 2] == ["", ""] and [r["text"] for r in got if r["doc_id"] == 3] == [None]
    assert [r["n_removed"] for r in got if r["doc_id"] in (1, 5, 6, 7)] == [0, 0, 0, 0]
    assert fuzzy_lines.dedup_lines(none).count() == 0


# 7. Jaccard join


@pytest.mark.parametrize("region_shingles", [6_000_000, 300])
def test_jaccard_components_equal_brute_force(spark, region_shingles):
    g = np.random.default_rng(2)
    words = [f"w{i}" for i in range(2000)]
    base = [list(g.choice(words, int(n))) for n in g.integers(30, 150, 12)]
    texts = []
    for i in g.permutation(150):
        x = list(base[g.integers(12)])
        for _ in range(g.integers(0, 5)):
            x[g.integers(len(x))] = "NEW" + str(g.integers(10**6))
        texts.append((int(i), " ".join(x)))
    texts += [(500, "a b"), (501, "A  b"), (502, "a b c"), (503, ""), (504, None), (505, "common")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components_by_jaccard(df, words=4, num=85, den=100, region_shingles=region_shingles).collect()}
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: (len(s), find(i)) for i, s in sets.items()} and len({c for _, c in got.values()}) < 100


def test_jaccard_common_shingles_are_found_in_any_number_of_documents(spark, monkeypatch):
    """A passage in a twentieth of the documents brought all of these together, from a few thousand documents on."""
    monkeypatch.setattr(jaccard_join, "SAMPLE_DOCS", 10)
    passage = " ".join(f"p{j}" for j in range(30))
    texts = [(i, " ".join(f"d{i}x{j}" for j in range(30)) + (" " + passage if i % 20 == 0 else "")) for i in range(3200)]
    common = jaccard_join._common_shingles(spark.createDataFrame(texts, "doc_id long, text string"), 5)
    found = set(np.concatenate(common[:1]).tolist())
    assert found == set(shingles.shingle_sets([passage.encode()], 5)[0].tolist())


def test_jaccard_commonest_shingles_stand_last():
    s = np.arange(1, 11, dtype=np.uint64)
    common, rank = np.array([2, 4, 6], np.uint64), np.array([30, 10, 20], np.uint8)
    assert jaccard_join.ordered_prefix(s, common, rank, 0, 100).tolist() == [1, 3, 5, 7, 8, 9, 10, 4, 6, 2]


def test_jaccard_odd_rows(odd, none):
    got = jaccard_join.components_by_jaccard(odd).collect()
    assert len(got) == 11 and [r["component_id"] for r in got if r["doc_id"] == 2] == [1, 1] and {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    assert jaccard_join.components_by_jaccard(none).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(1001, 1050)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 1000 for i in range(1000, 1050)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_are_connected_by_the_driver_in_two_jobs(spark, monkeypatch):
    """The rest of the jobs make the edges; each round of the tables takes several, and memory of the driver."""
    g = np.random.default_rng(7)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in g.integers(-90, 90, (80, 2))] + [(i, i + 1) for i in range(100, 140)], "a long, b long")
    found, jobs = [], []
    for few in (_common.EDGES, 0):
        monkeypatch.setattr(_common, "EDGES", few)
        spark.sparkContext.setJobGroup(f"edges{few}", "")
        found.append({r["node"]: r["root"] for r in components(edges).collect()})
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"edges{few}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] and len(set(found[0].values())) > 5 and found[0][140] == 100
    assert jobs[0] <= 8 and jobs[1] > 3 * jobs[0]


def test_squeeze_round_trip(odd, none):
    packed = squeeze(odd.select("doc_id", "text", "lang"), "text")
    assert dict(packed.dtypes)["text"] == "binary"
    assert squeeze(packed, "text", back=True).exceptAll(odd.select("doc_id", "text", "lang")).count() == 0
    assert squeeze(none.select("text"), "text").count() == 0


# 8. Audio


def test_media_round_trip_and_tensors(odd, none):
    got = audio.media_columns(odd).collect()
    assert len(got) == 11
    for r in got:
        back, rate = audio.from_wav(bytes(r["media"]))
        assert rate == audio.RATE_IN and len(back) == r["payload_bytes"] and len(back) % 576 == 0 < len(back) and back[r["n_bytes"] :] == b"\xff" * (len(back) - r["n_bytes"])
        assert hashlib.sha256(back).hexdigest() == r["payload_sha256"] and zlib.crc32(back[-32:]) == r["tail_crc32"]
        spans, tensors = audio.read_tensors(bytes(r["tensors"]))
        assert tensors.shape == (len(spans), audio.WINDOW_FRAMES, audio.MELS) and (spans[:, 0] < spans[:, 1]).all()
    assert len({str(r[1:]) for r in got if r["doc_id"] in (1, 2)}) == 1
    assert audio.media_columns(none).count() == 0


def test_resample_and_segments():
    x = np.random.default_rng(0).normal(size=400).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 5), (1, 1)):
        h = audio._sinc(up, down)
        z = np.zeros(len(x) * up, np.float32)
        z[::up] = x
        want = np.convolve(z, h)[len(h) // 2 : len(h) // 2 + len(z)][::down]
        assert audio.resample(x, up, down) == pytest.approx(want, abs=1e-5)
    tone = np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000).astype(np.float32)
    mel, _ = audio.log_mel(tone)
    peak = int(mel.astype(float).mean(0).argmax())
    assert abs(700 * (10 ** ((peak + 1) / (audio.MELS + 1) * 2595 * np.log10(1 + 4000 / 700) / 2595) - 1) - 1000) < 120
    assert audio.segments(np.array([0, 0, 4, 7, 4, 0, 4, 4, 0, 0.0])) == [(2, 5)]


def test_features_equal_brute_force(spark, tmp_path):
    """The whole feature of a text from the definitions, in double precision and with plain loops."""
    text = "".join("~" if i // 900 % 2 else chr(32 + i * i // 7 % 90) for i in range(6000))  # loud and quiet by turns
    n, payload = audio.pack_text(text)
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    h = audio._sinc(1, 2).astype(float)
    y = np.convolve(x, h)[len(h) // 2 : len(h) // 2 + len(x)][::2]
    starts = range(0, len(y) - audio.FRAME + 1, audio.HOP)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / (audio.FRAME - 1))
    wave = np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME), np.arange(audio.N_FFT // 2 + 1)) / audio.N_FFT)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    top = 2595 * np.log10(1 + audio.RATE_OUT / 2 / 700)
    edges = [hz(top * i / (audio.MELS + 1)) for i in range(audio.MELS + 2)]
    bins = [audio.RATE_OUT / 2 * k / (audio.N_FFT // 2) for k in range(audio.N_FFT // 2 + 1)]
    mel, db = [], []
    for a in starts:
        frame = y[a : a + audio.FRAME] * hann
        power = np.abs(frame @ wave) ** 2
        mel.append([np.log(sum(p * max(0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) for f, p in zip(bins, power, strict=True)) + 1e-6) for lo, mid, hi in zip(edges, edges[1:], edges[2:], strict=False)])
        db.append(10 * np.log10((frame**2).mean() + 1e-9))
    floor = np.percentile(db, 10)
    runs, run = [], []
    for i, v in enumerate([*db, -1e9]):
        if v > floor + audio.LOW_DB:
            run.append(i)
        else:
            if any(db[j] > floor + audio.HIGH_DB for j in run):
                runs.append((run[0] * audio.HOP / audio.RATE_OUT, (run[-1] * audio.HOP + audio.FRAME) / audio.RATE_OUT))
            run = []
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = audio.media_columns(df).first()
    spans, tensors = audio.read_tensors(bytes(r["tensors"]))
    got = tensors.reshape(-1, audio.MELS)
    assert r["n_frames"] == len(mel) and np.abs(got[: len(mel)].astype(float) - mel).max() < 0.02 and not got[len(mel) :].any()
    assert len(r["segments"]) == len(runs) > 0 and np.allclose([tuple(s) for s in r["segments"]], runs)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    q = queries.op8_audio_features(spark, str(tmp_path)).first()
    said = ",".join(f"{a:.3f}-{b:.3f}" for a, b in runs)
    assert q["feature"] == f"frames={len(mel)};log_mel={hashlib.sha256(bytes(r['tensors'])).hexdigest()};spans={said}" and q["media_bytes"] == 44 + len(payload)


# 9. Quality


def test_quality_on_held_out_labels(spark, odd, none):
    df, labels = docs(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(df, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("y")), "doc_id").toPandas()
    assert (got["keep"] == (got["y"] == 1)).mean() > 0.97
    no_labels = labels.limit(0)
    assert quality.score(odd, no_labels).count() == 11 and quality.score(none, labels).count() == 0
    assert {r["keep"] for r in quality.score(odd, no_labels).collect()} == {True}


def test_sparse_sites_shrink(spark):
    rows = [(i, f"same text {i} here", "en", "big" if i < 400 else "tiny") for i in range(402)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0) if i < 400 else 0) for i in range(402)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(df, labels).collect()}
    assert abs(got[1]["host_share"] - 0.75) < 0.05 and got[401]["host_share"] > 0.05


def test_shares_equal_brute_force(spark):
    """Neither a document nor a copy of its text counts; priors by moments, paths within their hosts."""
    g = np.random.default_rng(5)
    rows = [(i, f"text {i if i % 5 else i % 3}", str(g.choice(["en", "de", "fr"])), str(g.choice(["a", "b", "c", "d"], p=[0.6, 0.2, 0.15, 0.05]))) for i in range(400)]
    share = {"a": 0.9, "b": 0.3, "c": 0.6, "d": 0.5}
    good = {i: int(g.random() < share[s] - 0.2 * (lang == "de")) for i, _, lang, s in rows if i % 2}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.score(df, spark.createDataFrame(list(good.items()), "doc_id long, quality int")).collect()}
    value = {i: good.get(i, 1 / (1 + np.exp(-got[i]["evidence"]))) for i, *_ in rows}

    def strength(groups):
        """Of lists of sites, each a list of values: pooled within the lists."""
        between = free = noise = total = 0
        for sites in groups:
            t = sum(map(len, sites))
            m = sum(map(sum, sites)) / t
            between += sum(sum(s) ** 2 / len(s) for s in sites) - t * m * m - (len(sites) - 1) * m * (1 - m)
            free += t - sum(len(s) ** 2 for s in sites) / t
            noise, total = noise + t * m * (1 - m), total + t
        v = max(0, between) / free
        return min(10_000, max(1, noise / total / v - 1)) if v else 10_000

    by_path = {}
    for i, _, lang, source in rows:
        by_path.setdefault(source, {}).setdefault(lang, []).append(value[i])
    strong = strength([[sum(p.values(), []) for p in by_path.values()]])
    strong_path = strength([list(p.values()) for p in by_path.values()])
    mean = sum(value.values()) / len(value)
    for i, text, lang, source in rows:
        site = [value[j] for j, t, _, s in rows if s == source and t != text]
        path = [value[j] for j, t, x, s in rows if s == source and x == lang and t != text]
        host_share = (sum(site) + strong * mean) / (len(site) + strong)
        assert got[i]["host_share"] == pytest.approx(host_share)
        assert got[i]["path_share"] == pytest.approx((sum(path) + strong_path * host_share) / (len(path) + strong_path))


# 10. BPE


def test_bpe_equals_tiktoken(spark, small, odd, none):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    pairs = bpe.BytePairs.load(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={b: r for r, b in pairs.bytes_of.items()}, special_tokens={})
    for df in (docs(spark, small), odd):
        encoded = bpe.encode(df, path, P.PATTERN)
        texts = [t for (t,) in df.select("text").collect()]
        got = encoded.collect()
        assert [list(r["ids"]) for r in got] == [enc.encode_ordinary(t or "") for t in texts]
        assert [r["decoded_sha256"] for r in got] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
        assert [r["ids_sha256"] for r in got] == [hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t or ""))).encode()).hexdigest() for t in texts]
        assert [r["text"] for r in bpe.decode(encoded, path, P.PATTERN).collect()] == [t or "" for t in texts]
    assert bpe.encode(none, path, P.PATTERN).count() == 0
    for word in (b"a" * 3000, bytes(np.random.default_rng(0).integers(0, 256, 2000, dtype=np.uint8)), b"", b"\x00"):
        assert pairs.encode_one(word) == (enc._encode_single_piece(word) if word else [])
