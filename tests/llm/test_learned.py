"""Operators that learn, on made texts: held-out accuracy, exact search, and awkward rows."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import html, language, quality, toxicity

LEXICON = {"en": "the of and tion ing er on th", "de": "sch ung heit der und keit ein ä", "fr": "eau oi eux le ment é que ou"}


def prose(rng, lang, n):
    parts = LEXICON[lang].split()
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        lang = list(LEXICON)[i % 3]
        text = prose(rng, lang, int(rng.integers(8, 60)))
        bad, toxic = i % 8 == 0, i % 5 == 0
        if toxic:
            text += " " + " ".join(rng.choice(["vilewort", "nastywort", "foulwort"], 3)) + " x"
        if bad:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text, lang, f"src{i % 4}", int(not bad), int(toxic), "clash"))
    rows += [(900, None, None, None, None, None, "clash"), (901, "", None, "src1", 1, 0, "clash"), (902, "12 34 !!", "en", "src1", None, 0, "clash"), (903, "the and of " * 40_000, "en", "src1", 1, 0, "clash"), (903, "the and of", "en", "src1", 1, 0, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int, toxic int, score string")


def test_language(docs):
    model = language.train(docs.filter("doc_id % 4 <> 1"))
    got = {r.doc_id: r for r in language.predict(docs, model).collect() if r.doc_id != 903}
    told = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in range(240) if i % 4 == 1]
    assert np.mean([got[i].lang_pred == told[i] for i in held]) >= 0.98
    for i in (900, 901, 902):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert not any(got[i].rejected for i in range(240))
    assert language.accepted(docs, model).count() == 242
    assert language.predict(docs.limit(0), model).count() == 0
    assert language.train(docs.limit(0)) is None and language.predict(docs, None).filter("rejected").count() == 245


def test_language_rejects_what_it_never_saw(spark, docs):
    model = language.train(docs)
    strange = spark.createDataFrame([(1, "zxqj wvkz qqxz jjvk " * 30)], "doc_id long, text string")
    assert language.predict(strange, model).first().rejected


def plain_kneser_ney(words, order):
    """P(character | context) of interpolated Kneser-Ney, by recursion over the counts as defined."""
    raw = Counter(p[i - k : i + 1] for p in (f" {w} " for w in words) for i in range(1, len(p)) for k in range(min(order, i + 1)))
    of = [{} for _ in range(order)]
    of[-1] = {g: n for g, n in raw.items() if len(g) == order}
    for k in range(order - 1):
        before = Counter(g[1:] for g in raw if len(g) == k + 2)
        of[k] = {g: raw[g] if k and g[0] == " " else before[g] for g in raw if len(g) == k + 1 and (before[g] or k and g[0] == " ")}
    discounts = []
    for level in of:
        once, twice = (sum(n == x for n in level.values()) for x in (1, 2))
        discounts.append(min(0.9, once / (once + 2 * twice)) if once else 0.0)
    totals = [Counter() for _ in of]
    kinds = [Counter() for _ in of]
    for k, level in enumerate(of):
        for g, n in level.items():
            totals[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1

    def p(c, context):
        k = len(context)
        lower = p(c, context[1:]) if k else 1 / (len(of[0]) + 1)
        if not totals[k][context]:
            return lower
        left = max(discounts[k] * kinds[k][context] / totals[k][context], 1e-9)
        return max(of[k].get(context + c, 0) - discounts[k], 0) / totals[k][context] + left * lower

    return p, set(of[0]), [set(t) for t in totals], raw


def test_language_model_equals_a_plain_version():
    """Every character has a number of its own, however many there are, and probabilities of each context sum to one."""
    rng = np.random.default_rng(6)
    words = ["".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 9000, rng.integers(1, 6))) for _ in range(6000)]
    words += ["".join(rng.choice(list("abcde\U00020000"), rng.integers(1, 9))) for _ in range(400)]
    p, letters, contexts, counts = plain_kneser_ney(words, language.ORDER)
    assert len(letters) > 5000
    model = language.build({"x": dict(counts)})
    asked = words[::40] + ["abc\u0416", "\u0416", "eeeeeeee", words[0] + words[1]]
    sums, sizes = model.score_words(asked)
    assert sizes.tolist() == [len(w) + 1 for w in asked]
    for word, got in zip(asked, sums[:, 0]):
        text = f" {word} "
        want = sum(np.log(p(text[i], text[max(0, i + 1 - language.ORDER) : i])) for i in range(1, len(text)))
        assert got == pytest.approx(want, rel=1e-9)
    for level in contexts:
        for context in sorted(level)[:4] + sorted(level)[-4:]:
            assert sum(p(c, context) for c in letters) + p("\u0416", context) == pytest.approx(1, abs=1e-6)


def test_scoring_holds_little_and_each_text_alone():
    """A piece of text takes a bounded multiple of its size, whatever the words and languages; neighbours change no digit."""
    rng = np.random.default_rng(5)
    counts = {f"l{j}": dict(Counter(w[:k] for w in ("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(50)) for k in range(1, 5))) for j in range(12)}
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(200)) for _ in range(1000)]
    model = language.build(counts)
    model.score(pa.array(texts[:1]))  # loads what Arrow loads on first use
    model.forget()
    tracemalloc.start()
    many = model.score(pa.array(texts))[0]
    peak = tracemalloc.get_traced_memory()[1] - sum(x.nbytes for x in (model._sums, model._sizes))
    tracemalloc.stop()
    assert peak < 50 * sum(map(len, texts))
    model.forget()
    assert (many[7:9] == model.score(pa.array(texts[7:9]))[0]).all()


def test_workers_give_memory_back(spark):
    """What a worker holds after a task that took much, beside what it held before, in MB."""
    from gleaner.llm import common

    def run(batches):
        held = [pa.array(["x" * 5000] * 20000) for _ in range(2)] + [bytes(60000) for _ in range(4000)]
        yield from batches
        del held

    def told(batches):
        for batch in batches:
            with open("/proc/self/statm") as f:
                yield pa.RecordBatch.from_arrays([pa.array([int(f.read().split()[1]) * 4096 >> 20])], ["mb"])

    one = spark.range(0, 1, 1, 1)
    before = max(r.mb for r in one.mapInArrow(told, "mb long").collect())
    assert one.mapInArrow(common.lean(run), "id long").count() == 1
    assert max(r.mb for r in one.mapInArrow(told, "mb long").collect()) < before + 60


def test_probabilities_sum_to_one():
    counts = {"x": {}}
    for word in ("abba", "ab", "ba", "bab"):
        padded = f" {word} "
        for i in range(1, len(padded)):
            for k in range(1, min(3, i + 1) + 1):
                g = padded[i + 1 - k : i + 1]
                counts["x"][g] = counts["x"].get(g, 0) + 1
    logp, back, _ = language._kneser_ney(counts["x"], 3)
    uniform = 1 / (len(logp[0]) + 1)
    for context, weight in back[0].items():
        seen = sum(np.exp(p) for g, p in logp[0].items())
        assert seen + np.exp(weight) * uniform == pytest.approx(1.0)


def test_quality(docs):
    model = quality.train(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    assert all(got[i].keep == (i % 8 != 0) for i in range(240))
    assert len(got) == 244 and all(0 <= r.quality <= 1 for r in got.values())
    assert quality.classify(docs.limit(0), model).count() == 0
    assert quality.train(docs.limit(0).select("doc_id", "text"), docs.select("doc_id", "quality")) is None
    assert quality.classify(docs, None).filter("keep").count() == 245


def test_sparse_sites_shrink_to_the_global_rate(spark):
    rows = [(i, "good words stand here", "big", "a") for i in range(60)] + [(100, "bad%%% bad%%%", "small", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model = quality.Model(np.zeros(len(quality.FEATURES)), np.ones(len(quality.FEATURES)), np.zeros(2 * len(quality.FEATURES) + 1), 0.5)
    model.weights[FEATURE := quality.FEATURES.index("symbols")] = -20
    model.weights[-1] = 3
    rates = {r.doc_id: r.host_rate for r in quality.classify(docs, model).collect()}
    alone = 1 / (1 + np.exp(12))
    assert rates[0] > rates[100] > alone


def test_toxicity(docs):
    index = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic").filter("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    held = [i for i in range(240) if i % 3 == 1]
    assert np.mean([(got[i].score >= 0.7) == (i % 5 == 0) for i in held]) >= 0.97
    assert got[900].score == got[901].score < 0.3 and not got[900].neighbours
    # texts of label 0 have neighbours as well
    assert any(x.neighbours for i, x in got.items() if i < 240 and i % 5)
    assert toxicity.score(docs.limit(0), index).count() == 0
    assert toxicity.train(docs.select("doc_id", "text"), docs.limit(0).select("doc_id", "toxic")) is None
    assert toxicity.score(docs, None).filter("score = 0").count() == 245


@pytest.mark.parametrize("terms", [40, 3000])
def test_search_is_exact(terms):
    rng = np.random.default_rng(7)
    n = 500
    index = toxicity.Index([b"%d" % t for t in range(terms)], rng.uniform(1, 4, terms), list(range(n)), rng.integers(0, 2, n).astype(float), np.ones(n))
    vectors = [index.vector(tuple(t := sorted(rng.choice(terms, rng.integers(0, 6), replace=False).tolist())), tuple(rng.integers(1, 4, len(t)).tolist())) for _ in range(n)]
    index.fill(vectors)
    dense = np.zeros((n, terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, list(t)] = w
    for t, w in vectors[:60]:
        sims = dense[:, list(t)] @ w if t else np.zeros(n)
        want = sorted(sims[sims > 0])[::-1][: toxicity.NEIGHBOURS]
        assert [s for s, _ in index.nearest(t, w)] == pytest.approx(list(want), abs=2e-5)


PAGE = '<html><head><title>T</title></head><body><nav>menu one</nav><div class="ad">buy</div><article><h1>T &amp; x</h1><p>one <b>two</b>\n three<p>four<form>f</form><aside>no</aside></article><section id="comments"><p>me too</p></section><footer>(c)</footer>'


def test_main_text():
    assert [t for k, t in html.blocks(PAGE) if k == html.ARTICLE] == ["T & x", "one two three", "four"]
    assert {t for k, t in html.blocks(PAGE) if k == html.BESIDE} == {"menu one", "buy", "f", "no", "me too", "(c)"}
    assert html.blocks(None) == [] == html.blocks("<script>x</script>")
    assert html.blocks("a < b<p>c") == [(html.OPEN, "a < b"), (html.OPEN, "c")]


def test_repeated_substrings():
    pages = [[1, 2, 3, 4, 5, 6, 7], [9, 1, 2, 3, 4, 5, 8], [3, 4, 5], []]
    assert [c.astype(int).tolist() for c in html.repeated(pages)] == [[1, 1, 1, 1, 1, 0, 0], [0, 1, 1, 1, 1, 1, 0], [0, 0, 0], []]
    rng = np.random.default_rng(4)
    pages = [rng.integers(0, 3, int(rng.integers(0, 40))).tolist() for _ in range(12)]
    seen = {}
    for i, p in enumerate(pages):
        for k in range(len(p) - html.RUN + 1):
            seen.setdefault(tuple(p[k : k + html.RUN]), set()).add(i)
    for p, got in zip(pages, html.repeated(pages)):
        want = np.zeros(len(p), bool)
        for k in range(len(p) - html.RUN + 1):
            if len(seen[tuple(p[k : k + html.RUN])]) >= html.PAGES:
                want[k : k + html.RUN] = True
        assert (got == want).all()


def test_host_boilerplate_goes(spark):
    note = "please read our long notice about nothing at all"
    rows = [(i, f"https://www.h{i % 2}.org/{i}", f"<div>{note}</div><p>own text of page {i} which is quite unique {i}{i} indeed</p>", 1) for i in range(10)]
    rows += [(20, "https://h0.org/x", None, 1), (21, None, "", 1), (22, "https://alone.org/", f"<p>{note}</p>", 1), (23, "https://h0.org/c", PAGE, 1)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert all(got[i].text == f"own text of page {i} which is quite unique {i}{i} indeed" for i in range(10))
    assert got[20].text == got[21].text == "" and got[22].text == note and got[23].text == "T & x\none two three\nfour"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_a_host_of_many_arrays_loses_no_repeated_passage(spark):
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(12))
    rows = [(i, f"https://big.org/{i}", f"<p>passage of two pages number n{i // 2} and no more of it</p><p>{own(i)}</p>") for i in range(40)]
    rows += [(100 + i, "https://small.org/", f"<p>said on both pages of it</p><p>{own(i)}</p>") for i in range(2)]
    rows += [(200, "https://big.org/copy", f"<p>{own(0)}</p>"), (201, None, f"<p>{own(1)}</p>"), (202, "https://big.org/é", "<p>few words</p>"), (202, "https://big.org/é", "<p>few words</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, many = ([tuple(r) for r in html.extract(table, chars=c).collect()] for c in (html.ARRAY_CHARS, 600))
    assert sorted(one, key=str) == sorted(many, key=str)
    assert {r[0]: r[2] for r in many}[7] == own(7) and sum(r[4] for r in many) == 41 == sum(r[5] for r in many)


def test_unclosed_and_doubtful_elements():
    kinds = lambda page: [(k, t) for k, t in html.blocks(page)]
    assert kinds("<article><p>a</p><button>x<p>rest of the page</p></article>") == [(2, "a"), (2, "rest of the page")]
    assert kinds("<p>a<textarea>b<p>c</p><script>var x = '<p>';") == [(1, "a"), (1, "c")]
    assert kinds("<p>a <button><div>b</div></button>c <!-- d > e</p>") == [(1, "a c e")]
    # a teaser is not the article; a doubtful name inside an article needs the host's word
    assert [k for k, _ in kinds('<article>teaser</article><div id="content">the long text of the page</div>')] == [1, 1]
    assert kinds('<article><p>one and two and three</p><p class="reply-letter">four</p><p class="reply">five</p></article>') == [(2, "one and two and three"), (1, "four"), (0, "five")]


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a x=\"'" * 150_000, "<!--" * 250_000, "<button>" * 100_000 + "</button>", '<a x=">" ' * 100_000, "<" * 1_000_000, "<a" + "b" * 1_000_000, "<svg " * 200_000])
def test_scan_is_linear(page):
    import time

    began = time.process_time()
    html.blocks(page)
    assert time.process_time() - began < 10  # seconds for a megabyte; a quadratic scan takes an hour


def test_extraction_of_whole_hosts(spark):
    """Against a plain version: every open block is kept unless windows that two pages of the host share cover it."""
    rng = np.random.default_rng(9)
    notes = [" ".join(f"note{n}w{k}" for k in range(int(rng.integers(3, 20)))) for n in range(6)]
    rows = []
    for i in range(60):
        own = [" ".join(f"w{rng.integers(0, 40)}" for _ in range(int(rng.integers(1, 30)))) for _ in range(3)]
        parts = [f"<p>{own[0]}</p>", f"<div>{notes[rng.integers(0, 6)]}</div>", f"<nav>{notes[rng.integers(0, 6)]}</nav>", f"<p>{own[1]}</p>", f"<p>{own[2]} {notes[rng.integers(0, 6)]}</p>"]
        body = "".join(parts[k] for k in rng.permutation(5))
        rows.append((i, f"https://h{i % 3}.org/{i}", f"<article>{body}</article>" if i % 10 == 0 else body))
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), chars=2000).collect()}
    held = {i: html.blocks(page) for i, _, page in rows}
    for i, _, page in rows:
        seen = {}
        for j in range(i % 3, 60, 3):
            stream = [w for k, t in held[j] if k != html.ARTICLE for w in t.split()]
            for a in range(len(stream) - html.RUN + 1):
                seen.setdefault(tuple(stream[a : a + html.RUN]), set()).add(j)
        stream = [w for k, t in held[i] if k != html.ARTICLE for w in t.split()]
        cover = np.zeros(len(stream), bool)
        for a in range(len(stream) - html.RUN + 1):
            if len(seen[tuple(stream[a : a + html.RUN])]) >= html.PAGES:
                cover[a : a + html.RUN] = True
        at, kept, gone, again = 0, [], 0, 0
        for k, t in held[i]:
            n = len(t.split()) if k != html.ARTICLE else 0
            bad = n and cover[at : at + n].mean() >= html.COVERED
            at += n
            if k == html.BESIDE or bad:
                gone, again = gone + 1, again + bool(bad)
            else:
                kept.append(t)
        if not kept:
            kept = [t for k, t in held[i] if k != html.BESIDE]
            gone, again = gone - len(kept), again - len(kept)
        assert (got[i].text, got[i].n_boilerplate, got[i].n_repeated) == ("\n".join(kept), gone, again)
    assert any(r.n_repeated for r in got.values()) and not all(r.n_boilerplate == 0 for r in got.values())


def test_site_posteriors_equal_a_plain_version(spark, docs):
    labels = docs.filter("doc_id % 3 <> 0").select("doc_id", "quality")
    model = quality.train(docs, labels)
    got = quality.classify(docs, model, labels=labels).collect()
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()]
    alone = {(r.doc_id, round(r.doc_quality, 9)) for r in quality.classify(docs, model).collect()}
    assert {(r.doc_id, round(r.doc_quality, 9)) for r in got} == alone
    told = {r.doc_id: float(r.quality > 0) for r in labels.collect() if r.quality is not None}
    site = {i: (s, g) for i, _, s, g in rows}
    own = [(site[r.doc_id], told.get(r.doc_id, r.doc_quality), r) for r in got]

    def groups(of):
        held = {}
        for key, value, _ in own:
            held.setdefault(of(key), []).append(value)
        return held

    def weight(held, rate):
        n = sum(map(len, held.values()))
        within = sum(sum(v * v for v in x) - sum(x) ** 2 / len(x) for x in held.values()) / max(n - len(held), 1)
        spread = sum(len(x) * (sum(x) / len(x) - rate(k)) ** 2 for k, x in held.items()) / n
        return min(quality.WEIGHT[1], max(quality.WEIGHT[0], within / max(spread - within * len(held) / n, 1e-9)))

    hosts, paths = groups(lambda k: k[0]), groups(lambda k: k)
    top = sum(v for _, v, _ in own) / len(own)
    a = weight(hosts, lambda k: top)
    b = weight(paths, lambda k: (sum(hosts[k[0]]) + a * top) / (len(hosts[k[0]]) + a))
    for key, value, r in own:
        host = (sum(hosts[key[0]]) - value + a * top) / (len(hosts[key[0]]) - 1 + a)
        path = (sum(paths[key]) - value + b * host) / (len(paths[key]) - 1 + b)
        odds = np.log(r.doc_quality / (1 - r.doc_quality)) + np.log(path / (1 - path)) - np.log(top / (1 - top))
        assert (r.host_rate, r.path_rate, r.quality) == pytest.approx((host, path, 1 / (1 + np.exp(-odds))), abs=1e-6)
    assert quality.classify(docs.limit(0), model, labels=labels).count() == 0
    assert quality.classify(docs, None, labels=labels.limit(0)).filter("keep").count() == len(rows)
