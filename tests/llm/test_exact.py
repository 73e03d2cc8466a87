"""Operators with exact results, against plain versions over small and awkward tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleaner.llm import components, decontamination, fingerprints, licenses, mixing, near_duplicates, scoring

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    (0, "x " + PASSAGE + " y", "a", "en"),
    (1, PASSAGE.upper(), "a", "en"),
    (2, None, None, None),
    (3, "", "b", "en"),
    (4, "  \n\t", "b", None),
    (5, "w " * 3000 + PASSAGE, "a", "en"),
    (6, PASSAGE + " thirteen É é ß", "a", "fr"),
    (7, "Licensed under the Apache License, Version 2.0\nAll rights reserved. all rights reserved", "c", "en"),
    (8, "short text", "c", "en"),
    (9, "short text", "c", "en"),
    (9, "short text", "c", "en"),
    (10, "Released under the MIT Licence\nthis CC BY-NC 4.0", None, "en"),
    (11, " nbsp joined   wide", "é", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, "clash", 1) for t in TEXTS], "doc_id long, text string, source string, lang string, words string, term int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(A_Z))


def test_contamination(spark, docs, none):
    items = [(1, PASSAGE), (2, "eight nine"), (3, None), (4, ""), (None, PASSAGE), (5, "w " * 12), (6, "not there at all")]
    table = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, words int")
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(docs, table).collect()}
    for doc_id, text, *_ in TEXTS:
        own, hit, found = words(text), set(), set()
        for item, said in items:
            want = words(said)
            k = min(10, len(want))
            grams = {tuple(want[i : i + k]) for i in range(len(want) - k + 1)} if k and item is not None else set()
            for i in range(len(own) - k + 1):
                if tuple(own[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
        assert got[doc_id, len(own)] == (len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    assert decontamination.contamination(none, table).count() == 0
    assert not decontamination.contamination(docs, table.limit(0)).filter("contaminated").count()


def test_contamination_with_repeated_ids(spark):
    """Items that share an item_id keep their own words; documents that share a doc_id keep their own hits; null ids count."""
    first, second = "a b c d e f g h i j", "k l m n o p q r s t"
    items = spark.createDataFrame([(1, first), (1, second), (1, second), (2, "u")], "item_id long, text string")
    texts = [(1, f"x {second} y", 10), (2, f"{first} z {second}", 20), (3, second, 10), (3, "x y", 0), (None, f"{first} u", 11), (None, "y", 0), (4, "u " * 12_000, 12_000)]
    got = decontamination.contamination(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), items).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in got) == sorted((str(i), len(t.split()), n) for i, t, n in texts)
    assert {r.n_items for r in got if r.doc_id == 2} == {1} and all(r.contaminated == (r.n_hit > 0) for r in got)
    named = decontamination.contamination(spark.createDataFrame([(f"d{t[0]}", t[1]) for t in texts], "doc_id string, text string"), items).collect()
    assert sorted(r.n_hit for r in named) == sorted(t[2] for t in texts)


def test_proximity(spark, docs):
    tokens = decontamination.tokenise(docs)
    terms = spark.createDataFrame([(t,) for t in ("twelve", "ten", "y", "one")], "term string")
    queries = spark.createDataFrame([(1, ["twelve", "y"]), (2, ["one", "twelve"])], "query_id int, terms array<string>")
    found = decontamination.proximity_matches(decontamination.build_index(tokens, terms), queries, 2)
    named = tokens.select("row", "doc_id").join(found, "row").select("doc_id", "query_id")
    assert sorted(map(tuple, named.collect())) == [(0, 1)]


def brute(rows):
    sets, root = {}, {}
    for i, (_, text, *_) in enumerate(rows):
        w = words(text, SPACED)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        root[i] = i
    find = lambda v: v if root[v] == v else find(root[v])
    for i in sets:
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(rows[i][0], len(sets[i]), rows[find(i)][0]) for i in sets]


@pytest.mark.parametrize("trie", [near_duplicates.TRIE, 8])
def test_near_duplicates(spark, docs, none, monkeypatch, trie):
    monkeypatch.setattr(near_duplicates, "TRIE", trie)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 400, 150)]
    rows = list(TEXTS)
    for i in range(120):
        own = list(base[: 150 - int(rng.integers(0, 25))])
        for k in rng.integers(0, len(own), int(rng.integers(0, 4))):
            own[k] = f"v{rng.integers(0, 50)}"
        rows.append((100 + i, " ".join(own), "s", "en"))
    got = near_duplicates.near_duplicates(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    assert near_duplicates.near_duplicates(none).count() == 0


def test_blocks_of_a_large_cluster_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "TRIE", 8)
    rows = [(i, " ".join(f"t{k}" for k in range(i, i + 60))) for i in range(40)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_a_very_long_set_takes_no_more_than_its_tokens():
    import tracemalloc

    rng = np.random.default_rng(2)
    sets = [np.sort(rng.choice(200_000, 30, replace=False)) for _ in range(2000)] + [np.arange(20_000)]
    tracemalloc.start()
    trie = near_duplicates.Trie(sets, np.array([len(s) for s in sets]))
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert trie.probe(sets[5], 30).tolist() == [5] and trie.probe(sets[2000][:-1000], 19_000).tolist() == [2000]


def test_short_and_null_rows_keep_their_class(spark):
    rows = [(None, "a b"), (7, "a b"), (None, None), (8, "a b c d e f g"), (9, "a b c d e f g h"), (10, "a b c d e f g h i"), (11, "a b"), (11, "x"), (12, "A B")]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # 4 shingles of 5 are similar enough, 3 of 4 are not
    want = [(None, 1, 7), (7, 1, 7), (None, 0, None), (8, 3, 8), (9, 4, 9), (10, 5, 9), (11, 1, 7), (11, 1, 11), (12, 1, 7)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (7, 7), (21, 22), (30, 22)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.root for r in got} == {4: 3, 5: 3, 9: 3, 21: 20, 22: 20, 30: 20}


def test_licenses(docs, none):
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(docs).collect()}
    r = next(v for k, v in got.items() if k[0] == 7)
    assert (r.n_base, r.base_labels, r.labels, r.score, r.last_word - r.first_word) == (2, "reserved", "apache,reserved", 1.0, 3)
    r = next(v for k, v in got.items() if k[0] == 10)
    assert (r.n_base, r.base_labels, r.labels) == (1, "cc-by", "cc-by,mit")
    assert got[2, 0].first_word is None and got[2, 0].score == 0.0 and got[2, 0].labels == ""
    assert licenses.scan(none).count() == 0


def test_licenses_wrapped_over_lines(spark):
    bsd, mpl = "Redistribution and use in source and binary forms, with or without", "This Source Code Form is subject to the terms of the Mozilla Public"
    texts = [
        (1, f"x\n{bsd}\nmodification, are permitted", "bsd", 1.0),
        (2, f"x\n * {mpl}\n * License, version 2.0\ny", "mpl", 1.0),
        (3, bsd, "", 0.0),
        (4, f"{bsd}\n" + "other words\n" * 20 + "modification, are permitted", "", 0.0),
        (5, "\n".join("Released under the MIT License".split()), "mit", 1.0),
        (6, "first\nReleased under the MIT License\nlast", "mit", 1.0),
        (7, "\n\n", "", 0.0),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")).collect()}
    assert [(i, got[i].labels, got[i].score) for i, *_ in texts] == [(i, labels, score) for i, _, labels, score in texts]
    assert len(got[6].matches) == 1


def test_fingerprints(docs, none):
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    rows = sorted({t[:2] for t in TEXTS}, key=lambda t: t[0])
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        if doc_id == 9:
            continue  # stands twice: its own successor the first time
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprints.fingerprint(text) and r.edited_fingerprint == fingerprints.fingerprint(edited)
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1) == (fingerprints.canonical(edited) == fingerprints.canonical(text))
    assert fingerprints.edited_fingerprints(none).count() == 0
    assert fingerprints.edited_fingerprints(docs.filter("doc_id = 8")).first().near_next == 1.0
    assert fingerprints.canonical("Ｆｕｌｌ  ﬁne STRASSE ß") == "full fine strasse ss"


def test_fingerprints_of_string_ids(spark):
    rows = [(f"d{i:03}", f"text number {i} " * (1 + i % 7)) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    for slices in (1, 4, 50):
        got = {r.doc_id: r for r in fingerprints.edited_fingerprints(table, slices).collect()}
        for i, (doc_id, text) in enumerate(rows):
            k = len(text) // 4
            edited = text[: len(text) - k] + rows[(i + 1) % len(rows)][1][:k]
            assert got[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_fingerprint_query_keeps_every_row_once(spark, docs, tmp_path):
    from gleaner.llm import queries

    odd = spark.createDataFrame([(None, "short text"), (None, "alone here"), (9, "another text of nine"), (9, "short text")], "doc_id long, text string")
    docs.select("doc_id", "text").unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.group_id, r.n_copies) for r in queries.op4_fingerprints(spark, str(tmp_path)).collect())
    assert sum(got.values()) == len(TEXTS) + 4
    assert got[9, 8, 5] == 3 and got[8, 8, 5] == 1 and got[9, 9, 1] == 1 and got[None, 8, 5] == 1 and got[None, None, 1] == 1


def test_exact_duplicates(docs):
    groups = defaultdict(set)
    for r in fingerprints.exact_duplicates(docs).collect():
        groups[r.group_id].add((r.doc_id, r.n_copies))
    assert groups[8] == {(8, 3), (9, 3)} and groups[2] == {(2, 3), (3, 3), (4, 3)}
    assert groups[0] == {(0, 1)} and groups[1] == {(1, 1)}


def test_colliding_digests_are_split(docs, monkeypatch):
    marks = docs.selectExpr("doc_id", "'0000000' AS digest")
    monkeypatch.setattr(fingerprints, "digest", lambda canon: "0000000")
    assert fingerprints.exact_duplicates(docs, marks).select("group_id").distinct().count() == 9


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    total = sum(r.size for r in got)
    assert [r.size for r in sorted(got, key=lambda r: r.doc_id)] == [len(words(t[1], SPACED)) for t in sorted(TEXTS, key=lambda t: t[0])]
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(total)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert own[0].target <= 3 * own[0].source_size + 1e-9
        assert abs(sum(r.taken for r in own) - own[0].target) <= mixing.BLOCK
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0


def test_quotas_are_those_of_highest_quotients(spark):
    rng = np.random.default_rng(5)
    claims = [(f"s{i % 7}", i, float(x)) for i, x in enumerate(rng.exponential(500, 60))]
    seats = round(sum(c for *_, c in claims) / 32)
    quotients = sorted(((-c / (2 * k + 1), s, i, k) for s, i, c in claims for k in range(seats)))[:seats]
    want = Counter((s, i) for _, s, i, _ in quotients)
    rows = spark.createDataFrame([(s, i, 10_000, c) for s, i, c in claims], "source string, shard long, shard_size long, claim double")
    assert {(r.source, r.shard): r.quota for r in mixing.quotas(rows, 32).collect() if r.quota} == dict(want)


def test_scores(docs, none):
    got = scoring.score(docs, docs.doc_id % 3 != 0).collect()
    tokens = [[*words(t, SPACED), None] for _, t, *_ in TEXTS]
    counts = Counter(w for (i, *_), t in zip(TEXTS, tokens) if i % 3 for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, i % 3 == 0, len(t), sum(counts[w] > 0 for w in t), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, *_), t in zip(TEXTS, tokens))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)
    assert scoring.score(none, none.doc_id > 0).count() == 0


def test_model_sums_to_one(docs):
    held = docs.filter("doc_id IN (0, 6, 8)")
    grams = scoring.count_unigrams(held)
    known = sum(grams.counts) / (grams.n + 1) + grams.share * (grams.v - len(grams.hashes) + 1)
    assert known == pytest.approx(1.0)


def test_every_word_has_its_own_probability(spark):
    # more words than any table of frequent ones would hold, with unlike counts
    rng = np.random.default_rng(6)
    names = [f"w{i}" for i in range(200_000)]
    said = rng.permutation(np.repeat(np.arange(200_000), np.where(np.arange(200_000) < 140_000, 2, 1)))
    rows = [(i, " ".join(names[k] for k in said[s : s + 200])) for i, s in enumerate(range(0, len(said), 200))]
    rows += [(9000, "w0 w1 w199999 unseen w150000"), (9001, " ".join(names[k] for k in said[1000:1020])), (9002, "w199999 w2"), (9003, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in scoring.score(table, table.doc_id < 9000).filter("doc_id >= 9000 OR doc_id = 7").collect()}
    check_scores(rows, got, lambda i: i < 9000)


def check_scores(rows, got, training):
    """Against a plain version of the mean of a pair and a triple model."""
    tokens = {i: [*(t or "").split(), None] for i, t in rows}
    grams = [Counter(), Counter(), Counter(), Counter(), Counter()]  # words; pairs, triples; contexts of both
    for i, t in tokens.items():
        if training(i):
            t = ["<s>", "<s>", *t]
            grams[0].update(t[2:])
            grams[1].update(zip(t[1:], t[2:]))
            grams[2].update(zip(t, t[1:], t[2:]))
            grams[3].update(t[1:-1])
            grams[4].update(zip(t[:-2], t[1:-1]))
    n = sum(grams[0].values())
    single = lambda w: max(grams[0][w], 1) / (n + 1)
    for i, r in got.items():
        t = ["<s>", "<s>", *tokens[i]]
        one = sum(np.log10((grams[1][v, w] + scoring.MU * single(w)) / (grams[3][v] + scoring.MU)) for v, w in zip(t[1:], t[2:]))
        two = sum(np.log10((grams[2][u, v, w] + scoring.MU_PAIR * single(w)) / (grams[4][u, v] + scoring.MU_PAIR)) for u, v, w in zip(t, t[1:], t[2:]))
        want = max(one, two) + np.log10((1 + 10 ** (min(one, two) - max(one, two))) / 2)
        assert r.score == pytest.approx(want, abs=4e-4 * len(t))


def test_scores_equal_a_plain_model_for_any_number_of_partitions(spark):
    rng = np.random.default_rng(8)
    words_ = [f"w{int(k)}" for k in rng.zipf(1.3, 8000) % 300]
    rows = [(i, " ".join(words_[k : k + int(rng.integers(1, 40))])) for i, k in enumerate(range(0, 7900, 20))]
    rows += [(900, None), (901, ""), (902, rows[5][1]), (903, "w0 " * 500), (904, "never said")]
    got = []
    for parts in (3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got.append({r.doc_id: r for r in scoring.score(table, table.doc_id % 7 != 2).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0].keys() == got[1].keys() and all(got[0][i].score == pytest.approx(got[1][i].score, rel=1e-9) for i in got[0])
    check_scores(rows, got[0], lambda i: i % 7 != 2)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for top in (50, 2**40, 2**63):
        values = np.sort(rng.integers(0, top, 3000, dtype=np.uint64))
        held = scoring.EliasFano(*scoring.EliasFano.pack(values))
        place, found = held.locate(values)
        assert found.all() and (values[place] == values).all()
        asked = np.concatenate((values, values + np.uint64(1), rng.integers(0, top, 500, dtype=np.uint64)))
        assert (held.find(asked) == np.searchsorted(values, asked)).all()
        assert (held.locate(asked)[1] == np.isin(asked, values)).all()


def test_elias_fano_seeks_sorted_numbers_in_passing():
    from time import process_time

    rng = np.random.default_rng(2)
    spread = np.sort(rng.integers(0, 2**62, 300_000, dtype=np.uint64))
    crowded = np.sort(np.concatenate((np.full(200_000, 5, np.uint64), rng.integers(0, 2**62, 20, dtype=np.uint64), 2**62 + rng.integers(0, 2**20, 150_000, dtype=np.uint64))))
    few = np.array([3, 2**63], np.uint64)
    for values in (spread, crowded, few, few[:0]):
        held = scoring.EliasFano(*scoring.EliasFano.pack(values))
        for asked in (values, np.sort(np.concatenate((values, values - np.uint64(1), values + np.uint64(1)))), values[-3:], np.array([0, 5, 6, 2**61, 2**64 - 1], np.uint64)):
            place, found = held.locate(asked)
            assert (place == np.searchsorted(values, asked)).all() and (found == np.isin(asked, values)).all()
    # a small multiple of a plain search, which keeps all numbers unpacked
    held = scoring.EliasFano(*scoring.EliasFano.pack(spread))
    asked = np.sort(rng.integers(0, 2**62, 300_000, dtype=np.uint64))

    def seconds(f):
        took = []
        for _ in range(5):
            began = process_time()
            f()
            took.append(process_time() - began)
        return min(took)

    assert seconds(lambda: held.locate(asked)) < 5 * seconds(lambda: np.searchsorted(spread, asked))
