"""Operators over texts against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from patternweave.llm import decontamination, langid, license_scan, line_dedup, pii, quality, queries, runtime, simhash

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANK = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}
CLASH = "doc_id long, text string, score string, spans string, items string, rest string"


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def odd(spark, texts):
    """Rows with null and repeated ids, and columns whose names the operators use."""
    rows = [(k, t, "s", "p", "i", "r") for k, t in enumerate(texts)] + [(None, texts[-1], None, None, None, None), (0, texts[0], "s", "p", "i", "r")]
    return spark.createDataFrame(rows, CLASH)


def words(t):
    return WORD.findall((t or "").translate(LOWER))


# --- op3


def contamination(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault((n, tuple(w[k : k + n])), set()).add(str(i))
    sizes = {n for n, _ in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get((n, tuple(w[k : k + n]))):
                    hit.update(range(k, k + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_is_exact(spark, sf_dir):
    got = [tuple(r) for r in queries.op3_decontamination(spark, sf_dir).collect()]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    want = contamination([(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()], items)
    assert sorted(got) == sorted(want)
    assert any(r[-1] for r in got)


@pytest.mark.parametrize("block_words", [4_000_000, 5])
def test_decontamination_of_odd_rows(spark, block_words):
    r = random.Random(block_words)
    pool = ["aa", "bb", "cc", "é", "x1"]
    texts = [None, "", "...", "aa", "AA bb-CC"] + [" ".join(r.choice(pool) for _ in range(r.randrange(1, 60))) for _ in range(40)]
    items = [(k, " ".join(r.choice(pool) for _ in range(r.randrange(1, 16)))) for k in range(12)] + [(90, None), (91, ""), (92, "aa bb cc"), (93, "aa bb cc"), (None, "aa")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = odd(spark, texts)
    got = decontamination.decontaminate(docs, bench, block_words=block_words).collect()
    flat = [(x.doc_id, x.n_words, sum(s.end - s.first for s in x.spans), len(x["items"]), hashlib.sha256(",".join(x["items"]).encode()).hexdigest(), bool(x.spans)) for x in got]
    want = contamination([(x.doc_id, x.text) for x in docs.collect()], [i for i in items if i[0] is not None])
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(flat, key=key) == sorted(want, key=key)
    assert decontamination.decontaminate(docs, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0


def test_winnowing_guarantee():
    r = np.random.default_rng(0)
    for _ in range(200):
        h = r.integers(0, 6, 40).astype(np.uint64)
        kept = decontamination.winnow(h, 6)
        for k in range(35):
            own = h[k : k + 6]
            assert kept[k + 5 - int(np.argmin(own[::-1]))]


# --- op5


def fingerprint(t):
    w = BLANK.findall((t or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    root = list(range(len(nodes)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(nodes))]


def test_simhash_is_exact(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text").orderBy("doc_id").collect()
    fps = [fingerprint(r.text) for r in rows]
    roots = components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    want = {r.doc_id: (f"{f:016x}", rows[k].doc_id) for r, f, k in zip(rows, fps, roots, strict=True)}
    assert {r[0]: tuple(r[1:]) for r in queries.op5_simhash(spark, sf_dir).collect()} == want


def test_simhash_of_odd_rows(spark):
    texts = [None, "", "\n\t", "One", "one", "a b c", "a b c d", "same text in all of them here", "same text in all of them here", "é É x", "w " * 3000]
    got = simhash.near_duplicates(odd(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for k, t in enumerate(texts):
        assert by[k].fp % (1 << 64) == fingerprint(t)
    assert by[0].component_id == by[1].component_id == by[2].component_id == 0
    assert by[4].component_id == 3 and by[8].component_id == 7
    assert simhash.near_duplicates(odd(spark, texts).limit(0)).count() == 0
    kept = simhash.keep_one(odd(spark, texts))
    assert kept.columns == CLASH.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 0, 3, 5, 6, 7, 9, 10]


def dense(n, seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, 3).astype(np.uint64)
    out = base[r.integers(0, 3, n)].copy()
    for _ in range(5):
        out ^= np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
    return np.unique(np.concatenate((out, r.integers(0, 1 << 63, n // 4).astype(np.uint64))))


def near(fp):
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4, 1))
    return set(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("n", [30, 1500])
def test_vantage_point_trees_lose_no_pair(n):
    fp = dense(n, n)
    got = set()
    for i, j in simhash.near_pairs(fp, np.arange(len(fp)), np.zeros(0, np.int64)):
        got |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == near(fp)
    tree, leaves = simhash.build_tree(fp[::7])
    at, leaf, home = simhash.route(tree, fp)
    assert sorted(at[home].tolist()) == list(range(len(fp))) and leaf.max() < leaves
    met = set()
    for k in range(leaves):
        own = leaf == k
        for i, j in simhash.near_pairs(fp, at[own & home], at[own & ~home]):
            met |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert met == near(fp)


@pytest.mark.parametrize("b", [5, 6, 7, 8])
def test_bands_lose_no_pair(b):
    r = random.Random(b)
    masks = simhash.masks(b)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for k in r.sample(range(64), 4):
            y ^= 1 << k
        assert any((x ^ y) & m == 0 for m in masks)


def test_hot_shards_are_split_without_loss(spark, monkeypatch):
    fp = dense(1200, 9)
    monkeypatch.setattr(simhash, "HOT_ROWS", 50)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    monkeypatch.setattr(runtime, "partitions", lambda _: 200)
    from patternweave.llm.components import connected

    hooked = {r.u: r.v for r in connected(simhash.link(df)).collect()}
    roots = components([int(x) for x in fp], lambda a, b: (a ^ b).bit_count() <= 4)
    group = {}
    for x, k in zip(fp.view(np.int64).tolist(), roots, strict=True):
        group.setdefault(k, set()).add(hooked.get(x, x))
    assert all(len(g) == 1 for g in group.values()) and len({next(iter(g)) for g in group.values()}) == len(group)


# --- op7


def test_license_phrases(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op7_license_scan(spark, sf_dir).collect()}
    for r in documents(spark, sf_dir).collect():
        w = words(r.text)
        places = sorted((k, label) for p, label in license_scan.BASE.items() for n in [len(p.split())] for k in range(len(w) - n + 1) if w[k : k + n] == p.split())
        own = got[r.doc_id]
        assert (own.n_words, own.n_base) == (len(w), len(places))
        assert own.base_labels == ",".join(sorted({x for _, x in places}))
        assert (own.first_word, own.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(own.base_labels.split(",")) - {""} <= set(own.labels.split(","))
        assert 0 <= own.score <= 1


def test_license_templates(spark):
    texts = [None, "", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License. Under the mit license", "CC-BY-NC cc by nc cc by cc by nc", "the of and to", "under the under the mit license apache license version 2", "Licensed under the GNU something else Public License version 3"]
    got = {r.doc_id: r for r in license_scan.scan_licenses(odd(spark, texts)).collect() if r.doc_id}
    assert [s.label for s in got[2].spans] == ["gpl-3"] and got[2].score == 1
    assert [b.start for b in got[3].base] == [1, 5]
    assert [b.start for b in got[4].base] == [0, 3, 8]
    assert got[5].score == 0 and not got[5].base
    assert [b.label for b in got[6].base] == ["mit", "apache-2"]
    assert license_scan.scan_licenses(odd(spark, texts).limit(0)).count() == 0


def test_matching_statistics():
    r = random.Random(0)
    templates = [[r.randrange(4) for _ in range(12)] for _ in range(4)]
    a = license_scan.Automaton(templates, [0])
    subs = {tuple(t[i:j]) for t in templates for i in range(12) for j in range(i + 1, 13)}
    for _ in range(60):
        text = [r.randrange(4) for _ in range(30)]
        _, matches = a.scan(text)
        longest = [max([n for n in range(k + 1) if n == 0 or tuple(text[k - n : k]) in subs]) for k in range(31)]
        want = [(k, longest[k]) for k in range(1, 31) if longest[k] >= license_scan.LEAST and (k == 30 or longest[k + 1] <= longest[k])]
        assert [(e, n) for e, n, _ in matches] == want


# --- op8, op2


def test_languages_are_told_apart(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op8_language_id(spark, sf_dir).collect()}
    rows = documents(spark, sf_dir).collect()
    held = [r for r in rows if got[r.doc_id].held_out]
    assert held and np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    docs = odd(spark, [None, "", "123 !!", "the cat of the house", "日本語のテキスト", "x"])
    seen = {r.doc_id: r for r in langid.predict(docs, langid.learn(documents(spark, sf_dir))).collect() if r.doc_id}
    assert [seen[k].lang_pred for k in (1, 2)] == ["und", "und"] and seen[3].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in seen.values())
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op2_quality(spark, sf_dir).collect()}
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert labels and np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_quality_of_odd_rows(spark):
    docs = odd(spark, [None, "", "!!!", "one", "two words", "é"])
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    vectors, net = quality.fit(docs, labels)
    got = quality.score(docs, vectors, net)
    assert got.count() == 8 and all(0 <= r.score <= 1 for r in got.collect())
    empty = quality.fit(docs.limit(0), labels.limit(0))
    assert quality.score(docs, *empty).count() == 8


# --- op9


def repeated_lines(rows, least):
    """Deleted lines by the definition, over all units."""
    seen, places = {}, []
    for key, t in rows:
        lines = [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate((t or "").split("\n")) if BLANK.search(x)]
        sizes = [len(BLANK.findall(x)) for _, x in lines]
        spans = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(sizes[a:b]) >= least:
                    if sum(sizes[a : b - 1]) < least or sum(sizes[a + 1 : b]) < least:
                        spans.add((a, b))
        for a, b in sorted(spans):
            unit = tuple(x for _, x in lines[a:b])
            place = (key, a, b)
            seen[unit] = min(seen.get(unit, place), place)
            places.append((unit, place, lines))
    gone = {}
    for unit, (key, a, b), lines in places:
        first = seen[unit]
        if first[0] != key or a >= first[2]:
            gone.setdefault(key, set()).update(range(a, b))
    out = {}
    for key, t in rows:
        where = [k for k, x in enumerate((t or "").split("\n")) if BLANK.search(x)]
        drop = set()
        own = gone.get(key, set())
        for i in own:
            drop.add(where[i])
            if i + 1 in own:
                drop.update(range(where[i], where[i + 1]))
        out[key] = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_is_exact(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdefg") for _ in range(r.randrange(1, 9))) for _ in range(8)] + ["", "  ", "x " * 12]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 25)))) for k in range(25)] + [(25, None), (26, "")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=12).collect()
    want = repeated_lines(rows, 12)
    assert {x.doc_id: x.text for x in got} == want
    assert any(x.n_deleted for x in got)


def test_line_dedup_on_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in queries.op9_line_dedup(spark, sf_dir).collect()}
    want = repeated_lines(rows, line_dedup.MIN_WORDS)
    assert {k: r.text for k, r in got.items()} == want


def test_line_dedup_of_odd_rows(spark):
    long = "w " * 60
    docs = odd(spark, [long, None, "", long + "\nmore", "\n\n" + long + "\n\n", long])
    got = line_dedup.dedup_lines(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.text for r in by[None]] == [long] and [r.text for r in by[0]] == ["", ""]
    assert by[3][0].text == "more" and by[5][0].emptied and not by[2][0].emptied and by[1][0].text is None
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# --- op10


def plain_base(t):
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_on_odd_texts():
    r = random.Random(3)
    parts = ["a", "@", ".", "-", "b.c", "1", "12", "255", "256", " ", "+", "(", ")", "4111 1111 1111 1111", "é", "0", "\n", "x@y.z", "1.2.3.4"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert sorted((pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)) == sorted(plain_base(t)), t


def test_pii_on_the_table(spark, sf_dir):
    order = {k: i for i, k in enumerate(pii.KINDS)}
    got = {r.doc_id: r for r in queries.op10_pii(spark, sf_dir).collect()}
    for r in documents(spark, sf_dir).collect():
        base = sorted(plain_base(r.text), key=lambda x: (order[x[0]], x[1]))
        own = got[r.doc_id]
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert own.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(own.spans.split(","))
        assert own.n_email == sum(k == "email" for k, _, _ in base) and own.n_phone == sum(k == "phone" for k, _, _ in base)
    # the tagger alone finds nearly all of them
    texts = [r.text or "" for r in documents(spark, "/root/testdata/sf0.01").collect()]
    found = pii.tag(texts, pii.trained())
    base = [pii.base_spans(t) for t in texts]
    assert np.mean([any(a < e and s < b for _, a, b in m) for m, bs in zip(found, base, strict=True) for _, s, e in bs]) > 0.9


def test_pii_of_odd_rows(spark):
    docs = odd(spark, [None, "", "@" * 500, "1" * 20_000, "9" * 5000 + ".1.2.3", "a" * 50_000 + "@b.c", "+1 (238) 555-6608", "plain words only"])
    got = {r.doc_id: r for r in pii.find_pii(docs).collect() if r.doc_id}
    assert [s.kind for s in got[6].base] == ["phone"] and not got[7].spans and not got[4].base
    assert [(s.start, s.end) for s in got[5].base] == [(0, 50_004)]
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_crf_gradient():
    r = np.random.default_rng(0)
    tagger = pii.Tagger()
    x, y = r.integers(0, 128, (3, 7)), r.integers(0, pii.TAGS, (3, 7))
    _, grads = tagger.step(x, y)
    for name in tagger.p:
        at = tuple(int(r.integers(n)) for n in tagger.p[name].shape) if name not in ("fx", "bx") else (int(x[1, 3]), 2)
        keep = tagger.p[name].copy()
        loss = []
        for d in (1e-2, -1e-2):
            tagger.p[name] = keep.copy()
            tagger.p[name][at] += d
            loss.append(tagger.step(x, y)[0])
        tagger.p[name] = keep
        assert abs((loss[0] - loss[1]) / 2e-2 - grads[name][at]) < 2e-2, name


def test_hashes_do_not_depend_on_parts(monkeypatch):
    from patternweave.llm import words

    r = random.Random(9)
    texts = [" ".join("".join(r.choice("abcé1") for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(0, 80))).encode() for _ in range(20)] + [None, b"", b"x" * 500]
    whole = words.Words(texts, words.not_blank()).hashes()
    monkeypatch.setattr(words, "PART", 37)
    assert (words.Words(texts, words.not_blank()).hashes() == whole).all()
    assert len(set(whole.tolist())) == len({w for t in texts for w in (t or b"").split()})


def test_null_ids_keep_their_rows(spark):
    docs = spark.createDataFrame([(None, "under the mit license, call +1 (238) 555-6608", "en"), (0, "this is plain english text", "en"), (0, None, None), (5, "esto es texto en español", "es")], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect() if r.base}
    assert set(found) == {None} and found[None].base[0]["label"] == "mit"
    assert sorted((str(r.doc_id), len(r.base)) for r in pii.find_pii(docs).collect()) == [("0", 0), ("0", 0), ("5", 0), ("None", 1)]
    rows = langid.predict(docs, langid.learn(docs.where("lang is not null"))).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["0", "0", "5", "None"] and [r.lang_pred for r in rows if r.doc_id == 0].count("und") == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert license_scan.scan_licenses(docs).count() == pii.find_pii(docs).count() == 0
    assert langid.predict(docs, langid.learn(docs)).count() == 0


def test_very_long_texts(spark):
    long = "under the mit license " + "palabras largas sin fin " * 150_000
    docs = spark.createDataFrame([(1, long, "es"), (2, "short words of english", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.n_words for r in license_scan.scan_licenses(docs).collect()} == {1: 4 + 600_000, 2: 4}
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.learn(docs)).collect()} == {1: "es", 2: "en"}
    assert len(pii.find_pii(docs).collect()) == 2
