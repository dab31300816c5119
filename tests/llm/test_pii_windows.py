"""Windows of the tagger: all are scored, and the best paths are those of a plain search over whole texts."""

import random

import numpy as np
import pytest

from patternweave.llm import pii, runtime


def texts(count=60, seed=3):
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    made = ["", "x", "5", "@", "é" * 300, "a@b.co " * 90, "1" * 700, "\n" * 400]
    for _ in range(count):
        words = [r.choice(["alpha", "Beta,", "42", "v1.2", "ñandú", f"ann{digits(2)}@mail{digits(1)}.example.com", f"+1 ({digits(3)}) 555-{digits(4)}", f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', f"10.0.{digits(2)}.1", "plain", "words"]) for _ in range(r.randrange(1, 160))]
        made.append(r.choice([" ", "\n"]).join(words))
    return made


def plain_scores(text, tagger):
    """The blended scores of one text, window by window."""
    x = pii.symbols(text)
    sums, weight = np.zeros((len(x), pii.TAGS)), np.zeros((len(x), 1))
    at = 0
    while True:
        own = np.full(pii.WINDOW, 32, np.uint8)
        part = x[at : at + pii.WINDOW]
        own[: len(part)] = part
        e = tagger.emissions(own[None])[0]
        w = pii._BLEND[: len(part), None]
        sums[at : at + len(part)] += e[: len(part)] * w
        weight[at : at + len(part)] += w
        if at + pii.WINDOW >= len(x):
            return (sums / weight).astype(np.float32)
        at += pii.STRIDE


def plain_spans(text, tagger):
    e = plain_scores(text, tagger)
    path = tagger.decode(e[None], np.array([len(text)]))[0]
    return sorted(s for s in pii.spans_of(path) if pii.plausible(s[0], text[s[1] : s[2]]))


@pytest.mark.parametrize("trained", [True, False])
def test_spans_are_those_of_a_search_over_whole_texts(trained):
    tagger = pii.trained() if trained else pii.Tagger(4)
    rows = texts()
    want = [plain_spans(t, tagger) if t else [] for t in rows]
    assert pii.tag(rows, tagger) == want
    assert not trained or sum(map(len, want)) > 500


def test_long_texts_in_parts_give_the_same(monkeypatch):
    tagger, rows = pii.trained(), [" ".join(texts(40, 5)), *texts(5, 6)]
    whole = pii.tag(rows, tagger)
    monkeypatch.setattr(pii, "PART", pii.STRIDE * 6)
    assert len(rows[0]) > 20 * pii.PART and pii.tag(rows, tagger) == whole


def test_no_path_gains_more_than_the_bound_says():
    r = np.random.default_rng(0)
    for seed in range(20):
        tagger = pii.Tagger(seed)
        for k in ("move", "begin", "finish"):
            tagger.p[k] = r.standard_normal(tagger.p[k].shape).astype(np.float32) * 2
        step, need = tagger.bounds()
        p = tagger.p
        for _ in range(300):
            tags = r.integers(1, pii.TAGS, int(r.integers(1, 9)))
            into = max(p["move"][0, tags[0]] - p["move"][0, 0], p["begin"][tags[0]] - p["begin"][0])
            out = max(p["move"][tags[-1], 0] - p["move"][0, 0], p["finish"][tags[-1]] - p["finish"][0])
            moves = into + out + sum(p["move"][a, b] - p["move"][0, 0] for a, b in zip(tags, tags[1:]))  # noqa: B905
            assert moves <= len(tags) * step - need


def test_recall_on_planted_data(spark, sf_dir):
    """Secrets have no base pattern, and the tagger alone finds most of what the base patterns find."""
    import re

    rows = [r.text or "" for r in runtime.load(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents").select("text").collect()]
    found = pii.tag(rows, pii.trained())
    secrets = [(k, m) for k, t in enumerate(rows) for m in re.finditer(r'token = "([0-9a-f]{40})"', t)]
    hit = sum(any(kind == 4 and abs(a - m.start(1)) <= 2 and abs(b - m.end(1)) <= 2 for kind, a, b in found[k]) for k, m in secrets)
    assert secrets and hit >= 0.9 * len(secrets)
    base = [(k, a, b) for k, t in enumerate(rows) for _, a, b in pii.base_spans(t)]
    assert base and sum(any(x < b and a < y for _, x, y in found[k]) for k, a, b in base) >= 0.9 * len(base)
