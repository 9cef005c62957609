"""The neighbours' votes and the lexicon's scores, worked out again in plain Python over small tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from phasewell.llm import quality, queries, toxicity


def _tables(spark, folder, rows, labels, name):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, f"doc_id long, {name} int").write.parquet(f"{folder}/labels.parquet")


def _shape(byte):
    c = chr(byte)
    if byte >= 128 or "a" <= c <= "z":
        return "a"
    if "A" <= c <= "Z":
        return "A"
    if c.isdigit():
        return "0"
    return c if c in " \n.,!?|#*&%$-:;'\"()" else "other"


def _terms(text):
    """Square roots of the shares of trigrams of shapes and of six repeats; none for an empty text."""
    if not text:
        return {}
    signs = ["\n", "\n", *map(_shape, text.encode()), "\n"]
    grams = Counter(zip(signs, signs[1:], signs[2:]))
    out = {g: math.sqrt(n / grams.total()) for g, n in grams.items()}
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    same = sum(a == b for a, b in itertools.pairwise(words)) / n
    repeats = {
        "same": same, "words": 1 - len(set(words)) / n if n > 20 else 0, "lines": 1 - len(set(lines)) / len(lines), "upper": sum(w.isupper() for w in words) / n,
        "ends": sum(not w[-1].isalnum() for w in words) / n, "same again": 4 * same,
    }
    return out | {k: math.sqrt(v) for k, v in repeats.items() if v}


def test_quality_votes_by_hand(spark, tmp_path):
    """Fewer labelled texts than dimensions, so that the space is the span of their weighted terms."""
    rng = random.Random(4)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(rng.randint(3, 30))).capitalize() + "."
    bad = lambda: " ".join(rng.choice(["!!", "WIN", "$$ 99", "a|b", "win win", "#"]) for _ in range(rng.randint(3, 30)))
    rows = [(i, good() if i % 2 else bad()) for i in range(40)] + [(100, ""), (101, None), (102, "Mixed words, WIN $$ win win."), (103, "x\nx\nx")]
    labels = [(i, i % 2) for i in range(26)]
    _tables(spark, tmp_path, rows, labels, "quality")
    learned = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5]
    texts = dict(rows)
    known = [_terms(texts[i]) for i in learned]
    frequency = Counter(t for terms in known for t in terms)
    kept = [t for t, n in frequency.items() if n >= 3]
    weigh = lambda terms: np.array([terms.get(t, 0) * (math.log((1 + len(known)) / (1 + frequency[t])) + 1) for t in kept])
    x = np.array([weigh(t) for t in known])
    _, s, right = np.linalg.svd(x, full_matrices=False)
    right = right[s > 1e-9]
    unit = lambda v: v / np.linalg.norm(v)
    labelled = [unit(right @ v) for v in x]
    got = {r["doc_id"]: r for r in queries.op3_quality_neighbours(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        if not text:
            expected = np.mean([i % 2 for i in learned])
        else:
            cosines = [float(unit(right @ weigh(_terms(text))) @ v) for v in labelled]
            near = sorted(range(len(learned)), key=lambda k: -cosines[k])[:15]
            votes = [max(cosines[k], 0) ** 4 + 1e-9 for k in near]
            expected = sum(v * (learned[k] % 2) for v, k in zip(votes, near)) / sum(votes)
        assert got[i]["score"] == pytest.approx(expected, abs=2e-3), (i, text)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_toxicity_scores_by_hand(spark):
    """Every beginning of a word is tried against every entry and every phrase."""
    lexicon = toxicity.Lexicon({"idiot": 2.5, "idio": 1.0, "scum": 3.0, "rat": 0.7}, {"scum", "rat"}, ["scum line", "pack rat"], (-2.0, 1.5, 0.8))
    rng = random.Random(6)
    words = ["idiot", "idiots", "1d10t", "IDIO", "scum", "scumbag", "sсum", "line", "pack", "rat", "rats", "a", "b2", "scum-line", "é"]
    texts = ["", None, *(rng.choice([" ", "  ", ", "]).join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    a, b, c = lexicon.calibration
    for r in toxicity.score(rows, lexicon).collect():
        folded = toxicity.fold(texts[r["doc_id"]] or "")
        free = lambda s, e: (s == 0 or not folded[s - 1].isalnum()) and (e == len(folded) or not folded[e].isalnum())  # noqa: B023, E731
        void = [(s, s + len(p)) for p in lexicon.exceptions for s in range(len(folded)) if folded.startswith(p, s) and free(s, s + len(p))]
        total = 0.0
        for s in range(len(folded)):
            if s and folded[s - 1].isalnum():
                continue
            here = [e for e in lexicon.weights if folded.startswith(e, s) and (e not in lexicon.whole or free(s, s + len(e)))]
            if here and not any(v <= s and s + len(max(here, key=len)) <= w for v, w in void):
                total += lexicon.weights[max(here, key=len)]
        z = a + b * math.log1p(total) + c * math.log1p(1000 * total / (len(folded) + 200))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z))), folded


def test_lexicon_weights_by_hand(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("bcdfghkl", k=3)) + "o" + "".join(rng.choices("mnpqrvwx", k=2)) for _ in range(80)]
    vile, plain = words[:6], words[6:]
    rows = [(i, " ".join([*rng.choices(plain, k=9), *(rng.sample(vile, 2) if i % 4 == 0 else [])])) for i in range(160)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    held: dict[str, Counter] = {}
    for i, text in rows:
        for w in set(re.findall("[a-z]+", text)):
            for term in {f"={w}"} | {f"<{w[:n]}" for n in (4, 5)}:
                held.setdefault(term, Counter())[int(i % 4 == 0)] += 0
        for term in {t for w in set(text.split()) for t in (f"={w}", f"<{w[:4]}", f"<{w[:5]}")}:
            held[term][int(i % 4 == 0)] += 1
    odds = lambda t: math.log((held[t][1] + 0.5) / 41) - math.log((held[t][0] + 0.5) / 121)
    pure = {t for t, n in held.items() if n[1] >= 3 and n[1] >= (0.97 if t[0] == "<" else 0.85) * n.total() and odds(t) > 1}
    expected = {t[1:]: odds(t) for t in pure if not any(f"<{t[1:][:n]}" in pure and n < len(t) - 1 for n in (4, 5))}
    assert {w[:4] for w in vile} <= {e[:4] for e in expected} and lexicon.weights == pytest.approx(expected)
    assert lexicon.whole == {t[1:] for t in pure if t[0] == "=" and t[1:] in expected and f"<{t[1:]}" not in pure}
