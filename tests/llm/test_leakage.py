import random

import numpy as np
import pytest

from skein.llm import leakage
from tests.conftest import rows

WORDS = "queue retry node voice script budget marker cache tenant upload digest folder canvas report listener segment branch gateway jingle resolver".split()
HAN = "重试队列保存失败任务服务恢复以后再次尝试然后删除标记音色目录脚本草稿预算缓存租户上传摘要文件夹画布报表听众段落分支网关片头解析器"


def english(seed, size=130):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(1, 999)) for _ in range(size)) + "."


def chinese(seed, size=240):
    r = random.Random(seed)
    return "".join(r.choice(HAN) + ("，" if n % 11 == 10 else "") for n in range(size))


ITEMS = [(1, english(1)), (2, chinese(2)), (3, english(3)), (4, "")]


def leaks(text):
    return {item for _, item, share, density, good in leakage.search(leakage.Index(ITEMS), [text]) if good}


def part(text, start, share):
    size = int(len(text) * share)
    return text[start : start + size]


@pytest.mark.parametrize("name", [1, 2, 3])
def test_altered_passages_are_found(name):
    text = dict(ITEMS)[name]
    fill = english(77) if name != 2 else chinese(77)
    assert leaks(text) == {name}
    assert leaks(fill + text.upper() + fill) == {name}
    wide = "".join(chr(ord(x) + 0xFEE0) if "!" <= x <= "~" else x for x in text)
    assert leaks(fill + wide) == {name}
    assert leaks("\n> ".join(text[i : i + 50] for i in range(0, len(text), 50))) == {name}
    assert leaks(fill + part(text, len(text) // 3, 0.5) + fill) == {name}
    r = random.Random(name)
    edited = "".join(x if r.random() > 0.02 else r.choice(["", "Z", x + "q"]) for x in part(text, 5, 0.6))
    assert leaks(fill + edited + fill) == {name}
    labelled = "".join(f"\n**line {i}** " + text[i : i + 60] for i in range(0, len(text), 60))
    assert leaks(labelled) == {name}


@pytest.mark.parametrize("name", [1, 2, 3])
def test_short_fragments_and_other_texts_are_not(name):
    text = dict(ITEMS)[name]
    assert leaks(english(50) + part(text, 0, 0.25) + english(51)) == set()
    scattered = "".join(text[i : i + 25] + english(i, 12) for i in range(0, len(text), 50))
    assert leaks(scattered) == set()
    assert leaks(english(99, 4000) + chinese(98, 9000)) == set()


def test_grams_equal_for_equal_texts_only():
    for q in (3, 5, 8, 16):
        points = leakage.codes(english(5)[:300])
        found = leakage.grams(points, q)
        assert len(found) == len(points) - q + 1
        pieces = ["".join(map(chr, points[i : i + q])) for i in range(len(found))]
        assert len(set(found.tolist())) == len(set(pieces))
        assert found[7] == leakage.grams(points[7 : 7 + q], q)[0]


def longest(item, text):
    """Best local alignment by plain dynamic programming over all diagonals: its score."""
    row = [0] * (len(text) + 1)
    best = 0
    for a in item:
        before = row[:]
        for j, b in enumerate(text, 1):
            row[j] = max(0, before[j - 1] + (leakage.MATCH if a == b else leakage.MISMATCH), before[j] + leakage.GAP, row[j - 1] + leakage.GAP)
            best = max(best, row[j])
    return best


def test_alignment_equals_plain_dynamic_programming():
    r = random.Random(4)
    jobs, wanted = [], []
    for _ in range(30):
        item = "".join(r.choice("abc") for _ in range(r.randint(1, 40)))
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 60)))
        jobs.append((leakage.codes(item), leakage.codes(text), -leakage.BAND // 2 - 20))  # the band holds every diagonal
        wanted.append(longest(item, text))
    matched, scores = leakage.align(jobs)
    assert scores.tolist() == wanted and np.all(matched >= scores // leakage.MATCH)


def test_table(spark):
    docs = spark.createDataFrame([(1, dict(ITEMS)[1], 0.0), (2, None, 0.0), (3, "", 0.0), (4, chinese(2) * 3, 0.0), (None, dict(ITEMS)[1], 0.0)], "doc_id long, text string, share double")
    items = spark.createDataFrame([*ITEMS, (None, "x"), (9, None), ITEMS[0]], "item_id long, text string")
    assert rows(leakage.leaked(docs, items).select("doc_id", "item_id")) == [(1, 1), (4, 2)]
    assert rows(leakage.leaked(docs, items, per_pass=1).select("doc_id", "item_id")) == [(1, 1), (4, 2)]
    assert leakage.leaked(docs.limit(0), items).count() == 0 and leakage.leaked(docs, items.limit(0)).count() == 0


def test_a_dense_passage_counts_beside_a_longer_thin_one():
    item = leakage.reduced(chinese(2))
    size = len(item)
    thin = "".join(item[i : i + 16] + "x" * 8 for i in range(0, int(size * 0.66), 16))
    dense = part(item, size // 2, 0.45)
    index = leakage.Index([(2, item)])
    ((_, _, share, density, _),) = leakage.search(index, [thin])
    assert share > 0.5 and density < leakage.DENSITY
    ((_, _, share, density, _),) = leakage.search(index, [thin + english(77) + dense])
    assert share > 0.4 and density > 0.9


def test_long_items_with_labels_between_their_lines():
    text = leakage.reduced(english(6, 800))
    index = leakage.Index([(6, text)])
    fill = english(77)
    labelled = "".join(text[i : i + 60] + f"label{i:05d}" for i in range(0, len(text), 60))
    for passage in (labelled, part(labelled, len(labelled) // 4, 0.45)):
        ((_, name, _, _, good),) = leakage.search(index, [fill + passage + fill])
        assert name == 6 and good


def test_the_hits_of_every_band_that_reaches_the_bound_are_aligned_together():
    r = random.Random(8)
    seen = 0
    for seed in range(12):
        text = leakage.reduced(english(seed + 30, 150))
        index = leakage.Index([(1, text), (2, english(5))])
        item = index.items[0]
        body = "".join(text[i : i + 50] + "q" * r.choice([0, 0, 1, 9, 30, 90]) for i in range(0, len(text), 50)) + text[r.randint(0, 300) :]
        points = leakage.codes(body + "\0")
        where = {}
        for at, gram in enumerate(leakage.grams(item.points, item.q).tolist()):
            where.setdefault(gram, []).append(at)
        hits = [at - place for at, gram in enumerate(leakage.grams(points, item.q).tolist()) for place in where.get(gram, ())]
        found = [first for _, number, first in index.candidates(points, np.zeros(1, np.int64)) if number == 0]
        assert len(found) == len(set(found))
        half = item.band // 2
        for band in range(min(hits) // half - 1, max(hits) // half + 1):
            mine = [x for x in hits if band * half <= x < (band + 2) * half]
            if len(mine) >= item.needed:
                seen += 1
                assert any(first <= min(mine) and max(mine) < first + item.band for first in found)
    assert seen > 24


def test_slices_hold_all_texts(monkeypatch):
    monkeypatch.setattr(leakage, "BATCH", 3)
    monkeypatch.setattr(leakage, "BATCH_CHARS", 10)
    assert list(leakage._slices(["ab"] * 7)) == [(0, 3), (3, 6), (6, 7)]
    assert list(leakage._slices(["x" * 9, "ab", None, "x" * 50, ""])) == [(0, 1), (1, 3), (3, 4), (4, 5)]
    assert list(leakage._slices([])) == []


def altered(text, kind, r):
    """``text`` with edits within the budget: 3 places per 100 characters, 20 % of its characters."""
    if kind == "exact":
        return text
    if kind == "labels":
        return "".join(text[i : i + 60] + f" lbl{i // 60 % 1000:03d} " for i in range(0, len(text), 60))
    if kind == "case and marks":
        return "\n> ".join(text[i : i + 37].upper() for i in range(0, len(text), 37))
    out, at = [], 0
    while at < len(text):
        step = r.randint(40, 60)
        size = 1 if len(text) < 100 else r.randint(1, 5)
        out.append(text[at : at + step])
        at += step
        out.append({"added": "w" * size, "left out": "", "changed": "w" * size}[kind])
        at += size * (kind != "added")
    return "".join(out)


KINDS = ("exact", "labels", "case and marks", "added", "left out", "changed")


@pytest.mark.parametrize("letters", [12, 20, 30, 50, 80, 150, 400, 1500, 5000, 10_000])
@pytest.mark.parametrize("script", ["en", "zh"])
def test_recall_over_lengths_and_kinds_of_edits(letters, script):
    cases = found = 0
    for seed in range(3 if letters < 5000 else 1):
        r = random.Random(seed * 1000 + letters)
        make = (lambda n, s: english(n, s // 6 + 8)) if script == "en" else (lambda n, s: chinese(n, s + 20))
        item = make(seed + 11, letters)[:letters]
        size = len(leakage.reduced(item))
        index = leakage.Index([(1, item), (2, make(seed + 500, 300))])
        for kind in KINDS:
            for share in (0.45, 0.7, 1.0):
                part_size = int(len(item) * max(share, min(1.0, leakage.LEAST * 1.15 / size)))
                start = r.randint(0, len(item) - part_size)
                passage = altered(item[start : start + part_size], kind, r)
                cases += 1
                hits = {name for _, name, _, _, good in leakage.search(index, [make(seed + 900, 400) + " " + passage + " " + make(seed + 901, 400)]) if good}
                found += 1 in hits
                assert 2 not in hits
    assert found >= 0.9 * cases, (found, cases)
