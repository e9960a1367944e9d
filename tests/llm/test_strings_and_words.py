"""Spelling variants, suffix dedup and collocations against brute force, on small tables with nulls,
empty and long texts, ties, repeated rows and columns whose names clash with the operators' own."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabforge.llm import collocations, spelling, substrings, suffixsort

SCHEMA = "doc_id long, text string, lang string, word string, doc long, th long, h long, n long, key string, runs string"
RND = random.Random(11)


def table(spark, rows):
    """Rows (id, text, lang) with further columns that no operator may read."""
    return spark.createDataFrame([(i, t, g, "w", 1, 2, 3, 4, "k", "r") for i, t, g in rows], SCHEMA).repartition(3)


# ------------------------------------------------------------------ suffix sorting and dedup


def test_suffix_order_equals_sorting():
    for _ in range(400):
        lanes = []
        for _ in range(RND.randint(1, 5)):
            k, n = RND.choice([1, 2, 3, 26]), RND.randint(0, 40)
            lane = [RND.randint(1, k) for _ in range(n)]
            if RND.random() < 0.3:
                lane = (lane[:RND.randint(1, 5)] * 20)[:n]
            lanes.append(lane + [0])
        want, at = [], 0
        for lane in lanes:
            want += [at + i for i in sorted(range(len(lane)), key=lambda i: lane[i:])]
            at += len(lane)
        assert suffixsort.suffix_order(np.array(sum(lanes, [])), np.array([len(x) for x in lanes])).tolist() == want
    assert len(suffixsort.suffix_order(np.zeros(0, int), np.zeros(0, int))) == 0


def test_runs_hold_each_start_once():
    texts = [b"", b"short", bytes(RND.randrange(256) for _ in range(3000)), b"a" * 500, b"xyz" * 300]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    _, _, start, n = substrings.runs_of(data, ends)
    held = np.zeros(len(data) + 1, int)
    np.add.at(held, start, 1)
    np.add.at(held, start + n, -1)
    last = ends[np.searchsorted(ends, np.arange(len(data)), side="right")]
    assert np.array_equal(np.cumsum(held)[:-1], (np.arange(len(data)) + substrings.LENGTH <= last).astype(int))


def removed(rows, length):
    """Rows' covered bytes; equal (id, text) are one document, null ids first, equal ids by a hash (given as ``rows[2]``)."""
    docs = sorted({(i is not None, i or 0, th, t or b"") for i, t, th in rows})
    seen, cover = set(), {}
    for key in docs:
        t = key[3]
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if t[s:s + length] in seen:
                gone[s:s + length] = True
            seen.add(t[s:s + length])
        cover[key] = gone
    return [cover[i is not None, i or 0, th, t or b""] for i, t, th in rows]


def string_rows(rnd):
    line = "".join(rnd.choice("abcd é") for _ in range(400))
    rows = [(None, line), (None, "zz" + line[:60]), (None, None), (1, None), (2, ""), (3, "abc"), (4, line), (4, line), (5, line[100:260]),
            (6, "q" * 200), (7, "ab" * 150), (8, line[:200] + "X" + line[200:]), (9, line[3:90] + "Y" + line[10:80]), (9, "zz" + line[40:90])]
    rows += [(20 + k, line[:k] + "".join(rnd.choice("uvw") for _ in range(4)) + line[k + 5:]) for k in range(0, 300, 9)]
    return rows


@pytest.mark.parametrize("lane_runs,hot_least", [(512, 10 ** 9), (2, 10 ** 9), (512, 3)])
def test_repeats_equal_brute_force(spark, lane_runs, hot_least):
    """Small groups are sorted; with ``lane_runs`` 2 large ones are aggregated; with ``hot_least`` 3 frequent values are never gathered."""
    length, rows = 20, string_rows(random.Random(5))
    d = substrings._texts(table(spark, [(i, t, "en") for i, t in rows]), "doc_id", "text")
    hashes = {(r.doc, bytes(r.text or b"")): r.th for r in d.collect()}
    found = substrings.repeats(d, length, 8, lane_runs, hot_least).distinct().collect()
    plain = [(i, (t or "").encode(), hashes[i, (t or "").encode()]) for i, t in rows]
    for (i, t, th), want in zip(plain, removed(plain, length)):
        got = np.zeros(len(t), bool)
        for r in found:
            if r.doc == i and r.th == th:
                got[r.a:r.b] = True
        assert np.array_equal(got, want), (i, t)


def test_dedup_returns_spans_and_kept_bytes(spark):
    passage = " ".join(f"word{k} é" for k in range(40))
    rows = [(1, "start " + passage, "en"), (2, passage + " end", "en"), (3, passage, None), (None, None, "en"), (5, "", "en"), (6, "own text", "en")]
    got = {r.doc_id: r for r in substrings.dedup(table(spark, rows)).collect()}
    assert len(got) == 6 and got[None].n_bytes == 0 and got[5].kept == b"" and got[6].kept == b"own text" and not got[6].spans
    assert bytes(got[1].kept) == ("start " + passage).encode() and not got[1].spans
    assert bytes(got[2].kept) == b" end" and [tuple(s) for s in got[2].spans] == [(0, len(passage.encode()))]
    assert bytes(got[3].kept) == b"" and got[3].n_bytes == len(passage.encode())
    assert substrings.dedup(table(spark, [])).collect() == []


def test_dedup_of_text_ids(spark):
    text = "the same long passage " * 8
    d = spark.createDataFrame([("b", text), ("a", text)], "name string, body string")
    got = {r.doc_id: bytes(r.kept) for r in substrings.dedup(d, "name", "body").collect()}
    # the passage repeats itself: only its first period stays, and the bytes of no whole string
    assert got["b"] == b"" and 0 < len(got["a"]) < len(text)


# ------------------------------------------------------------------ spelling variants


def spelling_brute(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    form, out = {}, {}
    for w, n in words.items():
        others = [v for v in words if v != w and near(v, w)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = len(others)
    rows = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, words[w], out[w], words[form[w]] if form[w] else None))
    return sorted(rows)


def spelling_rows():
    rnd = random.Random(3)
    base = ["grouping", "spélling", "variant", "reduced", "alphabet", "aaaaaa", "aaaaaaa", "aaaaab", "÷×ÀÿÇé"]
    pool = base + [w[:k] + rnd.choice("abcxé") + w[k + 1:] for w in base for k in range(len(w))] + [w[:k] + w[k + 1:] for w in base for k in range(0, len(w), 2)]
    pool += [w[:k] + "z" + w[k:] for w in base for k in range(len(w) + 1)]
    weights = [600] * len(base) + [rnd.choice([3, 6, 30]) for _ in pool[len(base):]]
    rows = [(i, " ".join(rnd.choices(pool, weights, k=40)).replace("grou", "GROU") + ". 1 éclair_éclair") for i in range(300)]
    rows += [(1000 + k, "chaincb " * 20 + "chainab " * 3 + "chainaa " * (k < 5)) for k in range(10)]
    return rows + [(None, None), (None, "Variant variant VARIANT"), (1, ""), (2, "alphabet " * 500), (2, "alphabet " * 500)]


def test_spelling_equals_brute_force(spark):
    rows = spelling_rows()
    got = spelling.variants(table(spark, [(i, t, "en") for i, t in rows]))
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect())
    want = spelling_brute(rows)
    assert got == want
    assert any(f is not None for _, f, *_ in want) and any(r != (f or w) for w, f, r, *_ in want)  # chains of two steps


@pytest.mark.parametrize("symbols", [1, 2, 8])
def test_spelling_for_any_number_of_symbols(spark, symbols):
    words = ["abcdef", "abcdeg", "abcde", "xabcdef", "zzzzzz", "zzzzz", "azzzzz", "fedcba"]
    v = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = sorted((r.word, r.near) for r in spelling.near_words(v, symbols).collect())
    pairs = [("abcdef", "abcdeg"), ("abcdef", "abcde"), ("abcdef", "xabcdef"), ("abcdeg", "abcde"), ("zzzzzz", "zzzzz"), ("zzzzzz", "azzzzz"), ("zzzzz", "azzzzz")]
    assert got == sorted(pairs + [(b, a) for a, b in pairs])


def test_spelling_of_nothing(spark):
    assert spelling.variants(table(spark, [])).collect() == []
    assert spelling.variants(table(spark, [(1, "short words here", "en"), (2, None, "en")])).collect() == []


# ------------------------------------------------------------------ collocations


def collocations_brute(rows, least, depth, top):
    count, total = Counter(), Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, depth + 1):
                for i in range(len(w) - m + 1):
                    count[lang, tuple(w[i:i + m])] += 1
    out = []
    cand = {k: a for k, a in count.items() if len(k[1]) >= 2 and a >= least}
    inside = Counter()
    for (lang, p), a in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i:i + m]] = max(inside[lang, p[i:i + m]], a)
    for (lang, p), a in cand.items():
        if inside[lang, p] >= a:
            continue
        score, k = min((1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p), count[lang, p[:k]], count[lang, p[k:]], total[lang]))
    out.sort(key=lambda r: (*r[:3], r[3].encode()))
    rank, done = Counter(), []
    for lang, score, a, p, left, right, n in out:
        rank[lang] += 1
        if rank[lang] <= top:
            done.append((lang, rank[lang], p, -a, left, right, n, -score))
    return sorted(done)


def phrase_rows():
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(12)] + ["Été", "x-y", "日本", "\x1cctl"]
    rows = []
    for i in range(120):
        t = " ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", "\n", "\t", "  ", "!?"]) for _ in range(60))
        rows.append((i, t + " very common pair of words " * rnd.randint(0, 2), rnd.choice(["en", "fr", None])))
    return rows + [(500, None, "en"), (501, "", None), (None, "very common pair of words", "en"), (7, "very common pair of words", "en"),
                   (7, "very common pair of words", "en"), (8, "one very common " * 300, "de"), (9, "...", "xx")]


@pytest.mark.parametrize("partitions,broadcast_words", [(8, 10 ** 6), (400, 10 ** 6), (8, 0), (400, 0)])
def test_collocations_equal_brute_force(spark, partitions, broadcast_words):
    """With 400 partitions nearly every pair is hot and routed by more words; with no words to broadcast they are named by hashes."""
    rows = phrase_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = collocations.collocations(table(spark, rows), least=6, top=40, broadcast_words=broadcast_words, sample=1)
        got = sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == collocations_brute(rows, 6, 5, 40)


def test_hot_prefixes_are_routed_by_more_words():
    rows = np.array([[1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [1, 2, 9, 0, 0], [1, 2, 0, 0, 0], [7, 8, 1, 2, 3]])
    hot = [np.sort(collocations._mixed(rows[:1], n)) for n in (2, 3)] + [np.zeros(0, np.uint64)]
    level, hashes = collocations.route(rows, hot)
    assert level.tolist() == [4, 4, 3, 3, 2] and hashes[0] == hashes[1]


def test_multikey_counts_abandon_what_is_rare():
    rows = np.array([[1, 2, 3]] * 5 + [[1, 2, 4]] * 2 + [[1, 3, 0]] * 3 + [[2, 1, 0]])
    got = {tuple(p.tolist()): n for p, n in collocations.multikey_counts(rows, np.ones(len(rows), np.int64), 3)}
    assert got == {(1, 2): 7, (1, 2, 3): 5, (1, 3): 3}


def test_collocations_exact_beyond_64_bits(spark):
    """The score is exact where 1000 a n passes 64 bits."""
    a, n, left, right = 4 * 10 ** 15, 9 * 10 ** 15, 7 * 10 ** 15 + 1, 3 * 10 ** 15 + 7
    d = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert d.select(collocations.score_of("a", "n", "l", "r").alias("s")).first().s == 1000 * a * n // (left * right)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(table(spark, [])).collect() == []
    assert collocations.collocations(table(spark, [(1, None, None), (2, "a b", "en")])).collect() == []
