"""Suffix-array dedup, phrase mining and fill-in-middle against brute force on the table with every awkward case."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import blocks, infill, phrases, repeats


def got(df):
    return [tuple(r) for r in df.collect()]


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def sha(data):
    return hashlib.sha256(data).hexdigest()


# 11 ---------------------------------------------------------------------------


def brute_repeats(rows, length):
    """(id, bytes, spans, kept) of (id, text) rows, window by window."""
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(window)
        spans = [m.span() for m in re.finditer(b"\1+", gone)]
        out.append((d, len(data), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("length", "hot", "block"), [(100, 4096, 8_000_000), (100, 1, 3000), (24, 3, 3000), (40, 4096, 500), (130, 2, 3000)])
def test_repeats(spark, docs, rows, length, hot, block):
    want = brute_repeats([(d, t) for d, t, *_ in rows], length)
    out = [(d, n, [tuple(s) for s in spans], bytes(kept)) for d, n, spans, kept in got(repeats.remove_repeats(docs, length, hot, block))]
    assert same(out, want) and any(s for _, _, s, _ in want)


def test_repeats_digests_and_empty_table(docs, rows, none):
    want = [(d, n, sum(b - a for a, b in s), len(s), sha(k)) for d, n, s, k in brute_repeats([(d, t) for d, t, *_ in rows], 100)]
    assert same(got(repeats.digests(docs)), want)
    assert repeats.digests(none).count() == 0
    with pytest.raises(ValueError, match="at least 16"):
        repeats.remove_repeats(docs, 15).count()


def test_repeats_of_bytes_in_one_long_text(spark):
    """Strings that start inside a character, periodic texts, and passages that a third of the documents have."""
    rnd = random.Random(3)
    line = "".join(rnd.choice("abcdé日 ") for _ in range(150))
    texts = ["é" * 400, "è" * 400, "ab" * 900, "x" * 100, "x" * 99, "x" * 101]
    texts += ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 300))) + (line if k % 3 == 0 else "") + "".join(rnd.choice("abcdefgh ") for _ in range(200)) for k in range(90)]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    for hot in (10, 4096):
        out = [(d, n, [tuple(s) for s in spans], bytes(kept)) for d, n, spans, kept in got(repeats.remove_repeats(df, 100, hot, 2000))]
        assert same(out, brute_repeats(rows, 100))


def test_segments_of_the_scan_agree(monkeypatch):
    """Records cut at the ends of segments cover the same windows as those of one segment."""
    rnd = np.random.default_rng(2)
    data = bytes(rnd.integers(97, 100, 5000).astype(np.uint8))
    ends = np.array([0, 700, 790, 790, 3000, 5000])
    windows = lambda found: sorted(int(s) + k for _, s, n, _ in zip(*found, strict=True) for k in range(n))
    want = [s for a, b in zip(ends, ends[1:], strict=False) for s in range(a, b - 99)]
    assert windows(repeats.records(data, ends)) == want
    monkeypatch.setattr(repeats, "_SEGMENT", 512)
    assert windows(repeats.records(data, ends)) == want


def test_refined_buckets():
    rnd = np.random.default_rng(4)
    for length in (16, 21, 100):
        sizes = rnd.integers(length, 3 * length, 60)
        text = rnd.integers(97, 99, sizes.sum()).astype(np.uint8)
        text[: sizes[0]] = 97
        text[sizes[0] : sizes[:2].sum()] = 97
        ends = np.repeat(np.cumsum(sizes), sizes)
        wanted = np.flatnonzero(ends - np.arange(len(text)) >= length)
        pointer = repeats.refined(text, wanted, length)
        first = {}
        for k, p in zip(wanted.tolist(), pointer.tolist(), strict=True):
            first.setdefault(text[k : k + length].tobytes(), set()).add(p)
        assert all(len(p) == 1 for p in first.values()) and len(set(pointer.tolist())) == len(first)


def test_blocks_keep_all_rows(docs, rows):
    table = blocks.write_blocks(docs, "lang", size=1000).toArrow()
    found = []
    for k in range(table.num_rows):
        block = blocks.Block.of(table, k)
        ids = block.doc_ids.to_pylist()
        assert ids == sorted(ids, key=lambda d: (d is None, d or 0))
        for d, lang, a, b in zip(ids, block.more[0].to_pylist(), [0, *block.ends], block.ends, strict=False):
            found.append((d, lang, block.data[a:b].decode()))
    assert same(found, [(d, lang, t or "") for d, t, lang, *_ in rows])
    with pytest.raises(TypeError, match="integer"):
        blocks.write_blocks(docs.withColumn("doc_id", F.col("text")))


# 12 ---------------------------------------------------------------------------


def brute_phrases(rows, least, best, inside):
    """All columns but the rank's type, from (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, *words[i : i + k]] += 1
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *words), a in often.items():
        longer = [b for (other, *w), b in often.items() if other == lang and len(w) > len(words) and (w[: len(words)] == words or w[1 : 1 + len(words)] == words)]
        if any(100 * b >= inside * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, k, *r[1:]) for k, r in enumerate(own[:best], 1)]
    return ranked


@pytest.mark.parametrize(("least", "best", "inside", "block"), [(10, 2000, 50, 8_000_000), (2, 30, 50, 2000), (2, 2000, 90, 500), (3, 5, 100, 20_000)])
def test_phrases(docs, rows, least, best, inside, block):
    want = brute_phrases([(r[2], r[1]) for r in rows], least, best, inside)
    assert same(got(phrases.collocations(docs, least, best, inside, block)), want)
    assert want or least == 10


def test_phrases_of_hot_words(spark):
    """Few words, many documents, several languages, marks and capitals; one pair of words nearly everywhere."""
    rnd = random.Random(5)
    texts = [(rnd.choice(["en", "fr", None, "und"]), "".join(rnd.choice(["Of the ", "of the ", "a\t", "b, ", "cé ", "日本 ", "d.\n", "e\x0b", "f ", "g"]) for _ in range(rnd.randint(0, 60)))) for _ in range(400)]
    df = spark.createDataFrame([(None, t, lang) for lang, t in texts], "doc_id long, text string, lang string").repartition(6)
    assert same(got(phrases.collocations(df, 5, 100, 50, 1500)), brute_phrases(texts, 5, 100, 50))


def test_phrases_of_empty_table(none):
    assert phrases.collocations(none).count() == 0


def test_keys_are_sorted_and_cut_by_range():
    rnd = np.random.default_rng(6)
    high, low = rnd.integers(0, 1 << 63, 4000).astype(np.uint64) >> rnd.integers(0, 60, 4000).astype(np.uint64), rnd.integers(0, 3, 4000).astype(np.uint32)
    a, b, n = phrases.run_lengths(high, low)
    want = sorted(Counter(zip(high.tolist(), low.tolist(), strict=True)).items())
    assert list(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == want
    edges = a[[100, 100, 900]], b[[100, 100, 900]]
    assert phrases.cuts_at(a, b, edges).tolist() == [0, 100, 100, 900, len(a)]


def test_scores_are_exact(spark):
    rows = [(10**12 + 7, 10**12 + 9, 10**12 + 11), (10**15 - 1, 10**15 - 1, 10**15 - 1), (999_999_999_989, 10**13, 10**14), (10, 10, 99_999_999_999_999)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select(phrases._score("a", "l", "r").alias("s"))
    assert [r["s"] for r in df.collect()] == [10**6 * a * a // (x * y) for a, x, y in rows]


# 13 ---------------------------------------------------------------------------


def brute_infill(doc_id, text, seed, rate, spm):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize(("seed", "rate", "spm"), [(7, 100, 50), (8, 60, 0), (9, 100, 100)])
def test_infill(docs, rows, seed, rate, spm):
    want = [brute_infill(d, t, seed, rate, spm) for d, t, *_ in rows]
    assert same(got(infill.fill_in_middle(docs, seed, rate, spm)), want)
    digests = [(*w[:5], sha(w[5].encode()), sha((t or "").encode())) for w, (_, t, *_) in zip(want, rows, strict=True)]
    assert same(got(infill.digests(docs, seed=seed, rate=rate, spm=spm)), digests)


def test_infill_scan(spark, none):
    """Marks and cuts on texts full of line feeds, parts of sentinels and characters of every width."""
    rnd = random.Random(8)
    bits = ["<", "P", "S", "M", ">", "<P>", "<M", "\n", "\n\n", "é", "日", "😀", "a", "\x80", "\r", "\x00", "x" * 127]
    texts = ["", "\n", "<P>", "<P", ">", "<<P>", "<P<S>", "a\n", "\na", *("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(600))]
    texts += ["".join(rnd.choice(["ab<", "P\n", "é\n", "日<S", "😀"]) for _ in range(300)) for _ in range(200)]
    out = infill.transform([t.encode() for t in texts], np.array([[int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)] for d in range(len(texts))]), 100, 50)
    want = [brute_infill(d, t, 7, 100, 50) for d, t in enumerate(texts)]
    assert [list(c) for c in zip(*((n, f, p, m, o.encode()) for _, n, f, p, m, o in want), strict=True)] == out
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(a == b for a, b in got(infill.digests(df).join(df, "doc_id").select("restored_sha256", F.sha2(F.col("text").cast("binary"), 256))))
    assert infill.digests(none).count() == 0
