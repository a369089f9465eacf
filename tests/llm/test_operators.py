"""Operators against brute force on a small table with every awkward case."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chunks, common, dac, exact_dedup, jaccard, langid, packing, pieces, quality, rows as rowwise, sharding, topk, urls
from gridloom.llm.chunks import ChunkEncoder
from gridloom.llm.graph import components


def got(df):
    return [tuple(r) for r in df.collect()]


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


# 1 ----------------------------------------------------------------------------


def test_sharding(spark, docs, rows, none):
    out = [r.asDict() for r in sharding.shard_documents(docs, 7, 64).collect()]
    size = lambda t: len((t or "").encode()) + 8
    assert same([(r["doc_id"], r["size"], r["text_crc32"]) for r in out], [(d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows])
    places, slots = defaultdict(list), defaultdict(set)
    for r in out:
        places[r["shard"]].append(r["slot"])
        slots[r["virtual_slot"]].add(r["shard"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert all(len(s) == 1 for s in slots.values()) and {r["law"] for r in out} == {"bytes"}
    per_slot = Counter()
    for r in out:
        per_slot[r["virtual_slot"]] += r["size"]
    loads = [sum(r["size"] for r in out if r["shard"] == s) for s in range(7)]
    assert max(loads) - min(loads) <= max(per_slot.values())
    assert sharding.shard_documents(none, 7, 64).count() == 0


def test_shards_have_near_equal_bytes(spark):
    """The law of the query: at sf0.01, and with one id on every row."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (docs, docs.withColumn("doc_id", F.lit(None).cast("long"))):
        loads = Counter()
        for r in sharding.shard_documents(df, 6).collect():
            loads[r["shard"]] += r["size"]
        assert len(loads) == 6 and max(loads.values()) - min(loads.values()) <= 0.02 * max(loads.values())


def test_slot_map_versions(spark, tmp_path):
    rnd = random.Random(1)
    one = sharding.SlotMap.build([rnd.randint(0, 1000) for _ in range(500)], [3] * 500, 6)
    assert max(one.loads()) - min(one.loads()) <= 1000
    grown = one.rebalance(7)
    moved = [b for a, b in zip(one.shard, grown.shard, strict=True) if a != b]
    assert 6 in moved and max(grown.loads()) < 1.1 * sum(grown.loads()) / 7
    assert len(moved) < 500 / 7 * 1.3
    shrunk = grown.rebalance(5)
    assert set(shrunk.shard) <= set(range(5)) and shrunk.version == 3
    path = str(tmp_path / "map")
    one.store(spark, path)
    grown.store(spark, path)
    assert sharding.SlotMap.load(spark, path) == grown and sharding.SlotMap.load(spark, path, 1) == one
    with pytest.raises(ValueError, match="version 2"):
        grown.store(spark, path)


# 2 ----------------------------------------------------------------------------


def copies(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    first = {t: min((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return groups, first


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda t: F.unhex(F.substring(F.md5(t.cast("binary")), 1, 1))])
def test_exact_dedup(docs, rows, none, hashed):
    groups, first = copies(rows)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    out = [r.asDict() for r in exact_dedup.group_copies(docs, hashed).collect()]
    want = [(d, first[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t, *_ in rows]
    assert same([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out], want)
    assert sum(r["kept"] for r in out) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
    kept = exact_dedup.keep_first(docs, hashed)
    assert kept.columns == docs.columns
    assert same([(r["doc_id"], norm(r["text"])) for r in kept.collect()], [(first[t], t) for t in groups])
    assert exact_dedup.group_copies(none).count() == exact_dedup.keep_first(none).count() == 0


def test_keep_first_is_stable_and_spreads_large_groups(spark):
    rows = [(i, "same  text", "x") for i in range(50, 3000)] + [(7, "same\ttext", "a"), (7, "same text", "b"), (7, "same text", "a"), (5, "alone", "a"), (5, "alone", "a"), (None, "none", "n"), (None, "none ", "n")]
    kept = []
    for n in (1, 3, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(n)
        kept.append(sorted(map(repr, got(exact_dedup.keep_first(df)))))
        out = exact_dedup.group_copies(df).filter("group_size > 100")
        assert out.count() == 2953 and {r["keep_id"] for r in out.collect()} == {7} and out.filter("kept").count() == 1
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 4


# 3 ----------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunk_encoder_equals_library(name, rows):
    rnd = random.Random(3)
    odd = [" ", "  a  b ", "a\n\nb \n c", "\n", " <|endoftext|> a", "tab\tb", "don't you're 's", "1 2  34 5a", "ΣΑΣ ς", "İI", "a\xa0b", "a$$$ b!! C%%%.\nD", "x's. y", "_a_ b_", "a.b,c. d"]
    odd += ["".join(rnd.choice("ab 1'\n.s,$!ÉßÄ語Σ  ") for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    texts = [t for _, t, *_ in rows] + odd
    for most in (500_000, 50):
        encoder = ChunkEncoder(public_tokenizers.path(name), max_chunks=most)
        for _ in range(2):
            want = [e.ids for e in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            assert all(a == b.tolist() for a, b in zip(want, encoder.encode(texts), strict=True))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_marks_after_any_letter(name):
    """All letters below U+30000 before a mark, and random texts of letters that are decomposed, folded or joined."""
    rnd = random.Random(9)
    texts = [f"{c}." for c in map(chr, range(0x30000)) if c.isalpha()]
    odd = "İıŞşǅΩÅÁñéßﬁªºµ\u0130\u0928\u093c\u0958\u09dc\u0a33\u0b5c\u1e9e\u0301\u0307ab.,!'-) "
    texts += ["".join(rnd.choice(odd) for _ in range(rnd.randint(1, 30))) for _ in range(30_000)]
    encoder = ChunkEncoder(public_tokenizers.path(name), max_chunks=100)
    for i in range(0, len(texts), 20_000):
        some = texts[i : i + 20_000]
        want = [e.ids for e in encoder.library.encode_batch_fast(some, add_special_tokens=False)]
        assert [t for t, a, b in zip(some, want, encoder.encode(some), strict=True) if a != b.tolist()] == []


def test_table_of_chunks_stays_bounded_and_cut_chunks_are_looked_up_once():
    """Words that a full table lacks never enter it; each distinct chunk of a call is looked up once, not each occurrence."""
    encoder = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), max_chunks=20)
    asked = []

    class Table(dict):
        def get(self, key):
            asked.append(key)
            return super().get(key)

        def __setitem__(self, *_):
            raise AssertionError("only update() fills the table")

    encoder.table = Table(encoder.table)
    texts = [" ".join(f"word{chr(97 + i)}{chr(97 + j)}" for i in range(5)) + "\nagain and again and again" for j in range(20)]
    got_ids = encoder.encode(texts * 3, 1)
    assert len(asked) == len(set(asked)) and len(encoder.table) > 20
    size = len(encoder.table)
    assert [x.tolist() for x in encoder.encode(["a new phrase, unseen."], 1)] == [[*encoder.library.encode("a new phrase, unseen.", add_special_tokens=False).ids, 1]]
    assert len(encoder.table) == size
    assert all(x.tolist() == [*encoder.library.encode(t, add_special_tokens=False).ids, 1] for t, x in zip(texts * 3, got_ids, strict=True))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_share_an_entry_whatever_mark_follows(name):
    """Words are in the table once, not with each mark again, and a call doesn't walk through the table."""

    class Table(dict):
        def __iter__(self):
            raise AssertionError("work of a call must not grow with the table")

    encoder = ChunkEncoder(public_tokenizers.path(name))
    encoder.table = Table(encoder.table)
    texts = [f". {a}{x} {b}{y} {c}{z} " for a, b, c in itertools.permutations(["stone", "élan", "allée"]) for x, y, z in itertools.permutations([",", ".", "!?", ")", ""], 3)]
    got_ids = encoder.encode([None, "", *texts, "<|a", "x<", "|y", ""])
    want = [e.ids for e in encoder.library.encode_batch(["", "", *texts, "<|a", "x<", "|y", ""], add_special_tokens=False)]
    assert [x.tolist() for x in got_ids] == want
    assert len(encoder.table) <= 16


@pytest.mark.parametrize("most", [1, 10, 25, 10**6])
def test_gathered_batches_hold_all_rows_in_order(most):
    texts = [None, "", "a" * 9, "b", None, "c" * 30, "é" * 5, "", "d" * 10, "e", None]
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    for size in (1, 3, 100):
        out = list(chunks.gathered(iter([*table.to_batches(max_chunksize=size), *table.slice(0, 0).to_batches()]), 1, most))
        assert pa.Table.from_batches(out).equals(table)
        sizes = [[len((t or "").encode()) for t in b.column(1).to_pylist()] for b in out]
        assert all(s and (sum(s) <= most or sum(n > 0 for n in s) == 1) for s in sizes)
        assert all(sum(a) + next((n for n in b if n), 0) > most for a, b in itertools.pairwise(sizes))
    assert list(chunks.gathered(iter(table.slice(0, 0).to_batches()), 1, most)) == []


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1, 300), (700, 200), (5000, 70_000), (3000, 1 << 31)])
def test_dac_random_access(n, top):
    ids = np.random.default_rng(n).integers(0, top, n)
    code = dac.Dac(dac.encode_levels(ids))
    assert code.n == n and (code.slice(0, n) == ids).all()
    assert [code[i] for i in range(n)] == ids.tolist()
    for a, b in np.random.default_rng(1).integers(0, n + 1, (100, 2)):
        assert (code.slice(a, b) == ids[a:b]).all()


def test_token_output(docs, rows, none):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    library = ChunkEncoder(vocabulary).library
    out = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in dac.read_documents(dac.write_segments(docs, vocabulary, segment_tokens=500)).collect() if r["doc_id"] is not None)
    whole = got(dac.read_documents(dac.write_segments(docs, vocabulary)))
    ids = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in rows]
    want = [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids]
    assert same([(d, n, c) for d, _, n, c in whole], want)
    starts = sorted((s, n) for _, s, n, _ in whole)
    assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(starts)) and starts[0][0] == 0
    assert [d for _, d, *_ in out] == sorted(d for d, _ in ids if d is not None)
    assert dac.read_documents(dac.write_segments(none, vocabulary)).count() == 0


def test_documents_are_read_through_rank_directories(docs, monkeypatch):
    """A document is read by its position alone: with wrong ranks, documents after the first block come out wrong."""
    files = dac.write_segments(docs, public_tokenizers.path("word_bpe_49k.json"))
    segment = dac.Segment(max(files.collect(), key=lambda r: r["n_tokens"])["payload"])
    asked = []
    real = dac.Dac._rank
    monkeypatch.setattr(dac.Dac, "_rank", staticmethod(lambda bits, ranks, i: asked.append(i) or real(bits, ranks, i)))
    whole = segment.tokens.slice(0, segment.tokens.n)
    asked.clear()
    for k, (a, b) in enumerate(zip(segment.starts, segment.starts[1:])):
        assert (segment.document(k) == whole[a:b]).all()
    assert sum(i > 0 for i in asked) >= len(segment.doc_ids) - 1


def test_rows_of_one_id_lie_in_several_parts(spark):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1 if i % 3 else None, f"text {i}", "s") for i in range(4000)], "doc_id long, text string, part string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would make one part of so few rows
    files = dac.write_segments(df, vocabulary)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.select("part").distinct().count() > 2
    out = dac.read_documents(files).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None] * 1334 + [1] * 2666
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in itertools.pairwise(out))


# 4 ----------------------------------------------------------------------------


def test_urls(spark):
    found = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x", "https://example.org/en/2", "ftp://shop.com/fr/a", "x://com/de/", "x://notcom", "x://host.net/p/123.html#t", None, "nothing", "", "http://", "http://u@H.com:80/de/x", "x://a://b/c", "x://org", "x://org?q", "x://my.net/" + "/".join("abcdefghij"), "x://é.net/É/deadbeef99"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*found, found[0]])], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in urls.judge(df).collect()}

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(t), t, v) for v, t in urls.RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/") :])]
        best = max(fits, default=(0, None, None))
        return host, path, best[1], best[2]

    assert len(out) == len(found) + 1
    for i, u in enumerate([*found, found[0]]):
        host, path, rule, verdict = brute(u)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule)
        assert out[i]["verdict"] == (verdict or out[i]["verdict"]) and out[i]["verdict"] in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0


def brute_tree(groups, z=urls.Z):
    """(template, purity) of each (host, segments), by recursion over python lists."""
    groups = [(h, tuple(s), n, b) for h, s, n, b in groups]
    share = (sum(g[3] for g in groups) + 1) / (sum(g[2] for g in groups) + 2)
    out = {}

    def smooth(b, n, towards):
        return (b + towards * urls.PRIOR) / (n + urls.PRIOR)

    def walk(members, level, template, purity):
        branches = defaultdict(list)
        for g in members:
            branches[g[1][level] if level < len(g[1]) else "$"].append(g)
        n, b = sum(g[2] for g in members), sum(g[3] for g in members)
        names = defaultdict(list)
        for segment, own in branches.items():
            on, ob = sum(g[2] for g in own), sum(g[3] for g in own)
            differs = n and on and abs(ob / on - b / n) > z * (b / n * (1 - b / n) / on) ** 0.5
            names[segment if segment == "$" or differs else "*"] += own
        return names, template, purity

    todo = []
    for h in {g[0] for g in groups}:
        own = [g for g in groups if g[0] == h]
        todo.append((own, 0, "", {g: smooth(sum(x[3] for x in own), sum(x[2] for x in own), share) for g in own}))
    while todo:
        members, level, template, purity = todo.pop()
        names, _, _ = walk(members, level, template, purity)
        for name, own in names.items():
            n, b = sum(g[2] for g in own), sum(g[3] for g in own)
            new = {g: smooth(b, n, purity[g]) for g in own}
            if name == "$":
                out |= {(g[0], g[1]): (f"{template}/$", new[g]) for g in own}
            else:
                todo.append((own, level + 1, f"{template}/{name}", new))
    return out


def test_template_tree_equals_brute_force_at_any_depth(spark):
    rnd = random.Random(2)
    shapes = {(f"h{rnd.randint(0, 2)}", tuple(rnd.choice(["=a", "=b", "=$", "=*", "#0", "%"]) for _ in range(rnd.choice([0, 1, 2, 3, 6, 9])))) for _ in range(300)}
    shapes.add(("h0", tuple(["=a"] * 40)))
    rows = []
    for h, s in sorted(shapes):
        n = rnd.choice([0, 0, 3, 30])
        rows.append((h, list(s), n, rnd.randint(0, n) if "=b" in s else n * (s[:1] == ("#0",))))
    df = spark.createDataFrame(rows, "host string, segments array<string>, labelled long, blocked long")
    want = brute_tree(rows)
    found = {(r["host"], tuple(r["segments"])): (r["template"], r["purity"]) for r in urls.template_tree(df).collect()}
    assert found.keys() == want.keys()
    assert all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 1e-9 for k in want)


def test_marks_in_urls_are_no_marks(spark):
    paths = ["/$/x", "/*/x", "/<n>/x", "/%/x", "/0/x", "/=a", "/a0", "", "/", "/a/b/c/d/e/f/g", "/a/b/c/d/e/f/h"]
    df = spark.createDataFrame([(i, f"x://h.net{p}") for i, p in enumerate(paths)], "page_id long, url string").select("page_id", urls.segments(urls.parsed(F.col("url"))[1]).alias("s"))
    found = {r["page_id"]: tuple(r["s"]) for r in df.collect()}
    assert [found[i] for i in range(7)] == [("=$", "=x"), ("=*", "=x"), ("=<n>", "=x"), ("=%", "=x"), ("#0", "=x"), ("==a",), ("#a0",)]
    assert found[7] == found[8] == () and found[9] != found[10] and len(found[9]) == 7


def test_template_tree_rejects_impure_branches(spark):
    rows = [("h.com", ["good", f"x{i}"], 10, 0) for i in range(5)] + [("h.com", ["bad", f"x{i}"], 10, 10) for i in range(5)] + [("h.com", ["bad", "new"], 0, 0), ("h.com", ["other", "q"], 0, 0)]
    df = spark.createDataFrame(rows, "host string, segments array<string>, labelled long, blocked long")
    tree = {tuple(r["segments"]): (r["template"], r["purity"]) for r in urls.template_tree(df).collect()}
    assert tree["bad", "new"][0] == "/bad/*/$" and tree["bad", "new"][1] > urls.REJECT
    assert tree["good", "x1"][1] < 0.2 and tree["other", "q"][0] == "/*/*/$" and tree["other", "q"][1] < urls.REJECT


# 5 ----------------------------------------------------------------------------


@pytest.mark.parametrize("n, dims, top", [(1, 3, 5), (5, 1, 1), (40, 4, 2), (300, 8, 1000), (300, 8, 0), (900, 16, 600)])
def test_index_equals_brute_force(n, dims, top):
    rng = np.random.default_rng(n)
    vectors, ids = rng.integers(-top, top + 1, (n, dims)), rng.permutation(n)
    index = topk.Index(ids, vectors)
    for i in range(0, n, 3):
        found, score, _, _ = index.search(vectors[i], 10, ids[i])
        exact = vectors @ vectors[i]
        want = [x for x in np.lexsort((ids, -exact)) if ids[x] != ids[i]][:10]
        assert found.tolist() == ids[want].tolist() and score.tolist() == exact[want].tolist()


def test_index_stops_on_proof():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-5, 6, (4000, 16))
    vectors[:20] += 500
    index = topk.Index(np.arange(4000), vectors)
    _, score, met, rescored = index.search(vectors[0], 10, 0)
    assert met < vectors.size / 2 and rescored <= 40 and score.min() > 1_000_000
    # Without a proof nothing ends the processing: here no candidate can be told from another.
    alike = topk.Index(np.arange(4000), np.full((4000, 16), 3))
    _, _, met, rescored = alike.search(np.ones(16, int), 10, 0)
    assert met == 4000 * 16 and rescored == 3999


def test_dense_search_costs_little_more_than_its_postings():
    """Uniform vectors, where the proof comes late: right answers, with a few array passes a query."""
    import time

    rng = np.random.default_rng(2)
    vectors = rng.integers(-1000, 1001, (8192, 64))
    index = topk.Index(np.arange(8192), vectors)
    start = time.process_time()
    found = [index.search(vectors[i], 10, i)[:2] for i in range(20)]
    took = time.process_time() - start
    start = time.process_time()
    for _ in range(20):
        np.add.at(np.zeros(8192), index.postings.ravel(), 1.0)
    assert took < 16 * (time.process_time() - start)
    for i, (ids, score) in enumerate(found):
        exact = np.delete(vectors @ vectors[i], i)
        assert score.tolist() == np.sort(exact)[-10:][::-1].tolist() and len(set(ids.tolist())) == 10


def test_one_index_a_block(monkeypatch):
    """As many index builds as there are blocks of candidates, however many queries and batches."""
    import pyarrow as pa

    built = []
    real = topk.Index.__init__
    monkeypatch.setattr(topk.Index, "__init__", lambda self, ids, vectors, *a: built.append(len(ids)) or real(self, ids, vectors, *a))
    rng = np.random.default_rng(1)
    rows = [(b, t, i, rng.integers(-9, 9, 4).tolist()) for b in range(3) for t, n in ((0, 50), (1, 70)) for i in range(n)]
    names = ["block", "turn", "vec_id", "vector"]
    table = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([("block", pa.int32()), ("turn", pa.int32()), ("vec_id", pa.int64()), ("vector", pa.list_(pa.int64()))]))
    out = pa.Table.from_batches(topk.answers(iter(table.to_batches(max_chunksize=17)), 5))
    assert built == [50, 50, 50] and len(out) == 3 * 70 * 5


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = [rng.normal(0, 0.3, 6).tolist() for _ in range(260)]
    rows = [(i * 10, v, 1) for i, v in enumerate(vectors)] + [(7, None, 1), (8, [1.0, None], 1), (9, [float("nan")] * 6, 1), (11, [float("inf")] * 6, 1), (12, [0.5, 0.5], 1), (13, [], 1), (None, [1.0] * 6, 1), (10, vectors[1], 1), (300, vectors[30], 1), (21, [3e38, -3e38, 0.0, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    most = int(np.sqrt(2.0**62 / 6))
    whole = [(i, [max(-most, min(most, int(np.floor(np.float64(np.float32(x)) * 1024)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in whole if i % 100 == 0}):
        v = next(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert same(got(topk.top_k(df, block=64)), want)
    assert topk.top_k(df.limit(0)).count() == 0


# 6 ----------------------------------------------------------------------------


def test_nnls():
    rng = np.random.default_rng(2)
    a = rng.random((12, 40))
    b = a @ np.maximum(rng.normal(0, 1, 40), 0)
    x = packing.nnls(a, b)
    assert (x >= 0).all() and np.allclose(a @ x, b, atol=1e-4)


@pytest.mark.parametrize("lengths", [np.random.default_rng(0).integers(1, 3000, 3000), np.random.default_rng(1).geometric(1 / 900, 3000), np.full(2000, 1000), np.array([1]), np.array([2048, 4096, 5]), np.array([], int)])
def test_pack_covers_everything_once(lengths):
    full, last = packing.pack(lengths)
    spans = defaultdict(list)
    for w in full + last:
        assert 0 < sum(n for _, _, n in w) <= 2048
        for i, s, n in w:
            spans[i].append((s, n))
    for i, n in enumerate(lengths):
        at = 0
        for s, k in sorted(spans[i]):
            assert s == at and k > 0
            at += k
        assert at == n
    assert len(last) <= 1 and (len(full) == 0 or lengths.sum() > 0.99 * 2048 * len(full))


def test_packing(docs, rows, none):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    library = ChunkEncoder(vocabulary).library
    want = Counter()
    for d, t, *_ in rows:
        x = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[d, len(x), zlib.crc32(x.tobytes())] += 1
    for group in (4_000_000, 3000):
        out = [r.asDict() for r in packing.pack_documents(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), vocabulary, group_tokens=group).collect()]
        by_doc, by_window = defaultdict(list), defaultdict(list)
        for r in out:
            by_doc[r["doc_id"]].append(r)
            by_window[r["sequence_id"]].append((r["offset"], r["length"]))
        texts = {d: t for d, t, *_ in rows}
        for d, found in by_doc.items():
            ids = np.array([*library.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
            at = 0
            for r in sorted(found, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids)
        assert set(by_doc) == {d for d in texts if d is not None}
        for found in by_window.values():
            found.sort()
            assert found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(found)) and sum(n for _, n in found) <= 2048
    total = sum(r["length"] for r in map(lambda r: r.asDict(), packing.pack_documents(docs, vocabulary).collect()))
    assert total == sum(n * k for (_, n, _), k in want.items())
    assert packing.pack_documents(none, vocabulary).count() == 0


# 7 ----------------------------------------------------------------------------


def test_quality_learns_from_its_rows_only(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score_quality(docs, labels)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(rows[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in rows)
    assert np.mean([rows[d]["predicted"] == truth[d] for d in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, flipped).collect()}
    assert all(again[d] == rows[d]["score"] for d in rows)


def test_quality_awkward(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, None, 0), (None, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, labels)
    found = out.collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(none, labels).count() == 0


def test_context_sums_and_features_equal_brute_force():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["The", "the", "river", "x1!", "--", "ÉTÉ", "stone,"]) for _ in range(rnd.randint(0, 60))) for _ in range(20)]
    tokens = ["the", "river", "<title>", "<upper>", "x1", "<!", "<again>", "<marks>"]
    contexts = quality.Contexts(tokens)
    want = np.zeros((len(tokens), quality.DIM), int)
    vectors = np.random.default_rng(0).normal(size=(len(tokens), quality.DIM)).astype(np.float32)
    features, sizes = quality.Pooler(tokens, vectors, most=3).features(texts)
    for k, text in enumerate(texts):
        contexts.add(text)
        words = text.split()
        found = []
        for i, w in enumerate(words):
            found += [*quality.parts(w), *(["<again>"] if i and words[i - 1] == w else [])]
        for i, t in enumerate(found):
            if t in tokens:
                for j in (i - 2, i - 1, i + 1, i + 2):
                    if 0 <= j < len(found) and found[j] in tokens:
                        want[tokens.index(t)] += quality.index_vector(found[j]).astype(int)
        mean = sum((vectors[tokens.index(t)] for t in found if t in tokens), np.zeros(quality.DIM)) / max(1, len(found))
        assert sizes[k] == len(words) and np.allclose(features[k], mean, atol=1e-5)
    assert (contexts.sums[:-1] == want).all()


def test_training_sums_do_not_depend_on_partitions(spark, docs):
    rows = docs.filter("doc_id is not null").selectExpr("doc_id", "cast(doc_id % 2 as int) quality", "text")
    vocabularies, sums = [], []
    for n in (1, 4):
        tokens = quality.vocabulary(rows.repartition(n), held=50 if n == 4 else 10**6)
        vocabularies.append(tokens)
        sums.append(quality.word_vectors(rows.repartition(n), tokens, chunk=7))
    assert vocabularies[0] == vocabularies[1] and (sums[0] == sums[1]).all() and len(sums[0]) > 10


# 8 ----------------------------------------------------------------------------


def brute_jaccard(rows):
    sets = []
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            label[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(sets)):
        members[root(i)].append(sets[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return [(d, len(s), least[root(i)] if s else d) for i, (d, s) in enumerate(sets)]


def test_near_duplicates(docs, rows, none):
    assert same(got(jaccard.near_duplicates(docs)), brute_jaccard(rows))
    kept = jaccard.keep_representatives(docs)
    assert kept.columns == docs.columns
    ids = Counter(d for d, _, c in brute_jaccard(rows) if d is None or d == c)
    assert Counter(r["doc_id"] for r in kept.collect()) == ids
    assert jaccard.near_duplicates(none).count() == 0


def test_near_duplicates_in_chains_and_crowds(spark, tmp_path):
    """Chains of copies of copies, a crowd of near copies, and passages that unrelated texts share."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    texts = []
    for _ in range(6):
        w = [word() for _ in range(80)]
        for _ in range(9):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(rnd.randint(1, 2)):
                w[rnd.randrange(80)] = word()
    crowd = [word() for _ in range(70)]
    for _ in range(60):
        w = list(crowd)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(70)] = word()
        texts.append(" ".join(w))
    shared = [[word() for _ in range(25)] for _ in range(4)]
    for _ in range(60):
        texts.append(" ".join([*rnd.choice(shared), *rnd.choice(shared), *(word() for _ in range(rnd.randint(0, 25)))]))
    rows = [(i, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    assert same(got(jaccard.near_duplicates(spark.read.parquet(path))), brute_jaccard(rows))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        label[max(ra, rb)] = min(ra, rb)
    want = {x: root(x) for x in {v for a, b in edges for v in (a, b) if a != b}}
    assert dict(got(components(spark.createDataFrame(edges, "a long, b long")))) == want


# 9 ----------------------------------------------------------------------------


def test_pieces(docs, rows, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    library = pieces.Library(model)
    assert library.cuts
    want = []
    for d, t, *_ in rows:
        ids = library.processor.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.processor.decode(ids).encode()).hexdigest()))
    assert same(got(pieces.round_trip(docs, model)), want)
    assert same(got(pieces.round_trip(docs, model, block=2000, per_range=3000)), want)
    full = pieces.encode_documents(docs, model, block=5000)
    assert full.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert same([(r["doc_id"], r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in full.collect()], want)
    assert pieces.round_trip(none, model).count() == 0


def test_odd_texts_equal_library(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    rnd = random.Random(1)
    odd = ["▁", "▁a▁▁b", " ▁ ", "<s> </s>", ".  ", " . "] + ["".join(rnd.choice("ab 1'\n.,Éß語▁  ") for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    out = pieces.encode_documents(spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string").repartition(3), model, block=20_000)
    library = pieces.Library(model)
    found = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in out.collect()}
    assert all(found[i] == library.processor.encode(t, add_bos=True, add_eos=True) for i, t in enumerate(odd))


def test_each_distinct_word_is_segmented_once():
    asked = Counter()

    def segment(words):
        asked.update(words)
        return [w.encode("utf-16-le") for w in words]

    messages = [(k, b"p%d" % k, " ".join(f"w{j}" for j in range(k, k + 30)).encode()) for k in range(50)]
    for (block, places, packed), (b, p, n, ids) in zip(messages, pieces.answers(iter(messages), segment, 2), strict=True):
        words = packed.decode().split(" ")
        assert (b, p) == (block, places) and ids.decode("utf-16-le") == "".join(words) and np.frombuffer(n, "<u4").tolist() == [len(w) for w in words]
    assert set(asked.values()) == {1} and len(asked) == 79


# 10 ---------------------------------------------------------------------------


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    scores = rng.normal(0, 3, (50, 3)).astype(np.float32)
    words = [rng.integers(0, 50, n) for n in (0, 1, 2, 5, 7, 7)]
    for w, path in zip(words, langid.viterbi(words, scores, 2.0), strict=True):
        value = lambda s: sum(scores[a, b] for a, b in zip(w, s, strict=True)) - 2 * sum(x != y for x, y in itertools.pairwise(s))
        assert np.isclose(value(path), max(map(value, itertools.product(range(3), repeat=len(w)))))


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 3000")
    out = langid.identify(docs, per_lang=200).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and lang[r["doc_id"]]]
    assert len(out) == 3000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_language_spans_and_scripts():
    en, de, ru = "the house of the river that is under stone and light", "die haus der fluss und das ist unter dem stein", "это дом реки который под камнем"
    model = langid.fit([en] * 3 + [de] * 3 + [ru] * 3, ["en"] * 3 + ["de"] * 3 + ["ru"] * 3)
    text = f"{en}. {de}! {ru}"
    assert [s[2] for s in langid.spans(model, text)] == ["en", "de", "ru"]
    scorer = langid.Scorer(model)
    labels, scores = langid.predict(scorer, [None, "", "12 % !", "дом", "the house", "日本語"])
    assert labels[:5] == ["und", "und", "und", "ru", "en"] and scores[:3] == [0, 0, 0] and labels[5] in model.langs
    assert all(0 <= s <= 1 for s in scores)


def test_a_word_has_one_score_whatever_its_neighbours():
    model = langid.fit(["the house of stone", "das haus ist alt"], ["en", "de"])
    words = ["the", "a", "haus", "é", "x" * 50, "дом"]
    alone = {w: langid.Scorer(model) for w in words}
    for w, scorer in alone.items():
        scorer.ids([[w]])
    for order in itertools.permutations(words):
        scorer = langid.Scorer(model)
        (ids,) = scorer.ids([list(order)])
        assert all((scorer.scores[i] == alone[w].scores[0]).all() for i, w in zip(ids, order, strict=True))
    places, starts = langid.grams(["ab", "c"])
    assert len(places) == 10 and starts.tolist() == [0, 6]


def test_only_letters_are_words():
    assert langid.words_of("½ ² ① 12 Ⅷ _ %") == [] and langid.words_of("m² ½x Ab") == ["m", "x", "ab"]
    model = langid.fit(["the house", "das haus"], ["en", "de"])
    assert langid.predict(langid.Scorer(model), ["½", "²", "①", "Ⅷ 12"]) == (["und"] * 4, [0.0] * 4)
    assert langid.spans(model, "½ ²") == []


def test_more_languages_than_a_byte_counts():
    langs = [f"l{k:03}" for k in range(300)]
    texts = ["".join(chr(97 + (k * 7 + j * j) % 26) for j in range(5)) + f" {chr(97 + k % 26)}{chr(97 + k // 26)}q" for k in range(300)]
    model = langid.fit(texts, langs)
    assert len(model.table) * 300 <= langid.CELLS
    rng = np.random.default_rng(0)
    scores = rng.normal(0, 3, (40, 300)).astype(np.float32)
    words = [rng.integers(0, 40, 6)]
    (path,) = langid.viterbi(words, scores, 1.0)
    value = np.zeros(300)
    for w in words[0]:
        value = np.maximum(value, value.max() - 1.0) + scores[w]
    assert np.isclose(sum(scores[w, k] for w, k in zip(words[0], path, strict=True)) - sum(a != b for a, b in itertools.pairwise(path)), value.max(), atol=1e-4)


def test_keep_known_rejects_planted_texts(spark):
    """Texts of four languages in like shares and texts in an unknown script go; nearly all others stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = {r["lang"]: r["text"] for r in docs.filter("length(text) between 1500 and 2500").groupBy("lang").agg(F.min("text").alias("text")).collect() if r["lang"]}
    mixed = " ".join(t[:1000] for t in one.values())
    planted = spark.createDataFrame([(-1, mixed), (-2, "これは 日本語 の 文章 です"), (-3, "½ 12 %"), (-4, None)], "doc_id long, text string")
    kept = {r["doc_id"] for r in langid.keep_known(docs.unionByName(planted, allowMissingColumns=True)).select("doc_id").collect()}
    assert len(one) == 4 and not kept & {-1, -2, -3, -4} and len(kept) >= 0.99 * docs.filter("length(trim(text)) > 0").count()


def test_language_counts_do_not_depend_on_partitions(docs):
    rows = langid.training_rows(docs, 30)
    a, b = langid.train_on(rows.repartition(1)), langid.train_on(rows.repartition(5))
    brute = langid.fit(*zip(*[(r["text"], r["lang"]) for r in rows.collect()], strict=True))
    assert a.langs == b.langs == brute.langs and (a.table == b.table).all() and (a.table == brute.table).all() and (a.scripts == brute.scripts).all()


def test_language_is_learned_from_all_rows(spark, monkeypatch):
    """Far more rows than a sample would hold: the model has every word, of a repeated id one text, and the threshold is the quantile of all."""
    texts = [f"der stein wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" if i % 3 else f"the stone over {'xyz'[i % 3]}{chr(97 + i % 26)} river" for i in range(3000)]
    rows = [(i, t, "en" if i % 3 == 0 else "de") for i, t in enumerate(texts)]
    ids = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame(rows + [rows[ids[7]]] * 3 + [(None, "le fleuve", "fr")], "doc_id long, text string, lang string").repartition(3)
    brute = langid.fit([texts[i] for i in ids], [rows[i][2] for i in ids])
    model = langid.train(docs)
    assert len(ids) > 2 * langid.PER_LANG and model.langs == brute.langs and (model.table == brute.table).all()
    scores = spark.range(5000).selectExpr("1 - 1 / (id + 3.0D) AS s")
    for refused in (0.0005, 0.25, 0.0, 1.0):
        assert np.isclose(langid.threshold(scores, "s", refused), np.quantile(1 - 1 / (np.arange(5000) + 3.0), refused), atol=1e-12)
    monkeypatch.setattr(langid, "SORTED", 3)
    monkeypatch.setattr(langid, "SCORE_BUCKETS", 7)
    for refused in (0.0, 0.0005, 0.013, 0.5, 0.9999, 1.0):
        assert np.isclose(langid.threshold(scores, "s", refused), np.quantile(1 - 1 / (np.arange(5000) + 3.0), refused), atol=1e-12)
    same = [0.25] * 700 + [0.5] * 50 + [1.0] * 900
    ties = spark.createDataFrame([(x,) for x in same], "s double")
    for refused in (0.1, 0.43, 0.44, 0.7):
        assert langid.threshold(ties, "s", refused) == np.quantile(same, refused)
    assert langid.threshold(scores.limit(0), "s") == 0.0


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 5)
    docs = spark.createDataFrame([(i, f"word{i}", f"l{i % 7}") for i in range(200)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 5"):
        langid.train(docs)
    assert langid.train(docs.filter("lang < 'l5'")).langs == [f"l{k}" for k in range(5)]
    assert langid.table_size(1 << 15) * (1 << 15) <= langid.CELLS


def test_language_awkward(docs, rows, none):
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in out)
    assert langid.keep_known(docs).columns == docs.columns
    assert langid.identify(none).count() == 0
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


# What they share ---------------------------------------------------------------


def test_bitmap_has_no_false_negatives(spark):
    df = spark.range(5000).withColumn("__bucket", F.lit(1)).withColumn("__bits", F.lit(2))
    bits = common.bitmap_of(spark.range(0, 5000, 7), F.col("id"))
    flagged = common.with_bit(df, F.col("id"), bits, "in")
    assert flagged.filter("id % 7 = 0 and not in").count() == 0 and flagged.filter("id % 7 <> 0 and in").count() < 50
    assert flagged.columns == ["id", "__bucket", "__bits", "in"]


def test_temp_names_do_not_clash(spark):
    df = spark.range(1).select(F.lit(1).alias("__x"), F.lit(1).alias("__X_"))
    assert common.temp(df, "x", "y") == ["__x__", "__y"]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot_equals_join(spark, how):
    df = common.materialize(spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 900 as string)) as key"), "t")
    table = common.materialize(df.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("key <> '7'"), "t")
    out = common.join_hot(df, table, ["key"], "n", how)
    assert same(got(out), got(df.join(table, ["key"], how)))


def test_rows_keep_other_columns(docs, rows):
    from pyspark.sql import types as T
    import pyarrow as pa

    out = rowwise.add_columns(docs, "text", lambda: lambda texts: [[len(t or "") for t in texts]], [("size", T.LongType(), pa.int64())], most=100)
    assert out.columns == [*docs.columns, "size"]
    assert same([(r["doc_id"], r["n_chars"], r["size"]) for r in out.collect()], [(r[0], r[4], len(r[1] or "")) for r in rows])
