"""The ten operators and the pipeline against brute force, with the edge cases that their docstrings define."""

import hashlib
import itertools
import os
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from meridian.llm import additive_ann, common, fuzzy_simhash, html_text, language_id, mixing, nra_topk, packing, suffix_dedup, token_counts, url_filter

P = pytest.importorskip("public_tokenizers")
ODD = "doc_id long, text string, source string, lang string, fp long, n long"


def odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "a b", None, "en"), (2, "", "x", "de"), (3, "Ein Wort und noch eins " * 40, "y", "de"), (3, "Ein Wort und noch eins " * 40, "y", "de"), (4, "one word and one more " * 2000, "y", "en"), (5, "123 !!", "x", "en")]
    return spark.createDataFrame([(*r, 7, 8) for r in rows], ODD)


def test_token_counts(spark):
    df, model = odd_rows(spark), P.path("piece_bpe_32k.model")
    counter = token_counts.WholeTokenCounter(model)
    got = token_counts.count_tokens(df, model).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r.doc_id, len(counter.sp.encode(r.text or ""))) for r in df.collect())
    assert token_counts.count_tokens(df.limit(0), model).count() == 0
    rng = random.Random(1)
    bits = ["a", "the", " ", "  ", "\n", "▁", "</s>", "é", "日本", "😀", "\x00", ".", "ing,", "<0x0A>"]
    for _ in range(2000):
        s = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert counter.count(s) == len(counter.sp.encode(s)), s


def test_packing(spark):
    df, path = odd_rows(spark), P.path("word_bpe_49k.json")
    got = packing.pack(df, path, capacity=512).toPandas()
    encoder = packing.WordEncoder(path)
    want = Counter()
    for r in df.collect():
        raw = (encoder._plain(r.text) if r.text else b"") + np.uint32(1).tobytes()
        for n, at in enumerate(range(0, len(raw), 2048)):
            want[(r.doc_id, n, at // 4, len(raw[at : at + 2048]) // 4, zlib.crc32(raw[at : at + 2048]))] += 1
    have = Counter((None if d != d else int(d), *map(int, rest)) for d, *rest in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert have == want
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        ends = (seq.offset + seq.length).tolist()
        assert seq.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 512
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 512) + 1
    assert packing.pack(df.limit(0), path).count() == 0
    rng = random.Random(2)
    bits = ["a", "The", "don't", " ", "\n", "<|endoftext|>", "É", "İ", "Σ", "日本", "²", "\x1c", "12", "́", "ß", ".", "\xa0"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(2000)]
    assert list(encoder.encode(texts)) == [encoder._plain(t) if t else b"" for t in texts]


def test_packing_plan_grows_with_lengths_not_rows():
    rng = np.random.default_rng(10)
    lengths = np.sort(rng.choice(np.arange(1, 2000), 300, replace=False))
    for hot in (False, True):
        n, counts = np.append(lengths, 2100), np.append(rng.integers(1, 60, 300), 3)
        counts[-1] = counts[:-1].sum() // 2 if hot else 3
        for times in (1, 1000):
            plan, bins = packing.plan_bins(n, counts * times, 4096)
            placed = Counter()
            for config, often in plan:
                assert often > 0 and sum(a * b for a, b in config.items()) <= 4096
                placed.update({a: b * often for a, b in config.items()})
            assert placed == dict(zip(n.tolist(), (counts * times).tolist()))
            assert bins == sum(often for _, often in plan) and len(plan) <= 10 * len(n)
            if not hot:
                assert bins <= 1.01 * (n * counts * times).sum() / 4096 + 1
        _, left = packing.solve_configurations(n, counts * 1000, 4096)
        assert (left == 0).all()
        alone = sum(often for _, often in packing.best_fit(n, counts * 1000, 4096, []))
        assert bins <= 1.001 * alone
    assert packing.plan_bins(np.array([4096]), np.array([7]), 4096)[1] == 7


def test_language_id(spark):
    df = odd_rows(spark).withColumn("held", language_id.held_out())
    model = language_id.fit(df)
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(df, model).collect()}
    assert {(1, "und"), (2, "und"), (5, "und"), (3, "de"), (4, "en"), (None, "en")} <= got
    assert language_id.identify(df, language_id.fit(df.limit(0))).where("lang_pred <> 'und' or score <> 0").count() == 0
    code = language_id.codewords(5)
    assert min((code[i] != code[j]).sum() for i in range(5) for j in range(i)) >= 7


def brute_repeats(texts, size, across=False, words=0):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for n, r in enumerate(raws):
        for i in range(len(r) - size + 1):
            seen.setdefault(r[i : i + size], set()).add(n if across else (n, i))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - size + 1):
            if len(seen[r[i : i + size]]) > 1:
                gone[i : i + size] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        for a, b in zip(np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)):
            if len(r[a:b].split()) < words and raws.count(r) == 1:
                gone[a:b] = False
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        left = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left))
    return out


def passages(rng):
    words = lambda n: " ".join("".join(rng.choices("abcdeé", k=5)) for _ in range(n))
    shared = [words(20) for _ in range(4)]
    texts = [words(rng.randint(0, 30)) + (p := rng.choice(shared))[rng.randint(0, 20) : rng.randint(len(p) - 20, len(p))] + words(rng.randint(0, 30)) for _ in range(60)]
    texts += [texts[0], texts[1], texts[1], "a" * 300, "ab" * 90, "a" * 79, "a" * 50, "a" * 50, "", None, None, "b" * 100 + words(9) + "b" * 90, "\0" * 90 + "x", "\0" * 95, (words(6) + "\n") * 9]
    return texts


def test_suffix_dedup(spark):
    texts = passages(random.Random(3))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter((i, *w[:4]) for i, w in enumerate(brute_repeats(texts, 80)))
    for most in (20_000, 3):  # the second counts the windows of each frequent gram
        got = suffix_dedup.repeated_bytes(df, suffix_dedup.Rule(80), gram=16, most=most).collect()
        assert Counter(tuple(r) for r in got) == want
    assert suffix_dedup.repeated_bytes(df.limit(0)).count() == 0


def test_suffix_dedup_by_two_rules(spark):
    texts = passages(random.Random(13))
    df = spark.createDataFrame([(i % 50, t, i, i) for i, t in enumerate(texts)], "doc_id long, text string, tk long, sha long")
    far, near = suffix_dedup.Rule(80), suffix_dedup.Rule(40, 9, True)
    first, second = brute_repeats(texts, 80), brute_repeats(texts, 40, True, 9)
    want = {i: (i % 50, *a[:4], b[4].decode("utf-8", "ignore")) for i, (a, b) in enumerate(zip(first, second))}
    for most in (20_000, 3):
        got = suffix_dedup.repeated_bytes(df, far, near, gram=16, most=most, kept=1, carry=F.struct("tk", "sha")).collect()
        assert len(got) == len(texts)
        assert {r.carry.tk: (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept) for r in got} == want


def test_slices_are_written_for_frequent_grams_only(spark):
    """Slices that are read once go to their tasks as they are cut; the results are held against brute force above."""
    root = common.shared_dir(spark).removeprefix("file://")
    texts = ["".join(random.Random(n % 5).choices("abc ", k=150)) + str(n) + "".join(random.Random(9).choices("xyz ", k=120)) for n in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written = lambda: {x for x in os.listdir(root) if x.startswith("slices-")}
    rows = []
    for most, grows in ((20_000, False), (1, True)):
        before = written()
        rows.append(sorted(map(tuple, suffix_dedup.repeated_bytes(df, suffix_dedup.Rule(80), gram=16, most=most).collect())))
        assert bool(written() - before) == grows
    assert rows[0] == rows[1] and any(r[2] for r in rows[0])


def test_slices_of_a_long_text_are_cut_in_bounded_memory():
    rng = np.random.default_rng(3)
    long = rng.integers(0, 256, 6_000_000, dtype=np.uint8).tobytes()
    texts = [b"head", b"", b"some bytes here", long, "\u00e9t\u00e9".encode() * 9]
    at = [[0, 3], [], [7], list(range(0, len(long), 60)), [0, 5, 44]]
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("ctx", pa.int64()), ("pos", pa.int32()), ("t0", pa.int64()), ("t1", pa.int64()), ("hot", pa.bool_())]))
    count = iter(range(1 << 20))
    want = [[{"gram": (n := next(count)), "ctx": -n, "pos": p, "t0": n % 7, "t1": n % 11, "hot": n % 3 == 0} for p in row] for row in at]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(range(5), pa.int64()), pa.array(texts, pa.binary()), pa.array(want, kind)], names=["tk", "tl", "text", "wanted"])
    expected = [(w["gram"], w["ctx"], w["t0"], w["t1"], w["hot"], min(w["pos"], 24), t[max(0, w["pos"] - 24) : w["pos"] + 40]) for t, row in zip(texts[1:], want[1:]) for w in row]
    del want
    got, most = [], 0
    tracemalloc.start()
    for b in suffix_dedup.around(iter([batch.slice(1)]), 24, 40):
        most = max(most, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert b.num_rows <= 1024
        got += zip(*(c.to_pylist() for c in b.columns))
        tracemalloc.start()
    tracemalloc.stop()
    assert got == expected
    assert most < 8 << 20  # Python's share; of a list of rows' dictionaries it was over 40 MB


def test_index_grows_by_batches(spark):
    texts = [t or "" for t in passages(random.Random(21))]
    index = suffix_dedup.RepeatIndex(suffix_dedup.Rule(80), gram=16)
    df = suffix_dedup.keyed(spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "n int, text binary"), F.col("text")).cache()
    of = {(r.tk, r.tl): bytes(r.text) for r in df.collect()}
    seen, marked = [], {}
    for at in range(0, len(texts), 20):
        found = index.add(df.where(f"n >= {at} and n < {at + 20}").select("tk", "tl", "text")).collect()
        seen = list(dict.fromkeys(seen + [t for t in texts[at : at + 20]]))
        for r in found:
            raw = of[r.tk, r.tl]
            gone = marked.setdefault(raw, np.zeros(len(raw), bool))
            for s in r.spans:
                if s["twice"]:
                    gone[max(0, s["pos"] - 64) : min(s["last"], len(raw) - 80) + 80] = True
                for f in s["found"] or ():
                    gone[s["pos"] + f["lo"] : s["last"] + f["hi"]] = True
        for t, want in zip(seen, brute_repeats(seen, 80)):
            assert int(marked.get(t.encode(), np.zeros(1)).sum()) == want[1]
        sizes = [n for n, _, _ in index.levels]
        assert sum(sizes) == len(seen) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_suffix_family_in_batches():
    rng = np.random.default_rng(12)
    n, spread, rules = 700, 24, (suffix_dedup.Rule(40), suffix_dedup.Rule(56, across=True))
    group, text = rng.integers(0, 12, n), rng.integers(0, 40, n)
    left = rng.integers(0, spread + 1, n)
    bodies = [bytes(rng.choice(3, size=k + int(rng.integers(16, 57)), p=(0.96, 0.03, 0.01)).astype(np.uint8)) for k in left]
    family = suffix_dedup.SuffixArrayFamily(rules, spread)
    for at in range(0, n, 50):
        part = slice(at, at + 50)
        family.add(group[part], text[part], text[part], left[part], pa.array(bodies[part], pa.binary()))
        sizes = [len(level[1]) for level in family.levels]
        assert sum(sizes) == at + 50 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    assert len(family.levels) > 1
    for k, rule in enumerate(rules):
        seen = {}
        for i in range(n):
            for x in range(left[i] + 1):
                w = bodies[i][left[i] - x : left[i] - x + rule.length]
                if len(w) == rule.length:
                    seen.setdefault((group[i], x, w), []).append(i)
        want = np.zeros((n, spread + 1), bool)
        for (_, x, _), rows in seen.items():
            if len({text[i] for i in rows} if rule.across else rows) > 1:
                want[rows, x] = True
        assert want.any() and (family.windows(k) == want).all()


def test_simhash(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choices("alpha beta gamma delta eps zeta eta theta".split(), k=400)) for _ in range(6)]
    texts = [b for b in base for _ in range(2)] + [b + " tail" for b in base] + ["", None, "one", "A b"]
    df = spark.createDataFrame([(i + 5, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp long")
    marks = []
    for t in texts:
        ws = regex.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))] if ws else []
        marks.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)))
    low = list(range(len(texts)))
    for _ in texts:
        low = [min(low[j] for j, b in enumerate(marks) if (a ^ b).bit_count() <= 3) for a in marks]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in fuzzy_simhash.near_duplicate_components(df).collect()}
    assert got == {i + 5: (f"{m:016x}", n + 5) for i, (m, n) in enumerate(zip(marks, low))}
    assert fuzzy_simhash.near_duplicate_components(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in fuzzy_simhash.keep_one_of_each(df).collect()) == sorted({n + 5 for n in low})


def test_golay_keys_meet():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
    ra, ka = fuzzy_simhash.golay_keys(a, True)
    rb, kb = fuzzy_simhash.golay_keys(b, False)
    assert {r for r, _ in set(zip(ra.tolist(), ka.tolist())) & set(zip(rb.tolist(), kb.tolist()))} == set(range(len(a)))


def test_searches(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:130] = x[50]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(9000, None, 0), (9050, [float("nan")] * 16, 0), (9100, [None] * 16, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long")
    ints = np.floor(x.astype(float) * 256).astype(np.int64)
    want = {}
    for q in range(0, 1500, 50):
        s = ints @ ints[q]
        want.update({(q, k + 1): (i, int(s[i])) for k, i in enumerate([j for j in np.lexsort((np.arange(1500), -s)) if j != q][:5])})
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in nra_topk.top_k_inner_products(df, block_rows=1500).collect()} == want
    hits = 0
    got = additive_ann.nearest(df, block_rows=800).toPandas()
    for q in range(0, 1500, 50):
        s = additive_ann.cosine(x[q].astype(float), x.astype(float))
        hits += len(set(got[got.query_id == q].vec_id) & {j for j in np.lexsort((np.arange(1500), -s)) if j != q and True} & set([j for j in np.lexsort((np.arange(1500), -s)) if j != q][:5]))
    assert hits / 150 >= 0.9
    assert got[got.query_id == 50].vec_id.tolist() == [100, 101, 102, 103, 104]
    for f in (nra_topk.top_k_inner_products, additive_ann.nearest):
        assert f(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 4, 500, 2000])
def test_top_k_stops_before_the_lists_end(n):
    rng = np.random.default_rng(n)
    x = np.floor(rng.normal(size=(n, 64)) * 32).astype(np.float32)
    ids, read = np.arange(n), []
    got = nra_topk.nra_block(ids[::50], x[::50], ids, x, 5, lists_read=read)
    want = []
    for own in ids[::50]:
        s = x @ x[own]
        want += [(own, i, int(s[i])) for i in [j for j in np.lexsort((ids, -s)) if j != own][:5]]
    assert sorted(zip(*got)) == sorted(want)
    assert n < 500 or np.mean(np.array(read) <= 48) > 0.9


def test_top_k_with_repeated_ids():
    rng = np.random.default_rng(11)
    x = np.floor(rng.normal(size=(1500, 16)) * 256).astype(np.float32)
    ids = np.arange(1500)
    ids[700:710] = 700
    x[700:710] = x[700] * 3  # ten rows of one id lead their own query's scores
    q = x[[700, 705, 20]]
    got_q, got_i, got_s = nra_topk.nra_block(ids[[700, 705, 20]], q, ids, x, 5)
    want = []
    for own, v in zip((700, 700, 20), q):
        s = x @ v
        want += [(own, int(ids[i]), int(s[i])) for i in [j for j in np.lexsort((ids, -s)) if ids[j] != own][:5]]
    assert sorted(zip(got_q, got_i, got_s)) == sorted(want)


def test_url_filter(spark):
    urls = ["https://a.example.org/es/x", "http://example.org/en/17", "http://X.ORG/", "http://notorg.net/", "http://b.com/de/1?q", "http://b.com/fr/", "http://org?x", "mailto:x", None, "http:///p", "http://a.com/de/1", "http://a.com/de/1"]
    got = Counter((r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame([(1, u) for u in urls], "page_id long, url string")).collect())
    assert got[("a.example.org", "/es/x", "example.org/es/", "block")] == 1 and got[("example.org", "/en/17", "example.org/en/1", "block")] == 1
    assert got[("x.org", "/", "org/", "allow")] == 1 and got[("org", "", None, "allow")] == 1 and got[("a.com", "/de/1", "com/de/", "block")] == 2
    assert got[("", "", None, "allow")] == 2 and sum(got.values()) == len(urls)


def test_html_text(spark):
    field = html_text.trained()
    right = total = 0
    for page, truth in html_text.labelled_pages(60, seed=99):
        _, labels = html_text.labelled_blocks(page, truth)
        right += sum(a == b for a, b in zip(labels, field.decode(html_text.leaf_blocks(page))))
        total += len(labels)
    assert right / total > 0.97
    page = "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &lt; B</h1><p>First  line\n here&nbsp;is. It goes on, and on, for some words.<p>Second one, also of a good length, ends here.</article><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(df, field).collect()}
    assert got == {1: "A < B\n\nFirst line here is. It goes on, and on, for some words.\n\nSecond one, also of a good length, ends here.", 2: "", None: ""}


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "c", None])) for i in range(900)] + [(7, None, None), (7, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, fan=8).withColumnRenamed("doc_id", "id").toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() < 60).all()
    assert abs(by.target.sum() - 1.5 * got["size"].sum()) < 1e-6
    again = mixing.mix(df.repartition(7), fan=8).toPandas()
    assert Counter(zip(again.doc_id, again.taken)) == Counter(zip(got.id, got.taken))
    assert mixing.mix(odd_rows(spark)).count() == 8 and mixing.mix(df.limit(0)).count() == 0


def test_mixing_of_equal_rows(spark):
    rows = [(None, "w w w", "a")] * 700 + [(3, "w " * 9, "a")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, share=0.5, fan=8).toPandas()
    assert len(got) == 1000 and abs(got.taken.sum() - got.target[0]) < 9
    assert 0 < (got[got["size"] == 3].taken > 0).mean() < 1


def water_level(sizes, weights, share, cap):
    """Brute force: the excess of full sources reshared until none is above its cap."""
    most, left, full = {s: cap * n for s, n in sizes.items()}, share * sum(sizes.values()), {}
    left = min(left, sum(most.values()))
    while True:
        open_ = [s for s in sizes if s not in full]
        rest = left - sum(full.values())
        got = {s: rest * weights[s] / sum(weights[t] for t in open_) for s in open_}
        over = [s for s in open_ if got[s] > most[s] + 1e-9]
        if not over:
            return full | got
        full |= {s: float(most[s]) for s in over}


def test_mixing_targets_are_the_water_level(spark):
    rng = random.Random(14)
    for _ in range(2):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 40, 400, 3000]) for i in range(9)}
        weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
        want = water_level({s: n for s, n in sizes.items() if n}, weights, 1.5, 2.0)
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
        for r in mixing.targets(df, (3.0, 1.0, 2.0), 1.5, 2.0).collect():
            assert abs(r.target - want.get(r.source, 0.0)) < 1e-6


def test_columns_of_any_name_pass(spark):
    schema = "doc_id long, text string, source string, `__at` int, `__key` int, key string, row int, times int, nth int, `a.b` map<string,int>"
    rows = [(i, f"some words of text number {i} " * 30, "s", 11, 22, "k", i, 3, 4, {"x": i}) for i in range(20)]
    df = spark.createDataFrame(rows, schema)
    for got in (fuzzy_simhash.keep_one_of_each(df), mixing.repeat_documents(df, share=1.0, cap=1.0)):
        assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == sorted(rows, key=lambda r: r[0])
    again = df.select("doc_id", "text", "source", "row").union(df.select("doc_id", "text", "source", F.col("row") + 100))
    kept = fuzzy_simhash.keep_one_of_each(again).collect()
    assert len(kept) == 20
    doubled = mixing.repeat_documents(again, share=2.0, cap=2.0).collect()
    assert Counter(r.row for r in doubled) == {r: 2 for r in [*range(20), *range(100, 120)]}


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(15)
    page = "<body>" + "".join(f"<p class=c{i}>{'word ' * int(n)}</p>" for i, n in enumerate(rng.integers(1, 30, 7)))
    blocks = html_text.leaf_blocks(page)
    names = sorted({f for fs in html_text.features(blocks) for f in fs})
    for _ in range(20):
        field = html_text.ChainField({f: tuple(rng.normal(size=2)) for f in names}, rng.normal(size=(2, 2)), rng.normal(size=2))
        emit = field.emissions(blocks)
        score = lambda y: field.first[y[0]] + sum(e[k] for e, k in zip(emit, y)) + sum(field.pairs[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert abs(score(field.decode(blocks)) - max(map(score, itertools.product((0, 1), repeat=len(blocks))))) < 1e-9


def test_html_of_broken_pages():
    texts = lambda page: [b.text for b in html_text.leaf_blocks(page)]
    assert texts("<p class=it's>hello there</p>") == ["hello there"]
    assert texts('<div title="a>hello</div><p class="x">b</p>') == ["hello", "b"]
    assert texts('<a href="x>y" title=\'a"b\'>c</a>') == ["c"]
    assert texts("<p>a<b>c<p>d") == ["ac", "d"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<ul><li>y<li>z</ul><li>w</ul>") == ["a", "b", "c", "x", "y", "z", "w"]
    long = "<span>" * 30_000 + "<div>x</div>" * 300 + "</b>" * 30_000 + "<li>y" * 300
    began = time.time()
    assert len(html_text.leaf_blocks(long)) == 600 and time.time() - began < 5
    field, article = html_text.trained(), "Just a paragraph on a bare page, of some length, that says what it has to say. And then it goes on a little."
    assert html_text.main_text(f"<html><body><p>{article}</p></body></html>", field) == article


def test_language_decoding_against_every_codeword(spark):
    rows = [(i, t, lang) for lang, t in (("en", "the cat and the dog went out"), ("de", "der Hund und die Katze gingen"), ("fr", "le chien et le chat sont partis"), ("es", "el perro y el gato se fueron")) for i in range(60)]
    df = spark.createDataFrame([(n, f"{t} {i}", lang) for n, (i, t, lang) in enumerate(rows)], "doc_id long, text string, lang string").withColumn("held_out", language_id.held_out())
    model = language_id.fit(df.where("not held_out"))
    got = language_id.identify(df.where("held_out"), model, keep=("lang",)).collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) == len(got) and all(0 <= r.score <= 1 for r in got)


def test_pipeline_stages(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    shared = words(90)
    rows = [(i, words(60), "en", f"s{i % 3}", 1, 0.5) for i in range(30)] + [(40, shared + words(80), "en", "s0", 1, None), (41, words(80) + shared, "en", "s1", 1, None), (42, "123", "en", "s1", 3, None), (43, None, None, None, None, None)]
    rows.append((50, rows[0][1], "en", "s2", 1, 0.5))
    docs = spark.createDataFrame(rows, schema)
    kept = docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        kept = stage(spark, kept, "").cache()
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.collect()]
        if n == 0:
            assert set(ids) == set(range(30)) | {40, 41, 50}
        if n == 1:
            assert sorted(ids) == [*range(30), 40, 41]
        if n == 2:
            texts = {r.doc_id: r.text for r in kept.collect()}
            assert shared[10:-10] not in texts[40] + texts[41] and texts[3] == rows[3][1]
    packed = corpus_pipeline.STAGES[4][1](spark, kept, "")
    assert packed.where("offset = 0").count() == packed.select("sequence_id").distinct().count()


def test_language_stage_rejects_what_it_cannot_tell(spark):
    rows = [(n, f"{t} {n}", lang) for lang, t, at in (("en", "the cat and the dog went out", 0), ("de", "der Hund und die Katze gingen", 100)) for n in range(at, at + 60)]
    rows += [(900, "ж", None), (901, "the dog went out and the cat", None), (902, "12", None), (903, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - {900, 902, 903}


def test_language_stage_without_labels(spark):
    rows = [(1, "one word", None), (2, "123 !!", None), (3, None, None), (4, "", None), (5, "日本", None), (1, "one word", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 5]
