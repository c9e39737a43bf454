"""The operators on texts against brute force."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests_llm_brute import base_spans, prints_of
from tidewell.llm import bpe, langid, licences, pii, quality, simhash, suffixes

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def tokens():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("etaoinshr dlu'st,.\n\x1c\x85　é²٣漢😀019", max_size=80))
def test_bpe_encodes_as_tiktoken(tokens, text):
    codec = bpe.codec(PATH)
    ids = codec.encode(text)
    assert ids == tokens.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()
    assert codec.digests(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_of_one_long_run(tokens):
    codec = bpe.codec(PATH)
    for text in ("ab" * 20_000, "=" * 20_000, "thethe" * 5_000):
        assert codec.encode(text) == tokens.encode_ordinary(text)


def test_bpe_over_documents(docs, tokens):
    got = {r.doc_id: list(r.ids) for r in bpe.token_ids(docs, PATH).collect()}
    assert got == {r.doc_id: tokens.encode_ordinary(r.text) for r in docs.collect()}


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("bucket", [0, 1, 32])
def test_simhash_links_lose_none(spark, bucket):
    rng = random.Random(bucket)
    prints = {0}
    for centre in (rng.getrandbits(64) for _ in range(15)):
        for _ in range(25):
            centre ^= 1 << rng.randrange(64)  # chains of single bits, and jumps of more
            prints.add(centre ^ ((1 << rng.randrange(64)) | (1 << rng.randrange(64)) | rng.choice([0, 1])))
            prints.add(centre)
    prints = sorted(prints)
    want = components(prints, [(a, b) for k, a in enumerate(prints) for b in prints[:k] if (a ^ b).bit_count() <= 2])
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    found = simhash.links(spark.createDataFrame(signed, "fp long").repartition(3), bucket).collect()
    met = [tuple(int(np.int64(x).astype(np.uint64)) for x in r) for r in found]
    assert all((a ^ b).bit_count() <= 2 for a, b in met)
    assert components(prints, met) == want


def test_simhash_over_documents(spark, docs, odd_docs):
    for df in (docs, odd_docs):
        rows = df.select("doc_id", "text").collect()
        prints = prints_of([r.text for r in rows])
        pairs = [(a, b) for k, a in enumerate(prints) for b in prints[:k] if (a ^ b).bit_count() <= 2]
        label = components(set(prints), pairs)
        least = {}
        for r, p in zip(rows, prints):
            if r.doc_id is not None:
                least[label[p]] = min(least.get(label[p], r.doc_id), r.doc_id)
        got = simhash.group_near_copies(df).collect()
        as_key = lambda rs: sorted(map(str, rs))
        assert as_key((r.doc_id, int(np.int64(r.fp).astype(np.uint64)), r.component_id) for r in got) == as_key((r.doc_id, p, least.get(label[p])) for r, p in zip(rows, prints))


def brute_removal(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot, many", [(3, 1 << 20), (50_000, 1 << 20), (50_000, 0), (3, 0)])
def test_suffixes_remove_what_repeats(spark, docs, monkeypatch, hot, many):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "MANY_RUNS", many)
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 30_000)
    monkeypatch.setattr(suffixes, "PARTITION_BYTES", 100_000)
    monkeypatch.setattr(suffixes, "PIECE", 50_000)
    rng = random.Random(3)
    base = "".join(rng.choice("ab") for _ in range(700))
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id < 120").collect()]
    rows += [(1000 + k, base[rng.randint(0, 500) :][: rng.randint(50, 400)] + "xyz" * rng.randint(0, 60)) for k in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "z" * 1000), (2003, base), (2003, base), (None, base), (2005, "é" * 120)]
    got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_removal(rows)


def test_suffixes_exchange_no_common_gram(spark, monkeypatch):
    """Where one passage stands in every document, the rows of one gram stay below ``HOT``, however many documents there are."""
    monkeypatch.setattr(suffixes, "HOT", 40)
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 2_000)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(250))
    for size in (200, 800):
        rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(120)) + passage) for k in range(size)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        dealt, _ = suffixes._dealt(df)
        most = lambda common: dealt.select("text", "slice").mapInArrow(suffixes._count_grams(common), "gram long, slice int, n int").groupBy("gram").count().agg({"count": "max"}).first()[0]
        common = suffixes.common_grams(dealt)
        assert len(common) and most(common) <= 40 < most(common[:0])
        monkeypatch.setattr(suffixes, "COMMON", 2)  # the rest goes the other way
        assert len(suffixes.common_grams(dealt)) == 2
        if size == 200:
            assert sorted(str(tuple(r)) for r in suffixes.without_repeats(df).collect()) == brute_removal(rows)
        monkeypatch.undo()
        monkeypatch.setattr(suffixes, "HOT", 40)
        monkeypatch.setattr(suffixes, "SLICE_BYTES", 2_000)


def test_suffixes_compare_left_contexts_by_bytes(monkeypatch):
    """The same spans if all left contexts hash alike."""
    rng = np.random.default_rng(1)
    n = 60
    shared = np.where(rng.random(n) < 0.7, 100, 40)
    lefts = rng.integers(0, 2, (n, suffixes.SPAN)).astype(np.uint8)
    lefts[10:20] = lefts[:10]
    owners = np.column_stack([rng.permutation(n), np.zeros(n, int), np.zeros(n, int), np.zeros(n, int), rng.integers(0, 60, n)])
    want = suffixes.repeated(shared, lefts, owners)
    monkeypatch.setattr(suffixes, "_BASE", np.uint64(0))
    monkeypatch.setattr(suffixes, "_MIX", np.uint64(0))
    assert want.any() and (suffixes.repeated(shared, lefts, owners) == want).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6) | st.text("ab", max_size=9).map(str.encode), max_size=12), min_size=1, max_size=7))
def test_loser_tree_merges(lists):
    runs = []
    for rows in lists:
        rows = sorted(rows)
        runs.append((rows, suffixes._shared(rows).tolist() if rows else []))
    order, shared = suffixes.LoserTree(runs).order()
    at = [0] * len(runs)
    merged = []
    for k in order:
        merged.append(runs[k][0][at[k]])
        at[k] += 1
    assert merged == sorted(x for rows in lists for x in rows)
    assert not merged or shared[1:] == suffixes._shared(merged).tolist()[1:]


def test_quality_counts(docs, odd_docs):
    for df in (docs, odd_docs):
        for r in quality.with_counts(df.select("text", "doc_id").withColumnRenamed("doc_id", "own").withColumn("raw", df.text)).collect():
            text = r.raw or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", text)
            lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            covered = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
            want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    good = [(k, " ".join(word() for _ in range(rng.randint(12, 600))), "en", "s") for k in range(400)]
    bad = [(1000 + k, " ".join(word() + "$&%" for _ in range(200)), "en", "s") for k in range(60)]
    bad += [(2000 + k, " ".join(word() * 6 for _ in range(200)), "en", "s") for k in range(30)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep_good(df).collect()}
    assert kept == {g[0] for g in good}


def test_quality_rejects_menus_and_keeps_boilerplate(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    header = line(9)
    good = [(k, "\n".join(line(12) for _ in range(rng.randint(1, 40))), "en", "s") for k in range(300)]
    good += [(500 + k, "\n".join([header, *[line(12) for _ in range(rng.randint(8, 20))], header]), "en", "s") for k in range(40)]
    menus = [(1000 + k, " | ".join(word() for _ in range(rng.randint(15, 160))), "en", "s") for k in range(60)]
    df = spark.createDataFrame(good + menus, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep_good(df).collect()}
    assert kept == {g[0] for g in good}
    assert abs(quality.chi_square_quantile(0.999, 5) - 20.515) < 0.001 and abs(quality.chi_square(4.3515, 5) - 0.5) < 1e-4


def test_quality_covariance_matters(spark, monkeypatch):
    """A text whose vowels and word lengths are each usual, but not together, is an outlier; with floors for an estimate it is none."""
    rng = random.Random(12)

    def text(vowels, n=240):
        size = round(2 + 14 * vowels)  # in this language longer words have more vowels
        word = lambda: "".join(rng.choice("aeio" if rng.random() < vowels else "tnshrdl") for _ in range(max(1, size + rng.randint(-1, 1))))
        return ".\n".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(n // 12))

    def crossed(vowels):
        return ".\n".join(" ".join("".join(rng.choice("aeio" if rng.random() < vowels else "tnshrdl") for _ in range(round(2 + 14 * (0.7 - vowels)))) for _ in range(12)).capitalize() for _ in range(20))

    rows = [(k, text(0.2 + 0.3 * k / 300)) for k in range(300)] + [(1000 + k, crossed(0.2 + 0.02 * k)) for k in range(4)]
    df = spark.createDataFrame([(k, t, "xx", "s") for k, t in rows], "doc_id long, text string, lang string, source string")
    kept = lambda: {r.doc_id for r in quality.judge(df).where("kept").collect()}
    assert kept() == set(range(300))
    monkeypatch.setattr(quality, "FACTOR", 0.0)
    monkeypatch.setattr(quality, "LEAST", (0.3, 0.08, 0.08, 0.08, 0.5))
    assert {1000, 1001, 1002, 1003} <= kept()


def test_quality_distances_are_calibrated(spark):
    """Of ordinary documents nearly all are kept; the median distance is near the chi-square's, 4.35 (less in a small table, where groups lean on the whole)."""
    judged = quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not base_failed and n_symbols < 0.02 * word_chars").collect()
    assert 1.5 < np.median([r.d2 for r in judged]) < 5.5
    assert sum(not r.kept for r in judged) <= 0.005 * len(judged)


def brute_verdicts(rows, half):
    """Estimates in NumPy: squared distances of vectors and of rates; ``half``: the rows of each start."""
    g, gl, x, rate, fit = [np.array(c) for c in zip(*rows)]
    x = np.hstack([x, rate])
    dim, least = quality.DIM, (np.array(quality.LEAST) * quality.UNIT) ** 2

    def moments(v):
        m = v.mean(0)
        return m, quality.FACTOR * (v.T @ v / len(v) - np.outer(m, m))[:dim, :dim]

    def factor(c):
        low = np.zeros_like(c)
        for j in range(dim):
            low[j, j] = max(c[j, j] - low[j, :j] @ low[j, :j], least[j]) ** 0.5
            for i in range(j + 1, dim):
                low[i, j] = (c[i, j] - low[i, :j] @ low[j, :j]) / low[j, j]
        return low

    def distance(v, m, c):
        return (np.linalg.solve(factor(c), (v - m)[:, :dim].T) ** 2).sum(0)

    core = {}
    for name in sorted(set(g)):
        own, best = x[(g == name) & fit], None
        for start in range(quality.STARTS):
            inner = own[half[(g == name) & fit, start]]
            if not len(inner):
                continue
            for _ in range(quality.STEPS):
                bins = np.floor(np.log2(distance(own, *moments(inner)) + 1e-9) * 16)
                near = np.array([(bins < b).sum() < quality.CORE * len(own) for b in bins])
                inner = own[near]
            volume = np.log(np.diag(factor(moments(inner)[1]))).sum()
            if best is None or volume < best[0] - 1e-12:
                best = volume, inner
        if best:
            core[name] = best[1]
    lang = {name: gl[g == name][0] for name in set(g)}
    out, far = np.full(len(g), np.nan), np.full(len(g), np.nan)
    if core:
        whole = moments(np.concatenate(list(core.values())))
        for name in set(g[fit]):
            kin = [v for k, v in core.items() if lang[k] == lang[name]]
            n_l, n = sum(map(len, kin)) / quality.CORE, len(core.get(name, ())) / quality.CORE
            wl, w = n_l / (n_l + quality.SHRINK), n / (n + quality.SHRINK)
            of_lang = moments(np.concatenate(kin)) if kin else whole
            of_own = moments(core[name]) if name in core else of_lang
            m, c = ((w * o + (1 - w) * (wl * k + (1 - wl) * t)) for o, k, t in zip(of_own, of_lang, whole))
            out[g == name] = distance(x[g == name], m, c)
            far[g == name] = (np.maximum(x[g == name][:, dim:] - m[dim:], 0) ** 2 / (np.array(quality.CHANCE) * quality.UNIT) ** 2).sum(1)
    return out, far


def test_quality_verdict_against_numpy(spark):
    """Estimates and verdicts on real documents, and on lone ones of a source and of a language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    clean = "the quiet words of an ordinary text about rivers and small towns by the sea that nobody has seen before"
    lone = [(10**6, "$ % & | < > # * " * 30, "xx", "s"), (10**6 + 1, clean, "en", "alone"), (10**6 + 2, "a$ b% c& d| e< f> g# h* " * 30 + " ".join(map(chr, range(97, 123))), "en", "other")]
    df = docs.union(spark.createDataFrame(lone, docs.schema)).repartition(3)
    vectors = quality.settle(quality._vectors(quality.settle(quality.with_counts(df))).withColumn("row_hash", F.xxhash64("doc_id", "text_key")))
    starts = [(F.pmod(F.xxhash64("row_hash", F.lit(s)), F.lit(2)) == 0).alias(f"h{s}") for s in range(quality.STARTS)]
    rows = vectors.select("*", *starts).collect()
    x = [([float(r[f"x{k}"]) for k in range(quality.DIM)], [float(r[f"r{k}"]) for k in range(quality.N_RATES)]) for r in rows]
    want = brute_verdicts([(r.g, r.gl, *v, not r.base_failed) for r, v in zip(rows, x)], np.array([[r[f"h{s}"] for s in range(quality.STARTS)] for r in rows]))
    got = {(r.doc_id, r.n_words, r.n_symbols, r.word_chars): r for r in quality.judge(df).collect()}
    for r, d2, far in zip(rows, *want):
        own = got[r.doc_id, r.n_words, r.n_symbols, r.word_chars]
        assert r.base_failed or abs(own.d2 - d2) <= 1e-6 * (1 + d2) and abs(own.far - far) <= 1e-6 * (1 + far)
        assert own.kept == (not r.base_failed and d2 <= quality.CUTOFF and far <= quality.RATES_CUTOFF)
    verdict = {k[0]: r.kept for k, r in got.items()}
    assert (verdict[10**6], verdict[10**6 + 1], verdict[10**6 + 2]) == (False, True, False)


def test_pii_base_spans(spark, docs, odd_docs):
    rng = random.Random(2)
    bits = ["a", "b.", "@", "c.d", "1", "22", "255.", "3.4", "+1 ", "(555) ", "-", " ", "é", "😀", "4111 1111 1111 1111", "x_y", "%", "+", "\n", "001.2.3.4", "."]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for k in range(1500)]
    rows += [(5000, "1" * 20_000 + "a@" * 3), (5001, "a" * 20_000 + "@b"), (5002, "1 " * 30_000), (5003, None)]
    rows += [(10_000 + k, r.text) for k, r in enumerate(docs.union(odd_docs.select(*docs.columns)).collect())]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans if s.kind != "id"] for r in found}
    assert got == {k: [(s, kind, e) for s, _, kind, e in base_spans(t)] for k, t in rows}


def brute_ids(texts):
    """The bootstrap in plain Python: (document, start, end) of what it adds."""
    token = regex.compile(r"(?<![A-Za-z0-9_])[A-Za-z_]{0,16}+[0-9](?:[\x20().+:_/-]{0,2}[0-9]|[A-Za-z])*+|(?<=[:=]\x20?[\x22\x27])[A-Za-z0-9_+/.=@-]++")
    words = lambda x: [w for w in regex.split(pii.BETWEEN, x) if w]
    occurrences, total = [], Counter()
    for k, text in enumerate(texts):
        text = text or ""
        total.update(words(text.lower()))
        base = base_spans(text)
        valid = {(s, e) for s, _, _, e in base}
        gaps = {kind: [m.span() for m in re.finditer(p, text)] for kind, p in pii.PLAIN.items()} | {"id": [m.span() for m in token.finditer(text)]}
        n_digits = lambda s, e: sum(c in "0123456789" for c in text[s:e])
        failed = [(s, e) for kind in ("ip", "card", "phone") for s, e in gaps[kind] if (kind not in {x for a, _, x, b in base if (a, b) == (s, e)}) and (kind != "card" or 12 <= n_digits(s, e) <= 19)]
        found = [(kind, s, e) for s, _, kind, e in base]
        found += [("id", s, e) for s, e in gaps["id"] if e - s >= pii.LEAST and not any(a < e and b > s for a, b in valid)]
        for kind, s, e in found:
            own = gaps[kind]
            at = own.index((s, e))
            before = text[own[at - 1][1] if at else 0 : s]
            before = (re.sub(r"^\S+", "", before[-pii.BESIDE :], flags=re.A) if len(before) > pii.BESIDE else before).lower()
            after = text[e : own[at + 1][0] if at + 1 < len(own) else len(text)]
            after = (re.sub(r"\S+$", "", after[: pii.BESIDE], flags=re.A) if len(after) > pii.BESIDE else after).lower()
            match, contexts, left, right = text[s:e], [], words(before), words(after)
            if len(left) > 1:
                contexts.append(f"b:{left[-2]} {left[-1]}")
            if left and right:
                contexts.append(f"a:{left[-1]} {right[0]}")
            if mark := regex.search(r"([\p{L}\p{N}_-]{1,32}\s{0,2}[:=(\[{<#\"'][\s:=(\[{<#\"']{0,6})$", before, regex.ASCII):
                contexts.append("m:" + re.sub(r"\s+", " ", mark[1], flags=re.A))
            mixed = re.fullmatch("[A-Za-z0-9]+", match) and re.search("[0-9]", match) and re.search("[A-Za-z]", match)
            runs = re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", match)) + f":{sum(c in '0123456789' for c in match)}"
            shape = (("hex" if re.fullmatch("[0-9A-Fa-f]+", match) else "mix") + str(len(match))) if mixed else runs
            seed = kind != "id" or bool(regex.search(pii.LABELS, before, regex.ASCII))
            refused = not seed and any(a < e and b > s for a, b in failed)
            occurrences.append((k, s, e, kind != "id", seed, refused, re.sub("[^A-Za-z0-9]", "", match).lower(), contexts, shape))
    edges, fixed, support, own = Counter(), {}, Counter(), Counter()
    for *_, seed, refused, instance, contexts, _ in occurrences:
        fixed[instance] = 1.0 if seed or fixed.get(instance) == 1.0 else 0.0 if refused or fixed.get(instance) == 0.0 else None
        edges.update((p, instance) for p in contexts)
    for (p, _), n in edges.items():
        support[p], own[p] = support[p] + 1, own[p] + n
    edges = {x: n for x, n in edges.items() if support[x[0]] >= pii.SUPPORT}
    score = {i: x or 0.0 for i, x in fixed.items()}
    for _ in range(pii.ROUNDS):
        scored, err = Counter(), {}
        for (p, i), n in edges.items():
            scored[p] += n * score[i]
        chance = lambda p: 0.0 if p[0] == "m" else math.prod(total[w] for w in p[2:].split(" ")) / sum(total.values())
        rating = {p: x / (max(own[p], chance(p)) + pii.DAMP) for p, x in scored.items()}
        for p, i in edges:
            err[i] = err.get(i, 1.0) * (max(1 - rating[p], 1e-9) if rating[p] >= pii.FAIR else 1.0)
        score = {i: (1 - err.get(i, 1.0)) if x is None else x for i, x in fixed.items()}
    by_shape = {}
    for *_, i, _, shape in occurrences:
        by_shape.setdefault(shape, []).append(i)
    forms = {f for f, own in by_shape.items() if sum(score[i] for i in own) / (len(own) + pii.DAMP) >= pii.CONFIDENCE and len(set(own)) >= pii.SUPPORT}
    good = lambda contexts, shape: any(rating.get(p, 0) >= (pii.FAIR if shape in forms else pii.CONFIDENCE) for p in contexts)
    return sorted({(k, s, e) for k, s, e, base, seed, _, _, contexts, shape in occurrences if not base and (seed or good(contexts, shape))})


#: Identifiers of forms that no seed has, in contexts that seeds also have; and numbers of the same forms elsewhere.
MEMBERS = [f"our records show member no: {k * 7919 % 100_000:05d}/{chr(97 + k % 26)} joined late" for k in range(20)]
MEMBERS += [f"our records show member no: user{k}@mail{k}.org joined late" for k in range(40)] + [f"please reach me under 555-{k:05d} until noon" for k in range(15)]
MEMBERS += [f"please reach me under +1 (555) 555-{k:04d} until noon" for k in range(40)] + [f"the order of {(k + 50) * 7919 % 100_000:05d}/{chr(97 + k % 26)} and the rest" for k in range(25)]
MEMBERS += [f"the order of user{k}@shop.org and the rest" for k in range(6)] + ["the order of things and the rest was the order of the day"] * 60


def test_pii_discovers_forms_that_no_seed_has(spark, monkeypatch):
    """Held-out forms in seeds' contexts are found, the same forms elsewhere are not; without scoring neither holds."""
    df = spark.createDataFrame(list(enumerate(MEMBERS)), "doc_id long, text string").repartition(3)
    ids = lambda: {r.doc_id for r in pii.find(df).collect() if any(s.kind == "id" for s in r.spans)}
    want = {k for k, t in enumerate(MEMBERS) if re.search(r"no: [0-9]{5}/|under 555-", t)}
    assert ids() == want and len(want) == 35
    monkeypatch.setattr(pii, "CONFIDENCE", 0.1)
    monkeypatch.setattr(pii, "FAIR", 0.1)
    assert ids() > want
    monkeypatch.undo()
    monkeypatch.setattr(pii, "ROUNDS", 1)
    monkeypatch.setattr(pii, "CONFIDENCE", 1.1)
    monkeypatch.setattr(pii, "FAIR", 1.1)
    assert ids() == set()


def test_pii_needs_a_context(spark):
    """Numbers that the card check refuses, and version numbers, are nothing by their shape; in running text they are not told from others."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(4))
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012888888881881", "4222222222222"]
    texts = [f"{word()} {word()} {rng.choice(cards)} {word()} {word()}" for _ in range(60)]
    texts += [f"{word()} {word()} {k}111222233334440 {word()} {word()}" for k in range(1, 60)] + [f"release 1.2.3.{300 + k} of the tool" for k in range(20)]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert not [s for r in found for s in r.spans if s.kind == "id"]


def test_pii_bootstrap_against_plain_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text for r in df.orderBy("doc_id").collect()] + MEMBERS
    texts += [f"key: '{c * 3}{k}' and user = \"name.{c}x\" sent from the box 10.0.0.{k} at 2024" for k, c in enumerate("abcdefgh")]
    texts += [f"user = \"name{c}@mail.org\" was here in the year 199{k}" for k, c in enumerate("stuvwxyz")] + [None, "", "password: abc123", "ſecret = 'x1234'"]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    got = sorted((r.doc_id, s.start, s.end) for r in found for s in r.spans if s.kind == "id")
    assert got == brute_ids(texts)
    shown = [texts[k][s:e] for k, s, e in got]
    tokens = [m for t in texts if t for m in re.findall('token = "([0-9a-fA-F]{40})"', t)]
    assert len(tokens) > 5 and sorted(t for t in shown if len(t) == 40) == sorted(tokens)
    assert "name.ax" in shown and not any(t.startswith("199") or t == "2024" for t in shown)


def test_pii_redacts(spark):
    texts = [f"some words then please call me at +1 (555) 555-{k:04d} for more" for k in range(40)]
    texts += ["and so please call me at 555-12345 for more", "the year 20241 was long", None]
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in enumerate(texts)], "doc_id long, text string, __key int, __id int, spans int")
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.find(df).collect()}
    assert found[40] == [("id", "555-12345")] and found[41] == [] and found[3][0][0] == "phone"
    clean = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert clean[40].text == "and so please call me at [ID] for more" and clean[42].text is None
    assert clean[3].text == "some words then please call me at [PHONE] for more"
    assert {(r["__key"], r["__id"], r.spans) for r in clean.values()} == {(1, 2, 3)}


def test_licences_match_sql(spark, docs, odd_docs):
    rng = random.Random(9)
    notices = [t for _, t in licences.TEMPLATES + licences.NOTICES] + list(licences.PHRASES) + ["CC-BY", "cc by cc by", "General  Public\nLicense"]
    texts = [" ".join(rng.choice(["lorem", "ipsum", "the", "of", "license", rng.choice(notices)]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(docs.select("doc_id", "text")).union(odd_docs.select("doc_id", "text"))
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.sql(licences.oracle())
    columns = want.columns
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in licences.scan_licences(df.repartition(3)).collect())
    assert got == sorted(tuple(map(shown, r)) for r in want.fetchall())
    pattern = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for t in texts[:50]:
        assert licences.words(t) == [w.encode() for w in pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))]


def test_licences_tell_sisters_apart(spark):
    """What a notice or body names and no more: not its sister license, nor words that only lie near one another."""
    body = lambda label, k=0: [t for name, t in licences.BODIES if name == label][k]
    cases = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "GNU Lesser General Public License": "gpl,lgpl",
        "GNU Affero General Public License": "agpl,gpl",
        "the mozilla firefox public beta license plate": "",
        "creative people and common attribution license commons": "",
        "Licensed under the Apache License, Version 2.0": "apache",
        "a license, licensed or not, under the common apache": "",
        body("gpl"): "gpl", body("lgpl"): "gpl,lgpl", body("agpl"): "agpl,gpl", body("mit"): "mit", body("isc"): "isc", body("zlib"): "zlib",
        body("bsd", 2): "bsd", body("boost"): "boost", body("apache", 1): "apache", " ".join(body("mit").split()[::5]): "",
        "word " * 40 + body("mit")[:500] + " word" * 40: "mit",
    }
    texts = list(cases)
    got = licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {texts[r.doc_id]: r.labels for r in got} == cases
    gpl = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text like '%licensed under the GNU General Public License%'")
    assert {r.labels for r in licences.scan_licences(gpl).collect()} == {"gpl"}


def test_language_of_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(df, langid.train(df)).join(df.select("doc_id", "lang", "text"), "doc_id").collect()
    tried = [r for r in got if r.held_out]
    assert len(tried) > 200 and sum(r.lang_pred == r.lang for r in tried) >= 0.97 * len(tried)
    assert all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_language_needs_letters():
    x = np.zeros(langid.FEATURES, np.float32)
    assert langid.Model([("en", x)]).predict("1 2 ...") == ("und", 0.0)
    assert langid.Model([("en", x)]).predict("a") == ("en", 1.0) or langid.Model([("en", x)]).predict("a")[0] == "en"
    assert langid.Model([]).predict("a") == ("und", 0.0)
