"""The pipeline against its five stages in plain Python."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
import xxhash

import corpus_pipeline
from test_tables import fair
from test_texts import brute_ids, brute_verdicts, components
from tests_llm_brute import base_spans, prints_of
from tidewell.llm import bpe, mixing, pii, quality

WORDS = r"[^\x20\x09-\x0D]+"


def int32(value):
    return value.to_bytes(4, "little", signed=True)


def spark_hash(*values):
    """What ``xxhash64`` makes of columns: longs, strings and, as four bytes, ints; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            data = v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True)
            h = xxhash.xxh64_intdigest(data, h)
    return h - (h >> 63 << 64)


def good_ones(docs):
    """Counts, rates and halves by hand, the estimates in NumPy."""
    rows = []
    for d in docs:
        text = d["text"] or ""
        w = re.findall(WORDS, text)
        lines = [x for x in text.split("\n") if re.search(WORDS, x)]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered), *(len(re.findall(p, text)) for p in ("[AEIOUYaeiouy]", "[.,;:?!]", "[A-Z!]")))
        rows.append((repr((d["lang"], d["source"])), repr(d["lang"]), counts, failed))
    own, by_lang = defaultdict(lambda: np.zeros(6)), defaultdict(lambda: np.zeros(6))
    sums = lambda c: np.array([c[1], c[6], c[7], c[8], c[3], c[0]], float)  # noqa: E731  characters, vowels, marks, capitals, lines, words
    for g, gl, c, failed in rows:
        if not failed:
            own[g] += sums(c)
            by_lang[gl] += sums(c)
    prior, shrink, vectors, half = quality.PRIOR, quality.SHRINK * quality.PRIOR, [], []
    for d, (g, gl, c, failed) in zip(docs, rows):
        typical = (own[g][:5] + shrink * by_lang[gl][:5] / by_lang[gl][5]) / (own[g][5] + shrink) if g in own else np.array([5.0, 2.0, 0.1, 0.1, 0.1])
        chars, vowels, marks, shouts, n_lines = sums(c)[:5] + prior * typical
        n = c[0] + prior
        x = (math.log(chars / n), math.sqrt(vowels / chars), math.sqrt(marks / chars), math.sqrt(shouts / chars), math.log(n_lines / n))
        rates = (math.sqrt(c[2] / (c[1] + 5 * prior)), math.sqrt(c[4] / (c[3] + prior / 10)), math.sqrt(c[5] / n))
        whole = lambda values: [float(math.floor(v * quality.UNIT + 0.5)) for v in values]
        vectors.append((g, gl, whole(x), whole(rates), not failed))
        row_hash = spark_hash(d["doc_id"], spark_hash(d["text"]))
        half.append([spark_hash(row_hash, int32(s)) % 2 == 0 for s in range(quality.STARTS)])
    d2, far = brute_verdicts(vectors, np.array(half))
    return [d for d, v, a, b in zip(docs, vectors, d2, far) if v[4] and not (a > quality.CUTOFF or b > quality.RATES_CUTOFF)]


def one_of_each(docs):
    prints = prints_of([d["text"] for d in docs])
    label = components(set(prints), [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for d, p in zip(docs, prints):
        least[label[p]] = min(least.get(label[p], d["doc_id"]), d["doc_id"])
    return [d for d, p in zip(docs, prints) if d["doc_id"] == least[label[p]]]


def redacted(docs):
    added = defaultdict(list)
    for k, s, e in brute_ids([d["text"] for d in docs]):
        added[k].append((s, len(pii.PLAIN), "id", e))
    out = []
    for k, d in enumerate(docs):
        at, made = 0, ""
        for s, _, kind, e in sorted(base_spans(d["text"]) + added[k]):
            if s >= at:
                made += d["text"][at:s] + f"[{kind.upper()}]"
            at = max(at, e)
        text = made + d["text"][at:]
        out.append({**d, "text": text, "n_chars": len(text) if at else d["n_chars"]})
    return out


def place(x, n, *names):
    for r in range(1, mixing.ROUNDS + 1):
        other = (spark_hash(int32(mixing.SEED), *names, int32(r)) - x) % n
        if spark_hash(int32(mixing.SEED + 1), *names, int32(r), max(x, other)) % 2:
            x = other
    return x


def mixed(docs, int_chars):
    """Word by word: each source's words in their order, its slots until the target is met."""
    buckets = 1 + math.isqrt(len(docs))
    words, by_source = [re.findall(WORDS, d["text"]) for d in docs], defaultdict(list)
    for k, d in enumerate(docs):
        chars = int32(d["n_chars"]) if int_chars else d["n_chars"]
        key = spark_hash(d["doc_id"], d["text"], d["lang"], d["source"], chars)
        by_source[d["source"]].append((spark_hash(d["doc_id"], key) % buckets, d["doc_id"], key, k))
    target = fair({s: sum(len(words[m[3]]) for m in members) for s, members in by_source.items()})
    names = sorted((s for s in by_source if s is not None), key=str.encode) + [None] * (None in by_source)
    taken = defaultdict(set)
    for rank, s in enumerate(names, 1):
        stream = [(k, j) for *_, k in sorted(by_source[s]) for j in range(len(words[k]))]
        left, slot, n_blocks = math.floor(target[s] + 0.5), 0, -(-len(stream) // mixing.BLOCK)
        while left:
            b = place(slot % n_blocks, n_blocks, "block", rank)
            got = stream[b * mixing.BLOCK : (b + 1) * mixing.BLOCK][:left]
            for k, j in got:
                taken[k, slot // n_blocks].add(j)
            left, slot = left - len(got), slot + 1
    return [
        {**docs[k], "text": docs[k]["text"] if len(js) == len(words[k]) else " ".join(words[k][j] for j in sorted(js))} for (k, _), js in taken.items()
    ]


def encoded(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    ids = [(d["doc_id"], own.encode_ordinary(d["text"])) for d in docs]
    return sorted((k, len(i), sha(",".join(map(str, i)).encode()), sha(own.decode_bytes(i))) for k, i in ids)


def test_pipeline_against_plain_python(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clean = "the quiet words of an ordinary text about rivers and small towns by the sea that nobody has seen before"
    odd = [(10_000, None, "en", "s", None), (10_001, "", None, None, 0), (10_002, clean, None, None, len(clean)), (10_003, clean, "en", "alone", None), (10_004, "$ % | " * 90, "en", None, 9)]
    letters = ["they wrote to a.b@c.org and 10.0.0.1 about a secret of the old house by the river", "all of us had seen the ships leave before dawn, said her brother in a note to x@y.net"]
    letters += ["nobody else knew what the baker kept behind the mill while it rained all summer", "two of them walked north until the snow on the hills had gone and came back late"]
    odd += [(10_005 + k, f'{t}, token = "{hashlib.sha1(t.encode()).hexdigest()}", and so on', "xx", "other", None) for k, t in enumerate(letters)]
    table.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    written = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = [r.asDict() for r in written.collect()]
    good = good_ones(docs)
    single = one_of_each(good)
    hidden = redacted(single)
    assert 10_002 in {d["doc_id"] for d in single} and not {10_000, 10_001, 10_003, 10_004} & {d["doc_id"] for d in single}
    assert any("[ID]" in d["text"] and "[EMAIL]" in d["text"] for d in hidden)
    want = encoded(mixed(hidden, dict(written.dtypes)["n_chars"] == "int"))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want
    assert 0 < len(single) < len(good) < len(docs)
