"""The registered queries as they are, and the pipeline, on tables of odd rows: final columns and values."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tidewell.llm import registry
from tests_llm_brute import base_spans, prints_of

COLUMNS = {
    "op1_licences": "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    "op2_suffixes": "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    "op3_neighbours": "query_id long, rank int, vec_id long, score double",
    "op4_simhash": "doc_id long, fingerprint string, component_id long",
    "op5_langid": "doc_id long, held_out boolean, lang_pred string, score double",
    "op6_quality": "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean",
    "op7_bpe": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    "op8_warc": "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    "op9_mixing": "doc_id long, size long, source_size long, target double, taken long",
    "op11_balls": "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string",
    "op12_secrets": "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    "op13_spelling": "word string, form string, root string, n long, n_near long, form_n long",
    "op10_pii": "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
}
TEXTS = [
    None, "", "\n", "one word", 'Mail a.b@c.org, call +1 (555) 555-0123, host 10.0.0.1, card 4111 1111 1111 1111; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"',
    "All rights reserved. CC BY, cc by", "a b c d e f g h i j k l m n o p " * 9, "a b c d e f g h i j k l m n o p " * 9, "ünïcode 😀 words here " * 20, "z" * 3000,
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    docs = [(k if k else None, t, ["en", "fr", None][k % 3], ["s", None][k % 2], len(t or ""), "x") for k, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, rid string").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(20 * k, [1.0, float(k)]) for k in range(4)] + [(None, [0.5, 0.5])], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(k, "u", t) for k, t in enumerate(TEXTS)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return str(d)


@pytest.fixture(scope="module")
def results(spark, folder):
    found = {}
    for name, build in registry.queries().items():
        df = build(spark, folder)
        kinds = dict(df.dtypes)
        for column, kind in (c.split() for c in COLUMNS[name].split(", ")):
            assert kinds[column] == {"long": "bigint"}.get(kind, kind), (name, column)
        found[name] = df.collect()
    return found


def test_a_row_for_each_document(results):
    for name, rows in results.items():
        if name not in ("op3_neighbours", "op11_balls", "op13_spelling"):
            assert len(rows) == len(TEXTS), name


def by_text(rows, key="doc_id"):
    return [next(r for r in rows if r[key] == (k if k or key == "page_id" else None)) for k in range(len(TEXTS))]


def test_final_values(results):
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for text, r in zip(TEXTS, by_text(results["op10_pii"])):
        spans = base_spans(text)
        assert r.base_sha256 == sha(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans).encode())
        assert {k: r[f"n_{k}"] for k in ("email", "ip", "card", "phone")} == {k: Counter(s[2] for s in spans)[k] for k in ("email", "ip", "card", "phone")}
        assert set(f"{kind}:{a}:{b}" for a, _, kind, b in spans) <= set(r.spans.split(","))
    for text, want, r in zip(TEXTS, prints_of(TEXTS), by_text(results["op4_simhash"])):
        assert r.fingerprint == f"{want:016x}"
    for text, r in zip(TEXTS, by_text(results["op7_bpe"])):
        assert r.decoded_sha256 == sha((text or "").encode())
    for text, r in zip(TEXTS, by_text(results["op9_mixing"])):
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) and 0 <= r.taken <= 2 * r["size"]
    for text, r in zip(TEXTS, by_text(results["op5_langid"])):
        doc_id = r.doc_id
        assert r.held_out == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or ""))) and 0 <= r.score <= 1
    for text, r in zip(TEXTS, by_text(results["op2_suffixes"])):
        assert r.n_bytes == len((text or "").encode())
    one = by_text(results["op1_licences"])[5]
    assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels, one.score) == (7, 3, 0, 5, "cc-by,reserved", 1.0)
    assert [(r.record_type, r.refers_to) for r in by_text(results["op8_warc"], "page_id")][:2] == [("revisit", 1), ("response", None)]
    assert all(r.base_failed or r.kept for r in results["op6_quality"] if r.doc_id == 8)
    assert sorted((r.query_id, r["rank"]) for r in results["op3_neighbours"]) == [(20 * k, n) for k in range(4) for n in range(1, 5)]


def test_pipeline_on_odd_rows(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert all(r.doc_id in range(len(TEXTS)) or r.doc_id is None for r in rows)
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0").repartition(2)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, empty, folder)
        assert docs.count() == 0
