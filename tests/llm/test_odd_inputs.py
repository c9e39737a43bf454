"""Every operator on nulls, empty, long and repeated texts, clashing columns and empty tables."""

import public_tokenizers
import pytest

from tidewell.llm import bpe, langid, licences, mixing, pii, quality, secrets, simhash, suffixes

PER_ROW = {
    "licences": licences.scan_licences,
    "suffixes": suffixes.without_repeats,
    "simhash": simhash.group_near_copies,
    "langid": lambda d: langid.identify(d, langid.train(d)),
    "quality": quality.judge,
    "bpe": lambda d: bpe.encode_decode(d, public_tokenizers.path(bpe.VOCABULARY)),
    "mixing": lambda d: mixing.packed(s := mixing.measured(d), mixing.targets(s)).join(s, "rid", "right").dropDuplicates(["rid"]),
    "pii": pii.find,
    "secrets": secrets.find,
}
STAGES = {"quality": quality.keep_good, "simhash": simhash.keep_one_of_each, "pii": pii.redacted, "mixing": mixing.mixed}


ODD = ("odd_docs", "empty_docs", "sparse_docs")


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each_row(name, request):
    for df in map(request.getfixturevalue, ODD):
        assert len(PER_ROW[name](df).collect()) == df.count()


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(name, request):
    for df in map(request.getfixturevalue, ODD):
        made = STAGES[name](df)
        assert made.columns == df.columns
        assert len(made.collect()) <= 2 * df.count()


CLASHING = ("row", "own", "key", "id", "rid", "size", "turn", "pieces", "taken", "made", "spans", "clean", "text_key", "_id", "_key", "_label", "__key", "__size", "__own", "__pass", "a.b")


@pytest.mark.parametrize("name", STAGES)
def test_stages_leave_other_columns_alone(name, docs):
    from pyspark.sql import functions as F

    clashing = docs.limit(60).withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)})
    made = STAGES[name](clashing)
    assert made.columns == clashing.columns
    rows = made.collect()
    assert rows and {tuple(r[c] for c in CLASHING) for r in rows} == {tuple(range(len(CLASHING)))}


def test_results(odd_docs):
    near = simhash.keep_one_of_each(odd_docs)
    assert near.where("text like 'a b c%'").count() == 1
    left = {(r.n_bytes, r.n_removed) for r in suffixes.without_repeats(odd_docs).collect()}
    assert (60_000, 60_000 - 1) in left
    kept = quality.keep_good(odd_docs)
    assert kept.where("text is null or length(text) < 10").count() == 0
