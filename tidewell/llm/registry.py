"""The queries of the training-data operators and their oracles in SQL."""

from __future__ import annotations

from tidewell.llm.balls import op11_balls, oracle as balls_sql
from tidewell.llm.bpe import op7_bpe
from tidewell.llm.langid import op5_langid
from tidewell.llm.licences import op1_licences, oracle as licences_sql
from tidewell.llm.mixing import op9_mixing
from tidewell.llm.neighbours import op3_neighbours
from tidewell.llm.pii import op10_pii
from tidewell.llm.quality import op6_quality
from tidewell.llm.secrets import op12_secrets, oracle as secrets_sql
from tidewell.llm.simhash import op4_simhash
from tidewell.llm.spelling import op13_spelling
from tidewell.llm.suffixes import op2_suffixes
from tidewell.llm.warc import op8_warc


def queries() -> dict:
    found = (
        op1_licences, op2_suffixes, op3_neighbours, op4_simhash, op5_langid, op6_quality, op7_bpe, op8_warc, op9_mixing, op10_pii, op11_balls,
        op12_secrets, op13_spelling,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_licences": licences_sql(), "op11_balls": balls_sql(), "op12_secrets": secrets_sql()}
