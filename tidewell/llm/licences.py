"""License scans: an exact set-similarity join of text blocks with license templates.

Words are runs of letters, digits and non-ASCII code points, lower case. A text's blocks
are ``BLOCK`` (64) words long and start every ``STEP`` (32) words, so that every passage of up to 32
words lies in one. A block matches a template if it holds at least ``CONTAINED`` (0.8) of the
template's different words. The templates are the texts of short licenses and the notices that longer ones ask for, cut into pieces
of up to 32 words. A piece that a passage of another license would match is left out: what sister licenses share speaks for none of them,
and their names, which are notices, tell them apart.

The join: the templates' words are ordered by how often the whole corpus has them, rarest
first. A match of a template of ``n`` words needs ``need = ceil(0.8 n)`` of them, so a
block must hold one of its first ``n - need + 1``: only blocks with such a word are
written out, with their template words in that order (the prefix filter). Those join the
templates by prefix word; blocks with fewer than ``need`` words fall out (length), as do
pairs in which too few words are left after the shared one (position). What remains is
counted exactly. The templates, a parameter, are all that is broadcast; their
words' counts are all that the driver sees.

The base phrases, and short notices that name a license, are templates of the same join of which a block must hold all words. In the blocks
that it finds, the words must also stand one after the other. Each place counts in the one
block in whose first ``STEP`` words it starts.

Defined cases: a null or wordless text has no words and no labels (null first and last
places, empty strings, score 0); repeated rows are scanned alike; an empty table or partition gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import settle, table

BLOCK, STEP = 64, 32
CONTAINED = 0.8
#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that name a license, held whole and in order as the base phrases are.
NOTICES = (
    ("agpl", "gnu affero general public license"), ("agpl", "licensed under the agpl"),
    ("apache", "licensed under the apache license"), ("apache", "apache license version 2 0"), ("apache", "released under the apache license"),
    ("bsd", "distributed under bsd license"), ("bsd", "distributed under the bsd license"), ("bsd", "bsd 3 clause license"), ("bsd", "bsd 2 clause license"),
    ("cc-by", "creative commons attribution license"), ("cc-by", "creative commons attribution 4 0 international"), ("cc-by", "creative commons attribution 3 0"),
    ("cc-by-nc", "cc by nc"), ("cc-by-nd", "cc by nd"), ("cc-by-sa", "cc by sa"), ("cc-by-sa", "creative commons attribution sharealike"), ("cc-by-sa", "creative commons attribution share alike"),
    ("cc0", "creative commons zero"), ("cc0", "cc0 1 0 universal"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"), ("lgpl", "gnu library general public license"),
    ("mit", "released under mit license"), ("mit", "released under the mit license"), ("mit", "licensed under the mit license"),
    ("mpl", "mozilla public license"),
)
#: The texts of short public licenses, and the notices that longer ones ask for, as words.
BODIES = (
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the corresponding source of your version"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format and to adapt remix transform and build upon the material for any purpose even commercially"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made you may do so in any reasonable manner but not in any way that suggests the licensor endorses you or your use"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details you should have received a copy of the gnu lesser general public license along with this library if not write to the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
)


def pieces(text: str, most: int = STEP) -> list[str]:
    """A text's words in even pieces of at most ``most``."""
    w = text.split()
    n = -(-len(w) // most)
    return [" ".join(w[len(w) * k // n : len(w) * (k + 1) // n]) for k in range(n)]


def distinctive(bodies) -> tuple[tuple[str, str], ...]:
    """The pieces of bodies that no passage of another license contains: what sisters share speaks for none of them."""

    def held(piece: str, other: str) -> bool:
        own, w = set(piece.split()), other.split()
        return any(len(own & set(w[k : k + BLOCK])) >= CONTAINED * len(own) for k in range(max(1, len(w) - BLOCK + 1)))

    every = [(label, piece) for label, body in bodies for piece in pieces(body)]
    return tuple((label, piece) for label, piece in every if not any(name != label and held(piece, other) for name, other in bodies))


#: What is joined with the blocks: ``(label, text)``.
TEMPLATES = distinctive(BODIES)
_BREAKS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
SCAN = "n_words long, blocks array<struct<no long, words array<int>, at array<int>, seq array<int>>>"


def words(text: str | None) -> list[bytes]:
    """The text's words, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_BREAKS).split()


def template_table(templates, notices, counts: dict[str, int]) -> tuple[dict[str, int], list[tuple]]:
    """Each word's rank, rarest first, and the templates as (no, label, base, phrase, words by rank, need); phrases first."""
    phrases = [(label, text, True) for text, label in PHRASES.items()] + [(label, text, False) for label, text in notices]
    texts = [text for _, text, _ in phrases] + [text for _, text in templates]
    every = sorted({w for text in texts for w in text.split()}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(every)}
    rows = []
    for no, (label, text, base) in enumerate(phrases):
        own = sorted({rank[w] for w in text.split()})
        rows.append((no, label, base, [rank[w] for w in text.split()], own, len(own)))
    for no, (label, text) in enumerate(templates):
        own = sorted({rank[w] for w in text.split()})
        rows.append((len(phrases) + no, label, False, None, own, math.ceil(CONTAINED * len(own) - 1e-9)))
    return rank, rows


COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def word_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> DataFrame:
    """``(word, n)``: how often all texts have each word of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column("text"):
                for w in filter(vocabulary.__contains__, words(text.as_py())):
                    total[w] = total.get(w, 0) + 1
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in total], "n": list(total.values())}, COUNTS)

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scanned(docs: DataFrame, rank: dict[str, int], prefix: frozenset[int]) -> DataFrame:
    """Every document with the blocks that hold a prefix word: their template words, as a set and where they stand."""
    ranks = {w.encode(): k for w, k in rank.items()}

    def scan(text: str | None) -> tuple:
        tokens = words(text)
        known = [(at, k) for at, k in enumerate(map(ranks.get, tokens)) if k is not None]
        blocks: dict[int, list] = {no: [] for at, k in known if k in prefix for no in (at // STEP - 1, at // STEP) if no >= 0}
        for at, k in known:
            for no in (at // STEP - 1, at // STEP):
                if no in blocks:
                    blocks[no].append((at, k))
        held = [
            {"no": no, "words": sorted({k for _, k in own}), "at": [at for at, _ in own], "seq": [k for _, k in own]}
            for no, own in sorted(blocks.items())
        ]
        return len(tokens), held

    @F.pandas_udf(SCAN)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            made = [scan(t) for t in batch]
            yield pd.DataFrame({"n_words": pd.Series([n for n, _ in made], dtype="int64"), "blocks": pd.Series([b for _, b in made], dtype=object)})

    return docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), run("text").alias("s")).select("rid", "doc_id", "s.*")


def block_matches(documents: DataFrame, rows: list[tuple]) -> DataFrame:
    """``(rid, no, label, base, phrase, contained, at, seq)``: every block that a template is contained in."""
    templates = documents.sparkSession.createDataFrame(rows, "template int, label string, base boolean, phrase array<int>, own array<int>, need int")
    prefix = templates.select("*", F.posexplode(F.slice("own", F.lit(1), F.size("own") - F.col("need") + 1)).alias("first", "word"))
    blocks = documents.select("rid", F.inline("blocks"))
    entries = blocks.select("rid", "no", "words", "at", "seq", F.posexplode("words").alias("place", "word"))
    met = entries.join(F.broadcast(prefix), "word").where(F.size("words") >= F.col("need"))
    left = F.least(F.size("own") - F.col("first"), F.size("words") - F.col("place"))
    met = met.where(F.least("first", "place") + left >= F.col("need"))
    shared = F.size(F.array_intersect("own", "words"))
    once = F.element_at(F.array_intersect("own", "words"), 1) == F.col("word")  # a pair meets at each shared prefix word
    return met.where(once & (shared >= F.col("need"))).select("rid", "no", "label", "base", "phrase", (shared / F.size("own")).alias("contained"), "at", "seq")


def places():
    """Of a block that holds a phrase's words: the places in its first ``STEP`` words where they stand one after the other."""
    follows = lambda i, j: F.coalesce(
        (F.get(F.col("seq"), i + j) == F.get(F.col("phrase"), j)) & (F.get(F.col("at"), i + j) == F.get(F.col("at"), i) + j), F.lit(False)
    )
    each = F.transform("at", lambda p, i: F.when((p < (F.col("no") + 1) * STEP) & F.forall(F.sequence(F.lit(0), F.size("phrase") - 1), lambda j: follows(i, j)), p))
    return F.array_compact(each)


def scan_licences(docs: DataFrame, templates=TEMPLATES, notices=NOTICES) -> DataFrame:
    vocabulary = frozenset(w.encode() for text in [*PHRASES, *(t for _, t in notices), *(t for _, t in templates)] for w in text.split())
    counts = {r.word: r.n for r in word_counts(docs, vocabulary).collect()}  # a row for each template word at most
    rank, rows = template_table(templates, notices, counts)
    prefix = frozenset(w for *_, own, need in rows for w in own[: len(own) - need + 1])
    documents = settle(scanned(docs, rank, prefix))
    found = block_matches(documents, rows).withColumn("places", F.when(F.col("phrase").isNotNull(), places()))
    found = found.where("phrase is null or size(places) > 0")
    base = lambda c: F.when(F.col("base"), c)
    by_row = found.groupBy("rid").agg(
        F.sum(base(F.size("places"))).alias("n"), F.min(base(F.array_min("places"))).alias("first"), F.max(base(F.array_max("places"))).alias("last"),
        F.collect_set(base(F.col("label"))).alias("base"), F.collect_set("label").alias("all"), F.max("contained").alias("best"),
    )
    df = documents.drop("blocks").join(by_row, "rid", "left")
    shown = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return df.select(
        "doc_id", "n_words", F.coalesce("n", F.lit(0)).cast("long").alias("n_base"),
        F.col("first").cast("long").alias("first_word"), F.col("last").cast("long").alias("last_word"),
        shown("base").alias("base_labels"), shown("all").alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"),
    )


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in SQL: every block against every template, without filters."""
    quoted = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)
    phrases = [(label, text, True) for text, label in PHRASES.items()] + [(label, text, False) for label, text in NOTICES]
    named = ", ".join(f"('{label}', '{text} ', {base})" for label, text, base in phrases)
    longest = max(len(text.split()) for _, text, _ in phrases)
    ahead = ", ".join(f"lead(word, {k}) OVER o" for k in range(1, longest))
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
u AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
h AS (SELECT rid, pos, concat_ws(' ', word, {ahead}) || ' ' AS ahead FROM u WINDOW o AS (PARTITION BY rid ORDER BY pos)),
p AS (SELECT rid, label, base, pos FROM h JOIN (VALUES {named}) v(label, phrase, base) ON starts_with(ahead, phrase)),
base AS (SELECT rid, count(*) FILTER (base) AS n, min(pos) FILTER (base) AS lo, max(pos) FILTER (base) AS hi, list(DISTINCT label) FILTER (base) AS own, list(DISTINCT label) AS labels FROM p GROUP BY rid),
t AS (SELECT label, list_distinct(string_split(body, ' ')) AS own FROM (VALUES {quoted}) v(label, body)),
b AS (SELECT rid, list_distinct(ws[b.k * {STEP} + 1 : b.k * {STEP} + {BLOCK}]) AS own FROM w, range(len(ws) // {STEP} + 1) b(k)),
m AS (SELECT rid, label, len(list_intersect(b.own, t.own)) / len(t.own) AS c FROM b, t
      WHERE len(list_intersect(b.own, t.own)) >= ceil({CONTAINED} * len(t.own) - 1e-9)),
f AS (SELECT rid, list(DISTINCT label) AS labels, max(c) AS best FROM m GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base.own), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(f.labels, []))), ','), '') AS labels,
       CASE WHEN base.labels IS NOT NULL THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN f USING (rid)"""
