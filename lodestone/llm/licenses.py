"""Licence scan by a positional index of templates' rare words.

Document frequencies of the templates' words, counted over all documents, rank the words. Each template's rarest places are
looked up in every file; a posting (template, place) and the word's place in the file give the place where the template would
begin. A template has so many places in the index that every beginning with LEAST of its words in place meets VOTES of them,
whatever else the file holds. Such beginnings are verified by the share of words in place and the mandatory phrase.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow, utf8

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, mandatory phrase and words of paragraphs of well-known notices. Paragraphs are templates of their own, as files cut and reorder them.
NOTICES = (
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", "sublicense and or sell", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit", "copyright notice and this permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "distributed under the license is distributed on an as is basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "permissions and limitations under the license", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "gnu general public license", "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("lgpl", "gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("agpl", "gnu affero general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "endorse or promote products derived from this software", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "the author disclaims all warranties", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("mpl", "mpl was not distributed with this file", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("zlib", "including commercial applications", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("boost", "boost software license", "distributed under the boost software license version 1 0"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("wtfpl", "what the fuck you want to", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license"),
    ("cc0", "waived all copyright and related", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)
#: Names that a line of grant gives a licence, and what stands behind the name.
NAMES = (
    ("mit", "the mit license", ""), ("apache", "the apache license", "version 2 0"), ("gpl", "the gnu general public license", "version 3"), ("lgpl", "the gnu lesser general public license", "version 3"),
    ("agpl", "the gnu affero general public license", "version 3"), ("bsd", "the bsd license", ""), ("isc", "the isc license", ""), ("mpl", "the mozilla public license", "version 2 0"), ("boost", "the boost software license", "version 1 0"),
    ("epl", "the eclipse public license", "version 2 0"), ("cc-by", "cc by", "4 0"), ("cc-by-sa", "cc by sa", "4 0"), ("cc-by-nc", "cc by nc", "4 0"), ("cc-by-nd", "cc by nd", "4 0"), ("cc-by-nc-sa", "cc by nc sa", "4 0"),
    ("cc-by-nc-nd", "cc by nc nd", "4 0"), ("cc-by", "a creative commons attribution", "4 0 international license"), ("cc-by-sa", "a creative commons attribution sharealike", "4 0 international license"),
    ("cc-by-nc", "a creative commons attribution noncommercial", "4 0 international license"), ("cc0", "cc0", "1 0 universal"),
)
#: Identifiers in a file's one-line tag, as words.
TAGS = (("mit", "mit"), ("apache", "apache 2 0"), ("gpl", "gpl 2 0"), ("gpl", "gpl 3 0"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl", "agpl 3 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("isc", "isc"), ("mpl", "mpl 2 0"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("boost", "bsl 1 0"), ("epl", "epl 2 0"), ("cc0", "cc0 1 0"))
#: Label, mandatory phrase and words of every template: paragraphs, lines of grant by the rule "licensed under <name> <version>", tags.
TEMPLATES = (
    *NOTICES,
    # names that begin other names are told from them by what follows
    *[(label, name.removeprefix("the ").removeprefix("a ") + " 4" * version.startswith("4"), f"licensed under {name} {version}".strip()) for label, name, version in NAMES],
    *[(label, f"spdx license identifier {tag}", f"spdx license identifier {tag}") for label, tag in TAGS],
)
#: Looked-up places that must agree on a beginning before it is verified.
VOTES = 2
#: Share of a template's words that must stand at their places.
LEAST = 0.6
#: Score of a text with a phrase of the base, but no template.
PHRASE_SCORE = 0.5

#: A-Z to lower case; digits, a-z and bytes of other letters as they are; the rest parts words.
_fold = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_fold).split()


_phrases = [(words(p.encode()), label) for p, label in PHRASES.items()]
_templates = [(label, words(phrase.encode()), words(body.encode())) for label, phrase, body in TEMPLATES]
_vocabulary = frozenset(w for _, _, body in _templates for w in body)


def phrase_places(ws: list[bytes], phrase: list[bytes]) -> list[int]:
    """Every place where the phrase's words stand one after another; its last word is looked for first."""
    out, at, last = [], len(phrase) - 1, phrase[-1]
    while True:
        try:
            at = ws.index(last, at)
        except ValueError:
            return out
        if ws[at - len(phrase) + 1 : at + 1] == phrase:
            out.append(at - len(phrase) + 1)
        at += 1


class Index:
    """word -> [(template, place)], for the rarest places of each template."""

    def __init__(self, idf: dict[bytes, float]) -> None:
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, _, body) in enumerate(_templates):
            n = len(body)
            # a match may lack so many places; VOTES more can't all be among them
            lacking = n - next(m for m in range(n + 1) if m / n >= LEAST)
            for place in sorted(range(n), key=lambda i: (-idf.get(body[i], 0.0), body[i], i))[: lacking + VOTES]:
                self.postings[body[place]].append((t, place))

    def matches(self, ws: list[bytes]) -> list[tuple[str, int, float]]:
        """(label, first word, share of the template's words in place) of verified templates."""
        postings = self.postings
        votes: Counter[tuple[int, int]] = Counter()
        for at, w in enumerate(ws):
            if w in postings:
                for t, place in postings[w]:
                    votes[t, at - place] += 1
        out = []
        for (t, begin), n in votes.items():
            label, phrase, body = _templates[t]
            if n < VOTES:
                continue
            lo, hi = max(0, begin), min(len(ws), begin + len(body))
            share = sum(ws[i] == body[i - begin] for i in range(lo, hi)) / len(body)
            if share >= LEAST and phrase_places(ws[lo : max(hi, 0)], phrase):
                out.append((label, lo, share))
        return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df: Counter[bytes] = Counter()
    n = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            df.update(_vocabulary.intersection(words(text)))
            n += 1
    yield pa.record_batch([pa.array([b"", *df], pa.binary()), pa.array([n, *df.values()], pa.int64())], names=["word", "n"])


def word_rarity(docs: DataFrame) -> dict[bytes, float]:
    """Inverse document frequency of the templates' words over all documents: a row a word comes to the driver."""
    counted = map_arrow(docs.select(utf8(F.col("text")).alias("text")), _frequencies, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {bytes(r["word"]): r["n"] for r in counted.collect()}
    n = df.pop(b"", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in _vocabulary}


def _scan(idf: dict[bytes, float]):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for text in batch.column(1).to_pylist():
                ws = words(text)
                found = [(at, label) for phrase, label in _phrases for at in phrase_places(ws, phrase)]
                places, base = [at for at, _ in found], {label for _, label in found}
                matched = index.matches(ws)
                out["n_words"].append(len(ws))
                out["n_base"].append(len(found))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base.union(label for label, _, _ in matched))))
                out["score"].append(max((s for _, _, s in matched), default=PHRASE_SCORE if found else 0.0))
                out["spans"].append([{"label": label, "first_word": at, "share": s} for label, at, s in sorted(matched)])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("share", pa.float64())]))]
            yield pa.record_batch([batch.column(0), *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], names=["doc_id", *out])

    return f


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every document.

    A null text counts as empty: no words, no labels, score 0. Score is the largest share of a verified template's words, or
    PHRASE_SCORE where only phrases of the base stand. Texts of any length are read whole, equal rows are documents of their
    own, an empty table gives no rows. Only doc_id and text are read, so other columns may have any name.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, share: double>>"
    return map_arrow(docs.select("doc_id", utf8(F.col("text")).alias("text")), _scan(word_rarity(docs)), schema)
