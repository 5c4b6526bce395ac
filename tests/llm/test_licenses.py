import re

from lodestone.llm import licenses

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(ws), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at}))


def test_base(spark, small, docs, rows, nothing):
    out = licenses.scan_licenses(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=str) == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    real = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in real.collect()}
    for r in licenses.scan_licenses(real).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert licenses.scan_licenses(nothing).count() == 0


def test_templates(spark):
    label, _, body = licenses.TEMPLATES[3]
    ws = body.split()
    altered = ws[:12] + ["other"] + ws[13:]
    rows = [(1, "Intro. " + body.upper() + " and more"), (2, "some words " + " ".join(altered)), (3, " ".join(reversed(ws))), (4, "redistribution and use in source")]
    out = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].labels == label and out[1].score == 1.0 and out[1].spans[0].first_word == 1
    assert out[2].labels == label and 0.9 < out[2].score < 1
    assert out[3].labels == "" and out[4].labels == "" and out[4].score == 0


def test_no_template_hides_another(spark):
    bodies = [body for _, _, body in licenses.TEMPLATES]
    every = {label for label, _, _ in licenses.TEMPLATES}
    strewn = " x ".join(sorted({w for body in bodies for w in body.split()}))
    rows = [(0, " stop ".join(bodies)), (1, f"{strewn} stop {' stop '.join(bodies)}")]
    # common words are the least rare, as in any prose
    rows += [(100 + i, "a and any as by can for from in is it may not of or that the this to under use with you your") for i in range(40)]
    # every template alone among all templates' words, and with as many words altered as a match may have, at its rarest places
    idf = {w: float(i) for i, w in enumerate(sorted(licenses._vocabulary))}
    for i, (_, phrase, body) in enumerate(licenses.TEMPLATES):
        rows.append((10 + i, f"{strewn} stop {body}"))
        ws, kept = body.split(), phrase.split()
        at = next(j for j in range(len(ws)) if ws[j : j + len(kept)] == kept)
        lacking = len(ws) - next(m for m in range(len(ws) + 1) if m / len(ws) >= licenses.LEAST)
        free = sorted((j for j in range(len(ws)) if not at <= j < at + len(kept)), key=lambda j: -idf[ws[j].encode()])
        altered = ["zz" if j in free[:lacking] else w for j, w in enumerate(ws)]
        share = sum(a == b for a, b in zip(altered, ws, strict=True)) / len(ws)
        assert (licenses.TEMPLATES[i][0], 0, share) in licenses.Index(idf).matches([w.encode() for w in altered])
    out = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = lambda r: {x.label for x in r.spans if x.share == 1.0}
    assert whole(out[0]) == whole(out[1]) == every
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in whole(out[10 + i])


def brute_templates(text):
    """Labels and the largest share, by trying every template at every place."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    labels, score = set(), 0.0
    for label, phrase, body in licenses.TEMPLATES:
        body, phrase = body.split(), phrase.split()
        for begin in range(1 - len(body), len(ws)):
            same = sum(1 for i, w in enumerate(body) if 0 <= begin + i < len(ws) and ws[begin + i] == w)
            part = ws[max(0, begin) : begin + len(body)]
            if same / len(body) >= licenses.LEAST and any(part[i : i + len(phrase)] == phrase for i in range(len(part))):
                labels.add(label)
                score = max(score, same / len(body))
    return labels, score


def test_labels_and_score_by_brute_force(spark, small):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r.text and len(r.text) < 600][:40]
    lines = [
        "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "// SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "you may copy this", "Distributed under the Boost Software License, Version 1.0.", "the license is ours", None, "",
    ]
    rows = real + [(10_000 + i, t) for i, t in enumerate(lines)] + [(20_000 + i, f"a b {body} c") for i, (_, _, body) in enumerate(licenses.TEMPLATES)]
    out = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        base = set(filter(None, brute(text)[4].split(",")))
        labels, score = brute_templates(text)
        assert out[doc].labels == ",".join(sorted(labels | base)) and abs(out[doc].score - (score or (licenses.PHRASE_SCORE if base else 0.0))) < 1e-12
    assert [out[10_000 + i].labels for i in range(6)] == ["mit", "gpl", "cc-by-nc", "apache", "gpl", "cc-by-sa"]


def test_the_index_finds_what_the_base_does_not(spark, small):
    found = licenses.scan_licenses(spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/documents.parquet")).filter("labels <> ''")
    assert found.filter("size(spans) > 0").count() >= 0.9 * found.count() and found.filter("labels <> base_labels").count() > 0
