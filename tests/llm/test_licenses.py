"""The licence classifier on held-out paragraphs and in documents."""

import numpy as np

from paperloom.llm import licenses


def test_texts_held_out_whole():
    """Rows of notices that no row of the fold's model was made from; figures for the README."""
    rows = licenses.labelled_rows()
    families, logits, gold = licenses.held_out(rows, 200, 2.0, 1e-5)
    model = licenses.fit(rows)
    p = model.probabilities(logits)
    best, none = p.argmax(1), families.index(licenses.NONE)
    named = best != none
    sure = named & (p.max(1) >= model.limit)
    print(f"held out: {(best == gold).mean():.3f} right, other paragraphs {(best == gold)[gold == none].mean():.3f}, limit {model.limit:.3f}, of {named.sum()} named {sure.sum()} above it, {(best == gold)[sure].mean():.3f} of them right")
    assert (best == gold)[gold == none].mean() >= 0.9
    assert (best == gold)[sure].mean() >= licenses.PRECISION


def test_scores_match_plain_python():
    rows = licenses.labelled_rows()[::7]
    model = licenses.fit(rows, rounds=20)
    texts = [r[0] for r in rows[::11]] + ["Apache License", "", "of Zoë the, the (License)!"]
    index = {int(k): i for i, k in enumerate(model.keys)}
    single = set(model.single.tolist())
    text, _, paragraph, h = licenses.grams(*licenses.as_chunk(texts))
    found = model.logits(*model.features(paragraph, h, len(text)))
    for row, t in zip(found, text.tolist()):
        words = h[paragraph == text.tolist().index(t)]
        want = model.bias.copy()
        for n in range(1, licenses.ORDERS + 1):
            for i in range(len(words) - n + 1):
                key = int(licenses.joined(words, np.array([i]), n)[0])
                if all(int(w) in single for w in words[i : i + n]) and key in index:
                    want += model.weights[index[key]] / len(words)
        assert np.allclose(row, want, atol=1e-5)


def test_units_cover_long_lines():
    paragraph = np.repeat([0, 1, 2], [3, 34, 16])
    unit, first, end = licenses.units(paragraph)
    assert list(zip(unit.tolist(), first.tolist(), end.tolist())) == [(0, 0, 3), (1, 3, 37), (2, 37, 53), (1, 3, 19), (1, 11, 27), (1, 19, 35), (1, 27, 37)]


def test_documents(spark):
    prose = "The river was wide and the boat small.\n\nThey went on under the bridge to see the general public house."
    rows = [
        (1, f"{prose}\nLicensed under the Apache License, Version 2.0.", 0),
        (2, f"Released under the MIT License.\n{prose}", 0),
        (3, prose, 0),
        (4, None, 0),
        (5, "", 0),
        (6, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.\nAll rights reserved.", 0),
        (None, "Licensed under CC BY-NC 4.0.", 0),
        (7, "to " * 50_000, 0),
        (8, "river boat bridge " * 30 + "Licensed under the Apache License, Version 2.0. " + "stone house " * 40, 0),
    ]
    found = {r.doc_id: r for r in licenses.find_licenses(spark.createDataFrame(rows + rows[:1], "doc_id long, text string, family int")).collect()}
    assert {i: r.family for i, r in found.items()} == {1: "apache", 2: "mit", 3: "none", 4: "none", 5: "none", 6: "gpl", None: "cc-by-nc", 7: "none", 8: "apache"}
    assert found[1].paragraphs == "3:apache:confirmed" and found[1].n_paragraphs == 3
    assert licenses.find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
