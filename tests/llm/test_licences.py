import math
import random
import textwrap

import pytest

from parlance.llm import licences

BACK = [licences.normal(" ".join(random.Random(i).choice(["river", "stone", "the", "of", "light", "under", "public", "house", "version", "all"]) for _ in range(14)).encode()) for i in range(300)]


@pytest.fixture(scope="module")
def model():
    return licences.train(BACK)


def test_templates_and_damaged_templates_are_named(model):
    rng = random.Random(1)
    right = total = 0
    for family, templates in licences.TEMPLATES.items():
        for t in templates:
            words = licences.normal(t.encode()).split()
            for i in range(5):
                kept = [w for w in words if i == 0 or len(words) < 8 or rng.random() > 0.08]
                p = model.probabilities([b" ".join([*kept, b"river", b"stone"][: None if i else -2])])[0]
                right += licences.FAMILIES[int(p.argmax())] == family
                total += 1
    assert right / total >= 0.95


def test_background_is_unknown(spark, model):
    """Random runs of words of which three in eight stand in templates: most are unknown, and none is confirmed."""
    other = [" ".join(random.Random(1000 + i).choice(["sky", "stone", "the", "of", "light", "all", "public", "rights"]) for _ in range(12)) for i in range(200)]
    p = model.probabilities([licences.normal(t.encode()) for t in other])
    assert (p.argmax(1) == len(licences.TEMPLATES)).mean() >= 0.8
    df = spark.createDataFrame(list(enumerate(other)), "doc_id long, text string")
    assert licences.scan(df, model).where("n_licence_paragraphs > 0").count() == 0


def test_scan_rows_nulls_and_repeats(spark, model):
    rows = [
        (1, "some text\nReleased under the MIT License.\nmore"), (1, "some text\nReleased under the MIT License.\nmore"), (2, None), (3, ""), (4, "the public house of light under the stone"),
        (5, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.!!\nAll rights reserved."), (None, "Licensed under CC BY-NC 4.0."), (6, "word " * 50_000 + "\nThis work is licensed under the GNU General Public License, version 3."), (7, "a license to fish\nthe rights of all"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licences string")
    got = sorted(((r.doc_id, tuple(r.licences), r.n_licence_paragraphs) for r in licences.scan(df, model).collect()), key=str)
    want = [(1, ("mit",), 1), (1, ("mit",), 1), (2, (), 0), (3, (), 0), (4, (), 0), (5, ("apache", "proprietary"), 2), (None, ("cc-by-nc",), 1), (6, ("gpl",), 1), (7, (), 0)]
    assert got == sorted(want, key=str)
    assert licences.scan(df.limit(0), model).count() == 0


def test_fit_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licences.scan(docs, licences.fit(docs)).count() == 0


def test_sample_table(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    phrases = {"gpl": "GNU General Public License, version 3", "proprietary": "All rights reserved", "cc-by-nc": "CC BY-NC 4.0", "mit": "Released under the MIT License", "apache": "Apache License, Version 2.0"}
    want = {r.doc_id: sorted(f for f, p in phrases.items() if p.lower() in r.text.lower()) for r in docs.collect()}
    got = {r.doc_id: r.licences for r in licences.scan(docs, licences.fit(docs)).collect()}
    assert got == want


BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
MIT = "# Permission is hereby\n# granted, free of charge,\n# to any person obtaining\n# a copy of this software\n# and associated\n# documentation files"


def test_wrapped_licences(spark, model):
    rows = [(1, "Copyright 2020\n\n" + BSD + "\n\nmore"), (2, "some text\n" + GPL), (3, MIT), (4, BSD.replace("\n", "\n\n")), (5, "All rights reserved.\n" + BSD + "\n" + BSD), (6, "the river\n" * 3000 + BSD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.n_licence_paragraphs, [f.paragraph for f in r.found]) for r in licences.scan(df, model).collect()}
    assert got == {1: (["bsd"], 1, [2]), 2: (["gpl"], 1, [1]), 3: (["mit"], 1, got[3][2]), 4: ([], 0, []), 5: (["bsd", "proprietary"], 3, [0, 1, 3]), 6: (["bsd"], 1, [3000])}


def test_windows_are_all_that_hold_a_template():
    rng = random.Random(5)
    words = [w for t in ("bsd", "cc0") for w in licences.normal(licences.TEMPLATES[t][1].encode()).split()]
    for _ in range(50):
        start = rng.randrange(8)
        lines = [[rng.choice(words)] for _ in range(start)]
        at = 0
        while at < len(words):
            n = rng.randint(1, 9)
            lines.append(words[at : at + n])
            at += n
        got = licences.windows(lines, 0.6)
        want = []
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                own = licences._pairs(b" ".join(w for ws in lines[a : b + 1] for w in ws))
                if sum(len(ws) for ws in lines[a + 1 : b]) <= licences._INNER and any(len(own & t) / len(t) >= 0.6 for t in licences._TEMPLATE_PAIRS):
                    want.append((a, b))
        assert set(got) <= set(want)
        shortest = {w for w in want if not any(v != w and w[0] <= v[0] and v[1] <= w[1] for v in want)}
        assert shortest <= set(got)


def test_no_key_word_is_needed(spark, model):
    text = "Use in source and binary forms, with or without modification, is allowed provided that the following conditions are met."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licences.scan(df, model).first().licences == ["bsd"]


@pytest.mark.parametrize("width", [28, 45, 72])
def test_wrapped_notices_of_all_families(spark, model, width):
    cases = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts]
    wrap = lambda t, lead: "\n".join(lead + line for line in textwrap.wrap(t, width, break_long_words=False, break_on_hyphens=False))
    rows = [(i, f"Copyright 2020 by the river\n\n{wrap(t, lead)}\n\nstone light house") for lead in ("", " * ", "# ") for i, (_, t) in enumerate(cases)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.licences) for r in licences.scan(df, model).collect()]
    assert [(cases[i], found) for i, found in got if found != [cases[i][0]]] == []


def test_a_whole_licence_text(spark, model):
    mit = MIT.replace("# ", "") + ' (the "Software"), to deal\nin the Software without restriction.\n\nThe above copyright notice shall be included in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.'
    df = spark.createDataFrame([(1, "MIT License\n\nCopyright (c) 2021 Someone\n\n" + mit)], "doc_id long, text string")
    assert licences.scan(df, model).first().licences == ["mit"]


def plain_probabilities(model, text):
    """Softmax over the families of summed weights, one feature at a time."""
    _, buckets = licences.features([text])
    scores = [float(model.bias[c]) + sum(float(model.weights[b, c]) for b in buckets.tolist()) / math.sqrt(max(1, len(buckets))) for c in range(len(licences.FAMILIES))]
    parts = [math.exp((v - max(scores)) / model.temperature) for v in scores]
    return [v / sum(parts) for v in parts]


def plain_scan(model, text):
    """Every run of lines of every paragraph that begins and ends with words of a template."""
    lines = [licences.normal(line).split() for line in text.encode().split(b"\n")]
    known = set().union(*licences._TEMPLATE_PAIRS)
    out = set()
    for a in range(len(lines)):
        for b in range(a, len(lines)):
            run = lines[a : b + 1]
            if not all(run) or sum(map(len, run[1:-1])) > licences._INNER:
                break
            words = [w for line in run for w in line]
            pairs = list(zip(words, words[1:]))
            if not any(p in known for p in pairs[: len(run[0])]) or not any(p in known for p in pairs[max(0, len(words) - 1 - len(run[-1])) :]):
                continue
            p = plain_probabilities(model, b" ".join(words))
            family = licences.FAMILIES[max(range(len(p) - 1), key=p.__getitem__)]
            like = max(len(set(pairs) & t) / len(t) for t in model.pairs[family])
            named = licences.NAMED.get(family)
            if p[licences.FAMILIES.index(family)] >= 0.5 and like >= 0.6 and (a == b or not named or named & set(words)):
                out.add(family)
    return sorted(out)


def test_scan_against_plain_python(spark, model):
    rng = random.Random(8)
    pieces = [w for ts in licences.TEMPLATES.values() for t in ts for w in (t, t.lower(), " ".join(t.split()[: rng.randint(3, 30)]))]
    rows = []
    for i in range(150):
        words = " ".join(rng.choice(pieces) if rng.random() < 0.4 else rng.choice(["river stone", "the light of all", "public house", "version 3"]) for _ in range(rng.randint(1, 6))).split()
        text, at = "", 0
        while at < len(words):
            n = rng.randint(1, 14)
            text += " ".join(w for w in words[at : at + n] if rng.random() > 0.03) + rng.choice(["\n", "\n", "\n\n"])
            at += n
        rows.append((i, text))
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    want = {i: plain_scan(model, t) for i, t in rows}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert sum(map(bool, want.values())) > 60


def test_the_training_sample_is_bounded(spark):
    rows = [(i, "x " * 5000) for i in range(5)] + [(9, "a short line of the river\nanother line")]
    model = licences.fit(spark.createDataFrame(rows, "doc_id long, text string"), max_docs=10, max_paragraphs=1, max_chars=100)
    assert licences.scan(spark.createDataFrame([(1, "All rights reserved.")], "doc_id long, text string"), model).first().licences == ["proprietary"]
