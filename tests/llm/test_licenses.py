import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidemark.llm import licenses
from tidemark.llm.common import table

WORDING = {"Apache": "apache", "GNU General": "gpl", "CC BY-NC": "cc-by-nc", "CC BY-SA": "cc-by-sa", "CC BY 4": "cc-by", "MIT": "mit", "All rights": "proprietary"}


@pytest.fixture(scope="module")
def model(spark, sf):
    return licenses.fit(table(spark, sf, "documents"))


def test_every_notice_in_the_table_and_no_other(spark, model):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in df.collect()}
    found = {r.doc_id: r.x for r in licenses.scan(df, model, out="x").select("doc_id", "x").collect()}
    wanted = 0
    for i, text in texts.items():
        lines = [x for x in text.split("\n") if licenses.tokens(x)]
        assert found[i].n_paragraphs == len(lines)
        want = {(k, family) for k, x in enumerate(lines) if re.search(r"(?i)licensed? under|released under|all rights reserved", x) for wording, family in WORDING.items() if wording in x}
        assert {(f.paragraph, f.family) for f in found[i].found if f.confirmed} == want
        wanted += len(want)
    assert wanted > 10


def test_held_out_variants(model):
    rng, right, total = np.random.default_rng(99), 0, 0
    for family, texts in licenses.TEMPLATES.items():
        for words in map(licenses.tokens, texts):
            for _ in range(20):
                p = model.probabilities(licenses._variants(rng, words, [["some", "other", "words", "here"]]))
                right += p is not None and p.argmax() == licenses.FAMILIES.index(family)
                total += 1
    assert right / total > 0.93


def test_other_uses_of_the_words_are_unknown(model):
    assert [f for t in licenses.OTHER for f in model.of(t)[1] if f["confirmed"]] == []
    assert model.of("Renew your driving license before the version on file expires.")[1] in ([],) or not model.of("Renew your driving license.")[1]


def test_long_paragraph_and_odd_texts(spark, docs, model):
    long = "word " * 900 + "Licensed under CC BY-NC 4.0. " + "word " * 900
    rows = licenses.query(spark, docs(ODD + [long]).withColumn("x", F.lit("clash"))).orderBy("doc_id").collect()
    assert [r.n_confirmed for r in rows] == [0] * len(ODD) + [1] and rows[-1].families == "cc-by-nc"
    assert licenses.query(spark, docs([])).count() == 0


def test_wrapped_and_several_notices(model):
    mit = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License."
    confirmed = lambda text: [(f["paragraph"], f["family"]) for f in model.of(text)[1] if f["confirmed"]]
    assert [confirmed(x) for x in (mit, bsd, gpl)] == [[(0, "mit")], [(0, "bsd")], [(0, "gpl")]]
    assert confirmed("Some title\n\n" + mit + "\n\n" + gpl) == [(1, "mit"), (3, "gpl")]
    dual = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    assert confirmed(dual) == [(0, "apache"), (0, "mit")]
    assert confirmed("word " * 90 + dual + " word" * 90 + " " + " ".join(gpl.split()) + " word" * 30) == [(0, "apache"), (0, "gpl"), (0, "mit")]


def test_common_n_grams_are_counted_over_all_documents(spark, docs):
    texts = ["plain text of no use"] * 300 + ["the terms of the house"] * 700
    assert {"terms of the", "of the", "terms"} <= licenses.common_grams(docs(texts)) and "use" in licenses.common_grams(docs(texts))
    assert licenses.common_grams(docs(["Released under the MIT License."] * 9 + ["nothing here"])) == set()
    assert licenses.common_grams(docs([])) == set()


#: Notices as they stand in files, none of which is a template.
FILES = {
    "mit": "Copyright (c) 2020 The Authors\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the 'Software'), to deal\nin the Software without restriction",
    "isc": " * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above\n * copyright notice and this permission notice appear in all copies.",
    "agpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Affero General Public License as published by\n# the Free Software Foundation, either version 3 of the License",
    "gpl": "/* This program is free software: you can redistribute it and/or modify\n   it under the terms of the GNU General Public License as published by\n   the Free Software Foundation, version 3. */",
    "bsl": "// Permission is hereby granted, free of charge, to any person or organization\n// obtaining a copy of the software and accompanying documentation covered by\n// this license (the 'Software') to use",
    "epl": "This program and the accompanying materials\nare made available under the terms of the Eclipse Public License 2.0\nwhich is available at the site",
    "unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it.",
    "apache": "# SPDX-License-Identifier: Apache-2.0\nimport os",
}


def test_notices_as_they_stand_in_files():
    model = licenses.fit_texts([licenses.tokens(t) for t in licenses.OTHER] * 3, set())
    for family, text in FILES.items():
        assert {f["family"] for f in model.of(text)[1] if f["confirmed"]} == {family}, (family, model.of(text))
    for text in licenses.OTHER:
        assert not [f for f in model.of(text)[1] if f["confirmed"]]


def test_ids_null_repeated_and_long_texts(spark, docs):
    long = "plain words go on and on. " * 4000 + "\n\nReleased under the MIT License."
    rows = licenses.query(spark, docs([(None, long, "s"), (None, long, "s"), (1, long, "s"), (1, long, "s"), (2, None, "s")])).collect()
    assert sorted((r.doc_id or 0, r.families) for r in rows) == [(0, "mit")] * 2 + [(1, "mit")] * 2 + [(2, "")]


def confirmed(model, text):
    return [f["family"] for f in model.of(text)[1] if f["confirmed"]]


def test_every_notice_of_a_line(model):
    """Wordings that aren't the templates'."""
    for text, families in (
        ("Licensed under the MIT license. Released under the Apache 2.0 license.", ["apache", "mit"]),
        ("You may use it under the Apache 2.0 license and the MIT license.", ["apache", "mit"]),
        ("# SPDX-License-Identifier: MIT OR Apache-2.0", ["apache", "mit"]),
        ("# SPDX-License-Identifier: (GPL-2.0-only WITH x) AND BSD-3-Clause", ["gpl"]),
        ("Licensed under the MIT license.", ["mit"]),
        ("Released under the MIT License. Some words between. Released under the MIT License.", ["mit", "mit"]),
    ):
        assert confirmed(model, text) == families, (text, model.of(text))


def test_thousands_of_notices_in_a_line_take_a_second(model):
    import time

    took = []
    for n in (2_000, 20_000):
        began = time.time()
        got = model.of("Released under the MIT License. " * n)[1]
        took.append(time.time() - began)
        assert len(got) == n and all(f["confirmed"] and f["family"] == "mit" for f in got)
    assert took[1] < 40 * max(took[0], 0.05)


def test_the_sample_is_of_all_stretches_by_hash(spark, docs):
    texts = [f"word{k} alone here" for k in range(500)] + ["long " * 60_000 + f"tail{k}" for k in range(3)] + ["word1 alone here", None, ""]
    want = sorted({" ".join(w) for t in texts for line in licenses.paragraphs(t) for w in licenses.stretches(line)}, key=licenses.xxh64_intdigest)[:50]
    assert [" ".join(w) for w in licenses.corpus_counts(docs(texts).repartition(5), 50)[1]] == want
