import random
import re

import pytest

from portolan.llm import licences
from portolan.llm.common import table

KNOWN = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Released under the MIT License.": "mit",
}


def test_table_finds_exactly_the_notices(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert len(out) == len(texts)
    for i, text in texts.items():
        lines = text.split("\n")
        assert out[i].families == sorted({f for line, f in KNOWN.items() if line in lines}), (i, out[i])
        assert out[i].n_licence == sum(line in KNOWN for line in lines)


def test_odd_rows(documents):
    rnd = random.Random(2)
    prose = lambda: " ".join("".join(rnd.choice("aeioumnrst") for _ in range(5)) for _ in range(40))
    rows = [(i, prose() + "\n" + prose()) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (None, "Released under the MIT License."), (103, "日本語 é"), (104, ("x y z " * 20_000) + "\nLicensed under the Apache License, Version 2.0.")]
    rows += [(105, prose() + " Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: " + prose())]
    rows += [(106, "the license of the work is under the sea of version"), (107, "licensed  UNDER the mit LICENSE"), (0, rows[0][1]), (0, rows[0][1])]
    df = documents(rows, extra=("content", "at", "words", "gram", "family", "w0", "probability"))
    out = licences.scan(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[None].families == ["mit"] and by[104].families == ["apache"] and by[105].families == ["bsd"] and by[107].families == ["mit"]
    assert all(by[i].families == [] and by[i].n_licence == 0 for i in (0, 1, 100, 101, 102, 103, 106))
    assert by[100].n_paragraphs == by[102].n_paragraphs == 0 and by[0].n_paragraphs == 2
    assert all(r.probability is None or 0 <= r.probability <= 1 for r in out)
    assert licences.scan(df.limit(0)).count() == 0


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."
OUTSIDE = "Licensed under the Zebra Community Terms, edition 7. You may copy the work if you keep this note."


def wrapped(text, width, lead):
    out, line = [], lead
    for word in text.split(" "):
        if len(line) + len(word) > width:
            out.append(line)
            line = lead
        line += " " + word
    return "\n".join([*out, line])


def test_notices_over_line_ends_joined_half_and_unknown(documents):
    rnd = random.Random(3)
    prose = lambda n=40: " ".join("".join(rnd.choice("aeioumnrst") for _ in range(5)) for _ in range(n))
    both = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    cases = [
        (MIT.replace("to any", "\nto any"), ["mit"], 1), (wrapped(GPL, 70, " *"), ["gpl"], 1), (wrapped(GPL, 30, "#"), ["gpl"], 1), (both, ["apache", "mit"], 2),
        (prose(133) + "\n" + wrapped(MIT, 50, "//") + "\n" + prose(60) + "\n" + wrapped(GPL, 44, "") + prose(), ["gpl", "mit"], 2),
        (" ".join(GPL.split(" ")[:13]), [], 0), (" ".join(MIT.split(" ")[10:]), [], 0), (OUTSIDE, [], 0), (wrapped(OUTSIDE, 30, "#"), [], 0),
        ("Released under the MIT License.\n" * 3, ["mit"], 3), ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"], 1), ("Licensed under CC BY 4.0.", ["cc-by"], 1),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.", ["cc-by-sa"], 1),
        ("This library is licensed under the GNU Lesser General Public License, version 2.1.", ["lgpl"], 1),
    ]
    cases += [(prose(k) + " " + GPL, ["gpl"], 1) for k in range(30, 90, 7)]  # at every place against the windows
    rows = [(i, prose() + "\n" + prose()) for i in range(100, 180)] + [(i, t) for i, (t, _, _) in enumerate(cases)]
    out = {r.doc_id: r for r in licences.scan(documents(rows)).collect()}
    for i, (text, families, n) in enumerate(cases):
        assert (out[i].families, out[i].n_licence) == (families, n), (text, out[i])
        words = re.findall(licences.WORD, text.lower())
        for found in out[i].notices:  # the span holds the notice's words
            piece = " ".join(words[found.first_word : found.last_word + 1])
            own = [" ".join(re.findall(licences.WORD, t.lower())) for f, t in licences.NOTICES if f == found.family]
            assert any(piece in t or t in piece for t in own), (piece, found)
    assert all(out[i].n_licence == 0 for i in range(100, 180))


def test_every_notice_is_found_whole_and_fits_a_window(documents):
    rows = [(i, f"w{i} x y z\n{t}\nand so on") for i, (_, t) in enumerate(licences.NOTICES)] + [(100 + i, f"plain {i} words only here") for i in range(50)]
    out = {r.doc_id: r for r in licences.scan(documents(rows)).collect()}
    assert all(out[i].families == [f] and out[i].n_licence == 1 for i, (f, _) in enumerate(licences.NOTICES))
    assert max(len(re.findall(licences.WORD, t.lower())) for _, t in licences.NOTICES) <= licences.STRIDE


def test_copies_do_not_change_the_probability(documents):
    prose = [(i, " ".join(f"p{i}x{k}" for k in range(30))) for i in range(40)]
    notice = (100, "Released under the MIT License.")
    once, often = (licences.scan(documents(prose + [notice] * n)).filter("n_licence > 0").collect() for n in (1, 5))
    assert len(once) == 1 and len(often) == 5 and {r.probability for r in often} == {once[0].probability}


def test_plan_has_no_python(spark, sf_dir):
    plan = licences.scan(table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
