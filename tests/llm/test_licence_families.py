"""Licence families beside the first ones, and rules of one's own."""

import pytest

from tessera.llm import licences


@pytest.mark.parametrize(
    ("text", "licence"),
    [
        ("All rights reserved.", "LicenseRef-All-Rights-Reserved"),
        ("// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;", "LGPL-2.1-or-later"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("Licensed under CC BY-NC-SA 3.0.", "CC-BY-NC-SA-3.0"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
        (licences.SENTENCES.get("agpl3-free", ""), "AGPL-3.0-or-later"),
        (licences.SENTENCES.get("epl2", ""), "EPL-2.0"),
        (licences.SENTENCES.get("cc0-named", ""), "CC0-1.0"),
    ],
)
def test_families(text, licence):
    found = licences.licences(f"Some words.\n{text}\nMore words.")
    assert found[0] == 1 and [x[0] for x in found[1]] == [licence]


def test_each_sentence_is_found_alone():
    for key, sentence in licences.SENTENCES.items():
        assert [x[0] for x in licences.identifiers(f"Words.\n{sentence}\nwords")] == [key]


def test_rules_are_parameters(spark):
    docs = spark.createDataFrame([(1, "Use it as you like.\nBe kind."), (2, "All rights reserved.")], "doc_id long, text string")
    got = licences.scan(docs, {"use": "Use it as you like.", "kind": "Be kind."}, [("Own", ("use", "kind"))])
    assert sorted((r["doc_id"], r["n_sentences"], r["licences"]) for r in got.collect()) == [(1, 2, ["Own"]), (2, 0, [])]
    with pytest.raises(ValueError):
        licences.scan(docs, {"use": "Use it."}, [("Own", ("other",))])
