"""Notices that deny a license aren't notices of it."""

from __future__ import annotations

import pytest

from tessera.llm.licenses import licenses

from .helpers import documents

CASES = [
    ("This project is licensed under the MIT License.", ["MIT"]),
    ("This project is not licensed under the MIT License.", []),
    ("This project is no longer licensed under the MIT License.", []),
    ("It isn't licensed under the MIT License.", []),
    ("Licensed under the not quite MIT License.", []),
    ("We did not. Licensed under the MIT License.", ["MIT"]),
    ("Whether or not\nLicensed under the MIT License.", ["MIT"]),
    ("Not all of this is licensed under the MIT License.", ["MIT"]),
    ("not Licensed under the MIT License. Later: Licensed under the ISC License.", ["ISC"]),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = licenses(documents(spark, [(k, t) for k, (t, _) in enumerate(CASES)])).collect()
    return {k: sorted(r["license"] for r in rows if r["doc_id"] == k) for k in range(len(CASES))}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_denials(found, k):
    assert found[k] == CASES[k][1]


def test_texts_that_deny_by_themselves(spark):
    """A license's own "not" is matched, so it denies nothing."""
    from tessera.llm.license_templates import TEMPLATES

    text = TEMPLATES["MPL-2.0"][0].replace("{", "").replace("}", "")
    assert [r["license"] for r in licenses(documents(spark, [(1, text)])).collect()] == ["MPL-2.0"]
