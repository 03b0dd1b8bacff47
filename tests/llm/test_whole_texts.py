"""Whole turns and every anchor of the text operators."""

import pytest


@pytest.mark.parametrize("address", ["12 Pewter Hill, Dunwick 36998", "7 Holm Mews, Dunwick 36998", "7 Holm View, Dunwick 36998", "3 boulevard Voltaire, 75011 Paris", "9 quai Voltaire, 75007 Paris", "4 chemin Vert, 69001 Lyon", "Kurfürstendamm 21, 10719 Berlin", "Schiffbauerufer 3, 10117 Berlin"])
def test_every_street_word_anchors_addresses(address):
    from tracemill.llm import pii

    text = f"it went to {address}. Thanks"
    assert [text[a:b] for a, b, kind in pii.Finder(pii.Roster([])).find(text) if kind == "address"] == [address]
