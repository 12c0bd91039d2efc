"""Common notices, identifiers and denials; compression decides between licences whose wordings are alike."""

import random

import pytest

from textloom.llm import license_scan


@pytest.fixture(scope="module")
def scanner():
    return license_scan.Scanner(license_scan.known_wordings())


def found(scanner, text):
    return {r[0] for a, b in license_scan.candidates(text) for r in scanner._judge(text[a:b])}


@pytest.mark.parametrize(
    ("text", "licence"),
    [
        ("SPDX-License-Identifier: MIT", "MIT"), ("Released under MIT License.", "MIT"), ("Released under the MIT License.", "MIT"), ("License: Apache-2.0", "Apache-2.0"), ("Apache License 2.0", "Apache-2.0"), ("GPLv3 license", "GPL-3.0"), ("CC-BY-4.0", "CC-BY-4.0"),
        ("BSD 3-Clause License", "BSD-3-Clause"), ("GNU GPL v2 or later", "GPL-2.0"), ("Creative Commons Attribution 4.0 licence", "CC-BY-4.0"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("licensed under the BSD-2-Clause", "BSD-2-Clause"),
        ("Not released under the MIT License.", None), ("This isn't under the Apache License 2.0", None), ("My driving license is old.", None), ("The MIT team has a permission.", None), ("the licence of the zoo", None),
    ],
)
def test_notices(scanner, text, licence):
    for around in ("{}", "x y z. {} And so on.", " ".join(f"w{k}" for k in range(300)) + " {} " + " ".join(f"v{k}" for k in range(300))):
        assert found(scanner, around.format(text)) == {licence}


def family():
    """Notices of which each is close enough to others to be confirmed as them."""
    return [(n, license_scan.TEXTS[n][0]) for n in ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0")]


def test_the_closest_wins(scanner):
    for name, text in family():
        assert found(scanner, text) == {name}
        assert found(scanner, f"w {text.replace('redistribute it', 'share it')} z") == {name}


def test_random_sizes_decide_otherwise(scanner, monkeypatch):
    """Compression is what tells the licences of the family apart."""
    rng = random.Random(1)
    monkeypatch.setattr(license_scan.Scanner, "saved", lambda self, template, text, alone: rng.random())
    wrong = [found(scanner, text) != {name} for name, text in family() for _ in range(5)]
    assert any(wrong)


def test_nothing_possible_is_left_out(scanner):
    """The pass ends early only where no lower template can be there: ranks turned round give the same licences where no two compete."""
    texts = ["the MIT License, CC-BY-4.0 and GPLv3 license", *(f"a {w} b" for ws in license_scan.known_wordings().values() for w in ws[:2])]
    ranked = license_scan.Scanner.ranked
    for text in texts:
        want = found(scanner, text)
        license_scan.Scanner.ranked = lambda self, *a: ranked(self, *a)[::-1]
        try:
            assert found(scanner, text) == want
        finally:
            license_scan.Scanner.ranked = ranked
    assert found(scanner, texts[0]) == {"MIT", "CC-BY-4.0", "GPL-3.0"}
