"""Problems 5 and 8 without limits of depth, layers and scripts."""

import random

import pytest

from seamline.llm import p5_syntax as p5
from seamline.llm import p8_encoding as p8


@pytest.mark.parametrize("name", ["a.json", "a.toml", "a.js", "a.ts", "a.py"])
def test_unclosed_depth_is_invalid(name):
    lead = "x = " if name.endswith(("toml", "js", "ts", "py")) else ""
    assert p5.verdict(lead + "[" * 20_000, name)[1] is False


@pytest.mark.parametrize("name", ["a.json", "a.toml", "a.js", "a.ts"])
def test_closed_depth_is_valid(name):
    lead = "" if name == "a.json" else "x = "
    assert p5.verdict(lead + "[" * 3000 + "]" * 3000, name)[1] is True


def test_json_by_a_stack_matches_the_parser():
    rng = random.Random(5)
    bits = ["{", "}", "[", "]", ",", ":", '"a"', "1", "-0.5e3", "true", "nul", " ", "\n", '"\\u00e9"', '"\\x"', "01"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        assert (p5._json_of_any_depth(text) is None) == (p5._json(text) is None), text
    assert p5._json_of_any_depth('{"a": [1, {"b": "c"}], "d": {}}') is None and p5._json_of_any_depth("[1,\n2,\n]") == 3


def test_any_number_of_layers():
    text = "Der Bericht über die Größe der Übersicht wäre schön, außer für Gäste."
    bad = text
    for _ in range(6):
        bad = bad.encode().decode("latin-1")
    assert p8.repair(bad)[:2] == (text, True) and p8.repair(bad)[3] == 6 and p8.repair(bad)[7] == "round trip"


@pytest.mark.parametrize("text", ["これは日本語の文章です。設定を確認してください。", "Это обычный русский текст, проверьте настройки.", "Αυτό είναι ένα κανονικό κείμενο στα ελληνικά.", "이것은 한국어 문장입니다."])
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252"])
def test_other_scripts_are_restored(text, wrong):
    bad = "".join(chr(b) if (c := bytes([b]).decode(wrong, "replace")) == "�" else c for b in text.encode())
    assert p8.repair(bad)[:3] == (text, True, False)
    assert p8.repair(text) is None


def test_what_shows_the_damage():
    assert p8.repair("plain text, then �� and more")[7] == "marker"
    assert p8.repair("When you see `MÃ¼llerstraÃŸeninselbrÃ¼cke` in a log, check it.") is None
