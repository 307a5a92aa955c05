"""Problem 8: damage that looks like a mention, and mentions beside damage."""

import pytest

from seamline.llm import p8_encoding as p8

ZH = "请先打开“动作列”，因为`配置`依赖这个文件。另外，当学生名单为空时，这里读取默认值。"
FR = "Il reste à décider si la « moyenne générale » doit être triée, puisqu’elle n’est pas prête."


def misread(text, layers, wrong):
    table = {b: bytes([b]).decode(wrong, "replace") for b in range(256)}
    for _ in range(layers):
        text = "".join(chr(b) if table[b] == "\ufffd" else table[b] for b in text.encode())
    return text


@pytest.mark.parametrize("layers", [1, 2])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1"])
def test_quotation_in_garbled_text_is_restored(layers, wrong):
    assert p8.repair(misread(ZH, layers, wrong))[:3] == (ZH, True, False)


def test_short_names_in_backticks_are_restored():
    text = "Keys:\n" + misread("- `配置`\n- 请先打开配置文件\n", 1, "cp1252")
    assert p8.repair(text)[0] == "Keys:\n- `配置`\n- 请先打开配置文件\n"


def test_a_mention_stays_beside_damage_and_below_a_layer():
    told = "When the log shows `Ã©` for a letter, check it.\n"
    text = f"{told}{FR}\n{misread(FR, 1, 'latin-1')}\n"
    assert p8.repair(text)[0] == f"{told}{FR}\n{FR}\n"
    assert p8.repair(misread(told + FR, 1, "latin-1"))[0] == told + FR
    assert p8.repair(told) is None
