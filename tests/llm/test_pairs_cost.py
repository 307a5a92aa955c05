"""Problem 4: what the votes on an answer cost, and that signs and words looked for first change no vote."""

import random
import re
from time import thread_time

import pytest

from seamline.llm import p4_pairs as p4
from test_pairs_cutoffs import NO, planted

ODD = [
    "ı CANNOT do it", "I CANNOT help", "GUIDELİNES do not permit", "I ſaid I will not", "JE NE PUİS pas", "NÃO posso fazer", "Das kann ich nıcht", "réponds en FRANÇAISE", "auf Deutſch bitte", "use 中文", "my policy doeſ not allow it",
    "a/b/c.d x_y __init__ //", "a-b_c/d e_f/g", "> q\n`a` ~~~ b", "““a”b” «c» d»", "```py\nx", "No. > quoted. «x", "l’eau qu’il schung schlich thing 3th ção çãb", "1.2。\n\n!? \n.", "", "\n", "Übersicht: ʼ K ẞ",
]


def pairs():
    return [(q, a) for q, a, _ in planted(400, 5)] + [(q, a) for q in ODD for a in ODD]


def all_votes(pairs):
    for prompt, text in pairs:
        for t in (text, "Reads the rows first and sorts them by their score"):
            yield p4._empty(t), p4._copies(prompt, t), p4._refusal(t), p4._truncated(t), p4._language(prompt, t)


def test_an_answer_costs_little():
    """In units of a loop that takes about a millisecond; 1.3 to 1.7 when every pattern was tried on every sentence, else 0.5 to 0.9."""
    some = [(q, a + "\n\n" + a.replace("`", "")) for q, a, d in planted(300, 5) if not d]

    def cost(fn):
        began = thread_time()
        fn()
        return thread_time() - began

    unit = min(cost(lambda: sum(range(50_000))) for _ in range(40))
    assert min(cost(lambda: list(all_votes(some))) for _ in range(8)) / unit / len(some) < 1.1


def test_a_prompt_is_read_once_for_content_and_summary(monkeypatch):
    read = []
    monkeypatch.setattr(p4, "languages", lambda t, real=p4.languages: read.append(t) or real(t))
    prompt = "Please explain how the report of this test reads the list."
    list(all_votes([(prompt, "The report reads it first.")]))
    assert read.count(prompt) == 1


@pytest.mark.parametrize("seed", range(3))
def test_signs_and_words_looked_for_first_change_nothing(seed):
    rng = random.Random(seed)
    bits = [t for q, a in pairs() for t in (q, a)] + [t for v in NO.values() for t in v]
    texts = [rng.choice(("", " ", "\n", ". ")).join(rng.choice(bits)[: rng.randrange(1, 120)] for _ in range(rng.randrange(1, 4))) for _ in range(700)] + bits
    every = p4._code(p4._SIGNS)
    for t in (*texts, *(t.swapcase() for t in texts)):
        low = p4._folded(t)
        assert p4.prose(t) == every.sub(" ", t)
        assert all(any(w in low for w in words) for words, pattern in p4._CANNOT if pattern.search(t)), t
        assert not p4._POLITE.search(t) or any(w in low for w in p4._POLITE_WORDS), t
        assert all(any(w in low for w in p4._NAMED[k]) for k, pattern in p4._REQUESTED.items() if pattern.search(t)), t
        assert p4._normal(t) == re.sub(r"[\W_]+", "", t).casefold()
        for end, plain in ((p4._SENTENCE_END, r"(?<=[.!?])\s+|(?<=[。！？])|\n+"), (p4._PROSE_END, r"(?<=[.!?。！？])\s*|\n+")):
            assert [s for s in p4._sentences(t, end) if s] == [s for s in re.split(plain, t) if s]


def test_own_words_are_counted_as_far_as_they_decide():
    for q, t in pairs():
        (_, grams), t = p4._asked(q), p4._normal(t)
        whole = sum(t[i : i + 5] not in grams for i in range(max(1, len(t) - 4)))
        own, n = p4._own(grams, t)
        assert own == whole or 45 < own < whole and own / n > 0.5
