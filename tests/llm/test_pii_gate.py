"""The gate in front of spelled digits lets everything through that they would change."""

import random

from quadrat.llm import pii

TEXTS = [
    "192.168.0.one", "call +49 30 1234 five six", "4111 1111 1111 111 one", "one 2 3 then +49 one two three 1234 5",
    "at _one_two_three_", "x4 five, six", "«one-two» 3", "192 dot 168 dot zero dot eins", "plus 49 30 1234567 null", "é 10.0.0.neun",
]


def test_spelled_gate(monkeypatch):
    rng = random.Random(1)
    parts = ["one", "zwei", "fünf", "7", "x9", "4111", "dot", "plus", "+", ".", "word", "_", "é", "(", "—"]
    texts = TEXTS + ["".join(rng.choice(parts) + rng.choice(["", " ", ", ", "-", "."]) for _ in range(7)) for _ in range(20000)]

    def taped(text):
        tape = pii.Tape(text)
        pii.spelled(tape)
        return tape.text

    assert not [t for t in texts if taped(t) != t and not pii._spells(t.lower())]
    found = [pii.extra(t, pii.base(t)) for t in texts]
    monkeypatch.setattr(pii, "_spells", lambda low: True)
    assert found == [pii.extra(t, pii.base(t)) for t in texts]
    assert pii.redacted("from 192.168.0.one") == "from [IP]" and pii.redacted("4111 1111 1111 111 one") == "[CARD]"
