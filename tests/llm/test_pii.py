import random
import time

import pytest

from netbehave.llm import pii
from tests.llm.conftest import by_id

KEY = b"key"
RNG = random.Random(4)


def number(n):
    return "".join(RNG.choice("0123456789") for _ in range(n))


def made_card():
    payload = number(15)
    return payload + str(-pii.luhn_sum(payload + "0") % 10)


MADE = {
    "card": made_card,
    "ip": lambda: ".".join(str(RNG.randint(0, 255)) for _ in range(4)),
    "phone": lambda: f"+1 ({number(3)}) 555-{number(4)}",
    "ssn": lambda: f"{RNG.randint(1, 665):03d}-{RNG.randint(1, 99):02d}-{RNG.randint(1, 9999):04d}",
    "iban": lambda: "DE89 3704 0044 0532 0130 00",
    "email": lambda: f"aB.{number(2)}x@mail1.example.com",
    "date": lambda: RNG.choice(
        [
            f"{RNG.randint(1900, 2099)}-{RNG.randint(1, 12):02d}-{RNG.randint(1, 28):02d}",
            f"{RNG.randint(1, 28):02d}.{RNG.randint(1, 12):02d}.{RNG.randint(1900, 2099)}",
            f"{RNG.randint(1, 12):02d}/{RNG.randint(13, 28):02d}/{RNG.randint(1900, 2099)}",
        ]
    ),
}


def test_permutation_is_one_to_one():
    for size in (1, 2, 3, 10, 97, 1000):
        permutation = pii.Permutation(KEY, "x", size)
        values = [permutation.forward(value) for value in range(size)]
        assert sorted(values) == list(range(size))
        assert [permutation.backward(value) for value in values] == list(range(size))


def test_pseudonyms_keep_kind_and_turn_back():
    for kind, make in MADE.items():
        for _ in range(40):
            value = make()
            text = f"before {value}!! after"
            ((start, end, found, new),) = pii.pseudonyms(text, KEY)
            assert (found, text[start:end]) == (kind, value)
            assert [c.isdigit() for c in new] == [c.isdigit() for c in value] or kind == "ip"
            replaced = pii.replaced(text, pii.pseudonyms(text, KEY))
            assert pii.replaced(replaced, pii.pseudonyms(replaced, KEY, back=True)) == text


def test_invalid_values_stay():
    card = made_card()
    wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
    for text in (wrong, "256.1.1.1", "1.2.3.4.5", "2023-02-30", "000-12-3456", "DE88370400440532013000"):
        assert pii.pseudonyms(f"x {text} y", KEY) == []


def test_equal_values_stay_linked():
    card = made_card()
    spaced = " ".join(card[at : at + 4] for at in range(0, 16, 4))
    ((*_, one),) = pii.pseudonyms(f"a {card}", KEY)
    ((*_, two),) = pii.pseudonyms(f"other {spaced}.", KEY)
    assert two.replace(" ", "") == one != card
    assert pii.pseudonyms(f"a {card}", b"other")[0][3] != one


def test_results(docs, odd, none):
    mail = "x me.12@mail.example.com y me.12@mail.example.com"
    row = pii.pseudonymized(docs([mail]), KEY).first()
    assert row["n_email"] == 2 and row["spans"] == "email:2:24,email:27:49"
    assert "me.12@" not in row["text"]
    assert pii.pseudonymized(docs([row["text"]]), KEY, back=True).first()["text"] == mail
    found = by_id(pii.pseudonymized(odd, KEY))
    assert found[1]["text"] is None and found[2]["text"] == "" and found[1]["spans"] == ""
    given = by_id(odd)
    assert all(found[at]["text"] == given[at]["text"] for at in given)
    assert pii.pseudonymized(none, KEY).collect() == []


def test_values_next_to_other_groups():
    card, account = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    for text, value in (
        (f"order 12 {card}", card),
        (f"{card} 123", card),
        (f"2024 {card}", card),
        (f"2024-{card.replace(' ', '-')} x", card.replace(" ", "-")),
        (f"+1 555-123-4567 {card}", card),
        (f"{account} EUR", account),
        (f"paid {account} FROM", account),
    ):
        spans = pii.pseudonyms(text, KEY)
        assert value in [text[start:end] for start, end, *_ in spans], text
        assert value not in pii.replaced(text, spans)


@pytest.mark.parametrize("n", [60, 64, 100, 300, 512, 513, 5000])
def test_long_local_parts_are_mixed_throughout(n):
    """No stretch of a long address stays readable, and the pseudonym turns back."""
    local = "".join("abcdefghijklmnopqrstuvwxyz"[i % 26] for i in range(n))
    found = pii.pseudonyms(f"{local}@example.com", KEY)[0][3]
    same = sum(a == b for a, b in zip(local, found))
    assert same < n / 6 and sum(a == b for a, b in zip(local[:20], found)) < 7
    assert pii.pseudonyms(found, KEY, back=True)[0][3] == f"{local}@example.com"


def test_long_texts_take_time_in_proportion():
    day = "on 2024-03-17, "
    texts = [day * 50_000, "a1B2" * 250_000, "x@" * 200_000, "a" * 1_000_000 + "@b.cd", "a.b-" * 250_000 + "@"]
    before = time.monotonic()
    spans = [pii.pseudonyms(text, KEY) for text in texts]
    assert time.monotonic() - before < 30
    assert [len(one) for one in spans] == [50_000, 0, 0, 1, 0]


def test_addresses_equal_a_search_by_the_pattern():
    draw = random.Random(8)
    pattern = pii.COMPILED[0][1]
    for _ in range(3000):
        text = "".join(draw.choice("ab1.-_@@ +") for _ in range(draw.randrange(1, 25)))
        text += draw.choice(["", "@a.bc", "@a-b.c.de "])
        for at in range(len(text)):
            want, got = pattern.search(text, at), pii.email_match(text, at)
            assert (want and want.span()) == (got and got.span()), (text, at)


def test_taken_spans_are_in_order_and_disjoint():
    draw = random.Random(9)
    parts = ["4111 1111 1111 1111", "2024-03-17", "078-05-1120", "10.0.0.1", "a1@b.cd", "+1 555 123 4567", "12", "-", " "]
    for _ in range(500):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 12)))
        spans = pii.pseudonyms(text, KEY)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
