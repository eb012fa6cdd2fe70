"""Placeholders, classes and names of parts against plain rules."""

import random

from quillframe.operators import compositions as K


def test_placeholders_come_back():
    rng = random.Random(1)
    for _ in range(200):
        parts = [(rng.choice(["text", "formula", "style"]), f"w{rng.randrange(99)} ") for _ in range(rng.randrange(1, 12))]
        text, used, rich = K.placeholder_text(parts, "plain source")
        got, removed = K.parsed_output(text.upper().replace("{V", "{ v ").replace("<STYLE ID=", "< style  id = "), used)
        numbers = iter(used)
        want = []
        for kind, t in parts:
            number = next(numbers)[1] if kind != "text" else None
            if kind == "text" and want and want[-1][0] == "text":
                want[-1] = ("text", None, want[-1][2] + t.upper())
            else:
                want.append((kind, number, "" if kind == "formula" else t.upper()))
        assert rich and removed == 0 and got == want


def test_placeholder_rules():
    assert K.placeholder_text([("formula", "x"), ("formula", "y")], "{V1} begins the source") == ("{v2}{v3}", [("formula", 2), ("formula", 3)], True)
    assert K.placeholder_text([("style", "a"), ("formula", "x")], "s") == ("<style id='1'>a</style>{v3}", [("style", 1), ("formula", 3)], True)
    many = [("style", "a")] * 30 + [("formula", "x")] * 20
    text, used, rich = K.placeholder_text(many, "s")
    assert not rich and text.startswith("a" * 30) and [n for _, n in used] == list(range(1, 21))
    assert K.parsed_output("a {v7} b <style id='1'>c", [("style", 1)]) == ([("text", None, "a  b c")], 2)
    assert K.parsed_output("{v7}", [], ["{v7}"]) == ([("text", None, "{v7}")], 0)
    assert K.parsed_output("", [("formula", 1)]) == ([], 0)


def test_classes_keep_their_state():
    item = lambda size=10.0, formula=False, bullet=False, space=False: {"size": size, "formula": formula, "bullet": bullet, "space": space}
    assert K.classes_of([item(), item(7), item(space=True), item(7.5), item(10)]) == ["text", "corner", "corner", "corner", "text"]
    assert K.classes_of([item(formula=True, bullet=True), item(formula=True), item(space=True), item()]) == ["text", "formula", "formula", "text"]
    assert K.classes_of([]) == []
