"""Marks of a sentence are tried only where they can begin, and are those that one pattern for all finds."""

from docfacts.operators import lexing as L


def test_marks_are_tried_where_they_begin():
    text = "US$5 million, 3%of one-half shares; ſhares per common share. 52-week value per unit: $ 7 in CASH, all units"
    want = []
    for m in L.MARKS.finditer(text, 2, len(text) - 1):
        kinds = ["derived", "unlike"] if m.lastgroup == "value" else [m.lastgroup] if m.lastgroup != "word" else L.MARK_KINDS[" ".join(m.group().lower().replace("-", " ").split())]
        want += [{"name": k, "at": m.start(), "to": m.end()} for k in kinds]
    assert want and L.marks(text, 2, len(text) - 1) == want
    assert len(L.MARKERS["s"].pattern) < len(L.MARKS.pattern) / 4
