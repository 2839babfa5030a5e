"""Later mentions of names found after an honorific."""

import re

from factloom.llm import pii

ROWS = [
    (1, "Ian Moss came. Mr Ian Moss (10.0.0.25) spoke; Moss said, Ian's hat, Moss-bank, Mosses, moss; Mr Moss"),
    (2, "Moss and Ian are not named here, call 555-123-4567"),
    (3, "Frau Weber-Lang met Herr Lang. Weber-Lang, Lang, Langer."),
    (4, "Moss Ian"),
]


def test_mentions_get_the_surrogate_of_their_document(spark):
    got = {r["doc_id"]: r for r in pii.replace_personal_data(spark.createDataFrame(ROWS, "doc_id long, text string"), "k").collect()}
    one = re.fullmatch(r"(\w+) (\w+) came\. Mr (\w+) (\w+) \(\d\d\.\d\.\d\.\d\d\) spoke; (\w+) said, (\w+)'s hat, (\w+)-bank, Mosses, moss; Mr (\w+)", got[1]["text"])
    given, surname = one[3], one[4]
    assert (one[1], one[6]) == (given, given) and {one[2], one[5], one[7], one[8]} == {surname}
    assert not {"Ian", "Moss"} & {given, surname}
    spans = [s.split(":") for s in got[1]["spans"].split(",")]
    assert [ROWS[0][1][int(a) : int(b)] for _, a, b in spans] == ["Ian", "Moss", "Mr Ian Moss", "10.0.0.25", "Moss", "Ian", "Moss", "Mr Moss"]
    assert got[1]["n_entities"] == 8 and {k for k, *_ in spans} == {"name", "ip"}
    assert got[2]["text"].startswith("Moss and Ian are not named here") and got[2]["n_entities"] == 1
    three = re.fullmatch(r"Frau (\w+) met Herr (\w+)\. (\w+), (\w+), Langer\.", got[3]["text"])
    assert (three[3], three[4]) == (three[1], three[2])
    assert got[4]["text"] == "Moss Ian" and got[4]["n_entities"] == 0
