"""One person under several honorifics; IBANs; one class for all names."""

import re

from factloom.llm import pii


def _run(spark, rows):
    return {r["doc_id"]: r for r in pii.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}


def test_gender_belongs_to_the_person(spark):
    got = _run(spark, [(1, "Dr Ian Moss met Mr Ian Moss, Ian, Prof Moss"), (2, "Dr Ian Moss"), (3, "Dr Kim Lee met Dr Kim Park"), (4, "Mr Ian Moss; Mr Ian")])
    a = re.fullmatch(r"Dr (\w+) (\w+) met Mr (\w+) (\w+), (\w+), Prof (\w+)", got[1]["text"])
    assert a[1] == a[3] == a[5] and a[2] == a[4] == a[6] and a[1].endswith(("n", "ro"))
    assert got[2]["text"] == f"Dr {a[1]} {a[2]}"  # the corpus knows the gender
    b = re.fullmatch(r"Dr (\w+) (\w+) met Dr (\w+) (\w+)", got[3]["text"])
    assert b[1] == b[3] and b[2] != b[4]
    assert got[4]["text"] == f"Mr {a[1]} {a[2]}; Mr {a[1]}"


def test_ibans(spark):
    got = _run(spark, [(1, "pay DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not DE88 3704 0044 0532 0130 00."), (2, "again GB82WEST12345698765432")])
    one = re.fullmatch(r"pay (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) or (GB\d\d[A-Z]{4}\d{14}), not DE88 3704 0044 0532 0130 00\.", got[1]["text"])
    assert one and got[2]["text"] == f"again {one[2]}"
    for iban in (one[1].replace(" ", ""), one[2]):
        assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[1]["spans"] == "iban:4:31,iban:35:57"


def test_names_of_all_kinds_stay_distinct(spark):
    words = [f"{a}{b}" for a in "ABCDEFGHIJ" for b in "abcdefghij"]
    rows = [(kind, w) for kind in ("given male", "given female", "given any", "surname") for w in words]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, value string"), "k").collect()
    made = [r["surrogate"] for r in got]
    assert len(got) == 400 and len(set(made)) == 400 and not set(made) & set(words)
