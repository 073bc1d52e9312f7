from __future__ import annotations

import pytest

from paperlode.llm import pii

CASES = [
    ("Registered contact (+91) 51543 16201, en-213@mail.example.net", [("phone", "(+91) 51543 16201"), ("email", "en-213@mail.example.net")]),
    ("Alternate e-mail <A.B+C@HOME.INVALID> was added", [("email", "A.B+C@HOME.INVALID")]),
    ("Handle @someone posted", []),
    ("Contact:022-0994 9035; mail:x_y@example.org", [("phone", "022-0994 9035"), ("email", "x_y@example.org")]),
    ("can be reached on +1 (212) 555-0109.", [("phone", "+1 (212) 555-0109")]),
    ("number is 07700 900 081", [("phone", "07700 900 081")]),
    ("Wed, 21 Oct 2020 21:58:29 +0530 paid", []),
    ("Order no. 9547285052 relates to Briash Infra Ltd.", []),
    ("Voucher 4000-1234-7079 was cancelled by Tixe Estates Ltd.", []),
    ("UTR 5332687272780315 was settled", []),
    ("Account Number : 0000000025718", []),
    ("GSTIN 27KBFZD4167K1Z5 of Fevan Foods LLP is active.", []),
    ("KYC done, Aadhaar XXXX XXXX 5274 verified for G. Telvan.", [("id_number", "XXXX XXXX 5274"), ("name", "G. Telvan")]),
    ("YOTI RUSUME (PAN APZXT8078L) is the first holder of this account.", [("name", "YOTI RUSUME"), ("id_number", "APZXT8078L")]),
    ("Passport X0915968 of Mrs. Vanvan Ricnal was sighted.", [("id_number", "X0915968"), ("name", "Vanvan Ricnal")]),
    ("Signed by Sholeyhulti, Lonivan in the presence of two witnesses.", [("name", "Sholeyhulti, Lonivan")]),
    ("Nominee: Meru B. Ornishohul, identity no. 0551 0423 4900, mobile 646-555-0130.", [("name", "Meru B. Ornishohul"), ("id_number", "0551 0423 4900"), ("phone", "646-555-0130")]),
    ("Mrs. QUAHUL BHADRE s/o Gaquajo Vamo executed the deed.", [("name", "QUAHUL BHADRE"), ("name", "Gaquajo Vamo")]),
    ("Payment was collected from V. Kogrijo, H.No. 6-94, Shosho Lane, Dalnagar - 015 651.", [("name", "V. Kogrijo"), ("address", "H.No. 6-94, Shosho Lane, Dalnagar - 015 651")]),
    ("Address: 36, Xeor Marg, Metileygaon, Pamirhalli 098616", [("address", "36, Xeor Marg, Metileygaon, Pamirhalli 098616")]),
    ("Plot 646, Sector 425, Telseltikot is described in the schedule.", []),
    ("| 1 | RENT Varugaon FLAT 110 | NEFT Endrenal Naltch RENT | UPI/Bribri, Ponmo/payment | SALARY Mirtel Textiles Ltd |", [("name", "Endrenal Naltch"), ("name", "Bribri, Ponmo")]),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_find(text, want):
    spans = pii.find(text, pii.automaton())
    assert [(k, text[a:b]) for a, b, k in spans] == want
    red = pii.redact(text, spans)
    for k, v in want:
        assert f"[{k.upper()}]" in red and v not in red


def test_tables(spark):
    chunks = spark.createDataFrame([("d", 1, "Dear Dr. Asha Rao, write to a@b.example", "x"), ("d", 2, None, "x"), ("d", 3, "", "x"), ("d", 1, "Dear Dr. Asha Rao, write to a@b.example", "x"), ("e", 1, "plain " * 50_000, "x")], "doc_id string, chunk_index int, text string, origin string")
    lines = spark.createDataFrame([("l", 5, "Name : Shri Asha Rao", "x"), ("l", 6, None, "x")], "doc_id string, line_no int, text string, seq string")
    assert {tuple(r) for r in pii.found(chunks, lines).collect()} == {("chunk", "d", 1, "name", "Asha Rao"), ("chunk", "d", 1, "email", "a@b.example"), ("line", "l", 5, "name", "Asha Rao")}
    assert pii.found(chunks.limit(0), lines.limit(0)).count() == 0
    red = [(r.doc_id, r.seq, r.text) for r in pii.redacted(chunks, lines).collect()]
    assert len(red) == 7 and red.count(("d", 1, "Dear Dr. [NAME], write to [EMAIL]")) == 2 and ("d", 2, None) in red and ("l", 5, "Name : Shri [NAME]") in red
