import re

from seqloom.llm import surrogates as s


def test_bare_mentions_follow_the_titled_ones(spark, docs):
    rows = [
        (1, "Mr John Smith called. Smith said John's SMITH, smith or Smithson; a@b.example.com. Smith"),
        (2, "Smith said 555-1234 and no title."),
        (3, "Mrs Anna Maria Lopez O'Neil came, O'Neil left. Maria-Anna, Lopez."),
    ]
    got = {r["doc_id"]: r for r in s.replaced(docs(rows), "key").collect()}
    m = re.fullmatch(r"Mr (\w+) (\w+) called\. (\w+) said (\w+)'s (\w+), smith or Smithson; (\S+)\. (\w+)", got[1]["text"])
    assert m and m[2] == m[3] == m[7] and m[1] == m[4] and m[5] == m[2].upper() and "Smith" != m[2]
    assert got[1]["n_replaced"] == 6 and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"].startswith("Smith said ") and got[2]["n_replaced"] == 1
    n = re.fullmatch(r"Mrs (\w+) (\w+) (\w+) O'(\w+) came, O'(\w+) left\. (\w+)-(\w+), (\w+)\.", got[3]["text"])
    assert n and n[4] == n[5] != "Neil" and n[3] == n[8] and (n[6], n[7]) == (n[2], n[1]) and got[3]["n_replaced"] == 5


def test_ordinary_words_stay_where_sentences_begin(spark, docs):
    rows = [
        (1, "Mr Will Brown will go. Brown bears. Will it rain? Then Brown left, and Will: WILL."),
        (2, "Brown is he. Herr Doktor Müller-Lüdenscheidt kam. Müller ging, Lüdenscheidt blieb."),
        (3, "Mr. 山田 met Frau Prof. Dr. O’Connor-Díaz and Dr Doctor, السيدة فاطمة الزهراء and श्री मोदी, 山田."),
        (4, "Mr. Smith. Smith said no."),
    ]
    got = {r["doc_id"]: r["text"] for r in s.replaced(docs(rows), "key").collect()}
    m = re.fullmatch(r"Mr (\w+) (\w+) will go\. Brown bears\. Will it rain\? Then (\w+) left, and (\w+): (\w+)\.", got[1])
    assert m and m[2] == m[3] != "Brown" and m[1] == m[4] != "Will" and m[5] == m[1].upper()
    m = re.fullmatch(r"Brown is he\. Herr Doktor (\w+)-(\w+) kam\. (\w+) ging, (\w+) blieb\.", got[2])
    assert m and m[1] == m[3] != "Müller" and m[2] == m[4] != "Lüdenscheidt"
    m = re.fullmatch(r"Mr\. (\w+) met Frau Prof\. Dr\. O’(\w+)-(\w+) and Dr (\w+), السيدة (\w+) (\w+) and श्री (\S+), (\w+)\.", got[3])
    assert m and m[1] == m[8] != "山田" and m[2] != "Connor" and m[3] != "Díaz" and m[4] != "Doctor" and m[5] != "فاطمة" and m[7] != "मोदी"
    assert all(0x4E00 <= ord(c) < 0xA000 for c in m[1]) and all(0x600 <= ord(c) < 0x700 for c in m[5]) and all(0x900 <= ord(c) < 0x980 for c in m[7])
    m = re.fullmatch(r"Mr\. (\w+)\. (\w+) said no\.", got[4])
    assert m and m[1] == m[2] != "Smith"
